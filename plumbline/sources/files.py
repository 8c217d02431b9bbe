"""Helpers shared by the file readers."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with their file and a number that grows along the file; large files are split."""
    text = spark.read.option("recursiveFileLookup", "true").text(paths if isinstance(paths, str) else list(paths))
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), F.regexp_replace("value", "^﻿", "").alias("value"),
    )


_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?/*"


def _root(path: str) -> str:
    """The folder that holds everything a path names: what stands before its first pattern character."""
    plain = "/" + re.sub(_SCHEME, "", path).lstrip("/") if re.match(_SCHEME, path) else path
    if not plain.startswith("/"):
        plain = os.path.abspath(plain)
    fixed = re.split(r"[*?\[{]", plain, maxsplit=1)
    return (fixed[0].rpartition("/")[0] if len(fixed) > 1 else fixed[0]).rstrip("/")


def _below_root(path: Column, roots: str | Sequence[str]) -> Column:
    """A file's path below the longest of the roots that holds it; empty if the root is the file itself."""
    plain = F.concat(F.lit("/"), F.regexp_replace(path, _SCHEME, ""))
    known = sorted({_root(r) for r in ([roots] if isinstance(roots, str) else roots)}, key=len, reverse=True)
    inside = [F.when(plain == r, "").when(plain.startswith(r + "/"), F.substring(plain, len(r) + 2, 1 << 30)) for r in known]
    return F.coalesce(*inside, plain)


def folder_key(path: Column, roots: str | Sequence[str]) -> Column:
    """What a file belongs to: its folder below the root it was read from, so that ``A/sparse/0`` and ``B/sparse/0`` differ.

    A file that was named itself, or lies in the root, belongs to the folder that holds it.
    """
    below = F.regexp_extract(_below_root(path, roots), r"^(.*)/[^/]*$", 1)
    return F.when(below != "", below).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def stem_key(path: Column, roots: str | Sequence[str]) -> Column:
    """Like :func:`folder_key`, but every file is one thing: folder below the root, and name without ending."""
    below = F.regexp_extract(_below_root(path, roots), r"^(.*/)[^/]*$", 1)
    return F.concat(below, file_stem(path))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def tokens(value: Column) -> Column:
    return F.split(F.trim(value), r"\s+")


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that a path or URI names, and the path within it."""
    plain = re.sub("^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), plain) if plain.startswith("/") else pa.fs.FileSystem.from_uri(plain)


def open_binary(path: str) -> pa.NativeFile:
    """A file to read from any task, on whatever file system its URI names."""
    fs, inner = file_system(path)
    return fs.open_input_file(inner)
