"""SimHash fingerprints and near-duplicate classes through an inverted index of byte positions.

A fingerprint of b bytes with at most d differing bits differs in at most d byte positions, so two linked
fingerprints share at least b - d positional bytes: the guaranteed minimum. An index of single bytes would have lists
of 1/256 of all fingerprints, and tallying their pairs would grow with the square of the corpus. The index here holds
one list for each set of b - d positions (28 sets of six for 64 bits and 2 differing bits): a pair's tally reaches the
minimum exactly if the pair meets in a list, so the count filter needs no pairs below it. Members of a list differ in
d bytes at most, which bounds a list to 65,536 distinct fingerprints. They are verified bit by bit: each looks up its
136 variants of one or two flipped bits in the list. A list reports a spanning star for each of its local classes, not its pairs,
so a group of thousands of copies costs one row each, and loses no link.

Defined cases: a null text has no words; texts without words have the fingerprint zero and are linked like others;
fewer words than a shingle make one shingle; repeated rows each get their result; null ids only name a component if it
has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions, slices, utf8
from plumbline.llm.components import components
from plumbline.session import cut

SEED = 42
#: of the linked fingerprints
DIFFERING_BITS = 2
_BYTES = 8
_MASK64 = (1 << 64) - 1

#: for each byte value its bits, one in each byte of a long
_SPREAD = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.uint8).view(np.uint64).ravel()


def shingle_hashes(parts: list[bytes], words: int) -> list[int]:
    """XXH64 of every run of ``words`` words joined by spaces; of all words if there are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [digest(joined, SEED)]
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    return [digest(joined[start : end - 1], SEED) for start, end in zip(starts, ends[words - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray, longs: int = 1) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes, as ``8 * longs`` bytes each, lowest first.

    Bits are summed in bytes of a long, at most 255 hashes at a time, and these sums per group.
    """
    out = np.zeros((len(counts), 8 * longs), np.uint8)
    full = np.flatnonzero(counts)
    if not full.size:
        return out
    sizes = counts[full]
    pieces = -(-sizes // 255)
    first_piece = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    group_start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    piece_start = np.repeat(group_start - 255 * first_piece, pieces) + 255 * np.arange(pieces.sum())
    for long in range(longs):
        h = hashes
        if long:  # further independent hashes of the same shingles
            h = (hashes + np.uint64(long)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        octets = h.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            sums = np.add.reduceat(_SPREAD[octets[:, byte]], piece_start).view(np.uint8).reshape(-1, 8).astype(np.int32)
            ones = np.add.reduceat(sums, first_piece, axis=0)
            out[full, 8 * long + byte] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").ravel()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""
    source = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            counts, parts = [], []
            for value in batch.column("bytes").to_pylist():
                hashes = shingle_hashes(value.lower().split(), words)
                counts.append(len(hashes))
                parts.append(np.array(hashes, np.uint64))
            fp = majority(np.concatenate(parts), np.array(counts)).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def byte_sets(differing: int = DIFFERING_BITS) -> list[tuple[int, int]]:
    """For each set of positional bytes that linked fingerprints may share: the mask of these bytes, and of the others."""
    sets = []
    for others in combinations(range(_BYTES), differing):
        other = sum(0xFF << 8 * b for b in others)
        sets.append((_MASK64 ^ other, other))
    return sets


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(mask: int, differing: int) -> np.ndarray:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return np.array([sum(c) for n in range(1, differing + 1) for c in combinations(bits, n)], np.uint64).view(np.int64)


def stars(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between indices a and b as a star for each class: every value but the smallest, with the smallest."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(values)))
    return values[out], values[label[out]]


def links(distinct: DataFrame, differing: int = DIFFERING_BITS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` with at most ``differing`` differing bits."""
    sets = byte_sets(differing)
    posting = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("m")) for i, (m, _) in enumerate(sets)]))
    postings = distinct.select("fp", posting.alias("p")).select("p.s", "p.m", "fp")
    postings = postings.repartition(partitions(distinct.sparkSession), "s", "m").sortWithinPartitions("s", "m", "fp")
    flips = [_flips(other, differing) for _, other in sets]

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sets and fingerprints of all lists with two members or more, about 100,000 rows at a time, lists whole."""
        rest = [np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        ready, held = [], 0

        def several(s, m, fp):
            same = np.zeros(len(s) + 1, bool)
            same[1:-1] = (s[1:] == s[:-1]) & (m[1:] == m[:-1])
            keep = same[1:] | same[:-1]
            return s[keep], fp[keep]

        for batch in batches:
            s, m, fp = (np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns))
            if not len(s):
                continue
            cut_at = int(np.flatnonzero((s != s[-1]) | (m != m[-1]))[-1:].sum() + 1) if (s[0], m[0]) != (s[-1], m[-1]) else 0
            rest = [s[cut_at:], m[cut_at:], fp[cut_at:]]
            ready.append(several(s[:cut_at], m[:cut_at], fp[:cut_at]))
            held += len(ready[-1][0])
            if held > 100_000:
                yield tuple(map(np.concatenate, zip(*ready)))
                ready, held = [], 0
        ready.append(several(*rest))
        yield tuple(map(np.concatenate, zip(*ready)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, fp in lists(batches):
            for number in np.unique(s):
                members = np.sort(fp[s == number])
                a, b = [], []
                for flip in flips[number]:
                    partner = members ^ flip
                    at = np.searchsorted(members, partner)
                    hit = np.flatnonzero((at < len(members)) & (members[np.minimum(at, len(members) - 1)] == partner) & (partner > members))
                    a.append(hit)
                    b.append(at[hit])
                a, b = np.concatenate(a), np.concatenate(b)
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(members, a, b)], names=["a", "b"])

    return postings.mapInArrow(verify, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, differing: int = DIFFERING_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id among the documents that links reach."""
    prints = cut(fingerprints(docs, doc_id, text, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, differing))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
