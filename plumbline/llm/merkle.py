"""A Merkle manifest of a dataset by time-forward processing, with a proof for every row.

Rows form one binary tree per group, in order; the groups' roots form one more tree. Nodes are processed in the order
of their labels: a node's label is the last leaf below it and then its level, so that every child comes before its
parent. A priority queue ordered by label delivers child digests to their parents. It is external: a task holds the
messages of one block, a subtree of 1,024 leaves, in a heap (with these labels at most two for each level); a message
that leaves the block goes to a table in the shared folder, which Spark's sorted shuffle hands to the tasks of the next
epoch in label order. A tree of n leaves takes log n / 10 epochs. A second sweep runs over the same blocks in reversed
label order: each node sends to its children the proof suffix that they share, so a block is reached by one suffix, and
whole proofs only exist at the leaves.

Every epoch reads and writes tables, so a lost executor costs its blocks alone. No task sees more than a block, however
large a group is.

Defined cases: null fields have their own mark, and null groups and ids come first; rows with equal ids go by their
digest, and repeated rows are leaves of their own; an empty text is a field of 0 bytes; a group or table of one row has
the leaf itself as root and an empty proof; an empty table gives an empty manifest; columns that are no field are not
part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions
from plumbline.llm.positions import ranked
from plumbline.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_BITS = 10


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def up(digest: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        joined = F.when(step.startswith("L"), F.concat(sibling, digest)).when(step.startswith("R"), F.concat(digest, sibling))
        return F.sha2(F.coalesce(joined, digest), 256)

    return F.aggregate(proof, leaf, up)


def _digest(hex_digests: str) -> str:
    return sha256(hex_digests.encode()).hexdigest()


def _height(size: int, bits: int) -> int:
    """Levels of a block in a tree whose lowest level has ``size`` nodes."""
    return min(bits, (size - 1).bit_length())


def forward(leaves: Sequence[str], height: int) -> dict[tuple[int, int], str]:
    """Digests of a block's nodes by (level, index), computed in label order."""
    known: dict[tuple[int, int], str] = {}
    queue: list[tuple[int, int, int, str]] = []
    last = len(leaves) - 1

    def place(level: int, index: int, digest: str) -> None:
        known[level, index] = digest
        if level < height:  # a message to the parent, under the parent's label
            time = min(last, (((index >> 1) + 1) << (level + 1)) - 1)
            heappush(queue, (time, level + 1, index, digest))

    for now, leaf in enumerate(leaves):
        place(0, now, leaf)
        while queue and queue[0][0] <= now:
            time, level, index, digests = heappop(queue)
            if queue and queue[0][:3] == (time, level, index + 1):
                digests += heappop(queue)[3]
            place(level, index >> 1, _digest(digests))
    return known


def backward(known: Mapping[tuple[int, int], str], height: int, suffix: Sequence[str]) -> list[list[str]]:
    """Proofs of a block's leaves from the suffix of its root, delivered in reversed label order."""
    last = max(index for level, index in known if level == 0)
    proofs: list[list[str]] = [[] for _ in range(last + 1)]
    queue: list[tuple[int, int, int, tuple]] = []

    def send(level: int, index: int, steps: tuple) -> None:
        heappush(queue, (-min(last, ((index + 1) << level) - 1), -level, index, steps))

    send(height, 0, tuple(suffix))
    while queue:
        _, negative, index, steps = heappop(queue)
        if not negative:
            proofs[index] = list(steps)
            continue
        below = -negative - 1
        left, right = known[below, 2 * index], known.get((below, 2 * index + 1))
        send(below, 2 * index, (f"R{right}" if right else "-", *steps))
        if right:
            send(below, 2 * index + 1, (f"L{left}", *steps))
    return proofs


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """Rows with ``grp`` and ``block``, each block whole in a task and its rows in order; ``kind`` 0 comes first."""
    rows = rows.repartition(partitions(rows.sparkSession), "grp", "block")
    return rows.sortWithinPartitions("grp", "block", "kind", "pos")


def _each_block(batches: Iterator[pa.RecordBatch], columns: Sequence[str], types: dict[str, pa.DataType]) -> Iterator[tuple[list, ...]]:
    """The columns of one block after the other; ``types`` gets the types of all columns."""
    at, held = None, []
    for batch in batches:
        types.update({f.name: f.type for f in batch.schema})
        keys = zip(batch.column("grp").to_pylist(), batch.column("block").to_pylist())
        for key, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in columns])):
            if held and key != at:
                yield tuple(map(list, zip(*held)))
                held = []
            at = key
            held.append(row)
    if held:
        yield tuple(map(list, zip(*held)))


def _sweep_up(nodes: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, size, digest) of the roots of all blocks: the messages that leave them."""
    kind = nodes.schema["grp"].dataType.simpleString()
    rows = nodes.select("grp", F.shiftright("pos", bits).alias("block"), F.lit(1).alias("kind"), "pos", "size", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}
        for grp, block, size, digest in _each_block(batches, ("grp", "block", "size", "digest"), types):
            height = _height(size[0], bits)
            root = forward(digest, height)[height, 0]
            row = ((grp[0], types["grp"]), (block[0], pa.int64()), (-(-size[0] >> bits), pa.int64()), (root, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["grp", "pos", "size", "digest"])

    return _blocks(rows, bits).mapInArrow(run, f"grp {kind}, pos long, size long, digest string")


def _sweep_down(nodes: DataFrame, tops: DataFrame, keep: Sequence[str], bits: int) -> DataFrame:
    """``nodes`` with ``proof``; ``tops`` has the proof suffix of each block's root and what else (``top``) its rows shall know."""
    schema = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    rows = nodes.select(
        "grp", F.shiftright("pos", bits).alias("block"), F.lit(1).alias("kind"), "pos", "size", "digest",
        F.lit(None).cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("top"), *keep,
    ).unionByName(tops.select("grp", F.col("pos").alias("block"), F.lit(0).alias("kind"), "proof", "top"), allowMissingColumns=True)
    kept = ("grp", "pos", "digest", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, pa.DataType] = {}
        for proof, top, size, *columns in _each_block(batches, ("proof", "top", "size", *kept), types):
            height = _height(size[1], bits)
            proofs = backward(forward(columns[2][1:], height), height, proof[0])
            arrays = [pa.array(c[1:], types[name]) for name, c in zip(kept, columns)]
            arrays += [pa.array(proofs, pa.list_(pa.string())), pa.array(top[:1] * len(proofs), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "proof", "top"])

    layout = ", ".join(f"`{name}` {schema[name]}" for name in kept)
    return _blocks(rows, bits).mapInArrow(run, f"{layout}, proof array<string>, top string")


def _epochs(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """``nodes`` and the roots of their blocks, epoch by epoch; the last table has one node a group."""
    tables = [nodes]
    while (tables[-1].agg(F.max("size")).first()[0] or 0) > 1:
        tables.append(cut(_sweep_up(tables[-1], bits)))
    return tables


def _proofs(tables: Sequence[DataFrame], tops: DataFrame, keep: Sequence[str], bits: int) -> DataFrame:
    """``tables[0]`` with the proofs that start with ``tops`` at the last table."""
    for nodes in reversed(tables[1:-1]):
        tops = cut(_sweep_down(nodes, tops, [], bits))
    return _sweep_down(tables[0], tops, keep, bits)


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", doc_id: str = "doc_id",
    also: Mapping[str, Column] | None = None, bits: int = BLOCK_BITS,
) -> DataFrame:
    """(doc_id, leaf, proof, subroot, root) of every row, and the columns of ``also``.

    ``proof`` has one step a level, from the leaf to the root: ``L`` or ``R``, the side of the sibling, and its digest,
    or ``-`` where a node is alone. :func:`folded` leads back to the root.
    """
    also = dict(also or {})
    leaves = cut(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(group).alias("grp"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
        *[value.alias(name) for name, value in also.items()],
    ))
    per_group = _epochs(ranked(leaves, ["grp"], ["doc_id", "digest"]), bits)
    roots = per_group[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest")
    over_groups = _epochs(ranked(cut(roots), ["grp"], ["name"]), bits)
    root = over_groups[-1].select("digest").first()
    root = root[0] if root else None
    top = over_groups[-1].select("grp", "pos", F.array().cast("array<string>").alias("proof"), F.lit(root).cast("string").alias("top"))
    groups = cut(_proofs(over_groups, top, ["name"], bits))
    tops = groups.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("top"))
    found = _proofs(per_group, tops, ["doc_id", *also], bits)
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "proof", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), *also
    )
