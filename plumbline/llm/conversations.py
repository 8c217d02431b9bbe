"""Conversation repair: the cheapest edits that restore the turn order, by prefix-doubling path ranking.

A conversation shall read ``(s?(ua)+)?`` by the initials of its roles. Its rows and the four states of that pattern make
a graph: an arc keeps, re-roles or deletes a row, or inserts a turn in front of one. A first pass gives every node the
cost of its cheapest way to the end; only arcs that lie on such a way remain. Among these the ASCII-least audit (the
initials of the edits) is found by doubling: a node's rank by the first 2^(k+1) letters of its audit is the rank of the
pair (its rank by 2^k letters, the rank of the node 2^k arcs on), and pointers over 2^k arcs double with it. Ranks
choose each node's arc, and the doubled pointers write out a path in as many steps as its length has bits.

Conversations are cut in chunks of rows, so no task holds one whole. The cost of the rest of a conversation
at a chunk's end is a vector of four numbers: each chunk becomes a 4 x 4 matrix of cheapest costs, and one backward scan
over a conversation's matrices gives the vectors. With it a chunk can write its part of the audit for each state it may be
entered in; a forward scan picks the parts. Conversations of any length take this way; most have a single chunk.

Rows carry only what the costs need (fault, role initial) through these steps. Texts are moved once, sorted by
conversation and turn, and streamed past the audit. The audit is one value of the result, so it is held whole; the
digest of a conversation is a SHA-256 over its rows in order, so one task streams the rows of a conversation.

Defined cases: null roles and texts count as one space; rows of one turn go by role, then by the SHA-256 of the text; null
turns come first; null conversation ids are one conversation; a role whose initial is not s, u or a can only be re-roled
or deleted; a repeated row is a duplicate; a conversation in ``every`` without rows gets zeros, an empty audit and the digest
of the empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions
from plumbline.llm.positions import ranked
from plumbline.session import cut

CHUNK_ROWS = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_SPACES = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
#: states: nothing yet, after a system turn, after a user turn, after an assistant turn
_START, _S, _U, _A = range(4)
_FORWARD = np.array([_U, _U, _A, _U])
#: by role initial (none of them, s, u, a) the state that each state goes to when such a row is kept, or -1
_KEEP = np.array([[-1] * 4, [_S, -1, -1, -1], [_U, _U, -1, _U], [-1, -1, _A, -1]])
#: costs of the end of a conversation, where only turns can be inserted, and their audits
_END, _END_AUDIT = [0, 2 * INSERT, INSERT, 0], ["", "II", "I", ""]
_LETTERS = "DIKR"
_CONV = "conv_id"


def faults(text: Column) -> Column:
    """1 for a blank text, 3 for one whose last character but spaces is none of ``.!?``, else 0; 2 stands for duplicates."""
    trimmed = F.rtrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", 1).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), 3).otherwise(0)


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with the columns conv_id, turn, role and text, in the order of a conversation by (turn, role, digest)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(_CONV, "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def codes(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, chunk, pos, size, fault, initial) of ``prepared`` rows."""
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (("s", 1), ("u", 2), ("a", 3)) for x in pair]), F.substring("role", 1, 1)), F.lit(0))
    keys = cut(rows.select(_CONV, "turn", "role", "digest", faults(F.col("text")).alias("fault"), initial.alias("initial")))
    placed = ranked(keys, [_CONV], ["turn", "role", "digest"])
    # a conversation's first row of each role and text; both sides of the join have a row for each position at most
    first = placed.groupBy(_CONV, "role", "digest").agg(F.min("pos").alias("first")).select(F.col(_CONV).alias("of"), "first")
    known = placed.join(first, F.col(_CONV).eqNullSafe(F.col("of")) & (F.col("pos") == F.col("first")), "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("first").isNull(), 2).otherwise(F.col("fault"))
    return cut(known.select(
        _CONV, F.floor(F.col("pos") / chunk_rows).alias("chunk"), "pos", "size", fault.cast("byte").alias("fault"), F.col("initial").cast("byte").alias("initial")
    ))


def row_costs(fault: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the cost of keeping it by state (far where it can't be kept), where that leads, and the cost of re-roling."""
    gone = (fault == 1) | (fault == 2)
    more = np.where(fault == 3, TRUNCATED, 0)
    target = _KEEP[initial]
    keep = np.where((target < 0) | gone[:, None], _FAR, more[:, None])
    return keep, np.maximum(target, 0), np.where(gone, _FAR, more + REROLE)


def backward(costs: tuple[np.ndarray, ...], ends: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Cheapest cost from each node to the end: (rows + chunks, 4, ...), a chunk's own rows and then its exit.

    ``ends`` are the ends of consecutive chunks; all chunks go back one row at a time together.
    """
    keep, target, rerole = costs
    starts = np.concatenate(([0], ends[:-1]))
    base = starts + np.arange(len(ends))
    sizes = ends - starts
    out = np.full((len(rerole) + len(ends), *exits.shape[1:]), _FAR, np.int64)
    out[base + sizes] = exits
    longest = np.argsort(-sizes, kind="stable")
    for step in range(1, int(sizes.max(initial=0)) + 1):
        active = longest[: int((sizes >= step).sum())]
        row, node = ends[active] - step, base[active] + sizes[active] - step
        after = out[node + 1]
        wide = (slice(None), slice(None)) + (None,) * (after.ndim - 2)
        kept = np.take_along_axis(after, np.broadcast_to(target[row][wide], after.shape), axis=1) + keep[row][wide]
        best = np.minimum(np.minimum(after + DELETE, kept), after[:, _FORWARD] + rerole[row][(slice(None), None) + (None,) * (after.ndim - 2)])
        for _ in range(2):  # an insert leads to another state in front of the same row
            best = np.minimum(best, best[:, _FORWARD] + INSERT)
        out[node] = np.minimum(best, _FAR)
    return out


def ranks_and_pointers(letter: np.ndarray, target: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of nodes by their whole audits, and pointers over 1, 2, 4 ... arcs.

    ``letter`` and ``target`` have the arcs of each node in columns; -1 marks no arc, and nodes without arcs are ends.
    """
    nodes = np.arange(len(letter))
    order = np.where(letter < 0, len(_LETTERS), letter)
    first = np.argmin(order, axis=1)
    pointer = np.where(order[nodes, first] < len(_LETTERS), target[nodes, first], nodes)
    rank = np.where(pointer == nodes, 0, order[nodes, first] + 1)
    ahead, length = pointer, 1
    while length <= 2 * longest:
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[ahead], return_inverse=True)[1]
        ahead, length = ahead[ahead], 2 * length
    # the arc whose letter and target's rank are least is a node's own
    own = np.argmin(order * (len(nodes) + 1) + rank[target], axis=1)
    pointers = [np.where(pointer == nodes, nodes, target[nodes, own])]
    while 1 << len(pointers) <= 2 * longest:
        pointers.append(pointers[-1][pointers[-1]])
    return rank, pointers


def audits(fault: np.ndarray, initial: np.ndarray, ends: np.ndarray, exits: np.ndarray) -> Iterator[tuple[int, list[int], list[str]]]:
    """For each chunk the cost from its start, and by entry state the exit state and the audit."""
    costs = keep, kept_to, rerole = row_costs(fault, initial)
    dist = backward(costs, ends, exits)
    starts = np.concatenate(([0], ends[:-1]))
    base, sizes = starts + np.arange(len(ends)), ends - starts
    row_node = np.arange(len(fault)) + np.repeat(np.arange(len(ends)), sizes)
    here, after = dist[row_node], dist[row_node + 1]
    letter = np.full((len(dist), 4, 4), -1, np.int64)
    target = np.zeros((len(dist), 4, 4), np.int64)
    states = np.arange(4)
    moves = (
        (after + DELETE, 1, np.broadcast_to(states, here.shape)),
        (here[:, _FORWARD] + INSERT, 0, np.broadcast_to(_FORWARD, here.shape)),
        (np.take_along_axis(after, kept_to, 1) + keep, 1, kept_to),
        (after[:, _FORWARD] + rerole[:, None], 1, np.broadcast_to(_FORWARD, here.shape)),
    )
    for number, (cost, ahead, state) in enumerate(moves):
        tight = (cost == here) & (here < _FAR)
        letter[row_node, :, number] = np.where(tight, number, -1)
        target[row_node, :, number] = 4 * (row_node[:, None] + ahead) + state
    letter, target = letter.reshape(-1, 4), target.reshape(-1, 4)
    longest = int(3 * sizes.max(initial=0))  # two inserts and an edit a row at most
    _, pointers = ranks_and_pointers(letter, target, longest)
    step_letter = np.full(len(letter), ord(" "), np.uint8)
    moved = pointers[0] != np.arange(len(letter))
    arc = np.argmax((target == pointers[0][:, None]) & (letter >= 0), axis=1)
    step_letter[moved] = np.frombuffer(_LETTERS.encode(), np.uint8)[letter[np.flatnonzero(moved), arc[moved]]]
    for number in range(len(ends)):
        out_states, parts = [], []
        for state in states:
            path = np.array([4 * base[number] + state])
            for pointer in pointers:
                path = np.concatenate((path, pointer[path]))
                if path[-1] >= 4 * (base[number] + sizes[number]):
                    break
            out_states.append(int(path[-1] - 4 * (base[number] + sizes[number])))
            parts.append(step_letter[path].tobytes().decode().rstrip())
        yield int(dist[base[number], _START]), out_states, parts


def _ends(table: pa.Table) -> np.ndarray:
    """Where the chunks of a sorted table end."""
    conv, chunk = table.column("conv").to_numpy(), table.column("chunk").to_numpy()
    return np.append(np.flatnonzero((conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])) + 1, table.num_rows)


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows sorted by (conv_id, chunk), no chunk cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.Table.from_batches(held)
            if len(ends := _ends(whole)) > 1:
                yield whole.slice(0, int(ends[-2]))
                held = whole.slice(int(ends[-2])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _chunked(df: DataFrame) -> DataFrame:
    """Each chunk whole in a task, in order; ``conv`` tells conversations apart without looking at the id."""
    spread = df.repartition(partitions(df.sparkSession), _CONV, "chunk").sortWithinPartitions(_CONV, "chunk", "pos")
    return spread.withColumn("conv", F.xxhash64(_CONV))


def _matrices(coded: DataFrame) -> DataFrame:
    """(conv_id, chunk, matrix): the cheapest cost from each state at a chunk's start to each at its end, in rows."""
    kind = coded.schema[_CONV].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
        for table in _runs(batches, 4 * CHUNK_ROWS):
            ends = _ends(table)
            fault, initial = table.column("fault").to_numpy(), table.column("initial").to_numpy()
            dist = backward(row_costs(fault, initial), ends, np.broadcast_to(unit, (len(ends), 4, 4)))
            starts = np.concatenate(([0], ends[:-1]))
            found = dist[starts + np.arange(len(ends))].reshape(len(ends), 16)
            taken = table.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays(
                [taken.column(_CONV).combine_chunks(), taken.column("chunk").combine_chunks(), pa.array(found.tolist(), pa.list_(pa.int64()))],
                names=[_CONV, "chunk", "matrix"],
            )

    return _chunked(coded.filter("chunk > 0")).mapInArrow(run, f"{_CONV} {kind}, chunk long, matrix array<long>")


def _exits(matrices: DataFrame) -> DataFrame:
    """(conv_id, chunk, exit): the cost of the rest of the conversation behind each chunk but the last."""
    kind = matrices.schema[_CONV].dataType.simpleString()
    rows = matrices.repartition(partitions(matrices.sparkSession), _CONV).sortWithinPartitions(_CONV, F.desc("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, vector = None, np.array(_END)
        for batch in batches:
            found = []
            for conv, chunk, matrix in zip(batch.column(_CONV).to_pylist(), batch.column("chunk").to_pylist(), batch.column("matrix").to_pylist()):
                if last != (conv, chunk + 1):
                    vector = np.array(_END)
                last = (conv, chunk)
                vector = np.minimum((np.array(matrix).reshape(4, 4) + vector).min(axis=1), _FAR)
                found.append(vector.tolist())
            chunks = pa.compute.subtract(batch.column("chunk"), 1)
            yield pa.RecordBatch.from_arrays([batch.column(_CONV), chunks, pa.array(found, pa.list_(pa.int64()))], names=[_CONV, "chunk", "exit"])

    return rows.mapInArrow(run, f"{_CONV} {kind}, chunk long, exit array<long>")


def parts(coded: DataFrame) -> DataFrame:
    """(conv_id, chunk, cost, exits, parts, blank, duplicate, truncated) of each chunk.

    ``parts`` has the audit for each state that the chunk may be entered in, ``exits`` the state it is left in, and
    ``cost`` the cost of the rest of the conversation if it is entered in the first state.
    """
    kind = coded.schema[_CONV].dataType.simpleString()
    exits = cut(_exits(_matrices(coded)))
    beyond = exits.select(F.col(_CONV).alias("of"), F.col("chunk").alias("of_chunk"), "exit")
    # one row of a chunk is enough to hand the chunk its exit
    marked = coded.join(beyond, F.col(_CONV).eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("of_chunk")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 16 * CHUNK_ROWS):
            ends = _ends(table)
            starts = np.concatenate(([0], ends[:-1]))
            fault, initial = table.column("fault").to_numpy(), table.column("initial").to_numpy()
            taken = table.take(pa.array(starts))
            exit_costs = np.array([e or _END for e in taken.column("exit").to_pylist()], np.int64).reshape(-1, 4)
            found = list(audits(fault, initial, ends, exit_costs))
            counts = [np.add.reduceat(fault == f, starts).astype(np.int64) for f in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [
                    taken.column(_CONV).combine_chunks(), taken.column("chunk").combine_chunks(), pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.string())), *map(pa.array, counts),
                ],
                names=[_CONV, "chunk", "cost", "exits", "parts", "blank", "duplicate", "truncated"],
            )

    layout = f"{_CONV} {kind}, chunk long, cost long, exits array<int>, parts array<string>, blank long, duplicate long, truncated long"
    return _chunked(marked.select(_CONV, "chunk", "pos", "fault", "initial", "exit")).mapInArrow(run, layout)


class _Walk:
    """One conversation on its way past its rows: collects the audit, then the figures, and gives the repaired turns."""

    def __init__(self, conv) -> None:
        self.conv, self.state, self.audit, self.at = conv, _START, [], 0
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.before = self.least = self.most = self.role = None
        self.shape = ""

    def add(self, chunk: int, cost: int, exits: list[int], pieces: list[str], blank: int, duplicate: int, truncated: int) -> None:
        if chunk == 0:
            self.cost = cost
        self.audit.append(pieces[self.state])
        self.state = exits[self.state]
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated

    def begin(self) -> None:
        """All parts are there: the audit becomes one text."""
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit) + (_END_AUDIT[self.state] if self.audit else "")

    def _next(self, role: str) -> str:
        """The role that the pattern asks for next, where an edit gives it."""
        return "assistant" if role == "u" else "user"

    def insert(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            role = self._next(self.shape)
            self.shape = role[0]
            yield "I", role, ""

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the turns that a row leads to."""
        self.begin()
        if turn is not None:
            self.turns += self.most != turn
            self.least, self.most = turn if self.least is None else self.least, turn
        if self.role is not None and self.role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role[:1]
        yield from self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = self._next(self.shape) if edit == "R" else role
            self.shape = role[0]
            yield edit, role, text

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)


def _walks(rows: DataFrame, edits: DataFrame, every: DataFrame | None) -> DataFrame:
    """All that a walk needs in its order: the conversation itself (kind 0), the audit's parts (1), the rows (2)."""
    whole = rows.select(_CONV, F.lit(2).alias("kind"), "turn", "role", "digest", "text")
    whole = whole.unionByName(edits.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    if every is not None:
        whole = whole.unionByName(every.select(_CONV).distinct().withColumn("kind", F.lit(0)), allowMissingColumns=True)
    whole = whole.repartition(partitions(rows.sparkSession), _CONV)
    return whole.sortWithinPartitions(_CONV, "kind", "chunk", "turn", "role", "digest").drop("digest")


_PART = ("chunk", "cost", "exits", "parts", "blank", "duplicate", "truncated")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, _Walk, list[tuple[str, str, str]], bool]]:
    """(type of ids, walk, repaired turns, whether the walk ends here), row by row."""
    walk = None
    for batch in batches:
        layout = batch.schema.field(_CONV).type
        columns = [batch.column(c).to_pylist() for c in (_CONV, "kind", "turn", "role", "text", *_PART)]
        for conv, kind, turn, role, text, *part in zip(*columns):
            if walk is None or walk.conv != conv:
                if walk is not None:
                    walk.begin()
                    yield layout, walk, list(walk.insert()), True
                walk = _Walk(conv)
            if kind == 1:
                walk.add(*part)
            elif kind == 2:
                yield layout, walk, list(walk.row(turn, role, text)), False
    if walk is not None:
        walk.begin()
        yield layout, walk, list(walk.insert()), True


def edits(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Prepared rows of (conv_id, turn, role, text), and the parts of their audits."""
    rows = prepared(conversations)
    return rows, parts(codes(rows, chunk_rows))


def repaired(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired turns: (conv_id, seq from 0, edit, role, text)."""
    rows, found = edits(conversations, chunk_rows)
    kind = rows.schema[_CONV].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seq, size, layout = [], 0, 0, pa.null()

        def table() -> pa.RecordBatch:
            types = (layout, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[_CONV, "seq", "edit", "role", "text"])

        for layout, walk, turns, over in _walked(batches):
            for turn in turns:
                out.append((walk.conv, seq, *turn))
                seq, size = seq + 1, size + len(turn[2])
            seq = 0 if over else seq
            if size > 1 << 22 or len(out) > 10_000:
                yield table()
                out, size = [], 0
        if out:
            yield table()

    return _walks(rows, found, None).mapInArrow(run, f"{_CONV} {kind}, seq long, edit string, role string, text string")


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame, every: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a conversation: gaps, counts of faults, cost, audit and the digest of its repaired ``role:text`` lines.

    ``every`` may name conversations (conv_id) that have no rows.
    """
    rows, found = edits(conversations, chunk_rows)
    kind = rows.schema[_CONV].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, layout, digest, lines = [], 0, pa.null(), sha256(), 0

        def table() -> pa.RecordBatch:
            types = (layout, *[pa.int64()] * len(_FIGURES), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[_CONV, *_FIGURES, "audit", "repaired_sha256"])

        for layout, walk, turns, over in _walked(batches):
            for _, role, text in turns:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            if over:
                out.append((walk.conv, walk.gaps(), walk.blank, walk.duplicate, walk.truncated, walk.illegal, walk.cost, walk.audit, digest.hexdigest()))
                size, digest, lines = size + len(walk.audit), sha256(), 0
                if size > 1 << 22 or len(out) > 10_000:
                    yield table()
                    out, size = [], 0
        if out:
            yield table()

    figures = ", ".join(f"{name} long" for name in _FIGURES)
    return _walks(rows, found, every).mapInArrow(run, f"{_CONV} {kind}, {figures}, audit string, repaired_sha256 string")
