"""Benchmark decontamination with suffix arrays over the training texts.

Words are lower-cased runs of a-z, 0-9 and letters beyond ASCII. Every task builds a word-level suffix array over its
share of the documents, a shard, and binary-searches every suffix of every benchmark item in it: the neighbours of
its place give the longest verbatim match, and if that reaches the item's window (``window`` words, or the whole item
if it is shorter), the range of suffixes that start with the window gives all places. Matches that continue each
other are joined, so a match is the longest run shared by item and document at these places.

A shard only indexes suffixes that can match: a word that no item has ends every match, so runs of item words that
are shorter than the shortest window are left out. This loses no match.

Documents never move. The benchmark is sent in packs of at most ``pack_words`` words, one pass over the documents for
each pack, so what is broadcast does not grow with the benchmark. Items longer than a pack are split into pieces that
overlap by a window less one word.

Defined cases: null texts and texts without words match nothing; repeated rows each get their result; items with
equal words are searched once and all their ids are reported; a null item id counts as the id ``null``; an empty
benchmark leaves all documents clean. Columns named n_words or matches are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import slices, utf8, words
from plumbline.session import cut

WINDOW = 10
#: benchmark words in one broadcast; about 50 MB in a task at the most
PACK_WORDS = 400_000

MATCH = "array<struct<items:array<string>,item_word:int,doc_word:int,length:int>>"


@dataclass
class Pack:
    """Benchmark items as word numbers from 1 on, each followed by a 0."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray
    item: np.ndarray  #: of each suffix that a window starts: item number
    word: np.ndarray  #: its first word within the item
    at: np.ndarray  #: its place in ``tokens``
    window: np.ndarray  #: its window's length
    ids: list[list[str]]  #: of each item
    longest: int


def make_pack(pieces: dict[tuple[bytes, ...], list[tuple[str, int]]], window: int) -> Pack:
    """``pieces``: word sequences with the (id, first word) of every item that has them."""
    vocabulary: dict[bytes, int] = {}
    tokens: list[int] = []
    item, word, at, width, ids, longest = [], [], [], [], [], 0
    for number, (sequence, owners) in enumerate(pieces.items()):
        start = len(tokens)
        tokens += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in sequence]
        tokens.append(0)
        fits = min(window, len(sequence))
        for first in range(len(sequence) - fits + 1):
            item.append(number)
            word.append(first + owners[0][1])
            at.append(start + first)
            width.append(fits)
        ids.append(sorted({owner for owner, _ in owners}))
        longest = max(longest, len(sequence))
    ints = [np.array(x, np.int64) for x in (item, word, at, width)]
    return Pack(vocabulary, np.array(tokens, np.int32), *ints, ids, longest)


def packs(benchmark: DataFrame, item_id: str, text: str, window: int, pack_words: int) -> Iterator[Pack]:
    """At least one pack, each of at most ``pack_words`` words; the driver holds one partition of the benchmark and a pack."""
    pieces: dict[tuple[bytes, ...], list[tuple[str, int]]] = {}
    held, sent = 0, False
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), utf8(text))
    for owner, value in rows.toLocalIterator():
        sequence = tuple(words(bytes(value)))
        step = max(1, pack_words - window + 1)
        for start in range(0, max(1, len(sequence) - window + 1), step):
            piece = sequence[start : start + pack_words]
            if not piece:
                continue
            if held and held + len(piece) > pack_words:
                yield make_pack(pieces, window)
                pieces, held, sent = {}, 0, True
            if piece not in pieces:
                held += len(piece)
            pieces.setdefault(piece, []).append((owner, start))
    if pieces or not sent:
        yield make_pack(pieces, window)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in the order of their first ``depth`` tokens at least, by prefix doubling."""
    rank = tokens.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    known = 1
    while known < depth:
        following = np.zeros_like(rank)
        following[: len(rank) - known] = rank[known:] + 1
        key = rank * (int(following.max(initial=0)) + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == len(rank) - 1:
            break
        known *= 2
    return order


def _shared(query: np.ndarray, at: np.ndarray, text: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many tokens each pair of suffixes shares, up to ``most``; a 0 is shared with nothing."""
    length = np.zeros(len(at), np.int64)
    active = np.arange(len(at))
    while active.size:
        a = query[at[active] + length[active]]
        same = (a == text[place[active] + length[active]]) & (a > 0) & (length[active] < most[active])
        active = active[same]
        length[active] += 1
    return length


def search(order: np.ndarray, text: np.ndarray, query: np.ndarray, at: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """For each query suffix, cut to ``most`` tokens, the first index in ``order`` not before it (``after``: behind it)."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not open_.size:
            return low
        middle = (low[open_] + high[open_]) // 2
        place, begin, limit = order[middle], at[open_], most[open_]
        shared = _shared(query, begin, text, place, limit)
        right = text[place + shared] < query[begin + shared]
        whole = shared >= limit
        right = np.where(whole, after, right)
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


def find(texts: list[bytes], pack: Pack) -> tuple[list[int], dict[int, list[tuple]]]:
    """Word counts, and by document the (item, item word, document word, length) of its matches."""
    get, parts, sizes = pack.vocabulary.get, [], []
    for text in texts:
        found = words(text)
        sizes.append(len(found))
        parts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
        parts.append(np.zeros(1, np.int32))
    if not texts or not len(pack.at):
        return sizes, {}
    known = np.concatenate(parts)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (known > 0).astype(np.int8), [0]))))
    begins, ends = edges[::2], edges[1::2]
    long = (ends - begins) >= pack.window.min()
    begins, ends = begins[long], ends[long]
    if not begins.size:
        return sizes, {}
    # one zero behind each run: the token after a run in ``known`` is always a 0
    spans = ends + 1 - begins
    source = np.repeat(begins - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
    text = np.concatenate((known[source], np.zeros(1, np.int32)))
    order = suffix_array(text[:-1], pack.longest)
    place = search(order, text, pack.tokens, pack.at, np.full(len(pack.at), pack.longest, np.int64), False)
    most = np.full(len(pack.at), pack.longest, np.int64)
    longest = np.zeros(len(pack.at), np.int64)
    for neighbour in (place - 1, place):
        there = (neighbour >= 0) & (neighbour < len(order))
        rows = np.flatnonzero(there)
        longest[rows] = np.maximum(longest[rows], _shared(pack.tokens, pack.at[rows], text, order[neighbour[rows]], most[rows]))
    reach = np.flatnonzero(longest >= pack.window)
    if not reach.size:
        return sizes, {}
    begin, width = pack.at[reach], pack.window[reach]
    low = search(order, text, pack.tokens, begin, width, False)
    count = search(order, text, pack.tokens, begin, width, True) - low
    row = np.repeat(reach, count)
    index = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    flat = source[order[index]]
    starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)[:-1]))
    doc = np.searchsorted(starts, flat, side="right") - 1
    at_word, item, item_word, width = flat - starts[doc], pack.item[row], pack.word[row], pack.window[row]
    sort = np.lexsort((at_word, at_word - item_word, item, doc))
    doc, at_word, item, item_word, width = (x[sort] for x in (doc, at_word, item, item_word, width))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at_word[1:] != at_word[:-1] + 1) | (item_word[1:] != item_word[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.concatenate((first, [len(doc)]))) - 1 + width[first]
    matches: dict[int, list[tuple]] = {}
    for d, *match in zip(doc[first].tolist(), item[first].tolist(), item_word[first].tolist(), at_word[first].tolist(), length.tolist()):
        matches.setdefault(d, []).append(tuple(match))
    return sizes, matches


_BYTES = "_bytes_of_text"


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, pack_words: int = PACK_WORDS, keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all), ``n_words`` and ``matches``: items, first words and length of each match."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "matches")]
    df = docs.select(*keep, utf8(text).alias(_BYTES), F.lit(None).cast("long").alias("n_words"), F.array().cast(MATCH).alias("matches"))
    kind = pa.list_(pa.struct([
        ("items", pa.list_(pa.string())), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("length", pa.int32()),
    ]))
    first = True
    for pack in packs(benchmark, item_id, item_text, window, pack_words):
        sent = spark.sparkContext.broadcast(pack)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pack = sent.value
            for batch in slices(batches, _BYTES):
                sizes, found = find(batch.column(_BYTES).to_pylist(), pack)
                matches = batch.column("matches")
                if found:
                    every = matches.to_pylist()
                    for row, own in found.items():
                        every[row] = every[row] + [
                            {"items": pack.ids[i], "item_word": w, "doc_word": d, "length": n} for i, w, d, n in own
                        ]
                    matches = pa.array(every, kind)
                columns = [batch.column(c) for c in (*keep, _BYTES)] + [pa.array(sizes, pa.int64()), matches.cast(kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, _BYTES, "n_words", "matches"])

        df = (df if first else cut(df)).mapInArrow(scan, df.schema)
        first = False
    return df.drop(_BYTES)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, pack_words: int = PACK_WORDS,
) -> DataFrame:
    """``docs`` without the documents that hold a window of any benchmark item; columns and other rows untouched."""
    spark, df = docs.sparkSession, docs
    schema: T.StructType = docs.schema
    for pack in packs(benchmark, item_id, item_text, window, pack_words):
        sent = spark.sparkContext.broadcast(pack)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pack = sent.value
            for batch in slices(batches, text):
                _, found = find([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(text).to_pylist()], pack)
                if found:
                    mask = np.ones(batch.num_rows, bool)
                    mask[list(found)] = False
                    batch = batch.filter(pa.array(mask))
                yield batch

        df = df.mapInArrow(clean, schema)
    return df
