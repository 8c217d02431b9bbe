"""Conversation repair against a plain shortest-path search that carries (cost, audit) pairs."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import conversations
from plumbline.llm.queries import LLM_QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos int, chunk int, kind int"


def cheapest(rows):
    """(cost, audit, repaired turns) of rows (role, text, fault): the least cost, then the ASCII-least audit."""
    after = {("", "u"), ("", "s"), ("s", "u"), ("u", "a"), ("a", "u")}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, turns = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, turns
        if (at, last) in done:
            continue
        done.add((at, last))
        for role in ("user", "assistant"):
            if (last, role[0]) in after:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*turns, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (last, role[:1]) in after:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*turns, (role, text))))
                for new in ("user", "assistant"):
                    if (last, new[0]) in after:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, new[0], (*turns, (new, text))))


def brute(table):
    groups = {}
    for conv, turn, role, text, *_ in table:
        rows = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in rows:
            kept = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, turns = cheapest(marked)
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def table():
    draw = random.Random(3)
    rows = []
    for conv in range(300):
        for turn in range(draw.choice([1, 2, 3, 5, 9])):
            role = draw.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "User"])
            text = draw.choice(["Fine.", "Really?", "cut off", "So!  \n", "\t \x0b", "", "ü.", f"Text {turn}.", f"Other {turn}!", None, " "])
            rows.append((conv, draw.choice([turn, turn, turn, turn * 3, None]), role, text, 1, 2, 3))
    rows += [(None, t, "user", f"{t}.", 1, 2, 3) for t in (4, None, 6)]
    rows += [(900, t, ["user", "assistant"][t % 2], f"Long {t}.", 1, 2, 3) for t in range(600)]
    rows += [(901, 5, "user", "Same.", 1, 2, 3)] * 40 + [(902, 0, "assistant", "x. " * 50_000, 1, 2, 3)]
    return rows


FIGURES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def through_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = LLM_QUERIES["op12_conversation_repair"](spark, str(tmp_path)).select(*FIGURES)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_query_matches_brute_force(spark, tmp_path):
    assert through_query(spark, table(), tmp_path) == brute(table())


def test_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = LLM_QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").select(*FIGURES)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("kind, rows", [("none", []), ("only dropped", [(c, t, "user", "x.", 1, 2, 3) for c in range(200) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0])])
def test_empty(spark, tmp_path, kind, rows):
    got = through_query(spark, rows, tmp_path)
    assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in sorted({r[0] for r in rows}, key=str)]


@pytest.mark.parametrize("chunk_rows", [1, 3, 7])
def test_chunks_make_no_difference(spark, chunk_rows):
    """Conversations cut in many chunks: the same audits, costs and turns."""
    rows = [r for r in table() if r[0] in (None, 900, 901) or (r[0] or 0) % 5 == 0]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((tuple(r) for r in conversations.repair(df).collect()), key=repr)
    assert sorted((tuple(r) for r in conversations.repair(df, chunk_rows=chunk_rows).collect()), key=repr) == want
    turns = {}
    for r in sorted(conversations.repaired(df, chunk_rows).collect(), key=lambda r: (str(r.conv_id), r.seq)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    got = {conv: hashlib.sha256("\n".join(lines).encode()).hexdigest() for conv, lines in turns.items()}
    assert got == {w[0]: w[-1] for w in want if w[0] in got} and all(w[-1] == hashlib.sha256(b"").hexdigest() for w in want if w[0] not in got)


def test_ranks_order_audits():
    """Ranks by doubling order all nodes as their audits do, also where equal letters lead to different nodes."""
    draw = random.Random(1)
    n = 200
    letter, target = np.full((n, 4), -1), np.zeros((n, 4), int)
    for node in range(n - 1):
        for arc, code in enumerate(draw.sample(range(4), draw.randint(1, 4))):
            letter[node, arc], target[node, arc] = code, draw.randint(node + 1, min(n - 1, node + 4))
    audit = [""] * n
    for node in range(n - 2, -1, -1):
        audit[node] = min("DIKR"[l] + audit[t] for l, t in zip(letter[node], target[node]) if l >= 0)
    rank, pointers = conversations.ranks_and_pointers(letter, target, n)
    assert [sorted(set(audit)).index(a) for a in audit] == rank.tolist()
    assert all(pointers[-1] == n - 1)
