import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from plumbline.llm.queries import LLM_QUERIES

SCHEMA = "text string, lang string, doc_id long, source string, n_chars long, pos int, size int, grp string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, add=0):
    text, lang, doc_id, source, n_chars = doc[:5]
    values = [doc_id, source, lang, n_chars if n_chars is None else n_chars + add, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, at):
    """Siblings and their sides, level by level."""
    for nodes in tree[:-1]:
        other = at ^ 1
        yield (nodes[other] if other < len(nodes) else "", other < at)
        at //= 2


def brute(docs):
    groups = {}
    for doc in docs:
        groups.setdefault(doc[1], []).append(doc)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda d: (d[2] is not None, d[2] or 0, leaf(d)))
        trees[name] = levels([leaf(d) for d in groups[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for at, doc in enumerate(groups[name]):
            steps = [*climb(trees[name], at), *climb(top, number)]
            tampered = doc[2] is not None and zlib.crc32(str(doc[2]).encode()) % 7 == 0
            digest = leaf(doc, int(tampered))
            for sibling, left in steps:
                digest = H(sibling, digest) if left else H(digest, sibling)
            root = top[-1][0]
            out.append((doc[2], leaf(doc), trees[name][-1][0], root, H(*[s for s, _ in steps]), digest, digest == root))
    return sorted(out, key=repr)


def documents():
    docs = [(f"text {i} ü", ["en", "en", "de", "fr"][i % 4], i, "web", i, 1, 2, "x") for i in range(700)]
    docs += [(None, None, 701, None, None, 1, 2, "x"), ("", "", 702, "", 0, 1, 2, "x"), ("x" * 100_000, "a", None, "s", 5, 1, 2, "x")]
    docs += [("twice", "en", 703, "web", 5, 1, 2, "x")] * 3 + [("other", "en", 703, "web", 5, 1, 2, "x"), ("É", "é", 7, "s", 1, 1, 2, "x")]
    return docs + [("lone", f"l{i}", 1000 + i, "s", 1, 1, 2, "x") for i in range(40)]


def through_query(spark, docs, tmp_path):
    spark.createDataFrame(docs, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = LLM_QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 750])
def test_query_matches_brute_force(spark, tmp_path, count):
    docs = documents()[:count] if count < 700 else documents()
    assert through_query(spark, docs, tmp_path) == brute(docs)


@pytest.mark.parametrize("bits", [2])
def test_many_epochs(spark, bits):
    """Small blocks: a tree passes through up to five epochs, with the same result."""
    docs = documents()
    found = merkle.manifest(spark.createDataFrame(docs, SCHEMA), bits=bits)
    found = found.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof")))
    rows = found.collect()
    assert len(rows) == len(docs) and all(r.folded == r.root for r in rows)
    assert sorted((r.leaf, r.subroot, r.root) for r in rows) == sorted(r[1:4] for r in brute(docs))


def test_queue_stays_small(monkeypatch):
    """Labels keep at most two waiting messages a level."""
    most, push = [0], merkle.heappush

    def counted(queue, item):
        push(queue, item)
        most[0] = max(most[0], len(queue))

    monkeypatch.setattr(merkle, "heappush", counted)
    leaves = [H(str(i)) for i in range(1000)]
    assert merkle.forward(leaves, 10)[10, 0] == levels(leaves)[-1][0]
    assert most[0] <= 20
