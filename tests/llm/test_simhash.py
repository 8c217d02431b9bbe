import random

import xxhash

from plumbline.llm import simhash
from plumbline.llm.common import table
from plumbline.llm.components import components
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, ids):
    """By comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


def test_query_matches_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], zip([f"{p:016x}" for p in prints], classes(prints, [r.doc_id for r in docs]))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in LLM_QUERIES["op1_simhash"](spark, SF).collect()}
    assert got == want


def test_links_of_given_fingerprints(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(6)]
    prints = set(base) | {0, (1 << 64) - 1}
    for p in base[:4]:
        for _ in range(60):
            p ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
            prints.add(p)
    prints |= {base[4] ^ (0b111 << s) for s in (0, 7, 61)}
    prints |= {base[5] ^ x for x in range(1 << 10)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5))
    root = {r.node: r.root for r in components(edges).collect()}
    got = [root.get(p, p) for p in signed]
    want = classes(prints, signed)
    assert got == want


def test_edge_texts(spark):
    long = "a b c d " * 30_000
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (9, long), (7, long), (7, long), (None, "lonely text here"), (8, "É x"), (3, "é x")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.classes(docs.repartition(4)).collect()
    prints = [fingerprint(t) for _, t in rows]
    want = classes(prints, [i for i, _ in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got])) == sorted(
        map(key, zip([i for i, _ in rows], prints, want))
    )
    assert simhash.classes(docs.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    edges += [(draw.randrange(2000, 2400), draw.randrange(2000, 2400)) for _ in range(300)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == find(n) for n in root)
