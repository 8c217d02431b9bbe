import random
import re

from plumbline.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for text in docs:
        w, hit, ids = split(text), set(), set()
        for item_id, item in items:
            i = split(item)
            n = min(window, len(i))
            keys = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in keys:
                    hit |= set(range(k, k + n))
                    ids.add("null" if item_id is None else str(item_id))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def corpus():
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß9"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([1, 3, 9, 10, 11, 40]))) for i in range(12)] + [(12, None), (None, "--"), (13, "W1; w2 w3")]
    items += [(14, items[5][1]), (15, text(95))]
    docs = [text(draw.randrange(60)) for _ in range(40)] + [None, "", "x.y,z", items[15 - 1][1] + " " + items[16][1]]
    docs += [f"zzz {items[16][1].replace('w', 'W')}!" for _ in range(5)] + [text(30_000)]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "m", i) for i, t in enumerate(docs)], "doc_id long, text string, matches string, n_words int")
    return d.repartition(3), spark.createDataFrame(items, "item_id long, text string")


def union(matches):
    return len({w for m in matches for w in range(m.doc_word, m.doc_word + m.length)})


def test_matches_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    for pack_words in (dc.PACK_WORDS, 60):
        got = dc.find_overlaps(*frames(spark, docs, items), keep=["doc_id"], pack_words=pack_words).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, union(r.matches), sorted({i for m in r.matches for i in m["items"]})) == want[r.doc_id]


def test_longest_match_and_place(spark):
    docs, items = corpus()
    row = next(r for r in dc.find_overlaps(*frames(spark, docs, items)).collect() if r.doc_id == 44)
    best = max(row.matches, key=lambda m: m.length)
    assert (best["items"], best.item_word, best.doc_word, best.length) == (["15"], 0, 1, 95)


def test_decontaminate_keeps_clean_rows(spark):
    docs, items = corpus()
    d, b = frames(spark, docs, items)
    clean = {i for i, (_, hit, _) in enumerate(brute(docs, items)) if not hit}
    out = dc.decontaminate(d, b, pack_words=60)
    assert out.schema == d.schema and {r.doc_id for r in out.collect()} == clean
    assert dc.decontaminate(d, b.limit(0)).count() == len(docs)
    assert dc.decontaminate(d.limit(0), b).count() == 0


def test_empty_benchmark(spark):
    docs, items = corpus()
    d, b = frames(spark, docs, items)
    rows = dc.find_overlaps(d, b.limit(0), keep=["doc_id"]).collect()
    assert all(r.matches == [] and r.n_words == len(split(docs[r.doc_id])) for r in rows)
