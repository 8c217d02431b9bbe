import random
from collections import Counter

from plumbline.llm import licenses
from plumbline.llm.common import table, words
from plumbline.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_query_finds_every_notice(spark):
    rows = {r.doc_id: r for r in LLM_QUERIES["op5_license_scan"](spark, SF).collect()}
    texts = {r.doc_id: words(r.text.encode()) for r in table(spark, SF, "documents").collect()}
    assert set(rows) == set(texts)
    notices = {n: words(t.encode()) for n, t in licenses.TEMPLATES.items()}
    hits = 0
    for i, text in texts.items():
        joined = b" " + b" ".join(text) + b" "
        whole = {n for n, t in notices.items() if b" " + b" ".join(t) + b" " in joined}
        # a notice that is part of a longer license there is not named beside it
        named = set(rows[i].licenses.split(","))
        inner = {n for n in whole for o in whole - {n} if b" ".join(notices[n]) in b" ".join(notices[o])}
        assert whole - inner <= named, i
        hits += len(whole)
        if rows[i].licenses:
            assert whole or rows[i].coverage < 1
    assert hits > 10


def test_alignment_is_a_common_subsequence_near_the_longest():
    draw = random.Random(3)
    template = words(licenses.TEMPLATES["mit"].encode())
    for _ in range(40):
        text = [w for w in template if draw.random() > 0.08]
        for _ in range(4):
            text.insert(draw.randrange(len(text)), draw.choice(template + [b"zz"]))
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert 0.9 * common(text, template) <= len(pairs) <= common(text, template)


def test_places(spark):
    t = licenses.TEMPLATES
    noise = "the of and this with " * 40
    rows = [
        (1, None), (2, ""), (3, noise), (4, noise + t["mit"].upper() + noise), (5, (t["mit-notice"] + "\n") * 3),
        (6, t["apache-2.0-header"] + noise + t["isc"]), (7, "all the reserved"), (8, noise * 3000 + t["gpl-3.0-notice"]),
        (9, t["isc"].replace("purpose", "use").replace("appear", "is shown")), (4, noise + t["mit"].upper() + noise), (None, t["mit-notice"]),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, coverage double").repartition(3)
    got = [(r.doc_id, Counter(p.template for p in r.places), r.places) for r in licenses.scan(df).collect()]
    assert len(got) == len(rows)
    by_id = {i: c for i, c, _ in got}
    assert not by_id[1] and not by_id[2] and not by_id[3] and not by_id[7]
    assert by_id[4] == {"mit": 1} and by_id[5] == {"mit-notice": 3} and by_id[None] == {"mit-notice": 1}
    assert by_id[6] == {"apache-2.0-header": 1, "isc": 1} and by_id[9] == {"isc": 1}
    assert by_id[8]["gpl-3.0-notice"] == 1
    (place,) = next(p for i, _, p in got if i == 4)
    assert (place.coverage, place.first_word, place.end_word - place.first_word) == (1.0, 200, len(words(t["mit"].encode())))
    assert licenses.scan(df.limit(0)).count() == 0


def names(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    ready = licenses.prepared(templates, phrases, licenses.LEAST)
    return [p[0] for p in licenses.places(words(text.encode()), ready, {w for t in ready for w in t.distinct}, licenses.LEAST)]


def test_relatives_are_told_apart():
    """Licenses whose notices differ in a word or two; unknown ones get no name."""
    for notice, name in [
        ("Released under the BSD License.", ["bsd-notice"]), ("Licensed under CC BY-SA 4.0.", ["cc-by-sa-4.0-notice"]),
        ("Licensed under CC BY-NC-SA 4.0.", []), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0-notice"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0-notice"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0-notice"]),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", []),
        ("Licensed under the Mozilla Public License, Version 2.0.", ["mpl-2.0-notice"]),
        ("Licensed under the Apache License, Version 1.1.", []), ("Released under the WTF License.", []),
    ]:
        assert names(f"some words before. {notice} and some behind") == name, notice
    for name, text in licenses.TEMPLATES.items():
        assert names(text) == [name]


def test_words_between_those_of_a_license():
    """Line numbers and comment words, up to three for each word of the license."""
    for name in ("mit", "isc", "gpl-3.0-header", "bsd-3-clause"):
        lines = [words(licenses.TEMPLATES[name].encode())[i : i + 6] for i in range(0, 400, 6)]
        text = b" ".join(b" ".join([b"line", b"%d" % (1000 + i), b"rem", *line]) for i, line in enumerate(lines) if line).decode()
        plain = {name: licenses.TEMPLATES[name]}
        assert names(text, plain, {}) == [name]


def test_coverage_against_the_longest_common_subsequence():
    """What is reported is never more than the best subsequence; whole copies with words left out are all reported."""
    draw = random.Random(5)
    for _ in range(60):
        name = draw.choice(["mit", "isc", "apache-2.0-header", "bsd-2-clause"])
        template = words(licenses.TEMPLATES[name].encode())
        keep = draw.choice([0.6, 0.9, 0.97])
        text = [b"before"] * 5 + [w for w in template if draw.random() < keep] + [b"behind"] * 5
        ready = licenses.prepared({name: licenses.TEMPLATES[name]}, {}, licenses.LEAST)
        got = licenses.places(text, ready, set(template), licenses.LEAST)
        best = common(text, template) / len(template)
        assert all(licenses.LEAST <= p[1] <= best + 1e-12 for p in got)
        assert bool(got) == (best >= licenses.LEAST), (name, best)


def test_templates_from_a_table(spark):
    table_ = spark.createDataFrame(
        [("own", "You may use the Foo archive under its own terms", ["Foo archive"]), ("none", None, None), ("bar", "use bar as you like", None)],
        "name string, text string, phrases array<string>")
    templates, phrases = licenses.read_templates(table_)
    docs = spark.createDataFrame([(1, "you may use the FOO archive under its own terms"), (2, "you may use the bar archive under its own terms"),
                                  (3, "use bar as you like it")], "doc_id long, text string")
    got = {r.doc_id: [p.template for p in r.places] for r in licenses.scan(docs, templates, phrases=phrases).collect()}
    assert got == {1: ["own"], 2: [], 3: ["bar"]}
