"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

from plumbline.llm import linkgraph

LLM_ORACLE: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLE["op6_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
widths AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS key
                 FROM (SELECT item_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM widths)),
doc_windows AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS key
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM widths) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, x.n AS n FROM doc_windows x JOIN item_windows y ON x.n = y.n AND x.key = y.key),
spans AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN items USING (doc_id)"""

LLM_ORACLE["op9_warc_packages"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
n AS (SELECT *, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(hex, i, 1)) - 1) AS d FROM h),
v AS (SELECT *, list_transform(range(0, 8), lambda g: d[5*g+1]*65536 + d[5*g+2]*4096 + d[5*g+3]*256 + d[5*g+4]*16 + d[5*g+5]) AS five FROM n)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       CAST(1 + ((five[CAST(1 + k//4 AS INT)] // CAST(2 ** (15 - 5*(k % 4)) AS BIGINT)) % 32) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v"""

LLM_ORACLE["op4_ball_tree_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _link_graph() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in linkgraph.RULES)
    # more rounds than any mass lasts; none without links
    rounds = """s AS (SELECT *, 0 AS k FROM s0 UNION ALL SELECT kind, host, CAST(sum(mass) AS BIGINT), k + 1 FROM (
        SELECT e.kind, dst AS host, CAST(floor(mass * share) AS BIGINT) AS mass, k FROM s JOIN e ON e.kind = s.kind AND e.src = s.host
        UNION ALL SELECT s.kind, s.host, s0.mass, k FROM s JOIN s0 ON s0.kind = s.kind AND s0.host = s.host)
        WHERE k < 400 AND EXISTS (SELECT 1 FROM links) GROUP BY kind, host, k)"""
    link = linkgraph.LINK.replace("'", "''")
    return f"""
WITH RECURSIVE rules(v, rule, rule_host, rule_path) AS (VALUES {rules}),
p AS (SELECT page_id, html, {_LOWER.format(f"coalesce(regexp_extract(url, '{linkgraph.URL}', 1), '')")} AS host,
             coalesce(regexp_extract(url, '{linkgraph.URL}', 2), '') AS path FROM pages),
best AS (SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v
         FROM (SELECT DISTINCT host, path FROM p) JOIN rules
         ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
ruled AS (SELECT page_id, p.host, p.path, rule, v FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path),
shares AS (SELECT host, count(*) FILTER (v = 'allow') / count(*) AS allowed, count(*) FILTER (v = 'block') / count(*) AS blocked
           FROM ruled WHERE host <> '' GROUP BY host),
targets AS (SELECT host AS src, {_LOWER.format("t")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM p WHERE host <> '')),
links AS (SELECT src, dst, count(*) AS n FROM targets WHERE src <> dst GROUP BY src, dst),
e AS (SELECT 'trust' AS kind, src, dst, {linkgraph.DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY src) AS share FROM links
      UNION ALL SELECT 'distrust', dst, src, {linkgraph.DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY dst) FROM links),
s0 AS (SELECT 'trust' AS kind, host, CAST({linkgraph.UNIT} AS BIGINT) AS mass FROM shares WHERE allowed >= {linkgraph.SEED_SHARE}
       UNION ALL SELECT 'distrust', host, CAST({linkgraph.UNIT} AS BIGINT) FROM shares WHERE blocked >= {linkgraph.SEED_SHARE}),
{rounds},
m AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS d FROM s WHERE k = (SELECT max(k) FROM s) GROUP BY host)
SELECT page_id, ruled.host, path, rule,
       coalesce(v, CASE WHEN coalesce(d, 0) > coalesce(t, 0) AND coalesce(d, 0) >= {int(linkgraph.LEAST * linkgraph.UNIT)} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN m ON ruled.host = m.host"""


LLM_ORACLE["op8_link_graph"] = _link_graph()

#: crc32 of a text of ASCII characters, from the polynomial's byte table
_CRC_TABLE = """crc AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_concat([x], range(0, 8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t)"""
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: xor(t[1 + (xor(a, b) & 255)], a // 256)))"""


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


def _tree(name: str, source: str) -> str:
    """Levels (grp, level, d) of the trees over the lists of ``source``, and each group's root."""
    return f"""{name} AS (SELECT grp, 0 AS level, d FROM {source}
    UNION ALL SELECT grp, level + 1, list_transform(range(0, (len(d) + 1) // 2), lambda i: sha256(d[2*i + 1] || coalesce(d[2*i + 2], ''))) FROM {name} WHERE len(d) > 1),
{name}_root AS (SELECT grp, d[1] AS root FROM {name} WHERE len(d) = 1)"""


#: a step: the side of the sibling and its digest, or - where the node is alone; pos counts from 0
_STEP = "CASE WHEN (pos >> level) % 2 = 1 THEN 'L' || d[pos >> level] WHEN len(d) > (pos >> level) + 1 THEN 'R' || d[(pos >> level) + 2] ELSE '-' END"

LLM_ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
rows_ AS (SELECT doc_id, lang, sha256({"||".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    sha256({"||".join(map(_field, ("doc_id", "source", "lang", "(n_chars + CASE WHEN " + _CRC.format("CAST(doc_id AS VARCHAR)") + " % 7 = 0 THEN 1 ELSE 0 END)", "text")))}) AS used
    FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
leaves AS (SELECT lang AS grp, list(leaf ORDER BY pos) AS d FROM placed GROUP BY lang),
{_tree("low", "leaves")},
langs AS (SELECT grp AS lang, root AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos FROM low_root),
tops AS (SELECT 0 AS grp, list(subroot ORDER BY pos) AS d FROM langs),
{_tree("high", "tops")},
ends AS (SELECT lang, subroot, coalesce(list({_STEP} ORDER BY level) FILTER (len(d) > 1), []) AS steps FROM langs, high GROUP BY lang, subroot),
starts AS (SELECT doc_id, lang, leaf, used, coalesce(list({_STEP} ORDER BY level) FILTER (len(d) > 1), []) AS steps
           FROM placed JOIN low ON placed.lang IS NOT DISTINCT FROM low.grp GROUP BY doc_id, lang, leaf, used, pos),
proofs AS (SELECT doc_id, leaf, used, subroot, high_root.root AS root, list_concat(starts.steps, ends.steps) AS proof
           FROM starts JOIN ends ON starts.lang IS NOT DISTINCT FROM ends.lang, high_root),
folds AS (SELECT *, list_reduce(list_concat([used], proof), lambda a, s: sha256(
    CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s[2:]), '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM folds"""
