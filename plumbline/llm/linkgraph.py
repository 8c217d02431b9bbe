"""URL filtering by rules and by propagation over the host graph, in DataFrame operations only.

A rule is a host and a path beginning, such as ``example.com/de/``; it fits that host and its subdomains, and the longest
fitting rule decides. All other pages get their host's verdict. A host is a trusted (blocked) seed if rules allow
(block) at least half of its pages. Trust is the personalised PageRank of the trusted seeds along the links between
hosts; distrust is that of the blocked seeds against them, so it reaches hosts that link to blocked ones. A host is
blocked if its distrust exceeds its trust and is at least ``LEAST`` of what a seed has by itself.

Mass is counted in whole units of ``1/UNIT`` of a seed's own, so sums don't depend on their order. It never falls from one
round to the next and has a bound, so propagation goes on until a fixed point, however far from a seed; what a round adds
shrinks by ``DAMPING``, so about 170 rounds are the most for one seed (14 more for ten times the seeds). Every ``STRIDE``
rounds the state is written to the checkpoint folder.

Links are counted per pair of hosts before any shuffle of them, rules are joined per host, and a host's pages may be
split where its rows are joined (no step needs all pages of a host in one place).

Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule fits and no link reaches;
a null html has no links; links of a host to itself don't count; repeated rows each get their verdict; of rules of the
same length the last by code point wins; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii
from plumbline.session import cut

#: verdict and rule
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
STRIDE = 4
UNIT = 10**12
LEAST = 0.001
SEED_SHARE = 0.5

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column | str) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_table(spark, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    rows = [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, rule_host string, rule_path string")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of the hosts that have any: a host's rules are found by its endings, at most as long as a rule's host."""
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    count = F.least(F.size(labels), F.lit(depth))
    endings = F.transform(F.sequence(F.lit(1), count), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    return (
        hosts.filter((F.col("host") != "") & F.lit(depth > 0)).select("host", F.explode(endings).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "rule_path", "verdict")).alias("rules"))
    )


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, links) between different hosts."""
    targets = F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)))
    return (
        pages.filter(F.col(host) != "").select(F.col(host).alias("src"), targets.alias("dst")).withColumn("dst", lower_ascii("dst"))
        .filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))
    )


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(kind, host, mass): trust along and distrust against ``links``, from the ``seeds`` (kind, host)."""
    out = links.groupBy("src").agg(F.sum("links").alias("total"))
    into = links.groupBy("dst").agg(F.sum("links").alias("total"))
    share = (F.lit(damping) * F.col("links") / F.col("total")).alias("share")
    edges = cut(
        links.join(out, "src").select(F.lit("trust").alias("kind"), "src", "dst", share)
        .unionAll(links.join(into, "dst").select(F.lit("distrust"), F.col("dst"), F.col("src"), share))
    )
    own = cut(seeds.select("kind", "host", F.lit(UNIT).cast("long").alias("mass")))
    state, same = own, False
    while not same:
        following = state
        for _ in range(STRIDE):
            moved = following.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), F.floor(F.col("mass") * F.col("share")).cast("long").alias("mass")
            )
            following = moved.unionAll(own).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        following = cut(following)
        # mass never falls, so a state that some rounds leave alone is the fixed point
        change = following.unionAll(state.select("kind", "host", -F.col("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        same = not change.filter("mass <> 0").limit(1).count()
        state = following
    return state


def judge(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    damping: float = DAMPING, least: float = LEAST, seed_share: float = SEED_SHARE,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row."""
    placed = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html).alias("html"))
    hosts = placed.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    fitting = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    ruled = cut(
        placed.drop("html").join(rules_by_host(hosts, rules), "host", "left")
        .select("page_id", "host", "path", fitting.alias("best"))
        .select("page_id", "host", "path", "best.rule", F.col("best.verdict").alias("by_rule"))
    )
    shares = ruled.filter("host <> ''").groupBy("host").agg(
        (F.count_if(F.col("by_rule") == "allow") / F.count(F.lit(1))).alias("allowed"),
        (F.count_if(F.col("by_rule") == "block") / F.count(F.lit(1))).alias("blocked"),
    )
    seeds = shares.filter(F.col("allowed") >= seed_share).select(F.lit("trust").alias("kind"), "host").unionAll(
        shares.filter(F.col("blocked") >= seed_share).select(F.lit("distrust"), "host")
    )
    mass = propagate(cut(host_links(placed, "host", "html")), seeds, damping)
    sums = [F.sum(F.when(F.col("kind") == k, F.col("mass"))).alias(k) for k in ("trust", "distrust")]
    by_host = cut(mass.groupBy("host").agg(*sums).na.fill(0))
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    blocked = (distrust > trust) & (distrust >= int(least * UNIT))
    verdict = F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow"))
    return ruled.join(by_host, "host", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), (trust / UNIT).alias("trust"), (distrust / UNIT).alias("distrust")
    )
