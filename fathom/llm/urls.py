"""URL rules, and trust and distrust spread over the links between hosts.

Rules judge a page by its host and path; the longest rule that fits wins. For the
other pages the host decides. A host's trust seed is the share of its pages that
rules allow, its distrust seed the share that they block. Trust goes along links
(personalised PageRank from the trusted hosts); distrust goes against them, from
blocked hosts to those that link to them: what rules don't judge of a host gets
``DAMPING`` times the mean distrust of the hosts that it links to, so it lies
between 0 and 1 however many others link to the same hosts. Both are iterated
until they change by less than ``TOLERANCE``, however long the ways are. A host is
blocked if its distrust is at least ``threshold`` and more than its trust.

Pages are reduced to counts by host, and links to one row for each pair of hosts,
before anything is joined; ranks are added up with partial sums, so a host that a
third of all pages belong or link to is a few rows like any other.

Defined results: host and path of a null url and one without ``://`` are empty,
and no rule fits them; an empty host is allowed; links to a host itself don't
count; a null page has no links; repeated rows count as often as they occur in
the seeds and once as links; an empty table gives no rows. Columns that the
operator doesn't use may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>\\]+)"
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
#: Sum over all hosts of the change in 5 rounds.
TOLERANCE = 1e-9
SQL_LINKS = 150


def lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, like ``net/``, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """pages: host, html. Returns from, to: one row for each pair of different hosts with a link."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower))
    links = pages.select(F.col("host").alias("from"), F.explode(found).alias("to"))
    return links.where((F.col("from") != "") & (F.col("from") != F.col("to"))).distinct()


def _iterate(edges: DataFrame, seeds: DataFrame, rounds: int | None, tolerance: float) -> DataFrame:
    """edges: src, dst, part. Each host's seed and the parts of the ranks sent to it; without ``rounds``, until they stay."""
    edges = materialise(edges, "edges")
    seeds = seeds.where(F.col("seed") > 0).select("host", F.col("seed").cast("double").alias("rank"))
    ranks = before = seeds
    k = 0
    while rounds is None or k < rounds:
        sent = edges.join(ranks, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("part")).alias("rank"))
        ranks = seeds.unionByName(sent).groupBy("host").agg(F.sum("rank").alias("rank"))
        k += 1
        if k % 5 == 0:
            ranks = materialise(ranks, "ranks")
            if rounds is None:
                both = ranks.join(before.withColumnRenamed("rank", "old"), "host", "full")
                change = both.agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
                if (change or 0.0) < tolerance:
                    break
                before = ranks
    return ranks


def _parts(links: DataFrame, damping: float) -> DataFrame:
    out = links.groupBy("from").agg(F.count("*").alias("degree"))
    return links.join(out, "from").select("from", "to", (F.lit(damping) / F.col("degree")).alias("part"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """links: from, to. seeds: host, seed. Personalised PageRank, in units of a seed's own share."""
    if links.isEmpty():
        return seeds.select("host", F.col("seed").alias("rank"))
    edges = _parts(links, damping).select(F.col("from").alias("src"), F.col("to").alias("dst"), "part")
    return _iterate(edges, seeds, rounds, tolerance)


def spread_back(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """links: from, to. seeds: host, seed (0 to 1). The seed, and of the rest the mean rank of the hosts linked to, damped."""
    if links.isEmpty():
        return seeds.select("host", F.col("seed").alias("rank"))
    own = seeds.select(F.col("host").alias("from"), F.col("seed").alias("own"))
    rest = F.lit(1.0) - F.coalesce("own", F.lit(0.0))
    edges = _parts(links, damping).join(own, "from", "left").select(F.col("to").alias("src"), F.col("from").alias("dst"), (F.col("part") * rest).alias("part"))
    return _iterate(edges.where(F.col("part") > 0), seeds, None, tolerance)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, host, path, rule, verdict, trust and distrust."""
    at = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    at = at.withColumns({"rule": rule, "said": verdict})
    share = lambda what: F.avg((F.coalesce(F.col("said"), F.lit("")) == what).cast("double"))
    hosts = materialise(at.where(F.col("host") != "").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "hosts")
    links = materialise(host_links(pages.select(host(F.col("url")).alias("host"), "html")), "links")
    trust = spread(links, hosts.select("host", F.col("good").alias("seed")), rounds=None)
    distrust = spread_back(links, hosts.select("host", F.col("bad").alias("seed")))
    judged = hosts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    judged = judged.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    bad = (F.round("distrust", 9) >= threshold) & (F.round("distrust", 9) > F.round("trust", 9))
    return at.join(judged, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust"
    )


def op8_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    link = LINK.replace("'", "''")
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in rules) + " END"
    steps = [
        "a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"b AS (SELECT page_id, html, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)",
        f"c AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS said FROM b)",
        "h AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1e0 ELSE 0e0 END) AS good, avg(CASE WHEN said = 'block' THEN 1e0 ELSE 0e0 END) AS bad FROM c WHERE host <> '' GROUP BY host)",
        f"x AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM b)",
        f"l AS (SELECT DISTINCT src, {low.format('dst')} AS dst FROM x WHERE src <> '' AND src <> {low.format('dst')})",
    ]
    # What k links carry of the seeds adds up to the ranks; at SQL_LINKS of them it is below the rounding.
    for name, seed, src, dst, rest in (("t", "good", "src", "dst", "1e0"), ("d", "bad", "dst", "src", "1e0 - coalesce(h.bad, 0e0)")):
        steps.append(
            f"{name}e AS (SELECT l.{src} AS src, l.{dst} AS dst, {DAMPING}e0 / count(*) OVER (PARTITION BY l.src) * ({rest}) AS part FROM l LEFT JOIN h ON h.host = l.src)"
        )
        steps.append(
            f"{name}k AS (SELECT 0 AS k, host, {seed} AS r FROM h WHERE {seed} > 0 UNION ALL "
            f"SELECT k + 1, dst, sum(r * part) FROM {name}k JOIN {name}e ON src = host WHERE k < {SQL_LINKS} AND part > 0 GROUP BY k, dst)"
        )
        steps.append(f"{name} AS (SELECT host, sum(r) AS r FROM {name}k GROUP BY host)")
    steps.append("j AS (SELECT h.host, coalesce(t.r, 0e0) AS good, coalesce(d.r, 0e0) AS bad FROM h LEFT JOIN t USING (host) LEFT JOIN d USING (host))")
    return (
        "WITH RECURSIVE " + ",\n".join(steps) + "\nSELECT page_id, c.host, path, rule, coalesce(said, CASE WHEN round(j.bad, 9) >= "
        f"{THRESHOLD}e0 AND round(j.bad, 9) > round(j.good, 9) THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN j ON c.host = j.host"
    )


OP8_SQL = _sql()
