"""URL filters: rules first, and for the rest trust that spreads over the links between hosts.

Hosts of pages that the rules allow are trusted seeds, hosts of blocked pages are
distrusted ones. Personalised PageRank carries trust along links and distrust
against them; a host with more distrust than trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import drop, lower_ascii, quoted, stage, staging
from awardtrace.operators.joins import BROADCAST_BYTES, skew_join

#: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING = 0.85
#: Rounds between two written tables of ranks, and links that one task passes ranks along.
ROUNDS, LINKS_A_TASK = 8, 500_000
#: Bytes of a host's rank that may be broadcast, its name at most 253 characters.
RANK_BYTES = 320
#: Rounds go on until the ranks stay the same. They do if the changes of a kind's ranks in a round add up to less than this; a change passes at most DAMPING on,
#: so what all later rounds would still change is below TOLERANCE * DAMPING / (1 - DAMPING).
TOLERANCE = 1e-6
#: A host is blocked if its distrust is above so many times its trust.
MARGIN = 1.05

_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict), else null."""
    best = None
    for own, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        value = F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if best is None else best


def _parents(hosts: DataFrame) -> DataFrame:
    """Links both ways between a host and the domain above it, down to two labels."""
    above = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    up = hosts.select("host", above.alias("above")).where(F.col("above") != "")
    return up.select(F.explode(F.array(F.struct(F.col("host").alias("source"), F.col("above").alias("target")),
                                       F.struct(F.col("above").alias("source"), F.col("host").alias("target"))))
                     .alias("e")).select("e.*", F.lit(1).cast("long").alias("links"))


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """``source, target, links``: links from pages of a host to other hosts, and to and from its own domain."""
    linked = pages.where(F.col("host") != "").select(
        F.col("host").alias("source"),
        F.explode(F.regexp_extract_all(quoted(html), F.lit(_LINK), F.lit(1))).alias("target"))
    linked = (linked.withColumn("target", lower_ascii(F.col("target"))).where(F.col("source") != F.col("target"))
              .groupBy("source", "target").agg(F.count("*").alias("links")))
    hosts = pages.select("host").where(F.col("host") != "").distinct()
    return linked.unionByName(_parents(hosts)).groupBy("source", "target").agg(F.sum("links").alias("links"))


def _round(ways: DataFrame, ranks: DataFrame, base: DataFrame, damping: float, small: bool) -> DataFrame:
    """The ranks of the next round, ungrouped."""
    on = ["kind", "host"]
    along = ways.join(F.broadcast(ranks), on) if small else skew_join(ways, ranks, on)
    return base.unionByName(along.select(
        "kind", F.col("to").alias("host"), (F.col("rank") * F.col("part") * damping).alias("rank")))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` of personalised PageRank, in rounds until the ranks stay the same.

    ``seeds`` has ``host, kind, weight``. Trust leaves a host along its links, distrust
    against them, in parts by number of links. What a host without links holds is not
    passed on. The ranks are written to the shared folder every ``ROUNDS`` rounds, those of
    the last round beside the ones before it, and older ones removed. Rounds end when the
    changes of a kind's ranks, summed over hosts, are below ``tolerance``; with a damping
    below 1 they shrink by it in every round.
    """
    ways = links.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links"),
        F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links"),
    )).alias("w")).select("w.*")
    out = ways.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    with staging(links.sparkSession) as scope:
        ways = stage(skew_join(ways, out, ["kind", "host"]).select(
            "kind", "host", "to", (F.col("links") / F.col("all")).alias("part")), "link-parts")
        total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))  # two rows
        start = stage(seeds.join(F.broadcast(total), "kind").select(
            "kind", "host", (F.col("weight") / F.col("all")).alias("rank")), "link-seeds")
        # A host with a rank is a seed or at the end of a link, so this bounds them, and with them what is broadcast.
        most = ways.count() + start.count()
        small, tasks = most * RANK_BYTES <= BROADCAST_BYTES, 1 + most // LINKS_A_TASK
        ways, start = ways.coalesce(tasks), start.coalesce(tasks)
        base = start.withColumn("rank", F.col("rank") * (1 - damping))
        ranks = start
        while True:
            now = ranks
            for left in range(ROUNDS - 1, -1, -1):
                before, now = now, _round(ways, now, base, damping, small)
                if left:
                    now = now.groupBy("kind", "host").agg(F.sum("rank").alias("rank")).coalesce(tasks)
            was = before.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
            now = now.withColumn("was", F.lit(0.0)).unionByName(was).groupBy("kind", "host").agg(
                F.sum("rank").alias("rank"), F.sum("was").alias("was")).coalesce(tasks)
            now = stage(now, "link-ranks")
            drop(ranks)
            ranks = now.drop("was")
            change = now.groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("change"))
            most_change = change.agg(F.max("change")).first()[0]
            if most_change is None or most_change < tolerance:
                break
            ranks = now
        of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
        return scope.keep(ranks.groupBy("host").agg(of("trust"), of("distrust")).coalesce(tasks), "host-trust")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html",
          key: str = "page_id", margin: float = MARGIN) -> DataFrame:
    """``key, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, no rule and no
    trust or distrust; such pages, and those no seed reaches, are allowed. A null html
    has no links; a very long one is searched whole. Pages that repeat count again, as seeds
    and as links. An empty table gives no rows.
    """
    host, path = host_of(quoted(url)), path_of(quoted(url))
    parsed = pages.select(quoted(key).alias("_key"), host.alias("host"), path.alias("path"), quoted(html).alias("_html"))
    ruled = parsed.withColumn("_rule", _rule(F.col("host"), F.col("path"), rules))
    links = host_links(parsed, "_html")
    kind = F.when(F.col("_rule.verdict") == "allow", "trust").otherwise("distrust")
    seeds = ruled.where(F.col("_rule").isNotNull() & (F.col("host") != "")).groupBy(
        "host", kind.alias("kind")).agg(F.count("*").alias("weight"))
    scores = spread(seeds, links)
    judged = skew_join(ruled.drop("_html"), scores, ["host"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when(distrust > trust * margin, "block").otherwise("allow")
    return judged.select(
        F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op10_url_filters(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("trust", "distrust")


def _sql() -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)))
    link = _LINK.replace("'", "''")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Rounds far beyond TOLERANCE. The host '*' always has rank 1 and gives the seeds their share in every round.
    return rf"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS r, page_id, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT r, page_id, host, path, CASE {cases} END AS rule FROM p),
linked AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{upper}', '{lower}') AS dst
  FROM p WHERE host <> ''),
above AS (
  SELECT host, regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) AS up FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
edges AS (
  SELECT src, dst, sum(n)::BIGINT AS n FROM (
    SELECT src, dst, 1 AS n FROM linked WHERE src <> dst
    UNION ALL SELECT host, up, 1 FROM above WHERE up <> '' UNION ALL SELECT up, host, 1 FROM above WHERE up <> '')
  GROUP BY src, dst),
directed AS (SELECT 'trust' AS kind, src AS host, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
parts AS (SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS part FROM directed),
seeds AS (
  SELECT CASE WHEN rule.verdict = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n
  FROM ruled WHERE rule IS NOT NULL AND host <> '' GROUP BY ALL),
shares AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank FROM seeds),
ways AS (
  SELECT kind, host, dst, part * {DAMPING}::DOUBLE AS part FROM parts
  UNION ALL SELECT kind, '*', host, rank * (1 - {DAMPING}::DOUBLE) FROM shares
  UNION ALL SELECT DISTINCT kind, '*', '*', 1 FROM shares),
ranks(round, kind, host, rank) AS (
  SELECT 0, kind, host, rank FROM shares UNION ALL SELECT DISTINCT 0, kind, '*', 1 FROM shares
  UNION ALL SELECT round + 1, kind, w.dst, sum(r.rank * w.part) FROM ranks AS r JOIN ways AS w USING (kind, host)
  WHERE round < 120 GROUP BY round, kind, w.dst),
scores AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust,
         coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM ranks WHERE round = 120 GROUP BY host)
SELECT page_id, ruled.host, path, rule.rule AS rule,
       coalesce(rule.verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * {MARGIN}::DOUBLE
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN scores ON ruled.host = scores.host
"""


OP10_SQL = _sql()
