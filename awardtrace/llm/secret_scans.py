"""Secret scans with corpus-wide ownership frequency.

Each document yields candidate spans of fixed kinds and of some well-known or opaque
token forms. The hashes of all candidate values are counted over the corpus by
distinct owners and repositories. A value that many owners have is a copied example;
one that few have looks live. Spans of the fixed kinds always stay, the others only
where their value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from awardtrace.llm.common import documents, quoted, stage, text_or_empty
from awardtrace.llm.spans import before, let, spans_if
from awardtrace.operators.joins import skew_join

#: Fixed kinds, in the order of ties. Runs of the last two are as long as they can be, so the least length may be
#: part of the pattern; a failing assignment uses up its text, so there the length is tested afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Further forms; a value of the last one must mix digits and both cases and have at least DISTINCT characters.
FORMS = {
    "github": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{12,}",
    "google": r"AIza[A-Za-z0-9_-]{30,}",
    "stripe": r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "opaque": r"[A-Za-z0-9+/_-]{24,}",
}
DISTINCT = 10
KINDS = ["assign", "access", "hex", *FORMS]
#: From so many owners on a value is a copied example, and from so many repositories for each of its owners.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 3

_ANY_FORM = "|".join(FORMS.values())
_LABELLED = "struct<start:int,order:int,end:int,kind:string,hash:string>"


def _kind(value: Column) -> Column:
    kind = F.lit("opaque")
    for name, form in reversed([x for x in FORMS.items() if x[0] != "opaque"]):
        kind = F.when(value.rlike(f"^(?:{form})$"), name).otherwise(kind)
    return kind


def _labelled(found: Column, kind: Column | None) -> Column:
    def one(s: Column) -> Column:
        own = _kind(s["value"]) if kind is None else kind
        at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), own)
        return F.struct(s["start"].alias("start"), at.alias("order"), s["end"].alias("end"), own.alias("kind"),
                        F.sha2(s["value"], 256).alias("hash"))

    return F.transform(found, one)


def _mixed(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & varied


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(extra: Column, base: Column) -> Column:
    """The spans that overlap no base span, in order.

    Base spans by start and others by end in one order: a span overlaps a base one if any
    of these that begins before its end reaches beyond its start.
    """
    none = F.lit(None).cast(_LABELLED)
    merged = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("reach"), none.alias("span"))),
        F.transform(extra, lambda e: F.struct(e["end"].alias("at"), F.lit(0).alias("base"), F.lit(-1).alias("reach"), e.alias("span")))))

    def free(rows: Column) -> Column:
        reach = let(F.transform(rows, lambda r: r["reach"]), lambda own: before(own, -1, F.greatest))
        judged = F.zip_with(rows, reach, lambda r, far: F.struct(
            r["span"].alias("span"), ((r["base"] == 0) & (far <= r["span"]["start"])).alias("free")))
        return F.transform(F.filter(judged, lambda r: r["free"]), lambda r: r["span"])

    return let(merged, free)


def candidates(docs: DataFrame, text: str, key: str, owner: str, repository: str) -> DataFrame:
    """One row per document: ``_row``, the key, owner, repository, and arrays ``base`` and ``extra`` of spans."""
    body = F.col("_text")
    assign = F.filter(spans_if(body.rlike(ASSIGN), body, ASSIGN, 2),
                      lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST)
    access = spans_if(body.contains("AKIA"), body, ACCESS)
    hexes = spans_if(body.rlike(HEX), body, HEX)
    base = F.array_sort(F.concat(_labelled(assign, F.lit("assign")), _labelled(access, F.lit("access")),
                                 _labelled(hexes, F.lit("hex"))))
    forms = F.filter(spans_if(body.rlike(_ANY_FORM), body, _ANY_FORM),
                     lambda s: (_kind(s["value"]) != "opaque") | _mixed(s["value"]))
    apart = F.when(F.size("forms") > 0, _apart(_labelled(F.col("forms"), None), F.col("base"))).otherwise(
        F.expr("slice(base, 1, 0)"))
    name = F.coalesce(F.concat(F.lit("="), quoted(owner).cast("string")), F.lit(""))
    place = F.coalesce(F.concat(F.lit("="), quoted(repository).cast("string")), F.lit(""))
    rows = docs.select(quoted(key).alias("_key"), name.alias("_owner"), place.alias("_repository"),
                       text_or_empty(text).alias("_text"))
    return (rows.withColumn("base", base).withColumn("forms", forms).withColumn("extra", apart).drop("_text", "forms")
            .withColumn("_row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repositories``: how many hold a value; a repository belongs to its owner.

    Three groupings that each combine on the map side, so a value in a third of all
    documents costs a task one row per owner and repository.
    """
    holders = found.select("hash", "_owner", "_repository").distinct()
    by_owner = holders.groupBy("hash", "_owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
         repository: str = "lang", copied_owners: int = COPIED_OWNERS,
         copied_repositories: float = COPIED_REPOSITORIES) -> DataFrame:
    """``key, base, spans, n_live, n_copied, holders`` for every row of ``docs``.

    A value is live if fewer than ``copied_owners`` hold it, and these in fewer than
    ``copied_repositories`` repositories each on average. ``holders`` has (start, order,
    owners, repositories) of all spans, base ones and others, in order.

    ``base`` and ``spans`` are arrays of (start, order, end, kind, hash) in order. A
    null text counts as empty; a very long one takes time in proportion to its length and
    matches; null owners or repositories are one of their own. An empty table gives no rows.
    """
    rows = stage(candidates(docs, text, key, owner, repository), "secret-candidates")
    found = rows.select("_row", "_owner", "_repository", F.explode(F.concat("base", "extra")).alias("_span"))
    found = found.withColumn("hash", F.col("_span.hash"))
    known = skew_join(found.select("_row", "_span", "hash"), ownership(found), ["hash"])
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < F.col("owners") * copied_repositories)
    is_base = F.col("_span.order") <= 3
    judged = known.groupBy("_row").agg(  # bounded by the spans of one document
        F.array_sort(F.collect_list(F.when(live | is_base, F.col("_span")))).alias("spans"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct(F.col("_span.start").alias("start"), F.col("_span.order").alias("order"),
                                             "owners", "repositories"))).alias("holders"))
    nothing = F.expr("slice(base, 1, 0)")
    return rows.join(judged, "_row", "left").select(
        F.col("_key").alias(key), "base", F.coalesce("spans", nothing).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
        F.coalesce("holders", F.array().cast("array<struct<start:int,order:int,owners:bigint,repositories:bigint>>"))
        .alias("holders"))


def op8_secret_scans(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        "n_live", "n_copied")


def _sql() -> str:
    def found(kind: str, pattern: str, group: int = 0) -> str:
        pattern = pattern.replace("'", "''")
        return f"""SELECT r, doc_id, source, lang, {kind} AS kind, regexp_extract_all(t, '{pattern}', 0) AS m,
          regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p FROM d"""

    kinds = " ".join(f"WHEN regexp_matches(v, '^(?:{form})$') THEN '{k}'" for k, form in FORMS.items() if k != "opaque")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
matches AS ({found("'assign'", ASSIGN, 2)} UNION ALL {found("'access'", ACCESS)}
  UNION ALL {found("'hex'", HEX)} UNION ALL {found("'form'", _ANY_FORM)}),
each AS (SELECT r, doc_id, source, lang, kind, unnest(m) AS m, unnest(v) AS v, unnest(p[:len(m)]) AS p,
                unnest(range(len(m))) AS i FROM matches WHERE len(m) > 0),
placed AS (
  SELECT r, doc_id, source, lang, v, sum(length(p) + length(m)) OVER w AS e,
         sum(length(p) + length(m)) OVER w - length(m) AS s,
         CASE WHEN kind <> 'form' THEN kind {kinds} ELSE 'opaque' END AS kind
  FROM each WINDOW w AS (PARTITION BY r, kind ORDER BY i)),
fit AS (
  SELECT *, list_position({KINDS}, kind) AS k, sha256(v) AS h FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(v) >= {ASSIGN_LEAST}
    WHEN 'opaque' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
      AND len(list_distinct(string_split(v, ''))) >= {DISTINCT}
    ELSE true END),
apart AS (
  SELECT * FROM fit AS f WHERE k <= 3 OR NOT EXISTS (
    SELECT 1 FROM fit AS b WHERE b.r = f.r AND b.k <= 3 AND b.s < f.e AND f.s < b.e)),
owners AS (
  SELECT h, owners < {COPIED_OWNERS} AND repositories < owners * {COPIED_REPOSITORIES} AS live FROM (
    SELECT h, count(DISTINCT coalesce('=' || source, '')) AS owners,
           count(DISTINCT (coalesce('=' || source, ''), coalesce('=' || lang, ''))) AS repositories FROM apart GROUP BY h)),
sums AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM apart JOIN owners USING (h) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN sums USING (r)
"""


OP8_SQL = _sql()
