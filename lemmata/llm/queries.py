"""The p*_ queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm import abuse, capping, glyphs, markup, mixing, neardup, packing, ranking
from lemmata.plans.runtime import table

SHARE_CAP = 0.02
TOP = 3


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = markup.clean_markup(table(spark, d, "corpus"))
    return out.select("doc_id", F.explode("kinds").alias("kind"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every statement as clean text, and the kinds of markup it held."""
    return markup.clean_markup(table(spark, d, "corpus"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    w = ranking.wide(table(spark, d, "candidates"), table(spark, d, "corpus"))
    return ranking.top(ranking.stationary(w), TOP).select("query_id", "doc_id")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The stationary mass of every candidate, relative to the mean of its query."""
    w = ranking.wide(table(spark, d, "candidates"), table(spark, d, "corpus"))
    return ranking.stationary(w).select("query_id", "doc_id", F.round("mass", 6).alias("mass"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.Versions(table(spark, d, "corpus")).pairs()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every record, its copies and its links."""
    return neardup.Versions(table(spark, d, "corpus")).classes()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.affected(table(spark, d, "corpus"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Both fields of every record in their one form, and which were affected."""
    return glyphs.repaired(table(spark, d, "corpus"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.cap_contributors(table(spark, d, "corpus"), share=SHARE_CAP).filter("NOT kept").select("doc_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """The capped corpus by key, with what was read as contributor and citations."""
    return capping.cap_contributors(table(spark, d, "corpus"), share=SHARE_CAP).filter("kept").select("doc_id", "contributor", "citations")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))
    return packed.filter("is_split AND piece = 0").select("container", "doc_id")


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Bins used, tokens laid and the share of the room that is filled, by container kind."""
    packed = packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))
    bins = packed.groupBy("container", "capacity_tokens", "block", "bin_no").agg(F.sum("tokens").alias("tokens"))
    out = bins.groupBy("container", "capacity_tokens").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"))
    return out.withColumn("filled", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of an assignment, by container kind: every document laid once and whole, no bin too full."""
    packed = packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))
    docs = packed.groupBy("container", "capacity_tokens", "doc_id").agg(
        F.count("*").alias("pieces"), F.sum("tokens").alias("n"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.countDistinct("start").alias("starts"), F.bool_or("is_split").alias("split")
    )
    docs = docs.groupBy("container", "capacity_tokens").agg(
        F.count("*").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("n").alias("tokens"), F.count_if("split").alias("split"),
        F.count_if((F.col("end") != F.col("n")) | (F.col("starts") != F.col("pieces"))).alias("torn"),
    )
    bins = packed.groupBy("container", "block", "bin_no").agg(F.sum("tokens").alias("n"), F.first("capacity_tokens").alias("c"))
    bins = bins.groupBy("container").agg(F.count_if(F.col("n") > F.col("c")).alias("overfull"))
    return docs.join(bins, "container").select("container", "documents", "pieces", "tokens", "split", "torn", "overfull")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    base = mixing.sized(table(spark, d, "documents"))
    return mixing.report(base, table(spark, d, "mix_targets")).filter("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used; documents not used at all have no row."""
    base = mixing.sized(table(spark, d, "documents"))
    out = mixing.mix(base, mixing.plan(base, table(spark, d, "mix_targets")))
    return out.select(F.col("id").alias("doc_id"), F.col("src").alias("source"), F.col("n").alias("tokens"), "times")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Repeats and shares reached, by target."""
    base = mixing.sized(table(spark, d, "documents"))
    return mixing.report(base, table(spark, d, "mix_targets")).withColumn("reached_share", F.round("reached_share", 6))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_documents(docs, abuse.train(abuse.reviewed(docs, table(spark, d, "reviews"))))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("score") >= abuse.FLAGGED).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and offending spans of every document."""
    return _scored(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and rate, by source."""
    return abuse.rates(_scored(spark, d))


_CAPPED = """
WITH a AS (
  SELECT doc_id, regexp_replace(trim(lower(source)), '^https?://', '') AS s, trim(citations) AS t FROM corpus
), b AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(s, '^([^/?#]*)', 1), ':[0-9]*$', ''), '^www\\.', '') AS c,
    CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END AS x FROM a
), c AS (
  SELECT doc_id, CASE WHEN trim(c) <> '' THEN c END AS contributor,
    CASE WHEN x >= 0 AND isfinite(x) THEN CAST(trunc(x) AS BIGINT) END AS citations FROM b
), d AS (
  SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY citations DESC NULLS LAST, doc_id) AS place,
    (SELECT CAST(floor(count(*) * 0.02 + 1e-9) AS BIGINT) FROM corpus) AS cap FROM c
)
"""

_SIZES = """
WITH s AS (
  SELECT lower(trim(source)) AS src, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE trim(source) <> ''
), z AS (SELECT src, sum(n) AS n FROM s GROUP BY src)
"""

_MIX = """
WITH s AS (
  SELECT doc_id, lower(trim(source)) AS src, coalesce(CAST(strlen(text) AS BIGINT), 0) AS n,
    CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents WHERE trim(source) <> ''
), z AS (SELECT src, sum(n) AS size FROM s GROUP BY src), total AS (SELECT sum(n) AS total FROM s),
t AS (
  SELECT t.source, lower(trim(t.source)) AS src, t.target_share, CAST(t.max_repeats AS BIGINT) AS max_repeats,
    coalesce(z.size, 0) AS size, t.target_share * total AS budget
  FROM mix_targets t CROSS JOIN total LEFT JOIN z ON z.src = lower(trim(t.source))
), u AS (
  SELECT *, size * max_repeats < budget AS short,
    CAST(CASE WHEN size * max_repeats < budget OR size = 0 THEN max_repeats ELSE floor(budget / size) END AS BIGINT) AS repeats FROM t
), v AS (
  SELECT *, CASE WHEN short OR repeats >= max_repeats THEN 0 ELSE greatest(budget - repeats * size, 0) END AS rest FROM u
), w AS (
  SELECT doc_id, src, n, sum(n) OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) AS upto FROM s
), x AS (
  SELECT w.doc_id, w.src, w.n, least(v.repeats + CASE WHEN w.upto <= v.rest THEN 1 ELSE 0 END, v.max_repeats) AS times FROM w JOIN v USING (src)
)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_ranking, p3_found, p3_classes, p4_found, p4_repaired, p5_found, p5_kept, p6_found, p6_assignment, p6_fill, p6_audit, p7_found, p7_mix, p7_report, p8_found, p8_scores, p8_rates)
}

ORACLE_SQL: dict[str, str] = {
    "p5_found": _CAPPED + "SELECT doc_id FROM d WHERE contributor IS NOT NULL AND place > cap",
    "p5_kept": _CAPPED + "SELECT doc_id, contributor, citations FROM d WHERE contributor IS NULL OR place <= cap",
    "p6_found": "SELECT container, doc_id FROM documents, pack_limits WHERE strlen(text) > capacity_tokens",
    "p6_audit": """
WITH a AS (
  SELECT container, capacity_tokens AS c, coalesce(CAST(strlen(text) AS BIGINT), 0) AS n FROM documents, pack_limits
)
SELECT container, count(*) AS documents, CAST(sum(CASE WHEN n = 0 THEN 1 ELSE ceil(n / c) END) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS tokens,
  count(*) FILTER (n > c) AS split, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS overfull
FROM a GROUP BY container""",
    "p7_mix": _MIX + "SELECT doc_id, src AS source, n AS tokens, times FROM x WHERE times > 0",
    "p7_report": _MIX + """, g AS (SELECT src, count(*) AS documents, sum(n * times) AS tokens FROM x WHERE times > 0 GROUP BY src)
SELECT v.source, v.target_share, v.max_repeats, CAST(v.size AS BIGINT) AS source_tokens, v.repeats, coalesce(g.documents, 0) AS documents, CAST(coalesce(g.tokens, 0) AS BIGINT) AS tokens,
  round(coalesce(g.tokens, 0) / (SELECT sum(tokens) FROM g), 6) AS reached_share, v.short FROM v LEFT JOIN g USING (src)""",
    "p7_found": _SIZES + """
SELECT t.source FROM mix_targets t LEFT JOIN z ON z.src = lower(trim(t.source))
WHERE coalesce(z.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM z)""",
}
