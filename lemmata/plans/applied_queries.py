"""Queries over mapped results, samples and duplicate prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.operators import applied
from lemmata.plans.runtime import table


def mapped_results(s: SparkSession, d: str) -> DataFrame:
    """A candidate's cosine stands for how sure its mapping is, positive log-odds for its verification."""
    c = table(s, d, "candidates").filter("query_id IS NOT NULL AND doc_id IS NOT NULL AND NOT isnan(score)")
    best = {name: F.max(F.when(F.col("channel") == name, F.col("score"))) for name in ("dense", "rerank")}
    t = c.groupBy("query_id", "doc_id").agg(best["dense"].alias("confidence"), F.coalesce(best["rerank"] > 0, F.lit(False)).alias("verified"))
    out = applied.mapped(t.withColumn("applies", F.col("confidence").isNotNull()))
    return out.select("query_id", "doc_id", "place", "verified", F.round("confidence", 6).alias("confidence"))


def evaluation_sample(s: SparkSession, d: str) -> DataFrame:
    """A hundred records for evaluation, the same in every run (T9); the limit is the feature."""
    return applied.sample(table(s, d, "corpus").select("doc_id"), "doc_id", 100)


def repeated_prefixes(s: SparkSession, d: str) -> DataFrame:
    return applied.repeated_prefixes(table(s, d, "corpus"))


def declaration_urls(s: SparkSession, d: str) -> DataFrame:
    """The page of every formal record, by its source as the module and its id as the name."""
    t = table(s, d, "corpus").filter("doc_id LIKE 'mathlib4::%'")
    name = F.regexp_replace("doc_id", "^mathlib4::", "")
    return t.select("doc_id", applied.declaration_url(F.lit("Mathlib.Data"), F.regexp_replace(name, "[^A-Za-z0-9.]", "")).alias("url"))


QUERIES = {f.__name__: f for f in (mapped_results, evaluation_sample, repeated_prefixes, declaration_urls)}

ORACLE_SQL = {
    "mapped_results": """
WITH t AS (
  SELECT query_id, doc_id, max(score) FILTER (channel = 'dense') AS confidence, coalesce(max(score) FILTER (channel = 'rerank') > 0, false) AS verified
  FROM candidates WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND NOT isnan(score) GROUP BY query_id, doc_id
)
SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY verified DESC, confidence DESC, doc_id) AS INTEGER) AS place, verified, round(confidence, 6) AS confidence
FROM t WHERE confidence >= 0.5""",
    "evaluation_sample": "SELECT doc_id FROM corpus ORDER BY md5(doc_id), doc_id LIMIT 100",
    "repeated_prefixes": "SELECT count(*) AS n, CAST(count(*) - count(DISTINCT substr(coalesce(statement, ''), 1, 120)) AS BIGINT) AS duplicates FROM corpus",
    "declaration_urls": f"""
SELECT doc_id, CASE WHEN n <> '' THEN '{applied.DOCS_URL}Mathlib/Data.html#' || n END AS url
FROM (SELECT doc_id, regexp_replace(regexp_replace(doc_id, '^mathlib4::', ''), '[^A-Za-z0-9.]', '', 'g') AS n FROM corpus WHERE doc_id LIKE 'mathlib4::%')""",
}
