"""Retrieval metrics as aggregates over (query_id, doc_id, rank) and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(ranked: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., query_id, rank): of every query with a truth the first rank of a true record, null if none."""
    hits = ranked.join(truth.distinct(), ["query_id", "doc_id"]).groupBy(*by, "query_id").agg(F.min("rank").alias("rank"))
    asked = truth.select("query_id").distinct()
    if by:
        asked = asked.join(F.broadcast(ranked.select(*by).distinct()))  # by holds names of channels and the like
    return asked.join(hits, [*by, "query_id"], "left")


def metrics(hits: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Recall at each k, mean reciprocal rank, and the median rank of what was found."""
    recall = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    return hits.groupBy(*by).agg(F.count("*").alias("queries"), *recall, mrr, F.median("rank").cast("double").alias("median_rank"))


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of queries with the same first record, and the mean share of common records in the first k."""
    a1, b1 = (x.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias(f"s{n}"), F.min_by("doc_id", "rank").alias(f"t{n}")) for n, x in (("a", a), ("b", b)))
    j = a1.join(b1, "query_id")
    return j.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("ta") == F.col("tb")).cast("double")), 6).alias("top1"), F.round(F.avg(F.size(F.array_intersect("sa", "sb")) / F.lit(float(k))), 6).alias("overlap"))
