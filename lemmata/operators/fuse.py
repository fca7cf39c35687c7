"""Fusion of rankings: reciprocal ranks, weights, priors, a second-stage blend and the live merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K, LIVE_K = 10, 60


def rrf(channels: dict[str, DataFrame], k: float = RRF_K) -> DataFrame:
    """(query_id, doc_id, a rank for each channel, score): the sum of 1 / (k + rank) over the channels that have the record."""
    parts = [df.select("query_id", "doc_id", *[(F.col("rank") if n == name else F.lit(None).cast("int")).alias(f"{n}_rank") for n in channels]) for name, df in channels.items()]
    ranks = [F.min(f"{n}_rank").alias(f"{n}_rank") for n in channels]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(*ranks)
    score = reduce(Column.__add__, [F.coalesce(1.0 / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n in channels])
    return fused.withColumn("score", score)


def ordered(fused: DataFrame, channels: list[str], k: int | None = None) -> DataFrame:
    """The place of every record: by score, then by rank in the first channel, the next, and id (T5)."""
    order = [F.desc(F.round("score", 9)), *[F.asc_nulls_last(f"{c}_rank") for c in channels], F.asc("doc_id")]
    out = fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.filter(F.col("place") <= k) if k else out


def single(channel: DataFrame, k: float = RRF_K) -> DataFrame:
    """A single mode's score is that of its rank alone."""
    return channel.select("query_id", "doc_id", "rank", (1.0 / (k + F.col("rank"))).alias("score"))


def checked_weights(weights: dict[str, float], known: tuple[str, ...]) -> dict[str, float]:
    """Weights of known sources, finite and not negative; those of 1 say nothing."""
    for name, w in weights.items():
        if name not in known:
            raise ValueError(f"unknown source {name!r}; known: {', '.join(known)}")
        if not (0 <= w < float("inf")):
            raise ValueError(f"weight of {name!r} must be finite and at least 0")
    return {n: w for n, w in weights.items() if w != 1.0}


def weighted(fused: DataFrame, source: Column, weights: dict[str, float]) -> DataFrame:
    """Scores times the weight of the source; a weight of 0 drops its records."""
    w = F.lit(1.0)
    for name, x in weights.items():
        w = F.when(source == name, F.lit(x)).otherwise(w)
    return fused.withColumn("_w", w).filter("_w > 0").withColumn("score", F.col("score") * F.col("_w")).drop("_w")


def with_prior(fused: DataFrame, cited: Column, strength: float) -> DataFrame:
    """Scores plus strength * ln(citations) where there are any."""
    return fused.withColumn("score", F.col("score") + F.when(cited > 0, F.lit(strength) * F.ln(cited.cast("double"))).otherwise(0.0))


def rerank_blend(placed: DataFrame, scorer: Column, depth: int = 100, k: float = RRF_K) -> DataFrame:
    """A new place for the first depth records, by the sum of reciprocal places before and after the scorer; the tail and all scores stay."""
    w = Window.partitionBy("query_id")
    head = placed.withColumn("_h", F.col("place") <= depth).withColumn("_s", scorer)
    head = head.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_h"), F.desc_nulls_last(F.round("_s", 9)), "place")))
    blend = F.when(F.col("_h"), 1.0 / (k + F.col("place")) + 1.0 / (k + F.col("_r")))
    out = head.withColumn("_b", blend)
    return out.withColumn("final", F.row_number().over(w.orderBy(F.desc("_h"), F.desc_nulls_last(F.round("_b", 9)), "place"))).drop("_h", "_s", "_r", "_b")


def live_merge(channels: dict[str, DataFrame], key: str = "stmt_key", k: float = LIVE_K) -> DataFrame:
    """Rankings of corpus and findings merged by the key of the statement: records that share it are one."""
    parts = [df.select("query_id", key, "doc_id", F.lit(n).alias("channel"), "rank") for n, df in channels.items()]
    best = reduce(DataFrame.unionByName, parts).groupBy("query_id", key, "channel").agg(F.min(F.struct("rank", "doc_id")).alias("m"))
    return best.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("m.rank"))).alias("score"), F.min(F.struct("channel", "m.doc_id")).alias("d")).select("query_id", key, F.col("d.doc_id").alias("doc_id"), "score")
