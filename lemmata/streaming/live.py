"""The live corpus: validated findings in a landing folder, read by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.sources.readers import FINDING


def validated(findings: DataFrame, dims: int | None = None) -> DataFrame:
    """Findings that may be kept: statement and source not blank, a vector of the right size if there is one; the slogan defaults to the statement (L1)."""
    ok = (F.trim("statement") != "") & (F.trim("source") != "")
    if dims is not None:
        ok &= F.col("dense_vec").isNull() | (F.size("dense_vec") == dims)
    out = findings.filter(ok).withColumn("slogan", F.coalesce(F.nullif(F.trim("slogan"), F.lit("")), F.col("statement")))
    return out.withColumn("dense", F.col("dense_vec").isNotNull())


def land(findings: DataFrame, folder: str, dims: int | None = None) -> int:
    """Append valid findings to the landing folder; how many were refused. Nothing of a refused one is written."""
    good = validated(findings, dims)
    good.write.mode("append").json(folder)
    return findings.count() - good.count()


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str, files: int = 100) -> None:
    """Take what is new in the landing folder into the table, once, and stop (L5): the checkpoint knows what was taken."""
    stream = spark.readStream.schema(FINDING).option("maxFilesPerTrigger", files).json(landing)
    q = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_each(spark: SparkSession, landing: str, checkpoint: str, use: Callable[[DataFrame, int], None]) -> None:
    """The same, with a function of each batch: for postings and the like (L2)."""
    stream = spark.readStream.schema(FINDING).json(landing)
    stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot(spark: SparkSession, table: str) -> DataFrame:
    """The findings as they stand: the last version of each id."""
    t = spark.read.parquet(table)
    last = t.groupBy("doc_id").agg(F.max(F.struct("added_ts", "statement", "slogan", "source", "name", "dense_vec")).alias("v"))
    return last.select("doc_id", "v.*")


def reindex(findings: DataFrame, embed: Callable) -> DataFrame:
    """Vectors for the findings that lack one; others stay, so a second run changes nothing (L4)."""
    return findings.withColumn("dense_vec", F.coalesce("dense_vec", embed(F.col("statement")))).withColumn("dense", F.col("dense_vec").isNotNull())


def cached(cache: DataFrame, now: float, ttl: float = 7 * 86400, newest: int = 200) -> DataFrame:
    """Answers not older than ttl, the newest ones only (L6): a cache's size is its feature."""
    age = F.lit(now) - F.col("added_ts")
    return cache.filter((age >= 0) & (age <= ttl)).orderBy(F.desc("added_ts"), "key").limit(newest)


def event_stream_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of time, under a watermark: the same plan for streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
