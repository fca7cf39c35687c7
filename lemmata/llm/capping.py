"""Problem 5: at most a share of the records from any one contributor, the most cited kept.

Method: mergeable histograms of quality per contributor; the bin in which a contributor's cap is used
up is its cutoff. Bins above it are kept and bins below it dropped by a filter; only the records of the
cutoff bin are ranked. They are ranked by a range sort over all tasks (task-local row numbers plus the
counts of the tasks before), so that a contributor with a third of all rows, or a cutoff bin full of
ties, never meets one task.

Defined results
* null or blank source, or one with nothing before the first ``/``: no contributor, always kept;
* unreadable, negative, non-finite or null citations: missing, behind every number;
* equal citations: the smaller id by code point is kept (a null id counts as the smallest);
* repeated rows count and are ranked one by one; which of equal rows is dropped is immaterial;
* an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.plans.runtime import bounded_broadcast, materialize, partitions_of

#: Bins per doubling of the citations; small counts have a bin each.
BINS_PER_DOUBLING = 8


def contributor(source: Column) -> Column:
    """The host, or the first part of the path, that stands for who contributed a record; null if none."""
    s = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"^https?://", "")
    s = F.regexp_extract(s, r"(?s)^([^/?#]*)", 1)
    s = F.regexp_replace(F.regexp_replace(s, r":[0-9]*$", ""), r"^www\.", "")
    return F.when(F.trim(s) != "", s)


def citations(text: Column) -> Column:
    """Text as collected, read as a number and cut to an integer; null if missing."""
    t = F.regexp_replace(text.cast("string"), r"(?U)^\s+|\s+$", "")
    x = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t).try_cast("double")
    return F.when((x >= 0) & (x < float("inf")), x.try_cast("bigint"))


def quality_bin(quality: Column) -> Column:
    """A bin that rises with the quality: -1 for missing, else about BINS_PER_DOUBLING for each doubling."""
    q = quality.cast("double")
    return F.when(quality.isNull(), F.lit(-1)).otherwise(F.floor(F.log2(q + 1) * BINS_PER_DOUBLING).cast("int"))


def cap_contributors(
    df: DataFrame, share: float | None = None, count: int | None = None, key: str = "doc_id", source: str = "source", quality: str = "citations"
) -> DataFrame:
    """Every row's (key, contributor, citations, kept).

    The cap is ``floor(share * rows)``, or ``count``, or the smaller of both.
    """
    if share is None and count is None or share is not None and not 0 <= share <= 1 or count is not None and count < 0:
        raise ValueError("a share from 0 to 1 or a count of at least 0 is needed")
    base = df.select(F.col(key).alias("id"), contributor(F.col(source)).alias("who"), citations(F.col(quality)).alias("q"))
    base = base.withColumn("bin", quality_bin(F.col("q")))
    # sources and citations are read once; the three passes below read four narrow columns
    base = materialize(base, "cap-base")
    histogram = materialize(base.groupBy("who", "bin").agg(F.count("*").alias("n")), "cap-histogram")
    rows = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cap = min([c for c in (None if share is None else int(share * rows + 1e-9), count) if c is not None])

    down = Window.partitionBy("who").orderBy(F.desc("bin"))
    upto = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    cutoff = (
        histogram.filter("who IS NOT NULL")
        .withColumn("upto", upto)
        .filter((F.col("upto") > cap) & (F.col("upto") - F.col("n") <= cap))
        .select("who", F.col("bin").alias("cut"), (F.lit(cap) - F.col("upto") + F.col("n")).alias("room"))
    )
    # a contributor has a cutoff only if it has more than cap rows, so there are fewer than rows / cap
    bound = rows // (cap + 1)
    marked = base.join(bounded_broadcast(cutoff, bound), "who", "left")
    clear = marked.filter("cut IS NULL OR bin <> cut").select("id", "who", "q", (F.col("cut").isNull() | (F.col("bin") > F.col("cut"))).alias("kept"))

    order = [F.desc_nulls_last("q"), F.asc_nulls_first("id")]
    n = partitions_of(df.sparkSession)
    edge = marked.filter("bin = cut").select("id", "who", "q", "room").repartitionByRange(n, F.col("who"), *order)
    edge = materialize(edge.withColumn("task", F.spark_partition_id()), "cap-edge")
    before = Window.partitionBy("who").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edge.groupBy("who", "task").agg(F.count("*").alias("n"))
    offsets = offsets.select("who", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("who", "task").orderBy(*order)) + F.col("offset")
    ranked = edge.join(bounded_broadcast(offsets, bound * n), ["who", "task"]).select("id", "who", "q", (rank <= F.col("room")).alias("kept"))
    return clear.unionByName(ranked).select(F.col("id").alias(key), F.col("who").alias("contributor"), F.col("q").alias("citations"), "kept")
