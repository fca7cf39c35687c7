"""Problem 7: sources mixed to target shares, small ones repeated up to a cap, large ones sampled.

Method: every document has a hash that never changes. Histograms sum the tokens by source and hash
bucket; the budget of a source falls into one bucket, its threshold. Documents below it are taken, those
above it are not, and only the documents of that bucket are summed again, by the next bits of the hash.
Whatever is left in the boundary after the last level is taken in order of hash and id as long as it
fits. Nothing is sorted but that remainder. Thresholds nest: a larger budget takes a superset.

A source whose budget exceeds its size is taken ``floor(budget / size)`` times whole and once more up to
the threshold of the rest; never more than ``max_repeats`` times.

Defined results
* sources are compared trimmed and in lower case; a null or blank source is in no mix and in no total;
* a source without a target is counted in the total but takes no part; null or negative shares are 0, null repeats 1;
* null or empty texts have size 0; they are taken whenever their hash is below the threshold;
* repeated rows are documents of their own with one hash, so they are taken together;
* empty tables give targets with nothing reached; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.packing import byte_tokens
from lemmata.plans.runtime import bounded_broadcast, materialize

#: Bits of the hash by which each level of histograms splits, and the levels.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 10, 2
#: Targets are a small table by contract.
MAX_TARGETS = 100_000


def source_key(source: Column) -> Column:
    s = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


def document_hash(key: Column) -> Column:
    """HASH_BITS bits that any engine can compute from the id; 0 for a null one."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, src, n, h) of the documents that have a source, written once: the texts are read a single time."""
    base = docs.select(F.col(key).alias("id"), source_key(F.col(source)).alias("src"), byte_tokens(F.col(text)).alias("n"))
    return materialize(base.filter("src IS NOT NULL").withColumn("h", document_hash(F.col("id"))), "mix-sized")


def plan(base: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, source, target_share, max_repeats, size, total, budget, repeats, rest, short) of each target."""
    sums = base.groupBy("src").agg(F.sum("n").alias("size"))
    total = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError("too many targets")
    t = targets.select(
        "source",
        source_key(F.col("source")).alias("src"),
        F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"),
    ).dropDuplicates(["src"])
    t = t.join(sums, "src", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    budget = F.col("target_share") * F.lit(total)
    most = F.col("size") * F.col("max_repeats")
    short = most < budget
    whole = F.when(short | (F.col("size") == 0), F.col("max_repeats")).otherwise(F.floor(budget / F.col("size")))
    t = t.withColumns({"total": F.lit(total), "budget": budget, "short": short, "repeats": whole})
    # what is left of the budget after the whole copies; at max_repeats there is no further copy
    rest = F.when(F.col("short") | (F.col("repeats") >= F.col("max_repeats")), F.lit(0.0)).otherwise(F.col("budget") - F.col("repeats") * F.col("size"))
    return t.withColumn("rest", F.greatest(rest, F.lit(0.0)))


def bucket(level: int) -> Column:
    """The bits of the hash that a level of histograms goes by, from the top."""
    return F.shiftrightunsigned("h", HASH_BITS - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def times(once_more: Column) -> Column:
    return F.least(F.col("repeats") + F.when(once_more, 1).otherwise(0), F.col("max_repeats")).alias("times")


def mix(base: DataFrame, planned: DataFrame) -> DataFrame:
    """(id, src, n, times) of every document used at least once."""
    planned = materialize(planned.filter("src IS NOT NULL").select("src", "repeats", "max_repeats", "rest"), "mix-plan")
    open_, taken = base.join(bounded_broadcast(planned, MAX_TARGETS), "src").withColumnRenamed("rest", "room"), []
    for level in range(LEVELS):
        b = open_.withColumn("b", bucket(level))
        # at most 2 ** LEVEL_BITS rows for each target, whatever the number of documents
        upto = F.sum("s").over(Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        sums = b.groupBy("src", "b").agg(F.sum("n").alias("s"), F.first("room").alias("room0")).withColumn("upto", upto)
        edge = sums.filter("upto > room0").groupBy("src").agg(F.min_by(F.struct(F.col("b").alias("edge"), (F.col("room0") - F.col("upto") + F.col("s")).alias("left")), "b").alias("e"))
        edge = materialize(edge.select("src", "e.edge", "e.left"), "mix-edge")
        b = b.join(bounded_broadcast(edge, MAX_TARGETS), "src", "left")
        taken.append(b.filter("edge IS NULL OR b <> edge").select("id", "src", "n", times(F.col("edge").isNull() | (F.col("b") < F.col("edge")))))
        open_ = b.filter("b = edge").select("id", "src", "n", "h", "repeats", "max_repeats", F.col("left").alias("room"))
        if level == 0:
            open_ = materialize(open_, "mix-open")
    # one bucket in 2 ** (LEVEL_BITS * LEVELS) of a source's documents
    upto = F.sum("n").over(Window.partitionBy("src").orderBy("h", F.asc_nulls_first("id"), "n").rowsBetween(Window.unboundedPreceding, 0))
    last = open_.withColumn("upto", upto).select("id", "src", "n", times(F.col("upto") <= F.col("room")))
    out = last
    for t in taken:
        out = out.unionByName(t)
    return out.filter("times > 0")


def report(base: DataFrame, targets: DataFrame) -> DataFrame:
    """The repeats and shares really reached by each target."""
    planned = plan(base, targets)
    got = mix(base, planned).groupBy("src").agg(F.count("*").alias("documents"), F.sum(F.col("n") * F.col("times")).alias("tokens"))
    all_ = F.sum("tokens").over(Window.partitionBy())  # over the targets, a small table
    out = planned.join(got, "src", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    return out.select("source", "target_share", "max_repeats", F.col("size").alias("source_tokens"), "repeats", "documents", "tokens", F.coalesce(F.try_divide("tokens", all_), F.lit(0.0)).alias("reached_share"), "short")
