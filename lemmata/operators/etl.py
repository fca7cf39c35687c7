"""Corpus assembly: joins of the source tables, deduplication, splits, counts and quality scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import columns as C


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the given order (W2). Equal rows are interchangeable."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def least_per_key(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys and the value of the first row by order, with map-side aggregation: no sort of a hot key."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, value)).getField(value).alias(value))


def first_slogan(slogans: DataFrame, model: str) -> DataFrame:
    """One slogan of the model per theorem: the least, as rows have no stored order."""
    return slogans.filter(F.col("model") == model).groupBy("theorem_id").agg(F.min("slogan").alias("model_slogan"))


def latest_paper(papers: DataFrame) -> DataFrame:
    """The last harvest of every paper."""
    value = F.struct("harvested_at", "title", "link", "citations", "primary_category")
    return papers.groupBy("paper_id").agg(F.max(value).alias("p")).select("paper_id", "p.title", "p.link", "p.citations", "p.primary_category")


def assemble(corpus: DataFrame, slogans: DataFrame, papers: DataFrame, model: str) -> DataFrame:
    """The documents: statements with the model's slogan (else the trimmed body) and what is known of their paper."""
    p = latest_paper(papers).select("paper_id", F.col("title").alias("p_title"), F.col("link").alias("p_link"), F.col("citations").alias("p_cited"), F.col("primary_category").alias("p_cat"))
    s = first_slogan(slogans, model).withColumnRenamed("theorem_id", "doc_id")
    t = corpus.select("doc_id", "name", "statement", "source", "label", "paper_id").join(s, "doc_id", "left").join(p, "paper_id", "left")
    return t.select(
        "doc_id",
        F.coalesce(C.filled(F.col("model_slogan")), C.strip(F.col("statement"))).alias("slogan"),
        "statement",
        "name",
        F.coalesce("source", "p_link").alias("source"),
        F.col("p_title").alias("title"),
        "label",
        F.coalesce(C.citation_count(F.col("p_cited")), F.lit(-1)).alias("citations"),
        C.optional(F.col("p_cat")).alias("category"),
    )


def dedup_within(df: DataFrame, text: str = "statement", key: str = "doc_id") -> DataFrame:
    """The least id of every distinct normal text (U2), by a hash and with map-side aggregation."""
    return df.groupBy(F.md5(C.normal_text(F.col(text))).alias("h")).agg(F.min(key).alias(key)).select(key)


def dedup_against(df: DataFrame, base: DataFrame, text: str = "statement") -> DataFrame:
    """Rows whose normal text is not in base."""
    h = F.md5(C.normal_text(F.col(text)))
    return df.withColumn("_h", h).join(base.select(h.alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def dedup_in_group(df: DataFrame, group: str, text: str = "statement", order: str = "row_id") -> DataFrame:
    """The first of equal texts within a group (W3); a group need not be contiguous."""
    return first_per_key(df.withColumn("_h", F.md5(C.normal_text(F.col(text)))), [group, "_h"], [F.col(order)]).drop("_h")


def forced_scan(df: DataFrame, always: DataFrame, key: str, limit: int, order: str = "row_id") -> DataFrame:
    """Every row whose key is in always, and the first limit of the others."""
    known = always.select(key).distinct()
    return df.join(known, key, "left_semi").unionByName(df.join(known, key, "left_anti").orderBy(order).limit(limit))


def quality_scan(df: DataFrame) -> DataFrame:
    """One row of counts over a corpus (G9), in one pass; the places of the median and the 90 % are those of a sorted list."""
    n = F.length("statement")
    counts = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("empty"),
        F.count_if(n < 30).alias("short"),
        F.count_if(F.coalesce(F.length("slogan"), F.lit(0)) == 0).alias("no_slogan"),
        F.count_if(F.col("doc_id").rlike(r"^[0-9]{4}\.[0-9]{4,5}")).alias("arxiv_like"),
        F.count_if(F.col("statement").contains("\\")).alias("latex"),
    )
    sizes = df.filter(n.isNotNull()).groupBy(n.alias("len")).count()  # one row per length, not per record
    upto = F.sum("count").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    cum = sizes.withColumn("upto", upto).withColumn("all", F.sum("count").over(Window.partitionBy()))
    places = cum.agg(
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("len"))).alias("median_len"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") * 0.9), F.col("len"))).alias("p90_len"),
    )
    return counts.join(places)  # one row by one row


def split_counts(df: DataFrame) -> DataFrame:
    """Records by bucket and split, with totals by split."""
    t = df.select(C.bucket(F.col("doc_id")).alias("bucket"), C.split_of(F.col("doc_id")).alias("split"))
    return t.rollup("split", "bucket").agg(F.count("*").alias("n")).filter("split IS NOT NULL").select(F.coalesce("bucket", F.lit("ALL")).alias("bucket"), "split", "n")


def elites(events: DataFrame) -> DataFrame:
    """The best of every cell, the earliest of equals."""
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", (-F.col("event_id")).alias("e")))
    return events.filter("value IS NOT NULL").groupBy(F.col("event_type").alias("cell")).agg(best.alias("b")).select("cell", "b.event_id", "b.value")


def worst_verdict(df: DataFrame, group: str, applies: str, confidence: str) -> DataFrame:
    """The least confident rejection if there is one, else the most confident approval."""
    no = ~F.col(applies)
    return df.groupBy(group).agg(
        F.bool_and(applies).alias("applies"),
        F.coalesce(F.min(F.when(no, F.col(confidence))), F.max(F.col(confidence))).alias("confidence"),
    )


def few_shot(elite: DataFrame, texts: DataFrame, k: int = 3) -> DataFrame:
    """One row: the k best elites as examples, best last, for a generator to go on from (D6); k is the feature."""
    top = elite.orderBy(F.desc("value"), "cell").limit(k).join(texts, "event_id")
    line = F.concat(F.lit("# score "), F.round("value", 4).cast("string"), F.lit("\n"), F.col("text"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "cell", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("examples"))
