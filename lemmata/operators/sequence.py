"""Integer sequences: an n-gram index and exact contiguous matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NGRAM = 4


def windows(sequences: DataFrame, n: int = NGRAM) -> DataFrame:
    """(a_number, pos, gram) of every run of n terms (W7). Terms are canonical decimal strings: they may be of any size."""
    t = sequences.filter(F.size("terms") >= n)
    t = t.select("a_number", "terms", F.explode(F.sequence(F.lit(0), F.size("terms") - n)).alias("pos"))
    return t.select("a_number", "pos", F.array_join(F.slice("terms", F.col("pos") + 1, n), ",").alias("gram"))


def match(queries: DataFrame, sequences: DataFrame, max_results: int = 5, n: int = NGRAM) -> DataFrame:
    """(query_id, a_number, offset, exact_prefix, place): sequences that hold the query as a contiguous run, least number first (V1).

    The first n terms of the query find candidates in the index; the whole run is then compared. A query with fewer
    than n terms matches nothing.
    """
    q = queries.filter(F.size("terms") >= n).select("query_id", F.array_join("terms", ",").alias("run"), F.size("terms").alias("m"), F.array_join(F.slice("terms", 1, n), ",").alias("gram"))
    hits = windows(sequences, n).join(q, "gram").join(sequences, "a_number")
    hits = hits.filter(F.array_join(F.slice("terms", F.col("pos") + 1, F.col("m")), ",") == F.col("run"))
    first = hits.groupBy("query_id", "a_number").agg(F.min("pos").alias("offset"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("a_number"))
    return first.withColumn("place", place).filter(F.col("place") <= max_results).select("query_id", "a_number", "offset", (F.col("offset") == 0).alias("exact_prefix"), "place")
