"""Problem 2: one ranking of a query's candidates from scores of different scale and direction.

Method: a walk over the candidates. From a candidate, pick one of the scores with equal chance and jump
to one of the candidates that stand strictly higher by it, each with equal chance; stay if there is none.
With chance 1 - ``DAMPING`` jump anywhere instead: a walk
that seldom starts anew is absorbed by candidates that lead a single score, one that often does counts
every score alike. Candidates are ordered by how often the walk is there.
Only standing counts, so no score dominates by its size. Power iteration needs no transition matrix: a
candidate of a later tie group adds mass / (number of candidates above it) to every candidate above it,
so one step is a suffix sum over each score's order.

Queries with up to ``HOT_CANDIDATES`` candidates are laid side by side in arrays and iterated together in
a task. Larger ones, which may hold a third of all rows, are iterated as DataFrames: mass is summed by
(query, score, tie group), the sums go through two levels of windows (bins of groups, then within a bin),
and no task ever holds a query.

Defined results
* of repeated (query, candidate, channel) rows the latest counts; at one time, the greater score;
* a missing, null or NaN score, or missing citations, stands behind all others, tied;
* equal scores tie: neither is above the other; final ties go to the smaller id by code point;
* rows with a null query or candidate are ignored; unknown channels are ignored;
* an empty table gives an empty ranking; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.llm.capping import citations
from lemmata.plans.runtime import materialize, partitions_of

#: Channels and whether a higher score is better.
CHANNELS = {"sparse": True, "dense": True, "hamming": False, "rerank": True}
DAMPING, STEPS = 0.3, 24
#: Candidates of one query that a task may hold at a time (about 100 bytes each).
HOT_CANDIDATES = 500_000
#: Rows that a task iterates together, at least.
TOGETHER = 50_000


def wide(candidates: DataFrame, corpus: DataFrame | None, channels: dict[str, bool] | None = None) -> DataFrame:
    """(query_id, doc_id, s0..): one row a candidate, every score turned so that higher is better, null if missing."""
    channels = CHANNELS if channels is None else channels
    c = candidates.filter(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull() & F.col("channel").isin(list(channels)))
    c = c.select("query_id", "doc_id", "channel", F.struct("retrieved_at", F.when(~F.isnan("score"), F.col("score")).alias("score")).alias("v"))
    latest = [F.max(F.when(F.col("channel") == name, F.col("v"))).alias(f"v{i}") for i, name in enumerate(channels)]
    w = c.groupBy("query_id", "doc_id").agg(*latest)
    scores = [((F.col(f"v{i}.score") if up else -F.col(f"v{i}.score")) + F.lit(0.0)).alias(f"s{i}") for i, up in enumerate(channels.values())]
    if corpus is None:
        return w.select("query_id", "doc_id", *scores)
    cited = corpus.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(citations(F.col("citations"))).cast("double").alias("c"))
    return w.join(cited, "doc_id", "left").select("query_id", "doc_id", *scores, F.col("c").alias(f"s{len(channels)}"))


def rank_walk(query: np.ndarray, scores: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Stationary mass of every row, times the candidates of its query (1 is the mean); query: sorted integers, one run of equal values a query; scores: rows x scores, NaN if missing."""
    n, k = scores.shape
    if not n:
        return np.zeros(0)
    first = np.r_[True, query[1:] != query[:-1]]
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, n])
    run = np.repeat(np.arange(len(start)), size)
    begin, end = start[run], (start + size)[run]
    plans = []
    for j in range(k):
        s = np.where(np.isnan(scores[:, j]), -np.inf, scores[:, j])
        order = np.lexsort((-s, run))
        v = s[order]
        new = first | np.r_[True, v[1:] != v[:-1]]
        group = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        above = group[at] - begin  # by position: how many stand strictly higher
        after = np.r_[group[1:], n][at]  # where the next tie group begins
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        plans.append((order, np.where(above, 1.0 / np.maximum(above, 1), 0.0), above == 0, after, end, back))
    x = 1.0 / size[run]
    base = (1 - damping) / size[run]
    for _ in range(steps):
        total = np.zeros(n)
        for order, share, top, after, stop, back in plans:
            m = x[order]
            sums = np.r_[0.0, np.cumsum(m * share)]
            total += (sums[stop] - sums[after] + np.where(top, m, 0.0))[back]
        x = base + damping / k * total
    return x * size[run]


def _together(columns: list[str], damping: float, steps: int):
    def solve(t: pa.Table) -> pa.RecordBatch:
        codes = t["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        s = np.column_stack([t[c].to_numpy(zero_copy_only=False).astype(float) for c in columns])
        x = rank_walk(codes, s, damping, steps)
        return pa.RecordBatch.from_arrays([t["query_id"].combine_chunks(), t["doc_id"].combine_chunks(), pa.array(x)], names=["query_id", "doc_id", "mass"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= TOGETHER:  # solve all queries but the last, which may go on in the next batch
                t = pa.Table.from_batches(held)
                q = t["query_id"].combine_chunks()
                same = pa.compute.equal(q, q[-1]).to_numpy(zero_copy_only=False)
                cut = len(same) - int(same.sum())
                if cut:
                    yield solve(t.slice(0, cut))
                    held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def _walk_apart(hot: DataFrame, columns: list[str], damping: float, steps: int, bins: int = 256) -> DataFrame:
    """The same walk for queries too large for a task: every step is two shuffles of (candidate, score) rows."""
    k = len(columns)
    long = hot.select("query_id", "doc_id", F.posexplode(F.array(*[F.coalesce(F.col(c), F.lit(float("-inf"))) for c in columns])).alias("j", "s"))
    # the place of each tie group: values are few or many, so they go through bins as well
    values = materialize(long.groupBy("query_id", "j", "s").agg(F.count("*").alias("m")), "walk-values")
    n = partitions_of(hot.sparkSession)
    ranged = values.repartitionByRange(max(n, 2), "query_id", "j", F.desc("s")).withColumn("task", F.spark_partition_id())
    ranged = materialize(ranged, "walk-ranged")
    task = Window.partitionBy("query_id", "j").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("query_id", "j", "task").agg(F.sum("m").alias("t")).select("query_id", "j", "task", F.coalesce(F.sum("t").over(task), F.lit(0)).alias("o"))
    inside = Window.partitionBy("query_id", "j", "task").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    place = ranged.withColumn("above", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(before, ["query_id", "j", "task"])
    place = materialize(place.select("query_id", "j", "s", (F.col("above") + F.col("o")).alias("above"), F.col("task").alias("bin")), "walk-place")
    spots = materialize(long.join(place, ["query_id", "j", "s"]).select("query_id", "doc_id", "j", "above", "bin"), "walk-spots")
    sizes = hot.groupBy("query_id").agg(F.count("*").alias("size"))
    start = materialize(hot.select("query_id", "doc_id").join(sizes, "query_id"), "walk-start")
    x = start.withColumn("mass", F.lit(1.0) / F.col("size"))
    for _ in range(steps):
        mass = spots.join(x.select("query_id", "doc_id", "mass"), ["query_id", "doc_id"])
        out = F.when(F.col("above") > 0, F.col("mass") / F.col("above")).otherwise(F.lit(0.0))
        groups = materialize(mass.groupBy("query_id", "j", "bin", "above").agg(F.sum(out).alias("w")), "walk-groups")
        later = Window.partitionBy("query_id", "j").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        tail = groups.groupBy("query_id", "j", "bin").agg(F.sum("w").alias("t")).select("query_id", "j", "bin", F.coalesce(F.sum("t").over(later), F.lit(0.0)).alias("o"))
        below = Window.partitionBy("query_id", "j", "bin").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
        got = groups.withColumn("g", F.coalesce(F.sum("w").over(below), F.lit(0.0))).join(tail, ["query_id", "j", "bin"])
        got = got.select("query_id", "j", "above", (F.col("g") + F.col("o")).alias("g"))
        step = mass.join(got, ["query_id", "j", "above"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("g") + F.when(F.col("above") == 0, F.col("mass")).otherwise(0.0)).alias("t"))
        x = materialize(start.join(step, ["query_id", "doc_id"]).select("query_id", "doc_id", "size", (F.lit(1 - damping) / F.col("size") + F.lit(damping / k) * F.col("t")).alias("mass")), "walk-mass")
    return x.select("query_id", "doc_id", (F.col("mass") * F.col("size")).alias("mass"))


def stationary(table: DataFrame, damping: float = DAMPING, steps: int = STEPS, hot: int = HOT_CANDIDATES) -> DataFrame:
    """(query_id, doc_id, mass) of a table as wide() gives it; masses are relative to the mean of the query, whatever its size."""
    columns = [c for c in table.columns if c not in ("query_id", "doc_id")]
    table = materialize(table, "walk-table")
    sizes = table.groupBy("query_id").agg(F.count("*").alias("size"))
    large = materialize(sizes.filter(F.col("size") > hot).select("query_id"), "walk-large")
    few = large.count()  # at most rows / hot
    kinds = dict(table.dtypes)
    schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, mass double"
    usual = table if not few else table.join(large, "query_id", "left_anti")
    usual = usual.repartition(partitions_of(table.sparkSession), "query_id").sortWithinPartitions("query_id")
    out = usual.mapInArrow(_together(columns, damping, steps), schema)
    return out if not few else out.unionByName(_walk_apart(table.join(large, "query_id", "left_semi"), columns, damping, steps))


def combined_order() -> list[Column]:
    """By mass (relative to the mean), rounded so that sums made in another order do not part ties, then by id."""
    return [F.desc(F.round("mass", 9)), F.asc("doc_id")]


def top(table: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, place) of the first k of each query, k being the feature; partial top-k lists are merged."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*combined_order()))
    return table.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "doc_id", "place")
