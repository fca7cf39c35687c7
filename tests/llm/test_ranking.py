import random

import numpy as np

from lemmata.llm import ranking as R


def brute(scores: np.ndarray, damping: float, steps: int = 400) -> np.ndarray:
    """The walk by its transition matrix."""
    n, k = scores.shape
    s = np.where(np.isnan(scores), -np.inf, scores)
    p = np.zeros((n, n))
    for j in range(k):
        for i in range(n):
            above = np.flatnonzero(s[:, j] > s[i, j])
            if len(above):
                p[i, above] += 1 / k / len(above)
            else:
                p[i, i] += 1 / k
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = (1 - damping) / n + damping * x @ p
    return x


def test_prefix_sums_equal_the_matrix():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 12, 4)
        scores = rng.integers(0, 5, (sizes.sum(), 5)).astype(float)
        scores[rng.random(scores.shape) < 0.2] = np.nan
        q = np.repeat(np.arange(4), sizes)
        got = R.rank_walk(q, scores, 0.3, 60)
        for i in range(4):
            assert np.allclose(got[q == i], sizes[i] * brute(scores[q == i], 0.3))


def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id string, channel string, score double, retrieved_at timestamp").selectExpr("*", "1 AS mass", "2 AS s0")


def at(n):
    import datetime as dt

    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def test_latest_retry_counts_and_scales_do_not(spark):
    rows = [(1, "a", "sparse", 900.0, at(1)), (1, "b", "sparse", 1.0, at(1)), (1, "a", "dense", 0.1, at(1)), (1, "b", "dense", 0.9, at(1)), (1, "a", "hamming", 500.0, at(1)), (1, "b", "hamming", 3.0, at(1)), (1, "a", "rerank", 5.0, at(1)), (1, "a", "rerank", -9.0, at(2)), (1, "b", "rerank", -8.0, at(1)), (1, "c", "rerank", float("nan"), at(1)), (1, "d", "sparse", None, at(1))]
    rows += rows[:4] + [(None, "a", "sparse", 1.0, at(1)), (1, None, "sparse", 1.0, at(1)), (1, "e", "other", 1.0, at(1)), (2, "only", "dense", None, None)]
    corpus = spark.createDataFrame([("a", "5"), ("b", "none"), ("b", "7.0"), (None, "1")], "doc_id string, citations string")
    w = R.wide(frame(spark, rows), corpus)
    assert {r["doc_id"] for r in w.collect()} == {"a", "b", "c", "d", "only"}
    top = R.top(R.stationary(w), 3).collect()
    assert [r["doc_id"] for r in sorted(top, key=lambda r: r["place"]) if r["query_id"] == 1] == ["b", "a", "c"]
    assert [r["doc_id"] for r in top if r["query_id"] == 2] == ["only"]
    assert R.top(R.stationary(w.limit(0)), 3).count() == 0


def test_queries_too_large_for_a_task_get_the_same_masses(spark):
    rng = random.Random(1)
    rows = [(q, f"d{i}", c, rng.choice([None, float("nan"), *map(float, range(6))]), at(0)) for q in (1, 2) for i in range(14 if q == 1 else 4) for c in R.CHANNELS]
    w = R.wide(frame(spark, rows), None)
    usual = {(r["query_id"], r["doc_id"]): r["mass"] for r in R.stationary(w, steps=3).collect()}
    hot = {(r["query_id"], r["doc_id"]): r["mass"] for r in R.stationary(w, steps=3, hot=5).collect()}
    assert usual.keys() == hot.keys() and all(abs(usual[k] - hot[k]) < 1e-9 for k in usual)


def test_queries_that_go_over_batches_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "TOGETHER", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(2)
        rows = [(q, f"d{i}", c, rng.random(), at(0)) for q in range(9) for i in range(q + 1) for c in R.CHANNELS]
        w = R.wide(frame(spark, rows), None)
        got = R.stationary(w).collect()
        assert len(got) == sum(range(1, 10))
        for q in range(9):
            mine = [r["mass"] for r in got if r["query_id"] == q]
            assert abs(sum(mine) / len(mine) - 1) < 1e-9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
