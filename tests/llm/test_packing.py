import random
from collections import defaultdict

import numpy as np
import pytest

from lemmata.llm import packing as P


def brute_best_fit(sizes, capacity):
    left = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        if fits:
            left[min(fits)[1]] -= s
        else:
            left.append(capacity - s)
    return len(left)


@pytest.mark.parametrize("seed", range(8))
def test_segment_tree_packs_like_a_plain_search(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100, 1000])
    sizes = np.array([rng.randint(0, capacity) for _ in range(300)])
    placed, used = P.best_fit_decreasing(sizes, capacity)
    assert used == brute_best_fit(sizes.tolist(), capacity)
    assert np.bincount(placed, sizes, used).max(initial=0) <= capacity


@pytest.mark.parametrize("seed", range(8))
def test_a_tree_over_ranges_of_room_packs_the_same(seed, monkeypatch):
    rng = random.Random(seed)
    capacity = rng.choice([200, 1000, 99_999])
    sizes = np.array([rng.randint(0, capacity) for _ in range(300)])
    want, used = P.best_fit_decreasing(sizes, capacity)
    monkeypatch.setattr(P.TightestBin, "LEAVES", 8)
    got, again = P.best_fit_decreasing(sizes, capacity)
    assert again == used == brute_best_fit(sizes.tolist(), capacity) and (got == want).all()


def test_a_huge_capacity_needs_no_huge_tree():
    assert len(P.TightestBin(1 << 60).count) <= 1 << 18
    assert P.best_fit_decreasing(np.array([1 << 59, 1 << 59, 5]), 1 << 60)[1] == 2


def test_operator(spark):
    rng = random.Random(9)
    rows = [(i, "ä" * rng.randint(0, 60)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "x" * 100), (1003, "x" * 101), (1004, "x" * 250), (None, "null"), (1004, "x" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS block")
    limits = spark.createDataFrame([("c", 100), ("d", 10_000), ("e", 0), (None, 64)], "container string, capacity_tokens int")
    out = P.pack(df, limits, block_rows=100).collect()
    for name, capacity in (("c", 100), ("d", 10_000), (None, 64)):
        mine = [r for r in out if r["container"] == name]
        fill, whole = defaultdict(int), defaultdict(int)
        for r in mine:
            fill[r["block"], r["bin_no"]] += r["tokens"]
            whole[r["doc_id"]] += r["tokens"]
        assert max(fill.values()) <= capacity and sum(fill.values()) == sum(len((t or "").encode()) for _, t in rows)
        assert {r["doc_id"] for r in mine} == {d for d, _ in rows} and whole[1004] == 500
        assert {r["doc_id"] for r in mine if r["is_split"]} == {d for d, t in rows if len((t or "").encode()) > capacity}
    pieces = sorted((r["piece"], r["start"], r["tokens"]) for r in out if r["container"] == "c" and r["doc_id"] == 1003)
    assert pieces == [(0, 0, 100), (1, 100, 1)]
    assert P.pack(df.limit(0), limits).count() == 0 and P.pack(df, limits.limit(0)).count() == 0
