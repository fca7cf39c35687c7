import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lemmata.llm import capping as C


@pytest.mark.parametrize(
    "source, want",
    [("  https://WWW.A.example:80/x", "a.example"), ("http://a.example?q", "a.example"), ("data-set/part-1", "data-set"), ("", None), (" \t", None), (None, None), ("https:///x", None), ("a.example#f", "a.example")],
)
def test_contributor(spark, source, want):
    assert spark.createDataFrame([(source,)], "s string").select(C.contributor(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("3.0", 3), (" 7 ", 7), ("1e2", 100), ("-1", None), ("-0.5", None), ("nan", None), ("None", None), ("inf", None), ("1d", None), ("", None), (None, None), ("9" * 400, None), ("2.9", 2)])
def test_citations(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(C.citations(F.col("s"))).first()[0] == want


def brute(rows, cap):
    by = defaultdict(list)
    for d, s, c in rows:
        if s and s.strip():
            by[s.strip().lower()].append((-(float(c) if c and c.isdigit() else -1), d))
    return sorted(d for v in by.values() for _, d in sorted(v)[cap:])


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_with_ties_and_a_dominant_contributor(spark, seed):
    rng = random.Random(seed)
    rows = [(f"d{i:04d}", rng.choice(["big", "BIG ", "big", "a", "b", "c", None, ""]), rng.choice(["0", "0", "1", "5", "17", "400", "none", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id string, source string, citations string").repartition(7).selectExpr("*", "1 AS id", "2 AS who", "3 AS bin", "4 AS kept")
    for share, count in ((0.02, None), (0.2, None), (None, 3), (None, 0), (0.5, 60)):
        cap = min(x for x in (None if share is None else int(share * 500), count) if x is not None)
        out = C.cap_contributors(df, share, count).collect()
        assert len(out) == 500
        assert sorted(r["doc_id"] for r in out if not r["kept"]) == brute(rows, cap)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([("a", "s", "1")] * 10 + [(None, "s", "1")], "doc_id string, source string, citations string")
    assert C.cap_contributors(df, count=4).filter("kept").count() == 4
    assert C.cap_contributors(df.limit(0), share=0.02).count() == 0
    with pytest.raises(ValueError):
        C.cap_contributors(df)
