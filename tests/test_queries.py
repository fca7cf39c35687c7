"""Every core query against its SQL on the small tables; those without SQL must have rows of a stable schema."""

import pytest

from lemmata.plans import catalogue
from tests.oracle import compare

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in SQL:
        assert compare(spark, sf, QUERIES[name], SQL[name]) == ""
    else:
        df = QUERIES[name](spark, sf)
        assert df.columns == QUERIES[name](spark, sf).columns and df.limit(1).count() == 1


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).limit(1).count() == 1


def test_binary_recall(spark, sf):
    recall = {r["search"]: r["recall"] for r in QUERIES["binary_recall"](spark, sf).collect()}
    assert recall["binary_rescore_full"] >= 0.9 and recall["binary_rescore_full"] > recall["binary_rescore"]


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    """Tables in which queries do have their papers among the records, and code has holes: in the given ones none have."""
    folder = str(tmp_path_factory.mktemp("linked"))
    queries = [
        (1, "q one", "https://a.example/abs/1305.12345v2", None, "Theorem 2.1"),
        (2, "q two", None, "On  Rings, and Fields!", "Lemma 3"),
        (3, "q three", "https://a.example/abs/math/0301001", "none of these", "4.5.6"),
        (4, "q four", None, None, "7"),
        (5, "q five", "https://a.example/abs/9999.99999", "", None),
    ]
    corpus = [
        ("d1", "thm:2.1", "see http://b.example/1305.12345", "Other title", "theorem t : True := by sorry"),
        ("d2", "thm:2.2", "http://b.example/1305.12345v1", "On rings and fields", "-- sorry\ntrivial"),
        ("d3", "lem-3-x", None, "ON RINGS, and fields", "/- admit -/ exact admits"),
        ("d4", None, "http://b.example/math/0301001", None, "by admit"),
        ("d5", "eq:4.5.6", "math/0301001", "", None),
        ("d6", "x", "nothing", "", "sorry, no"),
    ]
    spark.createDataFrame(queries, "query_id long, query string, paper_link string, paper_title string, theorem_number string").write.parquet(f"{folder}/queries.parquet")
    spark.createDataFrame(corpus, "doc_id string, label string, source string, title string, statement string").write.parquet(f"{folder}/corpus.parquet")
    return folder


@pytest.mark.parametrize("name, rows", [("ground_truth", 6), ("reachable_queries", 3), ("label_number_join", 3), ("hole_scan", 3)])
def test_queries_whose_truth_is_empty_in_the_given_tables(spark, linked, name, rows):
    assert compare(spark, linked, QUERIES[name], SQL[name]) == ""
    assert QUERIES[name](spark, linked).count() == rows


def test_hits_over_a_truth_that_is_not_empty(spark, linked):
    from lemmata.operators import evaluate

    truth = QUERIES["ground_truth"](spark, linked)
    ranked = truth.selectExpr("'m' AS mode", "query_id", "doc_id", "CAST(query_id AS INT) AS rank")
    got = evaluate.metrics(evaluate.first_hits(ranked, truth, ("mode",)), ("mode",)).first()
    assert got["mode"] == "m" and got["queries"] == 3
