import json

import pytest

from lemmata.operators import applied as A


def test_verdicts_reject_what_cannot_be_read(spark):
    replies = [
        ("a", 'Sure: ```json\n{"applies": true, "confidence": 0.9, "conditions": [{"text": "n > 0", "satisfied": true, "evidence": "given"}]}\n```'),
        ("b", '{"applies": true, "need_met_by_guarantee": false, "confidence": 0.8, "failure": "weaker"}'),
        ("c", '{"applies": false, "confidence": 0.7, "failure": "", "conditions": [{"text": "compact", "satisfied": false}, {"text": "x"}]}'),
        ("d", "no idea"),
        ("e", None),
    ]
    got = {r["id"]: r for r in A.verdicts(spark.createDataFrame(replies, "id string, reply string")).collect()}
    assert got["a"]["applies"] and got["a"]["confidence"] == 0.9 and got["a"]["unmet"] == 0 and got["a"]["conditions"][0]["evidence"] == "given"
    assert not got["b"]["applies"] and got["b"]["failure"] == "weaker"
    assert not got["c"]["applies"] and got["c"]["failure"] is None and got["c"]["unmet"] == 1
    assert all(not got[i]["applies"] and got[i]["confidence"] == 0 and "rejected" in got[i]["note"] for i in "de")


def test_solved_puts_verified_results_first_and_takes_the_worst_pass(spark):
    results = spark.createDataFrame([(1, "a", True, 0.9), (1, "b", True, 0.6), (1, "c", True, 0.3), (1, "d", False, 0.9), (1, "e", True, 0.7)], "query_id long, doc_id string, applies boolean, confidence double")
    yes, no = '{"applies": true, "confidence": %s}', '{"applies": false, "confidence": %s}'
    replies = spark.createDataFrame([(1, "b", yes % 0.8), (1, "e", yes % 0.9), (1, "e", no % 0.4)], "query_id long, doc_id string, reply string")
    got = [(r["doc_id"], r["verified"], r["confidence"]) for r in A.solved(results, replies).orderBy("place").collect()]
    assert got == [("b", True, 0.8), ("a", False, 0.9), ("e", False, 0.4)]


def test_formal_payloads(spark):
    loogle = {"count": 2, "hits": [{"name": "Nat.add_comm", "type": "a + b = b + a", "module": "Mathlib.Algebra.Group", "doc": "d"}, {"name": None, "type": "t", "module": None}], "error": None, "header": "h"}
    lean = [[{"result": {"module_name": ["Mathlib", "Data"], "kind": "theorem", "name": ["Nat", "add_comm"], "type": "x", "docstring": "s"}, "distance": 0.1}, {"result": {"module_name": ["Mathlib"], "name": ["a'"], "kind": "def"}, "distance": 0.2}]]
    rows = [("q", "loogle", json.dumps(loogle)), ("q", "leansearch", json.dumps(lean)), ("r", "loogle", None), ("s", "leansearch", "<html>"), ("t", "loogle", json.dumps({"error": "parse error"}))]
    hits = A.formal_hits(spark.createDataFrame(rows, "query string, service string, payload string"))
    got = {(r["query"], r["service"]): r for r in hits.collect()}
    assert got["q", "loogle"]["hits"][0]["url"] == A.DOCS_URL + "Mathlib/Algebra/Group.html#Nat.add_comm" and got["q", "loogle"]["hits"][1]["url"] is None
    assert got["q", "leansearch"]["hits"][1]["url"].endswith("Mathlib.html#a%27") and got["q", "leansearch"]["hits"][0]["kind"] == "theorem"
    assert not got["r", "loogle"]["available"] and not got["s", "leansearch"]["available"] and got["r", "loogle"]["hits"] == []
    assert got["t", "loogle"]["available"] and got["t", "loogle"]["error"] == "parse error"
    merged = A.formal_merged(hits, 5).filter("query = 'q'").orderBy("place").collect()
    assert [(r["name"], r["source"]) for r in merged] == [("Nat.add_comm", "loogle"), (None, "loogle"), ("a'", "leansearch")]


class ByLength:
    def score(self, pairs):
        return pairs.selectExpr("query_id", "doc_id", "CAST(length(text) AS DOUBLE) AS score")


class Broken:
    def score(self, pairs):
        raise OSError("no weights")


def test_reranking_falls_back_with_a_notice(spark):
    fused = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4)], "query_id long, doc_id string, rank int")
    pairs = spark.createDataFrame([(1, "q", "a", "x"), (1, "q", "b", "xxx"), (1, "q", "c", "xx"), (1, "q", "d", "xxxxx")], "query_id long, query string, doc_id string, text string")
    out, notice = A.reranked(fused, pairs, ByLength(), 3)
    assert [r["doc_id"] for r in out.orderBy("rank").collect()] == ["b", "c", "a", "d"] and notice is None
    out, notice = A.reranked(fused, pairs, Broken())
    assert "OSError" in notice and [r["doc_id"] for r in out.orderBy("rank").collect()] == list("abcd")
    assert A.reranked(fused, pairs, None)[1] is None and isinstance(ByLength(), A.Reranker)


def test_manual_candidates_keep_their_order(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    own = A.ManualRetriever(spark.createDataFrame([("z", 1), ("a", 2), ("m", 3)], "doc_id string, pos int"))
    assert sorted(map(tuple, own.retrieve(queries, 2).collect())) == [(1, "a", 2), (1, "z", 1), (2, "a", 2), (2, "z", 1)]
    by_query = A.ManualRetriever(spark.createDataFrame([(1, "z", 1), (3, "a", 2)], "query_id long, doc_id string, pos int"))
    assert [tuple(r) for r in by_query.retrieve(queries, 2).collect()] == [(1, "z", 1)] and isinstance(own, A.Retriever)


def test_index_resolution():
    assert A.resolve_index() == {"slogan": "index"}
    assert A.resolve_index(" Small ", statement=True) == {"slogan": "index-small", "statement": "index-small-statement"}
    assert A.resolve_index(quantised=True) == {"slogan": "index-quantised"}
    for wrong in ({"tier": "tiny"}, {"quantised": True, "statement": True}):
        with pytest.raises(ValueError):
            A.resolve_index(**wrong)
    with pytest.raises(FileNotFoundError, match="index-small"):
        A.resolve_index("small", exists=lambda name: name == "index")


def test_claims_are_checked_where_they_are(spark):
    from lemmata.plans import api

    pi = "3.14159265358979323846264338327950288419716939937510"
    rows = [(pi, "pi"), (pi, "pi + 1"), (pi, "1/0"), (None, "pi"), (pi, None)]
    got = api.verify_numeric(spark.createDataFrame(rows, "value string, expr string")).collect()
    assert [r["verified"] for r in got] == [True, False, False, False, False] and got[2]["error"] and got[3]["error"] == "missing value or expression"
