import pytest

from lemmata.llm import mixing as M


def docs(spark):
    rows = [(i, "x" * (i % 7 + 1), "Big ") for i in range(3000)] + [(10_000 + i, "y" * 50, "small") for i in range(20)] + [(20_000 + i, "z" * 5, "mid") for i in range(400)]
    rows += [(1, None, "big"), (2, "", "big"), (3, "q" * 9, None), (4, "q" * 9, "  "), (None, "n" * 3, "mid"), (30_000, "u" * 500, "untargeted"), (7, "x", "big"), (7, "x", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n", "2 AS h", "3 AS src", "4 AS b")


def test_shares_caps_and_shortage(spark):
    base = M.sized(docs(spark))
    targets = spark.createDataFrame([("big", 0.4, 1), ("SMALL", 0.3, 2), ("mid", 0.25, 5), ("none", 0.05, 3), (None, 0.1, 1), ("", None, None)], "source string, target_share double, max_repeats int")
    rep = {r["source"]: r for r in M.report(base, targets).collect()}
    total = base.agg({"n": "sum"}).first()[0]
    sizes = {r["src"]: r["sum(n)"] for r in base.groupBy("src").sum("n").collect()}
    assert rep["SMALL"]["short"] and rep["SMALL"]["tokens"] == 2 * sizes["small"]
    assert rep["none"]["short"] and rep["none"]["tokens"] == 0
    for name, share in (("big", 0.4), ("mid", 0.25)):
        assert not rep[name]["short"] and share * total - 10 <= rep[name]["tokens"] <= share * total
    times = M.mix(base, M.plan(base, targets)).collect()
    assert all(1 <= r["times"] <= {"big": 1, "small": 2, "mid": 5}[r["src"]] for r in times)


def test_thresholds_nest(spark):
    base = M.sized(docs(spark))

    def chosen(share):
        t = spark.createDataFrame([("big", share, 1)], "source string, target_share double, max_repeats int")
        return {(r["id"], r["n"]) for r in M.mix(base, M.plan(base, t)).collect()}

    few, more = chosen(0.1), chosen(0.3)
    assert few < more


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    base = M.sized(docs(spark).limit(0))
    r = M.report(base, t).collect()
    assert len(r) == 1 and r[0]["tokens"] == 0 and not r[0]["short"]
    assert M.report(M.sized(docs(spark)), t.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_all_or_nothing(spark, share):
    t = spark.createDataFrame([("mid", share, 1)], "source string, target_share double, max_repeats int")
    base = M.sized(docs(spark))
    n = M.mix(base, M.plan(base, t)).filter("n > 0").count()
    assert n == (401 if share else 0)
