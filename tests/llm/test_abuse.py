import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from lemmata.llm import abuse as A
from tests.llm.held_out import HELD_OUT


def reviewed_tables(spark, sf):
    """The smallest tables with reviews enough to learn from."""
    folder = os.path.join(os.path.dirname(sf), "sf0.01")
    return (spark.read.parquet(f"{folder if os.path.isdir(folder) else sf}/{t}.parquet") for t in ("documents", "reviews"))


@pytest.fixture(scope="module")
def field(spark, sf):
    return A.train(A.reviewed(*reviewed_tables(spark, sf)))


def test_seeds_alone_train_a_field():
    field = A.train([])
    h, first, _ = A.Tokens().encode(["You are a stupid idiot and your family is filthy."])
    assert field.marginals(A.features(h, first), first).mean() > 0.8


@pytest.mark.parametrize("token, want", [("fucccck", "fuck"), ("S.E.X", "sex"), ("u$el3ss", "useless"), ("5h!t", "shit"), ("s**t", "<masked>"), ("scumbaɡ.", "scumbag"), ("$x_1$", "<m>"), ("12,", "<n>"), ("i-d-i-o-t-a", "idiota"), ("xxxxxx", "xxx"), ("308*x*M", "<m>"), ("...", "<p>")])
def test_plain(token, want):
    assert A.plain(token) == want


def test_letters_apart_spell_a_word():
    t = A.Tokens()
    assert t.encode(["such f u c k i n g dogs"])[0][0, 1] == t.encode(["fucking"])[0][0, 0]
    h = t.encode(["let x y be. a b c"])[0][0]
    assert h[1] != h[2] or h[1] == t.encode(["x"])[0][0, 0]


def test_passage_without_a_full_stop(field):
    h, first, _ = A.Tokens().encode(["Dann ist die Norm 7. halt deine klappe, du arschloch Dann ist jedes Feld bereits kompakt."])
    p = field.marginals(A.features(h, first), first)
    assert (p[5:10] > 0.5).all() and (p[:5] < 0.5).all() and (p[11:] < 0.5).all()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    f = A.Field()
    f.weight = rng.normal(size=1 << A.BITS).astype(np.float32)
    f.step = rng.normal(size=(2, 2))
    h, first, size = A.Tokens().encode(["one two three. four five", "six", ""])
    x = A.features(h, first)
    e = f.bias + sum(f.weight[r] for r in x)
    starts = np.flatnonzero(first)
    want = []
    for a, b in zip(starts, [*starts[1:], len(first)]):
        n, total, on = b - a, 0.0, np.zeros(b - a)
        for bits in range(2**n):
            y = [(bits >> i) & 1 for i in range(n)]
            w = np.exp(sum(e[a + i] for i in range(n) if y[i]) + sum(f.step[y[i - 1], y[i]] for i in range(1, n)))
            total += w
            on += w * np.array(y)
        want.extend(on / total)
    p, pairs = f.marginals(x, first, True)
    assert np.allclose(p, want, atol=1e-5) and np.allclose(pairs.sum(1), 1) and list(size) == [5, 1, 0]


def test_spans_and_clean_texts(spark, field):
    bad = "The bound is sharp. Shut your mouth, you w0rthless m***n. See page 3."
    good = ["The sex ratio is studied in population models.", "A moderator removed an insulting remark from this thread.", "Then $x$ annihilates a twisted holonomy.", None, "", "  \n"]
    rows = [(1, bad, "S "), *[(i + 2, t, None) for i, t in enumerate(good)], (None, "Fick dich, du Arschloch!", "s"), (1, bad, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS id", "2 AS src", "3 AS score")
    out = A.score_documents(df, field)
    got = out.collect()
    flagged = [r for r in got if r["score"] >= A.FLAGGED]
    assert sorted(str(r["doc_id"]) for r in flagged) == ["1", "1", "None"]
    s = next(r for r in got if r["doc_id"] == 1)["spans"][0]
    assert bad[s["start"] : s["end"]] == "Shut your mouth, you w0rthless m***n."
    assert all(r["score"] == 0 and not r["spans"] for r in got if r["doc_id"] in (5, 6, 7))
    rate = {r["source"]: r for r in A.rates(out).collect()}
    assert rate["s"]["documents"] == 3 and rate["s"]["flagged"] == 3 and rate[None]["flagged"] == 0
    assert A.score_documents(df.limit(0), field).count() == 0


def test_long_text_is_scored_to_its_end(spark, field):
    text = "The curve is smooth and " * 20_000 + "end. Shut up, you worthless idiot."
    out = A.score_documents(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), field).first()
    assert out["score"] >= A.FLAGGED and out["spans"][-1]["end"] == len(text)


def test_held_out_reviews(spark, sf):
    """Reviewers err, but nearly nothing that nobody called abusive is flagged, and flags are mostly confirmed."""
    docs, reviews = reviewed_tables(spark, sf)
    odd = A.reviewed(docs.filter("doc_id % 2 = 1"), reviews)
    out = A.score_documents(docs.filter("doc_id % 2 = 0"), A.train(odd))
    v = reviews.filter("toxic IS NOT NULL").groupBy("doc_id").agg({"toxic": "avg"}).withColumnRenamed("avg(toxic)", "share")
    t = out.join(v, "doc_id").collect()
    clean = [r for r in t if r["share"] == 0]
    assert sum(r["score"] >= A.FLAGGED for r in clean) <= 0.05 * len(clean)


def four_word_runs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {" ".join(w[i : i + 4]) for i in range(len(w) - 3)}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_seed_shares_four_words_with_the_documents(sf, scale):
    folder = os.path.join(os.path.dirname(sf), scale)
    if not os.path.isdir(folder):
        pytest.skip("no such table")
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["text"])["text"].to_pylist()
    seen = set().union(*(four_word_runs(t) for t in set(texts) if t))
    shared = seen & set().union(*(four_word_runs(t) for t in A.seed_passages()[0] + [t for t, _ in HELD_OUT]))
    assert not shared


def test_held_out_passages(spark, field):
    """Passages that were in no fit, one-word insults among them."""
    rows = [(i, t, "s") for i, (t, _) in enumerate(HELD_OUT)]
    out = A.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), field)
    got = {r["doc_id"] for r in out.collect() if r["score"] >= A.FLAGGED}
    bad = {i for i, (_, b) in enumerate(HELD_OUT) if b}
    assert len(got & bad) >= 0.85 * len(bad) and len(got - bad) <= 3


def test_wording_that_no_seed_has_is_learnt_from_the_reviews():
    rng = np.random.default_rng(3)
    neutral = ["The curve %d is smooth.", "We thank the reader of note %d.", "Fix a group of order %d."]
    docs = [" ".join(neutral[k] % rng.integers(99) for k in rng.integers(0, 3, 4)) for _ in range(400)]
    kinds = ["May your ink run dry, zorgling %d.", "Zorglings like %d rot the well."]
    bad = [f"{d} {kinds[i % 2] % i} {docs[i]}" for i, d in enumerate(docs[300:360])]
    labelled = [(d, 0.0) for d in docs[:300]] + [(d, 1.0) for d in bad] + [(d, 1.0) for d in docs[360:]]  # the last by mistake
    field, tokens = A.train(labelled), A.Tokens()
    for text, want in (("Fix a group of order 7. May your ink run dry, zorgling 500. The curve 1 is smooth.", True), (docs[5], False)):
        h, first, _ = tokens.encode([text])
        assert any(x >= A.FLAGGED for x in A.spans(field.marginals(A.features(h, first), first), first)[2]) is want
