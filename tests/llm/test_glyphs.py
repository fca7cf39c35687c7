import pytest

from lemmata.llm import glyphs as G


@pytest.mark.parametrize(
    "text, want",
    [
        ("ｗｉｌｄ cocycle", "wild cocycle"),
        ("Ja\u0308rn", "J\u00e4rn"),
        ("pack\u200bing \ufeffx", "packing x"),
        ("a\u00a0b\u2003c", "a b c"),
        ("diﬀerentiable ﬂag", "differentiable flag"),
        ("x² + ρ³ ≥ 0, ℤ ⊂ ℚ", "x² + ρ³ ≥ 0, ℤ ⊂ ℚ"),
        ("naïve жёсткий объект θεώρημα", "naïve жёсткий объект θεώρημα"),
        ("line\nbreak\ttab", "line\nbreak\ttab"),
        ("می\u200cخواهم", "می\u200cخواهم"),
        ("", ""),
    ],
)
def test_by_rule(text, want):
    assert G.repair(text, set()) == want


def test_look_alikes_need_the_vocabulary():
    known = {"the", "finite", "bound", "exceed"}
    assert G.repair("Тһе fіnіtе bօunԁ", known) == "The finite bound"
    assert G.repair("fіnіtе", set()) == "fіnіtе"
    # a genuine word next to another of its script is left alone, even if it could pass
    assert G.repair("рос объект", {"poc"}) == "рос объект"
    assert G.repair("ехсееԁ 131", known) == "exceed 131"
    assert G.repair("Here ο ≤ 2 and xα", {"o", "xa"}) == "Here ο ≤ 2 and xα"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, statement string, name string, slogan string").selectExpr("*", "1 AS id", "2 AS field", "3 AS known", "4 AS t0")


def test_operator(spark):
    rows = [("a", "tһe bound", None, None), ("b", "the bound", "Ｗide", ""), ("c", None, None, None), ("d", "zzqһ", "plain", None), (None, "tһe", None, None), ("b", "the bound", "Ｗide", ""), ("e", "x\u200b" * 50_000, "", None)]
    df = frame(spark, rows)
    assert {(r[0], r[1]) for r in G.affected(df).collect()} == {("a", "statement"), ("b", "name"), (None, "statement"), ("e", "statement")}
    out = G.repaired(df).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 7 and by["a"]["statement"] == "the bound" and by["a"]["affected"] == ["statement"]
    assert by["b"]["name"] == "Wide" and by["c"]["statement"] is None and by["d"]["statement"] == "zzqһ" and by[None]["statement"] == "the"
    assert by["e"]["statement"] == "x" * 50_000
    assert G.affected(df.limit(0)).count() == 0 and G.repaired(df.limit(0)).count() == 0


@pytest.mark.parametrize("word, want", [("pаge", "latin"), ("слово", "cyrillic"), ("сор", "cyrillic"), ("словo", "cyrillic"), ("word", "latin"), ("λόγος", "greek"), ("ο", "greek")])
def test_dominant_script(word, want):
    assert G.dominant_script(word) == want
