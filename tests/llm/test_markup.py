import time

import pytest

from lemmata.llm import markup
from lemmata.llm.markup import clean, clean_markup, clean_or_keep


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Plain text with $x_1 < y$ and f''(x) + g''(x).", []),
        ("The matrix [[1,0],[0,2]] and {x : x_1 > 0, x_2 < 3}; $C$ == $D$, 3*x*y, A -> B => C & its dual.", []),
        ("Write $Q$ \\ $n$ and $Q$ ~ $n$, see http://a.example/x_y_z and [200].", []),
        ("<p>One <b>bold</b> word.</p>", ["html"]),
        ("A &le; B", ["html"]),
        ("AT&T; is no reference, a &unknownthing; neither", []),
        ("<!-- note -->Body", ["html"]),
        ("# Title\n\nText", ["markdown"]),
        ("a **bold** and _soft_ word", ["markdown"]),
        ("x\n| n | v |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("> quoted line", ["markdown"]),
        ("`code` here", ["markdown"]),
        ("[text](https://a.example)", ["markdown"]),
        ("== Head ==\nText", ["wiki"]),
        ("a [[Link|label]] and '''bold'''", ["wiki"]),
        ("{{eqn | l = x | r = y}}", ["wiki"]),
        ("\\emph{so} and \\cite{a}", ["latex"]),
        ("a ``quoted'' word", ["latex"]),
        ("\\begin{enumerate} \\item A \\item B \\end{enumerate}", ["latex"]),
        ("```python\n#check x < y [[z]] \\emph{q}\n```", ["markdown"]),
        ("<i>a</i> and ''b''", ["html", "wiki"]),
    ],
)
def test_kinds(text, kinds):
    assert clean(text)[1] == kinds


def test_structure_is_kept():
    out = clean("<h2>Main</h2><p>Let $a<b$, then <i>so</i>.</p><ul><li>one<li>two</ul><pre><code>x < 1</code></pre>")[0]
    assert out == "## Main\n\nLet $a<b$, then so.\n\n- one\n- two\n\n```\nx < 1\n```"
    assert clean("\\section*{Setup} Text \\footnote{see}.\n\\begin{itemize} \\item a \\item b \\end{itemize}")[0] == "## Setup\n\nText (see).\n\n- a\n- b"
    assert clean("1. a\n2. b\n**c**")[0] == "1. a\n2. b\n\nc"
    assert clean("| n | v |\n|---|---|\n| 1 | 2 |")[0] == "n | v\n1 | 2"


def test_best_container_leaves_navigation_out():
    page = "<div><ul><li><a href='/a'>Home</a></li><li><a href='/b'>All pages</a></li></ul></div><div><p>" + "A long paragraph, with commas, that holds the statement. " * 6 + "</p></div>"
    out, kinds, blocks = clean(page)
    assert "Home" not in out and "A long paragraph" in out and kinds == ["html"] and blocks > 5


def test_odd_inputs(spark):
    long = "<p>" + "word, " * 50_000 + "</p>"
    rows = [("a", None, "x"), ("b", "", "y"), ("c", "  \n ", "z"), (None, "<b>n</b>", "k"), ("d", long, "l"), ("e", "</p></div><ul>open <li>item", "m"), ("e", "</p></div><ul>open <li>item", "m")]
    df = spark.createDataFrame(rows, "doc_id string, statement string, text string").selectExpr("*", "1 AS clean", "2 AS kinds")
    got = {}
    for r in clean_markup(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got["a"][0]["clean"] is None and got["a"][0]["kinds"] == []
    assert got["b"][0]["clean"] == "" and got["c"][0]["clean"] == ""
    assert got[None][0]["clean"] == "n" and len(got["e"]) == 2 and "item" in got["e"][0]["clean"]
    assert got["d"][0]["clean"].count("word") == 50_000
    assert clean_markup(df.limit(0)).count() == 0


def test_deep_nesting_does_not_break():
    assert "x" in clean("<div>" * 300 + "x" + "</div>" * 300)[0]


HOSTILE = {
    "nested tags": "<div>" * 100_000 + "x" + "</div>" * 100_000,
    "open tags, other ends": "<div>" * 100_000 + "x" + "</p>" * 100_000,
    "nested quotes": "<blockquote>" * 50_000 + "x",
    "nested lists": "<ul><li>" * 50_000 + "x",
    "formulas": "$a_1$ and " * 200_000,
    "open verbatims": "\\begin{verbatim} x " * 50_000,
    "open comments": "<!-- x " * 50_000,
    "open display": "\\( x \\[ y " * 50_000 + "<code> <pre> " * 20_000,
    "open brackets": "[[ [http://a.example \\emph{ \\a[ {{ x " * 20_000,
    "blanks": "== a" + " " * 200_000 + "\n" * 100_000 + "\\label" + " \n" * 50_000 + "# b",
    "one line before a rule": "word " * 50_000 + "\n--- x\n===\n" + "''a " * 50_000 + "~" * 100_000,
    "cells": "<table><tr>" + "<td></td>" * 50_000 + "<td>x</td></tr></table>",
    "paragraphs deep down": "<div>" * 20_000 + "<p>a paragraph, with a comma, that is long enough</p>" * 20_000,
    "quotes and stars": "``a **b __c `d " * 50_000 + "<a href=\"x" * 20_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_end_within_seconds(name):
    start = time.time()
    out, _, blocks, failure = clean_or_keep(HOSTILE[name])
    assert failure is None and time.time() - start < 15
    if name == "formulas":
        assert out.count("$a_1$") == 200_000
    if name in ("nested tags", "nested quotes", "nested lists", "cells"):
        assert "x" in out and blocks >= 50_000


def test_a_text_that_cannot_be_read_is_kept_with_the_reason(monkeypatch):
    monkeypatch.setattr(markup, "build", lambda text: 1 / 0)
    assert clean_or_keep("<p>x</p>") == ("<p>x</p>", [], 1, "ZeroDivisionError: division by zero")


BODY = "The statement says, in full, that every curve of this kind is smooth, and that the bound is sharp. "
MENU = "<nav><a href='/'>Home</a> <a href='/all'>All pages</a> <a href='/new'>Recent changes</a></nav>"
LINKS = "<div>" + "".join(f"<a href='/{i}'>Related page number {i}, with a long title</a> " for i in range(12)) + "</div>"


@pytest.mark.parametrize(
    "text, want",
    [
        # headings
        ("<h1>Main <i>part</i></h1><p>Text.</p>", "# Main part\n\nText."),
        ("# Main #\n\nText", "# Main\n\nText"),
        ("Main\n====\nText", "# Main\n\nText"),
        ("=== Deep ===\nText", "### Deep\n\nText"),
        ("\\subsection{Deep} Text", "### Deep\n\nText"),
        # lists
        ("<ol><li>one</li><li>two<ul><li>in</li></ul></li></ol>", "1. one\n2. two\n  - in"),
        ("* one\n* two\n\nText", "- one\n- two\n\nText"),
        ("\\begin{enumerate}\\item one \\item two\\end{enumerate}", "1. one\n2. two"),
        # code
        ("Run\n```py\nx = [1]  # *no* <b>\n```\nthen `y_1`.", "Run\n\n```\nx = [1]  # *no* <b>\n```\n\nthen `y_1`."),
        ("<pre>a &lt; b\n  c</pre>", "```\na < b\n  c\n```"),
        ("\\begin{verbatim}\n\\emph{x}\n\\end{verbatim}", "```\n\\emph{x}\n```"),
        # formulas
        ("<p>So $a < b$ and \\(x_1*y_1\\).</p>", "So $a < b$ and \\(x_1*y_1\\)."),
        ("Then \\begin{equation}\\label{e} a = b \\end{equation} holds in \\textbf{all} cases.", "Then\n\n$$a = b$$\n\nholds in all cases."),
        ("{{eqn | l = x | r = y}}", "x = y"),
        # links, quotes, tables, notes
        ("See [[Ring|the ring]] and [this](https://a.example/x) [https://b.example there].", "See the ring and this there."),
        ("> quoted\n> twice\n\nText", "> quoted\n> twice\n\nText"),
        ("<table><tr><th>n</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>", "n | v\n1 | 2"),
        ("It \\emph{holds}~\\cite{a}, see \\cref{b}\\footnote{or not}.", "It holds, see [ref] (or not)."),
        ("H<sub>2</sub> &amp; x<sup>2</sup>", "H_{2} & x^{2}"),
        # what is left out, by the scores of the tree
        (f"{MENU}<article><h2>Claim</h2><p>{BODY * 3}</p></article>", f"## Claim\n\n{(BODY * 3).strip()}"),
        (f"<div><p>{BODY * 3}</p><p>{BODY * 2}</p></div>{LINKS}", f"{(BODY * 3).strip()}\n\n{(BODY * 2).strip()}"),
        (f"{LINKS}<div><div><p>{BODY * 3}</p></div><ul><li>kept</li></ul></div><footer>Printed with ink</footer>", f"{(BODY * 3).strip()}\n\n- kept"),
        (f"<div><p>{BODY * 4}</p></div><div><p>Short but plain.</p></div>", f"{(BODY * 4).strip()}\n\nShort but plain."),
    ],
)
def test_gold(text, want):
    assert clean(text)[0] == want
