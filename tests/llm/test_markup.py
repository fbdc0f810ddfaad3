import pytest

from strandloom.llm.markup import GRAMMAR, clean, clean_texts, kinds_of, markup_rows, slots, template_classes, token_vectors

TOKENS = {"p", "b", "table", "tr", "td", "th", "li", "ul", "a", "i", "div", "br", *GRAMMAR}
REAL = {
    "<p>one</p>": {"html"}, "a<br/>b": {"html"}, "R&amp;D": {"html"}, "x <!-- note --> y": {"html"}, "<pre><code>if a &lt; b\n**x**</code></pre>": {"html"},
    "# Head": {"markdown"}, "a\n- one\n- two": {"markdown"}, "1. one": {"markdown"}, "> said": {"markdown"}, "**b** it": {"markdown"}, "say __b__": {"markdown"}, "Head\n=====": {"markdown"},
    "[t](http://x.y)": {"markdown"}, "![t](a.png)": {"markdown"}, "| a | b |\n|---|--:|\n| 1 | 2 |": {"markdown"}, "call `f(a)` now": {"markdown"}, "```\n<p>no</p> $x_1$\n": {"markdown"}, "~~~\n[[no]]\n~~~": {"markdown"},
    "== Head ==": {"wiki"}, "'''b''' and": {"wiki"}, "see [[Page|it]]": {"wiki"}, "{{note|x}} y": {"wiki"}, '{| class="g"\n! a !! b\n|-\n| 1 || 2\n|}': {"wiki"},
    "\\section{A}": {"latex"}, "\\emph{a} b": {"latex"}, "is $w_i = 1$ so": {"latex"}, "$$ \\cos x $$": {"latex"}, "\\[ a \\]": {"latex"}, "\\begin{itemize}\n\\item a\n\\end{itemize}": {"latex"},
    "<b>a</b> and **c**": {"html", "markdown"},
}
PLAIN = [
    "", " ", "p < 3 and q > 4", "a Vec<u8> of 5", "mail <ops at desk 3>.", "R&D alike", "2 * 3 * 4", "a|b", "C:\\temp\\ledger", "we pay $5 to $78", "[0, 41) is half-open", "arr[3] and {retry: 3}", "a == b for C#", "issue #21 and fold_rank_x", "5 - 3 = 2, x -> y",
    "it's ''", "snake_case_name __init__", "#tag", "-5 degrees", "3.14 is",
]


@pytest.mark.parametrize("text", REAL)
def test_real_markup(text):
    assert kinds_of(text, TOKENS) == REAL[text]


@pytest.mark.parametrize("text", [t for t in PLAIN if "__init__" not in t])
def test_plain_text(text):
    assert kinds_of(text, TOKENS) == set()
    assert clean(text, TOKENS) == (text if not text.strip() else text.strip())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h2>A</h2><ul><li>x</li><li>y &amp; z</li></ul>", "## A\n\n- x\n- y & z"),
        ("<pre><code>if a &lt; b</code></pre>", "```\nif a < b\n```"),
        ("**b** [t](http://x)\n```rust\nfn f() {}\n```", "b t\n\n```\nfn f() {}\n```"),
        ("Head\n====\ntext", "# Head\ntext"),
        ("== H ==\n'''b''' [[P|it]] [[Category:X]]", "## H\nb it"),
        ("\\section{A}\n\\emph{x} is $w_i = \\frac{1}{2}$", "# A\n\nx is $w_i = \\frac{1}{2}$"),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b"),
        ('{| class="g"\n! a !! b\n|-\n| 1 || 2\n|}', "a | b\n1 | 2"),
    ],
)
def test_clean(text, want):
    assert clean(text, {*TOKENS, "h2", "pre", "code"}) == want


def test_templates_decide_what_is_a_tag(spark):
    texts = [("h", i, 0, t) for i, t in enumerate(["<q>a</q> <z>", "<q>b</q>", "mail <ops at desk 1>", "mail <ops at desk 2>", "<t><u>x</u></t>", "<t><u>y</u></t>", None, "x <cut>y</cut>", "x <cut>"])]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "host string, row_id long, block_no int, text string, markup string").drop("markup")
    classes = {tuple(r.tokens) for r in template_classes(token_vectors(df.selectExpr("host", "row_id AS page", "text"))).collect()}
    assert classes == {("q",), ("t", "u")}
    assert {r.row_id for r in markup_rows(df).collect()} == {0, 1, 4, 5}
    kept = {r.row_id: r.text for r in clean_texts(df).collect()}
    assert kept[0] == "a <z>" and kept[4] == "x" and kept[2] == "mail <ops at desk 1>" and kept[6] is None
    assert markup_rows(df.limit(0)).count() == 0


def test_the_template_decides_every_kind(spark, monkeypatch):
    texts = [("h", i, 0, t) for i, t in enumerate(REAL)]
    df = spark.createDataFrame(texts, "host string, row_id long, block_no int, text string")
    found = {}
    for r in markup_rows(df).collect():
        found.setdefault(r.row_id, set()).add(r.markup)
    assert found == {i: k for i, k in enumerate(REAL.values())}
    assert all(kinds_of(t, set()) == set() and clean(t, set()) == t.strip() for t in REAL)
    # A mark that is mostly not closed on its host is no markup there.
    loose = spark.createDataFrame([("h", i, 0, "**a and b") for i in range(9)] + [("h", 9, 0, "**a** and b")], df.schema)
    assert markup_rows(loose).count() == 0
    monkeypatch.setattr("strandloom.llm.markup.template", lambda vectors, agree: vectors.limit(0))
    assert markup_rows(df).count() == 0


def test_classes_nest_and_slots(spark):
    df = spark.createDataFrame([("h", i, f"<note>a <box><row><cell>{i}</cell></row></box></note> <x>") for i in range(4)] + [("h", 9, "<note>**b**</note>")], "host string, page long, text string")
    got = {tuple(r.tokens): r.inside for r in template_classes(token_vectors(df)).collect()}
    assert got == {("box", "cell", "row"): ["note"], ("markdown:strong",): ["note"], ("note",): None}
    assert slots("<p>a <b>c</b></p>d", TOKENS) == [("", ""), ("\n", "a "), ("", "c"), ("", ""), ("\n", "d")]


def test_odd_texts():
    for text in ("", " ", "\x1a0\x1a", "<" * 3000, "{{" * 2000, "\\begin{a" * 900, "`" * 4001, "[" * 2000 + "](x)" * 2000, "**a" * 3000, "\n> " * 2000):
        kinds_of(text, TOKENS)
        clean(text, TOKENS)
