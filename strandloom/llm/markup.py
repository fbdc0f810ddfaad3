"""Markup in texts: template classes by equal occurrence, then slots as clean text.

One pass lexes the texts of a host (here: a table) that hold a character markup
needs.  Code blocks, code spans and wiki tables are hidden first (what stands in
them counts for no other kind).  A token is an element, an environment, a pair of
marks, a line mark; its openings and closings are counted apart.  For each page
the lexer gives a token's counts and the token around its first occurrence.

Over a host these make occurrence vectors (sums of hashes of page and count), of
the openings and of the closings of a token.  A token is valid where the two
agree, up to a stated share of pages that are cut short, and the opening one
comes first: ``Vec<u8>`` or ``<ops at desk 7>`` are not, since nothing closes
them.  Tokens of one vector are an equivalence class; a class lies in the class of
the token that most often encloses its tokens, so the classes nest into the
host's template.  Only tokens of the template are markup, of whatever kind: a page
holds the kinds of its valid tokens, and what lies between them are the slots,
which are the clean text; each token has its own way to be written between them.

Defined results for odd input:

* null, empty and blank texts hold no markup and stay as they are;
* a table with one text still has classes, as a pair shares its vector there;
* repeated rows count each; extra columns are ignored; empty tables give empty
  results; unclosed fences reach to the end of the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import cut

KINDS = ("html", "markdown", "wiki", "latex")
#: Share of a token's pages in which its counts must agree with its partner's.
AGREE = 0.8
#: Most valid tokens of all hosts that are broadcast (about 60 bytes each); beyond
#: it each text is joined with its own.
BROADCAST_TOKENS = 500_000
# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# Elements that stand on lines of their own.
BLOCKS = ("p", "div", "tr", "table", "ul", "ol", "section", "article", "header", "footer", "blockquote", "br", "hr")

#: Characters and line beginnings without which a text holds no markup.
CANDIDATE = r"""[<`\[{\\$&|]|\*\S|__|~~|''|(?m:^[ \t]*(?:[-*+>#]|\d{1,9}[.)])[ \t>#])|(?m:^[ \t]*[=-]{2,})"""


class Mark(NamedTuple):
    """A place in a text that belongs to a token; ``put`` is written in its stead.

    ``side``: 1 opens, -1 closes, 0 stands alone.
    """

    start: int
    end: int
    token: str
    side: int
    put: str


# -- the lexer --------------------------------------------------------------------

# Code and wiki tables, leftmost first.
_HIDDEN = re.compile(
    r"(?P<fence>^[ \t]*(?P<f>`{3,}|~{3,})[^\n]*(?:\n[\s\S]*?^[ \t]*(?P=f)[`~]*[ \t\r]*$|[\s\S]*\Z))"
    r"|(?P<pre><(?P<tag>pre|code|script|style)\b[^>]*>[\s\S]*?</(?P=tag)\s*>)"
    r"|(?P<table>^\{\|[\s\S]*?^\|\})"
    r"|(?P<span>(?<!`)(?P<t>`{1,2})(?!`)(?:[^`\n]|(?!(?P=t))`|\n(?!\s*\n))+?(?P=t)(?!`))",
    re.M | re.I,
)
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})([^\n]*)\n?([\s\S]*?)(?:^[ \t]*\1[`~]*[ \t\r]*$|\Z)", re.M)
_HOLE = re.compile(r"( ?)\x1a(\d+)\x1a( ?)")
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]{0,30})((?:\s[^<>]*)?)/?>")
_COMMENT = re.compile(r"<!--[\s\S]*?-->|<!DOCTYPE[^>]*>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_NEXT_CELL = re.compile(r"\s*<t[dh]\b", re.I)


class Construct(NamedTuple):
    """A token of a grammar: ``whole`` finds it from its opening to its closing, its
    group ``in``, if any, being the slot; ``opens`` and ``closes`` count either side
    alone, also where the other is missing."""

    kind: str
    name: str
    needs: str
    whole: re.Pattern
    opens: re.Pattern | None = None
    closes: re.Pattern | None = None
    put: Callable[[re.Match], tuple[str, str]] = lambda m: ("", "")
    #: The slot is kept as it stands: no token counts in it.
    verbatim: bool = False


def _pair(kind: str, name: str, needs: str, opens: str, slot: str, closes: str, sides: tuple[str, str] | None = None, **more) -> Construct:
    one, other = sides or (opens, closes)
    return Construct(kind, f"{kind}:{name}", needs, re.compile(f"(?:{opens})(?P<in>{slot})(?:{closes})", re.M), re.compile(one, re.M), re.compile(other, re.M), **more)


def _line(name: str, needs: str, mark: str, **more) -> Construct:
    return Construct("markdown", f"markdown:{name}", needs, re.compile(mark, re.M), **more)


def _same(m: re.Match) -> tuple[str, str]:
    a, b = m.span("in")
    return m.string[m.start() : a], m.string[b : m.end()]


GRAMMARS = (
    _line("heading", "#", r"^[ ]{0,3}(?P<m>#{1,6})[ \t]+(?=\S)", put=lambda m: (m["m"] + " ", "")),
    _line("item", "", r"^(?P<m>[ \t]*)[-*+][ \t]+(?=\S)", put=lambda m: (m["m"] + "- ", "")),
    _line("number", "", r"^[ ]{0,3}\d{1,9}[.)][ \t]+(?=\S)", put=lambda m: (m[0], "")),
    _line("quote", ">", r"^[ ]{0,3}>[ \t]?(?=\S)"),
    _line("underline", "", r"(?:(?<=\n)|^(?P<line>[^\n]*\S[^\n]*)\n)[ ]{0,3}(?P<m>={3,}|-{3,})[ \t]*$"),
    _line("rule", "*", r"^[ ]{0,3}(?:\*[ \t]*){3,}$", put=lambda m: (m[0], "")),
    _line("table", "|", r"^[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*(?:\n|$)"),
    _pair("markdown", "link", "](", r"!?\[(?=[^\]\n]+\]\()", r"[^\]\n]+", r"\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"),
    _pair("markdown", "strong", "**", r"(?<![*\w])\*\*(?=[^\s*])", r"[^\n]*?", r"(?<=[^\s*])\*\*(?!\*)", (r"(?<![*\w])\*\*(?=[^\s*])", r"(?<=[^\s*])\*\*(?![*\w])")),
    _pair("markdown", "under", "__", r"(?<![_\w])__(?=[^\s_])", r"[^\n]*?", r"(?<=[^\s_])__(?![_\w])"),
    _pair("markdown", "emphasis", "*", r"(?<![*\w])\*(?=[^\s*])", r"[^*\n]*?", r"(?<=[^\s*])\*(?![*\w])"),
    _pair("markdown", "strike", "~~", r"(?<![~\w])~~(?=[^\s~])", r"[^\n]*?", r"(?<=[^\s~])~~(?!~)", (r"(?<![~\w])~~(?=[^\s~])", r"(?<=[^\s~])~~(?![~\w])")),
    _pair("wiki", "bold", "'''", r"'''(?=[^\s'])", r"[^\n]*?", r"'''", (r"(?<!')'''(?=[^\s'])", r"(?<=[^\s'])'''(?!')")),
    _pair("wiki", "italic", "''", r"(?<!')''(?=[^\s'])", r"[^'\n]*?", r"''(?!')", (r"(?<!')''(?=[^\s'])", r"(?<=[^\s'])''(?!')")),
    _pair("wiki", "heading", "==", r"^(?P<eq>={2,6})[ \t]*(?=[^=\s])", r"[^=\s\n][^\n]*?", r"[ \t]*(?P=eq)[ \t]*$", (r"^={2,6}(?=[ \t]*[^=\s])", r"[^=\s][ \t]*={2,6}[ \t]*$"), put=lambda m: ("#" * len(m["eq"]) + " ", "")),
    Construct("wiki", "wiki:category", "[[", re.compile(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]")),
    _pair("wiki", "link", "[[", r"\[\[(?!(?:Category|File|Image):)(?=[^\[\]\s])(?:[^\[\]|\n]*\|)*", r"[^\[\]|\n]*", r"\]\]", (r"\[\[(?=[^\s\[\]])", r"(?<=[^\s\[])\]\]")),
    Construct("wiki", "wiki:template", "{{", re.compile(r"\{\{(?=[A-Za-z#])[^{}]*?(?:\|(?P<in>[^{}|=]+))?\}\}"), re.compile(r"\{\{(?=[A-Za-z#])"), re.compile(r"\}\}")),
    Construct("latex", "latex:formula", "$$", re.compile(r"\$\$(?P<in>[\s\S]+?)\$\$"), put=_same, verbatim=True),
    Construct("latex", "latex:inline", "$", re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?P<in>(?=[^$\n]*[\\^_={}])[^$\n]*?)(?<=[^\s\\$])\$(?![\d$])"), re.compile(r"(?<![\\$\w])\$(?=[^\s$\d])"), re.compile(r"(?<=[^\s\\$])\$(?![\d$\w])"), put=_same, verbatim=True),
    _pair("latex", "display", "\\[", r"\\\[", r"[\s\S]+?", r"\\\]", put=lambda m: ("$$", "$$"), verbatim=True),
    _pair("latex", "parentheses", "\\(", r"\\\(", r"[\s\S]+?", r"\\\)", put=_same, verbatim=True),
)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?")
_COMMAND = re.compile(r"(?P<tie>~?)\\(?!(?:begin|end)\{)(?P<name>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{(?=[^{}\n]*)")
_ITEM = re.compile(r"^[ \t]*\\item\b[ \t]*", re.M)
_BRACE = re.compile(r"[{}\n]")
# Environments that hold a formula, commands that head a part, commands that only refer.
FORMULAS = ("equation", "align", "displaymath", "math")
HEADS = {"part": 1, "chapter": 1, "section": 1, "subsection": 1, "subsubsection": 1}
REFERS = ("cite", "ref", "label")
#: All tokens that are not elements of HTML.
GRAMMAR = frozenset(
    ("html:code", "html:comment", "html:entity", "markdown:fence", "markdown:span", "wiki:table", "latex:environment", "latex:command", *(g.name for g in GRAMMARS)),
)


def _kind(token: str) -> str:
    return token.partition(":")[0] if ":" in token else "html"


def _code(body: str) -> str:
    return "\n```\n" + body.strip("\n") + "\n```\n"


def _shown(m: re.Match) -> str:
    """How a hidden piece is written in a clean text."""
    if m["fence"] is not None:
        f = _FENCE.match(m[0])
        return _code(f[3] if f else m[0])
    if m["pre"] is not None:
        body = html.unescape(re.sub(r"<[^<>]*>", "", m[0]))
        return _code(body) if m["tag"].lower() == "pre" else body if m["tag"].lower() == "code" else ""
    if m["table"] is not None:
        rows = re.split(r"^\|-[^\n]*$", re.sub(r"^\{\|[^\n]*\n?|^\|\}", "", m[0], flags=re.M), flags=re.M)
        cells = [re.sub(r"\s*\n[!|]\s*|\s*(?:!!|\|\|)\s*", " | ", r.strip().lstrip("!|").strip()) for r in rows if r.strip()]
        return "\n" + "\n".join(cells) + "\n"
    return m[0].strip("`")


def hide(text: str) -> tuple[str, list[tuple[str, re.Match]]]:
    """The text with a numbered hole for each piece of code or wiki table, and these
    with their tokens."""
    held: list[tuple[str, re.Match]] = []

    def hole(m: re.Match) -> str:
        token = "markdown:fence" if m["fence"] is not None else "html:code" if m["pre"] is not None else "wiki:table" if m["table"] is not None else "markdown:span"
        held.append((token, m))
        here = f"\x1a{len(held) - 1}\x1a"
        return f" {here} " if token == "html:code" else here if token == "markdown:span" else here + "\n"

    return _HIDDEN.sub(hole, text.replace("\x1a", "")), held


def _closing(rest: str, at: int) -> int:
    """Where the brace closes that opened before ``at``, within the line; -1 if it does not."""
    depth = 1
    for m in _BRACE.finditer(rest, at):
        depth += {"{": 1, "}": -1, "\n": 99}[m[0]]
        if not depth:
            return m.start()
        if depth > 50:
            break
    return -1


def _html_marks(rest: str) -> Iterator[Mark]:
    if "<" in rest:
        for m in _COMMENT.finditer(rest):
            yield Mark(*m.span(), "html:comment", 0, "")
        for m in _TAG.finditer(rest):
            name, closes = m[2].lower(), bool(m[1])
            put = "\n" if name in BLOCKS else ""
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                put = "\n" if closes else "\n" + "#" * int(name[1]) + " "
            elif name == "li" and not closes:
                put = "\n- "
            elif name in ("td", "th") and closes and _NEXT_CELL.match(rest, m.end()):
                put = " | "
            yield Mark(*m.span(), name, 0 if name in VOID else -1 if closes else 1, put)
    if "&" in rest:
        for m in _ENTITY.finditer(rest):
            if (plain := html.unescape(m[0])) != m[0]:
                yield Mark(*m.span(), "html:entity", 0, plain)


def _latex_marks(rest: str) -> Iterator[Mark]:
    for m in _ENVIRONMENT.finditer(rest):
        (start, end), opens = m.span(), m[1] == "begin"
        formula = m[2].rstrip("*") in FORMULAS
        if formula:  # without the white space at the ends of the slot
            start = start if opens else len(rest[:start].rstrip())
            end = len(rest) - len(rest[end:].lstrip()) if opens else end
        yield Mark(start, end, "latex:environment", 1 if opens else -1, ("\n$$" if opens else "$$\n") if formula else "")
    for m in _COMMAND.finditer(rest):
        end, name = _closing(rest, m.end()), m["name"]
        refers = any(name == r or name.startswith(r) for r in REFERS)
        start = m.start() if refers else m.start("name") - 1
        if refers and end >= 0:
            yield Mark(start, end + 1, "latex:command", 0, "")
            continue
        head = HEADS.get(name)
        yield Mark(start, m.end(), "latex:command", 1, "\n# " if head else "")
        if end >= 0:
            yield Mark(end, end + 1, "latex:command", -1, "\n" if head else "")
    for m in _ITEM.finditer(rest):
        yield Mark(*m.span(), "latex:environment", 0, "- ")


def _marks(c: Construct, rest: str) -> Iterator[Mark]:
    for m in c.whole.finditer(rest):
        before, after = c.put(m)
        if c.name == "markdown:underline":
            if m["line"] is not None:
                yield Mark(m.start(), m.start(), c.name, 0, "# " if m["m"][0] == "=" else "## ")
                yield Mark(m.end("line"), m.end(), c.name, 0, "")
            else:
                yield Mark(*m.span(), c.name, 0, m[0])
        elif m.re.groupindex.get("in") is None or m["in"] is None:
            yield Mark(*m.span(), c.name, 0, before)
        else:
            a, b = m.span("in")
            yield Mark(m.start(), a, c.name, 1, before)
            yield Mark(b, m.end(), c.name, -1, after)


class Page(NamedTuple):
    """A lexed text: the text with holes, the hidden pieces, its marks in order, the
    counts (opened, closed, first opens, whole) of each token and the token around
    it.  A token of which only one side was found is not whole."""

    rest: str
    held: list[tuple[str, re.Match]]
    marks: list[Mark]
    counts: dict[str, tuple[int, int, bool, bool]]
    around: dict[str, str]


def lex(text: str) -> Page:
    """The tokens of a text, valid or not."""
    rest, held = hide(text)
    marks: list[Mark] = []
    spans: list[tuple[int, int]] = []  # slots kept as they stand
    sides: dict[str, list] = {}
    for c in GRAMMARS:
        if c.needs not in rest:
            continue
        found = [x for x in _marks(c, rest) if not spans or not any(a < x.start < b for a, b in spans)]
        if c.verbatim:
            spans += [(x.end, y.start) for x, y in zip(found[::2], found[1::2]) if x.side == 1 and y.side == -1]
        if c.opens is not None:
            sides[c.name] = [len(c.opens.findall(rest)), len(c.closes.findall(rest)), True, bool(found)]
        marks += found
    more = list(_html_marks(rest)) if "<" in rest or "&" in rest else []
    if "\\" in rest:
        more += _latex_marks(rest)
    marks += [x for x in more if not any(a < x.start < b for a, b in spans)] if spans else more
    marks.sort(key=lambda x: (x.start, -x.side, -x.end))
    counts: dict[str, list] = {}
    for token, _ in held:
        got = counts.setdefault(token, [0, 0, True, True])
        got[0] += 1
        got[1] += 1  # an unclosed fence ends with the text
    around: dict[str, str] = {}
    stack: list[str] = []
    for x in marks:
        got = counts.setdefault(x.token, [0, 0, x.side >= 0, True])
        got[0] += x.side >= 0
        got[1] += x.side <= 0
        if x.side < 0:
            if x.token in stack:
                while stack.pop() != x.token:
                    pass
        else:
            around.setdefault(x.token, stack[-1] if stack else "")
            if x.side > 0:
                stack.append(x.token)
    counts |= {k: v for k, v in sides.items() if v[0] or v[1]}
    return Page(rest, held, marks, {k: tuple(v) for k, v in counts.items()}, around)


def kinds_of(text: str, tokens: frozenset[str] | set[str]) -> set[str]:
    """The kinds of markup a text holds, given its host's template tokens."""
    return {_kind(t) for t, c in lex(text).counts.items() if c[3] and t in tokens}


def slots(text: str, tokens: frozenset[str] | set[str]) -> list[tuple[str, str]]:
    """(before, slot): what lies between the template's tokens of a text, with what is
    written for the token before it."""
    page, out, at, put = lex(text), [], 0, ""
    table = "markdown:table" in page.counts and "markdown:table" in tokens
    # Block elements that are cut short go too where the page holds HTML for certain.
    loose = BLOCKS if any(t in tokens and _kind(t) == "html" for t in page.counts) else ()
    for x in page.marks:
        if x.start < at or x.token not in tokens and x.token not in loose:
            continue
        out.append((put, page.rest[at : x.start]))
        at, put = x.end, x.put
    out.append((put, page.rest[at:]))
    if table:  # bars at the ends of a row
        out = [(p, re.sub(r"^[ ]{0,3}\|[ \t]*([^\n]*?)[ \t]*\|[ \t]*$", r"\1", s, flags=re.M)) for p, s in out]

    def shown(m: re.Match) -> str:
        token, piece = page.held[int(m[2])]
        kept = _shown(piece) if token in tokens else piece[0]
        return kept if token == "html:code" else m[1] + kept + m[3]

    return [(p, _HOLE.sub(shown, s)) for p, s in out]


def clean(text: str, tokens: frozenset[str] | set[str]) -> str:
    """The text without markup: headings as ``#`` lines, list items as ``-``
    lines, code between fences, formulas between dollars, cells between bars."""
    if not text.strip():
        return text
    return re.sub(r"\n{3,}", "\n\n", "".join(p + s for p, s in slots(text, tokens))).strip()


# -- the template -----------------------------------------------------------------

LEXED = "host string, row_id long, page long, token string, opened long, closed long, in_order boolean, whole boolean, around string"


def _lexer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, row, page, text in zip(batch["host"], batch["row_id"], batch["page"], batch["text"]):
            found = lex(text)
            rows += [(host, row, page, t, *found.counts[t], found.around.get(t, "")) for t in found.counts]
        yield pd.DataFrame(rows, columns=["host", "row_id", "page", "token", "opened", "closed", "in_order", "whole", "around"])


def lexed(texts: DataFrame) -> DataFrame:
    """The tokens of each page, as ``LEXED``; ``texts``: (host, row_id, page, text)."""
    may = texts.filter(F.col("text").rlike(CANDIDATE))
    return may.select("host", F.col("row_id").cast("long").alias("row_id"), F.col("page").cast("long").alias("page"), "text").mapInPandas(_lexer, LEXED)


def token_vectors(texts: DataFrame) -> DataFrame:
    """Occurrence vectors of the tokens of each host, from (host, page, text)."""
    return vectors_of(lexed(texts.select("host", F.lit(0).alias("row_id"), "page", "text")))


def vectors_of(tokens: DataFrame) -> DataFrame:
    """(host, token, pages, agreeing, open_vector, close_vector, around): ``around`` is
    the token that most often encloses it, empty for none."""
    vector = lambda c: F.bit_xor(F.when(F.col(c) > 0, F.xxhash64("page", F.col(c))).otherwise(F.lit(0).cast("long")))
    agree = ((F.col("opened") == F.col("closed")) & F.col("in_order")).cast("long")
    each = tokens.groupBy("host", "token", "around").agg(F.count(F.lit(1)).alias("pages"), F.sum(agree).alias("agreeing"), vector("opened").alias("open_vector"), vector("closed").alias("close_vector"))
    most = F.max_by("around", F.struct("pages", "around")).alias("around")
    return each.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("agreeing").alias("agreeing"), F.bit_xor("open_vector").alias("open_vector"), F.bit_xor("close_vector").alias("close_vector"), most)


def template(vectors: DataFrame, agree: float = AGREE) -> DataFrame:
    """Valid tokens with the equivalence class each belongs to and the token it lies in.

    The class is named by the vector; where an opening and a closing vector
    differ in a few texts the token stands in the class of its opening one.
    """
    valid = (F.col("open_vector") == F.col("close_vector")) | (F.col("agreeing") >= agree * F.col("pages"))
    return vectors.filter(valid & (F.col("agreeing") > 0)).select("host", "token", "pages", F.col("open_vector").alias("class"), "around")


def template_classes(vectors: DataFrame, agree: float = AGREE) -> DataFrame:
    """(host, pages, tokens, inside): the classes of each host, ``inside`` being the
    tokens of the class around its outermost one, null where it lies in none."""
    valid = template(vectors, agree)
    parent = valid.select("host", F.col("token").alias("around"), F.col("class").alias("of"))
    placed = valid.join(parent, ["host", "around"], "left")
    placed = placed.withColumn("inner", F.coalesce(F.col("of") == F.col("class"), F.lit(False)))
    outer = F.max_by("of", F.struct(~F.col("inner"), F.col("of").isNull(), "pages", "token")).alias("of")
    classes = placed.groupBy("host", "class").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_set("token")).alias("tokens"), outer)
    around = classes.select("host", F.col("class").alias("of"), F.col("tokens").alias("inside"))
    classes = classes.withColumn("of", F.when(F.col("of") != F.col("class"), F.col("of")))
    return classes.join(around, ["host", "of"], "left").select("host", "pages", "tokens", "inside")


# -- kinds and slots --------------------------------------------------------------


def markup_rows(texts: DataFrame, agree: float = AGREE) -> DataFrame:
    """(host, row_id, markup): one row for each kind of markup a row's texts hold.

    ``texts``: (host, row_id, block_no, text).
    """
    tokens = cut(lexed(texts.select("host", "row_id", F.xxhash64("row_id", "block_no").alias("page"), "text")))
    kind = F.when(F.col("token").contains(":"), F.substring_index("token", ":", 1)).otherwise("html")
    valid = template(vectors_of(tokens), agree).select("host", "token")
    return tokens.filter("whole").join(valid, ["host", "token"], "left_semi").select("host", "row_id", kind.alias("markup")).distinct()


def _cleaner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["host", "row_id", "block_no"]].assign(text=[clean(t, frozenset(v)) for t, v in zip(batch["text"], batch["tokens"])])


def clean_texts(texts: DataFrame, agree: float = AGREE) -> DataFrame:
    """(host, row_id, block_no, text) with clean texts; texts that can hold no
    markup pass by within the JVM."""
    texts = texts.select("host", "row_id", F.col("block_no").cast("int").alias("block_no"), "text")
    may: Column = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    paged = texts.select("host", F.lit(0).alias("row_id"), F.xxhash64("row_id", "block_no").alias("page"), "text")
    valid = cut(template(vectors_of(lexed(paged)), agree).select("host", "token"))
    by_host = valid.groupBy("host").agg(F.collect_list("token").alias("tokens"))
    if valid.count() <= BROADCAST_TOKENS:
        by_host = F.broadcast(by_host)
    done = texts.filter(may).join(by_host, "host", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    done = done.mapInPandas(_cleaner, "host string, row_id long, block_no int, text string")
    return done.unionByName(texts.filter(~may))


def table_texts(sessions: DataFrame, chats: DataFrame) -> DataFrame:
    """The texts of both tables as (host, row_id, block_no, text)."""
    blocks = sessions.filter(F.col("line_type").isin("user", "assistant")).select("row_id", F.posexplode("message.content").alias("block_no", "b")).filter("b.type = 'text'")
    mine = blocks.select(F.lit("session_messages").alias("host"), "row_id", "block_no", F.col("b.text").alias("text"))
    theirs = chats.select(F.lit("chat_messages").alias("host"), "row_id", F.lit(0).alias("block_no"), "text")
    return mine.unionByName(theirs).filter("text is not null")
