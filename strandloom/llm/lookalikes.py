"""One consistent form for texts that look the same.

A transducer, compiled once, runs once over a text's grapheme clusters (a base
with the marks and invisible characters after it), the longest cluster at each
place.  Its tables are precomputed from rules over the Unicode database and a
list of look-alike letters, and nothing is looked up elsewhere while it runs:

* full-width and half-width forms become the plain form;
* invisible characters vanish, every kind of space becomes U+0020, line
  separators and CR LF become LF;
* ligatures and digraph letters become their letters;
* letters of another script with the same shape become the Latin letter;
* marks are put in their order and composed with their base, whatever script the
  base came from.

Nothing else is changed: raised or circled digits, fractions, dashes, quotes
and letter case stay, since a reader can see them.  When the tables are built
each character is put to every rule, and two rules that give it different targets
are a conflict, as is a target that would be changed again; either is an error.

That form is for comparing.  ``kept`` is for reading on: it leaves words that are
wholly of another script, with a letter that no Latin one resembles, as they are.
``letters`` of a build may come from ``confusables``, the public data file.

Defined results for odd input: null stays null; empty stays empty; a lone mark
at the start of a text is a cluster of its own; unpaired surrogates stay; ASCII
texts without control characters come back as they are.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import cut

# Letters of other scripts that have the shape of a Latin letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ѵ": "v", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
}
OTHER = {"Տ": "S", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "µ": "μ"}
LETTERS = CYRILLIC | GREEK | OTHER
_LETTERS = tuple(LETTERS.items())
# Characters without a glyph that are not of the format category, and format characters that have one.
BLANK_MARKS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
SEEN_FORMATS = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440)]
#: Ranges that can hold characters with a rule; left out are unified ideographs,
#: Hangul syllables, surrogates, private use and planes without either.
ASSIGNED = (range(0x3400), range(0xA000, 0xAC00), range(0xD7B0, 0xD800), range(0xF900, 0x17000), range(0x1AFF0, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))
# Digraph letters that have a compatibility decomposition but no LIGATURE in their name.
DIGRAPHS = [*range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4)]


def _invisible(code: int, kind: str) -> bool:
    if code in BLANK_MARKS:
        return True
    if kind == "Cc":
        return code not in (9, 10, 11, 12, 13, 0x85)
    return kind == "Cf" and code not in SEEN_FORMATS


def _width(ch: str, parts: str) -> str | None:
    if parts.startswith(("<wide>", "<narrow>")):
        return "".join(chr(int(x, 16)) for x in parts.split()[1:])
    return None


def _ligature(ch: str, parts: str) -> str | None:
    name = unicodedata.name(ch, "")
    if parts.startswith("<compat>") and ("LATIN SMALL LIGATURE" in name or "LATIN CAPITAL LIGATURE" in name or ord(ch) in DIGRAPHS):
        return "".join(chr(int(x, 16)) for x in parts.split()[1:])
    return None


def _blank(ch: str, kind: str) -> str | None:
    if _invisible(ord(ch), kind):
        return ""
    if kind == "Zs" or ord(ch) == 0x2800:
        return " "
    return "\n" if kind in ("Zl", "Zp") or ch == "\r" else None


class Transducer:
    """The compiled tables.

    ``apart``: what a character stands for, accents apart; ``order``: the class
    of each mark; ``pairs``: base and mark to their composed letter; ``table``:
    single characters that change, with their final form.
    """

    def __init__(self, letters: dict[str, str]):
        self.apart, self.table, self.order, self.pairs = {}, {}, {}, {}
        trailing = []
        known = [chr(c) for c in itertools.chain(*ASSIGNED) if c not in (9, 10)]
        known = [(ch, kind) for ch in known if (kind := unicodedata.category(ch)) not in ("Cn", "Co")]
        for ch, _ in known:
            if unicodedata.combining(ch):
                self.order[ch] = unicodedata.combining(ch)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", pair := "".join(chr(int(x, 16)) for x in parts)) == ch:
                self.pairs[pair] = ch
        for ch, kind in known:
            self.apart[ch] = self._resolve(ch, letters, 0)
        self.apart = {k: v for k, v in self.apart.items() if v != k}
        for ch, kind in known:
            to = self._composed(self.apart.get(ch, ch))
            if to != ch:
                self.table[ch] = to
            if kind in ("Mn", "Me", "Mc") or to == "" or unicodedata.category(to[0])[0] == "M":
                trailing.append(ch)
        for source, to in self.table.items():
            if self._composed("".join(self.apart.get(c, c) for c in to)) != to:
                raise ValueError(f"conflict in the table: {source!r} gives {to!r}, which is changed again")
        ranges = lambda xs: "".join(re.escape(a) if a == b else f"{re.escape(a)}-{re.escape(b)}" for a, b in _ranges(xs))
        after, heads = ranges(trailing), ranges(sorted(set(self.table) - set(trailing)))
        self.pattern = re.compile(f"\r\n|[{heads}][{after}]*|([{after}]+)")
        self.memory: dict[str, str] = {"\r\n": "\n"}

    def _resolve(self, ch: str, letters: dict[str, str], depth: int) -> str:
        """All rules at once: what they give must come to one target in the end."""
        if depth > 8:
            raise ValueError(f"conflict in the rules: {ch!r} has no end")
        parts = unicodedata.decomposition(ch)
        kind = unicodedata.category(ch)
        accents = "".join(chr(int(x, 16)) for x in parts.split()) if parts and parts[0] != "<" else None
        given = {t for t in (_blank(ch, kind), _width(ch, parts), _ligature(ch, parts), letters.get(ch), accents) if t is not None and t != ch}
        found = {"".join(self._resolve(c, letters, depth + 1) for c in t) for t in given}
        if len(found) > 1:
            raise ValueError(f"conflict in the rules: {ch!r} gives {sorted(found)}")
        return found.pop() if found else ch

    def _composed(self, text: str) -> str:
        """Marks in their order, composed with the base before them."""
        order, pairs = self.order, self.pairs
        if len(text) < 2:
            return pairs.get(text, text)
        run: list[str] = []
        at = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[end] in order:
                end += 1
            first = at + (text[at] not in order)
            run += [*text[at:first], *sorted(text[first:end], key=order.__getitem__)]
            at = end
        out: list[str] = []
        starter, last = -1, -1
        for ch in run:
            level = order.get(ch, 0)
            if starter >= 0 and (last < level or last == -1) and (both := pairs.get(out[starter] + ch)):
                out[starter] = both
                continue
            if level == 0:
                starter, last = len(out), -1
            else:
                last = level
            out.append(ch)
        return "".join(out)

    def cluster(self, cluster: str) -> str:
        found = self.memory.get(cluster)
        if found is None:
            found = self._composed("".join(self.apart.get(c, c) for c in cluster))
            if len(self.memory) < 65_536:
                self.memory[cluster] = found
        return found

    def run(self, text: str) -> str:
        """One pass over a text."""
        out, done = [], 0
        for m in self.pattern.finditer(text):
            start = m.start()
            if m.lastindex and start > done:  # marks belong to the base before them
                start -= 1
            out += text[done:start], self.cluster(text[start : m.end()])
            done = m.end()
        return "".join(out) + text[done:] if out else text


@lru_cache(maxsize=4)
def _built(letters: tuple[tuple[str, str], ...]) -> Transducer:
    return Transducer(dict(letters))


def transducer(letters: dict[str, str] = LETTERS) -> tuple[re.Pattern, dict[str, str]]:
    """The compiled pattern and the table of single characters that change."""
    built = _built(tuple(letters.items()))
    return built.pattern, built.table


def confusables(path: str) -> dict[str, str]:
    """Look-alike letters of the public confusables file (``source ; target ; ...``,
    hexadecimal): single letters of another script that stand for a Latin one of the
    same case.  Letters that the other rules change are left to them."""
    out = dict(LETTERS)
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            fields = [x.strip() for x in line.split("#")[0].split(";")]
            if len(fields) < 2 or " " in fields[0] or " " in fields[1]:
                continue
            a, b = chr(int(fields[0], 16)), chr(int(fields[1], 16))
            latin = b.isascii() and b.isalpha()
            if latin and not a.isascii() and unicodedata.category(a) == unicodedata.category(b) and not unicodedata.decomposition(a) and "LATIN" not in unicodedata.name(a, "LATIN"):
                out.setdefault(a, b)
    return out


def _ranges(chars: list[str]) -> Iterator[tuple[str, str]]:
    first = last = None
    for ch in sorted(chars):
        if last is not None and ord(ch) == ord(last) + 1:
            last = ch
            continue
        if first is not None:
            yield first, last
        first = last = ch
    if first is not None:
        yield first, last


_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f\r]")
_FOREIGN = re.compile(r"[^\W\d_]+")


def canonical(text: str | None, letters: dict[str, str] = LETTERS) -> str | None:
    """The one form of a text."""
    if text is None or (text.isascii() and not _CONTROL.search(text)):
        return text
    return _built(tuple(letters.items()) if letters is not LETTERS else _LETTERS).run(text)


def kept(text: str | None, letters: dict[str, str] = LETTERS) -> str | None:
    """The form to read on: as ``canonical``, but a word without a Latin letter and
    with one that none resembles keeps its letters."""
    if text is None or text.isascii():
        return canonical(text, letters)
    plain = _built(()).run(text)

    def word(m: re.Match) -> str:
        marks = unicodedata.normalize("NFD", m[0])
        if m[0].isascii() or any("a" <= c.lower() <= "z" for c in marks) or all(c in letters for c in marks if c.isalpha()):
            return canonical(m[0], letters)
        return m[0]

    return _FOREIGN.sub(word, plain)


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    """``canonical`` over Arrow batches."""
    return texts.map(canonical)


def canonical_text(text: Column) -> Column:
    """The one form of a text column; texts in plain ASCII never leave the JVM.

    Spark evaluates a Python function for all rows of a branch, so the ASCII
    rows are handed over as null.
    """
    odd = text.rlike(r"[^\x09\x0A\x0B\x0C\x20-\x7E]")
    return F.when(odd, canonical_udf(F.when(odd, text))).otherwise(text)


def canonical_documents(documents: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """Documents with the one form of their text in ``out``."""
    return documents.withColumn(out, canonical_text(F.col(text)))


def _forms(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, form, raw): digests of 128 bits, of documents with a visible character."""
    rows = canonical_documents(documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.col(text).isNotNull()))
    digest = lambda c: F.unhex(F.md5(c))
    rows = rows.filter(F.col("canonical").rlike(r"[^\s\p{Z}\p{C}]")).select("id", digest("canonical").alias("form"), digest("text").alias("raw"))
    return cut(rows)  # several passes over small rows instead of as many over the texts


def same_look_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, writings): each document of a form that is written in several
    ways; the class is its smallest id.  One row a document, whatever the class's size."""
    rows = _forms(documents, doc_id, text)
    classes = rows.groupBy("form", "raw").agg(F.min("id").alias("least")).groupBy("form").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("writings")).filter("writings > 1")
    return rows.join(classes, "form").select(F.col("id").alias(doc_id), "class_id", "writings")


def same_look_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a < b) of documents that look the same but are not equal.

    Equal texts are one class; only forms with two classes or more go on, and
    pairs are formed between classes, then of their members, so the work is
    that of the result, which is all pairs by contract; ``same_look_classes`` has a
    row a document.  Hashes of 128 bits stand for the texts.
    """
    rows = _forms(documents, doc_id, text)
    classes = rows.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    several = classes.groupBy("form").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("form")
    members = rows.join(several, "form")
    a = classes.join(several, "form").select("form", F.col("raw").alias("raw_a"))
    kinds = a.join(classes.select("form", F.col("raw").alias("raw_b")), "form").filter("raw_a < raw_b")
    left = members.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    right = members.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    pairs = kinds.join(left, ["form", "raw_a"]).join(right, ["form", "raw_b"])
    return pairs.select(F.least("x", "y").alias(f"{doc_id}_a"), F.greatest("x", "y").alias(f"{doc_id}_b")).distinct()
