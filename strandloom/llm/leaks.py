"""Evaluation passages inside a training corpus, by a suffix automaton.

The words of all test items, in the one form of ``lookalikes`` and without
case, go into one generalised suffix automaton over word ids.  A document's
words stream through it; the automaton's state and length are the longest run
of words that ends here and stands in some item.  Where that length reaches
``min_words`` the items that hold the last ``min_words`` words are leaks, and
the spans can be cut out of the text where they exceed a limit of length, or
where all spans together exceed a share of the document.

Items are few against the corpus: their total length is checked and, above
``ITEM_BYTES``, they are dealt to several automata.  The documents' words are
then written once and streamed through each in turn, so that a worker holds one
automaton at a time.  An automaton is flat arrays (16 bytes a state and 8 a
mark) and small tables at the states where runs of words part: 44 MB sent and
157 MB in a worker for 8 MB of passages (0.9 M words drawn at random).

Defined results for odd input:

* null or blank texts and passages leak nothing; an item shorter than
  ``min_words`` cannot leak; items with equal words leak together;
* repeated documents are reported each for itself; repeated item rows once;
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.lookalikes import canonical
from strandloom.session import cut

MIN_WORDS = 13
#: Bytes of test passages that one automaton may hold (the docstring has its memory).
ITEM_BYTES = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text that count in comparing."""
    return _WORD.findall(canonical(text).casefold())


class Automaton:
    """Generalised suffix automaton of word sequences, in flat arrays.

    A state has one step (``word``, ``to``) in the arrays; further ones, of the
    states where runs part, are in ``more``.  Items are marked at the shortest
    states of ``min_words`` words or more, which are the only ones reported:
    ``top`` leads there from any longer state.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.length, self.link, self.word, self.to = (array("i", [x]) for x in (0, -1, -1, -1))
        self.more: dict[int, dict[int, int]] = {}
        runs = []
        for item, passage in items:
            run = array("i", [self.ids.setdefault(w, len(self.ids)) for w in words(passage)])
            if len(run) >= min_words:
                runs.append((item, run))
                last = 0
                for w in run:
                    last = self._extend(last, w)
        length = np.frombuffer(self.length, dtype=np.int32)
        link = np.frombuffer(self.link, dtype=np.int32)
        top = np.arange(len(length), dtype=np.int32)
        for at in np.argsort(length, kind="stable")[1:].tolist():
            if length[link[at]] >= min_words:
                top[at] = top[link[at]]
        self.top = array("i", top.tobytes())
        self._mark(runs)

    def _mark(self, runs: list[tuple[int, array]]) -> None:
        """Items of the reported states, as slices of one array."""
        state, item = array("i"), array("q")
        for name, run in runs:
            at = 0
            for n, w in enumerate(run):
                at = self._step(at, w)
                if n + 1 >= self.min_words:
                    state.append(self.top[at])
                    item.append(name)
        pairs = np.unique(np.rec.fromarrays([np.frombuffer(state, dtype=np.int32), np.frombuffer(item, dtype=np.int64)], names="s,i")) if state else np.rec.fromarrays([np.zeros(0, np.int32), np.zeros(0, np.int64)], names="s,i")
        ends = np.searchsorted(pairs.s, np.arange(len(self.length) + 1)).astype(np.int32)
        self.items, self.ends = array("q", np.ascontiguousarray(pairs.i).tobytes()), array("i", ends.tobytes())

    def _step(self, state: int, w: int) -> int:
        """The state after a word, -1 if there is none."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's string and w, cut out of the state it shares."""
        q = self._step(p, w)
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q])
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p != -1 and self._step(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if self._step(last, w) >= 0:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, 0), last
        while p != -1 and self._step(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, w)
        return new

    def matches(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, end word) of every stretch of words that runs of
        ``min_words`` or more of the item cover; an item's stretches do not overlap."""
        known = [self.ids.get(w, -1) for w in tokens]
        found: dict[int, list[list[int]]] = {}
        least, size, at = self.min_words, len(known), 0
        while at < size:
            if known[at] < 0:
                at += 1
                continue
            end = at
            while end < size and known[end] >= 0:
                end += 1
            if end - at >= least:  # words of no item end every match
                self._stream(known, at, end, found)
            at = end
        return [(item, a, b) for item, spans in found.items() for a, b in spans]

    def _stream(self, known: list[int], begin: int, end: int, found: dict[int, list[list[int]]]) -> None:
        word, to, more, link, lengths, least = self.word, self.to, self.more, self.link, self.length, self.min_words
        state = length = 0
        for i in range(begin, end):
            w = known[i]
            while True:
                if word[state] == w:
                    state, length = to[state], length + 1
                    break
                step = more[state].get(w, -1) if state in more else -1
                if step >= 0:
                    state, length = step, length + 1
                    break
                if not state:
                    length = 0
                    break
                state = link[state]
                length = lengths[state]
            if length < least:
                continue
            while lengths[link[state]] >= length:
                state = link[state]
            at = self.top[state]
            for item in self.items[self.ends[at] : self.ends[at + 1]]:
                spans = found.setdefault(item, [])
                if spans and spans[-1][1] > i - least:
                    spans[-1][1] = i + 1
                else:
                    spans.append([i + 1 - least, i + 1])


def _automata(items: DataFrame, item_id: str, passage: str, min_words: int) -> tuple[int, Iterator[Automaton]]:
    """The number of automata, and these one after another."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).filter("i is not null and p is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    parts = -(-total // ITEM_BYTES)
    part = F.pmod(F.xxhash64("i", "p"), F.lit(max(1, parts)))
    return parts, (Automaton(sorted((r["i"], r["p"]) for r in rows.filter(part == n).toLocalIterator()), min_words) for n in range(parts))


def _worder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["id"]].assign(words=[words(t) for t in batch["text"]])


def _scanner(held, split: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton: Automaton = held.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["words" if split else "text"]):
                tokens = text if split else words(text)
                for item, a, b in automaton.matches(tokens):
                    rows.append((doc, item, a, b, len(tokens)))
            yield pd.DataFrame(rows, columns=["doc", "item", "first_word", "end_word", "n_words"])

    return run


def leak_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS) -> DataFrame:
    """Spans of documents that stand in an item: (doc, item, first_word, end_word, n_words)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null")
    schema = "doc long, item long, first_word int, end_word int, n_words int"
    parts, automata = _automata(items, item_id, passage, min_words)
    split = parts > 1
    if split:
        docs = cut(docs.mapInPandas(_worder, "id long, words array<string>"))
    out = None
    for automaton in automata:
        spans = docs.mapInPandas(_scanner(spark.sparkContext.broadcast(automaton), split), schema)
        del automaton
        out = spans if out is None else out.unionByName(spans)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


@F.pandas_udf(T.IntegerType())
def _count_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(words(t or "")))


def quoting(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS) -> DataFrame:
    """(query_id, id): documents that quote any part of a passage, ``min_words`` words
    or more of it, or the whole of a passage that is shorter."""
    spans = leak_spans(documents, items, doc_id, text, item_id, passage, min_words).select("doc", "item")
    n_words = _count_words(F.col(passage))
    lengths = items.select(n_words.alias("n")).filter(F.col("n").between(1, min_words - 1)).distinct().collect()
    for r in sorted(lengths):
        spans = spans.unionByName(leak_spans(documents, items.filter(n_words == r.n), doc_id, text, item_id, passage, r.n).select("doc", "item"))
    return spans.select(F.col("item").alias("query_id"), F.col("doc").alias("id")).distinct()


def leaks(spans: DataFrame) -> DataFrame:
    """One row for each document and item: longest stretch, words covered, words of the document.

    Parts of an item that several automata hold are no such case: an item is in one.
    """
    size = F.col("end_word") - F.col("first_word")
    return spans.groupBy("doc", "item").agg(F.max(size).alias("longest"), F.sum(size).alias("covered"), F.max("n_words").alias("n_words"))


def _cutter(max_words: int, max_share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["id"], batch["text"], batch["spans"]):
                # Words of the canonical text, whose places are those of the spans.
                plain = canonical(text)
                folded = []  # one character can fold to several; words stay words
                for m in _WORD.finditer(plain):
                    folded += [m.span()] * max(1, len(_WORD.findall(m[0].casefold())))
                covered, gone = set(), set()
                for s in spans:
                    place = range(s["first_word"], s["end_word"])
                    covered.update(place)
                    if len(place) > max_words:
                        gone.update(place)
                if len(covered) > max_share * len(folded):
                    gone = covered
                keep, last = [], 0
                for i in sorted(gone):
                    a, b = folded[i]
                    if i - 1 not in gone:
                        keep.append(plain[last:a])
                    last = b
                out.append((doc, "".join(keep) + plain[last:] if gone else text, len(gone)))
            yield pd.DataFrame(out, columns=["doc", "text", "removed_words"])

    return run


def without_leaks(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", max_words: int = MIN_WORDS - 1, max_share: float = 0.5) -> DataFrame:
    """Documents without spans longer than ``max_words``, and without any span where
    those of all items together cover more than ``max_share`` of the words.

    By default every span that is reported is too long; the share counts where
    ``max_words`` is larger.  Documents that lose nothing keep their text
    untouched; the others come back in the one form of ``lookalikes``.
    """
    held = spans.groupBy("doc").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    joined = docs.join(held, docs["id"] == held["doc"], "left").select("id", "text", "spans")
    clean = joined.filter("spans is null").select(F.col("id").alias("doc"), "text", F.lit(0).alias("removed_words"))
    return clean.unionByName(joined.filter("spans is not null").mapInPandas(_cutter(max_words, max_share), "doc long, text string, removed_words int"))
