"""Cutting oversized items at natural boundaries by pointer doubling.

Every byte position that can open a piece has one farthest legal successor: the
last boundary of the best rank within the size limit, or the end where the rest
fits.  The successor table is squared until a jump leaves the text; the union
of what the tables 1, 2, 4, ... reach from position 0 is the set of all greedy
cuts, found in as many steps as the number of pieces has binary digits.

Ranks of a boundary, best first: the start of a non-blank line after a blank
line outside a fenced block; the start of a line; the place after a space; the
start of a character.  Pieces after the first also repeat the last ``overlap``
bytes before them, moved forward to a character start; these count neither for
the limit nor for the place of the cut.

Defined results for odd input:

* null texts fall away, blank and empty ones are one piece (0 bytes if empty);
* items up to the limit are one piece and never leave the JVM;
* a text without any boundary is cut at character starts, never inside one;
* a limit below 4 bytes is refused, as a character may take 4;
* repeated rows give repeated pieces; extra columns are ignored;
* an item is cut by one task, which takes about 20 bytes of memory for each of its
  bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 8_000, 800
PIECES = "item_table string, item_id long, block_no int, piece_no int, cut_byte long, end_byte long, from_byte long"


def _last_at(marks: np.ndarray, size: int) -> np.ndarray:
    """For each position 0..size the last mark at or before it, 0 if none."""
    at = np.zeros(size + 1, dtype=np.int32)
    at[marks] = marks
    return np.maximum.accumulate(at, out=at)


def boundaries(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Positions above 0 that may open a piece, in four ranks, best first."""
    size = raw.size
    starts = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
    starts = starts[starts < size]
    seen = np.flatnonzero((raw != 32) & (raw != 9) & (raw != 13) & (raw != 10)).astype(np.int32)
    nth = np.searchsorted(seen, starts)
    first = np.append(seen, size)[nth]
    del seen
    blank = first >= np.append(starts[1:], size)
    tick = lambda at: np.append(raw, np.uint8(0))[np.minimum(at, size)] == 96
    fence = ~blank & tick(first) & tick(first + 1) & tick(first + 2)
    outside = (np.cumsum(fence) - fence) % 2 == 0
    opens = np.flatnonzero(~blank[1:] & blank[:-1] & outside[1:]) + 1
    yield starts[opens]
    yield starts[1:]
    spaces = np.flatnonzero(raw == 32) + 1
    yield spaces[spaces < size]
    yield np.flatnonzero((raw[1:] & 0xC0) != 0x80).astype(np.int32) + 1


def cuts(text: bytes, limit: int = LIMIT) -> np.ndarray:
    """Where the pieces of ``text`` begin, 0 first."""
    raw = np.frombuffer(text, dtype=np.uint8)
    size = raw.size
    if size <= limit:
        return np.zeros(1, dtype=np.int64)
    here = np.arange(size - limit, dtype=np.int32)  # from later places the rest fits
    jump = np.full(size + 1, size, dtype=np.int32)
    best = np.zeros(here.size, dtype=np.int32)
    for marks in boundaries(raw):
        np.copyto(best, _last_at(marks, size)[limit:size], where=best <= here)
    jump[: here.size] = best
    del here, best
    reached = np.zeros(1, dtype=np.int32)
    while True:
        ahead = jump[reached]
        reached = np.union1d(reached, ahead[ahead < size])
        if jump[0] >= size:
            return reached.astype(np.int64)
        jump = jump[jump]


def _pieces(limit: int, overlap: int, with_text: bool):
    names = ["item_table", "item_id", "block_no", "piece_no", "cut_byte", "end_byte", "from_byte"] + ["text"] * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for table, item, block, text in zip(batch["item_table"], batch["item_id"], batch["block_no"], batch["text"]):
                data = text.encode("utf-8", "surrogatepass")
                at = cuts(data, limit)
                ends = np.append(at[1:], len(data))
                for i, (a, b) in enumerate(zip(at, ends)):
                    back = max(0, int(a) - overlap) if i else int(a)
                    while i and back < a and data[back] & 0xC0 == 0x80:
                        back += 1
                    own = (data[back:b].decode("utf-8", "surrogatepass"),) if with_text else ()
                    rows.append((table, item, block, i, int(a), int(b), back, *own))
                if len(rows) > 4_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False, with_text: bool = False) -> DataFrame:
    """Pieces of items (item_table, item_id, block_no, text).

    A piece spans bytes ``cut_byte`` to ``end_byte`` of its own and begins to
    repeat at ``from_byte``.  ``with_text``: each piece's text, overlap included,
    is cut where the item is, so that no text is shuffled.
    """
    if limit < 4:
        raise ValueError("limit must be at least 4 bytes")
    items = items.select("item_table", F.col("item_id").cast("long").alias("item_id"), F.col("block_no").cast("int").alias("block_no"), "text").filter(F.col("text").isNotNull())
    size = F.octet_length("text")
    large = items.filter(size > limit).mapInPandas(_pieces(limit, overlap, with_text), PIECES + ", text string" * with_text)
    if oversized_only:
        return large
    zero = F.lit(0).cast("long")
    small = items.filter(size <= limit).select("item_table", "item_id", "block_no", F.lit(0).alias("piece_no"), zero.alias("cut_byte"), size.cast("long").alias("end_byte"), zero.alias("from_byte"), *["text"] * with_text)
    return large.unionByName(small)


def session_blocks(sessions: DataFrame) -> DataFrame:
    """Text blocks of user and assistant lines."""
    rows = sessions.filter(F.col("line_type").isin("user", "assistant")).select("row_id", F.posexplode("message.content").alias("block_no", "b"))
    return rows.filter("b.type = 'text'").select(F.lit("session_messages").alias("item_table"), F.col("row_id").alias("item_id"), "block_no", F.col("b.text").alias("text"))


def symbol_bodies(emits: DataFrame) -> DataFrame:
    """Bodies of code symbols; the body ends where the symbol does."""
    return emits.select(F.lit("emits").alias("item_table"), F.col("emit_id").alias("item_id"), F.lit(0).alias("block_no"), F.col("body").alias("text"))
