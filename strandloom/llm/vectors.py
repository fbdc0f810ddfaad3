"""Most similar vectors of every vector by cross-polytope hashing.

A fast Hadamard pseudo-rotation (three rounds of sign flips and the transform)
turns unit vectors; the nearest signed axis is the hash, a few such hashes make
a bucket of a table.  In each table a vector is at home in its own bucket and
visits the next likely ones (multiprobe).  Within a bucket the residents are
compared with residents and visitors, exactly, in blocks of a matrix product,
and only the best of each vector leave it.

Sizes: the number of buckets follows the number of rows so that a bucket of an
even spread holds ``BUCKET_ROWS``.  More buckets need longer codes, which part
more of the close vectors, so the number of tables follows the length of the
code (``tables_for``).  A bucket beyond ``CELL_ROWS`` is hashed again: its mean
is taken from its rows, what is left of them is turned and hashed by functions
of their own, and a row gets a fixed number of copies however many rows the
bucket has.  This is done ``DEEPER`` times; a bucket that resists is dealt to
cells, one for each pair of its parts, in which every pair is compared, so no
row and no pair of a bucket is dropped.  ``deeper=0`` deals at once, which is
exact within a bucket and quadratic in it.  Equal vectors are one
representative before any of this and expanded at the end.

Defined results for odd input:

* null vectors, vectors of another width, with null, NaN or infinite elements,
  or all zero are unusable and have no neighbours; null ids fall away;
* lengths other than 1 do not matter; equal vectors stored twice are each a row
  of their own, at cosine 1; cosines are compared rounded to 6 digits, the
  smaller id first among equals;
* a row given twice counts once; an id given several vectors has the
  neighbours of any of them and is never its own;
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut

WIDTH = 64
#: Tables for codes that use half of the axes of one hash or less, and those that
#: each further bit of the code adds.
TABLES, TABLES_A_BIT, PROBES = 2, 0.85, 3
BUCKET_ROWS, CELL_ROWS, DEEPER = 12_000, 16_384, 2
#: Elements of a matrix product at a time.
CHUNK = 4_000_000
MILLION = 1_000_000
#: Most rows (id, rep, n) that are broadcast, and most oversized buckets with
#: their means (about 0.6 kB each); beyond it they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BUCKETS = 1_000_000, 50_000


# -- hashing ---------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        step *= 2
    return x.reshape(n, d) / np.float32(math.sqrt(d))


def tables_for(width: int, buckets: int) -> int:
    """Tables that keep the recall of links as the codes grow longer."""
    half = max(0, (width - 1).bit_length())  # bits of a hash over half of its signed axes
    bits = math.ceil(math.log2(max(1, buckets)))
    return TABLES + max(0, math.ceil(TABLES_A_BIT * (bits - half)))


class CrossPolytope:
    """Hash functions of all tables for a number of buckets a table."""

    def __init__(self, width: int, buckets: int, tables: int = TABLES, probes: int = PROBES, seed: int = 11):
        self.width, self.tables, self.probes = width, tables, probes
        self.padded = 1 << max(0, (width - 1).bit_length())
        self.values, left = [], 1 << max(0, math.ceil(math.log2(max(1, buckets))))
        while left > 1:  # values of a hash: signed axes, at most all of them
            self.values.append(min(left, 2 * self.padded))
            left //= self.values[-1]
        rng = np.random.default_rng(seed)
        self.signs = [[[rng.choice(np.array([-1, 1], dtype=np.float32), self.padded) for _ in range(3)] for _ in self.values] for _ in range(tables)]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers, rows by tables * probes; a probe that adds nothing is -1."""
        n = len(unit)
        if not self.values:
            return np.zeros((n, 1), dtype=np.int64)
        x = np.zeros((n, self.padded), dtype=np.float32)
        x[:, : self.width] = unit
        out = np.full((n, self.tables * self.probes), -1, dtype=np.int64)
        for t in range(self.tables):
            code = np.zeros(n, dtype=np.int64)
            swaps, losses = [], []
            for signs, count in zip(self.signs[t], self.values):
                y = x
                for s in signs:
                    y = hadamard(y * s)
                y = y[:, : count // 2]
                size = np.abs(y)
                wide = min(self.probes, size.shape[1])
                near = np.argsort(-size, axis=1, kind="stable")[:, :wide]
                best = np.take_along_axis(size, near, 1)
                value = near * 2 + (np.take_along_axis(y, near, 1) > 0)
                code = code * count + value[:, 0]
                swaps = [s * count for s in swaps]
                for i in range(1, wide):
                    swaps.append((value[:, i] - value[:, 0]).astype(np.int64))
                    losses.append(best[:, 0] ** 2 - best[:, i] ** 2)
                if count == 2:  # one axis: the other sign
                    swaps.append(1 - 2 * value[:, 0].astype(np.int64))
                    losses.append((2 * best[:, 0]) ** 2)
            base = np.int64(t) << np.int64(48)
            out[:, t * self.probes] = base | code
            if swaps and self.probes > 1:
                order = np.argsort(np.stack(losses, 1), axis=1, kind="stable")[:, : self.probes - 1]
                moved = code[:, None] + np.take_along_axis(np.stack(swaps, 1), order, 1)
                out[:, t * self.probes + 1 : t * self.probes + 1 + moved.shape[1]] = base | moved
        return out


# -- rows and cells --------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of one width as float64; nulls inside become NaN."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which rows are usable."""
    fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    rows = np.where(fine[:, None], rows, 0)
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)  # no overflow in the squares
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300), fine


def wide_rows(df: DataFrame, vec_id: str, vector: str, width: int) -> DataFrame:
    """(id, v): rows of the right width."""
    return df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == width))


def _finger(v: str):
    return [F.xxhash64(v).alias("h1"), F.xxhash64(v, F.lit(1)).alias("h2")]


@lru_cache(maxsize=64)
def _finer(width: int, bits: int, probes: int, level: int) -> CrossPolytope:
    return CrossPolytope(width, 1 << bits, tables_for(width, 1 << bits), probes, seed=100 + level)


def _mixed(bucket: int, code: np.ndarray) -> np.ndarray:
    """Numbers of the buckets that ``bucket`` is hashed into again."""
    x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(bucket * 0xC2B2AE3D27D4EB4F % (1 << 64))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64)


SPREAD = "bucket long, home boolean, rep long, n long, ask boolean, v array<float>"


class Cells:
    """The buckets of a table of vectors, ready for work within each.

    ``buckets`` follow the number of rows and ``tables`` the number of buckets if not
    given; all other parameters are the module's constants by default.  ``asked``: a condition on ``id``;
    only rows that meet it are asked for, all rows are compared with them.
    """

    def __init__(self, df: DataFrame, vec_id: str, vector: str, width: int = WIDTH, tables: int | None = None, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS, cell_rows: int = CELL_ROWS, deeper: int = DEEPER, asked: Column | None = None, buckets: int | None = None):
        self.spark, self.width, self.cell_rows, self.bucket_rows, self.asked = df.sparkSession, width, cell_rows, bucket_rows, asked
        self.base = wide_rows(df, vec_id, vector, width)
        rows = self.base.count()
        buckets = buckets or max(1, rows * probes // bucket_rows)
        self.hashing = CrossPolytope(width, buckets, tables or tables_for(width, buckets), probes)
        self._copies = self._find_copies()
        #: Representatives (rep, n, ask, v): one row for each different vector.
        self.reps = self._representatives()
        self.spread = self._spread(deeper) if rows > cell_rows else self._dealt(self._hashed(self.reps), None)

    def _hashed(self, rows: DataFrame, brief: bool = False) -> DataFrame:
        """``rows`` in their buckets, as ``SPREAD``; ``brief``: the buckets only."""
        hashing, width = self.hashing, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, fine = _unit(_matrix(batch["v"], width))
                codes = hashing.codes(unit)
                row = np.repeat(np.arange(len(unit)), codes.shape[1])
                home = np.tile(np.arange(codes.shape[1]) % (hashing.probes if hashing.values else 1) == 0, len(unit))
                keep = fine[row] & (codes.ravel() >= 0)
                yield from _copied(batch, row[keep], codes.ravel()[keep], home[keep], brief)

        return rows.select("rep", "n", "ask", "v").mapInArrow(run, "bucket long" if brief else SPREAD)

    def _over(self, rows: DataFrame) -> tuple[DataFrame, int] | None:
        """(bucket, size) of oversized buckets and their number; None for none."""
        over = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > self.cell_rows))
        many = over.count()
        return (over, many) if many else None

    def _centres(self, rows: DataFrame, over: DataFrame, many: int) -> DataFrame:
        """(bucket, size, centre): the mean of the unit rows of each oversized bucket."""
        width = self.width

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, _ = _unit(_matrix(batch["v"], width))
                names, at = np.unique(batch["bucket"].to_numpy(), return_inverse=True)
                total = np.zeros((len(names), width))
                np.add.at(total, at, unit)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(total), pa.list_(pa.float64()))], ["bucket", "s"])

        picked = rows.join(self._small(over, many), "bucket", "left_semi").select("bucket", "v")
        total = picked.mapInArrow(sums, "bucket long, s array<double>").groupBy("bucket").agg(F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s"))
        return self._small(cut(total.join(over, "bucket").select("bucket", "size", F.transform("s", lambda x: x / F.col("size")).alias("centre"))), many)

    def _small(self, df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_BUCKETS else df

    def _hash_again(self, rows: DataFrame, crowded: DataFrame, level: int) -> DataFrame:
        """Rows of oversized buckets hashed again by what parts them from the mean."""
        width, probes, bucket_rows = self.width, self.hashing.probes, self.bucket_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                crowded = batch["centre"].is_valid().to_numpy(zero_copy_only=False)
                rest = batch.filter(pa.array(~crowded))
                yield from _copied(rest, np.arange(len(rest)), rest["bucket"].to_numpy(), rest["home"].to_numpy(zero_copy_only=False), False)
                bucket = batch["bucket"].to_numpy()
                for name in np.unique(bucket[crowded]):
                    at = np.flatnonzero(crowded & (bucket == name))
                    part = batch.take(pa.array(at))
                    centre = np.array(part["centre"][0].as_py())
                    bits = max(1, math.ceil(math.log2(part["size"][0].as_py() * probes / bucket_rows + 1)))
                    hashing = _finer(width, bits, probes, level)
                    unit, _ = _unit(_matrix(part["v"], width))
                    codes = hashing.codes(_unit(unit - centre)[0])
                    row = np.repeat(np.arange(len(at)), codes.shape[1])
                    home = np.tile(np.arange(codes.shape[1]) % probes == 0, len(at))
                    keep = codes.ravel() >= 0
                    yield from _copied(part, row[keep], _mixed(int(name), codes.ravel()[keep]), home[keep], False)

        return rows.join(crowded, "bucket", "left").mapInArrow(run, SPREAD)

    def _spread(self, deeper: int) -> DataFrame:
        rows, level = self._hashed(self.reps), 0
        over = self._over(self._hashed(self.reps, brief=True))
        while over and level < deeper:
            rows = self._hash_again(rows, self._centres(rows, *over), level)
            over, level = self._over(rows), level + 1
        return self._dealt(rows, over)

    def _dealt(self, rows: DataFrame, over: tuple[DataFrame, int] | None) -> DataFrame:
        """(bucket, a, b, own, ...): rows in their cells.

        ``a`` and ``b`` are the parts of the bucket that the cell compares and
        ``own`` is the row's part.
        """
        zero = F.lit(0)
        if not over:
            return rows.select("bucket", zero.alias("a"), zero.alias("b"), zero.alias("own"), "home", "rep", "n", "ask", "v")
        parts = F.coalesce(F.ceil(F.col("size") * 1.1 / self.cell_rows), F.lit(1)).cast("int")
        rows = rows.join(self._small(*over), "bucket", "left").withColumn("parts", parts)
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("parts") - 1)))
        return rows.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "home", "rep", "n", "ask", "v")

    def within(self, work: Callable[..., pa.Table], schema: str) -> DataFrame:
        """``work(unit, reps, copies, home, own, ask)`` on every cell, rows by ascending rep."""
        width = self.width

        def run(cell: pa.Table) -> pa.Table:
            cell = cell.combine_chunks()
            reps = cell["rep"].to_numpy()
            home = cell["home"].to_numpy(zero_copy_only=False)
            order = np.lexsort((~home, reps))
            unit, _ = _unit(_matrix(cell["v"].combine_chunks(), width))
            twice = np.flatnonzero(reps[order][1:] == reps[order][:-1])
            if len(twice):  # rows given twice, or here by two ways: one of each id and vector
                _, first = np.unique(np.column_stack((reps[order].astype(np.float64), unit[order])), axis=0, return_index=True)
                order = order[np.sort(first)]
            own = None if cell["a"][0].as_py() == cell["b"][0].as_py() else cell["own"].to_numpy()[order]
            return work(unit[order], reps[order], cell["n"].to_numpy()[order], home[order], own, cell["ask"].to_numpy(zero_copy_only=False)[order])

        return self.spread.groupBy("bucket", "a", "b").applyInArrow(run, schema)

    def _find_copies(self) -> DataFrame:
        """(id, rep, n, ask) of all usable rows whose vector is stored more than once.

        Fingerprints of 128 bits stand for the vectors, so that no vector is
        shuffled and a vector with a third of all rows is counted on the map side.
        """
        finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        fingers = self.base.select("id", *_finger("v"))
        ends = fingers.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        several = ends.filter("last > rep").select("h1", "h2", "rep")
        rows = self.base.filter(finite & F.exists("v", lambda x: x != 0)).select("id", *_finger("v"))
        rows = rows.join(several, ["h1", "h2"]).select("id", "rep").distinct()
        sizes = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(self._asks()), F.lit(False)).alias("ask"))
        return cut(rows.join(sizes, "rep").select("id", "rep", "n", "ask"))

    def _asks(self) -> Column:
        return F.lit(True) if self.asked is None else F.coalesce(self.asked, F.lit(False))

    def _representatives(self) -> DataFrame:
        """Rows that stand for their vector: all but the later copies.

        The copies are broadcast where their counted number allows, else the
        rows are joined by shuffle.
        """
        marks = self._copies.select(F.col("id").alias("copy"), F.col("rep").alias("of"), "n", "ask")
        if self._copies.count() <= BROADCAST_ROWS:
            marks = F.broadcast(marks)
        rows = self.base.join(marks, F.col("id") == F.col("copy"), "left").filter("copy is null or copy = of")
        return rows.select(F.col("id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce(F.col("ask"), self._asks()).alias("ask"), "v")

    def copies(self) -> DataFrame:
        """(id, rep) of all rows whose vector is stored more than once."""
        return self._copies.select("id", "rep")


def _copied(batch: pa.RecordBatch, row: np.ndarray, bucket: np.ndarray, home: np.ndarray, brief: bool) -> Iterator[pa.RecordBatch]:
    """Copies of a batch's rows for their buckets, a bounded number at a time."""
    if brief:
        yield pa.RecordBatch.from_arrays([pa.array(bucket)], ["bucket"])
        return
    for s in range(0, len(row), 20_000):
        e = slice(s, s + 20_000)
        picked = batch.take(pa.array(row[e]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[e]), pa.array(home[e]), picked["rep"], picked["n"], picked["ask"], picked["v"]], ["bucket", "home", "rep", "n", "ask", "v"])


def _close(unit: np.ndarray, reps: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows, columns, cosines) of the rows ``left`` against ``right`` that hold
    all pairs of at least ``least``; cosines in double precision, -2 for pairs that
    do not count.

    A product in single precision finds the rows and columns worth it.
    """
    small, m = unit.astype(np.float32), len(right)
    across = np.ascontiguousarray(small[right].T)
    place = np.full(len(unit), -1)
    place[right] = np.arange(m)
    repeated = bool((reps[1:] == reps[:-1]).any())
    step = max(1, CHUNK // max(1, m))
    for s in range(0, len(left), step):
        rows = left[s : s + step]
        rough = small[rows] @ across
        itself = place[rows]
        rough[np.flatnonzero(itself >= 0), itself[itself >= 0]] = -2
        if own is not None:
            rough[own[rows][:, None] == own[right][None, :]] = -2
        if repeated:
            rough[reps[rows][:, None] == reps[right][None, :]] = -2
        hit = rough >= np.float32(least - 1e-4)
        some = hit.any(axis=1)
        if not some.any():
            continue
        hit = hit[some]
        cols = np.flatnonzero(hit.any(axis=0))
        rows, hit = rows[some], hit[:, cols]
        fine = unit[rows] @ unit[right[cols]].T
        fine[~hit] = -2
        yield rows, right[cols], fine


NEIGHBOURS = "rep long, near array<struct<c:int,id:long>>"


def _nearest(k: int, least: float, asked: bool):
    kind = pa.list_(pa.struct([("c", pa.int32()), ("id", pa.int64())]))

    def work(unit: np.ndarray, reps: np.ndarray, copies: np.ndarray, home: np.ndarray, own: np.ndarray | None, ask: np.ndarray) -> pa.Table:
        names, sizes, cos, ids, guests = [], [], [], [], []

        def best(rows: np.ndarray, cols: np.ndarray, micro: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row, millionths, column) of the k best of each row."""
            # One number that orders by cosine, then by the smaller id (columns ascend by id).
            rank = np.where(micro >= 0, micro * len(unit) + (len(unit) - 1 - cols)[None, :], -1)
            if rank.shape[1] > k:
                at = np.argpartition(-rank, k - 1, axis=1)[:, :k]
            else:
                at = np.broadcast_to(np.arange(rank.shape[1]), rank.shape)
            got = np.take_along_axis(micro, at, 1)
            good = got >= 0
            return np.repeat(rows, good.sum(axis=1)), got[good], cols[at][good]

        def put(row: np.ndarray, micro: np.ndarray, column: np.ndarray) -> None:
            """Lists of rows, each row's items being neighbours in the arrays."""
            firsts = np.flatnonzero(np.diff(row, prepend=-1))
            names.append(reps[row[firsts]])
            sizes.append(np.diff(firsts, append=len(row)))
            cos.append(micro)
            ids.append(reps[column])

        def millionths(fine: np.ndarray) -> np.ndarray:
            micro = np.rint(fine * MILLION).astype(np.int64)
            micro[micro < round(least * MILLION)] = -1
            return micro

        here, everyone = np.flatnonzero(home), np.arange(len(unit))
        if asked:  # lists of the asked rows only, whether they live here or visit
            for left, right in ((np.flatnonzero(home & ask), everyone), (np.flatnonzero(~home & ask), here)):
                for rows, cols, fine in _close(unit, reps, left, right, own, least) if len(left) and len(right) else ():
                    put(*best(rows, cols, millionths(fine)))
        else:
            for rows, cols, fine in _close(unit, reps, here, everyone, own, least) if len(here) else ():
                micro = millionths(fine)
                put(*best(rows, cols, micro))
                visiting = np.flatnonzero(~home[cols])
                if len(visiting):
                    guests.append(best(cols[visiting], rows, np.ascontiguousarray(micro[:, visiting].T)))
            if guests:  # the best of each guest over all blocks
                row, micro, column = (np.concatenate(x) for x in zip(*guests))
                order = np.lexsort((column, -micro, row))
                row = row[order]
                firsts = np.flatnonzero(np.diff(row, prepend=-1))
                nth = np.arange(len(row)) - np.repeat(firsts, np.diff(firsts, append=len(row)))
                put(row[nth < k], micro[order][nth < k], column[order][nth < k])
        if not sum(map(len, cos)):
            return pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], kind)})
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(cos).astype(np.int32)), pa.array(np.concatenate(ids))], ["c", "id"])
        return pa.table({"rep": pa.array(np.concatenate(names)), "near": pa.ListArray.from_arrays(pa.array(ends), items)})

    return work


def nearest_reps(cells: Cells, k: int, least: float) -> DataFrame:
    """(rep, near): the k most similar other representatives with cosine of at
    least ``least``, as (c in millionths, id), best first."""
    found = cells.within(_nearest(k, least, cells.asked is not None), NEIGHBOURS)
    merged = found.groupBy("rep").agg(F.flatten(F.collect_list("near")).alias("near"))
    ordered = F.transform("near", lambda x: F.struct((-x["c"]).alias("c"), x["id"].alias("id")))
    best = F.slice(F.array_sort(F.array_distinct(ordered)), 1, k)
    return merged.select("rep", F.transform(best, lambda x: F.struct((-x["c"]).alias("c"), x["id"].alias("id"))).alias("near"))


def nearest(df: DataFrame, vec_id: str, vector: str, k: int = 5, least: float = -1.0, asked: Column | None = None, **sizes) -> DataFrame:
    """(id, other, cosine): the k most similar other rows of every row, or of
    those that meet ``asked``, a condition on ``id``.

    Copies of a vector are rows of their own.  For a representative the best
    k + 1 rows are kept, as one of them may be the row itself.
    """
    cells = Cells(df, vec_id, vector, asked=asked, **sizes)
    near = cut(nearest_reps(cells, k, least))  # read twice below
    copies = cells.copies()
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    few = copies.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    links = near.select("rep", F.explode("near").alias("x")).select("rep", "x.c", F.col("x.id").alias("to"))
    others = links.join(few.withColumnRenamed("rep", "to"), "to", "left").select("rep", "c", F.explode(F.coalesce("ids", F.array("to"))).alias("id"))
    own = few.select("rep", F.lit(MILLION).alias("c"), F.explode("ids").alias("id"))
    item = F.struct((-F.col("c")).alias("c"), "id")
    lists = others.unionByName(own).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(item)), 1, k + 1).alias("near"))
    # A representative may stand for a third of all rows: an inner join, of which either side can be split.
    rows = copies.join(lists, "rep").select("id", "near").unionByName(lists.join(few, "rep", "left_anti").select(F.col("rep").alias("id"), "near"))
    rows = rows if asked is None else rows.filter(asked)
    rows = rows.select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return rows.select("id", F.explode("near").alias("x")).select("id", F.col("x.id").alias("other"), (-F.col("x.c") / MILLION).alias("cosine"))


def similar_pairs(neighbours: DataFrame, least: float, name: str = "vec_id") -> DataFrame:
    """Pairs (a < b) of which one is among the other's neighbours."""
    return neighbours.filter(F.col("cosine") >= least).select(F.least("id", "other").alias(f"{name}_a"), F.greatest("id", "other").alias(f"{name}_b")).distinct()
