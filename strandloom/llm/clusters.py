"""Clusters of mutually similar records by power-iteration spectral clustering.

1.  Cells of the cross-polytope hashing (``vectors``) give the affinities of the
    vectors that meet in them: their cosines, where these are ``least`` or more.
    A vector has a place in each of its cells.  Places are the nodes of the
    affinity graph, joined by the affinities in a cell, and places of one vector
    are joined as well, so no link found in a cell is lost.
2.  The affinities are normalised to a lazy random walk (row sums 1), and
    several vectors with pseudo-random starts are iterated together.  Their
    limit is constant on whatever links connect, the mean of the starts weighted
    with the walk's stationary mass, and differs between unconnected parts.
    Plain steps would need the square of a part's diameter, so each few steps
    are followed by a coarse level: a node goes to the nearest, in the vectors'
    values, of the centres its links offer, nodes of one centre become one node
    with their mass and mean, and the walk goes on between those.  That keeps
    the weighted mean of every part, hence the limit, and ends where no link
    crosses; then the values are handed down again.
    The walk goes to its limit within each cell first, over the vectors and all
    their affinities.  The vectors on one point of a cell's limit are a node of
    the walk between the cells, with their mass and mean; two nodes are as close
    as the vectors that both hold, weighted with those vectors' mean affinity.
    So what leaves a cell follows the rows and not the links.
3.  k-means on the limit: its points coincide within a cluster, so the distinct
    points are the centres, and a node belongs to the centre it lies on.  The
    embedding alone tells clusters apart, within a cell and between cells: other
    values give other clusters.
4.  Sums of unit vectors give each cluster's size and cohesion (mean cosine of
    its pairs) and each member's mean affinity, which ranks the members.

Defined results for odd input: as in ``vectors``; unusable rows are in no
cluster; copies are members, each row for itself; groups below ``min_size``
are no clusters; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.vectors import Cells, _close, _matrix, _unit
from strandloom.session import cut

DIMENSIONS, ITERATIONS = 4, 2
#: Bytes of a cell's links that are held; the links beyond are computed again at each
#: step, so that a cell in which all are linked needs no more memory.
HELD = 160_000_000
#: Affinity of linked vectors that are not similar (``least`` of 0 or less).
LEAST_AFFINITY = 1e-6
LOCAL = "rep long, root long, links int, affinity double, n long"


def starts(ids: np.ndarray, dimensions: int) -> np.ndarray:
    """The values that ``_starts`` gives the ids: Spark's ``xxhash64`` of a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        first = np.full(len(ids), 42, dtype=np.uint64) + p5 + np.uint64(8)
        first = mixed(turn(first ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        out = [mixed(turn((first + p5 + np.uint64(4)) ^ (np.full(len(ids), j, dtype=np.uint64) * p1), 23) * p2 + p3) for j in range(dimensions)]
    return np.stack([np.mod(x.view(np.int64), 9_007_199_254_740_881) / 4_503_599_627_370_440.5 - 1 for x in out], axis=1)


class Links:
    """A symmetric matrix of affinities between ``size`` nodes.

    ``i``, ``j``, ``w``: single links; ``blocks`` gives the others, at each call, as
    blocks (rows, columns, affinities with 0 for no link); ``total``: the sum of
    each node's affinities.
    """

    def __init__(self, size: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, blocks: Callable[[], Iterable] = tuple, total: np.ndarray | None = None):
        self.size, self.i, self.j, self.w, self.blocks = size, i, j, w, blocks
        self.total = self.times(np.ones((size, 1)))[:, 0] if total is None else total

    def times(self, x: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(self.i, self.w * column[self.j], self.size) for column in x.T], axis=1).astype(float)
        for rows, cols, w in self.blocks():
            out[rows] += w @ x[cols]
        return out

    def centres(self, y: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The centre of each node: the way there leads to the nearest in ``y`` of the
        neighbours of lower rank, and on from it; a node without one is a centre."""
        best, to = np.full(self.size, np.inf), np.arange(self.size)
        below = rank[self.j] < rank[self.i]
        i, j = self.i[below], self.j[below]
        away = sum((c[i] - c[j]) ** 2 for c in y.T)
        np.minimum.at(best, i, away)
        nearest = away == best[i]
        to[i[nearest]] = j[nearest]
        for rows, cols, w in self.blocks():
            away = sum((c[rows][:, None] - c[cols][None, :]) ** 2 for c in y.T)
            away[(w == 0) | (rank[cols][None, :] >= rank[rows][:, None])] = np.inf
            at = away.argmin(axis=1)
            got = away[np.arange(len(rows)), at]
            better = got < best[rows]
            best[rows[better]], to[rows[better]] = got[better], cols[at[better]]
        while (to != to[to]).any():
            to = to[to]
        return to

    def merged(self, label: np.ndarray, size: int) -> Links:
        """The affinities between the nodes that ``label`` (0 to ``size`` - 1) makes one."""
        keys, sums = [label[self.i] * size + label[self.j]], [self.w]
        for rows, cols, w in self.blocks():
            for _ in range(2):  # columns, then rows, of one label
                order = np.argsort(label[cols], kind="stable")
                named = label[cols[order]]
                firsts = np.flatnonzero(np.diff(named, prepend=-1))
                w, rows, cols = np.add.reduceat(w[:, order], firsts, axis=1).T, cols[order][firsts], rows
            at, to = np.nonzero(w)
            keys.append(label[rows[at]] * size + label[cols[to]])
            sums.append(w[at, to])
        key, w = np.concatenate(keys), np.concatenate(sums)
        across = key // size != key % size
        key, w = key[across], w[across]
        key, at = np.unique(np.concatenate((key, key % size * size + key // size)), return_inverse=True)
        return Links(size, key // size, key % size, np.bincount(at, np.concatenate((w, w)) / 2, len(key)))


def walk_limit(links: Links, y: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """The limit of the lazy walk over ``links`` from ``y``, by steps and coarse levels as in ``embed``."""
    mass, at, level = 1 + 2 * links.total[:, None], np.arange(links.size), 0
    while links.total.any():
        kept = mass - links.total[:, None]
        for _ in range(iterations):
            y = (kept * y + links.times(y)) / mass
        rank = np.random.default_rng(level).permutation(links.size)
        centres, label = np.unique(links.centres(y, rank), return_inverse=True)
        total = np.bincount(label, mass[:, 0], len(centres))[:, None]
        y = np.stack([np.bincount(label, mass[:, 0] * c, len(centres)) for c in y.T], axis=1) / total
        links, mass, at, level = links.merged(label, len(centres)), total, label[at], level + 1
    return y[at]


def local_groups(y: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each row the first row on its point of the limit ``y``; rows that are not
    ``linked`` are on their own."""
    root = np.arange(len(y))
    if len(linked):
        _, first, point = np.unique(y[linked], axis=0, return_index=True, return_inverse=True)
        root[linked] = linked[first[point.ravel()]]
    return root


def _groups(least: float, dimensions: int, iterations: int):
    def work(unit: np.ndarray, reps: np.ndarray, copies: np.ndarray, home: np.ndarray, own: np.ndarray | None, ask: np.ndarray) -> pa.Table:
        m = len(reps)

        def computed(left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for rows, cols, fine in _close(unit, reps, left, np.arange(m), own, least) if len(left) else ():
                yield rows, cols, np.where(fine >= least, fine if least >= LEAST_AFFINITY else np.maximum(fine, LEAST_AFFINITY), 0)

        def unpacked() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for rows, cols, packed, values in dense:
                w = np.zeros(len(rows) * len(cols))
                w[np.unpackbits(packed, count=len(w)).view(bool)] = values
                yield rows, cols, w.reshape(len(rows), len(cols))

        def sides(rows: np.ndarray, cols: np.ndarray, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            guests = np.flatnonzero(~home[cols])  # a resident's link to a guest is the guest's link too
            return [(rows, cols, w)] + ([(cols[guests], rows, w[:, guests].T)] if len(guests) else [])

        here = np.flatnonzero(home)
        count, affinity = np.zeros(m, dtype=np.int64), np.zeros(m)
        single, dense, room, rest = [[np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]], [], HELD, here[:0]
        for rows, cols, w in computed(here):
            both = sides(rows, cols, w)
            for i, _, x in both:
                count[i] += np.count_nonzero(x, axis=1)
                affinity[i] += x.sum(axis=1)
            found = np.count_nonzero(w)
            thin = 8 * found < w.size
            room -= 48 * found if thin else 4 * found + w.size // 8
            if room < 0:  # from here on nothing is held
                rest = rest if len(rest) else here[here >= rows[0]]
            elif thin:
                for i, j, x in both:
                    at, to = np.nonzero(x)
                    single.append([i[at], j[to], x[at, to]])
            else:
                dense.append((rows, cols, np.packbits(w != 0), w[w != 0].astype(np.float32)))
        links = Links(m, *(np.concatenate(x) for x in zip(*single)), blocks=lambda: (side for block in chain(unpacked(), computed(rest)) for side in sides(*block)), total=affinity)
        linked = np.flatnonzero(count)
        root = local_groups(walk_limit(links, starts(reps, dimensions), iterations), linked)
        keep = (count > 0) | (copies > 1)
        return pa.table(
            {"rep": pa.array(reps[keep]), "root": pa.array(reps[root[keep]]), "links": pa.array(count[keep].astype(np.int32)), "affinity": pa.array(affinity[keep]), "n": pa.array(copies[keep])}
        )

    return work


def _affinity_graph(found: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (rep, node, n), nodes (node, mass, y) with the limit within their
    cells, and symmetric edges (a, b, w) between nodes."""
    held = F.collect_list(F.struct("root", (2 * F.col("affinity") + 1).alias("mass")))
    by_rep = found.groupBy("rep").agg(held.alias("held"), F.max("n").alias("n"), (F.sum("affinity") / F.greatest(F.lit(1), F.sum("links"))).alias("close"))
    members = cut(by_rep.select("rep", F.array_min("held.root").alias("node"), "n", "held", "close"))
    parts = members.select(F.col("rep").alias("node"), F.explode("held").alias("h")).select("h.root", "h.mass", *[y.alias(f"y{j}") for j, y in enumerate(_starts(dimensions))])
    sums = parts.groupBy("root").agg(F.sum("mass").alias("mass"), *[F.sum(F.col("mass") * F.col(f"y{j}")).alias(f"y{j}") for j in range(dimensions)])
    nodes = sums.select(F.col("root").alias("node"), "mass", F.array(*[F.col(f"y{j}") / F.col("mass") for j in range(dimensions)]).alias("y"))
    roots = F.array_distinct("held.root")
    pairs = members.filter(F.size(roots) > 1).select("node", F.explode(roots).alias("to"), "close").filter("to <> node")
    half = pairs.groupBy("node", "to").agg(F.sum("close").alias("w"))
    edges = half.select(F.col("node").alias("a"), F.col("to").alias("b"), "w").unionByName(half.select(F.col("to").alias("a"), F.col("node").alias("b"), "w"))
    return members, nodes, edges.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _starts(dimensions: int) -> list:
    """Pseudo-random values of a node between -1 and 1, one for each vector."""
    return [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(9_007_199_254_740_881)) / 4_503_599_627_370_440.5 - 1 for j in range(dimensions)]


def _joined(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, to, mass, y): nodes that have edges, with these in ``to``.

    ``mass`` is what the walk's limit weights a node with: its own weight (that
    of its edges and 1 before any were merged) and that of its edges.
    """
    return edges.groupBy("a").agg(F.collect_list(F.struct("b", "w")).alias("to")).join(nodes, F.col("a") == F.col("node")).select("node", "to", "mass", "y")


def _total(to: str) -> Column:
    return F.aggregate(to, F.lit(0.0), lambda s, t: s + t["w"])


def _walk(state: DataFrame, dimensions: int, iterations: int) -> DataFrame:
    """``iterations`` steps of the normalised walk.

    A row carries its node's edges, so that a step is one shuffle: messages to
    the neighbours and the row itself meet at the node.
    """
    edge_type = state.schema["to"].dataType
    ys = [f"y{j}" for j in range(dimensions)]
    for _ in range(iterations):
        kept = F.col("mass") - _total("to")
        own = F.struct("node", "to", "mass", *[(F.col("y")[j] * kept).alias(y) for j, y in enumerate(ys)])
        nothing = [F.lit(None).cast(edge_type).alias("to"), F.lit(None).cast("double").alias("mass")]
        sent = F.transform("to", lambda t: F.struct(t["b"].alias("node"), *nothing, *[(F.col("y")[j] * t["w"]).alias(y) for j, y in enumerate(ys)]))
        met = _mail(state, own, sent).groupBy("node").agg(F.first("to", ignorenulls=True).alias("to"), F.max("mass").alias("mass"), *[F.sum(y).alias(y) for y in ys])
        state = met.select("node", "to", "mass", F.array(*[F.col(y) / F.col("mass") for y in ys]).alias("y"))
    return state


def _mail(rows: DataFrame, own, sent) -> DataFrame:
    """Each row's own message and those to its neighbours, from one pass over the rows."""
    return rows.select(F.explode(F.concat(F.array(own), sent)).alias("m")).select("m.*")


def _nearest_centre(state: DataFrame, level: int) -> DataFrame:
    """(node, to, mass, y, label): the nearest in ``y`` of the centres that the
    links offer, these being the neighbours of lower rank; a node without one is a
    centre.  Ranks are drawn anew at each level, so that chains fall apart evenly."""
    rank = lambda c: F.xxhash64(c, F.lit(level))
    edge_type = state.schema["to"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    offer = F.struct(F.col("node").alias("label"), "y")
    own = F.struct("node", "to", "mass", "y", none("struct<label:bigint,y:array<double>>").alias("offer"))
    below = F.filter("to", lambda t: rank(t["b"]) > rank(F.col("node")))
    sent = F.transform(below, lambda t: F.struct(t["b"].alias("node"), none(edge_type).alias("to"), none("double").alias("mass"), none("array<double>").alias("y"), offer.alias("offer")))
    met = _mail(state, own, sent).groupBy("node").agg(F.first("to", ignorenulls=True).alias("to"), F.max("mass").alias("mass"), F.first("y", ignorenulls=True).alias("y"), F.collect_list("offer").alias("offers"))
    away = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, x: s + x)
    ranked = F.transform("offers", lambda o: F.struct(F.round(away(F.col("y"), o["y"]), 12).alias("d"), o["label"].alias("label")))
    return met.select("node", "to", "mass", "y", F.coalesce(F.array_min(ranked)["label"], F.col("node")).alias("label"))


def embed(nodes: DataFrame, edges: DataFrame, dimensions: int = DIMENSIONS, iterations: int = ITERATIONS) -> DataFrame:
    """(node, y): the limit of the walk on each node.

    ``nodes``: (node), or (node, mass, y) where a walk went before: their mass and
    values; ``edges``: (a, b, w), both directions of each.
    """
    if "y" not in nodes.columns:
        nodes = nodes.select("node", F.lit(1.0).alias("mass"), F.array(*_starts(dimensions)).alias("y"))
    weight = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("total"))
    start = nodes.join(weight, "node", "left").select("node", (2 * F.coalesce("total", F.lit(0.0)) + F.col("mass")).alias("mass"), "y")
    first, moves = cut(start), []
    state = cut(_joined(first, edges))
    while not state.isEmpty():
        placed = cut(_nearest_centre(_walk(state, dimensions, iterations), len(moves)))
        merged = placed.groupBy(F.col("label").alias("node")).agg(F.sum("mass").alias("mass"), *[(F.sum(F.col("mass") * F.col("y")[j])).alias(f"y{j}") for j in range(dimensions)])
        merged = cut(merged.select("node", "mass", F.array(*[F.col(f"y{j}") / F.col("mass") for j in range(dimensions)]).alias("y")))
        to_label = placed.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        links = placed.select("label", F.explode("to").alias("t")).select("label", "t.b", "t.w").join(to_label, "b").filter("label <> label_b")
        moves.append((placed.select("node", "label"), merged.select("node", "y")))
        state = cut(_joined(merged, links.groupBy(F.col("label").alias("a"), F.col("label_b").alias("b")).agg(F.sum("w").alias("w"))))
    # Values of the coarsest level that a node took part in, handed down.
    below = None
    for move, values in reversed(moves):
        if below is not None:
            deeper = below.select("node", F.col("y").alias("last"))
            values = values.join(deeper, "node", "left").select("node", F.coalesce("last", "y").alias("y"))
        below = move.join(values.select(F.col("node").alias("label"), "y"), "label").select("node", "y")
    if below is None:
        return first.select("node", "y")
    return first.join(below.select("node", F.col("y").alias("last")), "node", "left").select("node", F.coalesce("last", "y").alias("y"))


def clusters(df: DataFrame, vec_id: str, vector: str, least: float, min_size: int = 3, dimensions: int = DIMENSIONS, iterations: int = ITERATIONS, **sizes) -> DataFrame:
    """(cluster_id, id): members of clusters of at least ``min_size``; the id of
    a cluster is its smallest member."""
    cells = Cells(df, vec_id, vector, **sizes)
    members, nodes, edges = _affinity_graph(cells.within(_groups(least, dimensions, iterations), LOCAL), dimensions)
    points = embed(nodes, cut(edges), dimensions, iterations)
    placed = cut(members.select("rep", "node", "n").join(points, "node").select("rep", F.col("y").alias("centre"), "n"))
    sized = placed.groupBy("centre").agg(F.min("rep").alias("cluster_id"), F.sum("n").alias("size")).filter(F.col("size") >= min_size)
    kept = placed.join(sized, "centre").select("cluster_id", "rep", "n")
    # Only representatives of copies have rows besides their own.
    others = cells.copies().filter("id <> rep").join(kept.filter("n > 1").select("cluster_id", "rep"), "rep").select("cluster_id", "id")
    return kept.select("cluster_id", F.col("rep").alias("id")).unionByName(others)


def describe(members: DataFrame, df: DataFrame, vec_id: str, vector: str, typical: int = 3, width: int = 64) -> DataFrame:
    """(cluster_id, members, cohesion, typical): size, mean cosine of all pairs
    (from the sum of unit vectors, so no pairs are formed) and the ids of the
    members with the highest mean cosine to the others."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = _unit(_matrix(batch["v"], width))
            names, at = np.unique(batch["cluster_id"].to_numpy(), return_inverse=True)
            total = np.zeros((len(names), width))
            np.add.at(total, at, unit)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, minlength=len(names))), pa.array(list(total))], ["cluster_id", "n", "s"])

    def affinity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, _ = _unit(_matrix(batch["v"], width))
            whole = _matrix(batch["s"], width)
            n = batch["n"].to_numpy()
            mean = ((unit * whole).sum(axis=1) - 1) / np.maximum(1, n - 1)
            yield pa.RecordBatch.from_arrays([batch["cluster_id"], batch["id"], batch["n"], pa.array(np.round(mean, 6))], ["cluster_id", "id", "n", "mean"])

    rows = members.join(df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.size("v") == width), "id")
    partial = rows.select("cluster_id", "v").mapInArrow(sums, "cluster_id long, n long, s array<double>")
    total = partial.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s"))
    each = rows.join(total, "cluster_id").select("cluster_id", "id", "n", "v", "s").mapInArrow(affinity, "cluster_id long, id long, n long, mean double")
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("mean"), "id"))
    top = each.withColumn("nth", nth).filter(F.col("nth") <= typical).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("t"))
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    cohesion = F.when(F.col("n") > 1, F.round((square - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6))
    return total.select("cluster_id", F.col("n").alias("members"), cohesion.alias("cohesion")).join(top, "cluster_id").select("cluster_id", "members", "cohesion", F.transform("t", lambda x: x["id"]).alias("typical"))
