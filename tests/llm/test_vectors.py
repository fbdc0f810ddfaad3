import numpy as np
import pytest

from pyspark.sql import functions as F

from strandloom.llm import clusters as module
from strandloom.llm.clusters import Links, _groups, _starts, clusters, describe, embed, starts
from strandloom.llm.vectors import Cells, CrossPolytope, hadamard, nearest, similar_pairs

WIDTH = 8
SCHEMA = "vec_id long, v array<float>, id string"


def rows_of(seed=3, groups=12, each=9):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=WIDTH)
        rows += [(centre + 0.15 * rng.normal(size=WIDTH)) * rng.uniform(0.1, 9) for _ in range(each)]
    rows += [rng.normal(size=WIDTH) for _ in range(60)]
    rows += [rows[0]] * 8 + [rows[20]] * 2 + [2 * rows[40]]
    rows = [[float(np.float32(x)) for x in r] for r in rows]
    bad = [None, [1.0] * 3, [0.0] * WIDTH, [0.0] * WIDTH, [float("nan")] * WIDTH, [float("inf")] + [1.0] * (WIDTH - 1), [None] + [1.0] * (WIDTH - 1)]
    return [(i * 7 % 1009, r, "clash") for i, r in enumerate(rows + bad)]


def usable(rows):
    good = [(i, np.array(r)) for i, r, _ in rows if r is not None and len(r) == WIDTH and None not in r and np.isfinite(r).all() and np.any(np.array(r) != 0)]
    good.sort()
    ids = [i for i, _ in good]
    unit = np.stack([r / np.linalg.norm(r) for _, r in good])
    return ids, np.round(unit @ unit.T, 6)


def brute_nearest(rows, k, least):
    ids, c = usable(rows)
    out = {}
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a and c[a, b] >= least), key=lambda b: (-c[a, b], ids[b]))
        out[ids[a]] = [ids[b] for b in order[:k]]
    return out


def brute_clusters(rows, least):
    ids, c = usable(rows)
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            low = min(root[b] for b in range(len(ids)) if c[a, b] >= least)
            if low < root[a]:
                root[a], changed = low, True
    size = {r: root.count(r) for r in root}
    return {(ids[r], ids[i]) for i, r in enumerate(root) if size[r] >= 3}


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 10_000, "cell_rows": 40, "deeper": 0}], ids=["one cell", "cells of parts"])
def test_nearest_and_clusters_match_brute_force(spark, sizes):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, "vec_id", "v", 5, 0.82, width=WIDTH, **sizes).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = {k: set(v) for k, v in brute_nearest(rows, 5, 0.82).items() if v}
    if sizes:  # hashing may lose a neighbour, never invent one
        kept = sum(len(got.get(k, set()) & v) for k, v in want.items()) / sum(map(len, want.values()))
        assert kept > 0.9
    else:
        assert got == want
    found = {(r.cluster_id, r.id) for r in clusters(df, "vec_id", "v", 0.82, width=WIDTH, **sizes).collect()}
    assert found == brute_clusters(rows, 0.82)


def test_recall_of_the_hashing(spark):
    rows = rows_of(5, groups=60, each=8)
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = {(r.vec_id_a, r.vec_id_b) for r in similar_pairs(nearest(df, "vec_id", "v", 5, 0.82, width=WIDTH, bucket_rows=40), 0.82).collect()}
    want = {(min(a, b), max(a, b)) for a, bs in brute_nearest(rows, 5, 0.82).items() for b in bs}
    assert len(pairs & want) / len(want) >= 0.9


@pytest.mark.parametrize("bucket_rows", [48, 8], ids=["one hash", "two hashes"])
def test_recall_holds_as_buckets_grow(spark, bucket_rows):
    rng = np.random.default_rng(8)
    ends = []
    for _ in range(800):  # pairs at cosine 0.84 to 0.96 among vectors far from each other
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        c = rng.uniform(0.84, 0.96)
        ends += [x, c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)]
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(ends)], "vec_id long, v array<float>")
    found = similar_pairs(nearest(df, "vec_id", "v", 5, 0.82, bucket_rows=bucket_rows), 0.82)
    assert sum(r.vec_id_a // 2 == r.vec_id_b // 2 for r in found.collect()) >= 0.99 * 800


def test_describe(spark):
    rows = rows_of(4, groups=3, each=4)
    df = spark.createDataFrame(rows, SCHEMA)
    members = clusters(df, "vec_id", "v", 0.82, width=WIDTH)
    ids, c = usable(rows)
    at = {i: n for n, i in enumerate(ids)}
    for r in describe(members, df, "vec_id", "v", 2, WIDTH).collect():
        own = [at[m.id] for m in members.filter(f"cluster_id = {r.cluster_id}").collect()]
        pairs = [c[a, b] for a in own for b in own if a != b]
        assert r.members == len(own) and abs(r.cohesion - np.mean(pairs)) < 1e-4
        mean = {ids[a]: np.mean([c[a, b] for b in own if b != a]) for a in own}
        assert abs(mean[r.typical[0]] - max(mean.values())) < 1e-4


def test_hash_pieces():
    x = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    assert np.allclose(hadamard(hadamard(x)), x, atol=1e-4)
    codes = CrossPolytope(16, 64, tables=3, probes=2).codes(x)
    assert codes.shape == (5, 6) and len({tuple(np.sort(r)) for r in codes}) == 5
    assert (CrossPolytope(16, 64, 3, 2).codes(3 * x) == codes).all()


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest(empty, "vec_id", "v", width=WIDTH).count() == 0
    assert clusters(empty, "vec_id", "v", 0.8, width=WIDTH).count() == 0
    twice = spark.createDataFrame([(1, [1.0] * WIDTH, "")] * 3 + [(2, [1.0] * (WIDTH - 1) + [1.1], "")] * 2, SCHEMA)
    assert sorted((r.id, r.other) for r in nearest(twice, "vec_id", "v", width=WIDTH).collect()) == [(1, 2), (2, 1)]


def test_hot_bucket_is_hashed_again(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    ends = []
    for _ in range(700):  # one cone: every vector is similar to every other; each has one twin much closer
        x = centre + 0.04 * rng.normal(size=64)
        ends += [x, x + 0.01 * rng.normal(size=64)]
    df = spark.createDataFrame([(i, [float(z) for z in x]) for i, x in enumerate(ends)], "vec_id long, v array<float>")
    sizes = {"bucket_rows": 200, "cell_rows": 300}
    cells = Cells(df, "vec_id", "v", **sizes)
    largest = max(r["count"] for r in cells.spread.groupBy("bucket", "a", "b").count().collect())
    assert largest < 600 and cells.spread.count() < 60 * len(ends)
    near = {}
    for r in nearest(df, "vec_id", "v", 1, 0.82, **sizes).collect():
        near[r.id] = r.other
    assert sum(near.get(i) == i ^ 1 for i in range(len(ends))) >= 0.9 * len(ends)
    exact = {r.id: r.other for r in nearest(df, "vec_id", "v", 1, 0.82, deeper=0, bucket_rows=10**6, cell_rows=300).collect()}
    assert all(exact[i] == i ^ 1 for i in range(len(ends)))
    assert {r.cluster_id for r in clusters(df, "vec_id", "v", 0.82, **sizes).collect()} == {0}


def test_asked_rows_only(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    want = {k: set(v) for k, v in brute_nearest(rows, 5, 0.82).items() if v and k % 5 == 0}
    got = {}
    for r in nearest(df, "vec_id", "v", 5, 0.82, width=WIDTH, asked=F.col("id") % 5 == 0).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert got == want


def walk_limit(n, edges, start):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
    total = w.sum(axis=1)
    step = (w + np.diag(total + 1)) / (2 * total + 1)[:, None]
    return np.linalg.matrix_power(step, 1 << 20) @ start


def test_embedding_is_the_limit_of_the_walk(spark):
    rng = np.random.default_rng(1)
    half = [(i, i + 1, 1.0 + i % 3) for i in range(39)] + [(50, 51, 0.3), (50, 52, 2.0), (52, 53, 1.0)]
    half += [(60, int(j), float(rng.uniform(0.1, 3))) for j in range(61, 90)]
    edges = half + [(b, a, x) for a, b, x in half]
    nodes = spark.createDataFrame([(i,) for i in range(95)], "node long")
    start = np.array([r.y for r in nodes.orderBy("node").select(F.array(*_starts(2)).alias("y")).collect()])
    got = np.array([r.y for r in embed(nodes, spark.createDataFrame(edges, "a long, b long, w double"), dimensions=2).orderBy("node").collect()])
    assert np.allclose(got, walk_limit(95, edges, start), atol=1e-6)
    assert len({tuple(y) for y in got[:40]}) == 1 and len({tuple(y) for y in got}) == 3 + 21  # three connected parts, the rest alone


def test_the_embedding_decides(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    right = {(r.cluster_id, r.id) for r in clusters(df, "vec_id", "v", 0.82, width=WIDTH).collect()}
    assert right == brute_clusters(rows, 0.82)
    monkeypatch.setattr("strandloom.llm.clusters._starts", lambda d: [F.lit(0.0)] * d)
    wrong = {(r.cluster_id, r.id) for r in clusters(df, "vec_id", "v", 0.82, width=WIDTH).collect()}
    assert wrong != right and len({c for c, _ in wrong}) == 1


def test_starts_are_the_same_in_a_cell(spark):
    ids = [0, 1, 5, -3, 2**62, -(2**63), 123456789]
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    want = {r.node: r.y for r in nodes.select("node", F.array(*_starts(4)).alias("y")).collect()}
    assert starts(np.array(ids), 4).tolist() == [want[i] for i in ids]


@pytest.mark.parametrize("held", [0, 60, 10**6], ids=["computed again", "some held", "all held"])
def test_limit_of_the_walk_in_a_cell(held):
    rng = np.random.default_rng(2)
    half = [(i, i + 1, 1.0 + i % 3) for i in range(39)] + [(50, 51, 0.3), (50, 52, 2.0), (52, 53, 1.0)]
    half += [(a, b, float(rng.uniform(0.1, 3))) for a in range(60, 90) for b in range(60, a)]
    edges = half + [(b, a, x) for a, b, x in half]
    w = np.zeros((95, 95))
    for a, b, x in edges[held:]:
        w[a, b] = x
    blocks = [(np.arange(s, s + 19), np.arange(95), w[s : s + 19]) for s in range(0, 95, 19)]
    i, j, x = zip(*edges[:held]) if held else ((), (), ())
    links = Links(95, np.array(i, dtype=int), np.array(j, dtype=int), np.array(x, dtype=float), lambda: blocks)
    start = starts(np.arange(95), 3)
    got = module.walk_limit(links, start)
    assert np.allclose(got, walk_limit(95, edges, start), atol=1e-6)
    assert len({tuple(y) for y in got}) == 3 + 21


def cell_groups(rows, guests=()):
    ids, _ = usable(rows)
    vectors = {i: np.array(r) for i, r, _ in rows}
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    home = ~np.isin(np.arange(len(ids)), guests)
    table = _groups(0.82, 4, 2)(unit, np.array(ids), np.ones(len(ids), dtype=np.int64), home, None, home)
    return {(r["root"], r["rep"]) for r in table.to_pylist()}


def test_the_walk_decides_within_a_cell(monkeypatch):
    rows = rows_of()
    right = cell_groups(rows)
    assert brute_clusters(rows, 0.82) <= right  # pairs are no clusters, but groups
    monkeypatch.setattr(module, "HELD", 12_000)
    monkeypatch.setattr("strandloom.llm.vectors.CHUNK", 2_000)
    assert cell_groups(rows) == right
    some = cell_groups(rows, guests=range(0, 150, 7))
    monkeypatch.setattr(module, "HELD", 10**8)
    assert cell_groups(rows, guests=range(0, 150, 7)) == some
    monkeypatch.setattr(module, "starts", lambda ids, d: np.zeros((len(ids), d)))
    wrong = cell_groups(rows)
    assert {i for _, i in wrong} == {i for _, i in right} and len({c for c, _ in wrong}) == 1
