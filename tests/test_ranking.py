import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import ranking
from strandloom.operators.products import products


def brute_seats(rows, budget, least, share, slots):
    """The slots, one seat after the other, as the rule is written."""
    rows = sorted(rows, key=lambda r: (-r["total"], r["id"]))
    taken, shas, vecs, out, left = set(), set(), [], [], budget
    unit = lambda v: None if v is None or not np.linalg.norm(v) else np.array(v) / np.linalg.norm(v)
    for name, feature, seats in slots:
        for _ in range(seats):
            if left < least:
                return out
            free = [r for r in rows if r["id"] not in taken and r["sha"] not in shas]
            if feature:
                free = [r for r in free if r["total"] > 1.2e-7 and (r.get(f"c_{feature}") or 0) / r["total"] >= share]
                pick = free[0] if free else None
            else:
                far = {r["id"]: round(1 - max([max(0, float(unit(r["v"]) @ c)) for c in vecs], default=0), 9) for r in free if unit(r["v"]) is not None}
                pick = min((r for r in free if r["id"] in far), key=lambda r: (-far[r["id"]], r["id"]), default=None)
            if pick is None:
                break
            left -= min(pick["n_tokens"], left)
            out.append((pick["id"], len(out), name, left))
            taken.add(pick["id"])
            shas.add(pick["sha"])
            if unit(pick["v"]) is not None:
                vecs.append(unit(pick["v"]))
    return out


@pytest.mark.parametrize("budget", [10_000, 60])
def test_seats_match_the_rule(spark, budget):
    rng = np.random.default_rng(3)
    rows = []
    for q in range(25):
        for i in range(int(rng.integers(1, 14))):
            c = [round(float(x), 3) for x in rng.random(4) * [1, 0.5, 0.5, 0.5]]
            v = None if rng.random() < 0.1 else [0.0] * 3 if rng.random() < 0.1 else [float(x) for x in rng.normal(size=3)]
            rows.append((q, i, f"s{rng.integers(9)}", int(rng.integers(1, 40)), v, round(sum(c) - float(rng.random() < 0.2), 6), *c))
    schema = "query_id long, id long, sha string, n_tokens int, v array<float>, total double, c_attention_affinity double, c_freshness double, c_concept_support double, c_relational_lift double"
    df = spark.createDataFrame(rows, schema)
    names = [c.split()[0] for c in schema.split(", ")]
    got = {}
    for r in ranking.allocate(df, ranking.LensConfig(budget=budget, least=5)).collect():
        got.setdefault(r.query_id, []).append((r.id, r.seat, r.slot, r.left))
    for q in range(25):
        mine = [dict(zip(names, r)) for r in rows if r[0] == q]
        for r in mine:
            r["v"] = None if r["v"] is None else [float(np.float32(x)) for x in r["v"]]
        assert sorted(got.get(q, []), key=lambda x: x[1]) == brute_seats(mine, budget, 5, 0.3, ranking.SLOTS)
    assert ranking.allocate(df.limit(0)).count() == 0


def test_profiles_and_missing_context(spark):
    assert ranking.profile_weights("lens", {"default": {"freshness": 0.1, "own": 2.0}, "lens": {"own": 3.0}}) == ranking.PROFILES["lens"] | {"freshness": 0.1, "own": 3.0}
    pool = spark.createDataFrame([(1, 5), (1, 6)], "query_id long, id long")
    ranked = ranking.rank_pool(pool, ranking.Context(), {"attention_affinity": 1.0, "unknown": 4.0})
    assert [r.total for r in ranked.collect()] == [0.0, 0.0]
    fresh = ranking.rank_pool(pool, ranking.Context(now=10**15, accesses=spark.createDataFrame([(5, 10**15 - 10**10, "creation"), (6, 1, "creation")], "id long, micros long, kind string")), {"freshness": 1.0})
    assert {r.id: r.total for r in fresh.collect()} == {5: 1.0, 6: 0.0}


def test_own_feature(spark):
    @ranking.feature("own")
    def own(pool, context):
        return pool.select("query_id", "id", (F.col("id") * 0.25).alias("raw"))

    try:
        rows = ranking.rank_pool(spark.createDataFrame([(1, 1), (1, 9)], "query_id long, id long"), ranking.Context(), {"own": 2.0}).collect()
        assert {r.id: (r.f_own, r.c_own, r.total) for r in rows} == {1: (0.25, 0.5, 0.5), 9: (1.0, 2.0, 2.0)}
    finally:
        del ranking.FEATURES["own"]


@pytest.mark.parametrize("metric", ["l2", "cosine", "similarity"])
def test_products_in_blocks(spark, metric):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 6)), rng.normal(size=(90, 6))
    asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None), (98, [1.0])], "query_id long, v array<double>")
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)] + [(None, [1.0] * 6), (500, [1.0])], "id long, v array<double>")
    least = {"l2": 4.0, "cosine": 0.5, "similarity": 0.5}[metric]
    one = sorted(products(rows, asked, metric, least=least).collect())
    assert one and sorted(products(rows, asked, metric, least=least, block=7, part=20).collect()) == one
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    full = ((x[:, None] - y[None]) ** 2).sum(2) if metric == "l2" else unit(x) @ unit(y).T if metric == "similarity" else 1 - unit(x) @ unit(y).T
    want = {(i, j) for i in range(60) for j in range(90) if (full[i, j] >= least if metric == "similarity" else full[i, j] <= least)}
    assert {(r.query_id, r.id) for r in one} == want
    best = products(rows, asked, metric, limit=3, block=7, part=20)
    top = {i: set(np.argsort(-full[i] if metric == "similarity" else full[i])[:3]) for i in range(60)}
    found = {}
    for r in best.collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert all(top[i] <= found[i] for i in range(60))
    assert products(rows, asked.limit(0), metric, limit=1).count() == 0 and products(rows.limit(0), asked, metric, limit=1).count() == 0
