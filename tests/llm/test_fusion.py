import itertools
import random

from strandloom.llm.fusion import Score, best, outranking

SCORES = (Score("a", True, 1.0, True), Score("b", False, 2.0))
SCHEMA = "q long, item string, a double, b double, net_flow string"


def brute(rows, q=0.0, s=0.5):
    """Net flows by comparing all pairs."""
    best_of = {}
    for query, item, a, b, _ in rows:
        if query is None or item is None:
            continue
        got = best_of.setdefault((query, item), [None, None])
        for i, v in enumerate((None if a is None or a != a or a == 0 else a, None if b is None or b != b else -b)):
            if v is not None and (got[i] is None or v > got[i]):
                got[i] = v
    out = {}
    for query in {k[0] for k in best_of}:
        items = {k[1]: v for k, v in best_of.items() if k[0] == query}
        n = len(items)
        flow = dict.fromkeys(items, 0.0)
        for i, w in enumerate((1.0, 2.0)):
            v = {k: float("-inf") if x[i] is None else x[i] for k, x in items.items()}
            p = {k: (sum(y < v[k] for y in v.values()) + sum(y == v[k] for y in v.values()) / 2) / n for k in v}
            pref = lambda d: min(1.0, max(0.0, (d - q) / (s - q)))
            for x, y in itertools.permutations(items, 2):
                flow[x] += w * (pref(p[x] - p[y]) - pref(p[y] - p[x])) / (n - 1) / 3
        out |= {(query, k): round(x, 6) for k, x in flow.items()}
    return out


def test_flows_match_all_pairs_in_one_block_and_in_many(spark):
    rng = random.Random(1)
    odd = [None, float("nan"), 0.0, float("inf"), -5.0, 1e30]
    rows = [(rng.choice([1, 2, 3]), f"i{rng.randrange(60)}", rng.choice([*odd, rng.random(), round(rng.random(), 1)]), rng.choice([*odd, rng.random()]), "x") for _ in range(150)]
    rows += [(4, "alone", 1.0, 1.0, "x"), (None, "i1", 1.0, 1.0, "x"), (1, None, 1.0, 1.0, "x")] + [(5, f"t{i}", 2.0, 2.0, None) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for size in (200_000, 5):
        got = {(r.q, r.item): round(r.net_flow, 6) for r in outranking(df, "q", "item", SCORES, block_rows=size).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert got[(4, "alone")] == 0 and got[(5, "t1")] == 0


def test_scale_does_not_matter_and_one_sided_candidates_are_out(spark):
    rows = [(1, f"c{i}", 1e6 * i + 1, 50.0 - i, "") for i in range(10)] + [(1, "one_sided", 1e12, None, "")]
    top = [r.item for r in best(outranking(spark.createDataFrame(rows, SCHEMA), "q", "item", SCORES), "q", "item", 3).orderBy("place").collect()]
    assert top == ["c9", "c8", "c7"]


def test_empty(spark):
    assert outranking(spark.createDataFrame([], SCHEMA), "q", "item", SCORES).count() == 0
