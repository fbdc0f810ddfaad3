import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import text, vec
from strandloom.operators import concepts, graph, order, threads, upkeep
from strandloom.plans import memory
from strandloom.session import fresh_dir
from strandloom.streaming import observer


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


# -- concepts ---------------------------------------------------------------------


def test_ensure_keeps_the_first_and_fills_the_kind(spark):
    ev = spark.createDataFrame([(None, "a", 0.1, None, 1, "x"), (None, "a", 0.0, "need", 2, "x"), ("", "a", 0.5, "decision", 3, "x"), ("p", "a", 0.0, None, 4, "x"), ("p", None, 0.0, None, 5, "x")], "project string, handle string, confidence double, kind string, seq long, clash string")
    assert rows(concepts.ensured(ev), "project", "handle", "confidence", "kind") == [("", "a", 0.1, "need"), ("p", "a", 0.0, None)]
    assert concepts.ensured(ev.limit(0)).count() == 0


def test_evidence_triples_move_together(spark):
    schema = "handle string, source string, source_id string, pointer string, sha string, anchor double, score double, seq long"
    ev = spark.createDataFrame([("a", "s", "1", "p1", "h1", None, None, 1), ("a", "s", "1", "p2", None, 2.0, 0.5, 2), ("a", "s", "1", "p3", "h3", None, 0.9, 3), ("b", "s", "1", "q", "h", None, None, 9)], schema)
    assert rows(concepts.attached_evidence(ev), "handle", "pointer", "sha", "anchor", "score", "touch_count") == [("a", "p2", None, 2.0, 0.9, 3), ("b", "q", "h", None, None, 1)]


def test_merges_follow_chains_and_leave_cycles(spark):
    keys = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("d", "missing")], "handle string, merged_into string")
    into = concepts.merged_keys(keys)
    assert rows(into, "handle", "into") == [("a", "c"), ("b", "c"), ("d", "missing")]
    edges = spark.createDataFrame([("a", "r", "b", 0.5, 1), ("a", "r", "z", 0.2, 1), ("b", "r", "z", 0.7, 2), ("z", "r", "x", 0.1, 1)], "a string, relation string, b string, confidence double, touch_count long")
    assert rows(concepts.repointed_edges(edges, into), "a", "b", "confidence", "touch_count") == [("c", "z", 0.7, 3), ("z", "x", 0.1, 1)]
    aliases = spark.createDataFrame([("a", "n", 1), ("c", "n", 2)], "handle string, alias string, touch_count long")
    assert rows(concepts.repointed_aliases(aliases, into), "handle", "alias", "touch_count") == [("c", "a", 0), ("c", "b", 0), ("c", "n", 3), ("missing", "d", 0)]


def test_pairs_are_capped_by_rule_and_counted(spark):
    hits = spark.createDataFrame([(g, f"h{i:02d}", i) for g in "xy" for i in range(30)] + [("z", "h00", 0), ("x", None, 0), ("x", "h00", 9)], "group string, handle string, place int")
    got = rows(concepts.pairs_with(hits), "a", "b", "touch_count")
    assert len(got) == 28 and set(c for *_, c in got) == {2} and max(b for _, b, _ in got) == "h07"
    assert rows(concepts.recurring(hits, 3), "handle", "turns") == [("h00", 3)]


def test_latent_edges_once_and_not_where_known(spark):
    near = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("a", "c", 0.5), ("c", "a", 0.5), ("b", "c", 0.1)], "handle string, other string, cosine double")
    known = spark.createDataFrame([("c", "a")], "a string, b string")
    assert rows(concepts.latent_edges(near, known), "a", "b", "cosine") == [("a", "b", 0.9)]
    seeds = spark.createDataFrame([("a", 1.0), ("c", 0.4)], "handle string, activation double")
    assert rows(concepts.latent_lift(seeds, near), "handle", "activation") == [("a", 0.1), ("b", 0.45), ("c", 0.25)]


def test_histogram_specificity(spark):
    bins = spark.createDataFrame([("few", 9), ("one", 30), ("even", 15), ("even", 15), ("peak", 99), ("peak", 1)], "handle string, w long")
    got = dict(rows(concepts.histogram_specificity(bins), "handle", "specificity"))
    assert got["few"] == got["one"] == 1.0 and got["even"] == 0.0 and 0.9 < got["peak"] < 1


# -- threads ----------------------------------------------------------------------


def test_evidence_after_removals(spark):
    ev = spark.createDataFrame([("t", "p", "c", False, 1), ("t", "p", "c", True, 2), ("t", "p", "c", False, 3), ("t", "p", "c", False, 4), ("t", "q", "c", True, 1), ("t", "r", "d", False, 1)], "thread string, path string, category string, removes boolean, seq long")
    assert rows(threads.live_evidence(ev), "path", "touches", "first") == [("p", 2, 3), ("r", 1, 1)]


def test_surface_keeps_a_place_for_the_bridge(spark):
    df = spark.createDataFrame([(f"h{i}", 1 - i / 10, i == 5) for i in range(9)] + [("h0", 0.2, True), ("low", 0.05, False)], "handle string, score double, bridge boolean")
    assert rows(threads.surface(df, 3), "place", "handle") == [(1, "h0"), (2, "h1"), (3, "h5")]
    assert rows(threads.surface(df, 7), "place", "handle")[-1] == (7, "h6") and threads.surface(df.limit(0), 3).count() == 0
    pages = threads.pinned_pages(df.filter("handle in ('h0', 'h3')").select("handle", "score").dropDuplicates(["handle"]), df.select("handle", "score").filter("handle <> 'low'").dropDuplicates(["handle"]), 4)
    got = rows(pages, "place", "handle", "pinned")
    assert [g[0] for g in got] == [1, 2, 3, 4] and sum(p for *_, p in got) == 2 and len({h for _, h, _ in got}) == 4


def test_counters_fades_and_focus(spark):
    ev = spark.createDataFrame([("a", 1, None), ("a", 2, 10), ("a", 3, None), ("b", 1, None)], "key string, seq long, total long")
    assert rows(threads.totals(ev), "key", "value") == [("a", 11), ("b", 1)]
    f = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.0), ("b", 0.9), ("c", -1.0), ("c", 0.3), ("d", float("nan"))], "key string, factor double")
    assert rows(threads.faded(f), "key", "fade") == [("a", 0.25), ("b", 0.0), ("c", 0.3)]
    focus = spark.createDataFrame([("s", "x", False, 1), ("s", "y", False, 2), ("t", "x", False, 1), ("t", None, True, 2)], "scope string, item string, clears boolean, seq long")
    assert rows(threads.focus_state(focus), "scope", "item", "pinned") == [("s", "y", True), ("t", None, False)]


def test_edge_and_value_curves(spark):
    act = lambda s, age, idle, n: one(spark, threads.edge_activation(F.col("s"), F.col("age"), F.col("idle"), F.col("n")), s=s, age=age, idle=idle, n=n)
    assert act(0.8, 30.0, 0.0, 5) > act(0.8, 30.0, 30.0, 1) and act(0.9, 300.0, 1.0, 2) > act(0.9, 1.0, 1.0, 2) and act(0.5, 300.0, 1.0, 2) == act(0.5, 1.0, 1.0, 2)
    value = lambda u, j: one(spark, threads.value_factor(F.col("u"), F.col("j"), neutral=0.5), u=u, j=j)
    assert value(0.0, 0.0) == 0.5 and 0.5 < value(0.4, 0.0) < value(0.4, 2.0) <= 1.0


def test_components_need_two_links_each(spark):
    ring = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    got = threads.components(spark.createDataFrame(list(enumerate(ring)), "id long, v array<double>")).collect()
    assert len(got) == 1 and got[0].members == 3 and sorted(got[0].ids) == ["0", "1", "2"] and got[0].handle.startswith("proposed-")
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "id long, v array<double>")
    assert threads.components(same, distinct=2).count() == 0 and threads.components(same.limit(0)).count() == 0


# -- upkeep -----------------------------------------------------------------------

SCHEMA = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])


def test_keyed_table(spark):
    make = lambda *xs: spark.createDataFrame([(k, n, [float(n)] * 2) for k, n in xs], SCHEMA)
    held = upkeep.KeyedTable(spark, fresh_dir(spark, "k"), SCHEMA, buckets=4, widths={"v": 2})
    assert held.read().count() == 0 and held.version() == -1
    held.append(make(*[(f"k{i}", i) for i in range(20)]))
    before = held.read()
    held.upsert(make(("k3", 30), ("new", 1), ("new", 1)))
    held.insert(make(("k3", 99), ("k77", 77)))
    assert before.count() == 20  # readers keep what they began with
    got = dict(rows(held.read(), "chunk_id", "n"))
    assert got["k3"] == 30 and got["new"] == 1 and got["k77"] == 77 and len(got) == 22
    assert held.delete(ids=make(("k0", 0), ("absent", 0))) == 1 and held.delete(F.col("n") >= 77) == 1 and held.delete(F.col("n") < 0) == 0
    n = held.optimize()
    assert n == held.version() and held.read().count() == 20
    for bad in (spark.createDataFrame([(None, 1, None)], SCHEMA), spark.createDataFrame([("x", 1, [1.0])], SCHEMA)):
        with pytest.raises(ValueError):
            held.upsert(bad)


def test_paths_marks_and_windows(spark):
    noisy = lambda p: one(spark, upkeep.noisy_path(F.col("p")), p=p)
    assert [noisy(p) for p in ("a/b.md", "x/target/a", ".state/locks/a", ".state/journal.jsonl", ".state/mirror/journal.jsonl", "target/.state/journal.jsonl", "targets/a")] == [False, True, True, False, True, True, False]
    found = one(spark, text.triggers(F.col("t")), t="Yes, exactly! and got it. But no, exactly not; that's the move, right, so")
    assert found == ["yes, exactly", "got it", "that's the move", "right, s"]
    assert one(spark, text.strip_line_marker(F.col("t")), t="  - 1. > said") == "said" and one(spark, text.refine_token(F.col("t")), t="(gate's)") == "gate"
    assert one(spark, text.token_window(F.col("t"), F.lit(4), 3), t="a b c d e f g") == "d e f" and one(spark, text.token_window(F.col("t"), F.lit(0), 9), t="a  b") == "a  b"
    assert one(spark, text.doc_handle(F.col("t")), t="a/" + "b" * 60 + ".md").startswith("a-bbb") and one(spark, text.doc_title(F.col("t")), t="x\n# Head \n# Two") == "Head"


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vec.blend(F.col("a"), F.col("b"), 0.5).alias("m"), vec.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert abs(got[0].m[0] - 0.5**0.5) < 1e-9 and got[1].m == [0.0, 2.0] and [g.d for g in got] == [1.0, 2.0, 2.0]


def test_numbers_without_one_task_a_group(spark):
    df = spark.createDataFrame([("hot" if i % 4 else None, i) for i in range(2000)], "g string, i long")
    got = rows(order.numbered(df, ["g"], ["i"]), "g", "i", "nth")
    want = {}
    for g, i in sorted(((r.g, r.i) for r in df.collect()), key=lambda x: x[1]):
        want.setdefault(g, []).append(i)
    assert got == sorted(((g, i, n + 1) for g, xs in want.items() for n, i in enumerate(xs)), key=repr)


def test_streaming_upkeep(spark):
    states = spark.createDataFrame([("a", "p", 0.0, "h1"), ("b", "p", 0.2, "h2"), ("c", "p", 0.2, "h3"), ("d", None, 0.0, "h4"), ("e", "q", 0.0, "h5")], "scope string, pin string, drift double, hash string")
    shown = spark.createDataFrame([("a", "p", "h0"), ("b", "p", "h0"), ("c", "p", "h3"), ("e", "p", "h0")], "scope string, pin string, hash string")
    assert [s for (s,) in rows(observer.due(states, shown), "scope")] == ["b", "d", "e"]
    journals, newest = spark.createDataFrame([("p", 10_000_000), ("q", 10_000_000)], "project string, mtime long"), spark.createDataFrame([("p", 9_500_000)], "project string, micros long")
    assert rows(observer.stale_ingest(journals, newest, 1.0), "project", "behind_s") == [("q", 10.0)]
    turns = spark.createDataFrame([("s", 1, "one two got it three four"), ("s", 2, "nothing here")], "session_id string, turn int, text string")
    assert rows(observer.membrane(turns, 3), "turn", "trigger", "text") == [(1, "got it", "two got it")]


# -- the tool surface -------------------------------------------------------------


def test_near_duplicates_are_merged_greedily(spark):
    a = [1.0, 0.0, 0.0]
    rows_ = [("a", a, 1, 5), ("b", [1.0, 0.01, 0.0], 3, 9), ("c", [1.0, 0.0, 0.01], 3, 2), ("d", [0.0, 1.0, 0.0], 9, 1), ("e", [0.0, 1.0, 0.01], 9, 0), ("f", [0.0, 0.0, 1.0], 1, 1)]
    df = spark.createDataFrame(rows_, "handle string, v array<double>, resonance long, micros long")
    assert rows(threads.near_duplicates(df), "handle", "into") == [("a", "b"), ("b", "c"), ("d", "e")]
    assert threads.near_duplicates(df.limit(0)).count() == 0


def test_tools(spark):
    chunks = spark.createDataFrame([("a", "A", ["b", "x", "c"]), ("b", "B", []), ("c", "C", ["a"])], "id string, text string, parent_ids array<string>")
    assert rows(memory.link(chunks, chunks.filter("id = 'a'")), "pos", "parent", "text") == [(0, "b", "B"), (2, "c", "C")]
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.7)], "query_id long, id string, score double")
    details = spark.createDataFrame([("a", True, False, "s", "f"), ("b", False, False, "s", "f"), ("c", False, True, None, "f")], "id string, stale boolean, transcript boolean, symbol string, source_id string")
    pages, log = memory.fault(hits, details, 7)
    assert rows(pages, "page", "head", "total", "lineage", "evidence") == [("f", "c", 1, [], ["c"]), ("s", "b", 2, ["a"], [])] and log.count() == 3
    seeded = memory.remember(spark.createDataFrame([("p", "h", "decision")], "project string, handle string, kind string"), 4)
    assert rows(concepts.ensured(seeded.unionByName(seeded)), "handle", "confidence") == [("h", 0.5)]
    pairs = memory.connect(spark.createDataFrame([("a", "b"), ("a", "a")], "a string, b string"), "needs", 1, 2)
    assert rows(graph.upserted_edges(pairs), "a", "b", "source") == [("a", "b", "authored")]
    memory.register(spark)
    assert spark.sql("SELECT sl_unpack_vector(sl_pack_vector(array(cast(1.5 as float), cast(-2 as float)))) v").first().v == [1.5, -2.0]
    named = lambda ids: one(spark, memory.row_id("novelty", F.lit("p"), F.col("i")), i=ids)
    assert named(["a", "b"]) == named(["b", "a"]) != named(["a"])
    assert one(spark, F.size(vec.stub_embedding(F.col("t"))), t="x") == 32


def test_pages_and_supporting_hits(spark):
    hits = spark.createDataFrame([(1, "gate", "x", 9.0, "a/other.md", None), (1, "gate", "y", 1.0, "a/gate.md", None), (1, "lane", "z", 2.0, "a/b.md", "m::Lane"), (1, "none", "w", 1.0, "a/b.md", None)], "query_id long, handle string, id string, score double, source_id string, symbol string")
    from strandloom.operators import retrieval

    assert rows(retrieval.supporting_hit(hits), "handle", "id", "named") == [("gate", "y", True), ("lane", "z", True), ("none", "w", False)]
    assert one(spark, retrieval.pseudo_query(F.col("a"), F.array(F.lit("x"), F.lit("y"))), a="gate") == "gate x y"
