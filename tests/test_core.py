import datetime as dt
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import text, vec
from strandloom.operators import graph, ledger, retrieval, rows, signals
from strandloom.plans.recall import hybrid_recall, incremental_scan
from strandloom.sources import documents, sessions
from strandloom.streaming import observer


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# -- functions ----------------------------------------------------------------------


def test_text_functions(spark):
    r = one(
        spark,
        text.slugify(F.lit("  The Big--Idea! ")).alias("slug"), text.slugify(F.lit("12345")).alias("digits"), text.slugify(F.lit("ab")).alias("short"), text.slugify(F.lit(None).cast("string")).alias("none"),
        text.normalize(F.lit("L’État: 3_x")).alias("norm"), text.collapsed(F.lit(" a \n b  c"), 3).alias("cut"), text.excerpt(F.lit("a b c d"), 2).alias("ex"), text.truncated(F.lit("x" * 205)).alias("trunc"),
        text.path_stem(F.lit("a/b/c.tar.gz")).alias("stem"), text.valid_handle(F.lit("a-b")).alias("ok"), text.valid_handle(F.lit("-a")).alias("bad"), text.kebab_phrases(F.lit("see two-words and a-b-c-d-e")).alias("kebab"),
        text.mentions(F.lit("On Deep-Fold, yes"), F.lit("deep-fold")).alias("m1"), text.mentions(F.lit("deep-folder"), F.lit("deep-fold")).alias("m2"),
    )
    assert (r.slug, r.digits, r.short, r.none, r.norm) == ("the-big-idea", None, None, None, "l état 3 x")
    assert (r.cut, r.ex, r.stem, r.ok, r.bad, r.kebab, r.m1, r.m2) == ("a b…", "a b…", "c.tar", True, False, ["two-words"], True, False)
    assert r.trunc == "x" * 200 + "…[truncated 5 chars]"


def test_chunk_id_is_the_hash_of_its_parts(spark):
    import hashlib

    got = one(spark, text.chunk_id(F.lit("markdown"), F.lit("a/b.md"), F.lit(258), F.lit("cfg")).alias("i")).i
    assert got == hashlib.sha256(b"markdown:a/b.md:" + (258).to_bytes(4, "little") + b"cfg").hexdigest()


def test_vector_functions(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ([1, 2, 2], [2, 1, 2], [0, 0, 0]))
    r = one(spark, vec.cosine(a, b).alias("c"), vec.cosine(a, z).alias("zero"), vec.cosine(a, F.array(F.lit(1.0))).alias("ragged"), vec.l2_squared(a, b).alias("d"), vec.cosine(a, F.lit(None).cast("array<double>")).alias("none"))
    assert abs(r.c - 8 / 9) < 1e-12 and (r.zero, r.ragged, r.d, r.none) == (0, 0, 2, 0)


# -- retrieval ----------------------------------------------------------------------

DOCS = [(1, "the red fox jumps", "a"), (2, "red red fox", "a"), (3, "blue whale", "b"), (4, None, "b"), (5, "", "c"), (6, "red fox", "a"), (7, "red fox", "a")]


def test_hybrid_recall_caps_sources_and_breaks_ties_by_id(spark):
    chunks = spark.createDataFrame(DOCS, "id long, text string, source string")
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(1, 8)], "id long, v array<double>")
    asked = spark.createDataFrame([(1, "Red FOX?")], "query_id long, text string")
    got = hybrid_recall(chunks, asked, vectors, spark.createDataFrame([(1, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0])], "query_id long, v array<double>"), {"rrf": 1.0, "bm25": 0.5}).orderBy("place").collect()
    assert len({r.id for r in got}) == len(got) and sum(r.source == "a" for r in got) == 3
    for r in got:
        assert abs(sum(r.match_features.values()) - r.score) < 1e-6
    assert [(r.score, r.id) for r in got] == sorted(((r.score, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_bm25_by_hand(spark):
    index = retrieval.postings(spark.createDataFrame(DOCS, "id long, text string, source string"), "id", "text")
    got = {r.id: (r.score, r.lane_rank) for r in retrieval.bm25_lane(index, spark.createDataFrame([(1, "whale whale")], "q long, t string"), "q", "t", 5).collect()}
    idf = np.log(1 + (5 - 1 + 0.5) / 1.5)
    assert got == {3: (round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.6)), 6), 0)}
    assert retrieval.bm25_lane(index, spark.createDataFrame([(1, "none"), (2, None)], "q long, t string"), "q", "t", 5).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_dense_lane_is_exact(spark, metric):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 4)).round(3)
    m[10] = m[11]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(99, None), (98, [1.0])], "id long, v array<double>")
    got = {}
    for r in retrieval.dense_lane(df, "id", "v", df.filter("id < 3"), "id", "v", 5, metric).collect():
        got.setdefault(r.query_id, {})[r.lane_rank] = r.id
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        d = np.round(((m - m[q]) ** 2).sum(1) if metric == "l2" else 1 - unit @ unit[q], 6)
        assert [got[q][i] for i in range(5)] == sorted(range(50), key=lambda j: (d[j], j))[:5]
    assert retrieval.dense_lane(df, "id", "v", df.limit(0), "id", "v", 5).count() == 0


def test_boosts(spark):
    r = one(spark, retrieval.identifier_boost(F.lit(1.0), F.lit("code"), F.lit("fn Fold_Map()"), F.lit("fold_map")).alias("a"), retrieval.identifier_boost(F.lit(1.0), F.lit("code"), F.lit("how to fold a map"), F.lit("how to fold a map")).alias("b"), retrieval.self_reference(F.lit(1.0), F.lit(True), F.lit(12.0)).alias("c"), retrieval.self_reference(F.lit(1.0), F.lit(True), F.lit(None).cast("double")).alias("d"))
    assert (r.a, r.b, r.c, r.d) == (4.0, 1.0, 0.0, 1.0)


# -- rows ---------------------------------------------------------------------------


def test_rules(spark):
    mine = (rows.Rule(tag="t1", contains="x"), rows.Rule(tag="t2", prefix="ab"), rows.Rule(contains="drop", roles=("user",)))
    df = spark.createDataFrame([("  ab x", "user"), ("ab", "user"), ("x drop", "user"), ("x drop", None), (None, "user")], "t string, r string")
    assert [r.d for r in df.select(rows.decide(mine, F.col("t"), F.lit("s"), F.col("r")).alias("d")).collect()] == ["t1", "t2", "drop", "t1", "keep"]
    for bad in ({}, {"tag": " ", "prefix": "x"}):
        with pytest.raises(ValueError):
            rows.Rule(**bad)


def test_facets(spark):
    f = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(spark, rows.facet_map(f("a:1", "a:0", "b:x:y", ":z", "c:")).alias("m"), rows.overlay_facets(f("lang:en", "tags:a"), f("lang:de", "tags:b")).alias("o"), rows.overlay_facets(f("lang:en"), f("lang:")).alias("gone"), rows.facet_header(f("status:s", "lang:en", "other:x")).alias("h"))
    assert r.m == {"a": ["0", "1"], "b": ["x:y"]} and r.o == ["lang:de", "tags:a", "tags:b"] and r.gone == [] and r.h == "lang:en|status:s"


def test_sql_gate(spark):
    audit = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "event string, success boolean")
    assert rows.audit_sql(audit, " select event FROM audit_events WHERE success = FALSE ; ").count() == 1
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT ';' , 1", "SELECTED", ""):
        with pytest.raises(ValueError):
            rows.sql_gate(bad)


def test_upsert_drift_and_tier_two(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "")], "chunk_id string, embedding_input_sha256 string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("c", ""), ("d", "h4")], "chunk_id string, embedding_input_sha256 string")
    assert sorted(r.chunk_id for r in rows.tier_two(new, old).collect()) == ["b", "c", "d"]
    assert rows.upsert(old, new, "chunk_id").count() == 4
    d = rows.drift(new.unionAll(new.limit(1)), old).first()
    assert (d.extra, d.missing, d.shared, d.doubled_corpus) == (0, 1, 3, 1)


# -- graph and ledger ------------------------------------------------------------------


def test_diffusion(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.8), ("c", "d", 1.0), ("a", "x", 0.05)], "a string, b string, w double")
    seeds = spark.createDataFrame([("a", "a", 1.0)], "seed string, handle string, activation double")
    got = {r.handle: r.activation for r in graph.diffuse(seeds, graph.undirected(edges)).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.2}


def test_edges_and_resolution(spark):
    t = spark.createDataFrame([("a", "r", "b", 0.2, "authored", 1, 1), ("a", "r", "b", 0.9, "observed", 5, 2), ("a", "r", "a", 1.0, "x", 1, 3), (None, "r", "b", 1.0, "x", 1, 4)], "a string, relation string, b string, confidence double, source string, micros long, seq long")
    e = graph.upserted_edges(t).collect()
    assert [(r.a, r.b, r.confidence, r.touch_count, r.source, r.last_micros) for r in e] == [("a", "b", 0.9, 2, "authored", 5)]
    concepts = spark.createDataFrame([("", "fold", None), ("p", "lens", "fold"), ("", "x", "y"), ("", "y", "x")], "project string, handle string, merged_into string")
    aliases = spark.createDataFrame([("p", "fold-alias", "lens")], "project string, alias string, handle string")
    names = spark.createDataFrame([("p", "fold-alias"), ("p", "fold"), ("p", "x"), ("p", "nothing")], "project string, name string")
    assert {(r.name, r.handle) for r in graph.resolve(names, concepts, aliases).collect()} == {("fold-alias", "fold"), ("fold", "fold")}


def test_states(spark):
    state = lambda s, x: one(spark, ledger.curator_state(F.lit(s), F.lit(x)).alias("s")).s
    assert [state("active", 0.96), state("slack", 0.96), state("active", 0.5), state("dormant", 0.06), state("slack", 0.06)] == ["active", "slack", "slack", "dormant", "archived"]
    faded = lambda s, r, d: one(spark, ledger.fade_state(F.lit(s), F.lit(r), F.lit(d)).alias("s")).s
    assert [faded("active", 0, 15.0), faded("active", 20, 15.0), faded("slack", 0, 15.0), faded("active", 0, 61.0), faded("dormant", 0, 20.0)] == ["slack", "active", "slack", "dormant", "dormant"]


def test_portfolio_and_signals(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, "s1", 300), (1, "b", 0.8, "s1", 10), (1, "c", 0.7, "s2", 900), (1, "d", 0.6, "s3", 200)], "query_id long, id string, score double, sha string, n_tokens long")
    assert [(r.id, r.seat) for r in ledger.portfolio(hits, budget=600, least=50).orderBy("seat").collect()] == [("a", 0), ("d", 1)]
    r = one(spark, signals.composite({"density": F.lit(0.6), "activity": F.lit(None).cast("double"), "novelty": F.lit(0.3)}, {"density": float("nan"), "activity": -1.0}).alias("c"))
    assert r.c == 0.3


def test_incremental_scan(spark):
    chunks = spark.createDataFrame([("c1", "s", "f", "h1"), ("c2", "s", "f", "h2")], "chunk_id string, source string, source_id string, sha256 string")
    manifest = spark.createDataFrame([("c1", "s", "f", "h1"), ("c3", "s", "f", "h3"), ("c4", "s", "g", "h4")], "chunk_id string, source string, source_id string, content_sha256 string")
    new, gone = incremental_scan(chunks, manifest)
    assert [r.chunk_id for r in new.collect()] == ["c2"] and [r.chunk_id for r in gone.collect()] == ["c3"]


# -- sources -------------------------------------------------------------------------


def test_document_sources(spark, tmp_path):
    (tmp_path / "notes" / ".git").mkdir(parents=True)
    (tmp_path / "notes" / "a.md").write_text("intro\n# One\n## Two\ntext\n### Sub\n##NotAHead\n## Three\nmore\n")
    (tmp_path / "notes" / "B.MD").write_text("\n\n".join("para %d " % i + "x" * 3000 for i in range(6)))
    (tmp_path / "notes" / ".git" / "c.md").write_text("hidden")
    (tmp_path / "notes" / "t.txt").write_text("a\n\nb")
    (tmp_path / "notes" / "m.py").write_text('"""Doc."""\nimport os\n\n# about f\ndef f():\n    pass\n\nclass C:\n    def g(self):\n        pass\n')
    (tmp_path / "notes" / "w.js").write_text("".join(f"x{i}()\n" for i in range(450)))
    root = str(tmp_path / "notes")
    md = documents.markdown(spark, root).orderBy("source_id", "chunk_index").collect()
    a = [r.text for r in md if r.source_id.endswith("a.md")]
    assert a == ["intro\n# One", "## Two\ntext\n### Sub\n##NotAHead", "## Three\nmore"] and {r.source_id for r in md} == {"a.md", "B.MD"}
    big = [r.text for r in md if r.source_id == "B.MD"]
    assert len(big) > 1 and all(len(t) <= 16000 for t in big) and big[1][:700] in big[0]
    assert documents.markdown(spark, root, paths=["a.md"]).count() == 3
    assert [r.text for r in documents.plain(spark, root).collect()] == ["a\n\nb"]
    code = documents.code(spark, root).orderBy("source_id", "chunk_index").collect()
    assert [json.loads(r.extra).get("symbols") for r in code if r.source_id == "m.py"] == [[""], ["f"], ["C"]]
    assert [json.loads(r.extra)["line_start"] for r in code if r.source_id == "w.js"] == [1, 181, 361]


def test_session_sources(spark, tmp_path):
    d = tmp_path / "-Users-x-demo"
    d.mkdir()
    lines = [{"type": "summary"}, {"type": "user", "message": {"role": "user", "content": "hello"}, "timestamp": "2026-01-01T00:00:00Z"}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "one"}, {"type": "tool_use", "name": "t"}, {"type": "text", "text": "two"}]}}, "broken"]
    (d / "s.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    got = sessions.session_blocks(spark, str(tmp_path)).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["hello", "one", "two"] and [len(r.parent_ids) for r in got] == [0, 1, 1] and got[1].parent_ids[0] == got[0].chunk_id
    assert all(r.ts == dt.datetime(2026, 1, 1) for r in got) and got[0].project == "demo"
    roll = [("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d")]
    (d / "rollout-1.jsonl").write_text("\n".join(json.dumps({"type": "response_item", "payload": {"role": r, "content": [{"text": t}], "cwd": "/home/x/proj"}}) for r, t in roll))
    got = sessions.rollouts(spark, str(tmp_path)).collect()
    assert [(r.text, r.project) for r in got] == [("### User\na\n\nb\n\n### Assistant\nc", "proj")]
    (d / "session-1.json").write_text(json.dumps({"sessionId": "s", "messages": [{"type": "user", "content": "q"}, {"type": "gemini", "content": "r"}, {"type": "gemini", "content": "again"}]}))
    assert [r.text for r in sessions.paired(spark, str(tmp_path)).collect()] == ["### User\nq\n\n### Assistant\nr"]
    with zipfile.ZipFile(d / "e.zip", "w") as z:
        z.writestr("x/conversations.json", json.dumps([{"uuid": "c1", "chat_messages": [{"uuid": "m1", "text": "hi", "sender": "human"}, {"uuid": "m2", "text": " ", "sender": "assistant"}, {"uuid": "m3", "text": "yo", "sender": "assistant"}]}, {"uuid": "c2", "chat_messages": [{"uuid": "m4", "text": "z", "sender": "human"}]}]))
    got = sessions.zip_exports(spark, str(tmp_path)).orderBy("chunk_index").collect()
    assert [(r.source_id.split("/")[-1], r.chunk_index, len(r.parent_ids)) for r in got] == [("e.zip:c1:m1", 0, 0), ("e.zip:c1:m3", 1, 1), ("e.zip:c2:m4", 2, 0)]
    (d / "journal.jsonl").write_text("\n".join(json.dumps(x) for x in [{"ts": "t", "event": "decision"}, {"ts": "t", "event": "tool", "tool": "bash", "duration_ms": 40000}, {"ts": "t", "event": "tool", "success": False}, {"ts": "t", "event": "tool"}, {"ts": "t", "event": "escalation.up"}]))
    audit = sessions.audit_rows(spark, str(tmp_path))
    assert audit.count() == 5 and sessions.significant(audit).count() == 4


# -- streaming -----------------------------------------------------------------------


def test_stream_ends_where_the_replay_does(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows_ = [(f"s{i % 3}", i // 2, i, rng.normal(size=4).tolist()) for i in range(30)]
    schema = "scope string, ts long, seq long, vector array<double>"
    src = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame(rows_[n * 10 : n * 10 + 10], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = observer.observe(stream).writeStream.outputMode("update").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.scope: r for r in spark.sql("SELECT scope, max_by(struct(turns, resonant, rolling), turns) AS x FROM seen GROUP BY scope").select("scope", "x.*").collect()}
    for r in observer.replay(spark.createDataFrame(rows_, schema)).collect():
        assert last[r.scope].turns == r.turns and last[r.scope].resonant == r.resonant and np.allclose(last[r.scope].rolling, r.rolling)


def test_fold_skips_null_vectors():
    rolling, turns, resonant, drift = observer.fold(pd.DataFrame({"ts": [1, 2], "seq": [1, 2], "vector": [None, [3.0, 4.0]]}), None)
    assert turns == 1 and np.allclose(rolling, [0.6, 0.8])


def test_batches_replace_themselves(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int").coalesce(1).write.parquet(src)
    for cp in ("cp1", "cp2"):  # a second run without the first one's checkpoint replays the batch
        observer.sink_batches(spark.readStream.schema("k string, v int").parquet(src), out, str(tmp_path / cp), "k").awaitTermination(120)
    assert spark.read.parquet(out).count() == 2


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
