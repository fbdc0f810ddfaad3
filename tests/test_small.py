import pytest
from pyspark.sql import functions as F

from strandloom.functions import guards, text
from strandloom.operators import graph
from strandloom.plans import files
from strandloom.queries import QUERIES
from strandloom.sources import documents


def test_guards():
    assert guards.duration_seconds("24h") == 86_400 and guards.duration_seconds("1w") == 604_800
    assert guards.privacy_gate("t0_private", "t1_shared") == "t0_private"
    assert guards.clamped({"a": float("nan"), "b": 9.0}, {"a": (0.5, 0, 1), "b": (0.1, 0, 1), "c": (2, 0, 5)}) == {"a": 0.5, "b": 1, "c": 2}
    for bad in (lambda: guards.duration_seconds("soon"), lambda: guards.privacy_gate("t2_public", "t0_private"), lambda: guards.unique_configs(["a", "a"])):
        with pytest.raises(ValueError):
            bad()


def test_files(tmp_path):
    page = files.portfolio_markdown([{"seat": 1, "id": "b"}, {"seat": 0, "id": "a", "excerpt": "x "}])
    assert page.startswith("## 1. a\n\nx\n\n## 2. b") and files.portfolio_markdown([]) == ""
    assert files.write_if_changed(str(tmp_path / "d" / "p.md"), page) and not files.write_if_changed(str(tmp_path / "d" / "p.md"), page)
    assert "handle: fold-map" in files.crystallize(str(tmp_path), "idea", "fold-map", "s").read_text()
    with pytest.raises(FileExistsError):
        files.crystallize(str(tmp_path), "idea", "fold-map", "again")


def test_links_and_front_matter(spark):
    df = spark.createDataFrame([("a/b/c.md", "[x](../d.md#top) [y](./e.md) [z](http://x/y.md) [s](c.md) [i](p.png) [r](/top.md)"), ("m.md", "---\nlikes: one\nuses:\n  - two\n  - 'three'\ntags: [p, q]\n---\nbody"), ("n.md", None)], "source_id string, text string")
    assert {(r.a, r.b) for r in documents.link_edges(df).collect()} == {("a/b/c.md", "a/d.md"), ("a/b/c.md", "a/b/e.md"), ("a/b/c.md", "top.md")}
    assert {(r.relation, r.b) for r in documents.typed_edges(df, ["likes", "uses", "tags"]).collect()} == {("likes", "one"), ("uses", "two"), ("uses", "three"), ("tags", "p"), ("tags", "q")}


def test_gazetteer_long_forms(spark):
    long = "one two three four five six seven eight"
    texts = spark.createDataFrame([(1, f"so {long} nine"), (2, "one two")], "id long, norm string")
    forms = spark.createDataFrame([(long,), ("one two",)], "form string")
    assert {(r.id, r.form) for r in graph.gazetteer(texts, forms).collect()} == {(1, long), (2, "one two")}
    assert graph.gazetteer(texts, forms.limit(0)).count() == 0


def test_lens_takes_more_than_three_of_a_source(spark, tmp_path):
    docs = [(i, f"amber stone {i} " + "word " * 97, "notes", "same" if i < 8 else f"file {i}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, source_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "amber stone")], "item_id long, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(i, [1.0, i / 100]) for i in range(60)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ids = [r.id for r in QUERIES["lens_portfolio"](spark, str(tmp_path)).collect()]
    assert len(ids) == 32 and sum(i < 8 for i in ids) == 3


def test_phrase_names_of_any_shape(spark, tmp_path):
    names = ["orrery", "fold-map", "a-b-c", "lane2", "größe", None]
    spark.createDataFrame([("h", n) for n in names], "handle string, project string").write.parquet(f"{tmp_path}/emergent_reports.parquet")
    bodies = [(1, "s", "the Orrery2 and xa_b_c"), (2, "s", "orrery LANE2 fold_map"), (3, "t", "die größe"), (4, "t", None)]
    kind = "row_id long, session_id string, message struct<content: array<struct<type: string, text: string>>>"
    spark.createDataFrame([(i, s, ([("text", b)],)) for i, s, b in bodies], kind).write.parquet(f"{tmp_path}/session_messages.parquet")
    got = {tuple(r) for r in QUERIES["phrase_cooccurrence"](spark, str(tmp_path)).collect()}
    assert got == {("orrery", 2, 1), ("fold-map", 1, 1), ("a-b-c", 1, 1), ("lane2", 1, 1), ("größe", 1, 1)}


def test_names_in_texts_both_ways(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "c"), (3, ""), (4, None)], "id long, body string")
    names = spark.createDataFrame([("abc",), ("c",), ("cd",)], "name string")
    few, many = ({(r.id, r.name) for r in graph.containing(texts, names, n).collect()} for n in (10, 0))
    assert few == many == {(1, "abc"), (1, "c"), (2, "c")}


def test_gazetteer_longest_first(spark):
    texts = spark.createDataFrame([(1, "the fold map and fold"), (2, "nothing"), (3, None), (4, "fold map and fold map")], "id long, norm string")
    forms = spark.createDataFrame([("fold",), ("fold map",), ("map and",), ("and fold",), ("fold",)], "form string")
    assert {(r.id, r.form) for r in graph.gazetteer(texts, forms).collect()} == {(1, "fold map"), (1, "and fold"), (4, "fold map"), (4, "and fold")}


def test_ring_and_specificity(spark):
    t = spark.createDataFrame([("s", i % 12, i) for i in range(24)] + [("t", 1, 1)], "k string, item long, at long")
    got = [(r.item, r.place) for r in graph.focus_ring(t, "k", "item", ["at"], 3).filter("k = 's'").orderBy("place").collect()]
    assert got == [(11, 1), (10, 2), (9, 3)]
    s = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "p"), ("b", "p")], "t string, p string")
    assert {r.t: r.specificity for r in graph.span_specificity(s, "t", "p").collect()} == {"a": 0.0, "b": 1.0}
    assert spark.range(1).select(text.mentions(F.lit("a b-c"), F.lit("b-c")).alias("x")).first().x
