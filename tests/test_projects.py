import json

from pyspark.sql import functions as F

from strandloom.sources import projects


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n"


def project(tmp_path):
    own = tmp_path / ".state"
    write(own / "decisions.jsonl", lines({"key": "k", "value": "v", "status": "open", "reason": "r"}, "not json", {"other": 1}))
    write(own / "needles/issues.jsonl", lines({"id": "→1", "status": "open", "title": "T", "description": "D", "ac": ["x"]}, {"id": "2", "status": "open", "title": "no mark"}, {"id": "→3", "title": "no status"}, "{bad"))
    write(own / "memory/pages.jsonl", lines({"name": "one", "file_id": "f1", "stored_at": "2026-01-02T03:04:05Z"}, {"name": "two", "file_id": "f2"}, {"name": "three"}, {"name": "lost", "file_id": "nothing"}))
    write(own / "memory/f1.page", "first")
    write(own / "memory/f2", "second")
    write(own / "memory/three.page", "third")
    write(own / "conversations/c.jsonl", lines({"from": "a", "to": "b", "msg": "hello", "turn": 4}, {"from": "a", "msg": " "}))
    write(own / "journal.jsonl", lines({"ts": "2026-01-01T00:00:00Z", "event": "handoff"}, {"ts": "2026-01-01T00:00:01Z", "event": "tick"}, {"event": "tick", "success": False}))
    write(tmp_path / "docs/spec/a.md", "# A\n\n## B\ntext\n")
    write(tmp_path / "docs/other/b.md", "# no\n")
    write(tmp_path / "src/m.py", "def f():\n    return 1\n")
    return str(tmp_path)


def test_scan_by_area(spark, tmp_path):
    root = project(tmp_path)
    got = {}
    for r in projects.scan(spark, root).collect():
        got.setdefault(r.source, []).append((r.source_id, r.text))
    assert {k: len(v) for k, v in got.items()} == {"decision": 1, "issue": 1, "memory": 3, "conversation": 1, "audit": 2, "spec": 2, "code": 1}
    assert got["issue"] == [("→1", 'T\n\nD\n\n["x"]')] and sorted(got["memory"]) == [("one", "first"), ("three", "third"), ("two", "second")]
    assert got["conversation"] == [("c:4", "a → b: hello")] and all(s.startswith("docs/spec/") for s, _ in got["spec"]) and got["code"][0][0] == "src/m.py"
    some = projects.scan(spark, root, paths=["docs/spec/a.md", ".state/needles/issues.jsonl", "README.md"])
    assert {r.source for r in some.select("source").distinct().collect()} == {"spec", "issue"}
    assert projects.scan(spark, str(tmp_path / "docs/other")).count() == 0


def test_routes(spark):
    paths = {".state/decisions.jsonl": "decisions", ".state/journal.jsonl": "audit", ".state/needles/x": "issues", ".state/memory/a.page": "memory", ".state/locks/a": None, "docs/draft/x.MD": "specs", "docs/x.md": None, "crates/a/b.rs": "code", "src/a.txt": None, "tools/a.py": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.a for r in df.select("p", projects.sub_area(F.col("p")).alias("a")).collect()} == paths


def test_sealed_segments_once(spark, tmp_path):
    write(tmp_path / "epoch-1.jsonl", lines({"ts": "t", "event": "a"}, {"ts": "t", "event": "b"}))
    write(tmp_path / "journal.jsonl", lines({"ts": "t", "event": "open"}))
    rows, marks = projects.sealed(spark, str(tmp_path))
    assert rows.count() == 2
    done = spark.createDataFrame(marks.collect(), marks.schema)
    write(tmp_path / "epoch-2.jsonl", lines({"ts": "t", "event": "c"}))
    rows, marks = projects.sealed(spark, str(tmp_path), done)
    assert [r.event for r in rows.collect()] == ["c"] and marks.count() == 1


def test_ignore_files(spark, tmp_path):
    rules = ["# c", "", "*.log", "!keep.log", "/top", "out/", "a/**/z.txt", "doc?.md", "tmp/*"]
    want = {"x.log": True, "d/keep.log": False, "top/a": True, "d/top": False, "out/a": True, "d/out/b": True, "outer": False, "a/z.txt": True, "a/b/c/z.txt": True, "b/z.txt": False, "doc1.md": True, "doc12.md": False, "tmp/x": True}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.x for r in df.select("p", projects.ignored(F.col("p"), rules).alias("x")).collect()} == want
    for p in ("a.md", "b.log", "sub/c.md", "sub/d.tmp"):
        write(tmp_path / p, "x")
    write(tmp_path / ".gitignore", "*.log\n")
    write(tmp_path / ".scanignore", "sub/*.tmp\n")
    assert {r.source_id.lstrip("/") for r in projects.walked(spark, str(tmp_path)).collect()} == {"a.md", "sub/c.md"}
