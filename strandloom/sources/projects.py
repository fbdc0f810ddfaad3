"""A project's folder: issues, journals, memory pages, specs, code, by sub-area.

``state`` is the folder in which a project's tools keep their records.  Missing
folders and files give no rows; lines that are no JSON are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources import as_chunks, as_text, files
from strandloom.sources import documents as docs
from strandloom.sources import sessions as logs

STATE = ".state"
# The mark that an issue's id begins with, what a sub-area is called and where its files lie.
ISSUE_MARK = "→"
CODE = ("py", "rs", "go", "js", "ts", "tsx")
#: The sources of each kind of configured input.
KINDS: dict[str, tuple[str, ...]] = {
    "markdown": ("markdown",), "code": ("code",), "claude_code": ("claude_code",), "codex": ("codex",), "gemini": ("gemini",), "file_glob": ("file_glob",), "zip_export": ("zip_export",),
    "thread": ("thread",), "project": ("decision", "issue", "audit", "conversation", "assistant_session", "memory", "spec", "code"),
}
TRANSCRIPTS = ("claude_code", "codex", "gemini")


def sub_area(path: Column, state: str = STATE) -> Column:
    """The sub-area that a changed path, relative to the project, belongs to; null for none."""
    inside = path.startswith(f"{state}/")
    rest = F.substring(path, len(state) + 2, 10_000)
    first = F.element_at(F.split(rest, "/"), 1)
    own = F.when(rest == "decisions.jsonl", "decisions").when(rest.isin("audit.jsonl", "journal.jsonl"), "audit").when(first == "needles", "issues")
    own = own.when(first == "conversations", "conversations").when(first == "sessions", "sessions").when(first == "memory", "memory")
    return F.when(inside, own).when(path.rlike(r"(?i)^docs/(?:spec|draft)/.*\.md$"), "specs").when(path.rlike(r"^(?:src|crates|lib)/.*\.(?:" + "|".join(CODE) + ")$"), "code")


def _empty(spark: SparkSession) -> DataFrame:
    blank = spark.createDataFrame([], "source_id string, text string")
    return as_chunks(blank, "none", ["source_id"])


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def issues(spark: SparkSession, root: str, config: str = "", state: str = STATE) -> DataFrame:
    """Issues that have a status and an id with its mark: title, description, criteria."""
    folder = f"{root}/{state}/needles"
    if not _there(spark, folder):
        return _empty(spark)
    get = lambda p: F.get_json_object("line", p)
    rows = logs._lines(spark, folder, "issues.jsonl").filter(get("$.status").isNotNull() & get("$.id").startswith(ISSUE_MARK))
    text = F.concat_ws("\n\n", F.coalesce(get("$.title"), F.lit("")), F.coalesce(get("$.description"), F.lit("")), F.coalesce(get("$.ac"), F.lit("")))
    return as_chunks(rows.select(get("$.id").alias("source_id"), "line_no", F.to_timestamp(get("$.created_at")).alias("ts"), text.alias("text")), "issue", ["line_no"], config=config)


def memory_pages(spark: SparkSession, root: str, config: str = "", state: str = STATE) -> DataFrame:
    """Pages of the index with the body of the file named by id, with or without its
    ending, else by name; pages without a body are passed over."""
    folder = f"{root}/{state}/memory"
    if not _there(spark, folder):
        return _empty(spark)
    get = lambda p: F.get_json_object("line", p)
    index = logs._lines(spark, folder, "pages.jsonl").select("line_no", get("$.name").alias("name"), get("$.file_id").alias("file_id"), F.to_timestamp(get("$.stored_at")).alias("ts")).filter("name is not null")
    body = files(spark, folder).filter("source_id not like '%pages.jsonl'").select(F.col("source_id").alias("file"), as_text(F.col("content")).alias("body"))
    found = lambda df, key, name: df.join(body.select(F.col("file").alias(f"{name}_file"), F.when(F.col("body").rlike(r"\S"), F.col("body")).alias(name)), key == F.col(f"{name}_file"), "left")
    rows = found(found(found(index, F.concat("file_id", F.lit(".page")), "one"), F.col("file_id"), "two"), F.concat("name", F.lit(".page")), "three")
    return as_chunks(rows.select(F.col("name").alias("source_id"), "line_no", "ts", F.coalesce("one", "two", "three").alias("text")).filter("text is not null"), "memory", ["line_no"], config=config)


def specs(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Specifications and drafts through the Markdown splitter."""
    out = None
    for folder in ("docs/spec", "docs/draft"):
        if _there(spark, f"{root}/{folder}"):
            one = docs.markdown(spark, f"{root}/{folder}", config, source="spec", prefix=f"{folder}/")
            out = one if out is None else out.unionByName(one)
    return _empty(spark) if out is None else out


def project_code(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Code below the project's code folders."""
    out = None
    for folder in ("src", "crates", "lib"):
        if _there(spark, f"{root}/{folder}"):
            one = docs.code(spark, f"{root}/{folder}", config=config, prefix=f"{folder}/")
            out = one if out is None else out.unionByName(one)
    return _empty(spark) if out is None else out


def scan(spark: SparkSession, root: str, config: str = "", state: str = STATE, paths: list[str] | None = None) -> DataFrame:
    """All sub-areas of a project, or those that ``paths`` (relative) belong to."""
    root = root.rstrip("/")
    wanted = None
    if paths is not None:
        named = spark.createDataFrame([(p,) for p in paths], "path string")
        wanted = {r["a"] for r in named.select(sub_area(F.col("path"), state).alias("a")).distinct().collect()}
    own = f"{root}/{state}"
    parts = {
        "decisions": lambda: logs.decisions(spark, own, config), "issues": lambda: issues(spark, root, config, state), "memory": lambda: memory_pages(spark, root, config, state),
        "conversations": lambda: logs.turns(spark, f"{own}/conversations", config) if _there(spark, f"{own}/conversations") else _empty(spark),
        "sessions": lambda: logs.session_blocks(spark, f"{own}/sessions", config=config) if _there(spark, f"{own}/sessions") else _empty(spark),
        "audit": lambda: audit_chunks(spark, own, config), "specs": lambda: specs(spark, root, config), "code": lambda: project_code(spark, root, config),
    }
    out = _empty(spark)
    for area, read in parts.items():
        if (wanted is None or area in wanted) and (area in ("specs", "code") or _there(spark, own)):
            out = out.unionByName(read())
    return out


def audit_chunks(spark: SparkSession, folder: str, config: str = "") -> DataFrame:
    """Significant audit rows as chunks with their facet."""
    rows = logs.significant(logs.audit_rows(spark, folder))
    return as_chunks(rows.select(F.col("row_key").alias("source_id"), F.to_timestamp("ts").alias("ts"), F.col("raw").alias("text"), F.lit('{"facets":["record_kind:audit_significant"]}').alias("extra")), "audit", ["source_id"], config=config)


def sealed(spark: SparkSession, folder: str, done: DataFrame | None = None, glob: str = "epoch-*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Rows of sealed segments that no earlier call has read, and the marks (path,
    size_bytes, mtime_micros) of what is read now; a changed file is read again."""
    found = files(spark, folder, glob).select("source_id", F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime_micros"))
    marks = found.select(F.col("source_id").alias("path"), "size_bytes", "mtime_micros")
    if done is not None:
        marks = marks.join(done.select("path", "size_bytes", "mtime_micros"), ["path", "size_bytes", "mtime_micros"], "left_anti")
    rows = logs.audit_rows(spark, folder, glob, among=marks.select(F.col("path").alias("source_id")))
    return rows, marks


# -- ignore files -----------------------------------------------------------------


def ignore_patterns(lines: list[str]) -> list[tuple[bool, str]]:
    """(keeps, regular expression) of each rule of an ignore file, in order: ``!`` keeps,
    a slash inside binds to the root, one at the end means folders, ``**`` any depth."""
    out = []
    for line in lines:
        rule = re.sub(r"(?<!\\)\s+$", "", line)
        if not rule or rule.startswith("#"):
            continue
        keeps = rule.startswith("!")
        rule = rule[1:] if keeps else rule
        folder = rule.endswith("/")
        rule = rule.rstrip("/")
        bound = "/" in rule
        body = ""
        for part in re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\])", rule.lstrip("/")):
            body += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if re.fullmatch(r"\[[^\]]+\]", part) else re.escape(part))
        out.append((keeps, ("^" if bound else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")))
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the rules leave a relative path out: the last one that matches decides."""
    out = F.lit(False)
    for keeps, pattern in ignore_patterns(lines):
        out = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(out)
    return out


def _read(spark: SparkSession, path: str) -> str:
    """A small configuration file, hidden or not; empty where there is none."""
    if not _there(spark, path):
        return ""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def walked(spark: SparkSession, root: str, glob: str | None = None, names: tuple[str, ...] = (".gitignore", ".scanignore"), more: tuple[str, ...] = ()) -> DataFrame:
    """``files`` without those that the root's ignore files or ``more`` rules leave out.

    Ignore files are configuration and are read on the driver.
    """
    lines: list[str] = []
    for name in names:
        lines += _read(spark, f"{root.rstrip('/')}/{name}").splitlines()
    return files(spark, root, glob).filter(~ignored(F.col("source_id"), [*lines, *more]))
