"""Markdown, plain text, front matter and code files."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.schema import CHUNK_BYTES, CHUNK_TOKENS, OVERLAP_BYTES
from strandloom.sources import as_chunks, as_text, files


def pack(text: str, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[str]:
    """Paragraphs packed up to ``size`` bytes; each later piece repeats the tail
    of the one before; what has grown beyond twice the size is given out at once."""
    out, held = [], ""
    for part in re.split(r"\n[ \t]*\n", text):
        if not part.strip():
            continue
        joined = f"{held}\n\n{part}" if held else part
        if held and len(joined.encode()) > size:
            out.append(held)
            tail = held.encode()[-overlap:].decode("utf-8", "ignore")
            joined = f"{tail}\n\n{part}"
        held = joined
        if len(held.encode()) > 2 * size:
            out.append(held)
            held = ""
    return out + [held] if held.strip() else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _packed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if t is None else pack(t))


def sections(text: Column) -> Column:
    """Pieces that begin at second-level headings; other headings do not split."""
    return F.filter(F.transform(F.split(text, r"(?m)(?=^##(?:[ ]|\r?$))"), lambda s: F.rtrim(F.regexp_replace(s, r"\s+$", ""))), lambda s: s.rlike(r"\S"))


def markdown(spark: SparkSession, root: str, config: str = "", paths: list[str] | None = None, source: str = "markdown", prefix: str = "") -> DataFrame:
    """``.md`` files cut at second-level headings, oversized sections packed; ``prefix``
    goes before their ids."""
    found = files(spark, root, "*.[mM][dD]", paths=paths)
    rows = found.select(F.concat(F.lit(prefix), "source_id").alias("source_id"), F.col("modificationTime").alias("ts"), F.posexplode(sections(as_text(F.col("content")))).alias("pos", "s"))
    large = F.octet_length("s") / 4 > CHUNK_TOKENS
    rows = rows.select("source_id", "ts", "pos", F.posexplode(F.when(large, _packed(F.when(large, F.col("s")))).otherwise(F.array("s"))).alias("part", "text"))
    return as_chunks(rows, source, ["pos", "part"], config=config)


def plain(spark: SparkSession, root: str, glob: str = "*.txt", config: str = "") -> DataFrame:
    """Text files as packed paragraphs."""
    rows = files(spark, root, glob).select("source_id", F.col("modificationTime").alias("ts"), F.posexplode(_packed(as_text(F.col("content")))).alias("pos", "text"))
    return as_chunks(rows, "file_glob", ["pos"], config=config)


def line_windows(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Windows of lines; the last one reaches the end of the text."""
    lines = F.split(text, r"(?<=\n)")
    n = F.size(lines)
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / stride).cast("int") * stride), F.lit(stride))
    return F.transform(starts, lambda i: F.struct(i.alias("first"), F.array_join(F.slice(lines, i + 1, F.lit(size)), "").alias("text")))


_SYMBOL = re.compile(
    r"^(?:pub(?:\([^)]*\))?\s+|export\s+(?:default\s+)?|async\s+|unsafe\s+|static\s+)*"
    r"(?P<kind>fn|struct|enum|trait|impl|mod|class|interface|function|func|type)\s+(?:<[^>]*>\s*)?(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_][A-Za-z0-9_]*)"
)
_DOC = re.compile(r"^\s*(?://|/\*|\*|#\[|@|#)")


def symbols(text: str, path: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, body): top-level symbols with the
    comment and attribute lines before them.

    Python files are parsed; of other languages a symbol is a line at the margin
    that declares one, up to the next.  What precedes the first is the header.
    """
    lines = text.splitlines()
    marks: list[tuple[int, str, str]] = []
    if path.endswith(".py"):
        try:
            for node in ast.parse(text).body:
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
                    marks.append((first - 1, "class" if isinstance(node, ast.ClassDef) else "function", node.name))
        except (SyntaxError, ValueError):
            marks = []
    else:
        for i, line in enumerate(lines):
            if m := _SYMBOL.match(line):
                marks.append((i, m["kind"], m["name"]))
    out = []
    starts = []
    for at, kind, name in marks:
        first = at
        while first > 0 and at - first < 200 and _DOC.match(lines[first - 1]):
            first -= 1
        starts.append((first, kind, name))
    if starts and starts[0][0] > 0:
        out.append(("header", "", 1, min(starts[0][0], 200), "\n".join(lines[: min(starts[0][0], 200)])))
    for i, (first, kind, name) in enumerate(starts):
        end = starts[i + 1][0] if i + 1 < len(starts) else len(lines)
        out.append((kind, name, first + 1, end, f"// {kind} {name}\n" + "\n".join(lines[first:end]).rstrip()))
    return [x for x in out if x[4].strip()]


_SYMBOLS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_SYMBOLS)
def _symbols(texts: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else symbols(t, p) for t, p in zip(texts, paths)])


def code(spark: SparkSession, root: str, glob: str = "*.{py,rs,go,js,ts,tsx}", config: str = "", prefix: str = "") -> DataFrame:
    """Code files by symbol; files without any by windows of lines; ``prefix`` goes before their ids."""
    found = files(spark, root, glob).select(F.concat(F.lit(prefix), "source_id").alias("source_id"), F.col("modificationTime").alias("ts"), as_text(F.col("content")).alias("t"))
    found = found.withColumn("symbols", _symbols("t", "source_id"))
    named = found.filter(F.size("symbols") > 0).select("source_id", "ts", F.posexplode("symbols").alias("pos", "s"))
    extra = F.to_json(F.struct(F.col("s.kind").alias("kind"), F.array("s.name").alias("symbols"), F.col("s.first").alias("line_start"), F.col("s.last").alias("line_end")))
    named = named.select("source_id", "ts", "pos", F.col("s.text").alias("text"), extra.alias("extra"))
    windows = found.filter(F.size("symbols") == 0).select("source_id", "ts", F.posexplode(line_windows(F.col("t"))).alias("pos", "w"))
    windows = windows.select("source_id", "ts", "pos", F.col("w.text").alias("text"), F.to_json(F.struct((F.col("w.first") + 1).alias("line_start"))).alias("extra"))
    return as_chunks(named.unionByName(windows), "code", ["pos"], config=config)


def front_matter(text: Column) -> tuple[Column, Column]:
    """The block between ``---`` lines at the top, and the body after it."""
    block = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"
    return F.when(text.rlike(block), F.regexp_extract(text, block, 1)), F.regexp_replace(text, block, "")


def matter_value(block: Column, key: str) -> Column:
    """A scalar of the block, quotes removed; null where absent."""
    found = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*[\"']?([^\"'\r\n]*?)[\"']?[ \t]*$", 1)
    return F.when(found != "", found)


def threads(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Thread files: front matter to ``extra``, the body as one chunk; a block
    that cannot be read leaves the body with tension ``active``."""
    rows = files(spark, root, "*.md").select("source_id", F.col("modificationTime").alias("ts"), as_text(F.col("content")).alias("t"))
    block, body = front_matter(F.col("t"))
    tension = F.coalesce(matter_value(block, "tension"), F.lit("active"))
    handle = F.coalesce(matter_value(block, "handle"), F.regexp_replace(F.regexp_extract("source_id", r"([^/]+)$", 1), r"\.md$", ""))
    evidence = F.size(F.regexp_extract_all(F.regexp_extract(block, r"(?ms)^evidence:[ \t]*\r?\n((?:[ \t]+-.*\n?)*)", 1), F.lit(r"(?m)^[ \t]+-"), 0))
    extra = F.to_json(F.struct(handle.alias("handle"), tension.alias("tension"), matter_value(block, "familiarity").cast("long").alias("familiarity"), F.coalesce(evidence, F.lit(0)).alias("evidence_count"), matter_value(block, "last_touched").alias("last_touched")))
    return as_chunks(rows.select("source_id", "ts", F.trim(body).alias("text"), extra.alias("extra")), "thread", ["source_id"], config=config)


def link_edges(texts: DataFrame) -> DataFrame:
    """(a, relation, b) between files: Markdown links to other ``.md`` files.

    ``texts``: (source_id, text); targets are resolved against the file.
    """
    from strandloom.functions.text import link_targets, resolved_path

    found = texts.select("source_id", F.explode(link_targets(F.col("text"))).alias("t"))
    found = found.filter(~F.col("t").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & F.regexp_replace("t", "[#?].*$", "").rlike(r"(?i)\.md$"))
    edges = found.select(F.col("source_id").alias("a"), F.lit("references").alias("relation"), resolved_path(F.col("source_id"), F.col("t")).alias("b"))
    return edges.filter("a <> b").distinct()


def typed_edges(texts: DataFrame, fields: list[str]) -> DataFrame:
    """(a, relation, b) from front matter: each named key's value or list of values."""
    block, _ = front_matter(F.col("text"))
    rows, out = texts.select("source_id", block.alias("block")).filter("block is not null"), None
    for field in fields:
        listed = F.regexp_extract_all(F.regexp_extract("block", rf"(?m)^{field}:[ \t]*\r?\n((?:[ \t]+-.*(?:\n|$))*)", 1), F.lit(r"(?m)^[ \t]+-[ \t]*[\"']?([^\"'\r\n]+?)[\"']?[ \t]*$"), 1)
        inline = F.transform(F.split(F.regexp_replace(matter_value(F.col("block"), field), r"^\[|\]$", ""), r"\s*,\s*"), lambda x: F.trim(x))
        values = F.filter(F.concat(listed, F.coalesce(inline, F.array().cast("array<string>"))), lambda x: x != "")
        one = rows.select(F.col("source_id").alias("a"), F.lit(field).alias("relation"), F.explode(values).alias("b"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()
