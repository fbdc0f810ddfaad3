"""Chat logs: session lines, rollouts, paired messages, zip exports, project journals."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.text import truncated
from strandloom.sources import as_chunks, as_text, files

_BLOCK = "array<struct<type:string,text:string,name:string,input:string,content:string>>"


def _lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(source_id, mtime, line_no, line) of text files."""
    found = files(spark, root, glob)
    rows = found.select("source_id", F.col("modificationTime").alias("mtime"), F.posexplode(F.split(as_text(F.col("content")), r"\r?\n")).alias("line_no", "line"))
    return rows.filter(F.col("line").rlike(r"\S"))


def session_blocks(spark: SparkSession, root: str, source: str = "assistant_session", keep_tools: bool = False, config: str = "") -> DataFrame:
    """Session files of JSON lines: one chunk a block of user and assistant
    lines, linked to the one before; a missing time takes the file's first."""
    raw = _lines(spark, root, "*.jsonl")
    get = lambda p: F.get_json_object("line", p)
    kind = F.coalesce(get("$.type"), get("$.role"))
    content = F.coalesce(get("$.message.content"), get("$.content"))
    rows = raw.filter(kind.isin("user", "assistant")).select("source_id", "mtime", "line_no", F.coalesce(get("$.message.role"), get("$.role"), kind).alias("role"), F.to_timestamp(get("$.timestamp")).alias("ts"), content.alias("c"))
    blocks = F.when(F.col("c").startswith("["), F.from_json("c", _BLOCK)).otherwise(F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("c").alias("text")))), _BLOCK))
    rows = rows.select("source_id", "mtime", "line_no", "role", "ts", F.posexplode(blocks).alias("item", "b"))
    body = F.when(F.col("b.type") == "text", F.col("b.text"))
    if keep_tools:
        body = F.coalesce(body, F.when(F.col("b.type").isin("tool_use", "tool_result"), truncated(F.coalesce("b.input", "b.content", "b.name"))))
    first = F.first("ts", ignorenulls=True).over(Window.partitionBy("source_id").orderBy("line_no", "item").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("text", body).filter("text is not null").withColumn("ts", F.coalesce("ts", first, "mtime"))
    project = F.regexp_extract("source_id", r"([^/-]+)/[^/]+$", 1)
    return as_chunks(rows.withColumn("extra", F.to_json(F.struct(F.col("b.type").alias("block_kind")))), source, ["line_no", "item"], project=F.when(project != "", project), config=config, chained=True)


def rollouts(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Rollout files: consecutive user messages and the replies to them are one
    exchange; exchanges without a reply are left out."""
    raw = _lines(spark, root, "rollout-*.jsonl")
    get = lambda p: F.get_json_object("line", p)
    role, cwd = get("$.payload.role"), get("$.payload.cwd")
    parts = F.from_json(get("$.payload.content"), "array<struct<text:string>>")
    text = F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), get("$.payload.content"))
    rows = raw.select("source_id", "mtime", "line_no", role.alias("role"), cwd.alias("cwd"), F.to_timestamp(get("$.timestamp")).alias("ts"), text.alias("t"))
    dirs = rows.filter("cwd is not null").groupBy("source_id").agg(F.min_by("cwd", "line_no").alias("dir"))
    said = rows.filter("role in ('user', 'assistant')").filter(F.col("t").rlike(r"\S"))
    w = Window.partitionBy("source_id").orderBy("line_no")
    opens = ((F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("assistant")) == "assistant")).cast("int")
    said = said.withColumn("opens", opens).withColumn("turn", F.sum("opens").over(w))
    of = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("line_no", "t")))), lambda x: x["t"]), "\n\n")
    turns = said.groupBy("source_id", "turn").agg(of("user").alias("u"), of("assistant").alias("a"), F.min("ts").alias("ts")).filter("a <> ''")
    turns = turns.join(dirs, "source_id", "left")
    text = F.concat(F.lit("### User\n"), "u", F.lit("\n\n### Assistant\n"), "a")
    project = F.regexp_extract(F.coalesce("dir", F.lit("")), r"([^/]+)/?$", 1)
    return as_chunks(turns.withColumn("text", text), "rollout", ["turn"], project=F.when(project != "", project), config=config, chained=True)


def paired(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Session files of one JSON object: each reply with the latest user message before it."""
    kind = "struct<sessionId:string,messages:array<struct<type:string,content:string,timestamp:string>>>"
    found = files(spark, root, "session-*.json")
    rows = found.select("source_id", F.from_json(as_text(F.col("content")), kind).alias("s"))
    rows = rows.select("source_id", F.posexplode("s.messages").alias("pos", "m")).select("source_id", "pos", "m.*").filter(F.col("content").rlike(r"\S"))
    w = Window.partitionBy("source_id").orderBy("pos")
    rows = rows.filter("type in ('user', 'model', 'gemini')").withColumn("before", F.lag(F.struct("type", "content", "timestamp")).over(w))
    pairs = rows.filter("type <> 'user' and before.type = 'user'")
    text = F.concat(F.lit("### User\n"), F.col("before.content"), F.lit("\n\n### Assistant\n"), F.col("content"))
    return as_chunks(pairs.select("source_id", "pos", text.alias("text"), F.to_timestamp("before.timestamp").alias("ts")), "paired_session", ["pos"], config=config, chained=True)


def _unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, content in zip(batch["source_id"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in sorted(n for n in z.namelist() if n.rsplit("/", 1)[-1] == "conversations.json"):
                    for i, conv in enumerate(json.loads(z.read(member))):
                        for j, m in enumerate(conv.get("chat_messages") or []):
                            rows.append((name, str(conv.get("uuid")), i, j, str(m.get("uuid")), m.get("text"), m.get("sender"), m.get("created_at")))
        yield pd.DataFrame(rows, columns=["zip", "conv", "conv_pos", "msg_pos", "msg", "text", "sender", "created_at"])


def zip_exports(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Messages of exported conversations in zip files, a chunk each, linked
    within their conversation; indexes run on across a zip."""
    schema = "zip string, conv string, conv_pos int, msg_pos int, msg string, text string, sender string, created_at string"
    rows = files(spark, root, "*.zip").select("source_id", "content").mapInPandas(_unzipped, schema)
    sender = F.lower(F.trim("sender"))
    rows = rows.withColumn("role", F.when(sender == "human", "user").when(sender == "assistant", "assistant")).filter(F.col("role").isNotNull() & F.col("text").rlike(r"\S"))
    order = Window.partitionBy("zip").orderBy("conv_pos", "msg_pos")
    rows = rows.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("ts", F.to_timestamp("created_at")).withColumn("source_id", F.concat_ws(":", "zip", "conv", "msg"))
    made = as_chunks(rows, "zip_export", [], config=config)
    key = made.withColumn("_conv", F.regexp_replace("source_id", ":[^:]*$", ""))
    before = F.lag("chunk_id").over(Window.partitionBy("_conv").orderBy("chunk_index"))
    return key.withColumn("parent_ids", F.when(before.isNotNull(), F.array(before)).otherwise(F.col("parent_ids"))).drop("_conv")


def decisions(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Decision lines: key, value, status and reason as one text."""
    get = lambda p: F.get_json_object("line", p)
    key = F.coalesce(get("$.key"), get("$.decision"))
    rows = _lines(spark, root, "decisions.jsonl").withColumn("key", key).filter("key is not null")
    text = F.concat_ws("\n\n", "key", get("$.value"), get("$.status"), get("$.reason"))
    return as_chunks(rows.select(F.concat_ws("#", "source_id", "key").alias("source_id"), "line_no", F.to_timestamp(get("$.timestamp")).alias("ts"), text.alias("text")), "decision", ["line_no"], config=config)


def audit_rows(spark: SparkSession, root: str, glob: str = "{journal,audit}.jsonl", among: DataFrame | None = None) -> DataFrame:
    """Audit lines as rows; the key is the place of the line, so reading again gives it
    again.  ``among``: the files (source_id) to read."""
    get = lambda p: F.get_json_object("line", p)
    lines = _lines(spark, root, glob)
    lines = lines if among is None else lines.join(among, "source_id", "left_semi")
    rows = lines.filter(get("$.event").isNotNull() | get("$.ts").isNotNull())
    return rows.select(
        F.sha2(F.concat_ws(":", "source_id", F.col("line_no").cast("string"), "line"), 256).alias("row_key"), get("$.project").alias("project"), get("$.ts").alias("ts"), get("$.event").alias("event"), get("$.tool").alias("tool"), get("$.agent").alias("agent"),
        get("$.success").cast("boolean").alias("success"), get("$.exit_code").cast("long").alias("exit_code"), get("$.duration_ms").cast("long").alias("duration_ms"), F.col("line").alias("raw"),
    )


def significant(rows: DataFrame) -> DataFrame:
    """Decisions, handoffs, escalations, failures and long shell calls."""
    failed = ~F.coalesce("success", F.lit(True))
    slow = (F.col("tool") == "bash") & (F.coalesce("duration_ms", F.lit(0)) > 30_000)
    return rows.filter(F.coalesce(F.col("event").isin("decision", "handoff") | F.col("event").startswith("escalation."), F.lit(False)) | failed | F.coalesce(slow, F.lit(False)))


def turns(spark: SparkSession, root: str, config: str = "") -> DataFrame:
    """Conversation lines as ``from → to: message``."""
    get = lambda p: F.get_json_object("line", p)
    rows = _lines(spark, root, "*.jsonl").withColumn("msg", get("$.msg")).filter(F.col("msg").rlike(r"\S"))
    stem = F.regexp_replace(F.regexp_extract("source_id", r"([^/]+)$", 1), r"\.jsonl$", "")
    text = F.concat(get("$.from"), F.lit(" → "), F.coalesce(get("$.to"), F.lit("all")), F.lit(": "), F.col("msg"))
    return as_chunks(rows.select(F.concat_ws(":", stem, F.coalesce(get("$.turn"), F.col("line_no").cast("string"))).alias("source_id"), "line_no", F.to_timestamp(get("$.ts")).alias("ts"), text.alias("text")), "conversation", ["line_no"], config=config)
