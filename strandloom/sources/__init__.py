"""Scanners: one function a kind, ``(spark, ...) -> DataFrame`` of chunks.

Every scanner gives the columns of ``CHUNKS`` by way of ``as_chunks``: the
address, the content hash and the order of the chunks within a source id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.text import chunk_id

CHUNKS = ["chunk_id", "source", "project", "source_id", "source_config_id", "chunk_index", "ts", "role", "text", "sha256", "parent_ids", "extra"]
# Directories that are never walked.
SKIPPED = (".git", "target", "node_modules", "dist", "build", ".venv", "__pycache__")


def files(spark: SparkSession, root: str, glob: str | None = None, ignore: tuple[str, ...] = SKIPPED, paths: list[str] | None = None) -> DataFrame:
    """(path, source_id, modificationTime, length, content) below a root.

    ``source_id`` is the slash path relative to the root.  Hidden files and the
    ignored directories are left out; ``paths`` narrows to changed files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    clean = root.rstrip("/")
    found = reader.load(clean).withColumn("source_id", F.regexp_replace(F.col("path"), r"^file:/*(?=/)", ""))
    found = found.withColumn("source_id", F.expr("substr(source_id, instr(source_id, '" + clean.replace("file://", "").replace("'", "''") + "') + " + str(len(clean.replace("file://", "")) + 1) + ")"))
    found = found.filter(~F.col("source_id").rlike(r"(^|/)(\.|(" + "|".join(x.replace(".", r"\.") for x in ignore) + ")/)"))
    return found.filter(F.col("source_id").isin(paths)) if paths is not None else found


def as_text(content: Column) -> Column:
    """Bytes as text without a byte-order mark."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def as_chunks(rows: DataFrame, source: str, order: list[str], project: Column | None = None, config: str = "", chained: bool = False) -> DataFrame:
    """Blank texts dropped, chunks numbered within their source id, addressed and hashed.

    ``chained`` links each chunk to the one before it.
    """
    have = set(rows.columns)
    if "chunk_index" not in have:
        nth = F.row_number().over(Window.partitionBy("source_id").orderBy(*order)) - 1
        rows = rows.filter(F.col("text").rlike(r"\S")).withColumn("chunk_index", nth)
    rows = rows.withColumn("source", F.lit(source)).withColumn("source_config_id", F.lit(config))
    rows = rows.withColumn("project", project if project is not None else F.col("project") if "project" in have else F.lit(None).cast("string"))
    rows = rows.withColumn("chunk_id", chunk_id(F.col("source"), F.col("source_id"), F.col("chunk_index"), F.col("source_config_id")))
    for name, kind in (("ts", "timestamp"), ("role", "string"), ("extra", "string")):
        rows = rows if name in have else rows.withColumn(name, F.lit(None).cast(kind))
    before = F.lag("chunk_id").over(Window.partitionBy("source_id").orderBy("chunk_index"))
    parents = F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>")) if chained else F.array().cast("array<string>")
    return rows.withColumn("parent_ids", parents).withColumn("sha256", F.sha2("text", 256)).select(*CHUNKS)
