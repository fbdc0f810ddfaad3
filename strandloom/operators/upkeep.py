"""Corpus tables and their upkeep: sinks, marks, deletes, repair, recovery.

``KeyedTable`` is a folder of Parquet parts in buckets by the key's hash; a write
makes new parts of the buckets it touches and then one small list of what is
current, so readers see the old or the new state and never a half.

Defined results: rows with a null key are refused by an upsert and fall away in
sets of ids; a repeated write gives the same table; an empty write is a version
like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text beginnings of command wrappers, kinds of tool blocks, noisy folders, signal files.
WRAPPERS = ("<local-command-", "<command-name>", "</command-name>", "<command-message>", "<command-args>")
TOOL_BLOCKS = ("tool_use", "tool_result")
NOISE = (".git", "target", "node_modules", ".pnpm", ".worktrees", ".next", ".turbo", "dist", "build")
SIGNALS = ("journal.jsonl", "audit.jsonl", "decisions.jsonl", "issues.jsonl")
# What happens to pieces of files that are gone, by source.
RETENTION = {"code": "delete", "markdown": "stale", "file_glob": "stale"}


class KeyedTable:
    """A table of one row a key with upsert, append, delete and compaction."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "chunk_id", buckets: int = 64, widths: dict[str, int] | None = None):
        self.spark, self.path, self.schema, self.key, self.buckets, self.widths = spark, path.rstrip("/"), schema, key, buckets, widths or {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The number of the last complete write, -1 for none."""
        fs, p = self._fs(f"{self.path}/versions")
        if not fs.exists(p):
            return -1
        done = lambda n: fs.exists(self._fs(f"{self.path}/versions/{n}/_SUCCESS")[1])
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit() and done(s.getPath().getName())), default=-1)

    def _places(self) -> list[tuple[int, int]]:
        n = self.version()
        return [] if n < 0 else [(r["bucket"], r["part"]) for r in self.spark.read.parquet(f"{self.path}/versions/{n}").collect()]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The current rows, of some buckets only if given."""
        paths = [f"{self.path}/parts/{n}/bucket={b}" for b, n in sorted(self._places()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Columns of the schema; vectors of another width and null keys are an error."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        bad = F.col(self.key).isNull()
        for name, width in self.widths.items():
            bad = bad | (F.col(name).isNotNull() & (F.size(name) != width))
        if not rows.filter(bad).isEmpty():
            raise ValueError("a null key or a vector of the wrong width")
        return rows

    def _write(self, rows: DataFrame, touched: set[int], appended: bool = False) -> int:
        n, kept = self.version() + 1, [(b, p) for b, p in self._places() if appended or b not in touched]
        rows.withColumn("bucket", self._bucket()).repartition("bucket").sortWithinPartitions(self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/parts/{n}")
        there = {r["bucket"] for r in self.spark.read.parquet(f"{self.path}/parts/{n}").select("bucket").distinct().collect()} if touched else set()
        self.spark.createDataFrame(kept + [(b, n) for b in sorted(there)], "bucket int, part int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{n}")
        return n

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def upsert(self, rows: DataFrame) -> int:
        """New rows take the place of old ones with their key; of several new ones any stays."""
        rows = self._checked(rows).dropDuplicates([self.key])
        touched = self._touched(rows)
        old = self.read(touched).join(rows.select(self.key), self.key, "left_anti")
        return self._write(old.select(*self.schema.names).unionByName(rows), touched)

    def append(self, rows: DataFrame) -> int:
        """Rows that the caller knows to be new; nothing is read."""
        rows = self._checked(rows)
        return self._write(rows, self._touched(rows), appended=True)

    def insert(self, rows: DataFrame) -> int:
        """Only rows whose key is not there yet: of several the first by their columns."""
        rows = self._checked(rows).dropDuplicates([self.key])
        return self.append(rows.join(self.read(self._touched(rows)).select(self.key), self.key, "left_anti"))

    def delete(self, condition: Column | None = None, ids: DataFrame | None = None) -> int:
        """How many rows went: those that meet ``condition``, or of ``ids``."""
        if ids is not None:
            ids = ids.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
            touched = self._touched(ids)
            old = self.read(touched)
            kept = old.join(ids, self.key, "left_anti")
        else:
            touched = {b for b, _ in self._places()}
            old = self.read()
            kept = old.filter(~F.coalesce(condition, F.lit(False)))
        gone = old.count() - kept.count()
        if gone:
            self._write(kept.select(*self.schema.names), touched)
        return gone

    def optimize(self) -> int:
        """One part a bucket again; parts that no version needs are removed."""
        n = self._write(self.read(), {b for b, _ in self._places()})
        for kind in ("parts", "versions"):
            fs, p = self._fs(f"{self.path}/{kind}")
            for s in fs.listStatus(p):
                if s.getPath().getName().isdigit() and int(s.getPath().getName()) < n:
                    fs.delete(s.getPath(), True)
        return n


def wrapper(text: Column) -> Column:
    """Texts of command wrappers."""
    out = F.lit(False)
    for w in WRAPPERS:
        out = out | text.startswith(w)
    return F.coalesce(out, F.lit(False))


def apparatus(block_kind: Column, text: Column) -> Column:
    """Tool traffic and task notices, which are no content."""
    return F.coalesce(block_kind.isin(*TOOL_BLOCKS), F.lit(False)) | F.coalesce(text.startswith("<task-notification>"), F.lit(False))


def denied(facets: Column, denylist: Sequence[str]) -> Column:
    """Whether any ``key:value`` facet is denied."""
    return F.coalesce(F.arrays_overlap(facets, F.array(*[F.lit(x) for x in denylist])), F.lit(False)) if denylist else F.lit(False)


def mark_stale(rows: DataFrame, ids: DataFrame | None = None, condition: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """Rows with ``stale`` set for ``ids`` and where ``condition`` holds."""
    hit = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(False)
    if ids is not None:
        rows = rows.join(ids.select(F.col(key), F.lit(True).alias("_hit")).distinct(), key, "left")
        hit = hit | F.coalesce(F.col("_hit"), F.lit(False))
    return rows.withColumn("stale", F.col("stale") | hit).drop("_hit")


def noisy_path(path: Column, own: str = ".state", mirror: str = "mirror") -> Column:
    """Paths a watcher passes over: noisy folders, and the tool's ``own`` one but for
    its signal files; a ``mirror`` below it is always noise."""
    folders = F.split(path, "/")
    other = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in NOISE]))
    inside = F.array_contains(folders, own)
    mirrored = F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{own}/{mirror}/")
    return mirrored | other | (inside & ~F.element_at(folders, -1).isin(*SIGNALS))


def under(path: Column, root: str, extensions: Sequence[str] = ()) -> Column:
    """Whether a path lies below a root, with one of the extensions if any are given."""
    clean = root.rstrip("/") + "/"
    fine = path.startswith(clean)
    return fine & F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions) if extensions else fine


def hit_rows(rows: DataFrame) -> DataFrame:
    """Candidates as hits: snippet, known roles only, never stale; ``extra`` parsed."""
    role = F.when(F.col("role").isin("primary", "evolution", "usage"), F.col("role"))
    return rows.select("id", "source", F.substring("text", 1, 400).alias("snippet"), role.alias("role"), F.lit(False).alias("stale"), F.from_json("extra", "map<string,string>").alias("extra"))


def recovered(backup: DataFrame, live: DataFrame, width: int, key: str = "chunk_id", vector: str = "v") -> DataFrame:
    """Backup rows that are not live and have a vector of the width, one of each key."""
    fine = backup.filter(F.col(vector).isNotNull() & (F.size(vector) == width))
    return fine.join(live.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def repair(corpus: DataFrame, manifest: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, action): what brings a manifest in line: ``insert`` ids it lacks,
    ``unrepairable`` where the corpus row has no config id, ``delete`` ids it has too
    many, ``collapse`` doubled ones."""
    c = corpus.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("source_config_id").alias("config"), F.count(F.lit(1)).alias("n"))
    m = manifest.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    both = c.join(m, key, "full")
    action = F.when(F.col("n").isNull(), "delete").when(F.col("k").isNull() & F.col("config").isNull(), "unrepairable").when(F.col("k").isNull(), "insert").when(F.col("k") > 1, "collapse")
    return both.withColumn("action", action).filter("action is not null").select(key, "action")


def touched_run(manifest: DataFrame, unchanged: DataFrame, run_id: str, key: Sequence[str]) -> DataFrame:
    """The manifest with the current run stamped on rows of unchanged files."""
    hit = unchanged.select(*key, F.lit(True).alias("_hit")).distinct()
    return manifest.join(hit, list(key), "left").withColumn("last_run_id", F.when(F.col("_hit"), F.lit(run_id)).otherwise(F.col("last_run_id"))).drop("_hit")


def swept(manifest: DataFrame, run_id: Column, retention: dict[str, str] = RETENTION) -> DataFrame:
    """(chunk_id, action): rows the run has not stamped: deleted, marked stale or kept by source."""
    action = F.create_map(*[F.lit(x) for p in retention.items() for x in p])[F.col("source")]
    old = manifest.filter(F.col("last_run_id").isNull() | (F.col("last_run_id") != run_id))
    return old.select("chunk_id", F.coalesce(action, F.lit("keep")).alias("action"))


def purged(corpus: DataFrame, manifest: DataFrame, decision: Column, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Corpus and manifest without the rows that the record rules drop."""
    gone = corpus.filter(decision == "drop").select(key).distinct()
    return corpus.join(gone, key, "left_anti"), manifest.join(gone, key, "left_anti")


def overlay_hash(rules: Column, parse_version: Column) -> Column:
    """The digest of rules and parser that makes an unchanged file new."""
    return F.substring(F.sha2(F.concat_ws("\n", rules, parse_version.cast("string")), 256), 1, 32)


def embedding_input_hash(text: Column, model: str, version: int = 1) -> Column:
    """The digest of what is embedded: version, model and text."""
    return F.sha2(F.concat_ws("|", F.lit(str(version)), F.lit(model), text), 256)
