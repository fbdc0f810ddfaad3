"""Incremental processing: change log, write-ahead batch plans, deduplicating sink.

Looks at files are appended to a log whose records carry a segment, a partition
and an offset given once, at the append, so that a late look gets a late offset
and is never passed over.  A run first writes its plan (segment, partition,
from, to), then processes exactly the planned records into a folder named by
the batch, then folds them into the state of their keys, then writes the commit.
A run that dies leaves a plan without a commit; the next run replays that very
plan into the same folders.  Readers of the sink deduplicate by key and offset.

Work follows the change, not the history: a plan reads the segments that no plan
has, a batch reads the segments of its plan, and of the state (the latest
judgement of each key, in buckets by the key's hash) only the buckets that the
batch's keys fall into are read and written anew.  Stamps are an input table of
their own: they are scanned, but only those of the batch's keys go further.

Defined results for odd input:

* null in a key column: null is a key value like any other (grouped null-safe);
* null payload columns compare null-safe with the stamp;
* equal looks and equal stamps count once; looks of one file with the same time
  are ordered by their remaining columns, the larger counting as the later;
* empty tables: an empty log plans an empty batch and gives an empty result;
* extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("source", "source_id", "source_config_id")
PAYLOAD = ("mtime_micros", "size_bytes", "cfg_overlay_hash")
#: A log partition is meant to hold about so many records of one segment.
RECORDS_PER_PARTITION = 1_000_000
#: What orders the judgements of a key.
ORDER = ("observed_at", "part", "offset")
#: Keys of a batch up to which they are broadcast to pick their stamps.
BROADCAST_KEYS = 500_000


class ChangeLog:
    """A partitioned, append-only log with planned, replayable batches.

    ``state_dir`` must lie in a folder that all executors share.  ``partitions``
    follow the size of a segment if not given; ``buckets`` of the state stay as they
    are in the first run and are meant to hold a million keys or so each.
    """

    def __init__(self, spark: SparkSession, state_dir: str, partitions: int | None = None, buckets: int = 64, key: Sequence[str] = KEY):
        self.spark, self.dir, self.partitions, self.buckets, self.key = spark, state_dir.rstrip("/"), partitions, buckets, tuple(key)

    # -- files ---------------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _numbers(self, kind: str) -> list[int]:
        fs, p = self._fs(f"{self.dir}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and self._done(f"{self.dir}/{kind}/{n}"))

    def _read(self, kind: str, numbers: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.dir}/{kind}/{n}" for n in numbers])

    # -- the log -------------------------------------------------------------
    def append(self, records: DataFrame, segment: int) -> None:
        """Append ``records`` as one numbered segment; a segment that is there stays.

        Offsets run on from the highest of each partition.  The partition comes
        from the hash of the whole record, so that a key with a third of all
        records is spread; equal records are one record.
        """
        path = f"{self.dir}/log/{segment}"
        if self._done(path):
            return
        cols = records.columns
        rows = records.distinct()
        parts = self.partitions or max(1, -(-rows.count() // RECORDS_PER_PARTITION))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int"))
        order = [F.xxhash64(*cols), *[F.col(c) for c in cols]]
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long"))
        earlier = [n for n in self._numbers("log") if n != segment]
        if earlier:
            rows = rows.join(F.broadcast(self._heads(earlier)), "part", "left").withColumn("offset", F.col("nth") + F.coalesce("top", F.lit(0))).drop("top")
        else:
            rows = rows.withColumn("offset", F.col("nth"))
        rows.drop("nth").write.mode("overwrite").parquet(path)

    def _heads(self, segments: Sequence[int]) -> DataFrame:
        """(part, top): the highest offset of each partition, a few rows a segment
        that are taken from it once."""
        for n in segments:
            if not self._done(f"{self.dir}/heads/{n}"):
                self._read("log", [n]).groupBy("part").agg(F.max("offset").alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{self.dir}/heads/{n}")
        return self._read("heads", segments).groupBy("part").agg(F.max("top").alias("top"))

    # -- batches -------------------------------------------------------------
    def plan(self) -> int | None:
        """The batch to run: an unfinished one again, else a newly planned one.

        None where every record is in a committed batch already.
        """
        planned, committed = self._numbers("plans"), set(self._numbers("commits"))
        for n in planned:
            if n not in committed:
                return n
        known = {r["segment"] for r in self._read("plans", planned).select("segment").distinct().collect()} if planned else set()
        fresh = [n for n in self._numbers("log") if n not in known]
        if not fresh:
            return None
        rows = None
        for segment in fresh:
            one = self._read("log", [segment]).groupBy("part").agg((F.min("offset") - 1).alias("from_offset"), F.max("offset").alias("to_offset"))
            # An empty segment is planned as well, so that it is not looked at again.
            one = one.unionByName(self.spark.createDataFrame([(-1, 0, 0)], "part int, from_offset long, to_offset long")).withColumn("segment", F.lit(segment))
            rows = one if rows is None else rows.unionByName(one)
        n = planned[-1] + 1 if planned else 0
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.dir}/plans/{n}")
        return n

    def batch(self, n: int) -> DataFrame:
        """Exactly the records of plan ``n``; a plan has one row a segment and partition."""
        plan = self._read("plans", [n])
        out = None
        for segment in sorted(r["segment"] for r in plan.select("segment").distinct().collect()):
            mine = F.broadcast(plan.filter(F.col("segment") == segment).drop("segment"))
            part = self._read("log", [segment]).join(mine, "part").filter("offset > from_offset and offset <= to_offset").drop("from_offset", "to_offset")
            out = part if out is None else out.unionByName(part)
        return out

    def run(self, process: Callable[[DataFrame], DataFrame]) -> int | None:
        """Plan, process into the sink, fold into the state, commit.  Safe to call
        again after any failure."""
        n = self.plan()
        if n is None:
            return None
        process(self.batch(n)).write.mode("overwrite").parquet(f"{self.dir}/sink/{n}")
        self._fold(n)
        self._read("plans", [n]).coalesce(1).write.mode("overwrite").parquet(f"{self.dir}/commits/{n}")
        return n

    # -- the state of the keys -----------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _places(self, before: int | None = None) -> dict[int, int]:
        """For each bucket the batch that wrote it last (at most ``buckets`` rows)."""
        done = set(self._numbers("commits"))
        last = [n for n in self._numbers("places") if n in done and (before is None or n < before)]
        return {r["bucket"]: r["batch"] for r in self._read("places", last[-1:]).collect()} if last else {}

    def state(self, rows: DataFrame | None = None, before: int | None = None) -> DataFrame | None:
        """The latest judgement of each key; given ``rows``, only of the buckets their
        keys fall into."""
        places = self._places(before)
        if rows is not None:
            touched = {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}
            places = {b: n for b, n in places.items() if b in touched}
        paths = [f"{self.dir}/state/{n}/bucket={b}" for b, n in sorted(places.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _fold(self, n: int) -> None:
        news = self._read("sink", [n])
        places = self._places(n)
        touched = {r["b"] for r in news.select(self._bucket().alias("b")).distinct().collect()}
        old = self.state(news, n)
        both = news if old is None else old.select(*news.columns).unionByName(news)
        rest = [c for c in news.columns if c not in self.key]
        last = F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("last")
        rows = both.groupBy(*self.key).agg(last).select(*self.key, "last.*").withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.dir}/state/{n}")
        held = sorted((places | dict.fromkeys(touched, n)).items())
        self.spark.createDataFrame(held, "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.dir}/places/{n}")

    def sink(self, key: Sequence[str], committed_only: bool = True) -> DataFrame | None:
        """What the batches wrote, one row for each key and offset."""
        ready = [n for n in self._numbers("sink") if not committed_only or n in set(self._numbers("commits"))]
        return self._read("sink", ready).dropDuplicates([*key, "part", "offset"]) if ready else None


def successful_runs(runs: DataFrame) -> DataFrame:
    """Runs that count: status ``ok`` and a finish."""
    return runs.filter((F.col("status") == "ok") & F.col("finished_at").isNotNull()).select(F.col("run_id").alias("last_run_id"), "started_at").distinct()


def latest_stamps(stamps: DataFrame, runs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """For each file the stamp of its latest-started successful run.

    ``runs`` is the run log: one row a run, far smaller than the stamps; AQE
    broadcasts it where its measured size allows and shuffles otherwise.
    """
    at = stamps.select(*key, *PAYLOAD, "last_run_id").join(successful_runs(runs), "last_run_id")
    newest = F.max_by(F.struct(*PAYLOAD), F.struct("started_at", *PAYLOAD))
    return at.groupBy(*key).agg(newest.alias("stamp"))


def _differs(look: str, stamp: str) -> Column:
    same = F.lit(True)
    for c in PAYLOAD:
        same = same & F.col(f"{look}.{c}").eqNullSafe(F.col(f"{stamp}.{c}"))
    return ~same


def judge_looks(batch: DataFrame, stamps: DataFrame, runs: DataFrame, seen: DataFrame | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """The latest look of each file in ``batch`` and whether it must be processed.

    ``seen``: what is judged so far; a look that is not later than one already judged
    falls away.  Looks, stamps and earlier judgements are united and grouped
    once, null-safe in the keys.
    """
    look = F.struct("observed_at", *PAYLOAD, "present", "part", "offset")
    keys = batch.select(*key).distinct()
    keys = F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys
    asked = [stamps[c].eqNullSafe(keys[c]) for c in key]
    stamps = stamps.join(keys, asked, "left_semi")
    looks = batch.groupBy(*key).agg(F.max(look).alias("look"))
    look_type = looks.schema["look"].dataType
    known = latest_stamps(stamps, runs, key)
    stamp_type = known.schema["stamp"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    rows = looks.select(*key, "look", none(stamp_type).alias("stamp"), none("timestamp").alias("judged"))
    rows = rows.unionByName(known.select(*key, none(look_type).alias("look"), "stamp", none("timestamp").alias("judged")))
    if seen is not None:
        rows = rows.unionByName(seen.select(*key, none(look_type).alias("look"), none(stamp_type).alias("stamp"), F.col("observed_at").cast("timestamp").alias("judged")))
    one = rows.groupBy(*key).agg(F.max("look").alias("look"), F.max("stamp").alias("stamp"), F.max("judged").alias("judged"))
    one = one.filter(F.col("look").isNotNull() & (F.col("judged").isNull() | (F.col("look.observed_at") > F.col("judged"))))
    changed = F.col("look.present") & (F.col("stamp").isNull() | _differs("look", "stamp"))
    return one.select(*key, "look.*", F.coalesce(changed, F.lit(False)).alias("changed"))


def judge_next(log: ChangeLog, stamps: DataFrame, runs: DataFrame) -> int | None:
    """Judge what no committed batch has judged; the number of the batch, None for nothing new."""
    return log.run(lambda batch: judge_looks(batch, stamps, runs, log.state(batch), log.key))


def looks_of(listing: DataFrame) -> DataFrame:
    """The columns of a listing that the log keeps."""
    return listing.select(*KEY, "observed_at", *PAYLOAD, "present")


def capture_changes(log: ChangeLog, listing: DataFrame, stamps: DataFrame, runs: DataFrame, segment: int) -> int | None:
    """Append a listing to the log and judge what no earlier batch has judged."""
    log.append(looks_of(listing), segment)
    return judge_next(log, stamps, runs)


def changed_files(log: ChangeLog) -> DataFrame:
    """Files whose latest judged look asks for processing, from the state."""
    rows = log.state()
    rows = log.sink(log.key) if rows is None else rows  # nothing judged: empty
    return rows.filter("changed").select(*log.key)
