import datetime as dt

import pytest

import strandloom.operators.changes as changes_module
from strandloom.operators.changes import ChangeLog, capture_changes, changed_files, judge_looks
from strandloom.session import fresh_dir

LOOK = "source string, source_id string, source_config_id string, observed_at timestamp, mtime_micros long, size_bytes long, cfg_overlay_hash string, present boolean, extra int"
STAMP = "source string, source_id string, source_config_id string, mtime_micros long, size_bytes long, cfg_overlay_hash string, last_run_id string"
RUN = "run_id string, started_at timestamp, finished_at timestamp, status string"
T = [dt.datetime(2026, 1, d) for d in range(1, 20)]


def tables(spark, looks, stamps=(), runs=((("r1", T[0], T[1], "ok")), ("r2", T[2], None, "ok"), ("r3", T[3], T[4], "failed"))):
    return spark.createDataFrame(list(looks), LOOK), spark.createDataFrame(list(stamps), STAMP), spark.createDataFrame(list(runs), RUN)


def found(log):
    return sorted((r.source_id or "") for r in changed_files(log).collect())


def look(name, day=5, mtime=1, size=1, cfg="", present=True, source="s"):
    return (source, name, "c", T[day], mtime, size, cfg, present, 9)


def test_new_changed_gone_and_unsuccessful(spark):
    looks = [look("new"), look("new"), look("same"), look("moved", mtime=2), look("gone", 5), look("gone", 6, present=False), look("back", 5, present=False), look("back", 6), look("failed"), look("cfg", cfg="x"), look(None), look("unfinished")]
    stamps = [("s", n, "c", 1, 1, "", "r1") for n in ("same", "moved", "gone", "cfg")] + [("s", "same", "c", 1, 1, "", "r1"), ("s", "failed", "c", 1, 1, "", "r3"), ("s", "unfinished", "c", 1, 1, "", "r2"), ("s", "new", "c", 1, 1, "", None), ("s", "back", "c", 1, 1, "", "lost")]
    log = ChangeLog(spark, fresh_dir(spark, "t"))
    capture_changes(log, *tables(spark, looks, stamps), segment=0)
    assert found(log) == ["", "back", "cfg", "failed", "moved", "new", "unfinished"]


def test_null_payload_and_latest_started_run(spark):
    runs = [("late", T[9], T[10], "ok"), ("early", T[1], T[11], "ok")]
    stamps = [("s", "a", "c", 7, 1, "", "early"), ("s", "a", "c", 8, 1, "", "late"), ("s", "n", "c", 1, 1, None, "late")]
    log = ChangeLog(spark, fresh_dir(spark, "t"))
    capture_changes(log, *tables(spark, [look("a", mtime=8), look("n", cfg=None)], stamps, runs), segment=0)
    assert found(log) == []


def test_only_new_records_and_late_ones(spark):
    log = ChangeLog(spark, fresh_dir(spark, "t"), partitions=3)
    _, stamps, runs = tables(spark, [])
    assert capture_changes(log, tables(spark, [look("a", 5), look("b", 8)])[0], stamps, runs, 0) == 0
    assert capture_changes(log, tables(spark, [look("a", 5), look("b", 8)])[0], stamps, runs, 0) is None
    # A late look of a has a new offset but an older time: it is read, and judged to be no news.
    assert capture_changes(log, tables(spark, [look("a", 4, mtime=3), look("c", 4)])[0], stamps, runs, 1) == 1
    assert found(log) == ["a", "b", "c"]
    assert sorted(r.mtime_micros for r in log.sink(["source", "source_id"]).filter("source_id = 'a'").collect()) == [1]


def test_failed_run_replays_its_plan(spark):
    log = ChangeLog(spark, fresh_dir(spark, "t"), partitions=2)
    looks, stamps, runs = tables(spark, [look(f"f{i}") for i in range(20)])
    log.append(looks.drop("extra"), 0)

    def broken(batch):
        raise RuntimeError("lost")

    try:
        log.run(broken)
    except RuntimeError:
        pass
    log.append(tables(spark, [look("later")])[0].drop("extra"), 1)
    work = lambda b: judge_looks(b, stamps, runs, log.sink(["source", "source_id", "source_config_id"]))
    assert log.run(work) == 0 and len(found(log)) == 20
    # Written but not committed: the next run writes the same batch again, once.
    assert log.run(work) == 1
    assert found(log).count("later") == 1 and len(found(log)) == 21
    assert log.run(work) is None


def test_work_follows_the_change(spark):
    log = ChangeLog(spark, fresh_dir(spark, "t"), buckets=64)
    _, stamps, runs = tables(spark, [])
    many = spark.range(3000).selectExpr("'s' source", "concat('f', id) source_id", "'c' source_config_id", "timestamp'2026-01-06' observed_at", "1L mtime_micros", "1L size_bytes", "'' cfg_overlay_hash", "true present")
    assert capture_changes(log, many, stamps, runs, 0) == 0
    news = tables(spark, [look("f5", 8, mtime=2), look("new", 8)])[0]
    log.append(changes_module.looks_of(news), 1)
    batch = log.batch(log.plan())
    assert batch.count() == 2 and all("/log/1/" in f for f in batch.inputFiles() if "/log/" in f)
    assert log.state(batch).count() < 300  # two buckets of 64
    assert changes_module.judge_next(log, stamps, runs) == 1
    assert log.state().count() == 3001 and log.state().filter("mtime_micros = 2").count() == 1
    assert len(log._places()) == 64 and sorted(set(log._places().values())) == [0, 1]
    assert sum(n == 1 for n in log._places().values()) <= 2
    # A listing that is repeated later in the same words judges nothing anew.
    log.append(changes_module.looks_of(news), 2)
    assert changes_module.judge_next(log, stamps, runs) == 2 and log.sink(log.key).count() == 3002


def test_death_at_every_step(spark, monkeypatch):
    _, stamps, runs = tables(spark, [])
    listings = [tables(spark, [look("a"), look("b")])[0], tables(spark, [look("a", 7, mtime=9), look("c", 7)])[0]]
    for step in ("batch", "_fold", "_places"):
        log = ChangeLog(spark, fresh_dir(spark, "t"))
        capture_changes(log, listings[0], stamps, runs, 0)

        def dies(*_):
            raise ConnectionError

        with monkeypatch.context() as m:
            m.setattr(log, step, dies)
            with pytest.raises(ConnectionError):
                capture_changes(log, listings[1], stamps, runs, 1)
        assert changes_module.judge_next(log, stamps, runs) == 1 and changes_module.judge_next(log, stamps, runs) is None
        assert sorted((r.source_id, r.mtime_micros) for r in log.state().collect()) == [("a", 9), ("b", 1), ("c", 1)]


def test_no_machine_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        fresh_dir(Session(), "t")


def test_empty_tables(spark):
    log = ChangeLog(spark, fresh_dir(spark, "t"))
    capture_changes(log, *tables(spark, []), segment=0)
    assert found(log) == []
