"""Streaming state: rolling attention per scope, counters, windows, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.functions import text as text_functions
from strandloom.operators.products import products
from strandloom.schema import DRIFT, EMA_LAMBDA, GATE

OUT = "scope string, turns long, resonant long, drift double, rolling array<double>"
STATE = "rolling array<double>, turns long, resonant long"


def blend(rolling: np.ndarray | None, vector: np.ndarray, weight: float = EMA_LAMBDA) -> np.ndarray:
    """The next rolling vector, of length 1; replaced where empty or ragged."""
    if rolling is None or len(rolling) != len(vector):
        out = vector
    else:
        out = (1 - weight) * rolling + weight * vector
    size = np.linalg.norm(out)
    return out / size if size > 0 else out


def _cosine(a: np.ndarray | None, b: np.ndarray) -> float:
    if a is None or len(a) != len(b):
        return 0.0
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size > 0 else 0.0


def fold(rows: pd.DataFrame, state: tuple | None) -> tuple[np.ndarray | None, int, int, float]:
    """Turns in order of time and sequence onto a state (rolling, turns, resonant)."""
    rolling, turns, resonant = (np.asarray(state[0], dtype=np.float64) if state and state[0] is not None else None, state[1], state[2]) if state else (None, 0, 0)
    before = rolling
    for vector in rows.sort_values(["ts", "seq"], kind="stable")["vector"]:
        if vector is None:
            continue
        vector = np.asarray(vector, dtype=np.float64)
        resonant += int(_cosine(rolling, vector) >= GATE)
        rolling = blend(rolling, vector)
        turns += 1
    drift = 1 - _cosine(before, rolling) if before is not None and rolling is not None else 0.0
    return rolling, turns, resonant, drift


def _observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches))
    rolling, turns, resonant, drift = fold(rows, state.get if state.exists else None)
    kept = None if rolling is None else rolling.tolist()
    state.update((kept, turns, resonant))
    yield pd.DataFrame({"scope": [key[0]], "turns": [turns], "resonant": [resonant], "drift": [round(drift, 9)], "rolling": [kept]})


def observe(turns: DataFrame) -> DataFrame:
    """A stream of turns (scope, ts, seq, vector) to each scope's state after the batch."""
    return turns.groupBy("scope").applyInPandasWithState(_observe, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def replay(turns: DataFrame) -> DataFrame:
    """The same state from a batch table: what the stream ends with."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rolling, n, resonant, drift = fold(rows, None)
        return pd.DataFrame({"scope": [rows["scope"].iloc[0]], "turns": [n], "resonant": [resonant], "drift": [drift], "rolling": [None if rolling is None else rolling.tolist()]})

    return turns.groupBy("scope").applyInPandas(one, OUT)


def scoped(events: DataFrame, default: str = "default") -> DataFrame:
    """Each event under its project's scope and under the one of all projects."""
    own = F.coalesce("chunk_project", "event_project", F.lit(default))
    return events.withColumn("scope", F.explode(F.array(own, F.lit("*"))))


def gated(events: DataFrame) -> DataFrame:
    """Only watched transcripts drive attention."""
    return events.filter((F.col("origin") == "watch") & F.col("kind").isin("assistant_session", "rollout", "paired_session"))


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and kind, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Event-time sessions of a user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Repeated events of a key within the watermark fall away."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def sink_batches(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Start a query whose batches are written by number, so that a replayed
    batch replaces itself; all available rows, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encoded(events: DataFrame) -> DataFrame:
    """(event_id, kind, payload) with the payload, a struct, as JSON."""
    return events.select("event_id", "kind", F.to_json("payload").alias("payload"))


def decoded(events: DataFrame, schema: str) -> DataFrame:
    """Payloads read back by a schema; one that does not parse is null."""
    return events.select("event_id", "kind", F.from_json("payload", schema).alias("payload"))


def append_events(events: DataFrame, path: str) -> None:
    """Encoded events at the end of a log, one folder a kind."""
    encoded(events).write.mode("append").partitionBy("kind").parquet(path)


def woven(chunks: DataFrame, anchors: DataFrame, threshold: float) -> DataFrame:
    """A stream of chunks (id, v) matched with the anchors (anchor, v) of the moment:
    called anew in each micro-batch, it takes the ledger as it is then."""
    return products(chunks, anchors.select(F.col("anchor").alias("query_id"), "v"), "similarity", least=threshold)


def due(states: DataFrame, shown: DataFrame, drift: float = DRIFT) -> DataFrame:
    """Scopes whose page must be made again: the pin has changed, or the rolling vector
    has moved by ``drift``, and the content's hash is another one.

    ``states``: (scope, pin, drift, hash); ``shown``: (scope, pin, hash) of the last page.
    """
    last = shown.select("scope", F.col("pin").alias("last_pin"), F.col("hash").alias("last_hash"), F.lit(True).alias("known"))
    rows = states.join(last, "scope", "left")
    moved = F.col("known").isNull() | ~F.col("pin").eqNullSafe(F.col("last_pin")) | (F.col("drift") >= drift)
    return rows.filter(moved & ~F.col("hash").eqNullSafe(F.col("last_hash"))).select("scope", "pin", "drift", "hash")


def stale_ingest(journals: DataFrame, newest: DataFrame, threshold_s: float) -> DataFrame:
    """(project, behind_s): journals (project, mtime micros) written later than the
    newest ingested row (project, micros) by more than the threshold; none ingested counts as behind."""
    rows = journals.join(newest, "project", "left")
    behind = (F.col("mtime") - F.coalesce("micros", F.lit(0))) / 1e6
    return rows.select("project", behind.alias("behind_s")).filter(F.col("behind_s") > threshold_s)


def membrane(turns: DataFrame, size: int = 60) -> DataFrame:
    """(session_id, turn, nth, trigger, confidence, text): a chunk for each recognition
    phrase of a turn (session_id, turn, text), the tokens around it."""
    found = turns.select("session_id", "turn", "text", F.posexplode(text_functions.triggers(F.col("text"))).alias("nth", "trigger"))
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    first = F.split(F.col("trigger"), r"\s+")[0]
    at = F.greatest(F.lit(0), F.array_position(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^\W+|\W+$", ""))), F.regexp_replace(first, r"\W+$", "")).cast("int") - 1)
    return found.select("session_id", "turn", "nth", "trigger", F.lit(text_functions.TRIGGER_CONFIDENCE).alias("confidence"), text_functions.token_window(F.col("text"), at, size).alias("text"))
