"""Table schemas and the constants that are part of the semantics."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(k, v[0] if isinstance(v, tuple) else v, not isinstance(v, tuple)) for k, v in fields.items()])


CHUNK = _struct(
    chunk_id=(_S,), source=(_S,), project=_S, source_id=(_S,), source_config_id=_S, facets=T.ArrayType(_S), embedding_input_sha256=_S, chunk_index=(_I,),
    ts=_TS, role=_S, text=(_S,), sha256=(_S,), links=T.StructType([T.StructField("file_path", _S), T.StructField("parent_ids", T.ArrayType(_S))]), extra_json=_S, stale=(_B,),
)
AUDIT = _struct(row_key=(_S,), project=_S, ts=_S, event=_S, tool=_S, agent=_S, success=_B, exit_code=_L, duration_ms=_L, raw=_S)
CONCEPT_EDGE = _struct(a=(_S,), relation=(_S,), b=(_S,), confidence=_D, touch_count=_L, source=_S, last_touched=_TS)

# Constants of ranking and scoring.
K_RRF, LIMIT, PREFETCH, PER_SOURCE, CODE_PREFETCH = 60, 10, 6, 3, 12
IDENTIFIER_BOOST, K_BM25 = 3.0, 10.0
SELF_PENALTY, SELF_WINDOW_H = 2.0, 24.0
SNIPPET_CHARS = 400
FRESHNESS_DECAY, FRESHNESS_DAYS = 0.5, 30
ACCESS_WEIGHTS = {"creation": 1.0, "explicit_recall": 1.0, "operator_selected": 1.0, "recall_fault": 0.7, "lens_included": 0.5}
ACTIVATION_WEIGHTS = {"access": 0.5, "focus": 0.3, "edge": 0.2, "note": 0.2}
TAU_FOCUS_H, TAU_NOTE_H, TAU_EDGE_H = 24.0, 72.0, 72.0
HOPS, FRONTIER, HOP_DECAY, MIN_ACTIVATION, SEED_FLOOR, LATENT_K = 2, 16, 0.5, 0.05, 0.05, 8
LATENT_FLOOR, PROMOTE_K = 0.35, 4
LENS_BUDGET, LENS_MIN, LENS_K, DOMINANCE, REFRACTORY_TAU_S, REFRACTORY_WEIGHT, DRIFT = 4000, 200, 32, 0.30, 3600.0, 0.5, 0.15
CLUSTER_COSINE, CLUSTER_SIZE, CLUSTER_NEIGHBOURS = 0.82, 3, 2
NOVELTY_BASE_DAYS, NOVELTY_SINCE_H, NOVELTY_MEAN, BASELINE_ROWS = 7, 24, 0.3, 10
ACTIVITY_SINCE_H, ACTIVITY_SAMPLES, ACTIVITY_DECAY_H = 24, 3, 6.0
WEAVE = {"prose": 0.82, "code": 0.78, "transcript": 0.85, "default": 0.80}
BRIDGE, PROMOTE_SIZE, PROMOTE_COHESION, MERGE_COSINE = 0.85, 5, 0.9, 0.95
FADE_SLACK_DAYS, FADE_DORMANT_DAYS, PRUNE_DAYS = 14, 60, 14
SCORE_ALPHA, SCORE_BETA, ARCHIVE = 1.0, 0.5, 0.1
DECAY_HIGH, DECAY_LOW, FLOOR_LOW, FLOOR_HIGH, SATURATION, GATE = 0.05, 0.005, 0.1, 1.0, 20, 0.25
OFF_TENSION, OFF_COUNT, OFF_FLOOR = 0.2, 5, 0.30
CURATOR = {"active": 1.0, "slack": 0.3, "dormant": 0.1}
HYSTERESIS, EMA_LAMBDA, FOCUS_HISTORY = 0.05, 0.3, 9
CHUNK_TOKENS, CHUNK_BYTES, OVERLAP_BYTES = 2000, 8000, 800
