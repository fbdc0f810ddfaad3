"""Concept graph: edges, conductance, activation, two-hop diffusion, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom import schema as S
from strandloom.functions.vec import age_hours, squash


def upserted_edges(touches: DataFrame) -> DataFrame:
    """Edges from their touches: highest confidence, number of touches, first
    source kept, no self loops.  ``touches``: (a, relation, b, confidence, source, micros, seq)."""
    rows = touches.filter("a is not null and b is not null and a <> b")
    return rows.groupBy("a", "relation", "b").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("touch_count"), F.min_by("source", "seq").alias("source"), F.max("micros").alias("last_micros"))


def conductance(confidence: Column, age_h: Column) -> Column:
    """Confidence faded by the time since the last touch, in [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.greatest(confidence, F.lit(0.0)) * F.exp(-age_h / S.TAU_EDGE_H)))


def with_conductance(edges: DataFrame, now: Column) -> DataFrame:
    """Edges with ``w``; the age is at least a minute."""
    return edges.withColumn("w", F.round(conductance(F.col("confidence"), age_hours(now, F.col("last_micros"), 1 / 60)), 9))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as (at, to, w), parallel edges by their best."""
    both = edges.select(F.col("a").alias("at"), F.col("b").alias("to"), "w").unionByName(edges.select(F.col("b").alias("at"), F.col("a").alias("to"), "w"))
    return both.groupBy("at", "to").agg(F.max("w").alias("w"))


def diffuse(seeds: DataFrame, edges: DataFrame, hops: int = S.HOPS, frontier: int = S.FRONTIER) -> DataFrame:
    """Spreading activation from (seed, handle, activation).

    At each hop the strongest ``frontier`` handles of a seed pass on activation
    times conductance times the decay; what falls below the least is dropped
    and a handle keeps its highest activation.
    """
    reached = front = seeds.select("seed", "handle", "activation")
    for _ in range(hops):
        top = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("activation"), "handle"))
        sent = front.withColumn("nth", top).filter(F.col("nth") <= frontier).join(edges, F.col("handle") == F.col("at"))
        got = sent.select("seed", F.col("to").alias("handle"), F.round(F.col("activation") * F.col("w") * S.HOP_DECAY, 9).alias("activation"))
        front = got.filter(F.col("activation") >= S.MIN_ACTIVATION).groupBy("seed", "handle").agg(F.max("activation").alias("activation"))
        reached = reached.unionByName(front).groupBy("seed", "handle").agg(F.max("activation").alias("activation"))
    return reached


def base_level(ages_h: Column, weight: Column | None = None, decay: float = S.FRESHNESS_DECAY) -> Column:
    """An aggregate: ln(1 + sum of weight times age to the minus decay), ages of an hour at least."""
    power = F.pow(F.greatest(ages_h, F.lit(1.0)), F.lit(-decay))
    return F.log1p(F.sum(power if weight is None else power * weight))


def activation(confidence: Column, access: Column, focus: Column, edge: Column, note: Column) -> Column:
    """Confidence plus weighted access (squashed), focus, edges and notes."""
    w = S.ACTIVATION_WEIGHTS
    return confidence + w["access"] * squash(access) + w["focus"] * focus + w["edge"] * edge + w["note"] * note


def support_at(evidence: DataFrame, activation: DataFrame) -> DataFrame:
    """(source, source_id, value): the highest activation of a handle with evidence there."""
    return evidence.join(activation.select("handle", "activation"), "handle").groupBy("source", "source_id").agg(F.max("activation").alias("value"))


def edge_lift(edges: DataFrame, digits: int = 6) -> DataFrame:
    """1 - exp(-sum of confidences) over both directions."""
    ends = edges.select(F.col("a").alias("handle"), "confidence").unionByName(edges.select(F.col("b").alias("handle"), "confidence"))
    return ends.groupBy("handle").agg(F.round(1 - F.exp(-F.sum(F.greatest("confidence", F.lit(0.0)))), digits).alias("edge_lift"), F.count(F.lit(1)).alias("edges"))


def resolve(names: DataFrame, concepts: DataFrame, aliases: DataFrame, hops: int = 8) -> DataFrame:
    """(project, name) to a handle: own project before global, handle before
    alias, then ``merged_into`` followed; a cycle or a dead end gives no row."""
    forms = concepts.select("project", F.col("handle").alias("name"), "handle", F.lit(0).alias("tier")).unionByName(aliases.select("project", F.col("alias").alias("name"), "handle", F.lit(1).alias("tier")))
    own = names.join(forms, ["project", "name"]).withColumn("scope", F.lit(0))
    everywhere = names.join(forms.filter("project = ''").drop("project"), "name").withColumn("scope", F.lit(1))
    first = own.unionByName(everywhere.select(*own.columns)).groupBy("project", "name").agg(F.min(F.struct("tier", "scope", "handle"))["handle"].alias("handle"))
    merged = concepts.groupBy("handle").agg(F.max("merged_into").alias("merged_into"))
    for _ in range(hops):
        step = merged.select(F.col("handle").alias("at"), F.col("merged_into").alias("further"))
        first = first.join(step, F.col("handle") == F.col("at"), "left").select("project", "name", F.coalesce("further", "handle").alias("handle"))
    alive = merged.filter("merged_into is null").select("handle")
    return first.join(alive, "handle", "left_semi").select("project", "name", "handle")


def focus_ring(touches: DataFrame, key: str, item: str, order: list[str], size: int = S.FOCUS_HISTORY) -> DataFrame:
    """Move-to-front history: the last ``size`` different items of a key, newest first."""
    last = touches.groupBy(key, item).agg(F.max(F.struct(*order)).alias("_at"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at"), item))
    return last.withColumn("place", nth.cast("long")).filter(F.col("place") <= size).drop("_at")


def span_specificity(rows: DataFrame, term: str, project: str) -> DataFrame:
    """1 - (span - 1) / (N - 1): 1 for a term of one project, 0 for one of all."""
    spans = rows.groupBy(term).agg(F.countDistinct(project).alias("span"))
    whole = rows.agg(F.countDistinct(project).alias("projects"))  # one row
    top = F.greatest("projects", "span")
    return spans.crossJoin(whole).select(term, "span", F.when(top > 1, F.round(1 - (F.col("span") - 1) / (top - 1), 6)).otherwise(F.lit(1.0)).alias("specificity"))


#: Names that are broadcast and looked for in whole texts.
BROADCAST_NAMES = 2_000


def containing(texts: DataFrame, names: DataFrame, broadcast_names: int = BROADCAST_NAMES) -> DataFrame:
    """Rows of ``texts`` (body, ...) with those of ``names`` (name, ...) that their body holds anywhere.

    Beyond ``broadcast_names`` the pieces of a body that are as long as a name
    are matched by equality.
    """
    if names.count() <= broadcast_names:
        return texts.join(F.broadcast(names), F.contains("body", "name"))
    lengths = [n for n in names.agg(F.sort_array(F.collect_set(F.length("name")))).first()[0]]
    sized = texts.withColumn("n", F.explode(F.lit(lengths))).filter(F.col("n") <= F.length("body"))
    starts = F.sequence(F.lit(1), F.length("body") - F.col("n") + 1)
    pieces = F.array_distinct(F.transform(starts, lambda at: F.substr("body", at, F.col("n"))))
    return sized.withColumn("name", F.explode(pieces)).drop("n").join(names, "name")


def gazetteer(texts: DataFrame, forms: DataFrame, most_words: int | None = None) -> DataFrame:
    """(id, form): forms that stand in a normalised text as whole words.

    ``texts``: (id, norm); ``forms``: (form).  The word runs of a text up to
    the longest form (or ``most_words``) are matched by equality, so forms may
    be many.  A form inside a longer one that matches at the same place gives
    way to it.
    """
    words = texts.select("id", F.split("norm", " ").alias("w")).select("id", "w", F.posexplode("w").alias("at", "_")).drop("_")
    held = forms.agg(F.sort_array(F.collect_set(F.size(F.split("form", " "))))).first()[0]  # lengths that occur
    lengths = [n for n in held if n > 0 and (most_words is None or n <= most_words)]
    grams = words.select("id", "at", "w", F.explode(F.lit(lengths or [1])).alias("n")).filter(F.col("at") + F.col("n") <= F.size("w"))
    grams = grams.select("id", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("form"))
    hits = grams.join(forms.select("form").distinct(), "form")
    # Leftmost first, the longest at a place; what begins inside a taken one gives way.
    ordered = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "form"))).alias("hits"))
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("forms"))
    take = lambda acc, h: F.when(h["at"] >= acc["end"], F.struct((h["at"] - h["m"]).alias("end"), F.concat(acc["forms"], F.array(h["form"])).alias("forms"))).otherwise(acc)
    return ordered.select("id", F.explode(F.array_distinct(F.aggregate("hits", nothing, take)["forms"])).alias("form"))
