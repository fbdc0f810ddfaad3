"""Filters, record rules, facets, lookups and idempotent writes on chunk rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text beginnings of tool traffic and command wrappers.
REMINDER, NOTICE, TEAMMATE = "<system-reminder>", "<task-notification>", "<teammate-message"
WRAPPERS = ("<local-command-stdout>", "<local-command-stderr>", "<command-name>", "<command-message>", "<local-command-caveat>")
MULTI_FACETS = ("project", "tags", "status")
HEADER_FACETS = ("project", "lang", "agent", "status", "record_kind")


def recall_filter(project: str | None = None, source: str | None = None, since=None, before=None) -> Column:
    """All given conditions together; times half-open: since <= ts < before."""
    parts = [F.lit(True)]
    parts += [F.col("project") == project] if project is not None else []
    parts += [F.col("source") == source] if source is not None else []
    parts += [F.col("ts") >= since] if since is not None else []
    parts += [F.col("ts") < before] if before is not None else []
    return reduce(and_, parts)


@dataclass(frozen=True)
class Rule:
    """One record rule: its conditions are joined by and; ``tag`` None drops."""

    tag: str | None = None
    prefix: str | None = None
    contains: str | None = None
    regex: str | None = None
    sources: tuple[str, ...] = ()
    roles: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not (self.prefix or self.contains or self.regex or self.sources or self.roles):
            raise ValueError("a rule needs a condition")
        if self.tag is not None and not self.tag.strip():
            raise ValueError("an empty tag")

    def matches(self, text: Column, source: Column, role: Column) -> Column:
        """Whether the left-trimmed text and its row meet all conditions."""
        body, parts = F.ltrim(text), []
        parts += [body.startswith(self.prefix)] if self.prefix else []
        parts += [body.contains(self.contains)] if self.contains else []
        parts += [body.rlike(self.regex)] if self.regex else []
        parts += [source.isin(*self.sources)] if self.sources else []
        parts += [role.isin(*self.roles)] if self.roles else []
        return F.coalesce(reduce(and_, parts), F.lit(False))


DEFAULT_RULES = (Rule(prefix=REMINDER), *[Rule(prefix=w) for w in WRAPPERS], Rule(tag="harness_orchestration", prefix=TEAMMATE))


def decide(rules: Sequence[Rule], text: Column, source: Column, role: Column) -> Column:
    """``drop`` if any dropping rule matches, else the first matching tag, else ``keep``."""
    drops = [r.matches(text, source, role) for r in rules if r.tag is None]
    out = F.when(reduce(or_, drops), "drop") if drops else F.when(F.lit(False), "drop")
    for r in rules:
        if r.tag is not None:
            out = out.when(r.matches(text, source, role), r.tag)
    return out.otherwise("keep")


def facet_map(facets: Column) -> Column:
    """``key:value`` strings to a map of sorted value lists; split at the first
    colon, empty keys or values skipped."""
    good = F.filter(facets, lambda f: f.rlike("^[^:]+:.+$"))
    pairs = F.transform(good, lambda f: F.struct(F.regexp_extract(f, "^([^:]+):", 1).alias("k"), F.regexp_extract(f, "^[^:]+:(.*)$", 1).alias("v")))
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))))


def facet_header(facets: Column) -> Column:
    """Allowed ``key:value`` facets, sorted and joined by bars."""
    ok = F.filter(facets, lambda f: F.regexp_extract(f, "^([^:]+):", 1).isin(*HEADER_FACETS))
    return F.array_join(F.array_sort(F.array_distinct(ok)), "|")


def overlay_facets(base: Column, over: Column) -> Column:
    """Keys with many values are united, single ones replaced by the overlay's first."""
    key = lambda f: F.regexp_extract(f, "^([^:]+):", 1)
    over_keys = F.array_distinct(F.transform(over, key))
    kept = F.filter(base, lambda f: key(f).isin(*MULTI_FACETS) | ~F.array_contains(over_keys, key(f)))
    many = F.filter(over, lambda f: key(f).isin(*MULTI_FACETS))
    single = F.filter(over_keys, lambda k: ~k.isin(*MULTI_FACETS))
    firsts = F.filter(F.transform(single, lambda k: F.element_at(F.filter(over, lambda f: key(f) == k), 1)), lambda f: f.rlike("^[^:]+:.+$"))
    return F.array_sort(F.array_distinct(F.concat(kept, many, firsts)))


def sql_gate(sql: str) -> str:
    """One SELECT or WITH statement; anything after the first semicolon is refused,
    a semicolon inside a literal too."""
    head = sql.lstrip()
    if not (head[:6].upper() == "SELECT" and head[6:7] in " \t\n" and head[6:7]) and not (head[:4].upper() == "WITH" and head[4:5] in " \t\n" and head[4:5]):
        raise ValueError("only SELECT or WITH")
    body, _, rest = sql.partition(";")
    if rest.strip():
        raise ValueError("one statement only")
    return body


def audit_sql(audit: DataFrame, sql: str, view: str = "audit_events") -> DataFrame:
    """A gated statement over the audit rows."""
    statement = sql_gate(sql)
    audit.createOrReplaceTempView(view)
    return audit.sparkSession.sql(statement)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def tier_two(new: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks to embed: no manifest row with their id and a non-empty equal input hash."""
    known = manifest.filter("embedding_input_sha256 <> ''").select("chunk_id", "embedding_input_sha256").distinct()
    return new.join(known, ["chunk_id", "embedding_input_sha256"], "left_anti")


def orphans(manifest: DataFrame, run_id: Column) -> DataFrame:
    """Rows that the current run has not stamped."""
    return manifest.filter(F.col("last_run_id").isNull() | (F.col("last_run_id") != run_id))


def drift(corpus: DataFrame, manifest: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: ids only here, only there, on both sides, and doubled on each."""
    a = corpus.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = manifest.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, key, "full")
    n = lambda c: F.count(F.when(c, 1))
    return both.agg(n(F.col("a").isNull()).alias("extra"), n(F.col("b").isNull()).alias("missing"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), n(F.col("a") > 1).alias("doubled_corpus"), n(F.col("b") > 1).alias("doubled_manifest"))


def facet_list(facets: Column) -> Column:
    """The map of ``facet_map`` back to sorted ``key:value`` strings."""
    each = F.transform(F.map_entries(facets), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v)))
    return F.array_sort(F.flatten(each))
