"""Text functions as Columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case ASCII letters and digits; what the keyword lane indexes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def slugify(text: Column) -> Column:
    """Lower letters, digits and ``_``; runs of others are ``-``; 3 to 40 characters, not digits only, else null."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "-"), "^-+|-+$", "")
    return F.when((F.length(slug) >= 3) & (F.length(slug) <= 40) & ~slug.rlike("^[0-9]+$"), slug)


def normalize(text: Column) -> Column:
    """Lower-case words of letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def snippet(text: Column, size: int = 400) -> Column:
    """The first characters, without an ellipsis."""
    return F.substring(text, 1, size)


def collapsed(text: Column, size: int = 200) -> Column:
    """White space collapsed, cut with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > size, F.concat(F.substring(one, 1, size), F.lit("…"))).otherwise(one)


def excerpt(text: Column, size: int) -> Column:
    """The first ``size`` white-space tokens, with an ellipsis where cut."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.when(F.size(words) > size, F.concat(F.array_join(F.slice(words, 1, size), " "), F.lit("…"))).otherwise(F.array_join(words, " "))


def truncated(text: Column, size: int = 200) -> Column:
    """Tool blocks: the first characters and how many are left out."""
    more = F.concat(F.lit("…[truncated "), (F.length(text) - size).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), more)).otherwise(text)


def path_stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def title(slug: Column) -> Column:
    """Words of a slug with capitals."""
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def valid_handle(handle: Column) -> Column:
    """1 to 64 bytes of [a-z0-9-], no hyphen at the ends, at most 4 hyphens."""
    hyphens = F.length(handle) - F.length(F.regexp_replace(handle, "-", ""))
    return handle.rlike("^[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?$") & (hyphens <= 4)


def mentions(text: Column, handle: Column) -> Column:
    """A handle as a whole word of [a-z0-9-]."""
    return F.contains(F.concat(F.lit("\n"), F.regexp_replace(F.lower(text), "[^a-z0-9-]", "\n"), F.lit("\n")), F.concat(F.lit("\n"), handle, F.lit("\n")))


def link_targets(text: Column) -> Column:
    """Targets of Markdown links."""
    return F.regexp_extract_all(text, F.lit(r"\]\(([^)\s]+)\)"), 1)


def kebab_phrases(text: Column) -> Column:
    """Kebab phrases of two to four words; the character after one is used up."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^a-z0-9-])([a-z][a-z0-9]*(?:-[a-z0-9]+){1,3})(?:$|[^a-z0-9-])"), 1)


def u32_le(n: Column) -> Column:
    """Four bytes of an unsigned number, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def chunk_id(source: Column, source_id: Column, index: Column, config: Column) -> Column:
    """The content address of a chunk."""
    head = F.encode(F.concat(source, F.lit(":"), source_id, F.lit(":")), "UTF-8")
    return F.sha2(F.concat(head, u32_le(index), F.encode(F.coalesce(config, F.lit("")), "UTF-8")), 256)


def proposed_handle(ids: Column) -> Column:
    """The name of a proposed group: a hash of its sorted ids."""
    lines = F.concat(F.array_join(F.array_sort(ids), "\n"), F.lit("\n"))
    return F.concat(F.lit("proposed-"), F.substring(F.sha2(lines, 256), 1, 8))


def resolved_path(base: Column, target: Column) -> Column:
    """A relative link target seen from the file ``base``; ``..`` goes up, anchors fall away."""
    clean = F.regexp_replace(target, "[#?].*$", "")
    start = F.when(clean.startswith("/"), F.array().cast("array<string>")).otherwise(F.slice(F.split(base, "/"), 1, F.greatest(F.lit(0), F.size(F.split(base, "/")) - 1)))
    step = lambda acc, s: (
        F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(clean, "/"), start, step), "/")


# Phrases by which a listener recognises what was said, in this order.
RECOGNITION = (
    r"(?i)(?:^|[^\w])((?:yes\s*,?\s*exactly)|(?:that(?:'s|\s+is)\s+the\s+move)|(?:oh\s*[,\-—]?\s*(?:like|it'?s\s+like)\s+\w)"
    r"|(?:i\s+see\s+what\s+you\s+mean)|(?:exactly)|(?:got\s+it)|(?:right\s*,\s*\w))"
)
TRIGGER_CONFIDENCE = 0.75


def triggers(text: Column) -> Column:
    """Recognition phrases in lower case, those right after a negation left out."""
    kept = F.regexp_replace(text, r"(?i)(\bnot?,?\s*)(yes\s*,?\s*exactly|exactly|got\s+it|right\s*,\s*\w)", "$1")
    return F.transform(F.regexp_extract_all(kept, F.lit(RECOGNITION), 1), lambda t: F.lower(t))


def token_window(text: Column, at: Column, size: int) -> Column:
    """``size`` white-space tokens around the 0-based token ``at``; the text where it is short."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    low = F.greatest(F.lit(0), at - size // 2)
    high = F.least(F.size(words), at + size // 2 + 1)
    return F.when(F.size(words) <= size, text).otherwise(F.array_join(F.slice(words, low + 1, F.greatest(F.lit(0), high - low)), " "))


def strip_line_marker(line: Column) -> Column:
    """A line without list, quote and number marks at its start."""
    return F.regexp_replace(line, r"^[ \t]*(?:(?:[-*+>]|\d{1,9}[.)])[ \t]+)+", "")


def refine_token(token: Column) -> Column:
    """A word without a possessive and without punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"(?:'s|’s)$", "")


def stub_confidence(mentions: Column) -> Column:
    """Six mentions are certain."""
    return F.least(mentions, F.lit(6)) / 6.0


def project_of(path: Column) -> Column:
    """The folder that names the project of a session file: its parent, a slug of dashes by its last part."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return F.when(parent == "", None).otherwise(F.when(parent.startswith("-"), F.regexp_extract(parent, r"([^-]+)$", 1)).otherwise(parent))


def doc_handle(path: Column) -> Column:
    """A handle from a path: folders and stem joined, a long one cut with a hash behind it."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(path, r"\.[^./]*$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(slug) > 40, F.concat(F.substring(slug, 1, 31), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))).otherwise(slug)


def doc_title(text: Column) -> Column:
    """The first heading of the first level, null for none."""
    found = F.regexp_extract(text, r"(?m)^#[ \t]+(\S[^\n]*?)[ \t]*$", 1)
    return F.when(found != "", found)
