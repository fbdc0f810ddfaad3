"""Rebuilding conversations from message rows.

Rows arrive as fragments: a session file, or one export of a chat.  A message's
hash stands for it in every fragment, so a fragment is a path over hashes.  Two
fragments overlap where a suffix of the one equals a prefix of the other, that
is where the messages they share have one shift of place.  Shared messages of
one shift are a run, within which the two paths are one without ambiguity: a
place of the later fragment is the place, moved by the shift, of the earlier
one.  The runs are the edges of the overlap graph; followed to the end they give
each message a place on a path, and rows at one place of a path are one message.
Fragments whose shared messages disagree on the shift (an export that lacks a
message in the middle) are merged run by run.  Nothing but the overlap graph
merges rows of different fragments: without its edges every export's messages
count anew.  The merged messages are put in order of time, and a conversation
with a gap (an unanswered user message), an unknown speaker or no messages is
dropped.

Defined results for odd input:

* null conversation ids: such rows fall away; a null message id equals no other;
* of rows with one message id in a conversation the smallest row id counts;
* a row without time takes the time of the nearest earlier counted row that has
  one, by position; where there is none it stands before all timed rows;
* ties in time are ordered by position, then row id;
* rows whose text has no visible character fall away after ordering;
* empty tables give empty results; extra columns are ignored;
* very long conversations are cut into blocks along their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.blocks import BLOCK_ROWS, block_offsets, hot_groups, with_blocks
from strandloom.session import cut

# The spellings of the two speakers.
USER = ("user", "human")
ASSISTANT = ("assistant", "model", "ai")
CONV = ["conv_table", "conv_id"]
#: A character a reader can see: no space, control, format or filler character.
VISIBLE = r"[^\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]"


def trimmed(c: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def role_of(name: Column) -> Column:
    """``user``, ``assistant`` or ``unknown``."""
    at = trimmed(F.coalesce(name, F.lit("")))
    return F.when(at.isin(*USER), "user").when(at.isin(*ASSISTANT), "assistant").otherwise("unknown")


def session_rows(sessions: DataFrame) -> DataFrame:
    """Session lines as message rows; a session is one fragment."""
    blocks = F.filter("message.content", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    text = F.coalesce(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.lit(""))
    role = F.col("message.role")
    named = F.when(role.isNull() | (trimmed(role) == ""), F.col("line_type")).otherwise(role)
    return sessions.filter(F.col("line_type").isin("user", "assistant") & F.col("session_id").isNotNull()).select(
        F.lit("session_messages").alias("conv_table"), F.col("session_id").alias("conv_id"), F.col("session_id").alias("fragment"),
        "row_id", F.col("line_no").cast("long").alias("pos"), F.col("message_id").alias("mid"), role_of(named).alias("role"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"),
    )


def chat_rows(chats: DataFrame) -> DataFrame:
    """Exported chat messages as message rows; an export of a chat is a fragment."""
    told = trimmed(F.coalesce("sender", F.lit("")))
    return chats.filter(~told.isin("system", "tool") & F.col("conv_uuid").isNotNull()).select(
        F.lit("chat_messages").alias("conv_table"), F.col("conv_uuid").alias("conv_id"), F.coalesce("export_id", F.lit("")).alias("fragment"),
        "row_id", F.col("msg_pos").cast("long").alias("pos"), F.col("message_uuid").alias("mid"), role_of(F.col("sender")).alias("role"), F.col("created_at").cast("timestamp").alias("ts"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows without their texts, with the hash that stands for the message."""
    node = F.when(F.col("mid").isNotNull(), F.xxhash64("mid", F.lit(0))).otherwise(F.xxhash64("row_id", F.lit(1)))
    twin = F.when(F.col("mid").isNotNull(), F.xxhash64("mid", F.lit(2))).otherwise(F.xxhash64("row_id", F.lit(3)))
    return rows.select(*CONV, "fragment", "row_id", "pos", node.alias("node"), twin.alias("twin"), "role", "ts", F.col("text").rlike(VISIBLE).alias("visible"))


def _placed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their place in their fragment from 0, and the fragments' lengths.

    Positions may have holes; a place counts the fragment's own messages, and a
    message that a fragment repeats stands where it stands first.
    """
    key = [*CONV, "fragment"]
    at = nodes.groupBy(*key, "node", "twin").agg(F.min("pos").alias("pos"))
    at = with_blocks(at, key, "pos").withColumn("nth", F.row_number().over(Window.partitionBy(*key, "block").orderBy("pos", "node")))
    sizes = at.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("size"))
    at = at.join(block_offsets(sizes, key, {"before": "size"}), [*key, "block"])
    return at.select(*key, "node", "twin", (F.col("before") + F.col("nth") - 1).alias("place")), sizes.groupBy(*key).agg(F.sum("size").alias("len"))


def _links(placed: DataFrame) -> DataFrame:
    """(conv, fragment_a, place_a, fragment_b, place_b): each message's place in the
    next fragment by name that holds it, so that n fragments give n - 1 links."""
    next_one = Window.partitionBy(*CONV, "node", "twin").orderBy("fragment")
    links = placed.withColumn("fragment_b", F.lead("fragment").over(next_one)).withColumn("place_b", F.lead("place").over(next_one)).filter("fragment_b is not null")
    return links.select(*CONV, F.col("fragment").alias("fragment_a"), F.col("place").alias("place_a"), "fragment_b", "place_b")


def runs(placed: DataFrame) -> DataFrame:
    """(conv, fragment_a, fragment_b, place_b, shift): the places of ``fragment_b``
    that overlap ``fragment_a``, with the shift of their run."""
    return _links(placed).select(*CONV, "fragment_a", "fragment_b", "place_b", (F.col("place_a") - F.col("place_b")).alias("shift"))


def overlaps(rows: DataFrame) -> DataFrame:
    """The overlap graph of the fragments of a conversation, without the edges that
    follow from others (all shared messages of which a fragment between holds too).

    (conv, fragment_a, fragment_b, shift, shared, ambiguous): ``shift`` is the place
    in a of b's first message, ``shared`` the messages that both hold at this shift;
    ``ambiguous`` where both share messages at another shift too, or the shared ones
    are not a whole suffix and prefix.
    """
    placed, lengths = _placed(_nodes(rows))
    placed = cut(placed)
    pairs = _links(placed).select(*CONV, "fragment_a", "fragment_b").distinct()
    mine, theirs = (placed.select(*CONV, F.col("fragment").alias(f"fragment_{x}"), "node", "twin", F.col("place").alias(f"place_{x}")) for x in "ab")
    both = pairs.join(mine, [*CONV, "fragment_a"]).join(theirs, [*CONV, "fragment_b", "node", "twin"])
    edges = both.groupBy(*CONV, "fragment_a", "fragment_b", (F.col("place_a") - F.col("place_b")).alias("shift")).agg(F.count(F.lit(1)).alias("shared"))
    edges = edges.withColumn("shifts", F.count(F.lit(1)).over(Window.partitionBy(*CONV, "fragment_a", "fragment_b")))
    a, b = (lengths.select(*CONV, F.col("fragment").alias(f"fragment_{x}"), F.col("len").alias(f"len_{x}")) for x in "ab")
    edges = edges.join(a, [*CONV, "fragment_a"]).join(b, [*CONV, "fragment_b"])
    room = F.least(F.col("len_a") - F.greatest("shift", F.lit(0)), F.col("len_b") - F.greatest(-F.col("shift"), F.lit(0)))
    return edges.select(*CONV, "fragment_a", "fragment_b", "shift", "shared", ((F.col("shifts") > 1) | (F.col("shared") < room)).alias("ambiguous"))


def _paths(found: DataFrame) -> DataFrame:
    """(conv, fragment, place, path, at): where the runs lead each overlapping place.

    A place points at an earlier fragment's; pointers are doubled until all point
    at the first fragment of their path.
    """
    up = cut(found.select(*CONV, F.col("fragment_b").alias("fragment"), F.col("place_b").alias("place"), F.col("fragment_a").alias("path"), (F.col("place_b") + F.col("shift")).alias("at")))
    while True:
        above = up.select(*CONV, F.col("fragment").alias("path"), F.col("place").alias("at"), F.col("path").alias("head"), F.col("at").alias("there"))
        if up.join(above, [*CONV, "path", "at"], "left_semi").isEmpty():
            return up
        step = up.join(above, [*CONV, "path", "at"], "left")
        up = cut(step.select(*CONV, "fragment", "place", F.coalesce("head", "path").alias("path"), F.coalesce("there", "at").alias("at")))


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One row for each message of a conversation: that of the smallest row id.

    A fragment's own repeats of a message are one by their hash; rows of several
    fragments are one where they have one place on one path.
    """
    first = F.min(F.struct("row_id", "pos", "role", "ts", "visible")).alias("m")
    nodes = _nodes(rows)
    several = cut(nodes.groupBy(*CONV).agg(F.min("fragment").alias("a"), F.max("fragment").alias("b")).filter("a < b").select(*CONV))
    parts = nodes.join(several, CONV, "left_semi")
    placed = cut(_placed(parts)[0])
    on_path = placed.join(_paths(runs(placed)), [*CONV, "fragment", "place"], "left").select(*CONV, "fragment", "node", "twin", F.coalesce("path", "fragment").alias("path"), F.coalesce("at", "place").alias("at"))
    along = parts.join(on_path, [*CONV, "fragment", "node", "twin"]).groupBy(*CONV, "path", "at").agg(first)
    whole = nodes.join(several, CONV, "left_anti").groupBy(*CONV, "node", "twin").agg(first)
    return along.select(*CONV, "m.*").unionByName(whole.select(*CONV, "m.*"))


def _carry_time(nodes: DataFrame, block_rows: int, hot: DataFrame | None) -> DataFrame:
    """Fill missing times from the nearest earlier row by position."""
    rows = with_blocks(nodes, CONV, "pos", block_rows, hot=hot)
    order = [F.col("pos").asc_nulls_first(), F.col("row_id")]
    inside = Window.partitionBy(*CONV, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("filled", F.last("ts", ignorenulls=True).over(inside))
    ends = rows.groupBy(*CONV, "block").agg(F.max_by("filled", F.struct(F.coalesce("pos", F.lit(-1)), "row_id")).alias("end"))
    before = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*CONV, "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    return rows.join(ends, [*CONV, "block"]).withColumn("at", F.coalesce("filled", "carried")).drop("block", "filled", "carried")


def assemble(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kept conversations: (conv_table, conv_id, turn_no, row_id, role, at)."""
    nodes = cut(merged_nodes(rows))
    hot = hot_groups(nodes, CONV, block_rows)
    timed = _carry_time(nodes, block_rows, hot).filter("visible")
    timed = timed.withColumn("micros", F.unix_micros("at"))
    rows = with_blocks(timed, CONV, "micros", block_rows, hot=hot)
    order = Window.partitionBy(*CONV, "block").orderBy(F.col("micros").asc_nulls_first(), F.col("pos").asc_nulls_first(), "row_id")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("prev", F.lag("role").over(order))
    is_user = F.col("role") == "user"
    unanswered = (is_user & (F.col("prev") == "user")).cast("long")
    parts = rows.groupBy(*CONV, "block").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("role", "nth").alias("first"), F.max_by("role", "nth").alias("last"),
        F.sum(F.coalesce(unanswered, F.lit(0))).alias("gaps"), F.sum((F.col("role") == "unknown").cast("long")).alias("strangers"),
    )
    along, whole = Window.partitionBy(*CONV).orderBy("block"), Window.partitionBy(*CONV)
    back = along.rowsBetween(Window.unboundedPreceding, -1)
    seam = (F.col("first") == "user") & (F.lag("last").over(along) == "user")
    parts = parts.withColumn("before", F.coalesce(F.sum("size").over(back), F.lit(0))).withColumn("seam", F.coalesce(seam, F.lit(False)).cast("long"))
    parts = parts.withColumn("bad", F.sum(F.col("gaps") + F.col("strangers") + F.col("seam")).over(whole))
    parts = parts.withColumn("opens", F.min_by("first", "block").over(whole)).withColumn("closes", F.max_by("last", "block").over(whole))
    kept = parts.filter("bad = 0 and opens = 'user' and closes = 'assistant'").select(*CONV, "block", "before")
    out = rows.join(kept, [*CONV, "block"])
    return out.select(*CONV, (F.col("before") + F.col("nth") - 1).cast("int").alias("turn_no"), "row_id", "role", "at")


def conversations(sessions: DataFrame, chats: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Both tables' kept conversations, turn by turn."""
    return assemble(session_rows(sessions).unionByName(chat_rows(chats)), block_rows)
