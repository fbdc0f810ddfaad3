import datetime as dt
import random

import strandloom.llm.conversations as conversations_module
from strandloom.llm.conversations import assemble, chat_rows, conversations, overlaps, session_rows

T0 = dt.datetime(2026, 1, 1)
SESSION = "row_id long, session_id string, line_no int, line_type string, message_id string, message struct<role:string,content:array<struct<type:string,text:string>>>, ts timestamp, conv_id string"
CHAT = "row_id long, export_id string, conv_uuid string, msg_pos int, message_uuid string, text string, sender string, created_at timestamp"


def at(n):
    return None if n is None else T0 + dt.timedelta(seconds=n)


def line(row, conv, no, role, text="hi", ts=None, mid=None, kind=None):
    return (row, conv, no, kind or "user", mid, (role, [("text", text), ("tool_use", "x")]), at(ts), "clash")


def kept(df):
    out = {}
    for r in df.orderBy("conv_id", "turn_no").collect():
        out.setdefault(r.conv_id, []).append(r.row_id)
    return out


def test_roles_gaps_blanks_and_twins(spark):
    rows = [
        line(1, "ok", 0, "Human ", ts=1), line(2, "ok", 1, "MODEL", ts=2), line(3, "ok", 2, None, ts=3, kind="user"), line(4, "ok", 3, " ", ts=4, kind="assistant"),
        line(5, "gap", 0, "user", ts=1), line(6, "gap", 1, "user", ts=2), line(7, "gap", 2, "assistant", ts=3),
        line(8, "stranger", 0, "user", ts=1), line(9, "stranger", 1, "narrator", ts=2), line(10, "stranger", 2, "assistant", ts=3),
        line(11, "open", 0, "user", ts=1), line(12, "late", 0, "assistant", ts=1), line(13, "late", 1, "user", ts=2), line(14, "late", 2, "assistant", ts=3),
        line(15, "twin", 0, "user", ts=1, mid="m"), line(16, "twin", 1, "user", ts=1, mid="m"), line(17, "twin", 2, "assistant", ts=2), line(18, "twin", 3, "assistant", ts=3),
        line(19, "blank", 0, "user", ts=1), line(20, "blank", 1, "user", "\u200b \u2060\u00a0", ts=2), line(21, "blank", 2, "assistant", ts=3),
        line(22, "time", 5, "assistant"), line(23, "time", 4, "user", ts=9), line(24, "time", 0, "user", ts=1), line(25, "time", 1, "assistant"), line(26, None, 0, "user", ts=1),
        line(27, "other", 0, "user", ts=1, kind="summary"),
    ]
    for size in (200_000, 1):
        got = kept(assemble(session_rows(spark.createDataFrame(rows, SESSION)), block_rows=size))
        assert got == {"ok": [1, 2, 3, 4], "twin": [15, 17, 18], "blank": [19, 21], "time": [24, 25, 23, 22]}


def brute(rows):
    """The rule, one conversation after the other."""
    convs = {}
    for r in rows:
        who = (r[6] or "").strip().lower()
        if r[2] is not None and who not in ("system", "tool"):
            convs.setdefault(r[2], []).append(r)
    out = {}
    for conv, ms in convs.items():
        first = {}
        for m in ms:
            key = m[4] if m[4] is not None else ("#", m[0])
            if key not in first or m[0] < first[key][0]:
                first[key] = m
        ms, last, timed = sorted(first.values(), key=lambda m: (m[3], m[0])), None, []
        for m in ms:
            last = m[7] or last
            timed.append((last or dt.datetime.min, m[3], m[0], m))
        ms = [m for *_, m in sorted(timed, key=lambda t: t[:3]) if (m[5] or "").strip()]
        roles = ["u" if (m[6] or "").strip().lower() in ("user", "human") else "a" if (m[6] or "").strip().lower() in ("assistant", "model", "ai") else "?" for m in ms]
        if ms and "?" not in roles and roles[0] == "u" and roles[-1] == "a" and "uu" not in "".join(roles):
            out[conv] = [m[0] for m in ms]
    return out


def test_random_chats_match_the_rule_in_blocks(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        n = rng.randrange(1, 7)
        for i in range(n):
            sender = rng.choice(["human", "assistant"]) if rng.random() < 0.25 else ["human", "ai"][i % 2]
            rows.append((len(rows), f"e{rng.randrange(2)}", f"c{c}", i, f"m{c}-{rng.randrange(20) if rng.random() < 0.3 else i}", rng.choice(["x", "x", "x", " ", None]), rng.choice([sender] * 30 + ["system", None, "moderator"]), at(rng.choice([None, i, 5]))))
    df = spark.createDataFrame(rows, CHAT)
    want = brute(rows)
    assert want
    for size in (200_000, 2):
        assert kept(assemble(chat_rows(df), block_rows=size)) == want


def test_overlap_graph(spark):
    def export(name, ids, first=0):
        return [(hash((name, m)) % 10**9, name, "c", i + first, f"m{m}", "x", "human", at(m)) for i, m in enumerate(ids)]

    rows = export("e1", range(5)) + export("e2", range(3, 9)) + export("e3", range(9)) + export("e4", [20, 1, 21])
    got = {(r.fragment_a, r.fragment_b): (r["shift"], r.shared, r.ambiguous) for r in overlaps(chat_rows(spark.createDataFrame(rows, CHAT))).collect()}
    assert got[("e1", "e3")] == (0, 5, False)  # all messages that both hold, e2's too
    assert got[("e1", "e2")] == (3, 2, False)
    assert got[("e2", "e3")] == (-3, 6, False)
    assert got[("e3", "e4")][2] is True


def exports(held):
    """Chat rows of one conversation: messages by number, an even one a user's."""
    rows = []
    for name, ids in held:
        rows += [(len(rows) + k, name, "c", k, f"m{i}", f"text {i}", ["human", "assistant"][i % 2], at(i)) for k, i in enumerate(ids)]
    return rows


def test_paths_of_many_exports(spark):
    whole = list(range(12))
    for held in (
        [("e1", whole[:6]), ("e2", whole[4:10]), ("e3", whole[8:])],
        [("e1", whole), ("e2", whole[2:5]), ("e3", whole[:8]), ("e4", whole[6:])],
        [("e1", [0, 1, 4, 5, 6, 7]), ("e2", whole), ("e3", [2, 3, 10, 11])],  # e1 lacks messages in the middle: two runs
    ):
        rows = exports(held)
        want = brute(rows)
        assert want and kept(assemble(chat_rows(spark.createDataFrame(rows, CHAT)))) == want


def test_the_overlap_graph_decides(spark, monkeypatch):
    rows = spark.createDataFrame(exports([("e1", range(6)), ("e2", range(2, 10))]), CHAT)
    assert kept(assemble(chat_rows(rows))) == {"c": [0, 1, 2, 3, 4, 5, 10, 11, 12, 13]}
    whole = conversations_module.runs
    monkeypatch.setattr(conversations_module, "runs", lambda placed: whole(placed).limit(0))
    assert kept(assemble(chat_rows(rows))) != {"c": [0, 1, 2, 3, 4, 5, 10, 11, 12, 13]}


def test_empty(spark):
    assert conversations(spark.createDataFrame([], SESSION), spark.createDataFrame([], CHAT)).count() == 0
