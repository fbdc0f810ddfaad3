from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.splitting import cuts, session_blocks, split_items, symbol_bodies


def greedy(text: str, limit: int) -> list[int]:
    """One cut after the other, as the rule is written."""
    data = text.encode()
    para, lines, fenced, blank, at = set(), set(), False, False, 0
    for line in text.split("\n"):
        start = at
        at += len(line.encode()) + 1
        body = line.strip(" \t\r")
        if start:
            lines.add(start)
        if body and blank and not fenced and start:
            para.add(start)
        if body.startswith("```"):
            fenced = not fenced
        blank = not body
    space = {i + 1 for i, b in enumerate(data) if b == 32}
    char = {i for i, b in enumerate(data) if b & 0xC0 != 0x80}
    out = [0]
    while len(data) - out[-1] > limit:
        s = out[-1]
        for marks in (para, lines, space, char):
            fit = [m for m in marks if s < m <= s + limit]
            if fit:
                out.append(max(fit))
                break
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab  \n\n\t\r`é漢😀", "```", "\n\n", "\n```\n"]), max_size=120), st.integers(4, 40))
def test_cuts_match_the_rule(parts, limit):
    text = "".join(parts)
    assert list(cuts(text.encode(), limit)) == greedy(text, limit)


def test_pieces_overlap_and_come_back_together(spark):
    texts = ["", " ", "x" * 30, "wörd " * 40, None, "a\n\nb\n\n" * 20, "漢" * 50]
    items = spark.createDataFrame([("t", i, 0, x, "clash") for i, x in enumerate(texts)], "item_table string, item_id long, block_no int, text string, piece_no string")
    rows = split_items(items, limit=20, overlap=5, with_text=True).collect()
    assert split_items(items.union(items), limit=20, overlap=5, with_text=True).count() == 2 * len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.item_id, []).append(r)
    assert sorted(by) == [0, 1, 2, 3, 5, 6]
    for i, got in by.items():
        data, got = texts[i].encode(), sorted(got, key=lambda r: r.piece_no)
        assert [r.piece_no for r in got] == list(range(len(got)))
        assert b"".join(data[r.cut_byte : r.end_byte] for r in got) == data
        assert all(r.end_byte - r.cut_byte <= 20 and 0 <= r.cut_byte - r.from_byte <= 5 for r in got)
        assert all(data[r.from_byte : r.end_byte].decode() == r.text for r in got)


def test_sources_and_empty_tables(spark):
    block = "array<struct<type:string,text:string>>"
    s = spark.createDataFrame([(1, "user", ("user", [("text", "a"), ("tool_use", None), ("text", "b")])), (2, "system", ("x", [("text", "c")])), (3, "user", None)], f"row_id long, line_type string, message struct<role:string,content:{block}>")
    assert [(r.item_id, r.block_no, r.text) for r in session_blocks(s).orderBy("block_no").collect()] == [(1, 0, "a"), (1, 2, "b")]
    e = spark.createDataFrame([], "emit_id long, body string")
    assert split_items(symbol_bodies(e)).count() == 0
