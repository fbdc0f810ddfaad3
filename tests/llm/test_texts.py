import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from strandloom.llm.leaks import Automaton, leak_spans, leaks, quoting, without_leaks, words
from strandloom.llm.lookalikes import Transducer, canonical, confusables, kept, same_look_classes, same_look_pairs, transducer
from strandloom.llm.mixing import entropy, exponent_for_entropy, mix_plan, mix_report, realise, temperature, token_sizes

WORDS = [f"w{i}" for i in range(40)]


# -- look-alikes ------------------------------------------------------------------


def test_canonical_forms():
    same = ["café fine cAPE x-ray 12", "cafe\u0301 ﬁne сАРЕ x-ray １２", "ca\u200bfé\u00a0fi\u00adne\u2007cΑPΕ\u2009x-ray\ufeff 12"]
    assert {canonical(t) for t in same} == {same[0]}
    for a, b in [("x²", "x2"), ("①", "1"), ("½", "1/2"), ("™", "TM"), ("№", "No"), ("–", "-"), ("“", '"'), ("ß", "ss"), ("é", "e"), ("a b", "ab"), ("A", "a"), ("l", "I"), ("к", "k")]:
        assert canonical(a) != canonical(b)
    assert canonical(None) is None and canonical("") == "" and canonical("\u0301a") == "\u0301a"
    assert canonical("a\r\nb\rc\u2028d") == "a\nb\nc\nd" and canonical("ё") == canonical("е\u0308") == canonical("ë")


def test_one_pass_is_enough():
    table = transducer()[1]
    assert all(canonical(t) == t for t in table.values())
    rng = random.Random(4)
    chars = [*table, "a", "e", "\u0301", "\u0308", "\u200d", "é", " ", "\n"]
    for _ in range(300):
        once = canonical("".join(rng.choice(chars) for _ in range(12)))
        assert canonical(once) == once
    assert all(unicodedata.normalize("NFC", t) == t for t in table.values())


def test_tables_compose_as_unicode_does_and_conflicts_are_told(tmp_path):
    built = Transducer({})
    rng = random.Random(9)
    marks = ["\u0301", "\u0308", "\u0323", "\u0345", "\u0300", "\u0327", "\u031b", "\u0302"]
    for _ in range(3000):
        text = "".join(rng.choice(["a", "e", "o", "ω", "и", "é", "ё", "ǟ", "ậ", *marks, *marks]) for _ in range(rng.randrange(1, 7)))
        if text[0] not in marks:
            assert built.run(text) == unicodedata.normalize("NFC", text), ascii(text)
    for letters in ({"é": "e"}, {"\u00a0": "x"}, {"а": "ｂ", "ｂ": "а"}):
        with pytest.raises(ValueError):
            Transducer(letters)
    file = tmp_path / "confusables.txt"
    file.write_text("# head\n0501 ;\t0064 ;\tMA\t# d\n0430 ; 0061 ; MA\n006D ; 0072 006E ; MA\n13A0 ; 0044 ; MA\n")
    found = confusables(str(file))
    assert found["Ꭰ"] == "D" and "m" not in found and canonical("Ꭰay", found) == "Day" and canonical("Ꭰay") == "Ꭰay"


def test_words_of_another_script_are_kept_for_reading():
    assert kept("привет сАРЕ Ｗorld ρόδο") == "привет cAPE World ρόδο" and canonical("привет") != "привет"
    assert kept(None) is None and kept("a\u00a0b") == "a b" and kept("сора") == "copa"


def test_classes(spark):
    texts = ["same", "same", "ѕame", "sаme", "other", "other", None, "\u200b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.writings) for r in same_look_classes(df).collect()} == {(i, 0, 3) for i in range(4)}


def test_pairs(spark):
    texts = ["same", "same", "ѕame", "sаme", "other", None, "\u200b ", " ", "Same", "same "]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    got = {(r.doc_id_a, r.doc_id_b) for r in same_look_pairs(df).collect()}
    assert got == {(0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}
    assert same_look_pairs(df.limit(0)).count() == 0


# -- leaks ------------------------------------------------------------------------


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(1, 25)))) for i in range(30)] + [(99, "w0 w0 w0 w0 w0 w0"), (98, "w0 w0 w0 w0 w0 w0")]
    auto = Automaton(items, min_words=4)
    grams = {}
    for i, p in items:
        ws = p.split()
        for k in range(len(ws) - 3):
            grams.setdefault(tuple(ws[k : k + 4]), set()).add(i)
    for _ in range(200):
        doc = [rng.choice(WORDS[:7]) for _ in range(rng.randrange(0, 40))]
        want = {}
        for k in range(len(doc) - 3):
            for i in grams.get(tuple(doc[k : k + 4]), ()):
                want.setdefault(i, set()).update(range(k, k + 4))
        got = {}
        for i, a, b in auto.matches(doc):
            got.setdefault(i, set()).update(range(a, b))
        assert got == want


def test_leaks_and_removal(spark):
    passage = " ".join(WORDS[:20])
    docs = [(1, f"before. {passage.upper().replace(' ', ',\n> ')}! after"), (2, " ".join(WORDS[:12])), (3, None), (4, "ｗ0 " + " ".join(WORDS[1:13])), (5, ""), (6, "x " * 100_000 + passage)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item string")
    e = spark.createDataFrame([(7, passage), (7, passage), (8, "short"), (9, None)], "item_id long, passage string")
    spans = leak_spans(d, e)
    assert {(r.doc, r.item): r.longest for r in leaks(spans).collect()} == {(1, 7): 20, (4, 7): 13, (6, 7): 20}
    left = {r.doc: (r.text, r.removed_words) for r in without_leaks(d, spans).collect()}
    assert left[1] == ("before. ! after", 20) and left[2] == (docs[1][1], 0) and left[3] == (None, 0) and left[6][1] == 20
    assert leak_spans(d, e.limit(0)).count() == 0 and leak_spans(d.limit(0), e).count() == 0
    assert words("L’état_2—Ｘ") == ["l", "état", "2", "x"]


def test_spans_of_an_item_do_not_overlap(spark):
    item = " ".join(WORDS[:14]) + " q " + " ".join(WORDS[4:18])
    assert Automaton([(1, item)]).matches(WORDS[:18]) == [(1, 0, 18)]
    d = spark.createDataFrame([(1, " ".join(WORDS[:18])), (2, " ".join(WORDS[:15]) + " z" * 60)], "doc_id long, text string")
    spans = leak_spans(d, spark.createDataFrame([(1, item), (2, " ".join(WORDS[:16]))], "item_id long, passage string"))
    assert {(r.doc, r.item): (r.longest, r.covered) for r in leaks(spans).collect()} == {(1, 1): (18, 18), (1, 2): (16, 16), (2, 1): (14, 14), (2, 2): (15, 15)}
    # By length 15 only the 18 and 16 words go; by share also what covers most of a document.
    kept = {r.doc: r.removed_words for r in without_leaks(d, spans, max_words=15, max_share=1.0).collect()}
    assert kept == {1: 18, 2: 0}
    assert {r.doc: r.removed_words for r in without_leaks(d, spans, max_words=99, max_share=0.5).collect()} == {1: 18, 2: 0}
    assert {r.doc: r.removed_words for r in without_leaks(d, spans, max_words=99, max_share=0.19).collect()} == {1: 18, 2: 15}


def test_several_automata(spark, monkeypatch):
    d = spark.createDataFrame([(i, " ".join(WORDS[i : i + 16])) for i in range(12)], "doc_id long, text string")
    e = spark.createDataFrame([(i, " ".join(WORDS[i : i + 20])) for i in range(0, 20, 3)], "item_id long, passage string")
    whole = sorted(leak_spans(d, e).collect())
    monkeypatch.setattr("strandloom.llm.leaks.ITEM_BYTES", 150)
    assert whole and sorted(leak_spans(d, e).collect()) == whole


def test_quoting_any_part_of_a_passage(spark):
    passage = " ".join(WORDS[:40])
    docs = [(1, passage[:60] + " " + " ".join(WORDS[10:14])), (2, "x " + " ".join(WORDS[20:36]) + " y"), (3, " ".join(WORDS[20:30])), (4, "a Short one b"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(7, passage), (8, "short one"), (9, None), (10, "")], "item_id long, passage string")
    assert {(r.query_id, r.id) for r in quoting(d, e).collect()} == {(7, 1), (7, 2), (8, 4)}


# -- mixing -----------------------------------------------------------------------


def test_temperature():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    assert temperature(shares, 1) == shares
    flat = temperature(shares, 0)
    assert abs(flat["a"] - flat["c"]) < 1e-12 and flat["d"] == 0
    x = exponent_for_entropy(shares, 0.9)
    assert abs(entropy(temperature(shares, x)) - 0.9) < 1e-6


def test_exponents_decide_the_budgets(spark, monkeypatch):
    sizes = spark.createDataFrame([(1, "a", 700), (2, "b", 200), (3, "c", 100), (4, "x", 500)], "id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.3, 2)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in mix_plan(sizes, t).collect()}
    assert {k for k, r in plan.items() if r.short} == {"b", "c"} and plan["a"].exponent == 1 and plan["a"].budget == 600
    for k in "bc":  # the weight at the exponent is what the repeats allow
        have = plan[k].tokens / 1000
        assert plan[k].exponent < 1 and plan[k].budget == plan[k].max_repeats * plan[k].tokens
        assert abs(have * (plan[k].target_share / have) ** plan[k].exponent - plan[k].weight) < 1e-12
    assert abs(sum(r.mix_share for r in plan.values()) - 1) < 1e-12
    # A target below the natural share that does not fit either needs an exponent above 1.
    once = {r.source: r for r in mix_plan(sizes, t.selectExpr("source", "if(source = 'a', 0.9, target_share) target_share", "1 as max_repeats")).collect()}
    assert once["a"].target_share < 0.7 and once["a"].exponent > 1 and once["a"].budget == 700
    even = {r.source: r.target_share for r in mix_plan(sizes, t, target_entropy=5.0).collect()}
    assert max(even.values()) - min(even.values()) < 1e-3
    monkeypatch.setattr("strandloom.llm.mixing.fitting_exponent", lambda have, target, most: F.lit(0.0))
    natural = {r.source: r for r in mix_plan(sizes, t).collect()}
    assert all(r.short for r in natural.values()) and natural["c"].budget == 150


def test_mix_reaches_its_shares_within_repeats(spark):
    docs = [(i, "word " * (1 + i % 9), [" Big", "small", "other", "TINY "][0 if i < 700 else 1 if i < 900 else 2 if i < 990 else 3]) for i in range(1000)] + [(1001, None, "big"), (1002, " ", "big"), (1003, "x", None)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, source string, tokens string")
    t = spark.createDataFrame([("big", 0.5, 2), ("Small", 0.3, 4), ("tiny", 0.15, 2), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    sizes = token_sizes(d)
    assert sizes.count() == 1001 and sizes.filter("source is null").count() == 1
    plan = mix_plan(sizes, t)
    assert {r.source for r in plan.filter("short").collect()} == {"tiny", "none"}
    for block in (20_000_000, 50):
        mix = realise(sizes, plan, block_tokens=block)
        report = {r.source: r for r in mix_report(plan, mix).collect()}
        for r in report.values():
            assert r.used <= r.budget and r.most_copies <= r.max_repeats
            assert r.used >= r.budget - 10 * 9
        assert report["none"].used == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert mix_plan(sizes, t.limit(0)).count() == 0
    empty = mix_plan(sizes.limit(0), t)
    assert empty.filter("budget > 0").count() == 0 and realise(sizes.limit(0), empty).count() == 0
