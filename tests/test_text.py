import random

import pytest
from pyspark.sql import functions as F

from captionforge.functions import glyphs, lang, scalars, text_rules
from captionforge.functions import tokens as tk

EN = [
    ("Don ' t go", "Don't go"), ("it ’ s", "it's"), ("comin ' for", "comin' for"), ("they ' ve", "they've"), ("WolfDoctor", "Wolf Doctor"),
    ("McDonald", "Mc Donald"), ("USA", "USA"), ("Thank you.I love you.", "Thank you. I love you."), ("99.9 percent", "99.9 percent"), ("5.Go", "5. Go"),
    ("a.b.c", "a. b. c"), ("... the fog", "...the fog"), ("… the fog", "...the fog"), ("[Name] ... word", "[Name] ...word"), ("[Name] … word", "[Name]...word"),
    ("word … next", "word...next"), ("♪text♪", "♪ text ♪"), ("♪♫la", "♪ ♫ la"), ("-[Bob]Hi", "-[Bob] Hi"), ("-♪la la", "-♪ la la"),
    ("said “ Hello ” to", "said “Hello” to"), ('" Go ahead. "', '"Go ahead."'), ("£5", "£ 5"), ("wait—what", "wait — what"), ("<I>x</i>", "x"), ("", ""),
]
JA = [("そうだ。行こう", "そうだ 。 行こう"), ("「待て」", "「 待て 」"), ("え…", "え..."), ("♪～", "♪ ～"), ("WolfDoctor", "WolfDoctor")]


def values(spark, items, column):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, text string")
    return [r[1] for r in sorted(d.select("i", column(F.col("text")).alias("v")).collect())]


@pytest.mark.parametrize("language,golden", [("en", EN), ("ja", JA), ("jpn", JA), ("eng", EN), ("xx", EN)])
def test_chains(spark, language, golden):
    assert values(spark, [a for a, _ in golden], lambda c: text_rules.mid_process(c, language)) == [b for _, b in golden]


def test_null_text(spark):
    assert values(spark, [None], text_rules.mid_process) == [None]


def test_white_space_of_any_kind(spark):
    assert values(spark, ["　<i>a</i> ", "é ' s", "x　”"], text_rules.strip_italic_tags)[0] == "a"
    assert values(spark, ["é ' s"], text_rules.normalize_apostrophes) == ["é's"]
    assert values(spark, ["x　”"], text_rules.fix_quote_spacing) == ["x”"]


def test_tokens(spark):
    golden = {
        "[MAN] It's ♪ ok... go!": ["[MAN]", "It's", "♪", "ok", "...", "go", "!"], "漢字abc漢": ["漢", "字", "abc漢"], "-[X]hi": ["-", "[X]", "hi"],
        "[oops": ["[", "oops"], "！？": ["！？"], "don't 'quote'": ["don't", "'", "quote", "'"], "": [], "  ": [],
    }
    assert values(spark, list(golden), tk.tokens) == list(golden.values())
    for text, found in zip(golden, values(spark, list(golden), tk.with_starts), strict=True):
        assert [text[t.start : t.start + len(t.text)] for t in found] == golden[text]


def test_leading_tags(spark):
    golden = {"YODA: Do or do not": (5, 6), "[MAN] BOB: [quiet] hi": (18, 19), "-[X] hi": (4, 5), "- BOB: hi": (6, 7), "I: am": (2, 3), "[door slams]": (0, 0), "Bob: hi": (0, 0)}
    assert [tuple(x) for x in values(spark, list(golden), tk.leading_tag)] == list(golden.values())


def test_times(spark):
    golden = {0: "00:00:00,000", 999: "00:00:00,999", 61001: "00:01:01,001", 90061001: "25:01:01,001", 360000000: "100:00:00,000"}
    d = spark.createDataFrame([(x,) for x in golden], "ms long")
    assert {r[0]: r[1] for r in d.select("ms", scalars.srt_time(F.col("ms"))).collect()} == golden


def test_notes_inside_and_outside(spark):
    assert values(spark, ["♪ <i>text</i> ♪", "♪ text", "BOB: ♪ x ♪"], glyphs.put_inside) == ["<i>♪ text ♪</i>", "<i>♪ text</i>", "BOB: <i>♪ x ♪</i>"]
    assert values(spark, ["<i>♪ text ♪</i>", "<i>♪ text</i>", "<i>-♪ a ♪</i>", "<i>♪ ♪</i>"], glyphs.put_outside) == ["♪ <i>text</i> ♪", "♪ <i>text</i>", "-♪ <i>a</i> ♪", "<i>♪ ♪</i>"]


def test_tag_aware_walk(spark):
    f = values(spark, ["♪ <i>a</i> ♪", "<i>♪ a", "<b>♪</b> x <i>", "< ♪ x"], glyphs.flags)
    assert [(x.gl, x.ti, x.to, x.gi, x.go) for x in f] == [(True, True, False, False, True), (True, True, False, True, False), (True, False, True, False, True), (True, False, True, False, True)]


def test_aliases(spark):
    assert values(spark, ["EN", "jpn", "Fr"], lang.aliases) == [["en", "eng"], ["ja", "jpn"], ["fr"]]


def test_answers(spark):
    raw = ['x {"classification": ["I","R"]} y', '{"Classification":["i"]}', "none", '{"classification": [', None]
    assert values(spark, raw, tk.parse_answer) == [["I", "R"], ["i"], None, None, None]


def test_styled_text_keeps_the_text(spark):
    import random

    from captionforge.operators import italic

    r = random.Random(3)
    texts = ["".join(r.choices("ab [].,!♪'-  é漢1", k=r.randint(1, 20))) for _ in range(300)]
    d = spark.createDataFrame([(t, r.random()) for t in texts], "text string, p double").withColumn("toks", tk.tokens(F.col("text")))
    d = d.withColumn("cls", F.transform("toks", lambda t, i: F.when(F.pmod(F.xxhash64(t, i), F.lit(2)) == 0, "I").otherwise("R")))
    for x in d.select("text", "cls", "toks", tk.styled(F.col("text"), F.col("cls")).alias("s"), italic.expand_boundaries(F.col("cls"), F.col("toks")).alias("e"), italic.post_process(F.col("cls"), F.col("toks")).alias("p")).collect():
        assert x.s.replace("<i>", "").replace("</i>", "") == x.text
        assert x.s.count("<i>") == x.s.count("</i>") and "</i><i>" not in x.s
        assert len(x.e) == len(x.cls) == len(x.p) and all(b == "I" for a, b in zip(x.cls, x.e, strict=True) if a == "I")


def test_growing_spans(spark):
    """A sign next to an italic token becomes italic unless a roman word follows it on the other side, until nothing changes."""
    from captionforge.operators import italic

    r = random.Random(7)
    cases = [(["R", "I", "R"], ['"', "word", '"']), (["R", "R", "I"], ["no", ",", "yes"]), (["I", "R", "R"], ["yes", "...", "no"]), (["R", "R", "R", "I"], ["no", "(", '"', "yes"])]
    for _ in range(1500):
        toks = r.choices(["a", "b1", ",", ".", "[X]", "♪", "-"], k=r.randint(1, 12))
        cases.append((r.choices("IRi", k=len(toks)), toks))
    word = lambda t: any(c.isalnum() for c in t)

    def brute(cls, toks):
        on = [c.lower() == "i" for c in cls]
        roman = lambda i: 0 <= i < len(toks) and not on[i] and word(toks[i])
        while True:
            new = [i for i, t in enumerate(toks) if not on[i] and t.isascii() and not word(t)
                   and any(0 <= i - s < len(toks) and on[i - s] and not roman(i + s) for s in (1, -1))]
            if not new:
                return ["I" if x and c.lower() != "i" else c for x, c in zip(on, cls, strict=True)]
            on[new[0]] = True

    d = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(cases)], "n int, cls array<string>, toks array<string>")
    got = {x.n: x.e for x in d.select("n", italic.expand_boundaries(F.col("cls"), F.col("toks")).alias("e")).collect()}
    assert all(got[i] == brute(c, t) for i, (c, t) in enumerate(cases))
    assert [got[i] for i in range(4)] == [["I", "I", "I"], ["R", "R", "I"], ["I", "R", "R"], ["R", "R", "I", "I"]]


def test_long_lines(spark):
    """Starts and styled text of a line of many tokens, in less than quadratic time."""
    words = [f"w{i}" + "," * (i % 3 == 0) for i in range(12_000)]
    d = spark.createDataFrame([(" ".join(words),)], "text string")
    r = d.select(tk.with_starts(F.col("text")).alias("s"), tk.styled(F.col("text"), F.transform(tk.tokens(F.col("text")), lambda t, i: F.when(i % 2 == 0, "I").otherwise("R"))).alias("t")).first()
    text = " ".join(words)
    assert all(text[x.start : x.start + len(x.text)] == x.text for x in r.s) and r.t.replace("<i>", "").replace("</i>", "") == text
