from pyspark.sql import functions as F

from captionforge.operators import file_rules, srt
from captionforge.plans import corpus

ENTRY = "file_id string, idx long, start_ms long, end_ms long, text string, vlm_lines array<boolean>"


def apply(spark, rule, texts, vlm=None):
    d = spark.createDataFrame([("f", i, 0, 1, t, vlm[i] if vlm else None) for i, t in enumerate(texts)], ENTRY)
    return [r.text for r in rule(d).orderBy("idx").collect()]


def test_dominant_glyph(spark):
    assert apply(spark, file_rules.standardize_music_glyph, ["♪ ♪", "♫"]) == ["♪ ♪", "♪"]
    assert apply(spark, file_rules.standardize_music_glyph, ["♪", "♫"]) == ["♪", "♫"]  # none over 60 %
    # a line read by the fallback model is rewritten but not counted
    assert apply(spark, file_rules.standardize_music_glyph, ["♪", "♫ ♫ ♫"], [[False], [True]]) == ["♪", "♪ ♪ ♪"]


def test_spacing(spark):
    assert apply(spark, file_rules.standardize_glyph_spacing, ["♪ a ♪", "♪ b ♪", "♪c♪"]) == ["♪ a ♪", "♪ b ♪", "♪ c ♪"]
    assert apply(spark, file_rules.standardize_glyph_spacing, ["♪ a ♪", "♪c♪", "♪d"]) == ["♪a♪", "♪c♪", "♪d"]
    assert apply(spark, file_rules.standardize_glyph_spacing, ["♪ a ♪", "♪c♪"]) == ["♪a♪", "♪c♪"]  # a tie removes


def test_note_position(spark):
    assert apply(spark, file_rules.standardize_note_italics, ["<i>♪ a ♪</i>", "♪ <i>b</i> ♪"]) == ["<i>♪ a ♪</i>", "<i>♪ b ♪</i>"]
    assert apply(spark, file_rules.standardize_note_italics, ["<i>♪ a ♪</i>", "♪ <i>b</i> ♪", "♪ <i>c</i>"])[0] == "♪ <i>a</i> ♪"


def test_lyrics(spark):
    assert apply(spark, file_rules.standardize_lyric_italics, ["♪ <i>a</i> ♪", "♪ b ♪"]) == ["♪ <i>a</i> ♪", "♪ <i>b</i> ♪"]
    assert apply(spark, file_rules.standardize_lyric_italics, ["♪ <i>a</i> ♪", "♪ b\nc ♪", "♪ d ♪"]) == ["♪ a ♪", "♪ b\nc ♪", "♪ d ♪"]
    assert apply(spark, file_rules.standardize_lyric_italics, ["<i>♪ a ♪</i>", "♪ b\nc ♪"]) == ["<i>♪ a ♪</i>", "<i>♪ b</i>\n<i>c ♪</i>"]


def test_merged_spans(spark):
    assert apply(spark, file_rules.merge_italic_spans, ["<i>a</i>\n<i>b</i>", "<i>a</i> ・ <i>b</i>", None]) == ["<i>a\nb</i>", "<i>a ・ b</i>", None]


def test_files_vote_by_themselves_and_twice_changes_nothing(spark, sf):
    e = corpus.entries(corpus.lines(spark, sf)).cache()
    for rule in file_rules.RULES.values():
        once = rule(e).cache()
        assert once.count() == e.count()
        twice = rule(once)
        assert once.select("file_id", "idx", "text").exceptAll(twice.select("file_id", "idx", "text")).isEmpty()
        once.unpersist()
    e.unpersist()


def test_empty_and_null(spark):
    d = spark.createDataFrame([], ENTRY)
    assert file_rules.post_process(d).count() == 0 and srt.blocks(d).count() == 0
    assert apply(spark, file_rules.post_process, [None, "", "x"]) == [None, "", "x"]


def test_srt(spark, tmp_path):
    d = spark.createDataFrame([("a", 3, 61001, 62000, "x\ny", None), ("a", 1, 0, 999, " ", None), ("a", 2, 5, 6, "é", None), ("b", 1, 0, 1, "z", None)], ENTRY)
    out = {r.file_id: r for r in srt.write(d, str(tmp_path)).collect()}
    assert out["a"].entries == 2
    text = (tmp_path / "a.en.srt").read_bytes().decode()
    assert text == "1\n00:00:00,005 --> 00:00:00,006\né\n\n2\n00:01:01,001 --> 00:01:02,000\nx\ny\n\n"


def test_glyph_distribution(spark):
    d = spark.createDataFrame([("f", 0, 0, 1, "♪♪\n♫", [False, True])], ENTRY)
    assert [tuple(r) for r in file_rules.glyph_counts(d).orderBy(F.desc("n")).collect()] == [("f", "♪", 2)]
