"""What the queries' plans do with large tables: findings of round 2."""

import random
import re

import pytest
from pyspark.sql import functions as F

from captionforge.functions import text_rules as tr
from captionforge.functions import tokens as tk
from captionforge.operators import file_rules
from captionforge.operators.storage import stored
from captionforge.plans import corpus
from captionforge.plans import queries as q

SIGNS = ["a", "b", "Z", "7", " ", " ", "　", " ", "\x85", "\n", "'", "’", '"', "“", "”", "…", ".", "...", "... ", "]", "[", "-", "♪", "<i>", "</i>", "é", "漢", "😀", " ' s", " '"]


def texts(n, seed=11):
    r = random.Random(seed)
    return [None, "", *["".join(r.choices(SIGNS, k=r.randint(1, 14))) for _ in range(n)]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_file_rules_do_not_shuffle_the_entries(spark, sf):
    entries = stored(corpus.entries(corpus.lines(spark, sf)))
    p = plan(file_rules.post_process(entries, between=stored))
    assert "hashpartitioning" not in p and p.count("Scan ExistingRDD") <= 5


#: The rules as single expressions, which look at every place of a text.
PLAIN = {
    "t2": lambda c: tr.sub(tr.sub(tr.sub(F.translate(c, "‘’", "''"), rf"({tr.WORD_CHAR}) ' (s|t|m|d)(?!{tr.WORD_CHAR})", "$1'$2"), rf"({tr.WORD_CHAR}) ' (ll|ve|re)(?!{tr.WORD_CHAR})", "$1'$2"), rf"(?d)({tr.WORD_CHAR}) '(?={tr.WS}|[,;:!?.]|$)", "$1'"),
    "t4": lambda c: tr.sub(tr.sub(tr.sub(c, rf"(?<=\]|{tr.SYM})(?=[^ ])", " "), rf"(?<=[^ \-])(?=\[|{tr.SYM})", " "), rf"\A{tr.WS}+|{tr.WS}+\z", ""),
    "t5": lambda c: tr.sub(c, rf"{tr.WS}*…{tr.WS}*", "..."),
    "t6": lambda c: tr.sub(c, rf"(?<![.\p{{Nd}}])\.(?!{tr.WS}|[.]|\z)|(?<=\p{{Nd}})\.(?!{tr.WS}|[\p{{Nd}}.]|\z)", ". "),
    "t7": lambda c: tr.sub(c, r"(?:\A|(?<=\] ))\.\.\. +", "..."),
    "t8": lambda c: tr.sub(tr.sub(tr.sub(tr.sub(c, rf'(?d){tr.WS}+(["”]){tr.WS}*$', "$1"), rf'\A{tr.WS}*(["“]){tr.WS}+', "$1"), rf"{tr.WS}+(”)", "$1"), rf"(“){tr.WS}+", "$1"),
}


def test_rules_equal_their_plain_forms(spark):
    d = spark.createDataFrame([(x,) for x in texts(4000)], "t string").cache()
    for name, plain in PLAIN.items():
        assert d.filter(~tr.STEPS[name](F.col("t")).eqNullSafe(plain(F.col("t")))).isEmpty(), name
    # texts without a sign that a rule looks for go past its expressions
    assert all("contains(" in plan(d.select(tr.STEPS[n](F.col("t")))).lower() for n in ("t2", "t5", "t7", "t8"))


@pytest.mark.parametrize("name", ["q_styled_text", "q_expand_italics", "q_bridge_punct", "q_promote"])
def test_tokens_are_not_taken_by_a_filter(spark, sf, name):
    filters = [x for x in plan(q.QUERIES[name](spark, sf)).splitlines() if re.search(r"\bFilter\b", x)]
    assert filters and not any("regexp_extract_all" in x for x in filters)


def test_starts_make_no_arrays_for_sums(spark):
    d = spark.createDataFrame([(x,) for x in texts(500)], "t string").select("t", tk.with_starts(F.col("t")).alias("s"))
    assert "aggregate(" in plan(d) and not re.search(r"aggregate\([^()]*\([^()]*\), array\(", plan(d))
    assert all(x.t[y.start : y.start + len(y.text)] == y.text for x in d.filter("t is not null").collect() for y in x.s)


def test_generated_methods_are_short_enough_to_be_compiled(spark, sf):
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(q.QUERIES["q_tokens"](spark, sf)._jdf.queryExecution().executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:\s*(\d+)", code))) < 8000


def test_pictures_are_taken_in_pieces(spark, sf):
    import pyarrow as pa

    from captionforge.operators import batches, display_sets, raster
    from captionforge.plans import pipeline

    b = pa.RecordBatch.from_pydict({"a": list(range(1000)), "b": [{"x": None}] * 1000})
    found = list(batches.pieces([b]))
    assert max(p.num_rows for p in found) <= batches.ROWS and [r.a for p in found for r in batches.records(p)] == list(range(1000))
    shown = pipeline.intervals(q.picture_sets(spark, sf))
    for d in (raster.line_images(shown), raster.debug_images(shown), display_sets.fold_fuzzy(q.drawn_sets(spark, sf).selectExpr("file_id", "track", "seq", "start_pts", "end_pts", "true visible", "1 n_objects", "0 x", "0 y", "20 w", "20 h", "bitmaps[0][0].rle rle", "palette"))):
        assert "MapInArrow" in plan(d) and "MapInPandas" not in plan(d)
    assert raster.taps.cache_info().maxsize <= 256


def test_models_are_asked_in_pieces_and_other_columns_stay(spark):
    from captionforge.operators import recognise

    class Model(recognise.LookupRecognizer):
        def recognize(self, png):
            return (None, 0) if png == b"3" else (png.decode(), 0.5)

    d = spark.range(0, 300, 1, 1).selectExpr("id", "timestamp_seconds(id) at", "if(id = 5, null, array(id)) l", "cast(cast(id as string) as binary) png", "'old' text")
    read = recognise.recognise(d, lambda: Model({}))
    assert "MapInArrow" in plan(read) and read.columns == ["id", "at", "l", "png", "text", "score"]
    assert read.drop("text", "score").exceptAll(d.drop("text")).isEmpty()
    assert [r.text for r in read.orderBy("id").collect()] == [None if i == 3 else str(i) for i in range(300)]


def test_starts_slice_no_array_for_each_token(spark):
    d = spark.createDataFrame([("a bc  d " * 1500,), ("é 漢😀 x" * 40,), ("",), (None,)], "t string").select("t", tk.with_starts(F.col("t")).alias("s"))
    assert "substring_index(" in plan(d)
    got = d.collect()
    assert len(got[0].s) == 4500
    assert all(x.t[y.start : y.start + len(y.text)] == y.text for x in got if x.s for y in x.s)
    assert all([y.start for y in x.s] == sorted({y.start for y in x.s}) for x in got if x.s)
    assert got[2].s == [] and got[3].s is None


@pytest.mark.parametrize("name", ["q_expand_italics", "q_bridge_punct", "q_promote", "q_track_subtitles"])
def test_a_file_number_is_looked_for_once_a_document(spark, sf, name):
    p = plan(q.QUERIES[name](spark, sf))
    assert p.count("regexp_extract(source") == 1 and p.index("regexp_extract(source") > p.index("posexplode(")  # below the lines


@pytest.mark.parametrize("name", ["q_expand_italics", "q_bridge_punct", "q_promote"])
def test_token_queries_filter_without_patterns(spark, sf, name):
    p = plan(q.QUERIES[name](spark, sf))
    assert not re.search(r"\bFilter .*RLIKE", p) and "arrays_zip" not in (p if name == "q_expand_italics" else "")


def test_tokens_equal_their_plain_form(spark):
    d = spark.createDataFrame([(x,) for x in [*texts(4000), " ", "\t \x85 ", " \t a", "éa b", "\x07", "　。"]], "t string").cache()
    t = F.col("t")
    assert d.filter(~tk.tokens(t).eqNullSafe(F.regexp_extract_all(t, F.lit(tk.TOKEN), F.lit(0)))).isEmpty()
    assert d.filter(~tk.has_token(t).eqNullSafe(t.rlike(tk.TOKEN))).isEmpty()
    assert 'regexp_extract_all(t' in plan(d.select(tk.tokens(t))) and " *+(" in plan(d.select(tk.tokens(t)))


def test_spacing_is_one_pass_and_skips_plain_texts(spark):
    d = spark.createDataFrame([(x,) for x in texts(4000, 12)], "t string").cache()
    p = plan(d.select(tr.normalize_spacing(F.col("t")).alias("x"))).lower()
    assert p.count("regexp_replace(") == 1 and "octet_length(" in p
    plain = {"t1": lambda c: tr.trim(tr.sub(c, r"(?i)</?i>", "")), "t3": lambda c: tr.sub(c, r"(?<=[a-z])(?=[A-Z])", " "), "t4": PLAIN["t4"]}
    for name, old in plain.items():
        assert d.filter(~tr.STEPS[name](F.col("t")).eqNullSafe(old(F.col("t")))).isEmpty(), name
