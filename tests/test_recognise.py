import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.operators import raster, recognise
from captionforge.plans.config import PipelineConfig


def image(seed, slant=0.0):
    g = np.full((40, 160), 255, dtype=np.uint8)
    for x in range(6 + seed, 120, 7 + seed % 3):
        for y in range(5, 35):
            at = int(x + slant * (35 - y))
            g[y, at : at + 3] = 0
    return raster.png_gray(g)


LINE = "file_id string, idx long, start_ms long, end_ms long, line_no int, png binary"


def test_cascade(spark):
    pngs = [image(i) for i in range(5)] + [image(7, 0.3)]
    key = recognise.LookupRecognizer.key
    texts = {key(pngs[0]): ("Hello.World", 0.99), key(pngs[1]): ("doubt", 0.5), key(pngs[2]): ("  ", 0.99), key(pngs[4]): ("BOB: what now", 0.99), key(pngs[5]): ("Leaning text", 0.98)}
    fallbacks = {key(pngs[1]): " sure ", key(pngs[4]): "BOB KAY: who now"}
    answers = {key(pngs[4]): '{"classification": ["R", "R", "R", "I", "I"]}'}
    d = spark.createDataFrame([("f", i, 0, 1, 0, p) for i, p in enumerate(pngs)], LINE)
    calls = lambda: recognise.LookupRecognizer(texts, fallbacks, answers)
    got = {r.idx: (r.text, r.vlm) for r in recognise.read_lines(d, calls, PipelineConfig()).collect()}
    assert got == {0: ("Hello. World", False), 1: ("sure", True), 2: (None, True), 3: (None, True), 4: ("BOB KAY: <i>who now</i>", True), 5: ("<i>Leaning text</i>", False)}


def test_fallback_sees_only_what_was_rejected(spark):
    d = spark.createDataFrame([(1, "good", 0.99), (2, "bad", 0.2), (3, None, 1.0), (4, " ", 1.0)], "id int, text string, score double")
    got = recognise.with_fallback(d, lambda x: x.withColumn("text", F.concat(F.lit("again "), F.col("id").cast("string"))), 0.97)
    assert {r.id: (r.text, r.vlm) for r in got.collect()} == {1: ("good", False), 2: ("again 2", True), 3: ("again 3", True), 4: ("again 4", True)}


def test_verdicts(spark):
    d = spark.createDataFrame([("BOB: hi ", 4, 5, t, b) for t, b in ((True, True), (False, True), (True, False), (False, False), (True, None), (False, None))], "text string, tag int, body int, t boolean, b boolean")
    got = [r[0] for r in d.select(recognise.verdict(*map(F.col, ("text", "tag", "body", "t", "b")))).collect()]
    assert got == ["<i>BOB: hi</i>", "BOB: <i>hi</i>", "<i>BOB:</i> hi", "BOB: hi ", "<i>BOB: hi</i>", "BOB: hi "]


def test_result_shapes():
    f = recognise.result_text_score
    assert f("a") == ("a", 1.0) and f(None) == ("", 0.0)
    assert f({"rec_text": "a", "rec_score": 0.5}) == ("a", 0.5)
    assert f({"res": {"rec_texts": ["a", "b"], "rec_scores": [0.5, 1.0]}}) == ("a b", 0.75)
    assert f([{"text": "a", "score": 1}, {"text": "b", "score": 0}]) == ("a b", 0.5)


def test_config():
    assert PipelineConfig(language="jpn").code == "ja"
    assert PipelineConfig(language="xx").prompt == PipelineConfig().prompt
    for bad in ({"debug": True}, {"verify_threshold": 1.5}, {"italic_threshold": 50}, {"track": -2}):
        with pytest.raises(ValueError):
            PipelineConfig(**bad)


def test_one_model_a_process(spark):
    """Tasks and operators of a process share the recogniser that a factory makes."""
    def factory():
        import os

        os.environ["MODELS_MADE"] = str(int(os.environ.get("MODELS_MADE", "0")) + 1)

        class Counting(recognise.LookupRecognizer):
            def recognize(self, png):
                return os.environ["MODELS_MADE"], 1.0

        return Counting({})

    d = spark.createDataFrame([("f", i, 0, 1, 0, b"x") for i in range(40)], LINE).repartition(20)
    assert {r.text for r in recognise.recognise(d, factory).collect()} == {"1"}


def test_own_steps_and_rules(spark, tmp_path):
    """A run's own text steps, file rules and fallback rules, and the pictures between the steps."""
    from captionforge.plans import pipeline, queries

    config = PipelineConfig(debug=True, debug_dir=str(tmp_path / "debug"), text_steps=(F.upper,), file_rules=(lambda d: d.withColumn("text", F.concat(F.col("text"), F.lit("!"))),), fallback_rules={})
    sets = queries.stored(queries.picture_sets(spark, "/root/testdata/sf0.001").orderBy("seq").limit(6))
    got = pipeline.entries(sets, queries.reader, config).collect()
    assert got and all(r.text.endswith("!") and r.text == r.text.upper() for r in got)
    assert {r.stage for r in spark.read.parquet(config.debug_dir).select("stage").distinct().collect()} == {"raw", "mask", "final"}
