"""The recognition cascade around pluggable recognisers.

A recogniser is made once per Python process of an executor from a factory (a picklable callable). Rows that the first model reads well never
reach the fallback: the plan is split by a filter and joined again by a union, since Spark would call a Python function
for every row of a conditional expression.
"""

from __future__ import annotations

import re
import atexit
import hashlib
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.text_rules import is_blank, rtrim
from ..plans.config import PipelineConfig
from . import italic, raster
from .batches import arrow_schema, pieces, records
from .storage import stored


class Recognizer(Protocol):
    """Failures are (None, 0) or None, and so is an answer that takes too long (limits are the recogniser's own); only a
    lost connection may raise."""

    def recognize(self, png: bytes) -> tuple[str | None, float]: ...

    def fallback(self, png: bytes, prompt: str) -> str | None: ...

    def classify(self, tokens: list[str], png: bytes, reference: str, prompt: str) -> str | None: ...


Factory = Callable[[], Recognizer]


class LookupRecognizer:
    """Answers from tables by the PNG's SHA-256: texts {hash: (text, score)}, fallbacks {hash: text}, answers {hash: raw}."""

    def __init__(self, texts: dict, fallbacks: dict | None = None, answers: dict | None = None):
        self.texts, self.fallbacks, self.answers = texts, fallbacks or {}, answers or {}

    @staticmethod
    def key(png: bytes) -> str:
        import hashlib

        return hashlib.sha256(png).hexdigest()

    def recognize(self, png: bytes) -> tuple[str | None, float]:
        return self.texts.get(self.key(png), (None, 0.0))

    def fallback(self, png: bytes, prompt: str) -> str | None:
        return self.fallbacks.get(self.key(png))

    def classify(self, tokens: list[str], png: bytes, reference: str, prompt: str) -> str | None:
        return self.answers.get(self.key(png))


def result_text_score(result) -> tuple[str, float]:
    """Text and mean score of a model's result: a string, a mapping with text(s) and score(s) under their usual names,
    a list of such, or an object that turns into one."""
    if result is None:
        return "", 0.0
    if isinstance(result, str):
        return result, 1.0
    for name in ("to_dict", "to_json"):
        if hasattr(result, name):
            return result_text_score(getattr(result, name)())
    if isinstance(result, dict):
        inner = result.get("res", result)
        if inner is not result and isinstance(inner, dict):
            return result_text_score(inner)
        text = next((inner[k] for k in ("rec_text", "text", "rec_texts", "texts") if inner.get(k) is not None), "")
        score = next((inner[k] for k in ("rec_score", "score", "confidence", "rec_scores", "scores") if inner.get(k) is not None), 0.0)
        if isinstance(text, (list, tuple)):
            text = " ".join(map(str, text))
        if isinstance(score, (list, tuple)):
            score = sum(map(float, score)) / len(score) if score else 0.0
        return str(text), float(score)
    if isinstance(result, (list, tuple)):
        both = [result_text_score(x) for x in result]
        return " ".join(t for t, _ in both if t), (sum(s for _, s in both) / len(both) if both else 0.0)
    return str(result), 0.0


def accepted(text: Column, score: Column, threshold: float) -> Column:
    """Is a reading believed?"""
    return F.coalesce((score >= threshold) & ~is_blank(text), F.lit(False))


def with_fallback(read: DataFrame, call: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """read (text, score, ...) with vlm: rows that aren't believed are given to call, which replaces their text."""
    ok = accepted(F.col("text"), F.col("score"), threshold)
    kept = read.filter(ok).withColumn("vlm", F.lit(False))
    return kept.unionByName(call(read.filter(~ok)).withColumn("vlm", F.lit(True)))


#: Rules by which a line goes to the fallback although it was read well; the first that holds names the reason.
FALLBACK_RULES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "tag-segment-mismatch": lambda text, tag, body, verified: (tag > 0) & (body < F.length(text)) & ~verified,
}


def fallback_reason(text: Column, tag: Column, body: Column, verified: Column, rules: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    rules = FALLBACK_RULES if rules is None else rules
    return F.coalesce(*[F.when(rule(text, tag, body, verified), F.lit(name)) for name, rule in rules.items()], F.lit(None).cast("string"))


def verdict(text: Column, tag: Column, body: Column, tag_italic: Column, body_italic: Column) -> Column:
    """The line with italic tags by what is italic; a null body verdict means the line was judged as a whole by tag_italic."""
    wrap = lambda c: F.concat(F.lit("<i>"), c, F.lit("</i>"))
    upto = lambda n: F.substring(text, F.lit(1), n)
    after = lambda n: F.substring(text, n + 1, F.length(text))
    whole = F.when(tag_italic, wrap(rtrim(text))).otherwise(text)
    return (
        F.when(body_italic.isNull(), whole)
        .when(tag_italic & body_italic, wrap(rtrim(text)))
        .when(body_italic, F.concat(upto(body), wrap(rtrim(after(body)))))
        .when(tag_italic, F.concat(wrap(upto(tag)), rtrim(after(tag))))
        .otherwise(text)
    )


_MODELS: dict[str, Recognizer] = {}


def _model(name: str, factory: Factory) -> Recognizer:
    """The process's recogniser of this name; it serves all tasks and operators, and is closed when the process ends."""
    if name not in _MODELS:
        _MODELS[name] = factory()
        if hasattr(_MODELS[name], "close"):
            atexit.register(_MODELS[name].close)
    return _MODELS[name]


def _mapped(d: DataFrame, factory: Factory, added: str, each: Callable) -> DataFrame:
    """d with the columns of `added` from each(recogniser, row)."""
    fields = list(arrow_schema(added))
    clash = [f.name for f in fields if f.name in d.columns]
    out = d.drop(*clash)
    name = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", " + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, factory)
        for b in pieces(batches):
            got = [each(model, r) for r in records(b)]
            rest = [n for n in b.schema.names if n not in clash]
            new = [pa.array([g[i] for g in got], f.type) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in rest], *new], names=[*rest, *[f.name for f in fields]])

    return d.mapInArrow(run, schema)


def recognise(lines: DataFrame, factory: Factory) -> DataFrame:
    """lines (png, ...) with text and score."""
    def each(m: Recognizer, r):
        try:
            text, score = m.recognize(bytes(r.png))
        except ConnectionError:
            raise
        except Exception:  # a picture that the model can't read
            text, score = None, 0.0
        return text, float(score)

    return _mapped(lines, factory, "text string, score double", each)


def ask_fallback(lines: DataFrame, factory: Factory, prompt: str) -> DataFrame:
    return _mapped(lines, factory, "text string", lambda m, r: ((m.fallback(bytes(r.png), prompt) or "").strip() or None,))


_SPACE = re.compile(r"\s")


def geometry(lines: DataFrame, factory: Factory, italic_threshold: float) -> DataFrame:
    """lines (png, text, tag_len, body_at) with verified, tag_italic and body_italic.

    A tag is verified if the recogniser reads just it from the first segments of the line, taken one more at a time."""
    def each(m: Recognizer, r):
        gray = raster.png_to_gray(bytes(r.png))
        if r.tag_len > 0 and r.body_at < len(r.text):
            want = _SPACE.sub("", r.text[: r.tag_len]).lower()
            parts = raster.segments(gray)
            for n in range(1, len(parts)):
                crop = raster.crop_columns(gray, parts[0][0], parts[n - 1][1])
                if crop is None:
                    continue
                said, _ = m.recognize(raster.png_gray(crop))
                if _SPACE.sub("", said or "").lower() == want:
                    rest = raster.crop_columns(gray, parts[n][0], gray.shape[1])
                    return True, raster.classify_italic(crop, italic_threshold)[0], raster.classify_italic(rest, italic_threshold)[0]
            return False, False, None
        return False, raster.classify_italic(gray, italic_threshold)[0], None

    return _mapped(lines, factory, "verified boolean, tag_italic boolean, body_italic boolean", each)


def classified(lines: DataFrame, factory: Factory, prompt: str) -> DataFrame:
    """lines (png, text) with answer: what the model says of the tokens; null where no italics are looked for."""
    d = lines.withColumn("toks", tk.tokens(F.col("text"))).withColumn("ref", tk.for_reference(F.col("text")))
    idle = (F.size("toks") == 0) | tk.needs_no_italics(F.col("toks")) | F.col("ref").isNull()
    asked = _mapped(d.filter(~idle), factory, "answer string", lambda m, r: (m.classify(list(r.toks), bytes(r.png), r.ref, prompt),))
    return asked.unionByName(d.filter(idle).withColumn("answer", F.lit(None).cast("string"))).drop("ref")


def read_lines(lines: DataFrame, factory: Factory, config: PipelineConfig) -> DataFrame:
    """lines (file_id, idx, start_ms, end_ms, line_no, png) with text (null if nothing was read) and vlm."""
    keep = ["file_id", "idx", "start_ms", "end_ms", "line_no"]
    # each answer of a model is asked for once: what is split into branches is stored first
    first = stored(recognise(lines, factory))
    read = stored(with_fallback(first, lambda d: ask_fallback(d, factory, config.prompt), config.verify_threshold))
    blank = read.filter(F.coalesce(is_blank(F.col("text")), F.lit(True)))
    d = read.filter(~is_blank(F.col("text"))).withColumn("text", config.clean(F.col("text")))
    tag = tk.leading_tag(F.col("text"))
    d = geometry(d.withColumn("tag_len", tag["length"]).withColumn("body_at", tag["body"]), factory, config.italic_threshold)
    d = stored(d.withColumn("reason", fallback_reason(F.col("text"), F.col("tag_len"), F.col("body_at"), F.col("verified"), config.fallback_rules)))
    plain = d.filter("reason is null").withColumn("text", verdict(F.col("text"), F.col("tag_len"), F.col("body_at"), F.col("tag_italic"), F.col("body_italic")))

    odd = d.filter("reason is not null")
    again = ask_fallback(odd.filter("not vlm").withColumn("first", F.col("text")), factory, config.prompt)
    again = again.withColumn("text", F.when(F.coalesce(is_blank(F.col("text")), F.lit(True)), F.col("first")).otherwise(config.clean(F.col("text")))).drop("first")
    odd = classified(stored(again.unionByName(odd.filter("vlm"))), factory, config.italics_prompt)
    cls = tk.usable_answer(F.col("answer"), F.col("toks"))
    odd = odd.withColumn("cls", cls)
    styled = F.when(F.col("cls").isNull(), F.col("text")).otherwise(tk.styled(F.col("text"), italic.post_process(F.col("cls"), F.col("toks"))))
    odd = odd.withColumn("text", styled).withColumn("vlm", F.lit(True))

    out = [*keep, "text", "vlm"]
    return plain.select(*out).unionByName(odd.select(*out)).unionByName(blank.select(*keep, F.lit(None).cast("string").alias("text"), "vlm"))
