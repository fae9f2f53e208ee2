"""Queries over the driver's tables, one or more for each operator, with their SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import glyphs as g
from ..functions import scalars, text_rules
from ..functions import tokens as tk
from ..operators import display_sets as ds
from ..operators import file_rules, italic, raster, recognise, signals, srt
from ..operators.batches import ROWS, give_back
from ..operators.storage import stored
from ..sources import tracks
from . import corpus
from .oracles import (
    BASE, ENTRIES, G, SETS, SIGNAL, SPEAKER, TEXT, TOK, WS, chain, f1, f2, f3, f4, f5, line_query, mid, rx, step, trim,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- lines of text -------------------------------------------------------------------------------------------------


def _line(spark: SparkSession, d: str, *cols: Column) -> DataFrame:
    return corpus.lines(spark, d).select("doc_id", "line_no", *cols)


for _name, _step in text_rules.STEPS.items():
    query(f"q_{_name}", line_query(f"{step(_name, 'text')} AS text"))(
        lambda spark, d, f=_step: _line(spark, d, f(F.col("text")).alias("text")))
for _code in ("en", "ja"):
    query(f"q_mid_{_code}", line_query(f"{mid(_code, 'text')} AS text"))(
        lambda spark, d, c=_code: _line(spark, d, text_rules.mid_process(F.col("text"), c).alias("text")))


@query("q_changed_lines", f"{BASE} SELECT file_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE {step(n, 'text')} <> text) AS BIGINT) AS {n}" for n in text_rules.STEPS) + " FROM dec GROUP BY file_id")
def changed_lines(spark, d):
    """How many lines each rule changes, by file."""
    counts = [F.count_if(f(F.col("text")) != F.col("text")).alias(n) for n, f in text_rules.STEPS.items()]
    return corpus.lines(spark, d).groupBy("file_id").agg(*counts)


@query("q_t6_pages", f"SELECT page_id, {step('t6', 'html')} AS text FROM pages")
def dots_in_pages(spark, d):
    return table(spark, d, "pages").select("page_id", text_rules.fix_dot_spacing(F.col("html")).alias("text"))


@query("q_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def stripped(spark, d):
    return table(spark, d, "pages").select("page_id", g.strip_tags(F.col("html")).alias("text"))


# --- tokens --------------------------------------------------------------------------------------------------------


@query("q_tokens", line_query(f"array_to_string(regexp_extract_all(text, '{TOK}'), '¦') AS tokens, CAST(len(regexp_extract_all(text, '{TOK}')) AS BIGINT) AS n"))
def token_lists(spark, d):
    t = tk.tokens(F.col("text"))
    return _line(spark, d, F.array_join(t, "¦").alias("tokens"), F.size(t).cast("long").alias("n"))


TOKENS = f"""{BASE}, tok AS (
  SELECT doc_id, line_no, text, unnest(regexp_extract_all(text, '({WS}*)({TOK})', 1)) AS gap, unnest(regexp_extract_all(text, '({WS}*)({TOK})', 2)) AS t,
         generate_subscripts(regexp_extract_all(text, '{TOK}'), 1) AS n FROM dec),
cls AS (SELECT *, CASE WHEN substr(md5(t || ':' || n), 1, 1) < 'b' THEN 'I' ELSE 'R' END AS c, count(*) OVER (PARTITION BY doc_id, line_no) AS m,
   NOT regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]') AND regexp_full_match(t, '[\\x00-\\x7F]+') AS p, regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]') AS letter, length(t) > 1 AND t LIKE '[%' AND t LIKE '%]' AS br FROM tok)"""


def _classes(toks: Column) -> Column:
    """A made-up classification: I or R by a hash of the token and its place (from 1)."""
    h = lambda t, i: F.md5(F.concat(t, F.lit(":"), (i + 1).cast("string")))  # noqa: E731  (the first digit decides)
    return F.transform(toks, lambda t, i: F.when(h(t, i) < "b", F.lit("I")).otherwise(F.lit("R")))


def _classed(spark, d) -> DataFrame:
    """Lines with tokens, which are those that aren't blank: the filter takes no tokens, as they would be taken twice."""
    x = corpus.lines(spark, d).filter(tk.has_token(F.col("text"))).withColumn("toks", tk.tokens(F.col("text")))
    return x.withColumn("cls", _classes(F.col("toks")))


@query("q_token_starts", f"""{TOKENS} SELECT doc_id, line_no, n - 1 AS token_no, t AS token,
  CAST(sum(length(gap) + length(t)) OVER (PARTITION BY doc_id, line_no ORDER BY n) - length(t) AS BIGINT) AS start FROM tok""")
def token_starts(spark, d):
    x = _line(spark, d, F.posexplode(tk.with_starts(F.col("text"))).alias("token_no", "t"))
    return x.select("doc_id", "line_no", F.col("token_no").cast("long").alias("token_no"), F.col("t.text").alias("token"), F.col("t.start").cast("long").alias("start"))


@query("q_bridge_punct", f"""{TOKENS}, b AS (SELECT *, CASE WHEN n > 1 AND n < m AND c = 'R' AND p AND NOT regexp_full_match(t, '[.!?]*')
  AND lag(c) OVER w = 'I' AND lead(c) OVER w = 'I' THEN 'I' ELSE c END AS x FROM cls WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY n))
SELECT doc_id, line_no, string_agg(x, '' ORDER BY n) AS cls FROM b GROUP BY doc_id, line_no""")
def bridged(spark, d):
    x = _classed(spark, d)
    return x.select("doc_id", "line_no", F.array_join(tk.bridge_punctuation(F.col("cls"), F.col("toks")), "").alias("cls"))


@query("q_promote", f"""{TOKENS}, b AS (SELECT *, count(*) FILTER (WHERE letter AND NOT br AND c = 'R') OVER w AS roman, count(*) FILTER (WHERE letter AND NOT br) OVER w AS words FROM cls WINDOW w AS (PARTITION BY doc_id, line_no))
SELECT doc_id, line_no, string_agg(CASE WHEN roman = 1 AND words >= 2 AND NOT br THEN 'I' ELSE c END, '' ORDER BY n) AS cls FROM b GROUP BY doc_id, line_no""")
def promoted(spark, d):
    x = _classed(spark, d)
    return x.select("doc_id", "line_no", F.array_join(tk.promote_nearly_all(F.col("cls"), F.col("toks")), "").alias("cls"))


@query("q_styled_text", f"""{TOKENS}, b AS (SELECT *, coalesce(lag(c) OVER w, 'R') AS before FROM cls WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY n)),
s AS (SELECT doc_id, line_no, any_value(text) AS text, string_agg((CASE WHEN c = 'R' AND before = 'I' THEN '</i>' ELSE '' END) || gap || (CASE WHEN c = 'I' AND before = 'R' THEN '<i>' ELSE '' END) || t, '' ORDER BY n) AS body,
  arg_max(c, n) AS last, sum(length(gap) + length(t)) AS used FROM b GROUP BY doc_id, line_no)
SELECT doc_id, line_no, body || (CASE WHEN last = 'I' THEN '</i>' ELSE '' END) || substr(text, CAST(used AS BIGINT) + 1) AS text FROM s""")
def styled(spark, d):
    x = _classed(spark, d)
    return x.select("doc_id", "line_no", tk.styled(F.col("text"), F.col("cls")).alias("text"))


@query("q_expand_italics", f"""{TOKENS}, k AS (SELECT *, CASE WHEN c = 'I' THEN 'I' WHEN letter THEN 'W' WHEN p THEN 'P' ELSE 'S' END AS kind FROM cls),
s AS (SELECT *, max(CASE WHEN kind <> 'P' THEN n END) OVER a AS before, min(CASE WHEN kind <> 'P' THEN n END) OVER z AS after FROM k
  WINDOW a AS (PARTITION BY doc_id, line_no ORDER BY n ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY doc_id, line_no ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT s.doc_id, s.line_no, s.n, CASE WHEN s.kind = 'P' AND (l.kind = 'I' AND (s.n < coalesce(s.after, s.m + 1) - 1 OR coalesce(r.kind, '') <> 'W')
    OR r.kind = 'I' AND (s.n > coalesce(s.before, 0) + 1 OR coalesce(l.kind, '') <> 'W')) THEN 'I' ELSE s.c END AS c
  FROM s LEFT JOIN k l ON l.doc_id = s.doc_id AND l.line_no = s.line_no AND l.n = s.before LEFT JOIN k r ON r.doc_id = s.doc_id AND r.line_no = s.line_no AND r.n = s.after)
SELECT doc_id, line_no, string_agg(c, '' ORDER BY n) AS cls FROM x GROUP BY doc_id, line_no""")
def expanded(spark, d):
    x = _classed(spark, d)
    return x.select("doc_id", "line_no", F.array_join(italic.expand_boundaries(F.col("cls"), F.col("toks")), "").alias("cls"))


@query("q_italic_skip", f"{TOKENS} SELECT doc_id, line_no, bool_and(NOT letter OR br) AS skip FROM cls GROUP BY doc_id, line_no")
def skipped(spark, d):
    x = _classed(spark, d)
    return x.select("doc_id", "line_no", tk.needs_no_italics(F.col("toks")).alias("skip"))


_REF = rx(rx(rx("text", rf"^-+{WS}*", "  "), r"[^\x00-\x7F\p{L}\p{Nd}]", "  "), " {3,}", "  ")


@query("q_reference_text", line_query(f"CASE WHEN {trim(_REF)} = '' THEN NULL ELSE {_REF} END AS ref"))
def reference(spark, d):
    return _line(spark, d, tk.for_reference(F.col("text")).alias("ref"))


# Fixed value: a leading speaker tag, for the other dialect.
_TAG = r"^(?:-+\s*)?(?:(?:\[[^\]]*\]\s*)+(?:[A-Z][A-Z0-9]*:\s*)?(?:\[[^\]]*\]\s*)*|(?:[A-Z][A-Z0-9]*:\s*)(?:\[[^\]]*\]\s*)*)"
_TAG_SQL = f"{BASE}, m AS (SELECT *, regexp_extract(text, '{_TAG}') AS tag FROM dec), k AS (SELECT *, tag <> '' AND {trim('substr(text, length(tag) + 1)')} <> '' AS ok FROM m)"


@query("q_leading_tag", f"{_TAG_SQL} SELECT doc_id, line_no, CAST(CASE WHEN ok THEN length(rtrim(tag, ' ')) ELSE 0 END AS INTEGER) AS tag_len, CAST(CASE WHEN ok THEN length(tag) ELSE 0 END AS INTEGER) AS body_at FROM k")
def leading_tags(spark, d):
    t = tk.leading_tag(F.col("text"))
    return _line(spark, d, t["length"].alias("tag_len"), t["body"].alias("body_at"))


def _seen() -> Column:
    return F.substring(F.md5(F.col("text")), 1, 1) < "8"


@query("q_fallback_rule", f"""{_TAG_SQL} SELECT doc_id, line_no, CASE WHEN ok AND length(tag) < length(text) AND NOT (substr(md5(text), 1, 1) < '8') THEN 'tag-segment-mismatch' END AS reason FROM k""")
def reasons(spark, d):
    t = tk.leading_tag(F.col("text"))
    return _line(spark, d, recognise.fallback_reason(F.col("text"), t["length"], t["body"], _seen()).alias("reason"))


@query("q_verdict", f"""{_TAG_SQL}, v AS (SELECT *, substr(md5(text), 2, 1) < '8' AS ti, CASE WHEN ok THEN substr(md5(text), 3, 1) < '8' END AS bi,
  CASE WHEN ok THEN length(rtrim(tag, ' ')) ELSE 0 END AS a, CASE WHEN ok THEN length(tag) ELSE 0 END AS b FROM k)
SELECT doc_id, line_no, CASE WHEN bi IS NULL THEN CASE WHEN ti THEN '<i>' || {rx('text', WS + '+$', '')} || '</i>' ELSE text END
  WHEN ti AND bi THEN '<i>' || {rx('text', WS + '+$', '')} || '</i>'
  WHEN bi THEN substr(text, 1, b) || '<i>' || {rx('substr(text, b + 1)', WS + '+$', '')} || '</i>'
  WHEN ti THEN '<i>' || substr(text, 1, a) || '</i>' || {rx('substr(text, a + 1)', WS + '+$', '')} ELSE text END AS text FROM v""")
def verdicts(spark, d):
    t = tk.leading_tag(F.col("text"))
    bit = lambda i: F.substring(F.md5(F.col("text")), i, 1) < "8"
    return _line(spark, d, recognise.verdict(F.col("text"), t["length"], t["body"], bit(2), F.when(t["length"] > 0, bit(3))).alias("text"))


@query("q_parse_answer", """WITH r AS (SELECT event_id, 'Sure: {"Classification": ["I", "' || event_type || '"], "n": ' || user_id || '} done' AS raw, event_id % 3 AS k FROM events),
b AS (SELECT event_id, regexp_extract(CASE WHEN k = 0 THEN 'nothing' WHEN k = 1 THEN raw ELSE replace(raw, '}', '') END, '(?s)\\{.*\\}') AS body FROM r)
SELECT event_id, CASE WHEN body <> '' THEN array_to_string(CAST(json_extract(replace(body, '"Classification":', '"classification":'), '$.classification') AS VARCHAR[]), ',') END AS cls FROM b""")
def answers(spark, d):
    raw = F.concat(F.lit('Sure: {"Classification": ["I", "'), F.col("event_type"), F.lit('"], "n": '), F.col("user_id").cast("string"), F.lit("} done"))
    k = F.pmod("event_id", F.lit(3))
    text = F.when(k == 0, F.lit("nothing")).when(k == 1, raw).otherwise(F.replace(raw, F.lit("}"), F.lit("")))
    return table(spark, d, "events").select("event_id", F.array_join(tk.parse_answer(text), ",").alias("cls"))


@query("q_confidence_gate", """SELECT event_id, value / 100 >= 0.97 AND event_type <> 'view' AS accepted FROM events""")
def gate(spark, d):
    text = F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", recognise.accepted(text, F.col("value") / 100, 0.97).alias("accepted"))


# --- files ---------------------------------------------------------------------------------------------------------


def _entries(spark, d) -> DataFrame:
    return corpus.entries(corpus.lines(spark, d))


for _name, _sql in (("f1", f1), ("f2", f2), ("f3", f3), ("f4", f4), ("f5", f5)):
    query(f"q_{_name}", f"{ENTRIES}, {_sql('ent', _name)} SELECT file_id, idx, text FROM {_name}_out")(
        lambda spark, d, f=file_rules.RULES[_name]: f(_entries(spark, d)).select("file_id", "idx", "text"))


@query("q_post_all", f"{ENTRIES}, {chain('ent')} SELECT file_id, idx, text FROM f5_out")
def post_all(spark, d):
    """Each rule votes over what the one before wrote; the entries and the votes are stored."""
    return file_rules.post_process(stored(_entries(spark, d)), between=stored).select("file_id", "idx", "text")


@query("q_glyph_counts", f"""{BASE}, c AS (SELECT file_id, unnest(['♭', '♬', '♪', '♩', '♫']) AS glyph, text FROM dec WHERE pattern <> 5)
SELECT file_id, glyph, CAST(sum(length(text) - length(replace(text, glyph, ''))) AS BIGINT) AS n FROM c GROUP BY file_id, glyph HAVING sum(length(text) - length(replace(text, glyph, ''))) > 0""")
def glyph_totals(spark, d):
    return file_rules.glyph_counts(_entries(spark, d))


@query("q_line_flags", line_query(f"""regexp_matches(text, '^(?:<[^>]*>|{WS}|{SPEAKER}:)*{G}') AS lead, regexp_matches(text, '{G}(?:<[^<]*>|{WS})*$') AS tail,
  NOT regexp_matches(regexp_replace(text, '<[^>]+>', '', 'g'), '{TEXT}{G}|{G}{TEXT}') AS spaced, regexp_matches(text, '{G}') AS glyph"""))
def line_flags(spark, d):
    t = F.col("text")
    return _line(spark, d, g.leading_glyph(t).alias("lead"), g.trailing_glyph(t).alias("tail"), g.spaced(t).alias("spaced"), g.has_glyph(t).alias("glyph"))


def _clock(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query("q_srt_blocks", f"""{ENTRIES}, k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n FROM ent WHERE {trim('text')} <> '')
SELECT file_id, n, n || chr(10) || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(10) || text || chr(10) || chr(10) AS block FROM k""")
def srt_blocks(spark, d):
    return srt.blocks(_entries(spark, d)).select("file_id", F.col("n").cast("long").alias("n"), "block")


@query("q_line_totals", f"{ENTRIES} SELECT file_id, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM ent GROUP BY file_id")
def line_totals(spark, d):
    return srt.totals(_entries(spark, d).select("file_id", F.split("text", "\n", -1).alias("lines")))


@query("q_join_lines", f"{ENTRIES} SELECT file_id, idx, text, array_to_string(list_transform(vlm_lines, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS vlm FROM ent")
def joined(spark, d):
    x = corpus.lines(spark, d).withColumns({"idx": F.col("doc_id") * 100000 + F.floor(F.col("line_no") / 2), "vlm": F.col("pattern") == 5, "start_ms": F.lit(0), "end_ms": F.lit(1)})
    return srt.join_lines(x).select("file_id", "idx", "text", F.array_join(F.transform("vlm_lines", lambda v: v.cast("int").cast("string")), "").alias("vlm"))


@query("q_srt_time", f"SELECT event_id, {_clock('ms')} AS t FROM (SELECT event_id, event_id * 7919 AS ms FROM events)")
def times(spark, d):
    return table(spark, d, "events").select("event_id", scalars.srt_time(F.col("event_id") * 7919).alias("t"))


_TRACK_SQL = """WITH t AS (SELECT source AS file_id, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'S_TEXT/UTF8' ELSE 'S_HDMV/PGS' END AS codec, CASE WHEN lang = 'en' THEN 'ENG' WHEN lang = 'de' THEN NULL ELSE lang END AS language FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS place, coalesce(lower(language) IN ('en', 'eng'), false) AS hit FROM t WHERE codec = 'S_HDMV/PGS')"""


def _tracks(spark, d) -> DataFrame:
    x = table(spark, d, "documents")
    lang = F.when(F.col("lang") == "en", F.lit("ENG")).when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("lang"))
    codec = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("S_TEXT/UTF8")).otherwise(F.lit(tracks.CODEC))
    return x.select(F.col("source").alias("file_id"), F.col("doc_id").alias("pos"), codec.alias("codec_id"), lang.alias("language"), (F.col("doc_id") + 1).alias("track_number"))


@query("q_track_choice", _TRACK_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY (CASE WHEN hit THEN 0 ELSE 1 END), place) AS n FROM k) SELECT file_id, pos, language, pos + 1 AS track_number, hit AS matched FROM r WHERE n = 1")
def track_choice(spark, d):
    return tracks.choose(_tracks(spark, d), "en")


@query("q_track_number", _TRACK_SQL + " SELECT file_id, pos, language, pos + 1 AS track_number, true AS matched FROM k WHERE place = 2")
def track_number(spark, d):
    return tracks.choose(_tracks(spark, d), "en", 2)


# --- display sets --------------------------------------------------------------------------------------------------


def _sets(spark, d) -> DataFrame:
    """Events as display sets: a user's events are a track, the type is the picture, `error` clears."""
    x = table(spark, d, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    x = x.select(F.col("user_id").cast("string").alias("file_id"), F.lit(1).cast("long").alias("track"), (ms * 1000000 + F.col("event_id")).alias("seq"), (ms * 90).alias("start_pts"), "event_type")
    w = W.partitionBy("file_id", "track").orderBy("seq")
    return x.withColumn("end_pts", F.lead("start_pts").over(w)).withColumn("key", F.when(F.col("event_type") != "error", F.col("event_type")))


@query("q_display_sets", SETS + " SELECT file_id, track, idx, seq, start_ms, end_ms, n FROM runs")
def folded(spark, d):
    return ds.fold_exact(_sets(spark, d))


_FUZZY = SETS.split("nb AS")[0].rstrip().rstrip(",") + """, s AS (SELECT *, CAST((seq % 1000000) % 6 AS INTEGER) AS k, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS n, lead(key) OVER w AS after, lead(start_pts) OVER w AS nxt, lead(seq) OVER w IS NULL AS last FROM sets WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
f AS (SELECT file_id, n, key AS a, k AS ak, CASE WHEN key IS NULL THEN 0 ELSE 1 END AS idx, CASE WHEN key IS NULL THEN 'clear' ELSE 'open' END AS kind FROM s WHERE n = 1
  UNION ALL SELECT s.file_id, s.n, s.key, CASE WHEN s.key = f.a AND abs(s.k - f.ak) <= 2 THEN f.ak ELSE s.k END,
    f.idx + CASE WHEN s.key IS NULL OR (s.key = f.a AND abs(s.k - f.ak) <= 2) THEN 0 ELSE 1 END,
    CASE WHEN s.key IS NULL THEN 'clear' WHEN s.key = f.a AND s.k = f.ak THEN 'exact' WHEN s.key = f.a AND abs(s.k - f.ak) <= 2 THEN 'pixel' ELSE 'open' END
  FROM f JOIN s ON s.file_id = f.file_id AND s.n = f.n + 1),
g AS (SELECT f.file_id, f.idx, arg_min(s.seq, s.n) AS seq, arg_min(s.start_pts, s.n) AS start_pts, arg_min(coalesce(s.end_pts, 0), s.n) AS end_pts, arg_max(coalesce(s.after, ''), s.n) AS after, arg_max(coalesce(s.nxt, 0), s.n) AS nxt, arg_max(s.last, s.n) AS last,
    count(*) FILTER (WHERE kind = 'exact') AS exact, count(*) FILTER (WHERE kind = 'pixel') AS pixel FROM f JOIN s ON s.file_id = f.file_id AND s.n = f.n WHERE kind <> 'clear' GROUP BY f.file_id, f.idx)
SELECT file_id, CAST(idx AS BIGINT) AS idx, seq, start_pts // 90 AS start_ms,
  CASE WHEN last THEN CASE WHEN end_pts > 0 THEN end_pts // 90 ELSE start_pts // 90 + 5000 END WHEN after = '' THEN nxt // 90 ELSE end_pts // 90 END AS end_ms, exact, pixel FROM g"""


def drawn_sets(spark, d) -> DataFrame:
    """Events as raw display sets: pictures of 20 by 20 cells at a place for each type, of which k = 0 to 5 cells, by the
    event's id, are of another alpha. Two of them match (0.5 % of 400 cells) where k differs by 2 at most."""
    x = _sets(spark, d).withColumn("k", F.pmod(F.pmod("seq", F.lit(1000000)), F.lit(6)).cast("int"))
    run = lambda n, colour: F.concat(F.lit("00"), F.hex(n + 128), F.lit(colour))
    rle = F.unhex(F.concat(F.when(F.col("k") > 0, run(F.col("k"), "02")).otherwise(""), run(20 - F.col("k"), "01"), F.lit("0000" + "0094010000" * 19)))
    place = F.array_position(F.array(*[F.lit(t) for t in ("click", "view", "purchase", "signup", "error")]), F.col("key")).cast("int")
    objects = F.when(F.col("key").isNotNull(), F.array(F.struct(F.lit(0).alias("object_id"), F.lit(0).alias("x"), place.alias("y")))).otherwise(F.array())
    bitmaps = F.array(F.array(F.struct(F.lit(20).alias("w"), F.lit(20).alias("h"), rle.alias("rle"))))
    return x.select("file_id", "track", "seq", "start_pts", "end_pts", objects.alias("objects"), bitmaps.alias("bitmaps"), F.array(*[F.lit(v) for v in (0, 100 << 24, (200 << 24) - (1 << 32))]).cast("array<int>").alias("palette"))


@query("q_display_sets_fuzzy", _FUZZY.replace("WITH ev", "WITH RECURSIVE ev"))
def folded_fuzzy(spark, d):
    """The folding of the job, on pictures that differ by a few cells."""
    from . import pipeline

    return pipeline.intervals(drawn_sets(spark, d)).select("file_id", "idx", "seq", "start_ms", "end_ms", "exact", "pixel")


@query("q_display_statistics", SETS + """ SELECT s.file_id, s.track, s.visible, s.clear, s.visible - coalesce(r.runs, 0) AS merged_exact, CAST(0 AS BIGINT) AS merged_pixel, s.last_ms FROM
 (SELECT file_id, track, count(*) FILTER (WHERE key IS NOT NULL) AS visible, count(*) FILTER (WHERE key IS NULL) AS clear, arg_max(start_pts, seq) // 90 AS last_ms FROM sets GROUP BY ALL) s
 LEFT JOIN (SELECT file_id, track, count(*) AS runs FROM runs GROUP BY ALL) r USING (file_id, track)""")
def set_statistics(spark, d):
    x = _sets(spark, d)
    return ds.statistics(x, ds.fold_exact(x))


@query("q_picture_key", """SELECT event_id, event_type <> 'error' AS visible, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'alone:' || event_id ELSE '1:' || user_id || ':7:2:3:' || sha256(event_type) END AS key FROM events""")
def keys(spark, d):
    x = table(spark, d, "events")
    obj = F.array(F.struct(F.when(F.pmod("event_id", F.lit(5)) == 0, 2).otherwise(0).alias("object_id"), F.col("user_id").cast("int").alias("x"), F.lit(7).alias("y")))
    none = F.array().cast("array<struct<object_id:int,x:int,y:int>>")
    objects = F.when(F.col("event_type") == "error", none).otherwise(obj)
    bitmaps = F.array(F.array(F.struct(F.lit(2).alias("w"), F.lit(3).alias("h"), F.col("event_type").cast("binary").alias("rle"))))
    return x.select("event_id", ds.is_visible(objects, bitmaps).alias("visible"), ds.picture_key(objects, bitmaps, F.col("event_id")).alias("key"))


@query("q_alpha_match", """SELECT a.vec_id, len(list_filter(list_zip(a.embedding, b.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) > 0.3)) <= 64 * 0.05 AS match
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def alpha(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", ds.alpha_match(F.col("embedding"), F.col("other"), 0.3, 0.05).alias("match"))


# --- signals and rasters -------------------------------------------------------------------------------------------

LEVEL = "least(255, CAST(floor(value) AS INTEGER))"


def _levels(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.least(F.lit(255), F.floor("value").cast("int")).alias("v"))


OTSU = f"""WITH h AS (SELECT event_type, {LEVEL} AS v, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT event_type, v, sum(n) OVER w AS wb, sum(n * v) OVER w AS sb, sum(n) OVER p AS n, sum(n * v) OVER p AS s FROM h WINDOW w AS (PARTITION BY event_type ORDER BY v), p AS (PARTITION BY event_type)),
m AS (SELECT event_type, v, CAST(wb AS DOUBLE) * CAST(n - wb AS DOUBLE) * (CAST(sb AS DOUBLE) / wb - CAST(s - sb AS DOUBLE) / (n - wb)) * (CAST(sb AS DOUBLE) / wb - CAST(s - sb AS DOUBLE) / (n - wb)) AS b FROM c WHERE wb < n),
r AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY b DESC, v) AS k FROM m),
t AS (SELECT e.event_type, coalesce(r.v, 128) AS threshold FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN r ON r.event_type = e.event_type AND k = 1)"""


@query("q_otsu", OTSU + " SELECT event_type, CAST(threshold AS INTEGER) AS threshold FROM t")
def otsu(spark, d):
    return signals.otsu(_levels(spark, d), "event_type", "v")


@query("q_strong_threshold", OTSU + f""" SELECT event_type, CAST(threshold AS INTEGER) AS threshold, CAST(trunc(threshold + 0.80 * (m - threshold)) AS INTEGER) AS strong FROM
 (SELECT t.event_type, any_value(t.threshold) AS threshold, CAST(sum(x.v) FILTER (WHERE x.v >= t.threshold) AS DOUBLE) / count(*) FILTER (WHERE x.v >= t.threshold) AS m
  FROM t JOIN (SELECT event_type, {LEVEL} AS v FROM events) x USING (event_type) GROUP BY t.event_type)""")
def strong(spark, d):
    v = _levels(spark, d)
    return signals.strong_threshold(v, signals.otsu(v, "event_type", "v"), "event_type", "v")


@query("q_upper_median", "SELECT lang, n_chars AS median FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE k = n // 2 + 1")
def median(spark, d):
    return signals.upper_median_by(table(spark, d, "documents"), "lang", "n_chars")


def _signal(spark, d) -> DataFrame:
    """Embeddings as 64 levels, and as a mask (dark where under 100)."""
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.6) * 200).cast("int"))))
    e = table(spark, d, "embeddings").select("vec_id", level.alias("v"))
    return e.withColumn("m", F.transform("v", lambda x: x < 100))


@query("q_support", SIGNAL + " SELECT vec_id, CAST(len(list_filter(v, lambda x: abs(x - 120) > 20)) AS INTEGER) AS n FROM sig")
def supported(spark, d):
    return _signal(spark, d).select("vec_id", F.size(F.filter(signals.support(F.col("v"), F.lit(120), 20), lambda x: x)).alias("n"))


@query("q_bounds", SIGNAL + ", p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM sig) SELECT vec_id, CAST(min(i % 8) AS INTEGER) AS x0, CAST(min(i // 8) AS INTEGER) AS y0, CAST(max(i % 8) AS INTEGER) AS x1, CAST(max(i // 8) AS INTEGER) AS y1 FROM p WHERE x < 100 GROUP BY vec_id")
def bounds(spark, d):
    return _signal(spark, d).select("vec_id", signals.bounds(F.col("m"), 8).alias("b")).filter("b is not null").select("vec_id", "b.*")


@query("q_dilate", SIGNAL + ", p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sig), q AS (SELECT vec_id, i, max(CASE WHEN x < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p) SELECT vec_id, string_agg(CAST(m AS VARCHAR), '' ORDER BY i) AS mask FROM q GROUP BY vec_id")
def dilated(spark, d):
    return _signal(spark, d).select("vec_id", F.array_join(F.transform(signals.dilate(F.col("m"), 2), lambda x: x.cast("int").cast("string")), "").alias("mask"))


_K = signals.gaussian_weights()
_BLUR = " + ".join(f"v[greatest(1, least(64, i + {j - 2}))] * {w!r}::DOUBLE" for j, w in enumerate(_K))


@query("q_blur", SIGNAL + f", q AS (SELECT vec_id, i, CAST(floor(({_BLUR}) * 1000) AS BIGINT) AS b FROM sig, range(1, 65) r(i)) SELECT vec_id, CAST(sum(b * i) AS BIGINT) AS total FROM q GROUP BY vec_id")
def blurred(spark, d):
    b = F.transform(signals.blur(F.col("v")), lambda x, i: F.floor(x * 1000).cast("long") * (i + 1))
    return _signal(spark, d).select("vec_id", F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_RUNS = SIGNAL + """, p AS (SELECT vec_id, unnest(v) < 100 AS m, generate_subscripts(v, 1) - 1 AS i FROM sig),
u AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM p WHERE m),
spans AS (SELECT vec_id, min(i) AS a, max(i) + 1 AS b FROM u GROUP BY vec_id, k)"""


@query("q_column_runs", _RUNS + " SELECT vec_id, string_agg(a || '-' || b, ',' ORDER BY a) AS runs FROM spans GROUP BY vec_id")
def column_runs(spark, d):
    r = F.transform(signals.runs(F.col("m")), lambda x: F.concat_ws("-", x.start, x.end))
    return _signal(spark, d).select("vec_id", F.array_join(r, ",").alias("runs")).filter("runs <> ''")


@query("q_line_regions", _RUNS + """, gap AS (SELECT vec_id, greatest(2, CAST(trunc(max(b - a) * 0.15::DOUBLE) AS BIGINT)) AS gap FROM spans GROUP BY vec_id),
o AS (SELECT s.*, gap, CASE WHEN a - lag(b) OVER w < gap THEN 0 ELSE 1 END AS opens FROM spans s JOIN gap USING (vec_id) WINDOW w AS (PARTITION BY s.vec_id ORDER BY a)),
z AS (SELECT *, sum(opens) OVER (PARTITION BY vec_id ORDER BY a) AS k FROM o),
l AS (SELECT vec_id, min(a) AS a, CASE WHEN 64 - max(b) < any_value(gap) THEN 64 ELSE max(b) END AS b FROM z GROUP BY vec_id, k)
SELECT s.vec_id, coalesce(r, '0-64') AS lines FROM sig s LEFT JOIN (SELECT vec_id, string_agg(a || '-' || b, ',' ORDER BY a) AS r FROM l WHERE b - a >= 5 GROUP BY vec_id) USING (vec_id)""")
def line_regions(spark, d):
    r = F.transform(signals.line_regions(F.col("m")), lambda x: F.concat_ws("-", x.start, x.end))
    return _signal(spark, d).select("vec_id", F.array_join(r, ",").alias("lines"))


_ANGLES = [-10.0, -5.0, 0.0, 5.0, 10.0, 15.0, 20.0]
_PAD = int(math.tan(math.radians(20)) * 7) + 1


@query("q_shear_variance", SIGNAL + f""", p AS (SELECT vec_id, CASE WHEN unnest(v) < 128 THEN 255 ELSE 0 END AS x, generate_subscripts(v, 1) - 1 AS i FROM sig),
a AS (SELECT vec_id, angle, i % 8 + CAST(trunc(tan(radians(angle)) * (i // 8)) AS BIGINT) + {_PAD} AS col, sum(x) AS s FROM p, (SELECT unnest({_ANGLES}) AS angle) GROUP BY ALL)
SELECT vec_id, CAST(angle AS DOUBLE) AS angle, CAST({8 + 2 * _PAD} * sum(s * s) - sum(s) * sum(s) AS BIGINT) AS spread FROM a GROUP BY vec_id, angle""")
def shear(spark, d):
    """n * sum of squares - square of the sum, n * n times the variance, exact in whole numbers."""
    ink = F.transform("v", lambda x: F.when(x < 128, 255).otherwise(0))
    rows = [F.slice("ink", 8 * y + 1, 8) for y in range(8)]
    out = []
    for a in _ANGLES:
        sums = F.transform(signals.sheared_sums(rows, 8, a, _PAD), lambda x: x.cast("long"))
        sq = F.aggregate(sums, F.lit(0).cast("long"), lambda s, x: s + x * x)
        one = F.aggregate(sums, F.lit(0).cast("long"), lambda s, x: s + x)
        out.append(F.struct(F.lit(a).alias("angle"), ((8 + 2 * _PAD) * sq - one * one).alias("spread")))
    return _signal(spark, d).withColumn("ink", ink).select("vec_id", F.inline(F.array(*out)))


@query("q_height_bucket", "SELECT p_partkey, CASE WHEN p_size * 4 < 90 THEN 80 WHEN p_size * 4 < 140 THEN 96 ELSE 160 END AS height, CAST(greatest(6, round_even(p_size * 4 * 0.1::DOUBLE, 0)) AS INTEGER) AS margin, CAST(trunc(0.299::DOUBLE * p_size + 0.587::DOUBLE * (p_size * 2) + 0.114::DOUBLE * (p_size * 3)) AS INTEGER) AS luma FROM part")
def buckets(spark, d):
    h = F.col("p_size") * 4
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", scalars.height_bucket(h).alias("height"), scalars.margin(h).alias("margin"), scalars.luma(s, s * 2, s * 3).alias("luma"))


@query("q_rle_roundtrip", SIGNAL + ", p AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sig) SELECT vec_id, CAST(sum(CASE WHEN x < 100 THEN 0 ELSE x END * i) AS BIGINT) AS total FROM p GROUP BY vec_id")
def rle(spark, d):
    """Levels under 100 as colour 0, encoded and decoded as an 8 by 8 picture."""
    def run(batches):
        for b in batches:
            total = []
            for v in b["v"]:
                a = np.where(np.array(v) < 100, 0, v).astype(np.uint8).reshape(8, 8)
                total.append(int((raster.rle_decode(raster.rle_encode(a), 8, 8).ravel().astype(int) * np.arange(1, 65)).sum()))
            yield pd.DataFrame({"vec_id": b["vec_id"], "total": total})

    return _signal(spark, d).select("vec_id", "v").mapInPandas(run, "vec_id long, total long")


def picture_sets(spark: SparkSession, d: str) -> DataFrame:
    """Display sets drawn from embeddings: 64 columns of ink of various heights in one or two lines."""
    def drawn(v: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for levels, t in zip(v, two, strict=True):
            a = np.zeros((60 if t else 30, 200), dtype=np.uint8)
            for line in range(2 if t else 1):
                for i, x in enumerate(levels):
                    if x > 90:
                        a[5 + 30 * line : 5 + 30 * line + 8 + x // 20, 4 + 3 * i : 6 + 3 * i] = 1 + line
            out.append(raster.rle_encode(a))
        return pd.Series(out)

    @F.pandas_udf("binary")
    def draw(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, two in batches:
            for at in range(0, len(v), ROWS):
                yield drawn(v[at : at + ROWS], two[at : at + ROWS])
            del v, two
            give_back()

    e = _signal(spark, d).withColumn("two", F.pmod("vec_id", F.lit(2)) == 0)
    bitmap = F.struct(F.lit(200).alias("w"), F.when(F.col("two"), 60).otherwise(30).alias("h"), draw("v", "two").alias("rle"))
    objects = F.array(F.struct(F.lit(0).alias("object_id"), F.lit(10).alias("x"), F.lit(20).alias("y")))
    palette = F.array(F.lit(0), F.lit(-1), F.lit(-986896)).cast("array<int>")
    file = F.concat(F.lit("f"), F.pmod("vec_id", F.lit(7)).cast("string"))
    return e.select(
        file.alias("file_id"), F.lit(1).alias("track"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 180000).alias("start_pts"), (F.col("vec_id") * 180000 + 90000).alias("end_pts"),
        objects.alias("objects"), F.array(F.array(bitmap)).alias("bitmaps"), palette.alias("palette"),
    )


@query("q_line_images")
def line_images(spark, d):
    """Decoded, cleaned, scaled and split pictures (numpy; the parts are held against plain loops in tests)."""
    from . import pipeline

    lines = raster.line_images(pipeline.intervals(stored(picture_sets(spark, d))))
    return lines.select("file_id", "idx", "line_no", "y0", "y1", "w", "h", F.sha2("png", 256).alias("sha"))


def reader() -> recognise.LookupRecognizer:
    """Stands in for a model: reads a picture's hash, sometimes with little confidence."""
    class Reader(recognise.LookupRecognizer):
        def recognize(self, png):
            k = self.key(png)
            return ("" if k[0] == "0" else f"♪ Word {k[1:5]}.Then ♪"), 0.9 if k[0] < "4" else 0.99

        def fallback(self, png, prompt):
            return f"BOB: line {self.key(png)[:4]}"

        def classify(self, tokens, png, reference, prompt):
            import json

            return "ok " + json.dumps({"classification": ["I" if i % 3 else "R" for i in range(len(tokens))]})

    return Reader({})


@query("q_subtitles")
def subtitles(spark, d):
    """Display sets to entries through the whole cascade, with a stand-in for the models."""
    from . import pipeline

    return pipeline.entries(stored(picture_sets(spark, d)), reader).select("file_id", "idx", "start_ms", "end_ms", "text", F.size("vlm_lines").alias("lines"))


@query("q_track_subtitles", f"""{BASE}, l AS (SELECT file_id, doc_id * 100000 + line_no // 2 AS idx, line_no, {mid('en', 'text')} AS t FROM dec),
e AS (SELECT file_id, idx, idx * 40 AS start_ms, idx * 40 + 1500 AS end_ms, string_agg(t, chr(10) ORDER BY line_no) AS text FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n FROM e WHERE {trim('text')} <> '')
SELECT file_id, n, {_clock('start_ms')} AS start, text FROM k""")
def track_subtitles(spark, d):
    """The flagship: decorated lines, normalised, joined to entries, numbered and timed."""
    x = corpus.lines(spark, d).withColumn("text", text_rules.mid_process(F.col("text"), "en"))
    n = srt.numbered(corpus.entries(x))
    return n.select("file_id", F.col("n").cast("long").alias("n"), scalars.srt_time(F.col("start_ms")).alias("start"), "text")


