"""SQL for DuckDB (regular expressions of RE2: no look-around) for the queries over the decorated corpus and others."""

from __future__ import annotations

from . import corpus

WS = r"[\s\pZ\x{85}]"
SYM = r"[^\x00-\x7F\p{L}\p{Nd}]"
LD = r"[\p{L}\p{Nd}]"
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
GLYPHS = "♭♬♪♩♫"
G = f"[{GLYPHS}]"
TEXT = rf"[^\s\pZ\x{{85}}{GLYPHS}]"
SPEAKER = r"\p{Lu}[\p{Lu}\p{Nd}]*"
_PUNCT = r"[!-/:-@\[-`{-~\x00-\x08\x0E-\x1F\x7F]"
_PUNCT_NOT_OPEN = r"[!-/:-@\\-`{-~\x00-\x08\x0E-\x1F\x7F]"
_CJK = r"[぀-ヿ一-鿿㐀-䶿豈-﫿＀-￯]"
#: Tokens; an apostrophe inside a word is written as parts joined by single apostrophes.
TOK = (
    rf"\[[^\]]*\]|[^\x00-\x7F\p{{L}}\p{{Nd}}\pZ\x{{85}}]{SYM}*|{_CJK}|{_PUNCT}{_PUNCT_NOT_OPEN}*|{LD}+(?:'{LD}+)*"
).replace("'", "''")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(replacement)}, 'g')"


def trim(c: str) -> str:
    return rx(c, f"^{WS}+|{WS}+$", "")


def _twice(c: str, pattern: str, replacement: str) -> str:
    """For matches that may share a character."""
    return rx(rx(c, pattern, replacement), pattern, replacement)


def step(name: str, c: str) -> str:
    """One of the rules t1 to t8 on an expression."""
    if name == "t1":
        return trim(rx(c, "(?i)</?i>", ""))
    if name == "t2":
        c = f"translate({c}, '‘’', '''''')"
        for ends in ("s|t|m|d", "ll|ve|re"):
            c = rx(c, rf"({WORD}) ' ({ends})({WS}|[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]|$)", r"\1'\2\3")
        return rx(c, rf"({WORD}) '({WS}|[,;:!?.]|$)", r"\1'\2")
    if name == "t3":
        return rx(c, "([a-z])([A-Z])", r"\1 \2")
    if name == "t4":
        c = _twice(c, rf"(\]|{SYM})([^ ])", r"\1 \2")
        return trim(_twice(c, rf"([^ \-])(\[|{SYM})", r"\1 \2"))
    if name == "t5":
        return rx(c, f"{WS}*…{WS}*", "...")
    if name == "t6":
        c = _twice(c, r"(^|[^.\p{Nd}])\.([^\s\pZ\x{85}.])", r"\1. \2")
        return _twice(c, r"(\p{Nd})\.([^\p{Nd}\s\pZ\x{85}.])", r"\1. \2")
    if name == "t7":
        return rx(rx(c, r"^\.\.\. +", "..."), r"(\] )\.\.\. +", r"\1...")
    if name == "t8":
        c = rx(c, rf'{WS}+(["”]){WS}*$', r"\1")
        c = rx(c, rf'^{WS}*(["“]){WS}+', r"\1")
        return rx(rx(c, f"{WS}+(”)", r"\1"), f"(“){WS}+", r"\1")
    raise KeyError(name)


def mid(language: str, c: str) -> str:
    for name in ("t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8") if language == "en" else ("t1", "t4", "t5"):
        c = step(name, c)
    return c


def _decorated() -> str:
    def made(form: str) -> str:
        before, after = form.split("L")
        return f"{q(before)} || raw || {q(after)}"

    cases = ""
    for i, form in enumerate(corpus.PATTERNS):
        one = f"CASE WHEN no % 2 = 1 THEN {made(corpus.TIGHT[i])} ELSE {made(form)} END" if i in corpus.TIGHT else made(form)
        cases += f" WHEN {i} THEN {one}"
    return f"""WITH src AS (SELECT doc_id, source AS file_id, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) AS no, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, file_id, no, unnest(ls) AS raw, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no FROM src),
pat AS (SELECT *, CAST((doc_id * 31 + line_no) % 16 AS INTEGER) AS pattern FROM raw),
form AS (SELECT *, CASE pattern{cases} END AS t FROM pat),
dec AS (SELECT file_id, doc_id, line_no, raw, pattern, CASE WHEN no % 5 = 0 AND line_no % 2 = 0 THEN translate(t, '♪', '♫') ELSE t END AS text FROM form)"""


BASE = _decorated()
ENTRIES = f"""{BASE},
ent AS (SELECT file_id, doc_id * 100000 + line_no // 2 AS idx, (doc_id * 100000 + line_no // 2) * 40 AS start_ms, (doc_id * 100000 + line_no // 2) * 40 + 1500 AS end_ms,
  string_agg(text, chr(10) ORDER BY line_no) AS text, list(pattern = 5 ORDER BY line_no) AS vlm_lines FROM dec GROUP BY file_id, idx)"""


def line_query(columns: str) -> str:
    return f"{BASE} SELECT doc_id, line_no, {columns} FROM dec"


# --- rules over files ----------------------------------------------------------------------------------------------

_TAGLESS = "regexp_replace({c}, '<[^>]+>', '', 'g')"


def _lines(src: str, name: str) -> str:
    """Lines of entries with inside and outside italics, lead, tail and flags."""
    inside = "regexp_replace(array_to_string(regexp_extract_all(mk, '\\x01[^\\x02]*'), ''), '[\\x01\\x02]', '', 'g')"
    outside = "regexp_replace(regexp_replace(mk, '\\x01[^\\x02]*(\\x02|$)', '', 'g'), '[\\x01\\x02]', '', 'g')"
    tagless = _TAGLESS.format(c="line")
    return f"""{name}_l AS (SELECT file_id, idx, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, vlm_lines FROM {src}),
{name}_m AS (SELECT *, regexp_replace(replace(replace(line, '<i>', chr(1)), '</i>', chr(2)), '<[^>]*>', '', 'g') AS mk FROM {name}_l),
{name}_p AS (SELECT *, {inside} AS ins, {outside} AS outs, {tagless} AS bare FROM {name}_m),
{name}_f AS (SELECT *, regexp_matches(line, '{G}') AS gl, regexp_matches(ins, '{TEXT}') AS ti, regexp_matches(outs, '{TEXT}') AS tx, regexp_matches(ins, '{G}') AS gi, regexp_matches(outs, '{G}') AS go,
  regexp_matches(line, '^(?:<[^>]*>|{WS}|{SPEAKER}:)*{G}') AS lead, regexp_matches(line, '{G}(?:<[^<]*>|{WS})*$') AS tail FROM {name}_p)"""


def _inside() -> str:
    prefix = f"regexp_extract(bare, '^{WS}*{SPEAKER}: *')"
    return f"{prefix} || '<i>' || substr(bare, length({prefix}) + 1) || '</i>'"


def _outside() -> str:
    prefix = f"regexp_extract(bare, '^{WS}*{SPEAKER}: *')"
    rest = f"substr(bare, length({prefix}) + 1)"
    lead = f"regexp_extract({rest}, '^[{GLYPHS} \\-]*')"
    body = f"substr({rest}, length({lead}) + 1)"
    tail = f"regexp_extract({body}, '[{GLYPHS} ]*$')"
    core = f"substr({body}, 1, length({body}) - length({tail}))"
    return f"CASE WHEN {core} = '' THEN line ELSE {prefix} || {lead} || '<i>' || {core} || '</i>' || {tail} END"


def f1(src: str, name: str) -> str:
    n = ", ".join(f"sum(length(line) - length(replace(line, '{x}', ''))) AS n{i}" for i, x in enumerate(GLYPHS))
    total = " + ".join(f"n{i}" for i in range(len(GLYPHS)))
    pick = " ".join(f"WHEN n{i} > ({total}) * 0.60 THEN translate(text, '{GLYPHS}', '{x * len(GLYPHS)}')" for i, x in enumerate(GLYPHS))
    return f"""{name}_l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, unnest(vlm_lines) AS vlm FROM {src}),
{name}_v AS (SELECT file_id, {n} FROM {name}_l WHERE NOT coalesce(vlm, false) AND line IS NOT NULL GROUP BY file_id),
{name}_out AS (SELECT e.* REPLACE (CASE {pick} ELSE text END AS text) FROM {src} e LEFT JOIN {name}_v USING (file_id))"""


def f2(src: str, name: str) -> str:
    ok = f"NOT regexp_matches({_TAGLESS.format(c='line')}, '{TEXT}{G}|{G}{TEXT}')"
    add = rx(rx(rx("text", rf"({G})([^ \n<{GLYPHS}])", r"\1 \2"), rf"([^ \n{GLYPHS}>\-])({G})", r"\1 \2"), rf"(</[^>]+>)[^\S\n]*({G})", r"\1 \2")
    drop = rx(rx("text", rf"({G})[^\S\n]+", r"\1"), rf"[^\S\n]+({G})", r"\1")
    return f"""{name}_l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line FROM {src}),
{name}_v AS (SELECT file_id, count(*) FILTER (WHERE {ok}) AS a, count(*) FILTER (WHERE NOT ({ok})) AS b FROM {name}_l WHERE regexp_matches(line, '{G}') GROUP BY file_id),
{name}_out AS (SELECT e.* REPLACE (CASE WHEN NOT regexp_matches(text, '{G}') OR a IS NULL THEN text WHEN a > b AND b > 0 THEN {add} WHEN a <= b AND a > 0 THEN {drop} ELSE text END AS text) FROM {src} e LEFT JOIN {name}_v USING (file_id))"""


def _rewritten(src: str, name: str, line: str, when: str) -> str:
    return f"""{name}_w AS (SELECT file_id, idx, string_agg({line}, chr(10) ORDER BY k) AS t FROM {name}_g JOIN {name}_v USING (file_id) GROUP BY file_id, idx),
{name}_out AS (SELECT e.* REPLACE (CASE WHEN {when} AND regexp_matches(text, '{G}') THEN t ELSE text END AS text) FROM {src} e LEFT JOIN {name}_v USING (file_id) LEFT JOIN {name}_w USING (file_id, idx))"""


def f3(src: str, name: str) -> str:
    inside, outside = "gl AND ti AND NOT tx AND gi AND NOT go", "gl AND ti AND NOT tx AND go AND NOT gi"
    line = f"CASE WHEN {outside} AND a >= b THEN {_inside()} WHEN {inside} AND a < b THEN {_outside()} ELSE line END"
    return f"""{_lines(src, name)}, {name}_g AS (SELECT * FROM {name}_f),
{name}_v AS (SELECT file_id, count(*) FILTER (WHERE {inside}) AS a, count(*) FILTER (WHERE {outside}) AS b FROM {name}_g GROUP BY file_id),
{_rewritten(src, name, line, 'a > 0 AND b > 0')}"""


def f4(src: str, name: str) -> str:
    line = f"CASE WHEN kind > 0 AND NOT ital AND a >= b THEN (CASE WHEN c > d THEN {_inside()} ELSE {_outside()} END) WHEN kind > 0 AND ital AND a < b THEN regexp_replace(line, '(?i)</?i>', '', 'g') ELSE line END"
    return f"""{_lines(src, name)},
{name}_o AS (SELECT *, CASE WHEN ti AND NOT tx THEN true WHEN tx AND NOT ti THEN false END AS it, coalesce(lead AND NOT tail AND NOT (lead(lead) OVER w) AND (lead(tail) OVER w), false) AS opens FROM {name}_f WINDOW w AS (PARTITION BY file_id, idx ORDER BY k)),
{name}_r AS (SELECT *, CASE WHEN lead AND tail THEN 1 WHEN opens THEN 2 WHEN coalesce(lag(opens) OVER w, false) THEN 3 ELSE 0 END AS kind, lead(it) OVER w AS after, lag(it) OVER w AS before FROM {name}_o WINDOW w AS (PARTITION BY file_id, idx ORDER BY k)),
{name}_g AS (SELECT *, CASE WHEN kind = 1 THEN it WHEN kind = 2 AND it = after THEN it WHEN kind = 3 AND it = before THEN it END AS ital FROM {name}_r),
{name}_v AS (SELECT file_id, count(*) FILTER (WHERE kind IN (1, 2) AND ital) AS a, count(*) FILTER (WHERE kind IN (1, 2) AND NOT ital) AS b,
  count(*) FILTER (WHERE kind IN (1, 2) AND ital AND gi AND NOT go) AS c, count(*) FILTER (WHERE kind IN (1, 2) AND ital AND go AND NOT gi) AS d FROM {name}_g GROUP BY file_id),
{_rewritten(src, name, line, 'a > 0 AND b > 0')}"""


def f5(src: str, name: str) -> str:
    return f"{name}_out AS (SELECT * REPLACE ({rx('text', r'</i>(' + chr(10) + r'| *[・]+ *)<i>', chr(92) + '1')} AS text) FROM {src})"


def chain(src: str) -> str:
    out = []
    for name, f in (("f1", f1), ("f2", f2), ("f3", f3), ("f4", f4), ("f5", f5)):
        out.append(f(src, name))
        src = f"{name}_out"
    return ", ".join(out)


# --- others --------------------------------------------------------------------------------------------------------

SETS = """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(1 AS BIGINT) AS track, epoch_us(ts) // 1000 AS ms, event_id, event_type FROM events),
sets AS (SELECT file_id, track, ms * 1000000 + event_id AS seq, ms * 90 AS start_pts, lead(ms * 90) OVER (PARTITION BY file_id ORDER BY ms * 1000000 + event_id) AS end_pts, CASE WHEN event_type <> 'error' THEN event_type END AS key FROM ev),
nb AS (SELECT *, lag(key) OVER w AS before, lead(key) OVER w AS after, lead(start_pts) OVER w AS nxt, lead(seq) OVER w IS NULL AS last FROM sets WINDOW w AS (PARTITION BY file_id, track ORDER BY seq)),
gr AS (SELECT *, sum(CASE WHEN key IS NOT NULL AND (before IS NULL OR before <> key) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, track ORDER BY seq) AS run FROM nb),
ag AS (SELECT file_id, track, run, arg_min(seq, seq) AS seq, arg_min(start_pts, seq) AS start_pts, arg_min(coalesce(end_pts, 0), seq) AS end_pts, arg_max(coalesce(after, ''), seq) AS after, arg_max(coalesce(nxt, 0), seq) AS nxt, arg_max(last, seq) AS last, count(*) AS n FROM gr WHERE key IS NOT NULL GROUP BY ALL),
runs AS (SELECT file_id, track, CAST(run AS BIGINT) AS idx, seq, start_pts // 90 AS start_ms,
  CASE WHEN last THEN CASE WHEN end_pts > 0 THEN end_pts // 90 ELSE start_pts // 90 + 5000 END WHEN after = '' THEN nxt // 90 ELSE end_pts // 90 END AS end_ms, n FROM ag)"""

SIGNAL = """WITH sig AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 0.6::DOUBLE) * 200) AS INTEGER)))) AS v FROM embeddings)"""
