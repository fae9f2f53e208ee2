"""Column helpers for music glyphs, italic tags and lyric lines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text_rules import WS, sub

# The music glyphs, in the order in which they are looked at.
GLYPHS = "♭♬♪♩♫"
G = f"[{GLYPHS}]"
TEXT = rf"[^\s\p{{Z}}\x{{85}}{GLYPHS}]"  # neither white space nor glyph
SPEAKER = r"\p{Lu}[\p{Lu}\p{Nd}]*"


def has_glyph(c: Column) -> Column:
    """Looks for bytes, which is much faster than a regular expression. c: a column, as it is read once per glyph."""
    return reduce(or_, [F.contains(c, F.lit(x)) for x in GLYPHS])


def strip_tags(c: Column) -> Column:
    return sub(c, r"<[^>]+>", "")


def strip_italics(c: Column) -> Column:
    return sub(c, r"(?i)</?i>", "")


def spaced(line: Column) -> Column:
    """Does every glyph of a line have white space, an edge or a glyph on both sides?"""
    near = rf"[^\s\p{{Z}}\x{{85}}{GLYPHS}]"
    return ~strip_tags(line).rlike(rf"{G}(?:(?<={near}{G})|(?={near}))")


def add_spaces(c: Column) -> Column:
    c = sub(c, rf"({G})(?=[^ \n<{GLYPHS}])", "$1 ")
    c = sub(c, rf"({G})(?<=[^ \n{GLYPHS}>\-]{G})", " $1")
    return sub(c, rf"(</[^>]+>)(?:(?!\n){WS})*({G})", "$1 $2")


def remove_spaces(c: Column) -> Column:
    c = sub(c, rf"({G})(?:(?!\n){WS})+", "$1")
    return sub(c, rf"(?:(?!\n){WS})++({G})", "$1")


def _no_other_tags(line: Column) -> Column:
    return sub(line, r"(?i)<(?!/?i>)[^>]*>", "")


def italic_part(line: Column) -> Column:
    """The characters of a line inside italic spans (an unclosed span reaches to the end)."""
    found = F.regexp_extract_all(_no_other_tags(line), F.lit(r"(?is)<i>(.*?)(?:</i>|\z)"), F.lit(1))
    return strip_italics(F.array_join(found, ""))


def roman_part(line: Column) -> Column:
    """The characters of a line outside italic spans."""
    return strip_italics(sub(_no_other_tags(line), r"(?is)<i>.*?(?:</i>|\z)", ""))


def flags(line: Column) -> Column:
    """struct: gl (has a glyph), ti and to (text inside and outside italics), gi and go (glyphs inside and outside)."""
    inside, outside = italic_part(line), roman_part(line)
    plain = F.struct(
        has_glyph(line).alias("gl"), F.lit(False).alias("ti"), line.rlike(TEXT).alias("to"), F.lit(False).alias("gi"), has_glyph(line).alias("go"),
    )
    return F.when(~F.contains(line, F.lit("<")), plain).otherwise(F.struct(
        has_glyph(line).alias("gl"), inside.rlike(TEXT).alias("ti"), outside.rlike(TEXT).alias("to"),
        inside.rlike(G).alias("gi"), outside.rlike(G).alias("go"),
    ))


def qualifies(f: Column) -> Column:
    """All text of a line with a glyph is italic, and there is some."""
    return f["gl"] & f["ti"] & ~f["to"]


def notes_inside(f: Column) -> Column:
    return f["gi"] & ~f["go"]


def notes_outside(f: Column) -> Column:
    return f["go"] & ~f["gi"]


def lyric_italic(f: Column) -> Column:
    """True: all text italic; false: none; null: both or no text."""
    return F.when(f["ti"] & ~f["to"], F.lit(True)).when(f["to"] & ~f["ti"], F.lit(False))


def leading_glyph(line: Column) -> Column:
    return line.rlike(rf"\A(?:<[^>]*>|{WS}|{SPEAKER}:)*+{G}")


def trailing_glyph(line: Column) -> Column:
    return line.rlike(rf"{G}(?:<[^<]*>|{WS})*\z")


def _speaker(s: Column) -> tuple[Column, Column]:
    prefix = F.regexp_extract(s, rf"(?s)\A{WS}*{SPEAKER}: *", 0)
    return prefix, F.substring(s, F.length(prefix) + 1, F.length(s))


def put_inside(line: Column) -> Column:
    """The whole line but its speaker in one italic span."""
    prefix, rest = _speaker(strip_tags(line))
    return F.concat(prefix, F.lit("<i>"), rest, F.lit("</i>"))


def put_outside(line: Column) -> Column:
    """The line's text in an italic span, its glyphs outside; a line of glyphs alone stays as it is."""
    prefix, rest = _speaker(strip_tags(line))
    lead = F.regexp_extract(rest, rf"\A[{GLYPHS} \-]*", 0)
    body = F.substring(rest, F.length(lead) + 1, F.length(rest))
    tail = F.regexp_extract(body, rf"[{GLYPHS} ]*\z", 0)
    core = F.substring(body, F.lit(1), F.length(body) - F.length(tail))
    return F.when(core == "", line).otherwise(F.concat(prefix, lead, F.lit("<i>"), core, F.lit("</i>"), tail))
