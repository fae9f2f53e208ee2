"""Per-line text normalisers: Column -> Column, each a chain of regexp_replace.

Patterns are Java's. WS is white space in the Unicode sense, SYM a character beyond ASCII that is neither letter nor
digit, LD a letter or digit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x{85}]"
SYM = r"[^\x00-\x7F\p{L}\p{Nd}]"
LD = r"[\p{L}\p{Nd}]"
WORD_CHAR = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"

# SYM with a bracket: one negated class is looked up faster than a class within a class
_CLOSES = r"[^\x00-\x5C\x5E-\x7F\p{L}\p{Nd}]"
_OPENS = r"[^\x00-\x5A\x5C-\x7F\p{L}\p{Nd}]"

#: All characters that WS matches.
SPACES = "\t\n\x0b\f\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

Step = Callable[[Column], Column]


def sub(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(replacement))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it within other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where(c: Column, signs: Sequence[str], body: Callable[[Column], Column]) -> Column:
    """body(c) for texts with one of the signs, which are looked for as bytes; others stay as they are."""
    return let(c, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in signs]), body(t)).otherwise(t))


def trim(c: Column) -> Column:
    """Removes white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^\s\p{{Z}}\x{{85}}]")


def strip_italic_tags(c: Column) -> Column:
    return trim(where(c, ["<"], lambda t: sub(t, r"(?i)</?i>", "")))


def normalize_apostrophes(c: Column) -> Column:
    """Curly to straight; then `don ' t`, `they ' ve` and `comin ' for` lose their gaps."""
    def closed(c: Column) -> Column:
        c = sub(c, rf"({WORD_CHAR}) ' (s|t|m|d)(?!{WORD_CHAR})", "$1'$2")
        c = sub(c, rf"({WORD_CHAR}) ' (ll|ve|re)(?!{WORD_CHAR})", "$1'$2")
        return sub(c, rf"(?d)({WORD_CHAR}) '(?={WS}|[,;:!?.]|$)", "$1'")

    straight = F.replace(F.replace(c, F.lit("‘"), F.lit("'")), F.lit("’"), F.lit("'"))
    return where(straight, [" '"], closed)


def fix_missing_word_breaks(c: Column) -> Column:
    return sub(c, r"[a-z](?=[A-Z])", "$0 ")


def normalize_spacing(c: Column) -> Column:
    """A space around bracketed terms and symbols, but none between a dash and what it introduces.

    Both sides in one pass: what has got a space after it needs none before what follows. Texts of ASCII signs without
    brackets have neither terms nor symbols."""
    spaced = lambda t: sub(t, rf"{_CLOSES}(?=[^ ])|[^ \-](?={_OPENS})", "$0 ")
    plain = lambda t: (F.octet_length(t) == F.length(t)) & ~F.contains(t, F.lit("[")) & ~F.contains(t, F.lit("]"))
    return trim(let(c, lambda t: F.when(plain(t), t).otherwise(spaced(t))))


def normalize_unicode_ellipsis(c: Column) -> Column:
    return where(c, ["…"], lambda t: sub(t, rf"{WS}*…{WS}*", "..."))


def fix_dot_spacing(c: Column) -> Column:
    return sub(c, rf"\.(?:(?<![.\p{{Nd}}]\.)(?!{WS}|[.]|\z)|(?<=\p{{Nd}}\.)(?!{WS}|[\p{{Nd}}.]|\z))", ". ")


def collapse_space_after_leading_ellipsis(c: Column) -> Column:
    return where(c, ["... "], lambda t: sub(t, r"(?:\A|(?<=\] ))\.\.\. +", "..."))


def fix_quote_spacing(c: Column) -> Column:
    def closed(c: Column) -> Column:
        c = sub(c, rf'(?d){WS}+(["”]){WS}*$', "$1")
        c = sub(c, rf'\A{WS}*(["“]){WS}+', "$1")
        c = sub(c, rf"{WS}+(”)", "$1")
        return sub(c, rf"(“){WS}+", "$1")

    return where(c, ['"', "“", "”"], closed)


#: T1 to T8 in the order in which English runs them.
STEPS: dict[str, Step] = {
    "t1": strip_italic_tags,
    "t2": normalize_apostrophes,
    "t3": fix_missing_word_breaks,
    "t4": normalize_spacing,
    "t5": normalize_unicode_ellipsis,
    "t6": fix_dot_spacing,
    "t7": collapse_space_after_leading_ellipsis,
    "t8": fix_quote_spacing,
}
BY_LANGUAGE = {"en": tuple(STEPS), "ja": ("t1", "t4", "t5")}


def mid_process(c: Column, language: str = "en") -> Column:
    """All steps of a language. Aliases (eng, jpn) mean their language; any other language has the English steps."""
    from .lang import canonical

    for name in BY_LANGUAGE.get(canonical(language), BY_LANGUAGE["en"]):
        c = STEPS[name](c)
    return c
