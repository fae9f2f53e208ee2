"""Tokens of a line, leading tags, and the classification of tokens as italic (I) or roman (R)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_rules import LD, SPACES, SYM, WS, is_blank, let, sub

# The ranges of characters that are tokens by themselves.
CJK = r"[぀-ヿ一-鿿㐀-䶿豈-﫿＀-￯]"
PUNCT = r"\x00-\x08\x0E-\x1F!-/:-@\\-`{-~\x7F"  # of ASCII, but for [
_WORD = r"[A-Za-z0-9\p{L}\p{Nd}]"
# Most tokens begin as the first form says; none gives back what it took.
TOKEN = (
    rf"[A-Za-z0-9][a-z]*+{_WORD}*+(?:'{_WORD}++)*+|\[[^\]]*\]|[^\x00-\x7F\p{{L}}\p{{Nd}}\p{{Z}}\x{{85}}]{SYM}*+|{CJK}"
    rf"|[{PUNCT}\[][{PUNCT}]*+|{_WORD}++(?:'{_WORD}++)*+"
)
# Fixed value: a leading speaker tag.
LEADING_TAG = (
    r"\A(?:-+\s*)?(?:(?:\[[^\]]*\]\s*)+(?:[A-Z][A-Z0-9]*:\s*)?(?:\[[^\]]*\]\s*)*"
    r"|(?:[A-Z][A-Z0-9]*:\s*)(?:\[[^\]]*\]\s*)*)"
)
#: A recogniser's answer.
ANSWER = T.StructType([T.StructField("classification", T.ArrayType(T.StringType()))])


def tokens(text: Column) -> Column:
    """array<string>. Spaces are taken with the token after them, as no form has then to be tried at a space."""
    return F.regexp_extract_all(text, F.lit(f" *+({TOKEN})"), F.lit(1))


def has_token(text: Column) -> Column:
    """Is there a token? Whatever isn't white space begins one, so no pattern is needed."""
    return F.ltrim(text, F.lit(SPACES)) != ""


def spans(text: Column) -> Column:
    """array<string>: tokens, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(rf"{WS}*+(?:{TOKEN})"), F.lit(0))


def ends(ps: Column) -> Column:
    """array<int>: where each of some strings ends when they are joined.

    Strings of a block (32, or the root of their number) become runs of x with bars between, which are counted as bytes;
    the blocks before are summed. Work grows as the power 1.5 from 1,024 strings on. No array is sliced for each string,
    and lambdas give little, as Spark copies whatever a lambda gives."""
    n = F.size(ps)

    def placed(bs: Column, width: Column) -> Column:
        early = lambda k: F.aggregate(F.slice(bs, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x) + 1) - k * width
        block = lambda b, k, at: F.transform(F.sequence(F.lit(0), F.least(width, n - k * width) - 1), lambda i: at + F.length(F.call_function("substring_index", b, F.lit("|"), i + 1)) - i)
        return F.flatten(F.transform(bs, lambda b, k: let(early(k), lambda at: block(b, k, at))))

    def whole(width: Column) -> Column:
        runs = F.transform(ps, lambda p: F.repeat(F.lit("x"), F.length(p)))
        firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1, width)).when(ps.isNotNull(), F.array().cast("array<int>"))
        return let(let(runs, lambda rs: F.transform(firsts, lambda i: F.array_join(F.slice(rs, i + 1, width), "|"))), lambda bs: placed(bs, width))

    return let(F.greatest(F.lit(32), F.ceil(F.sqrt(n)).cast("int")), whole)


def with_starts(text: Column) -> Column:
    """array<struct<text, start>>: tokens with the positions at which they begin (code points, from 0)."""
    def placed(ps: Column) -> Column:
        toks = F.transform(ps, lambda p: F.ltrim(p, F.lit(SPACES)))
        return F.zip_with(toks, ends(ps), lambda t, end: F.struct(t.alias("text"), (end - F.length(t)).alias("start")))

    return let(spans(text), placed)


def is_bracketed(t: Column) -> Column:
    return t.startswith("[") & t.endswith("]") & (F.length(t) > 1)


def has_letter(t: Column) -> Column:
    return t.rlike(LD)


def is_ascii_punct(t: Column) -> Column:
    return t.rlike(r"\A[\x00-/:-@\[-`{-\x7F]+\z")


def needs_no_italics(toks: Column) -> Column:
    """No tokens, or every token with a letter is bracketed."""
    return F.forall(toks, lambda t: ~has_letter(t) | is_bracketed(t))


def for_reference(text: Column) -> Column:
    """The text as it is rendered for comparison: dashes and symbols become two spaces; null if nothing is left."""
    c = sub(text, rf"\A-+{WS}*", "  ")
    c = sub(c, SYM, "  ")
    c = sub(c, r" {3,}", "  ")
    return F.when(~is_blank(c), c)


def leading_tag(text: Column) -> Column:
    """struct<length, body>: length of a leading speaker tag without the spaces after it, and where the body begins;
    both 0 if there is no tag or nothing after it."""
    m = F.regexp_extract(text, LEADING_TAG, 0)
    rest = F.substring(text, F.length(m) + 1, F.length(text))
    found = (m != "") & ~is_blank(rest)
    zero = F.lit(0)
    return F.struct(F.when(found, F.length(sub(m, r" +\z", ""))).otherwise(zero).alias("length"), F.when(found, F.length(m)).otherwise(zero).alias("body"))


def parse_answer(raw: Column) -> Column:
    """array<string> of the classification in the JSON object within an answer; null if there is none."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    lowered = sub(body, r'(?i)"classification"\s*:', '"classification":')
    return F.when(body != "", F.from_json(lowered, ANSWER)["classification"])


def usable_answer(raw: Column, toks: Column) -> Column:
    """The classification if it has an entry for every token, else null."""
    cls = parse_answer(raw)
    return F.when(F.size(cls) == F.size(toks), cls)


def is_italic(c: Column) -> Column:
    return c.isin("I", "i")


def bridge_punctuation(cls: Column, toks: Column) -> Column:
    """An inner token of ASCII punctuation, not all of it sentence ends, between two italic tokens becomes italic."""
    def at(c: Column, i: Column) -> Column:
        t = F.get(toks, i)
        inner = (i > 0) & (i < F.size(toks) - 1)
        ends = t.rlike(r"\A[.!?]*\z")
        both = F.coalesce(is_italic(F.get(cls, i - 1)), F.lit(False)) & F.coalesce(is_italic(F.get(cls, i + 1)), F.lit(False))
        return F.when(inner & ~is_italic(c) & is_ascii_punct(t) & ~ends & both, F.lit("I")).otherwise(c)

    return F.transform(cls, at)


def promote_nearly_all(cls: Column, toks: Column) -> Column:
    """If just one of two or more words outside brackets is roman, all tokens outside brackets become italic."""
    pairs = F.filter(F.arrays_zip(cls.alias("c"), toks.alias("t")), lambda x: has_letter(x.t) & ~is_bracketed(x.t))
    roman = F.size(F.filter(pairs, lambda x: ~is_italic(x.c)))
    all_italic = F.transform(cls, lambda c, i: F.when(is_bracketed(F.get(toks, i)), c).otherwise(F.lit("I")))
    return F.when((roman == 1) & (F.size(pairs) >= 2), all_italic).otherwise(cls)


def styled(text: Column, cls: Column) -> Column:
    """The text with italic runs in tags: space before a roman token is outside, between two italic ones inside."""
    no = F.lit(False)

    def tagged(ps: Column, on: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            before, now = F.coalesce(F.get(on, i - 1), no), F.coalesce(F.get(on, i), no)
            parted = lambda tag: let(F.ltrim(p, F.lit(SPACES)), lambda t: F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(t)), F.lit(tag), t))
            return F.when(before == now, p).when(now, parted("<i>")).otherwise(F.concat(F.lit("</i>"), p))

        used = F.length(F.array_join(ps, ""))
        end = F.when(F.coalesce(F.get(on, F.size(ps) - 1), no), "</i>").otherwise("")
        return F.concat(F.array_join(F.transform(ps, piece), ""), end, F.substring(text, used + 1, F.length(text)))

    return let(spans(text), lambda ps: let(F.transform(cls, lambda c: F.coalesce(is_italic(c), no)), lambda on: tagged(ps, on)))


def same_ignoring_space(a: Column, b: Column) -> Column:
    return F.lower(sub(a, WS, "")) == F.lower(sub(b, WS, ""))
