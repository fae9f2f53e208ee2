"""File-level majority rules over subtitle entries: count per entry, vote per file, rewrite per entry.

Entries are rows (file_id, idx, text, vlm_lines array<boolean>, ...): lines of a text are parted by line feeds, and
vlm_lines tells which of them the fallback model read. Counts are made within a row with a glyph and summed with partial
aggregates; the vote table has one row per file, is stored, and is broadcast unless there are very many files, so a file
that holds a third of all rows is neither gathered nor sent to one task, and the entries are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import glyphs as g
from ..functions.text_rules import sub
from ..functions.tokens import let
from .storage import stored

Rule = Callable[[DataFrame], DataFrame]
#: Votes of up to so many files are broadcast; those of more are joined by Spark's own choice.
BROADCAST_FILES = 200_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _n(items: Column, keep: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.array_size(F.filter(items, keep)), F.lit(0)).cast("long")


def _votes(entries: DataFrame, items: Column, counts: dict[str, Column]) -> DataFrame:
    """The sums of counts over each file's entries; __x is items where an entry has a glyph, else null. No filter: it would
    be pushed below the rule before, and that rule's text would be made once more for each glyph looked for."""
    own = entries.select("file_id", F.when(g.has_glyph(F.col("text")), items).alias("__x"))
    return own.groupBy("file_id").agg(*[F.sum(c).alias(n) for n, c in counts.items()])


def _voted(entries: DataFrame, items: Column, counts: dict[str, Column]) -> DataFrame:
    """entries with the votes of their file (none: null or 0). What is stored are the votes, not the texts."""
    votes = stored(_votes(entries, items, counts).withColumnRenamed("file_id", "__file"))
    if votes.count() <= BROADCAST_FILES:
        votes = F.broadcast(votes)
    return entries.join(votes, F.col("file_id").eqNullSafe(F.col("__file")), "left").drop("__file")


def _back(voted: DataFrame, entries: DataFrame, text: Column) -> DataFrame:
    return voted.withColumn("text", text).select(*entries.columns)


def glyph_counts(entries: DataFrame) -> DataFrame:
    """file_id, glyph and n for every glyph that occurs on lines not read by the fallback model, most frequent first."""
    votes = _votes(entries, _own(), _glyph_columns())
    each = F.array(*[F.struct(F.lit(x).alias("glyph"), F.col(f"__n{i}").alias("n")) for i, x in enumerate(g.GLYPHS)])
    return votes.select("file_id", F.inline(each)).filter("n > 0").orderBy("file_id", F.desc("n"), "glyph")


def _own() -> Column:
    """The text without what the fallback model read."""
    own = F.filter(_lines(F.col("text")), lambda x, i: ~F.coalesce(F.get(F.col("vlm_lines"), i), F.lit(False)))
    return F.coalesce(F.array_join(own, ""), F.lit(""))


def _glyph_columns() -> dict[str, Column]:
    own = F.col("__x")
    return {f"__n{i}": (F.length(own) - F.length(F.replace(own, F.lit(x), F.lit("")))).cast("long") for i, x in enumerate(g.GLYPHS)}


def standardize_music_glyph(entries: DataFrame) -> DataFrame:
    """A glyph with over 60 % of a file's glyphs (fallback lines not counted) replaces the others everywhere."""
    v = _voted(entries, _own(), _glyph_columns())
    total = sum((F.col(f"__n{i}") for i in range(1, len(g.GLYPHS))), F.col("__n0"))
    text = F.col("text")
    pick = None
    for i, x in enumerate(g.GLYPHS):
        hit = F.col(f"__n{i}") > total * 0.60
        all_x = reduce(lambda t, y: F.replace(t, F.lit(y), F.lit(x)), [y for y in g.GLYPHS if y != x], text)
        pick = F.when(hit, all_x) if pick is None else pick.when(hit, all_x)
    return _back(v, entries, pick.otherwise(text))


def standardize_glyph_spacing(entries: DataFrame) -> DataFrame:
    """Spaces around glyphs are added if more of a file's glyph lines have them than not, else removed."""
    good = F.transform(F.filter(_lines(F.col("text")), g.has_glyph), g.spaced)
    v = _voted(entries, good, {"__with": _n(F.col("__x"), lambda x: x), "__without": _n(F.col("__x"), lambda x: ~x)})
    add = F.col("__with") > F.col("__without")
    uniform = F.when(add, F.col("__without") == 0).otherwise(F.col("__with") == 0)
    text = F.col("text")
    new = let(text, lambda t: F.when(add, g.add_spaces(t)).otherwise(g.remove_spaces(t)))
    return _back(v, entries, F.when(~uniform & g.has_glyph(text), new).otherwise(text))


def standardize_note_italics(entries: DataFrame) -> DataFrame:
    """On lines whose text is all italic, the glyphs go inside the italic span if at least as many have them inside."""
    lines = _lines(F.col("text"))
    tagged = lambda x: g.has_glyph(x) & F.contains(x, F.lit("<"))  # noqa: E731  (no others have italics)
    v = _voted(entries, F.transform(F.filter(lines, tagged), g.flags), {
        "__in": _n(F.col("__x"), lambda f: g.qualifies(f) & g.notes_inside(f)),
        "__out": _n(F.col("__x"), lambda f: g.qualifies(f) & g.notes_outside(f)),
    })
    inside = F.col("__in") >= F.col("__out")
    mixed = (F.col("__in") > 0) & (F.col("__out") > 0)

    def rewrite(x: Column) -> Column:
        move_in = g.qualifies(x.f) & g.notes_outside(x.f) & inside
        move_out = g.qualifies(x.f) & g.notes_inside(x.f) & ~inside
        return F.when(move_in, g.put_inside(x.line)).when(move_out, g.put_outside(x.line)).otherwise(x.line)

    flagged = F.transform(lines, lambda x: F.struct(x.alias("line"), F.when(tagged(x), g.flags(x)).alias("f")))
    new = F.array_join(F.transform(flagged, rewrite), "\n")
    return _back(v, entries, F.when(mixed & g.has_glyph(F.col("text")), new).otherwise(F.col("text")))


def _lyrics(text: Column) -> Column:
    """Per line: line, lead and tail, and f of lines with a glyph (no others are part of a block)."""
    return F.transform(_lines(text), lambda x: F.struct(
        x.alias("line"), F.when(g.has_glyph(x), g.flags(x)).alias("f"),
        (g.has_glyph(x) & g.leading_glyph(x)).alias("lead"), (g.has_glyph(x) & g.trailing_glyph(x)).alias("tail")))


def _opens(l: Column, i: Column) -> Column:
    x, y = F.get(l, i), F.get(l, i + 1)
    return F.coalesce(x.lead & ~x.tail & ~y.lead & y.tail, F.lit(False))


def _roles(l: Column) -> Column:
    """Per line: line, f, kind (0 none, 1 a block by itself, 2 first and 3 second of a pair) and ital of its block."""
    def role(x: Column, i: Column) -> Column:
        alone = x.lead & x.tail
        kind = F.when(alone, 1).when(_opens(l, i), 2).when((i > 0) & _opens(l, i - 1), 3).otherwise(0)
        one, other = g.lyric_italic(x.f), g.lyric_italic(F.get(l, F.when(kind == 2, i + 1).otherwise(i - 1)).f)
        ital = F.when(kind == 1, one).when((kind > 1) & (one == other), one)
        return F.struct(x.line.alias("line"), x.f.alias("f"), kind.alias("kind"), ital.alias("ital"))

    return F.transform(l, role)


def standardize_lyric_italics(entries: DataFrame) -> DataFrame:
    """Lyric blocks (a line between glyphs, or two lines) become italic if at least as many are as not, else roman.

    Blocks made italic get their glyphs inside the span if more italic blocks have them inside than outside."""
    roles = let(_lyrics(F.col("text")), _roles)
    block = lambda x: x.kind.isin(1, 2)
    yes = lambda x: F.coalesce(block(x) & x.ital, F.lit(False))
    v = _voted(entries, roles, {
        "__it": _n(F.col("__x"), yes),
        "__ro": _n(F.col("__x"), lambda x: F.coalesce(block(x) & ~x.ital, F.lit(False))),
        "__in": _n(F.col("__x"), lambda x: yes(x) & g.notes_inside(x.f)),
        "__out": _n(F.col("__x"), lambda x: yes(x) & g.notes_outside(x.f)),
    })
    italic, inside = F.col("__it") >= F.col("__ro"), F.col("__in") > F.col("__out")
    mixed = (F.col("__it") > 0) & (F.col("__ro") > 0)

    def rewrite(x: Column) -> Column:
        of_block = x.kind > 0
        add = F.coalesce(of_block & ~x.ital, F.lit(False)) & italic
        drop = F.coalesce(of_block & x.ital, F.lit(False)) & ~italic
        return F.when(add, F.when(inside, g.put_inside(x.line)).otherwise(g.put_outside(x.line))).when(drop, g.strip_italics(x.line)).otherwise(x.line)

    new = F.array_join(F.transform(roles, rewrite), "\n")
    return _back(v, entries, F.when(mixed & g.has_glyph(F.col("text")), new).otherwise(F.col("text")))


def merge_italic_spans(entries: DataFrame) -> DataFrame:
    """Italic spans parted by a line feed or middle dots alone become one."""
    return entries.withColumn("text", sub(F.col("text"), r"</i>(\n| *[・]+ *)<i>", "$1"))


RULES: dict[str, Rule] = {
    "f1": standardize_music_glyph,
    "f2": standardize_glyph_spacing,
    "f3": standardize_note_italics,
    "f4": standardize_lyric_italics,
    "f5": merge_italic_spans,
}


def post_process(entries: DataFrame, between: Rule | None = None, rules: Sequence[Rule] | None = None) -> DataFrame:
    """All rules in order. Each votes over what the one before wrote. The rules above store their votes, and make a text
    again when it is read; what other rules wrote `between` may store (one pass each)."""
    rules = list(RULES.values()) if rules is None else rules
    for i, rule in enumerate(rules):
        entries = rule(entries)
        if between and i < len(rules) - 1 and rule not in RULES.values():
            entries = between(entries)
    return entries
