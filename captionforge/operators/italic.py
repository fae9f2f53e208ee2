"""Growing italic spans over neighbouring punctuation, and the whole post-processing of a classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.text_rules import sub

#: A punctuation token that an italic token, or one just taken in, stands before, and no roman word after.
TAKEN = r"(?:(?<=I)|(?!\A)\G)P(?!W)"


def kinds(cls: Column, toks: Column) -> Column:
    """A letter for each token: I italic, W roman with a letter or digit, P other roman of ASCII signs, S any other."""
    def kind(c: Column, i: Column) -> Column:
        t = F.get(toks, i)
        return F.when(tk.is_italic(c), "I").when(tk.has_letter(t), "W").when(tk.is_ascii_punct(t), "P").otherwise("S")

    return F.array_join(F.transform(cls, kind), "")


def expand_boundaries(cls: Column, toks: Column) -> Column:
    """Italic spans take in the ASCII punctuation on either side, but for a token that touches a roman word beyond it.

    A regular expression over the tokens' kinds, in both directions: what is taken forward and what is taken backward
    don't depend on each other."""
    forward = sub(kinds(cls, toks), TAKEN, "I")
    both = F.reverse(sub(F.reverse(forward), TAKEN, "I"))
    now = lambda k: F.transform(cls, lambda c, i: F.when((F.get(k, i) == "I") & ~F.coalesce(tk.is_italic(c), F.lit(False)), F.lit("I")).otherwise(c))
    return tk.let(F.split(both, ""), now)


def post_process(cls: Column, toks: Column) -> Column:
    """Bridge, grow, promote."""
    return tk.promote_nearly_all(expand_boundaries(tk.bridge_punctuation(cls, toks), toks), toks)
