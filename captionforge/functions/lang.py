"""Language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that mean the same language.
ALIASES = {"en": ("en", "eng"), "eng": ("en", "eng"), "ja": ("ja", "jpn"), "jpn": ("ja", "jpn")}


def canonical(code: str) -> str:
    return ALIASES.get(code.lower(), (code.lower(),))[0]


def aliases(code: Column) -> Column:
    """Array of the lower-case codes that match a wanted language; an unknown code matches itself."""
    low = F.lower(code)
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, low), F.array(low))


def matches(track_language: Column, wanted: Column) -> Column:
    """False for a track without a language."""
    return F.coalesce(F.array_contains(aliases(wanted), F.lower(track_language)), F.lit(False))
