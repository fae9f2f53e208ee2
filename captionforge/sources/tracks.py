"""Subtitle tracks of a container: rows (file_id, pos, codec_id, language, track_number)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.lang import matches

CODEC = "S_HDMV/PGS"


class TrackError(ValueError):
    """A file without a usable track, or without the one that was asked for."""


def bitmap_tracks(tracks: DataFrame) -> DataFrame:
    """The bitmap subtitle tracks with at: their place among these, from 0."""
    w = W.partitionBy("file_id").orderBy("pos")
    return tracks.filter(F.col("codec_id") == CODEC).withColumn("at", F.row_number().over(w) - 1)


def choose(tracks: DataFrame, language: str = "en", track: int = -1) -> DataFrame:
    """One track per file that has one: number `track` among the bitmap tracks if not negative (files that don't have
    so many give none), else the first in the language (any alias, any case), else the first; matched tells which."""
    d = bitmap_tracks(tracks)
    if track >= 0:
        return d.filter(F.col("at") == track).withColumn("matched", F.lit(True)).select("file_id", "pos", "language", "track_number", "matched")
    hit = matches(F.col("language"), F.lit(language))
    best = F.min_by(F.struct("pos", "language", "track_number", hit.alias("matched")), F.struct((~hit).alias("miss"), F.col("at")))
    return d.groupBy("file_id").agg(best.alias("b")).select("file_id", "b.*")


def require(tracks: DataFrame, language: str = "en", track: int = -1) -> DataFrame:
    """As choose; raises TrackError if a file has no bitmap track or fewer than asked for (one small job)."""
    missing = tracks.select("file_id").distinct().join(choose(tracks, language, track).select("file_id"), "file_id", "left_anti").take(3)
    if missing:
        raise TrackError(f"no such bitmap subtitle track in {[r[0] for r in missing]}")
    return choose(tracks, language, track)
