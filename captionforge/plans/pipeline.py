"""The whole job: display sets to subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import display_sets, file_rules, raster, recognise, srt
from ..operators.storage import stored
from ..sources import display_sets as sets_source
from ..sources import tracks as tracks_source
from .config import PipelineConfig


def intervals(sets: DataFrame) -> DataFrame:
    """The runs of the display sets with the pictures of their first set: file_id, track, seq, idx, start_ms, end_ms,
    objects, bitmaps and palette, and exact and pixel (sets absorbed). idx counts the runs of a track from 1.

    Tracks are folded by window functions over their keys; only those where a set comes near the one before it, which may
    match by its pixels, are read in order."""
    first = F.get("objects", F.lit(0))
    ods = F.get(F.get("bitmaps", first["object_id"]), F.lit(0))
    visible = display_sets.is_visible(F.col("objects"), F.col("bitmaps"))
    key = display_sets.picture_key(F.col("objects"), F.col("bitmaps"), F.col("seq"))
    keyed = stored(sets.select(
        "file_id", "track", "seq", "start_pts", "end_pts", key.alias("key"), visible.alias("visible"), F.size("objects").alias("n_objects"),
        first["x"].alias("x"), first["y"].alias("y"), ods["w"].alias("w"), ods["h"].alias("h")))
    near = stored(display_sets.near_tracks(keyed))
    exact = display_sets.fold_exact(keyed.join(near, ["file_id", "track"], "left_anti"))
    pictures = sets.join(near, ["file_id", "track"], "left_semi").select("file_id", "track", "seq", ods["rle"].alias("rle"), "palette")
    fuzzy = display_sets.fold_fuzzy(keyed.join(pictures, ["file_id", "track", "seq"]))
    same = ["file_id", "track", "seq", "idx", "start_ms", "end_ms"]
    runs = exact.select(*same, (F.col("n") - 1).alias("exact"), F.lit(0).cast("long").alias("pixel")).unionByName(fuzzy.select(*same, "exact", "pixel"))
    return runs.join(sets.select("file_id", "track", "seq", "objects", "bitmaps", "palette"), ["file_id", "track", "seq"]).select(
        "file_id", "track", "seq", "idx", "start_ms", "end_ms", "objects", "bitmaps", "palette", "exact", "pixel")


def entries(sets: DataFrame, factory: recognise.Factory, config: PipelineConfig | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """Subtitle entries (file_id, idx, start_ms, end_ms, text, vlm_lines) after all rules."""
    config = config or PipelineConfig()
    if tracks is not None:
        sets = sets_source.of_tracks(sets, tracks_source.choose(tracks, config.language, config.track))
    shown = intervals(sets)
    if config.debug:
        shown = stored(shown)
        raster.debug_images(shown).write.mode("overwrite").partitionBy("stage").parquet(config.debug_dir)
    read = recognise.read_lines(raster.line_images(shown), factory, config)
    return file_rules.post_process(stored(srt.join_lines(read)), between=stored, rules=config.file_rules)


def run(sets: DataFrame, factory: recognise.Factory, config: PipelineConfig, tracks: DataFrame | None = None) -> DataFrame:
    """entries, written as SRT files to config.output; returns what was written."""
    if not config.output:
        raise ValueError("output is not set")
    return srt.write(entries(sets, factory, config, tracks), config.output, config.code)
