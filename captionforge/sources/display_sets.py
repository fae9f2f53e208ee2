"""Raw display sets: the canonical input of the engine, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "file_id string, track int, seq long, start_pts long, end_pts long, objects array<struct<object_id:int,x:int,y:int>>, "
    "bitmaps array<array<struct<w:int,h:int,rle:binary>>>, palette array<int>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def of_tracks(sets: DataFrame, tracks: DataFrame) -> DataFrame:
    """The sets of the chosen tracks (file_id, track_number)."""
    t = tracks.select("file_id", tracks["track_number"].cast("int").alias("track"))
    return sets.join(t, ["file_id", "track"], "left_semi")
