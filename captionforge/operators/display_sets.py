"""Folding time-ordered display sets into display intervals.

Raw sets are rows (file_id, track, seq, start_pts, end_pts, key): key is null for a clear set, and equal for sets that
show the same picture. Exact keys are folded by window functions; pictures that may match within a tolerance are
compared with the first one of their run, which is no equivalence relation, and folded in order per track.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import ticks_to_ms
from . import raster
from .batches import arrow_schema, batch, pieces, records

LAST_MS = 5000


def is_visible(objects: Column, bitmaps: Column) -> Column:
    return (F.size(objects) > 0) & (F.size(bitmaps) > 0)


def picture_key(objects: Column, bitmaps: Column, own: Column) -> Column:
    """Equal for sets that match exactly: objects, place, size and run-length bytes of the first object; null for a clear
    set. A first object without a bitmap matches nothing: its key is made of own, which differs from set to set."""
    first = F.get(objects, F.lit(0))
    ods = F.get(F.get(bitmaps, first["object_id"]), F.lit(0))
    key = F.concat_ws(":", F.size(objects), first["x"], first["y"], ods["w"], ods["h"], F.sha2(ods["rle"], 256))
    key = F.when(ods["rle"].isNull(), F.concat_ws(":", F.lit("alone"), own.cast("string"))).otherwise(key)
    return F.when(is_visible(objects, bitmaps), key)


def alpha_match(a: Column, b: Column, tolerance: float = 16, share: float = 0.005) -> Column:
    """Do two arrays differ by more than tolerance in no more than a share of their common length? Empty: no."""
    n = F.least(F.size(a), F.size(b))
    far = F.aggregate(
        F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (F.abs(x.cast("double") - y.cast("double")) > tolerance).cast("int")),
        F.lit(0), lambda s, x: s + x,
    )
    return (n > 0) & (far <= n * share)


def fold_exact(sets: DataFrame) -> DataFrame:
    """One row per run: file_id, track, idx, seq (its first set), start_ms, end_ms and n (sets absorbed)."""
    w = W.partitionBy("file_id", "track").orderBy("seq")
    d = sets.select("file_id", "track", "seq", "start_pts", "end_pts", "key", F.row_number().over(w).alias("__at"),
                    F.lag("key").over(w).alias("__before"), F.lead("key").over(w).alias("__after"),
                    F.lead("start_pts").over(w).alias("__next"), F.count(F.lit(1)).over(W.partitionBy("file_id", "track")).alias("__all"))
    opens = F.col("key").isNotNull() & (F.col("__before").isNull() | (F.col("__before") != F.col("key")))
    d = d.withColumn("__run", F.sum(opens.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("key").isNotNull())
    at = F.col("__at")
    runs = d.groupBy("file_id", "track", "__run").agg(
        F.min_by(F.struct("seq", "start_pts", "end_pts"), at).alias("f"),
        F.max_by(F.struct(F.col("__after").alias("after"), F.col("__next").alias("next"), (at == F.col("__all")).alias("last")), at).alias("l"),
        F.count(F.lit(1)).alias("n"),
    )
    start = ticks_to_ms(F.col("f.start_pts"))
    shown = F.coalesce(F.col("f.end_pts"), F.lit(0))
    end = (
        F.when(F.col("l.last"), F.when(shown > 0, ticks_to_ms(shown)).otherwise(start + LAST_MS))
        .when(F.col("l.after").isNull(), ticks_to_ms(F.col("l.next")))
        .otherwise(ticks_to_ms(shown))
    )
    return runs.select("file_id", "track", F.col("__run").alias("idx"), F.col("f.seq").alias("seq"), start.alias("start_ms"), end.alias("end_ms"), "n")


def statistics(sets: DataFrame, runs: DataFrame) -> DataFrame:
    """Per file and track: visible and clear sets, sets merged into others as exactly equal and by their pixels (runs:
    columns exact and pixel, or n of exact runs), and when the last one begins."""
    exact, pixel = (F.col("exact"), F.col("pixel")) if "exact" in runs.columns else (F.col("n") - 1, F.lit(0))
    s = sets.groupBy("file_id", "track").agg(F.count_if(F.col("key").isNotNull()).alias("visible"), F.count_if(F.col("key").isNull()).alias("clear"), ticks_to_ms(F.max_by("start_pts", "seq")).alias("last_ms"))
    r = runs.groupBy(F.col("file_id").alias("__f"), F.col("track").alias("__t")).agg(F.sum(exact).alias("e"), F.sum(pixel).alias("p"))
    d = s.join(r, F.col("file_id").eqNullSafe(F.col("__f")) & F.col("track").eqNullSafe(F.col("__t")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return d.select("file_id", "track", "visible", "clear", count("e").alias("merged_exact"), count("p").alias("merged_pixel"), "last_ms")


def picture_alpha(r) -> np.ndarray | None:
    """The alpha of a row's picture, (h, w): its bytes if it has them, else decoded from rle and palette."""
    h, w = int(r.h), int(r.w)
    if getattr(r, "alpha", None) is not None:
        return np.frombuffer(r.alpha, dtype=np.uint8).reshape(h, w)
    if getattr(r, "palette", None) is None or r.rle is None:
        return None
    return raster.to_bgra(raster.rle_decode(r.rle, w, h), np.asarray(r.palette))[..., 3]


def fuzzy_match(a, b, alpha_a: Callable[[], np.ndarray | None], tolerance: int = 16, share: float = 0.005) -> str:
    """'exact', 'pixel' or '' for two rows with n_objects, x, y, w, h, rle and alpha or palette; pictures are decoded only
    if all else is near enough."""
    if a.n_objects != b.n_objects or a.n_objects == 0 or (a.x, a.y) != (b.x, b.y) or a.rle is None or b.rle is None:
        return ""
    if (a.w, a.h) == (b.w, b.h) and a.rle == b.rle:
        return "exact"
    w, h = int(min(a.w, b.w)), int(min(a.h, b.h))
    if abs(a.w - b.w) > 2 or abs(a.h - b.h) > 2 or not w or not h:
        return ""
    u, v = alpha_a(), picture_alpha(b)
    if u is None or v is None:
        return ""
    far = np.count_nonzero(np.abs(u[:h, :w].astype(np.int16) - v[:h, :w]) > tolerance)
    return "pixel" if far <= w * h * share else ""


def near_tracks(sets: DataFrame) -> DataFrame:
    """file_id and track where a set follows one of another key, but the same place and number of objects and nearly the
    same size (rows with key, n_objects, x, y, w, h): only there can pictures match by their pixels."""
    w = W.partitionBy("file_id", "track").orderBy("seq")
    d = sets.select("file_id", "track", "key", "w", "h", F.struct("n_objects", "x", "y").alias("at"), F.lag(F.struct("key", "w", "h", F.struct("n_objects", "x", "y").alias("at"))).over(w).alias("b"))
    near = (F.col("key") != F.col("b.key")) & (F.col("at") == F.col("b.at")) & (F.abs(F.col("w") - F.col("b.w")) <= 2) & (F.abs(F.col("h") - F.col("b.h")) <= 2)
    return d.filter(near).select("file_id", "track").distinct()


def fold_fuzzy(sets: DataFrame) -> DataFrame:
    """As fold_exact, for rows (file_id, track, seq, start_pts, end_pts, visible, n_objects, x, y, w, h, rle, and alpha or
    palette); exact and pixel count the absorbed sets. A track is read in order, in batches, within one task; only the
    first set of the open run is kept."""
    names = ["file_id", "track", "seq", "start_pts", "end_pts", "visible", "n_objects", "x", "y", "w", "h", "rle", "alpha" if "alpha" in sets.columns else "palette"]
    d = sets.select(*names).repartition("file_id", "track").sortWithinPartitions("file_id", "track", "seq")

    runs = "file_id string, track long, idx long, seq long, start_ms long, end_ms long, exact long, pixel long"
    schema = arrow_schema(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, first, idx, kinds = None, None, 0, {"exact": 0, "pixel": 0}
        out: list[tuple] = []
        seen: list[np.ndarray | None] = []  # the alpha of the first set, once it was asked for

        def decoded() -> np.ndarray | None:
            if not seen:
                seen.append(picture_alpha(first))
            return seen[0]

        def close(end_ms: int) -> None:
            nonlocal first
            out.append((track[0], track[1], idx, int(first.seq), int(first.start_pts) // 90, end_ms, kinds["exact"], kinds["pixel"]))
            first = None

        def shown(r) -> int:
            return int(r.end_pts or 0) if r.end_pts == r.end_pts else 0

        def finish() -> None:
            if first is not None:
                close(shown(first) // 90 if shown(first) > 0 else int(first.start_pts) // 90 + LAST_MS)

        for b in pieces(batches):
            for r in records(b):
                if track != (r.file_id, r.track):
                    finish()
                    track, idx = (r.file_id, r.track), 0
                if r.visible:
                    if first is not None:
                        kind = fuzzy_match(first, r, decoded)
                        if kind:
                            kinds[kind] += 1
                            continue
                        close(shown(first) // 90)
                    first, idx, kinds = r, idx + 1, {"exact": 0, "pixel": 0}
                    seen.clear()
                elif first is not None:
                    close(int(r.start_pts) // 90)
            if out:
                yield batch(out, schema)
                out = []
        finish()
        if out:
            yield batch(out, schema)

    return d.mapInArrow(run, runs)
