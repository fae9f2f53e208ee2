"""Raster operators in DataFrame form, over signals: rows (id, v array) for one-dimensional data and histograms by key.

Array functions keep a signal in its row, so nothing is shuffled; thresholds by key use partial aggregates over a
histogram of at most 256 rows a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def otsu(values: DataFrame, key: str, value: str) -> DataFrame:
    """key and threshold: the first level that parts its histogram with the greatest variance between the parts.

    value: 0..255. A key with one level only has 128."""
    hist = values.groupBy(key, F.col(value).cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(key)
    d = hist.select(
        key, "v", F.sum("n").over(w).alias("wb"), F.sum(F.col("n") * F.col("v")).over(w).alias("sb"),
        F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"),
    )
    part = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / (F.col("n") - F.col("wb"))
    d = d.filter("wb < n").withColumn("between", F.col("wb").cast("double") * (F.col("n") - F.col("wb")) * part * part)
    best = d.groupBy(F.col(key).alias("__key")).agg(F.min_by("v", F.struct(-F.col("between"), F.col("v"))).alias("v"))
    keys = hist.select(key).distinct()
    return keys.join(best, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce("v", F.lit(128)).alias("threshold"))


def strong_threshold(values: DataFrame, thresholds: DataFrame, key: str, value: str) -> DataFrame:
    """key, threshold and strong: the threshold moved 80 % of the way to the mean of the values from it up."""
    t = thresholds.withColumnRenamed(key, "__key")
    d = values.join(t, F.col(key).eqNullSafe(F.col("__key")))
    v = F.col(value)
    bright = F.when(v >= F.col("threshold"), v)
    mean = F.sum(bright).cast("double") / F.count(bright)
    return d.groupBy(key, "threshold").agg(mean.alias("m")).select(
        key, "threshold", F.coalesce((F.col("threshold") + F.lit(0.80) * (F.col("m") - F.col("threshold"))).cast("int"), F.col("threshold")).alias("strong"))


def upper_median_by(d: DataFrame, key: str, value: str) -> DataFrame:
    """key and median without gathering a key's values: positions come from the counts of its different values."""
    hist = d.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    e = hist.select(key, value, F.sum("n").over(w).alias("upto"), F.sum("n").over(W.partitionBy(key)).alias("all"))
    return e.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def support(values: Column, background: Column, eps: float) -> Column:
    return F.transform(values, lambda x: F.abs(x - background) > eps)


def bounds(mask: Column, width: int) -> Column:
    """struct<x0, y0, x1, y1> of the true cells of a row-major mask; null if there are none."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    xs = F.transform(at, lambda i: F.pmod(i, F.lit(width)))
    ys = F.transform(at, lambda i: F.floor(i / width).cast("int"))
    box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    return F.when(F.size(at) > 0, box)


def dilate(mask: Column, r: int) -> Column:
    """True where any cell within r is."""
    return F.transform(mask, lambda m, i: F.exists(F.slice(mask, F.greatest(i - r, F.lit(0)) + 1, F.least(i, F.lit(r)) + r + 1), lambda x: x))


def gaussian_weights(sigma: float = 0.5) -> list[float]:
    half = math.ceil(3 * sigma)
    k = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(2 * half + 1)]
    return [x / sum(k) for x in k]


def blur(v: Column, sigma: float = 0.5) -> Column:
    """Gaussian blur with the ends repeated."""
    k = gaussian_weights(sigma)
    half = len(k) // 2
    last = F.size(v) - 1

    def at(_: Column, i: Column) -> Column:
        terms = [F.get(v, F.greatest(F.lit(0), F.least(i + (j - half), last))) * F.lit(w) for j, w in enumerate(k)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return F.transform(v, at)


def runs(mask: Column) -> Column:
    """array<struct<start, end>> of the maximal runs of true cells, half-open (columns with ink, rows with content)."""
    starts = F.filter(F.transform(mask, lambda m, i: F.when(m & ((i == 0) | ~F.get(mask, i - 1)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(mask, lambda m, i: F.when(m & ((i == F.size(mask) - 1) | ~F.get(mask, i + 1)), i + 1)), lambda i: i.isNotNull())
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def line_regions(content: Column, min_gap: int = 2, min_height: int = 5) -> Column:
    """array<struct<start, end>> of text lines: runs of content joined over gaps shorter than
    max(min_gap, 15 % of the longest run); short lines are dropped, and none at all means the whole height.

    A region that content reaches less than a gap before the end of the image goes to its end."""
    spans = runs(content)
    longest = F.coalesce(F.array_max(F.transform(spans, lambda s: s.end - s.start)), F.lit(0))
    gap = F.greatest(F.lit(min_gap), (longest * F.lit(0.15)).cast("int"))
    n = F.size(content)
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: F.get(a, F.size(a) - 1)
    step = lambda a, s: F.when(
        (F.size(a) > 0) & (s.start - last(a).end < gap),
        F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a).start.alias("start"), s.end.alias("end")))),
    ).otherwise(F.concat(a, F.array(F.struct(s.start.alias("start"), s.end.alias("end")))))
    joined = F.aggregate(spans, none, step)
    joined = F.transform(joined, lambda s: F.struct(s.start.alias("start"), F.when(n - s.end < gap, n).otherwise(s.end).alias("end")))
    kept = F.filter(joined, lambda s: s.end - s.start >= min_height)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))))


def sheared_sums(rows: list[Column], width: int, angle: float, pad: int) -> Column:
    """Column sums of a small image after each row y has been moved by int(tan(angle) * y) + pad."""
    shear = math.tan(math.radians(angle))
    full = width + 2 * pad
    cells = []
    for x in range(full):
        terms = [F.get(r, F.lit(x - (int(shear * y) + pad))) for y, r in enumerate(rows) if 0 <= x - (int(shear * y) + pad) < width]
        total = F.lit(0.0)
        for t in terms:
            total = total + t
        cells.append(total)
    return F.array(*cells)


def variance(v: Column) -> Column:
    """Population variance of an array."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
