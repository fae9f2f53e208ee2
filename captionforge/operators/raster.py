"""Bitmap operators in numpy, applied to batches of rows through Arrow.

An image is a 2-D (grey, mask) or 3-D (height, width, BGRA) array of uint8. Everything between the run-length bytes of
a display set and its line images runs in one pass over a row, so pixels cross to Python and back once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import arrow_schema, batch, pieces, records


@dataclass(frozen=True)
class Settings:
    """Fixed values of the preprocessing."""

    alpha_flatness: int = 10
    alpha_threshold: int = 5
    ring: int = 2
    background_eps: int = 20
    margin_fraction: float = 0.10
    least_margin: int = 6
    strong_share: float = 0.80
    sigma: float = 0.5
    pad_fraction: float = 0.15
    least_pad: int = 14
    content: int = 220


DEFAULT = Settings()


def half_even(x) -> int:
    """Rounds a float32 half to even."""
    return int(np.rint(np.float32(x)))


# --- decoding ------------------------------------------------------------------------------------------------------


def rle_decode(data: bytes, width: int, height: int) -> np.ndarray:
    """Palette indices, (height, width). Runs are clipped at the width, lines end only where the data says so, and
    truncated data leaves the rest at index 0."""
    colors, runs = [], []
    feed = iter(data)
    room, left = width, height  # of the line; lines
    try:
        while left:
            color, run = next(feed), 1
            if color == 0:
                code = next(feed)
                if code == 0:
                    colors.append(0)
                    runs.append(room)
                    room, left = width, left - 1
                    continue
                run = code & 0x3F
                if code & 0x40:
                    run = run << 8 | next(feed)
                if code & 0x80:
                    color = next(feed)
            if run > room:
                run = room
            colors.append(color)
            runs.append(run)
            room -= run
    except StopIteration:
        pass
    flat = np.repeat(np.array(colors, dtype=np.uint8), np.array(runs, dtype=np.int64))
    return np.concatenate([flat, np.zeros(width * height - len(flat), dtype=np.uint8)]).reshape(height, width)


def rle_encode(indices: np.ndarray) -> bytes:
    """The shortest run-length form of palette indices that rle_decode reads."""
    out = bytearray()
    for row in indices:
        edges = np.concatenate([[0], np.nonzero(np.diff(row.astype(np.int16)))[0] + 1, [len(row)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            color, run = int(row[a]), int(b - a)
            while run > 0:
                n = min(run, 0x3FFF)
                if color and n <= 2:
                    out += bytes([color]) * n
                elif n < 64:
                    out += bytes([0, n | (0x80 if color else 0)]) + (bytes([color]) if color else b"")
                else:
                    out += bytes([0, 0x40 | n >> 8 | (0x80 if color else 0), n & 0xFF]) + (bytes([color]) if color else b"")
                run -= n
        out += b"\0\0"
    return bytes(out)


def to_bgra(indices: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """(height, width, 4) from indices and 256 ARGB numbers; an index beyond the palette is transparent."""
    table = np.zeros(256, dtype="<u4")
    table[: min(256, len(palette))] = np.asarray(palette[:256], dtype=np.int64).astype("<u4")
    return table[indices].view(np.uint8).reshape(*indices.shape, 4)


def decode_set(objects, bitmaps, palette) -> np.ndarray | None:
    """The first object's first bitmap as BGRA; None if there is none."""
    if objects is None or bitmaps is None or not len(objects) or not len(bitmaps):
        return None
    which = objects[0]["object_id"]
    if which is None or not 0 <= which < len(bitmaps) or not len(bitmaps[which]):
        return None
    ods = bitmaps[which][0]
    if not ods["w"] or not ods["h"]:
        return None
    return to_bgra(rle_decode(ods["rle"] or b"", ods["w"], ods["h"]), palette if palette is not None else [])


# --- masks and thresholds ------------------------------------------------------------------------------------------


def luma(bgra: np.ndarray) -> np.ndarray:
    b, g, r = (bgra[..., i].astype(np.float32) for i in range(3))
    return (np.float32(0.299) * r + np.float32(0.587) * g + np.float32(0.114) * b).astype(np.uint8)


def border(gray: np.ndarray, ring: int) -> np.ndarray:
    """Values of the outer rings, each ring's rows in full and its columns between them."""
    h, w = gray.shape
    parts = []
    for k in range(ring):
        parts += [gray[k], gray[h - 1 - k], gray[k + 1 : max(k + 1, h - 1 - k), k], gray[k + 1 : max(k + 1, h - 1 - k), w - 1 - k]]
    return np.concatenate(parts)


def support_mask(bgra: np.ndarray, s: Settings = DEFAULT) -> np.ndarray:
    """Where there may be text: by alpha, or by distance from the border's upper median if alpha is flat."""
    a = bgra[..., 3]
    if int(a.max()) - int(a.min()) >= s.alpha_flatness:
        return a > s.alpha_threshold
    gray = luma(bgra)
    edge = np.sort(border(gray, min(s.ring, *gray.shape)))
    return np.abs(gray.astype(np.int16) - int(edge[len(edge) // 2])) > s.background_eps


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1, inclusive."""
    rows, cols = np.nonzero(mask.any(axis=1))[0], np.nonzero(mask.any(axis=0))[0]
    return (int(cols[0]), int(rows[0]), int(cols[-1]), int(rows[-1])) if len(rows) else None


def otsu_threshold(values: np.ndarray) -> int:
    """First level with the greatest variance between the classes up to and beyond it; 128 for a single level."""
    hist = np.bincount(values.ravel(), minlength=256).astype(np.int64)
    below = np.cumsum(hist)
    sums = np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return 128
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sums / below - (sums[-1] - sums) / above
        between = below.astype(float) * above * d * d
    return int(np.argmax(np.where(ok, between, -1.0)))


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    """Box dilation, one axis after the other."""
    out = mask
    for axis in (0, 1):
        wide = out.copy()
        for k in range(1, r + 1):
            ahead, behind = np.zeros_like(out), np.zeros_like(out)
            if axis == 0:
                ahead[:-k], behind[k:] = out[k:], out[:-k]
            else:
                ahead[:, :-k], behind[:, k:] = out[:, k:], out[:, :-k]
            wide = wide | ahead | behind
        out = wide
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels (0: background) of the 8-connected components: the runs of a row are linked to those of the next that they
    touch, also by a corner, and the least run of each component is found by halving paths."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    ys, starts = np.nonzero(step == 1)
    _, ends = np.nonzero(step == -1)
    line = w + 2
    lo = np.searchsorted(ys * line + ends, (ys + 1) * line + starts, "left")
    hi = np.searchsorted(ys * line + starts, (ys + 1) * line + ends, "right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(ys)), count)
    b = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(len(ys))
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    size = ends - starts
    at = np.repeat(ys * w + starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    label = np.zeros(h * w, dtype=np.int32)
    label[at] = np.repeat(root + 1, size)
    return label.reshape(h, w)


def drop_small(mask: np.ndarray, least_area: int) -> np.ndarray:
    """Without components of fewer pixels than least_area, or less than two pixels high or wide."""
    label = components(mask)
    n = int(label.max()) + 1
    area = np.bincount(label.ravel(), minlength=n)
    ys, xs = np.nonzero(label)
    of = label[ys, xs]
    lo_x, hi_x, lo_y, hi_y = np.full(n, 1 << 30), np.full(n, -1), np.full(n, 1 << 30), np.full(n, -1)
    np.minimum.at(lo_x, of, xs), np.maximum.at(hi_x, of, xs), np.minimum.at(lo_y, of, ys), np.maximum.at(hi_y, of, ys)
    keep = (area >= least_area) & (np.minimum(hi_x - lo_x, hi_y - lo_y) + 1 >= 2)
    keep[0] = False
    return keep[label]


def gaussian(v: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur in float32 with repeated edges."""
    half = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-half, half + 1, dtype=np.float32) ** 2) / np.float32(2 * sigma * sigma)).astype(np.float32)
    k /= k.sum(dtype=np.float32)
    for axis in (1, 0):
        p = np.pad(v, [(half, half) if i == axis else (0, 0) for i in range(2)], mode="edge")
        n = v.shape[axis]
        out = np.zeros_like(v, dtype=np.float32)
        for j, w in enumerate(k):
            out += w * (p[j : j + n] if axis == 0 else p[:, j : j + n])
        v = out
    return v


def bucket_height(h: int) -> int:
    return 80 if h < 90 else 96 if h < 140 else 160


@lru_cache(maxsize=256)
def taps(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n_out places the pixels it is made of and their weights, (n_out, taps): the Mitchell kernel
    (B = C = 1/3), widened when shrinking."""
    scale = max(1.0, n_in / n_out)
    centre = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
    count = min(n_in, int(np.ceil(4 * scale)) + 1)
    first = np.clip(np.floor(centre - 2 * scale).astype(int), 0, n_in - count)
    at = first[:, None] + np.arange(count)
    x = np.abs(centre[:, None] - at) / scale
    inner = (7 * x**3 - 12 * x**2 + 16 / 3) / 6
    outer = (-7 / 3 * x**3 + 12 * x**2 - 20 * x + 32 / 3) / 6
    w = np.where(x < 1, inner, np.where(x < 2, outer, 0.0))
    return at, w / w.sum(axis=1, keepdims=True)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = gray.shape
    (ys, u), (xs, v) = taps(h, height), taps(w, width)
    tall = sum(u[:, k, None] * gray[ys[:, k]] for k in range(ys.shape[1]))
    out = sum(v[:, k] * tall[:, xs[:, k]] for k in range(xs.shape[1]))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def pad_size(h: int, s: Settings = DEFAULT) -> int:
    return max(s.least_pad, half_even(np.float32(s.pad_fraction) * np.float32(h)))


def preprocess(bgra: np.ndarray, s: Settings = DEFAULT) -> np.ndarray | None:
    """Dark text on white, scaled to a standard height and padded; None if the picture has no text."""
    support = support_mask(bgra, s)
    box = bounding_box(support)
    if box is None:
        return None
    h, w = support.shape
    m = max(s.least_margin, half_even(np.float32(s.margin_fraction) * np.float32(box[3] - box[1] + 1)))
    ys, xs = slice(max(0, box[1] - m), min(h - 1, box[3] + m) + 1), slice(max(0, box[0] - m), min(w - 1, box[2] + m) + 1)
    support, value = support[ys, xs], bgra[ys, xs, :3].max(axis=2)
    t = otsu_threshold(value[support])
    bright = value[support & (value >= t)]
    strong = int(t + s.strong_share * (bright.astype(float).sum() / len(bright) - t)) if len(bright) else t
    fill = dilate(support & (value >= strong), 1) & support & (value >= t)
    ch, cw = fill.shape
    fill = drop_small(fill, max(3, int(np.float32(0.0001) * np.float32(cw) * np.float32(ch))))
    gray = (255 - (gaussian(fill.astype(np.float32), s.sigma) * np.float32(255)).astype(np.int32)).astype(np.uint8)
    th = bucket_height(ch)
    tw = max(1, half_even(np.float32(cw) * (np.float32(th) / np.float32(ch))))
    return np.pad(resize(gray, tw, th), pad_size(th, s), constant_values=255)


def split_lines(gray: np.ndarray, min_gap: int = 2, min_height: int = 5, s: Settings = DEFAULT) -> list[tuple[int, int, np.ndarray]]:
    """(top, bottom, image) of each text line; the whole picture if no line is found."""
    ink = gray < s.content
    rows = ink.any(axis=1)
    h, w = gray.shape
    edge = np.diff(np.concatenate([[0], rows.astype(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    gap = max(min_gap, int(np.float32(max(ends - starts, default=0)) * np.float32(0.15)))
    regions: list[list[int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if regions and a - regions[-1][1] < gap:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    if regions and h - regions[-1][1] < gap:
        regions[-1][1] = h
    regions = [r for r in regions if r[1] - r[0] >= min_height]
    if not regions:
        return [(0, h, gray.copy())]
    out = []
    for a, b in regions:
        p = pad_size(b - a, s)
        cols = np.nonzero(ink[a:b].any(axis=0))[0]
        x0, x1 = (max(0, int(cols[0]) - p), min(w, int(cols[-1]) + 1 + p)) if len(cols) else (0, w)
        y0, y1 = max(0, a - p), min(h, b + p)
        line = gray[y0:y1, x0:x1].copy()
        guard = max(2, (b - a) // 8)
        line[: max(0, a - guard - y0)] = 255
        line[max(0, b + guard - y0) :] = 255
        out.append((y0, y1, line))
    return out


# --- geometry of a line --------------------------------------------------------------------------------------------


def ink(gray: np.ndarray) -> np.ndarray:
    """255 where there is ink, else 0."""
    return 255 * (gray < 128).astype(np.uint8)


def segments(gray: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of columns with ink, half-open."""
    ink = (gray < 128).any(axis=0).astype(np.int8)
    edge = np.diff(np.concatenate([[0], ink, [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


def crop_columns(gray: np.ndarray, start: int, end: int) -> np.ndarray | None:
    start, end = max(0, start), min(end, gray.shape[1])
    return gray[:, start:end] if start < end else None


def shear_variances(image: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """For each angle the variance of the column sums after every row has moved by tan(angle) times its number, cut to
    whole columns. The picture is as wide as the largest move needs, with a column to spare on either side."""
    h, w = image.shape
    moves = np.trunc(np.tan(np.radians(angles))[:, None] * np.arange(h)).astype(int)
    spare = int(np.abs(moves).max(initial=0)) + 1
    wide = w + 2 * spare
    ys, xs = np.nonzero(image)
    cells = np.arange(len(angles))[:, None] * wide + moves[:, ys] + xs + spare
    sums = np.bincount(cells.ravel(), weights=np.tile(image[ys, xs].astype(float), len(angles)), minlength=len(angles) * wide)
    return sums.reshape(len(angles), wide).var(axis=1)


def slant(image: np.ndarray, most: float = 20.0, steps: int = 40) -> tuple[float, float]:
    """The rightward angle at which the columns stand out most, and how much more than without shear (infinite if they
    don't stand out there at all)."""
    angles = np.linspace(0.0, most, steps + 1)
    upright, *spread = shear_variances(image, angles)
    best = int(np.argmax(spread))
    return float(angles[best + 1]), float(spread[best] / upright) if upright else float("inf")


def classify_italic(gray: np.ndarray, threshold: float = 3.0, least_ratio: float = 1.2) -> tuple[bool, float, float]:
    """(is italic, angle, ratio). A picture without variance has an infinite ratio and isn't italic."""
    angle, ratio = slant(ink(gray))
    return least_ratio < ratio < float("inf") and angle > threshold, angle, ratio


# --- PNG -----------------------------------------------------------------------------------------------------------


def png_gray(gray: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG."""
    h, w = gray.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), gray], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_to_gray(png: bytes) -> np.ndarray:
    """Reads what png_gray writes (8-bit grey, filter 0)."""
    at, body, size = 8, b"", (0, 0)
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        kind = png[at + 4 : at + 8]
        if kind == b"IHDR":
            size = struct.unpack(">II", png[at + 8 : at + 16])
        elif kind == b"IDAT":
            body += png[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(size[1], size[0] + 1)[:, 1:]


# --- over DataFrames -----------------------------------------------------------------------------------------------

LINES = "file_id string, idx long, start_ms long, end_ms long, line_no int, y0 int, y1 int, w int, h int, png binary"


def line_images(sets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per text line of each set: rows (file_id, idx, start_ms, end_ms, objects, bitmaps, palette).

    Sets without a picture or text give none; idx is as given, so numbers are those before such sets vanish."""

    schema = arrow_schema(LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for r in records(b):
                bgra = decode_set(r.objects, r.bitmaps, r.palette)
                gray = preprocess(bgra, settings) if bgra is not None else None
                for n, (y0, y1, line) in enumerate(split_lines(gray, s=settings) if gray is not None else []):
                    rows.append((r.file_id, r.idx, r.start_ms, r.end_ms, n, y0, y1, line.shape[1], line.shape[0], png_gray(line)))
            yield batch(rows, schema)

    return sets.select("file_id", "idx", "start_ms", "end_ms", "objects", "bitmaps", "palette").mapInArrow(run, LINES)


STAGES = "file_id string, idx long, stage string, w int, h int, px binary"


def debug_images(sets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The pictures between the steps, one row each (raw, mask, final), to be written by stage."""

    schema = arrow_schema(STAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for r in records(b):
                bgra = decode_set(r.objects, r.bitmaps, r.palette)
                if bgra is None:
                    continue
                final = preprocess(bgra, settings)
                shown = [("raw", luma(bgra)), ("mask", np.where(support_mask(bgra, settings), 0, 255).astype(np.uint8))] + ([("final", final)] if final is not None else [])
                rows += [(r.file_id, r.idx, k, v.shape[1], v.shape[0], v.tobytes()) for k, v in shown]
            yield batch(rows, schema)

    return sets.select("file_id", "idx", "objects", "bitmaps", "palette").mapInArrow(run, STAGES)
