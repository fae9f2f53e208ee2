import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from captionforge.operators import raster


def test_rle_golden():
    data = bytes.fromhex("05 00 02 00 00 00 83 09 07 00 00 00 C0 04 03 00 00".replace(" ", ""))
    assert raster.rle_decode(data, 4, 3).tolist() == [[5, 0, 0, 0], [9, 9, 9, 7], [3, 3, 3, 3]]


def test_rle_clips_and_stops():
    assert raster.rle_decode(bytes([0, 0x7F, 0xFF]), 3, 1).tolist() == [[0, 0, 0]]
    assert raster.rle_decode(bytes([4, 4, 4, 4, 4]), 3, 1).tolist() == [[4, 4, 4]]
    assert raster.rle_decode(bytes([0, 0xC1]), 3, 1).tolist() == [[0, 0, 0]]
    assert raster.rle_decode(b"", 2, 1).tolist() == [[0, 0]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 6), st.integers(0, 2**31))
def test_rle_roundtrip(w, h, seed):
    r = np.random.default_rng(seed)
    a = np.repeat(r.integers(0, 4, size=(h, w)), 9, axis=1).astype(np.uint8)
    assert (raster.rle_decode(raster.rle_encode(a), w * 9, h) == a).all()


@pytest.mark.parametrize("v,t", [([10] * 4 + [200] * 4, 10), ([7] * 5, 128), ([0, 0, 100, 255], 100)])
def test_otsu(v, t):
    assert raster.otsu_threshold(np.array(v, dtype=np.uint8)) == t


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**31))
def test_components_against_flood_fill(w, h, seed):
    m = np.random.default_rng(seed).random((h, w)) < 0.45
    label = raster.components(m)
    seen = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m), strict=True):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for c in range(max(0, a - 1), min(h, a + 2)):
                for d in range(max(0, b - 1), min(w, b + 2)):
                    if m[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        ids = {label[c] for c in cells}
        assert len(ids) == 1 and (label == ids.pop()).sum() == len(cells)
    assert ((label > 0) == m).all()


def test_small_components_go():
    m = np.zeros((10, 12), dtype=bool)
    m[1:4, 1:4] = True
    m[6, 1:9] = True  # one pixel high
    m[8:10, 10] = True
    assert raster.drop_small(m, 3).sum() == 9


def test_dilation():
    m = np.zeros((5, 5), dtype=bool)
    m[2, 2] = True
    assert raster.dilate(m, 1).sum() == 9 and (raster.dilate(m, 0) == m).all()


def picture(lines, slant=0.0):
    a = np.zeros((40 * lines + 10, 300, 4), dtype=np.uint8)
    for n in range(lines):
        for x in range(20, 270, 9):
            for y in range(30):
                at = int(x + slant * (30 - y))
                a[5 + 40 * n + y, at : at + 3] = 255
    return a


def test_preprocess_and_split():
    for n in (1, 2):
        gray = raster.preprocess(picture(n))
        assert gray.min() < 50 and gray[0].min() == 255
        lines = raster.split_lines(gray)
        assert len(lines) == n and all(x.shape[0] >= 5 for _, _, x in lines)
    assert raster.preprocess(np.zeros((20, 20, 4), dtype=np.uint8)) is None
    opaque = picture(1)
    opaque[..., 3] = 255  # flat alpha: by distance from the border
    assert raster.preprocess(opaque) is not None


def test_blank_picture_is_one_line():
    assert [(a, b) for a, b, _ in raster.split_lines(np.full((12, 8), 255, dtype=np.uint8))] == [(0, 12)]


def test_italics():
    upright, slanted = (raster.preprocess(picture(1, s)) for s in (0.0, 0.25))
    assert not raster.classify_italic(upright)[0]
    ok, angle, ratio = raster.classify_italic(slanted)
    assert ok and 8 < angle <= 20 and ratio > 1.2
    assert raster.classify_italic(np.full((9, 9), 255, dtype=np.uint8)) == (False, pytest.approx(0.5), float("inf"))


def test_shear_against_a_plain_loop():
    r = np.random.default_rng(2)
    angles = np.linspace(0, 20, 9)
    for _ in range(20):
        a = raster.ink(r.integers(0, 256, size=r.integers(1, 30, size=2)).astype(np.uint8))
        h, w = a.shape
        spare = int(np.tan(np.radians(20)) * (h - 1)) + 1
        for angle, got in zip(angles, raster.shear_variances(a, angles), strict=True):
            wide = np.zeros((h, w + 2 * spare))
            for y in range(h):
                at = int(np.tan(np.radians(angle)) * y) + spare
                wide[y, at : at + w] = a[y]
            assert got == pytest.approx(wide.sum(axis=0).var())


def test_both_forms_agree(spark):
    """The array functions of signals and the numpy of raster, on random rows and pictures."""
    from pyspark.sql import functions as F

    from captionforge.operators import signals

    r = np.random.default_rng(5)
    rows = [(i, [int(x) for x in r.choice([r.integers(0, 256, 60), r.integers(90, 110, 60)])]) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, v array<int>").withColumn("m", F.transform("v", lambda x: x < 100))
    got = d.select("id", "v", signals.dilate(F.col("m"), 2).alias("dilated"), signals.blur(F.col("v")).alias("blurred"), signals.runs(F.col("m")).alias("runs"), signals.line_regions(F.col("m")).alias("lines"), signals.bounds(F.col("m"), 10).alias("box")).collect()
    levels = d.select("id", F.explode("v").alias("x"))
    otsu = {x.id: x.threshold for x in signals.otsu(levels, "id", "x").collect()}
    for x in got:
        v = np.array(x.v, dtype=np.uint8)
        mask = v < 100
        assert raster.otsu_threshold(v) == otsu[x.id]
        assert raster.dilate(mask[None, :], 2)[0].tolist() == x.dilated
        assert raster.gaussian(v[None, :].astype(np.float32), 0.5)[0] == pytest.approx(x.blurred, abs=1e-3)
        assert raster.segments(np.where(mask, 0, 255).astype(np.uint8)[None, :]) == [(s.start, s.end) for s in x.runs]
        box = raster.bounding_box(mask.reshape(6, 10))
        assert box == (None if x.box is None else tuple(x.box))
        # lines of a picture whose rows have ink where the mask is set; padding and the crop aside
        picture = np.repeat(np.where(mask, 0, 255).astype(np.uint8)[:, None], 4, axis=1)
        n = len(v)
        found = [(max(0, s.start - raster.pad_size(s.end - s.start)), min(n, s.end + raster.pad_size(s.end - s.start))) for s in x.lines]
        cut = [(a, b) for a, b, _ in raster.split_lines(picture)]
        assert cut == found or cut == [(0, n)]


def test_resize_against_whole_weights():
    r = np.random.default_rng(3)
    for h, w, th, tw in ((5, 7, 80, 112), (90, 40, 80, 36), (1, 1, 4, 4), (33, 200, 160, 969)):
        a = r.integers(0, 256, size=(h, w)).astype(np.uint8)

        def weights(n_in, n_out):
            scale = max(1.0, n_in / n_out)
            x = np.abs(((np.arange(n_out) + 0.5) * n_in / n_out - 0.5)[:, None] - np.arange(n_in)) / scale
            k = np.where(x < 1, (7 * x**3 - 12 * x**2 + 16 / 3) / 6, np.where(x < 2, (-7 / 3 * x**3 + 12 * x**2 - 20 * x + 32 / 3) / 6, 0))
            return k / k.sum(axis=1, keepdims=True)

        want = np.clip(np.rint(weights(h, th) @ a.astype(float) @ weights(w, tw).T), 0, 255)
        assert np.abs(raster.resize(a, tw, th) - want).max() <= 1

def test_segments_and_png():
    g = np.full((4, 10), 255, dtype=np.uint8)
    g[1, 2:4] = 0
    g[2, 7] = 100
    assert raster.segments(g) == [(2, 4), (7, 8)]
    assert (raster.png_to_gray(raster.png_gray(g)) == g).all()
    assert raster.crop_columns(g, 5, 5) is None and raster.crop_columns(g, -3, 99).shape == g.shape


def test_sets_without_pictures():
    pal = [0, -1]
    ods = [{"w": 1, "h": 1, "rle": b"\x01"}]
    assert raster.decode_set([], [ods], pal) is None
    assert raster.decode_set([{"object_id": 3}], [ods], pal) is None
    assert raster.decode_set([{"object_id": 0}], [[]], pal) is None
    assert raster.decode_set([{"object_id": 0}], [ods], pal).tolist() == [[[255, 255, 255, 255]]]
