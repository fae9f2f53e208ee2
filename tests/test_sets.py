import random

import pytest
from pyspark.sql import functions as F

from captionforge.operators import display_sets as ds
from captionforge.sources import tracks


def brute(rows):
    """Runs of one track by a plain loop over (start, end, key)."""
    out, run = [], None
    for start, end, key in rows:
        if run and key == run[2]:
            run[3] += 1
            continue
        if run:
            out.append((run[0] // 90, (start if key is None else run[1]) // 90, run[3]))
        run = [start, end, key, 1] if key is not None else None
    if run:
        out.append((run[0] // 90, run[1] // 90 if run[1] > 0 else run[0] // 90 + 5000, run[3]))
    return out


def made(spark, tracks_):
    rows = [(f, 1, i, s, e, k) for f, t in tracks_.items() for i, (s, e, k) in enumerate(t)]
    return spark.createDataFrame(rows, "file_id string, track long, seq long, start_pts long, end_pts long, key string")


@pytest.fixture(scope="module")
def random_tracks():
    r = random.Random(5)
    out = {}
    for f in range(30):
        t = sorted(r.sample(range(10**6), r.randint(1, 25)))
        out[f"f{f}"] = [(x * 90, r.choice([0, x * 90 + 4000]), r.choice([None, "a", "a", "b"])) for x in t]
    return out


def test_exact_folding(spark, random_tracks):
    got = {}
    for r in ds.fold_exact(made(spark, random_tracks)).orderBy("file_id", "idx").collect():
        got.setdefault(r.file_id, []).append((r.start_ms, r.end_ms, r.n))
    assert got == {k: v for k, v in ((k, brute(v)) for k, v in random_tracks.items()) if v}


def fuzzy_rows(spark, d):
    return d.select("file_id", "track", "seq", "start_pts", "end_pts", F.col("key").isNotNull().alias("visible"), *[F.lit(v).alias(n) for n, v in (("n_objects", 1), ("x", 0), ("y", 0), ("w", 1), ("h", 1))], F.col("key").cast("binary").alias("rle"), F.lit(None).cast("binary").alias("alpha"))


def test_fuzzy_folding_agrees_on_exact_keys(spark, random_tracks):
    d = made(spark, random_tracks)
    a = ds.fold_exact(d).select("file_id", "seq", "start_ms", "end_ms", (F.col("n") - 1).alias("exact"))
    b = ds.fold_fuzzy(fuzzy_rows(spark, d)).select("file_id", "seq", "start_ms", "end_ms", "exact")
    assert sorted(a.collect()) == sorted(b.collect())


def test_tolerance_is_measured_from_the_first_of_a_run(spark):
    """Pictures that drift: each is like the one before, but the last is unlike the first."""
    frames = [bytes([v] * 200) for v in (0, 10, 20, 30)]
    rows = [("f", 1, i, i * 900, i * 900 + 450, True, 1, 0, 0, 20, 10, bytes([1, i + 1]), a) for i, a in enumerate(frames)]
    d = spark.createDataFrame(rows, "file_id string, track long, seq long, start_pts long, end_pts long, visible boolean, n_objects int, x int, y int, w int, h int, rle binary, alpha binary")
    got = [(r.seq, r.start_ms, r.end_ms, r.exact, r.pixel) for r in ds.fold_fuzzy(d).orderBy("seq").collect()]
    assert got == [(0, 0, 5, 0, 1), (2, 20, 25, 0, 1)]


def test_alpha_match(spark):
    d = spark.createDataFrame([([0, 0, 0, 0], [0, 16, -16, 0]), ([0] * 4, [17, 0, 0, 0]), ([], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(ds.alpha_match(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_tracks(spark):
    rows = [("a", 0, "S_TEXT", "eng", 1), ("a", 1, tracks.CODEC, "jpn", 2), ("a", 2, tracks.CODEC, "ENG", 3), ("b", 0, tracks.CODEC, None, 1), ("c", 0, "S_TEXT", "en", 1)]
    d = spark.createDataFrame(rows, "file_id string, pos int, codec_id string, language string, track_number int")
    got = {r.file_id: (r.track_number, r.matched) for r in tracks.choose(d, "en").collect()}
    assert got == {"a": (3, True), "b": (1, False)}
    assert {r.file_id: r.track_number for r in tracks.choose(d, "en", 1).collect()} == {"a": 3}
    with pytest.raises(tracks.TrackError):
        tracks.require(d, "en")


def test_stream(spark, random_tracks, tmp_path):
    """What the stream gives is what the batch operator gives, but for runs that nothing has closed yet."""
    from captionforge.streaming.display_sets import fold_stream

    closed = {k: [*v, (10**9, 0, None)] for k, v in random_tracks.items()}
    d = made(spark, closed)
    for part in range(3):
        n = {k: len(v) for k, v in closed.items()}
        cut = F.udf(lambda f, s, part=part, n=n: s * 3 // n[f] == part, "boolean")
        d.filter(cut("file_id", "seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.file_id, r.start_ms, r.end_ms, r.n) for r in spark.table("folded").collect())
    want = sorted((r.file_id, r.start_ms, r.end_ms, r.n) for r in ds.fold_exact(d).collect())
    assert got == want


def test_sets_without_a_bitmap_match_nothing(spark):
    one, none = [(0, 1, 2)], [[(2, 2, b"a")]]
    rows = [(1, one, none), (2, one, none), (3, [(2, 1, 2)], none), (4, [(2, 1, 2)], none), (5, [], none), (6, [(5, 1, 2)], none)]
    d = spark.createDataFrame(rows, "seq long, objects array<struct<object_id:int,x:int,y:int>>, bitmaps array<array<struct<w:int,h:int,rle:binary>>>")
    k = [r[0] for r in d.select(ds.picture_key(F.col("objects"), F.col("bitmaps"), F.col("seq"))).collect()]
    assert k[0] == k[1] and k[4] is None and len({k[0], k[2], k[3], k[5]}) == 4


def test_job_folds_pictures_that_differ_a_little(spark):
    """The job's intervals: drawn pictures, by the alpha of their first set, and counts by kind."""
    from captionforge.plans import pipeline, queries

    sets = queries.drawn_sets(spark, "/root/testdata/sf0.001")
    runs = pipeline.intervals(sets)
    got = runs.select(F.sum("exact"), F.sum("pixel"), F.count("*")).first()
    assert got[0] and got[1] and sum(got) == sets.filter(F.size("objects") > 0).count()
    s = ds.statistics(sets.withColumn("key", F.when(F.size("objects") > 0, "k")), runs)
    assert tuple(s.select(F.sum("merged_exact"), F.sum("merged_pixel")).first()) == (got[0], got[1])
