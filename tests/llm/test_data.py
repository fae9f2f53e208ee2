"""Decontamination, mixing, token shards and the pipeline."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionforge.llm import decontam, mixing, tokenpack

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=10):
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = [(i, tuple(w[k : k + size])) for i, t in items for w in [low(t)] for k in range(max(1, len(w) - size + 1)) if w]
    out = {}
    for d, t in docs:
        w = low(t)
        hit, ids = set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    ids.add(str(i))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "x y"), (3, "B C"), (4, ""), (5, None), (6, "a a a a a a a a a a a"), (7, "never seen words here at all in any of them")]
DOCS = [(1, "z a b c d e f g h i j k l z"), (2, "x, y; X-Y"), (3, "a " * 14), (4, "b c d e f g h i j k"), (5, None), (6, "nothing"), (7, "x"), (8, "A B C D E F G H I J b c")]


@pytest.mark.parametrize("block", [100_000, 5])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", block)
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontam.contamination(d, i).collect()}
    assert got == brute(DOCS, ITEMS)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "p b a q r"), (2, "a x x x x x x x x x x x x b"), (3, "a x b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    t = d.select("doc_id", decontam.tokens(F.col("text")).alias("t"))
    found = decontam.proximity(t, i, size=2, slack=2)
    assert {r.doc_id for r in found.collect()} == {1, 3}
    assert [(r.doc_id, r.near_ids) for r in decontam.contamination(d, i, 2, 2).orderBy("doc_id").collect()] == [(1, ["1"]), (2, []), (3, ["1"])]
    assert {r.doc_id for r in decontam.occurrences(t, i, size=2).collect()} == set()


def test_native_plans(spark, sf):
    from captionforge.llm import fingerprints

    for f in (decontam.op4_decontamination, fingerprints.op7_simhash_fingerprints):
        plan = f(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def water(sizes, weights, share, repeats):
    """Shares by weight; what is above a cap is shared anew among the others."""
    left, goal, free = share * sum(sizes), {}, dict(enumerate(sizes))
    while free:
        w = sum(weights[i % len(weights)] for i in free)
        over = {i: s for i, s in free.items() if left * weights[i % len(weights)] / w > repeats * s}
        if not over:
            return {**goal, **{i: left * weights[i % len(weights)] / w for i in free}}
        for i, s in over.items():
            goal[i] = repeats * s
            left -= repeats * s
            del free[i]
    return goal


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 10], [1, 1, 1, 1, 500], [0, 5, 7], [3]])
def test_targets(spark, sizes):
    d = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.targets(d).orderBy("source").collect()]
    assert got == pytest.approx([water(sizes, [3, 1, 2], 1.5, 2)[i] for i in range(len(sizes))])


def test_mix(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.op3_mixing(spark, sf).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 3)  # many buckets give the same mix
    assert mixing.op3_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True).equals(got.sort_values("doc_id").reset_index(drop=True))
    m = mixing.mix(docs).toPandas()
    per = m.groupby("doc_id").mix_taken.sum()
    want = got.set_index("doc_id").taken
    assert per.equals(want[want > 0].sort_index())
    assert (m.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))) == m.mix_taken).all() and (m.n_chars == m.text.str.len()).all()
    for s, g in m.merge(got, on="doc_id").groupby("source"):
        assert abs(g.mix_taken.sum() - g.target.iloc[0]) < 1.001, s
    parts = mixing.mix(docs, partitions=4).withColumn("p", F.spark_partition_id()).toPandas()
    assert parts.sort_values("p", kind="stable").mix_finish.is_monotonic_increasing


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel(n):
    p = tokenpack.feistel(np.arange(n), n, "k")
    assert sorted(p) == list(range(n)) and (tokenpack.feistel(p, n, "k", inverse=True) == np.arange(n)).all()
    assert n < 60 or (p != tokenpack.feistel(np.arange(n), n, "other")).any()


def test_encoding_in_parts():
    e = tokenpack.encoder(tokenpack.TOKENIZER)
    for t in ["a  b c\n d \t e   ", "  x", " \n y z ", "it's a b c", "", " ", "é 漢字 😀 x", "a　 b", "x\x85 y"]:
        assert np.frombuffer(tokenpack.encode(t), "<u2").tolist() == e.encode_ordinary(t)


@pytest.mark.parametrize("n", [0, 1, tokenpack.RANKED - 1, tokenpack.RANKED, 100_000])
@pytest.mark.parametrize("most", [1, 300, 1 << 16])
def test_packed_tokens_come_back(n, most):
    a = np.random.default_rng(n).integers(0, most, n).astype("<u2")
    assert (tokenpack.unpack(tokenpack.pack(a), n) == a).all()


def test_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}/shards"
    done = tokenpack.write_shards(docs, folder, length=128, per_shard=64)
    a = tokenpack.records(done, folder, length=128, per_shard=64).toPandas()
    n = len(a)
    assert sorted(a.slot) == list(range(n)) and set(map(len, a.tokens)) == {256}
    assert (a.shard == a.slot // 64).all() and (a.at_byte == a.slot % 64 * 256).all()
    assert (a.slot == tokenpack.feistel(a.sequence.to_numpy(), n, tokenpack.KEY)).all()
    stream = np.concatenate([np.frombuffer(t, "<u2")[:k] for t, k in zip(a.sort_values("sequence").tokens, a.sort_values("sequence").n_tokens, strict=True)])
    cuts = np.split(stream, np.nonzero(stream == tokenpack.END)[0] + 1)[:-1]
    e = tokenpack.encoder(tokenpack.TOKENIZER)
    assert sorted(e.decode(c[:-1].tolist()) for c in cuts) == sorted(r.text for r in docs.select("text").collect())
    # the documents of a record, in order: those whose tokens it holds
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    ends = np.cumsum([len(c) for c in cuts])
    for r in a.itertuples():
        first, last = np.searchsorted(ends, [r.sequence * 128, r.sequence * 128 + r.n_tokens - 1], side="right")
        assert list(r.doc_ids) == ids[first : last + 1]
    shards = done.collect()
    assert sum(s.records for s in shards) == n and {s.sequences for s in shards} == {n}
    for s in shards:
        with open(s.path, "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == s.sha256
    again = tokenpack.sequences(docs, length=128, per_shard=64).toPandas()
    assert dict(zip(again.slot, again.tokens, strict=True)) == dict(zip(a.slot, a.tokens, strict=True))


def test_reading_shards_from_any_slot(spark, sf, tmp_path):
    """Reads from the middle and resumes; what a killed task left, and a second writing, change nothing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"{tmp_path}/shards"
    done = tokenpack.write_shards(docs, folder, length=64, per_shard=32).collect()
    n = sum(s.records for s in done)
    whole = tokenpack.read(folder, 0, n + 5, 64, 32)
    assert whole.shape == (n, 64)
    for slot, records in ((0, 1), (31, 2), (40, 100), (n - 3, 10), (n, 4)):
        assert (tokenpack.read(folder, slot, records, 64, 32) == whole[slot : slot + records]).all()
    part = tokenpack.read(folder, 10, 50, 64, 32)
    assert (np.concatenate([part, tokenpack.read(folder, 60, n, 64, 32)]) == whole[10:]).all()
    (tmp_path / "shards" / ".00000001-killed").write_bytes(b"half a shard")
    (tmp_path / "shards" / "shard-00000001.bin").unlink()
    again = tokenpack.write_shards(docs, folder, length=64, per_shard=32).collect()
    assert {s.shard: s.sha256 for s in again} == {s.shard: s.sha256 for s in done}
    assert (tokenpack.read(folder, 0, n, 64, 32) == whole).all()


def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from captionforge.llm import toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_ids"]
    kept = []
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(docs.toPandas())
    a, b, c, d = kept
    predicted = toxicity.op6_toxicity(spark, sf).toPandas()
    assert set(a.doc_id) == set(predicted[predicted.predicted == 0].doc_id)
    assert b.text.is_unique and set(b.doc_id) <= set(a.doc_id)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute(list(zip(b.doc_id, b.text, strict=True)), bench)
    assert set(c.doc_id) == {i for i in b.doc_id if not hit[i][1]}
    assert set(d.doc_id) <= set(c.doc_id) and d.doc_id.value_counts().max() <= 2
    tokens = p.STAGES[-1][1](spark, docs, sf)
    assert tokens.select(F.sum("n_tokens")).first()[0] == sum(len(tokenpack.encode(t)) // 2 + 1 for t in d.text)
    assert p.ORACLE_SQL is None and p.run(spark, sf).count() == tokens.count()


def test_near_copies_in_the_pipeline(spark, sf):
    """Near copies of over 0.8 similarity go, unlike texts stay."""
    import random

    import corpus_pipeline as p

    r = random.Random(8)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(40):
        w = r.choices(vocabulary, k=400)
        rows.append((i, " ".join(w)))
        for n in range(2):
            v = list(w)
            for k in r.sample(range(400), 3):
                v[k] = r.choice(vocabulary)
            rows.append((100 + 2 * i + n, " ".join(v)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in p.near_dedup_stage(spark, d, sf).collect()) == list(range(40))


def test_shared_ids_in_the_pipeline(spark, sf):
    """Rows that share an id are judged by their texts: one row of each text stays, whatever the ids."""
    import corpus_pipeline as p

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    for rows, want in (
        ([(3, "a"), (5, "a"), (5, "b")], [(3, "a"), (5, "b")]), ([(3, "c"), (5, "c"), (5, "d")], [(3, "c"), (5, "d")]),
        ([(3, "b"), (5, "b"), (5, "c")], [(3, "b"), (5, "c")]), ([(None, "a"), (None, "a"), (None, "b"), (7, "b"), (7, "b")], [(None, "a"), (7, "b")]),
    ):
        d = spark.createDataFrame([(i, text[k], k, k) for i, k in rows], "doc_id long, text string, row string, row_key string")
        got = p.near_dedup_stage(spark, d, sf)
        assert got.columns == d.columns and sorted((str(r.doc_id), r.row) for r in got.collect()) == sorted((str(i), k) for i, k in want)


def test_order_of_rows_does_not_change_the_mix(spark):
    rows = [(1, f"{c}1 {c}2 {c}3 {c}4", "s") for c in "abcdef"] + [(None, f"{c}1 {c}2", "s") for c in "xyz"]
    mixes = [[(r.doc_id, r.text) for r in mixing.mix(spark.createDataFrame(x, "doc_id long, text string, source string"), share=0.4).collect()] for x in (rows, rows[::-1])]
    assert mixes[0] == mixes[1]
