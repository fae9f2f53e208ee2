import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from captionforge.llm import fingerprints, neardup


def simhash(text, k, words=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    out = ""
    for i in range(words):
        h = [xxhash.xxh64_intdigest(s.encode(), 42 + i) for s in sh]
        out += f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    return out


TEXTS = ["", " \n", "One", "one TWO three", "a b c d", "a b c d e f g " * 9, "x\x1cy z\x85w a b", "é漢 字 a　b c d e", "A\x0bB\x0cC\rD e", "a\U000F0000b c\xa0d e f g h", "\u2028x \U000F0011"]


@pytest.mark.parametrize("k,words", [(4, 1), (5, 2)])
def test_fingerprint(k, words):
    for t in TEXTS:
        assert "".join(f"{w:016x}" for w in neardup.fingerprint(t, k, words)) == simhash(t, k, words)


def components(fps, ids, radius):
    n = len(fps)
    x = [int(f, 16) for f in fps]
    label = list(ids)
    near = [[j for j in range(n) if (x[i] ^ x[j]).bit_count() <= radius] for i in range(n)]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(n)]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("k,radius,words", [(4, 4, 1), (5, 24, 2)])
def test_components_against_brute_force(spark, sf, monkeypatch, k, radius, words):
    monkeypatch.setattr(neardup, "TILE", 40)  # many tiles
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = neardup.near_duplicates(d, k, radius, words).toPandas()
    docs = d.toPandas().set_index("doc_id").text
    assert [simhash(docs[i], k, words) for i in got.doc_id] == list(got.fingerprint)
    assert components(list(got.fingerprint), list(got.doc_id), radius) == list(got.component_id)


@pytest.mark.parametrize("radius", [0, 3, 9, 24])
def test_tile_comparison(radius):
    r = np.random.default_rng(radius)
    a = r.integers(0, 1 << 64, size=(700, 2), dtype=np.uint64)
    a[200:400] = a[:200] ^ (np.uint64(1) << r.integers(0, 64, size=(200, 2), dtype=np.uint64))
    a[400:500] = a[:100]
    order = np.lexsort(neardup.block_counts(a).T[::-1])
    a = a[order]
    u, v = a[:333], a[333:]
    root = np.arange(len(a))
    first, second = np.arange(len(u)), np.arange(len(v))
    neardup.compare(u, u, radius, first, True)
    neardup.compare(v, v, radius, second, True)
    root[:333], root[333:] = neardup.flat(first), neardup.flat(second) + 333
    links = neardup.compare(u, v, radius, root, False)
    dist = sum(np.bitwise_count(a[:, None, w] ^ a[None, :, w]).astype(int) for w in range(2))
    label = np.arange(len(a))
    while True:
        new = np.where(dist <= radius, label[None, :], len(a)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (neardup.flat(root) == label).all()
    assert all(dist[i, j + 333] <= radius for i, j in links)


def test_long_chains(spark):
    r = random.Random(1)
    names = [f"{i:05d}" for i in range(300)]
    r.shuffle(names)
    e = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a string, b string")
    got = {x.node: x.root for x in neardup.components(e).collect()}
    assert set(got) == set(names) and set(got.values()) == {"00000"}


def test_copies_are_not_paired(spark):
    """A group of copies takes one fingerprint; near copies take no more links than there are components of tiles."""
    d = spark.createDataFrame([(i, "same text of some words " * 5) for i in range(500)], "doc_id long, text string")
    got = neardup.near_duplicates(d, 4, 4).agg(F.count("*"), F.count_distinct("fingerprint"), F.max("component_id")).first()
    assert tuple(got) == (500, 1, 0)


# --- operator 7 ----------------------------------------------------------------------------------------------------


def test_edited_texts_and_next(spark, sf):
    import hashlib

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    want = {}
    for i, r in enumerate(d):
        nxt = d[(i + 1) % len(d)].text
        h = len(r.text) // 2
        want[r.doc_id] = (len(r.text), hashlib.sha256((r.text[: len(r.text) - h] + nxt[:h]).encode()).hexdigest())
    got = fingerprints.op7_simhash_fingerprints(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    fps = {r.doc_id: r.fingerprint for r in got}
    for i, r in enumerate(d):
        other = fps[d[(i + 1) % len(d)].doc_id]
        near = 1 - (int(fps[r.doc_id], 16) ^ int(other, 16)).bit_count() / fingerprints.BITS
        assert next(x for x in got if x.doc_id == r.doc_id).near_next == pytest.approx(near)
    long = [x for x in got if x.n_chars > 300]
    assert sum(x.near_edited > x.near_next for x in long) / len(long) > 0.98


def voted(text):
    """The 128-bit SimHash of op7 in plain Python: of each word with the one after it."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    first = []
    for i, x in enumerate(w):
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        first.append(xxhash.xxh64_intdigest(w[i + 1].encode(), h) if i + 1 < len(w) else h)
    second = [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42) for h in first]
    word = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return f"{word(second):016x}{word(first):016x}"


def test_votes_against_plain_python(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprints.op7_simhash_fingerprints(spark, sf).collect()}
    fps = {i: voted(texts[i]) for i in order}
    near = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for n, i in enumerate(order):
        nxt = order[(n + 1) % len(order)]
        h = len(texts[i]) // 2
        efp = voted(texts[i][: len(texts[i]) - h] + texts[nxt][:h])
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (fps[i], efp)
        assert (r.near_edited, r.near_next) == (near(fps[i], efp), near(fps[i], fps[nxt]))
        others = sum((int(fps[i], 16) ^ int(f, 16)).bit_count() <= fingerprints.RADIUS for f in fps.values()) - 1
        assert r.n_near == (others if i % 20 == 0 else None)


def test_equal_texts_have_equal_fingerprints(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "A  b\nc"), (3, "a b d"), (4, None), (5, "")], "doc_id long, text string")
    fp = {r.doc_id: r.fp for r in fingerprints.fingerprints(d).collect()}
    assert fp[1] == fp[2] != fp[3] and fp[4] == fp[5] == "0" * 32


def test_votes_over_chunks(spark, monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(900))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = fingerprints.fingerprints(d).first().fp
    monkeypatch.setattr(fingerprints, "CHUNK", 100)
    assert fingerprints.fingerprints(d).first().fp == whole


def test_block_tables(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(150)]
    for x in base[:100]:
        for n in (1, 2, 3, 4):
            y = x
            for b in r.sample(range(128), n):
                y ^= 1 << b
            base.append(y)
    fps = [f"{x:032x}" for x in base]
    d = spark.createDataFrame([(f,) for f in fps], "fp string")
    q = spark.createDataFrame([(f,) for f in fps[:60]], "fp string")
    for radius, blocks in ((3, None), (2, 6), (0, 1)):
        got = {(x.query, x.fp) for x in fingerprints.within_radius(d, q, radius, blocks).collect()}
        assert got == {(a, b) for a in fps[:60] for b in fps if (int(a, 16) ^ int(b, 16)).bit_count() <= radius}


def jaccard_components(texts, ids, k, similarity):
    sets = [set(neardup.shingles(t or "", k)) for t in texts]
    near = [[j for j in range(len(sets)) if len(x & sets[j]) >= similarity * len(x | sets[j]) - 1e-9] for x in sets]
    label = list(ids)
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(sets))]
        if new == label:
            return label
        label = new


def edited(r, base, n):
    """base with its last words replaced, so that n of its 5-word shingles are lost."""
    return " ".join(base[: len(base) - n] + [f"x{r.getrandbits(60)}" for _ in range(n)])


def test_stage_links_by_exact_shingles(spark, sf, monkeypatch):
    """Near copies at 0.8 and more are linked, different documents that share much less than 0.8 are not; in pieces too."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "PIECE", 7)
    r = random.Random(8)
    texts = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [None, "", " ", "one two", "One  two"]
    for n in (11, 11, 11, 17, 20, 24, 30) * 12:  # of 104 words: Jaccard 89/111 = 0.80 and less
        base = [f"w{r.getrandbits(60)}" for _ in range(104)]
        texts += [" ".join(base), edited(r, base, n)]
    base = [f"w{r.getrandbits(60)}" for _ in range(104)]
    texts += [edited(r, base, 5) for _ in range(40)] + [edited(r, base, 18) for _ in range(40)]  # pairs of the latter: 0.68
    texts += ["a b c d e " * 40 + f"f{i}" for i in range(3)]
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    want = jaccard_components(texts, ids, 5, 0.8)
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).select("doc_id").collect())
    assert kept == sorted(set(want))
