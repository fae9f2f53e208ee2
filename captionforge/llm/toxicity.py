"""Operator 6: toxicity by class-conditional Kneser-Ney models.

The models are over the characters of a word (with its boundaries), of order 7. For either class,

    P(x | h) = max(c(hx) - D, 0) / c(h) + D * N(h.) / c(h) * P4(x | h'),

where c counts the documents of the class that have a word with the n-gram, N(h.) the different characters seen after
h, and P4 and P2 are backed off to. Those are shared by the classes and count continuations: the different 7-grams in
which an n-gram ends. So what neither class has seen gets the same probability from both, and a rare expression is
judged by the part of it that is known.

A word's score is the difference of its two log-likelihoods. A document's is a logistic function of the
length-normalised differences over its characters and its different words and of its most telling words, fitted on
labelled documents that the counts haven't seen.

The counts cover all labelled rows that may be learned from but those of the calibration. The tables are keyed by the full 64-bit hashes of n-grams and
grow with the number of different ones; the driver and each worker hold them. The calibration takes CALIBRATION
documents at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, slices

ORDER, MIDDLE, LOW = 7, 4, 2
DISCOUNT = 0.75
CALIBRATION = 20_000
THRESHOLD = 0.3
MOST_CACHED = 150_000
FLUSH = 150_000
#: Texts are taken together until they have this many different words (each text's counted), so that arrays are long and few.
GATHERED = 16_384
#: So many words at most are cut into n-grams at a time.
PIECE = 4_096
#: Labelled ids up to this number are broadcast; more are joined by a shuffle of the documents.
BROADCAST_ROWS = 500_000
_WORDS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = 500.0


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id has fold -1, which isn't held out and has no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def doc_words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _grams(words: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams and contexts at every character to be predicted; its word; the words' lengths.

    A word is preceded by one mark and followed by another; contexts stop at the first."""
    text = "\x02" + "\x03\x02".join(words) + "\x03" if words else ""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    marks = np.flatnonzero(a == 2)
    lengths = np.diff(marks, append=len(a)) - 1
    pos = np.arange(len(a)) - np.repeat(marks, lengths + 1)
    before = np.concatenate([np.zeros(ORDER - 1, dtype=np.uint64), a.astype(np.uint64)])
    h = np.zeros(len(a), dtype=np.uint64)
    by = {}
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            new = h ^ before[ORDER - 1 - k : len(before) - k]
            new *= _MIX
            new ^= new >> np.uint64(29)
            h = np.where(pos >= k, new, h) if k else new
            by[k + 1] = h
    here = np.flatnonzero(pos > 0)
    out = {"g7": by[ORDER][here], "c7": by[ORDER - 1][here - 1], "g4": by[MIDDLE][here], "c4": by[MIDDLE - 1][here - 1], "g2": by[LOW][here], "c2": by[LOW - 1][here - 1]}
    return out, marks - np.arange(len(marks)), lengths


def _slots(h: np.ndarray, table: str) -> np.ndarray:
    """Where the n-grams with these hashes stand in a Table: their keys, the full hashes."""
    return h


def word_counts(labelled: DataFrame) -> DataFrame:
    """word, and in how many documents of class 0 and 1 it stands (n0, n1). labelled: text, toxic."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                seen[int(y)].update(set(doc_words(text)))
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield table(seen)
                    seen = (Counter(), Counter())
        if seen[0] or seen[1]:
            yield table(seen)

    def table(seen: tuple[Counter, Counter]) -> pd.DataFrame:
        words = list(seen[0].keys() | seen[1].keys())
        return pd.DataFrame({"word": words, "n0": [seen[0][w] for w in words], "n1": [seen[1][w] for w in words]})

    rows = labelled.select("text", "toxic").mapInPandas(lean(run), "word string, n0 long, n1 long")
    return rows.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def counts(labelled: DataFrame) -> DataFrame:
    """One row per different 7-gram: the hashes g7, c7, g4, c4, g2, c2 of it and its parts, and in how many documents of
    class 0 and 1 a word has it (n0, n1, words counted once per document). labelled: text, toxic.

    Words are summed before they are cut into n-grams, so that hashes, which don't compress, are few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g, _, lengths = _grams(b["word"].tolist())
            d = pd.DataFrame({k: v.view(np.int64) for k, v in g.items()})
            first = d.drop_duplicates("g7").set_index("g7")
            n = pd.DataFrame({"g7": d["g7"], "n0": np.repeat(b["n0"].to_numpy(), lengths), "n1": np.repeat(b["n1"].to_numpy(), lengths)}).groupby("g7").sum()
            yield first.join(n).reset_index()[["g7", "c7", "g4", "c4", "g2", "c2", "n0", "n1"]]

    rows = word_counts(labelled).mapInPandas(lean(run), "g7 long, c7 long, g4 long, c4 long, g2 long, c2 long, n0 long, n1 long")
    return rows.groupBy("g7").agg(*[F.min(c).alias(c) for c in ("c7", "g4", "c4", "g2", "c2")], F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Table:
    """Numbers by 64-bit hash; 0 where there is none. table[i, h] and table[:, h] take hashes as an array would places.

    The hashes are sorted; the first of those that begin with the same bits is known, and there are as many such
    beginnings as hashes or more, so that a look-up takes a step or two at any size. A hash's numbers lie side by side."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(0xFFFFFFFFFFFFFFFF))  # at the end a row of zeros
        self.values = np.zeros((len(self.keys), len(values)), np.float32)
        self.values[:-1] = values[:, order].T
        self.bits = max(1, int(len(keys)).bit_length())
        n = np.bincount((keys >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.first = np.concatenate([[0], np.cumsum(n)]).astype(np.int32 if len(keys) < 2**31 else np.int64)

    def at(self, h) -> np.ndarray:
        """The rows of hashes; the last row for those that the table doesn't have."""
        h = np.asarray(h, dtype=np.uint64)
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64).reshape(-1)
        flat = h.reshape(-1)
        last = len(self.keys) - 1
        todo = np.flatnonzero(self.keys[at] < flat)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < flat[todo]]
        at[self.keys[at] != flat] = last
        return at.reshape(h.shape)

    def __getitem__(self, what):
        if isinstance(what, tuple):
            return self.rows(self.at(what[1])).T[what[0]]
        return _Row(self, what)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The numbers at places that at() gave, a row for each."""
        return self.values.take(at, axis=0)

    def __eq__(self, other):
        return np.array([np.array_equal(self.keys, other.keys), np.array_equal(self.values, other.values)])

    __hash__ = None


class _Row:
    def __init__(self, table: Table, i: int):
        self.table, self.i = table, i

    def __getitem__(self, h):
        return self.table[self.i, h]


class Model:
    """The tables of n-grams and contexts; they grow with the corpus."""

    def __init__(self, grams: DataFrame):
        one = lambda c: F.sum((F.col(c) > 0).cast("long"))
        grams = grams.persist()
        try:
            self.g7 = self._table(grams.select("g7", "n0", "n1"))
            self.c7 = self._table(grams.groupBy("c7").agg(F.sum("n0"), F.sum("n1"), one("n0"), one("n1")))
            # continuations: the different 7-grams in which an n-gram ends
            middle = grams.groupBy("g4").agg(F.min("c4").alias("c4"), F.count(F.lit(1)).alias("n"))
            low = grams.groupBy("g2").agg(F.min("c2").alias("c2"), F.count(F.lit(1)).alias("n"))
            self.g4 = self._table(middle.select("g4", "n"))
            self.c4 = self._table(middle.groupBy("c4").agg(F.sum("n"), F.count(F.lit(1))))
            self.g2 = self._table(low.select("g2", "n"))
            self.c2 = self._table(low.groupBy("c2").agg(F.sum("n"), F.count(F.lit(1))))
        finally:
            grams.unpersist()
        self.weights = self.mean = self.scale = None

    @staticmethod
    def _table(sums: DataFrame) -> Table:
        """One row per different n-gram comes to the driver."""
        kind = [F.col(f"`{c}`").cast("float").alias(str(i)) for i, c in enumerate(sums.columns[1:])]
        got = sums.select(F.col(sums.columns[0]).alias("h"), *kind).toArrow()
        keys = got.column(0).to_numpy().astype(np.int64).view(np.uint64)
        return Table(keys, np.stack([got.column(i + 1).to_numpy().astype(np.float32) for i in range(len(kind))]))

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        return np.concatenate([np.zeros(0), *[self._ratios(words[at : at + PIECE]) for at in range(0, len(words), PIECE)]])

    def _ratios(self, words: list[str]) -> np.ndarray:
        g, starts, _ = _grams(words)
        # after a context that neither class has, both have the same probability
        known = self.c7.at(_slots(g["c7"], "c7"))
        here = np.flatnonzero(known < len(self.c7.keys) - 1)
        s = {k: _slots(v[here], k) for k, v in g.items() if k != "c7"}

        def level(n, total, kinds, lower):
            """Interpolated Kneser-Ney, where the context is known."""
            t = np.maximum(total, 1)
            p = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * np.minimum(kinds, total) * lower) / t
            return np.where(total > 0, p, lower)

        p = level(self.g2[0, s["g2"]], *self.c2[:, s["c2"]], np.full(len(here), 1 / SYMBOLS))
        p = level(self.g4[0, s["g4"]], *self.c4[:, s["c4"]], p)
        p = np.maximum(p, 1e-9)
        c = self.c7.rows(known[here]).T
        n = self.g7[:, s["g7"]]
        p0, p1 = (level(np.minimum(n[y], c[y]), c[y], c[2 + y], p) for y in (0, 1))
        each = np.zeros(len(known))
        each[here] = np.log(p1) - np.log(p0)
        return np.add.reduceat(each, starts)

    def features(self, texts: Iterable[str | None], cache: dict[str, float]) -> np.ndarray:
        """A row of N_FEATURES numbers for each text; zeros for texts without words."""
        out, gathered, n = [np.zeros((0, N_FEATURES))], [], 0
        for text in texts:
            gathered.append(Counter(doc_words(text)))
            n += len(gathered[-1])
            if n >= GATHERED:
                out.append(self._features(gathered, cache))
                gathered, n = [], 0
        return np.concatenate([*out, self._features(gathered, cache)])

    def _features(self, texts: list[Counter], cache: dict[str, float]) -> np.ndarray:
        out = np.zeros((len(texts), N_FEATURES))
        some = np.array([i for i, words in enumerate(texts) if words], dtype=int)
        if not len(some):
            return out
        words = list(chain.from_iterable(texts))
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            if len(cache) > MOST_CACHED:
                cache.clear()
                new = list(dict.fromkeys(words))
            cache.update(zip(new, self.ratios(new).tolist(), strict=True))
        r = np.fromiter(map(cache.__getitem__, words), float, len(words))
        n = np.fromiter(chain.from_iterable(t.values() for t in texts), float, len(words))
        size = np.fromiter(map(len, words), float, len(words)) + 1
        many = np.array([len(texts[i]) for i in some])
        first = np.cumsum(many) - many
        total = lambda x: np.add.reduceat(x, first)
        top = r[np.lexsort((-r, np.repeat(np.arange(len(some)), many)))]
        best = [np.where(many > i, top[np.minimum(first + i, len(top) - 1)], 0) for i in range(3)]
        root = np.sqrt(many)
        over = total(np.maximum(r - 1.5, 0))
        out[some] = np.stack([
            total(r * n) / total(size * n), total(r) / total(size), best[0], best[0] + (best[1] + best[2]), np.log1p(over), over / root,
            np.log(many), total((r > 2).astype(float)) / root, total(np.maximum(r - 3, 0)) / root,
        ], axis=1)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small ridge."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (p - y) + 0.3 * w)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:  # nothing to learn from: every text is ordinary
            return np.zeros(len(x))
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


N_FEATURES = 9


def train(docs: DataFrame, labels: DataFrame, calibration: int = CALIBRATION) -> Model:
    """From the rows that aren't held out: of fold 3 `calibration` documents at most are used to fit the logistic function,
    all others are counted. docs: doc_id, text; labels: doc_id, toxic (null: no label; several: the highest)."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    d = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    # ids that are rows of labels and at most `calibration`
    chosen = known.filter(fold(F.col("l_id")) == 3).orderBy(F.xxhash64("l_id"), "l_id").limit(calibration)
    seen = known.filter(fold(F.col("l_id")).isin(0, 1, 3)).join(F.broadcast(chosen.select("l_id")), "l_id", "left_anti")
    if seen.count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    counted = d.filter(fold(F.col("doc_id")).isin(0, 1, 3)).join(seen, F.col("doc_id") == F.col("l_id"))
    model = Model(counts(counted))
    picked = d.filter(fold(F.col("doc_id")) == 3).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for b in batches:
            yield pd.DataFrame({"x": list(shared.value.features(b["text"], cache)), "y": b["toxic"].astype("int32")})

    got = picked.mapInPandas(lean(run), "x array<double>, y int").toPandas()
    if len(got) and got["y"].nunique() == 2:
        # repeated rows may arrive in any order; a fixed one gives the same sums
        x = np.array(got["x"].tolist())
        y = got["y"].to_numpy(dtype=float)
        order = np.lexsort([*x.T, y])
        model.fit(x[order], y[order])
    shared.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns with toxic_score (0 to 1) and toxic_predicted. Null, empty and wordless texts get the score of no
    evidence; repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        m = shared.value
        for b in slices(batches):
            x = m.features(b.column("text").to_pylist(), cache)
            s = pa.array(np.round(m.score(x), 6))
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*names, "toxic_score"])

    out = docs.mapInArrow(lean(run), docs.select("*", F.lit(0.0).alias("toxic_score")).schema)
    return out.withColumn("toxic_predicted", (F.col("toxic_score") >= THRESHOLD).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; learned from labels outside fold 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return d.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
