"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

A text is read in runs: what stands between white space, with a space at either end; a run of more than MOST_BYTES bytes
is read in windows of a fourth as many characters, each of which begins in the middle of the one before.
A forward and a backward gated recurrent network read the bytes of a run; from both states a softmax labels every
position. A document's log-probability of a language is the mean over the positions of all its runs that hold letters.
The state begins anew with each run, so a run is computed once for all the places at which it stands.

Trained in numpy by backpropagation through time, on at most PER_LANG documents a language (the least hashes of
doc_id among those with a language outside fold 2) and RUNS runs of each, so PER_LANG * RUNS runs a language whatever
the others have. Languages with fewer runs than the mean weigh more by the root of the ratio.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import read

MOST_BYTES = 48
PER_LANG, RUNS = 250, 60
HIDDEN, EMBED, EPOCHS, RATE = 16, 12, 3, 0.02
MOST_CACHED = 150_000
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id has fold -1: it isn't held out, nor learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def runs(text: str) -> list[bytes]:
    """The runs of a text that hold a letter, lower-cased, as bytes with a space at either end."""
    out = []
    for w in text.lower().split():
        if len(w) <= MOST_BYTES // 4:
            if not w.isdigit():
                out.append(w)
        else:
            b = w.encode("utf-8", "replace")
            out += [w] if len(b) <= MOST_BYTES else [w[i : i + MOST_BYTES // 4] for i in range(0, len(w) - MOST_BYTES // 8, MOST_BYTES // 8)]
    return out


def has_letter(w: str) -> bool:
    return w.isalpha() or any(map(str.isalpha, w))


def as_bytes(w: str) -> bytes:
    return b" " + w.encode("utf-8", "replace") + b" "


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; one set of gates for each direction (f, b), stacked as update, reset, candidate."""

    def __init__(self, langs: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.langs = langs
        n = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": (r.normal(size=(256, EMBED)) * 0.5).astype(np.float32), "out": n(2 * HIDDEN, len(langs)), "out_b": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": n(EMBED, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States (time, batch, HIDDEN) of one direction; masked positions leave the state as it is."""
        w, u, c, h = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"c{d}"], HIDDEN
        table = self.p["emb"] @ w + c  # the input's part of the gates, by byte
        t, n = x.shape
        state = np.zeros((n, h), np.float32)
        states, saved = np.zeros((t, n, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            g = table[x[i]]
            a = state @ u[:, : 2 * h]
            zr = _sigmoid(g[:, : 2 * h] + a)
            z, r = zr[:, :h], zr[:, h:]
            q = np.tanh(g[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            m = mask[i][:, None]
            new = np.where(m, z * state + (1 - z) * q, state)
            if keep:
                saved.append((i, state, z, r, q))
            states[i] = state = new
        return states, saved

    def positions(self, batch: list[bytes], keep: bool = False):
        """log-probabilities (time, batch, languages) of the labels at every position; the mask; what training needs."""
        t = max(map(len, batch))
        x = np.zeros((t, len(batch)), dtype=np.int64)
        mask = np.zeros((t, len(batch)), dtype=bool)
        for j, b in enumerate(batch):
            x[: len(b), j] = np.frombuffer(b, dtype=np.uint8)
            mask[: len(b), j] = True
        sf, kf = self._direction("f", x, mask, keep)
        sb, kb = self._direction("b", x, mask, keep)
        s = np.concatenate([sf, sb], axis=2)
        o = s @ self.p["out"] + self.p["out_b"]
        o -= o.max(axis=2, keepdims=True)
        o -= np.log(np.exp(o).sum(axis=2, keepdims=True))
        return o, mask, (x, s, kf, kb)

    def gradients(self, batch: list[bytes], y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, weighted by run, by backpropagation through time."""
        o, mask, (x, s, kf, kb) = self.positions(batch, keep=True)
        h = HIDDEN
        d = np.exp(o)
        d[:, np.arange(len(batch)), y] -= 1
        by = mask if weight is None else mask * weight.astype(np.float32)
        d *= by[:, :, None] / by.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("tnh,tnk->hk", s, d)
        g["out_b"] = d.sum(axis=(0, 1))
        ds = d @ self.p["out"].T
        for name, part, saved in (("f", ds[:, :, :h], kf), ("b", ds[:, :, h:], kb)):
            w, u = self.p[f"w{name}"], self.p[f"u{name}"]
            carry = np.zeros((len(batch), h), np.float32)
            for i, state, z, r, q in reversed(saved):
                m = mask[i][:, None]
                dh = part[i] + carry
                on = np.where(m, dh, 0)
                dz = on * (state - q) * z * (1 - z)
                dq = on * (1 - z) * (1 - q * q)
                rs = dq @ u[:, 2 * h :].T
                dr = rs * state * r * (1 - r)
                gates = np.concatenate([dz, dr, dq], axis=1)
                e = self.p["emb"][x[i]]
                g[f"w{name}"] += e.T @ gates
                g[f"c{name}"] += gates.sum(axis=0)
                g[f"u{name}"][:, : 2 * h] += state.T @ gates[:, : 2 * h]
                g[f"u{name}"][:, 2 * h :] += (r * state).T @ dq
                np.add.at(g["emb"], x[i], gates @ w.T)
                carry = on * z + rs * r + gates[:, : 2 * h] @ u[:, : 2 * h].T + np.where(m, 0, dh)
        return g

    def fit(self, samples: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE, size: int = 256, seed: int = 5) -> Network:
        """Adam with a falling rate over batches of like length, in an order fixed by the seed.

        Runs of a language with fewer than the mean weigh more: by the root of the ratio, so that a stray one is learned
        without ruling its batches."""
        r = np.random.default_rng(seed)
        n = np.maximum(np.bincount([y for _, y in samples], minlength=len(self.langs)), 1)
        weight = np.sqrt(np.maximum(n.mean() / n, 1))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        order = sorted(range(len(samples)), key=lambda i: (len(samples[i][0]), i))
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        step, last = 0, epochs * len(batches)
        for _ in range(epochs):
            for b in r.permutation(len(batches)):
                rows = [samples[i] for i in batches[b]]
                y = np.array([y for _, y in rows])
                g = self.gradients([x for x, _ in rows], y, weight[y])
                step += 1
                now = rate * (1 - 0.9 * step / last)
                for k, p in self.p.items():
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                    p -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def pooled(self, words: list[str], size: int = 2048) -> np.ndarray:
        """For each run the sum of its positions' log-probabilities, and their number as the last column."""
        raw = [as_bytes(w) for w in words]
        out = np.zeros((len(words), len(self.langs) + 1))
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        for at in range(0, len(order), size):
            take = order[at : at + size]
            o, mask, _ = self.positions([raw[i] for i in take])
            out[take, :-1] = (o * mask[:, :, None]).sum(axis=0)
            out[take, -1] = mask.sum(axis=0)
        return out

    def label(self, text: str) -> list[list[str]]:
        """The label of every byte position of every run of a text."""
        out = []
        for w in runs(text):
            o, _, _ = self.positions([as_bytes(w)])
            out.append([self.langs[k] for k in o[:, 0].argmax(axis=1)])
        return out


def train(docs: DataFrame, per_lang: int = PER_LANG, per_doc: int = RUNS) -> Network | None:
    """docs: doc_id, text, lang. None if no document outside fold 2 has a language and a letter."""
    w = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", "lang")
    chosen = ids.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_lang).select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang"))
    # at most per_lang ids a language
    picked = docs.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang"))).select("doc_id", "text", "lang")

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, lang in zip(b["doc_id"], b["text"], b["lang"], strict=True):
                seen = list(dict.fromkeys(x for x in runs(t or "") if has_letter(x)))
                step = max(1, len(seen) // per_doc)
                rows += [(d, lang, x) for x in seen[::step][:per_doc]]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "run"])

    got = picked.mapInPandas(some, "doc_id long, lang string, run string").toPandas().drop_duplicates(["lang", "run"]).sort_values(["lang", "run"])
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    index = {x: i for i, x in enumerate(langs)}
    return Network(langs).fit([(as_bytes(w), index[x]) for w, x in zip(got["run"], got["lang"], strict=True)])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, lang_score (its pooled probability) and positions (labelled) per row of docs (doc_id, text).

    Null, empty and letterless texts: `und`, score 0. Repeated rows are predicted alike; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache: dict[str, np.ndarray] = {}
        for b in batches:
            texts = b.column("text").to_pylist()
            counted = [Counter(runs(t)) if t and m is not None else Counter() for t in texts]
            if len(cache) > MOST_CACHED:
                cache.clear()
            new = list({w for c in counted for w in c if w not in cache})
            for at in range(0, len(new), 1 << 16):
                part = [w for w in new[at : at + (1 << 16)]]
                letters = [w for w in part if has_letter(w)]
                cache.update(dict.fromkeys(part))
                if letters:
                    cache.update(zip(letters, m.pooled(letters), strict=True))
            names, scores, sizes = [], [], []
            for c in counted:
                rows = [(cache[w], n) for w, n in sorted(c.items()) if cache[w] is not None]
                if not rows:
                    names.append(UNKNOWN), scores.append(0.0), sizes.append(0)
                    continue
                s = np.array([n for _, n in rows], dtype=float) @ np.array([r for r, _ in rows])
                mean = s[:-1] / s[-1]
                p = np.exp(mean - mean.max())
                k = int(mean.argmax())
                names.append(m.langs[k]), scores.append(round(float(p[k] / p.sum()), 6)), sizes.append(int(s[-1]))
            cols = [b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "lang_score", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, lang_score double, positions long")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned outside fold 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = predict(docs, train(docs))
    return d.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
