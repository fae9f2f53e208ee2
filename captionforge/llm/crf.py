"""A linear-chain conditional random field in numpy: training by full-batch gradients, Viterbi in padded batches."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class CRF:
    """weights: feature -> label scores; trans[a, b]: label b after a; start, end: labels at the ends of a sequence."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.index: dict[str, int] = {}
        n = len(labels)
        self.weights = np.zeros((0, n))
        self.trans, self.start, self.end = np.zeros((n, n)), np.zeros(n), np.zeros(n)

    def score(self, features: list[str]) -> np.ndarray:
        """Sum of the weights of the features that are known."""
        at = [self.index[f] for f in features if f in self.index]
        return self.weights[at].sum(axis=0) if at else np.zeros(len(self.labels))

    def fit(self, sequences: list[list[list[str]]], tags: list[list[int]], rounds: int = 150, rate: float = 0.15, l2: float = 0.02) -> CRF:
        """sequences: for each position a list of features. Adam on the mean negative log-likelihood with an L2 term."""
        keep = [i for i, s in enumerate(sequences) if s]
        sequences, tags = [sequences[i] for i in keep], [tags[i] for i in keep]
        for s in sequences:
            for fs in s:
                for f in fs:
                    self.index.setdefault(f, len(self.index))
        n, t, k = len(sequences), max(map(len, sequences)), len(self.labels)
        sizes = np.array(list(map(len, sequences)))
        rows, cells = [], []
        for i, s in enumerate(sequences):
            for j, fs in enumerate(s):
                rows += [self.index[f] for f in fs]
                cells += [i * t + j] * len(fs)
        rows, cells = np.array(rows), np.array(cells)
        gold = np.zeros((n, t), dtype=int)
        for i, g in enumerate(tags):
            gold[i, : len(g)] = g
        mask = np.arange(t)[None, :] < sizes[:, None]
        self.weights = np.zeros((len(self.index), k))
        params = [self.weights, self.trans, self.start, self.end]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        last = sizes - 1
        who = np.arange(n)
        for step in range(1, rounds + 1):
            em = np.zeros((n * t, k))
            np.add.at(em, cells, self.weights[rows])
            em = em.reshape(n, t, k)
            al, be = np.zeros((n, t, k)), np.zeros((n, t, k))
            al[:, 0] = self.start + em[:, 0]
            for j in range(1, t):
                nxt = _lse(al[:, j - 1, :, None] + self.trans[None], 1) + em[:, j]
                al[:, j] = np.where(mask[:, j, None], nxt, al[:, j - 1])
            z = _lse(al[who, last] + self.end, 1)
            be[:, t - 1] = self.end
            for j in range(t - 2, -1, -1):
                nxt = _lse(self.trans[None] + (em[:, j + 1] + be[:, j + 1])[:, None, :], 2)
                be[:, j] = np.where(mask[:, j + 1, None], nxt, self.end)
            p = np.exp(al + be - z[:, None, None]) * mask[:, :, None]
            diff = p.copy()
            np.subtract.at(diff, (*np.nonzero(mask), gold[mask]), 1.0)
            g_w = np.zeros_like(self.weights)
            np.add.at(g_w, rows, diff.reshape(n * t, k)[cells])
            g_t = np.zeros_like(self.trans)
            for j in range(1, t):
                on = mask[:, j]
                pair = np.exp(al[on, j - 1, :, None] + self.trans[None] + (em[on, j] + be[on, j])[:, None, :] - z[on, None, None])
                g_t += pair.sum(axis=0)
                np.subtract.at(g_t, (gold[on, j - 1], gold[on, j]), 1.0)
            g_s = diff[:, 0].sum(axis=0)
            g_e = p[who, last].sum(axis=0)
            np.subtract.at(g_e, gold[who, last], 1.0)
            for q, (w, g) in enumerate(zip(params, [g_w, g_t, g_s, g_e], strict=True)):
                g = g / n + l2 * w / n
                first[q] = 0.9 * first[q] + 0.1 * g
                second[q] = 0.99 * second[q] + 0.01 * g * g
                w -= rate * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-8)
        return self

    def viterbi(self, emissions: list[np.ndarray], most: int = 1 << 18) -> list[np.ndarray]:
        """Best label sequence for each (length, labels) array; sequences of like length share a padded batch."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(emissions)
        order = sorted((i for i in range(len(emissions)) if len(emissions[i])), key=lambda i: len(emissions[i]))
        at = 0
        while at < len(order):
            batch = [order[at]]
            while at + len(batch) < len(order) and len(emissions[order[at + len(batch)]]) * (len(batch) + 1) <= most:
                batch.append(order[at + len(batch)])
            at += len(batch)
            for i, path in zip(batch, self._paths([emissions[i] for i in batch]), strict=True):
                out[i] = path
        return out

    def _paths(self, ems: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array(list(map(len, ems)))
        n, t, k = len(ems), int(sizes.max()), len(self.labels)
        em = np.zeros((t, n, k))
        for i, e in enumerate(ems):
            em[: len(e), i] = e
        back = np.zeros((t, n, k), dtype=np.int8)
        score = self.start + em[0]
        ended = np.where((sizes == 1)[:, None], score + self.end, 0.0)
        for j in range(1, t):
            step = score[:, :, None] + self.trans[None]
            back[j] = step.argmax(axis=1)
            score = step.max(axis=1) + em[j]
            done = sizes == j + 1
            if done.any():
                ended[done] = score[done] + self.end
        label = ended.argmax(axis=1)
        paths = np.zeros((t, n), dtype=np.int8)
        for j in range(t - 1, -1, -1):
            if j < t - 1:
                inside = sizes > j + 1
                label = np.where(inside, back[j + 1, np.arange(n), label], label)
            paths[j] = label
        return [paths[: sizes[i], i] for i in range(n)]
