"""Operator 9: SimHash near-duplicates by tiled exact comparison.

1. Each document gets a SimHash of its word shingles (XXH64; a bit is 1 if set in over half of the hashes).
2. Equal fingerprints are collapsed before anything is compared, so a group of copies counts once.
3. The distinct fingerprints are range-sorted by the population counts of their blocks and cut into tiles of bounded
   size. A tile pair is skipped if its population counts differ by more than the radius (the sum over blocks of the
   gap between the two tiles' ranges; each differing bit changes one block's count by one). The pairs that remain
   are compared exactly in numpy: exclusive-or and bit counts, with the same skipping for sub-tiles.
4. Within a tile, components are found at once and one fingerprint stands for each; a tile pair gives the links of a
   spanning forest over the components of its two tiles, which keeps every component of the whole.
5. Components: least-label propagation with pointer jumping over the links, checkpointed each round.

verified_near_duplicates goes on from there: the components of candidate links are cut into pieces, and the links
within each pair of pieces are checked on the exact shingles before components are built again from those that hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, UPPER, WORD, checkpointed, dropped, lean, read, slices, written

TILE, SUB = 16384, 256
#: Small inputs are cut into so many tiles at least, to be compared in parallel.
LEAST_TILES = 12
BLOCKS = 4  # population counts per 64-bit word
#: Shingle sets of a candidate component that are compared at a time: about so many of each of two pieces at most. Smaller
#: components are dealt over up to SPREAD pieces of LEAST_PIECE sets or more, so that no task has much more than others.
PIECE, LEAST_PIECE, SPREAD = 1024, 128, 16
_ASCII = str.maketrans(UPPER, LOWER)


def shingles(text: str, k: int) -> list[str]:
    """The k-word shingles of a text, repeats included; of fewer words the whole sequence; none: empty."""
    w = _split(text.translate(_ASCII))
    if len(w) <= k:
        return [" ".join(w)] if w else []
    return list(map(" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


_WORD = re.compile(WORD)
_OTHER = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _split(text: str) -> list[str]:
    """The runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. str.split()
    also splits at other white space, so it is for texts without any."""
    return _WORD.findall(text) if _OTHER.search(text) else text.split()


def fingerprint(text: str | None, k: int, words: int = 1, seed: int = 42) -> tuple[int, ...]:
    """words 64-bit words; word i hashes with seed + i."""
    sh = shingles(text or "", k)
    if not sh:
        return (0,) * words
    return _majority([s.encode("utf-8", "replace") for s in sh], words, seed)


def _hashes(raw: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(b, seed) for b in raw), dtype="<u8", count=len(raw))


def _majority(raw: list[bytes], words: int, seed: int, first: np.ndarray | None = None) -> tuple[int, ...]:
    """first: the hashes with `seed`, if known."""
    out = []
    for i in range(words):
        h = first if first is not None and i == 0 else _hashes(raw, seed + i)
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 1 << 16):
            votes += np.unpackbits(h[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]))
    return tuple(out)


def shingle_set(text: str | None, k: int, seed: int = 42) -> tuple[list[bytes], np.ndarray]:
    """The different shingles of a text, and their hashes in the same order."""
    raw = [s.encode("utf-8", "replace") for s in dict.fromkeys(shingles(text or "", k))]
    return raw, _hashes(raw, seed)


def rank(doc_id: Column) -> Column:
    """20 digits in the order of the ids; null comes last."""
    zero = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.coalesce(F.lpad((doc_id.cast("decimal(20,0)") + zero).cast("string"), 20, "0"), F.lit("~" * 20))


def ranked_id(name: Column) -> Column:
    """The id that a name begins with the rank of."""
    zero = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(~name.startswith("~"), (F.substring(name, 1, 20).cast("decimal(20,0)") - zero).cast("long"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of the same id and text, in the order of the ids."""
    return F.concat_ws(":", rank(doc_id), F.coalesce(F.md5(text), F.lit("")))


def sketches(docs: DataFrame, k: int, words: int) -> DataFrame:
    """doc_id, fp (the SimHash of the different shingles), key (a digest of the set of them) and row_key for each row of
    docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps, keys = [], []
            for t in b.column("text").to_pylist():
                raw, h = shingle_set(t, k)
                fps.append("".join(f"{w:016x}" for w in _majority(raw, words, 42, h)) if raw else "0" * 16 * words)
                keys.append(xxhash.xxh3_128_hexdigest(np.sort(h).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.string()), pa.array(keys, pa.string()), b.column("row_key")], names=["doc_id", "fp", "key", "row_key"])

    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    return keyed.mapInArrow(lean(run), "doc_id long, fp string, key string, row_key string")


def fingerprints(docs: DataFrame, k: int, words: int = 1) -> DataFrame:
    """doc_id and fp (16 lowercase hex digits per word) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = ["".join(f"{w:016x}" for w in fingerprint(t, k, words)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.string())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fp string")


def pack(fps: list[str], words: int) -> np.ndarray:
    """Hex fingerprints as an array (n, words) of u64."""
    return np.frombuffer(bytes.fromhex("".join(fps)), dtype=">u8").reshape(-1, words).astype("<u8")


def block_counts(a: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit blocks, (n, BLOCKS * words)."""
    return np.bitwise_count(np.ascontiguousarray(a).view("<u2")).astype(np.int16)


def _gaps(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Least Hamming distance that the count ranges of each sub-tile of a and each of b allow."""
    d = np.maximum(lo_a[:, None, :] - hi_b[None, :, :], lo_b[None, :, :] - hi_a[:, None, :])
    return np.maximum(d, 0).sum(axis=2)


def _subs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = block_counts(a)
    at = np.arange(0, len(a), SUB)
    return np.minimum.reduceat(c, at, axis=0), np.maximum.reduceat(c, at, axis=0)


def compare(a: np.ndarray, b: np.ndarray, radius: int, root: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs (row of a, row of b) within radius that join trees of `root`, the forest over the rows of a, then b
    (of a alone if same), until no more can be joined. root is changed in place."""
    lo_a, hi_a = _subs(a)
    lo_b, hi_b = (lo_a, hi_a) if same else _subs(b)
    off = 0 if same else len(a)
    found = []

    def find(x: np.ndarray) -> np.ndarray:
        r = root[x]
        while True:
            up = root[r]
            if np.array_equal(up, r):
                return r
            r = up

    words_a, words_b = ([np.ascontiguousarray(z[:, w]) for w in range(z.shape[1])] for z in (a, b))
    diff, bits = np.empty(SUB * SUB, dtype=np.uint64), np.empty(SUB * SUB, dtype=np.uint8)
    # the first word alone rules out most pairs, unless the radius comes near the 32 bits that any two words differ in
    whole, more = 1 < len(words_a) <= 3 and radius > 26, np.empty(SUB * SUB, dtype=np.uint8)
    for i, j in zip(*np.nonzero(_gaps(lo_a, hi_a, lo_b, hi_b) <= radius), strict=True):
        if same and j < i:
            continue
        x, y = words_a[0][i * SUB : (i + 1) * SUB], words_b[0][j * SUB : (j + 1) * SUB]
        n = len(x) * len(y)
        np.bitwise_xor(x[:, None], y[None, :], out=diff[:n].reshape(len(x), len(y)))
        np.bitwise_count(diff[:n], out=bits[:n])
        for u, v in zip(words_a[1:], words_b[1:], strict=True) if whole else ():
            np.bitwise_xor(u[i * SUB : (i + 1) * SUB, None], v[None, j * SUB : (j + 1) * SUB], out=diff[:n].reshape(len(x), len(y)))
            np.bitwise_count(diff[:n], out=more[:n])
            np.add(bits[:n], more[:n], out=bits[:n])
        near = np.flatnonzero(bits[:n] <= radius)
        if not len(near):
            continue
        p, q = np.divmod(near, len(y))
        if len(words_a) > 1 and not whole:
            rest = bits[near].astype(np.int16)
            for u, v in zip(words_a[1:], words_b[1:], strict=True):
                rest += np.bitwise_count(u[i * SUB + p] ^ v[j * SUB + q])
            p, q = p[rest <= radius], q[rest <= radius]
            if not len(p):
                continue
        p, q = p + i * SUB, q + j * SUB
        todo = np.arange(len(p))
        while len(todo):
            rp, rq = find(p[todo]), find(q[todo] + off)
            todo, rp, rq = todo[rp != rq], rp[rp != rq], rq[rp != rq]
            # one link for each pair of trees; joining trees may make others superfluous
            _, first = np.unique(rp * len(root) + rq, return_index=True)
            for t in first:
                u, v = int(rp[t]), int(rq[t])
                while root[u] != u:
                    u = int(root[u])
                while root[v] != v:
                    v = int(root[v])
                if u != v:
                    root[max(u, v)] = min(u, v)
                    found.append((int(p[todo[t]]), int(q[todo[t]])))
    return found


def flat(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def tiles(fps: DataFrame, radius: int, words: int) -> DataFrame:
    """The distinct fingerprints of column fp, range-sorted by block population counts and cut into tiles.

    Columns tile (long), lo and hi (array<int>, ranges of the block counts), blob (the fingerprints) and tree (int32:
    for each fingerprint the row that stands for its component within the tile). A tile is a run of at most TILE
    fingerprints in sort order; its number follows from the numbers of fingerprints with smaller counts (at most
    17 ** BLOCKS sums) and the place among those with equal ones."""
    n = fps.count()
    size = min(TILE, max(1, -(-n // LEAST_TILES)))
    counts = [F.bit_count(F.conv(F.substring("fp", 4 * i + 1, 4), 16, 10).cast("int")) for i in range(4 * words)]
    key = counts[0].cast("int")
    for c in counts[1:BLOCKS]:
        key = key * 17 + c
    d = fps.select("fp", key.alias("key"))
    hist = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hist = hist.select("key", before.alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("key").orderBy("fp")) - 1
    d = d.join(F.broadcast(hist), "key").select("fp", F.floor(rank / size).cast("long").alias("tile"))
    lists = d.groupBy("tile").agg(F.collect_list("fp").alias("fps"))  # at most TILE of them
    parts = max(1, min(-(-n // size), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tile, held in zip(b["tile"], b["fps"], strict=True):
                a = pack(list(held), words)
                c = block_counts(a)
                order = np.lexsort([*a.T[::-1], *c.T[::-1]])
                a, c = a[order], c[order]
                root = np.arange(len(a))
                compare(a, a, radius, root, True)
                yield pd.DataFrame({"tile": [tile], "lo": [c.min(axis=0).tolist()], "hi": [c.max(axis=0).tolist()], "blob": [a.tobytes()], "tree": [flat(root).astype("<i4").tobytes()]})

    return lists.repartition(parts, "tile").mapInPandas(lean(cut), "tile long, lo array<int>, hi array<int>, blob binary, tree binary")


def _hex(a: np.ndarray) -> list[str]:
    return ["".join(f"{int(w):016x}" for w in row) for row in a]


def members(t: DataFrame, words: int) -> DataFrame:
    """fp and tree: the fingerprint that stands for its component within its tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for x, tree in zip(p["blob"], p["tree"], strict=True):
                names = np.array(_hex(np.frombuffer(x, dtype="<u8").reshape(-1, words)), dtype=object)
                yield pd.DataFrame({"fp": names, "tree": names[np.frombuffer(tree, dtype="<i4")]})

    return t.select("blob", "tree").mapInPandas(lean(run), "fp string, tree string")


def links(t: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """a, b: standing fingerprints of components of different tiles that are linked; for each tile pair a spanning
    forest, so no more links than it has components."""
    # tile pairs by their ranges alone: one row per tile of TILE fingerprints, nothing of the fingerprints themselves
    # the first block's counts rise with the tiles, so the tiles that may be near enough follow each other
    n = t.count()
    first = BLOCKS - 1  # of a word's blocks the highest
    least = dict(t.groupBy(F.get("lo", F.lit(first))).count().collect())  # 17 counts at most
    upto = F.array(*[F.lit(sum(k for x, k in least.items() if x <= c)) for c in range(17)])
    ranges = t.select("tile", "lo", "hi", F.row_number().over(W.orderBy("tile")).alias("at"))
    last = F.get(upto, F.least(F.lit(16), F.get("hi", F.lit(first)) + radius)).cast("int")
    later = F.when(F.col("at") < last, F.sequence(F.col("at") + 1, last))
    a = ranges.select(F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(later).alias("at"))
    b = ranges.select(F.col("tile").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), "at")
    gap = F.aggregate(
        F.arrays_zip("lo_a", "hi_a", "lo_b", "hi_b"), F.lit(0),
        lambda s, x: s + F.greatest(F.lit(0), x.lo_a - x.hi_b, x.lo_b - x.hi_a),
    )
    pairs = a.join(b, "at").filter(gap <= radius).select("a", "b")
    left = t.select(F.col("tile").alias("a"), F.col("blob").alias("blob_a"), F.col("tree").alias("tree_a"))
    right = t.select(F.col("tile").alias("b"), F.col("blob").alias("blob_b"), F.col("tree").alias("tree_b"))
    # a row is one tile pair, at most twice TILE fingerprints; the pairs are dealt evenly
    parts = max(1, min(n * (n - 1) // 2, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    both = pairs.join(left, "a").join(right, "b").repartition(parts, "a", "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for x, y, s, r in zip(p["blob_a"], p["blob_b"], p["tree_a"], p["tree_b"], strict=True):
                u, v = (np.frombuffer(z, dtype="<u8").reshape(-1, words) for z in (x, y))
                ta, tb = (np.frombuffer(z, dtype="<i4").astype(np.int64) for z in (s, r))
                found = compare(u, v, radius, np.concatenate([ta, tb + len(u)]), False)
                if found:
                    i, j = np.array(found).T
                    yield pd.DataFrame({"a": _hex(u[ta[i]]), "b": _hex(v[tb[j]])})

    return both.select("blob_a", "blob_b", "tree_a", "tree_b").mapInPandas(lean(run), "a string, b string")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root: the least node of each node's component, for the nodes that have edges (a, b).

    Each round a node takes the least label among its neighbours and tells it to the node that it points to; then it
    takes the label of its label. So trees are hooked to each other by their roots and paths shorten by half: the
    rounds grow as the logarithm of the nodes. It ends when nothing changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both)
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = label.join(near, "node").select("node", "root", F.least("root", "m").alias("m"))
        # what a node hears, the node it points to hears as well
        heard = step.select("node", "m", F.col("root").alias("old")).union(step.select(F.col("root").alias("node"), "m", F.lit(None).alias("old")))
        heard = heard.groupBy("node").agg(F.min("m").alias("m"), F.max("old").alias("root"))
        up = heard.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        new = written(heard.join(up, "m").select("node", F.least("m", "mm").alias("new"), "root"))
        dropped(label)
        label = new.select("node", F.col("new").alias("root"))
        if new.filter("new <> root").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def roots(fps: DataFrame, radius: int, words: int) -> DataFrame:
    """fp and root, the name of its component, for fps: different fingerprints fp, and least (an id or null).

    A tree of a tile is named by the rank of the least id of its fingerprints and the one that stands for it. So the
    least name of a component tells its least id, and no rows need be brought together by component. What is joined to
    the fingerprints is stored first, so that Spark may split a tree or fingerprint with many rows."""
    t = checkpointed(tiles(fps.select("fp"), radius, words))
    held = members(t, words)
    named = held.join(fps, "fp").groupBy("tree").agg(F.min("least").alias("least"))
    named = checkpointed(named.select("tree", F.concat_ws(":", rank(F.col("least")), "tree").alias("name")))
    ends = [named.select(F.col("tree").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab"]
    edges = links(t, radius, words).join(ends[0], "a").join(ends[1], "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    root = components(edges)
    table = checkpointed(named.join(root.withColumnRenamed("node", "name"), "name", "left").select("tree", F.coalesce("root", "name").alias("root")))
    return held.join(table, "tree").select("fp", "root")


def near_duplicates(docs: DataFrame, k: int = 5, radius: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of docs (doc_id, text; other columns are ignored).

    k: words in a shingle. words: 64-bit words of the fingerprint. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows stay repeated. component_id is the least non-null doc_id reachable; null if all
    ids reachable are null. An empty table gives an empty result."""
    fp = checkpointed(fingerprints(docs, k, words))
    # copies first: one row for each distinct fingerprint
    reps = checkpointed(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    known = checkpointed(roots(reps, radius, words).select(F.col("fp").alias("__fp"), ranked_id(F.col("root")).alias("component_id")))
    return fp.join(known, F.col("fp") == F.col("__fp")).select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def verify(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows whose fingerprints (n, words) are within radius and whose sets of
    hashes have this Jaccard similarity at least. Pairs that verified links connect already aren't compared."""
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    mark = np.zeros(1 + max((int(x.max()) for x in ids if len(x)), default=0), dtype=np.int64)
    label = np.arange(len(sets))
    found = []
    for i in range(len(sets) - 1):
        if not size[i]:
            continue
        far = sum(np.bitwise_count(fps[i + 1 :, w] ^ fps[i, w]).astype(np.int16) for w in range(fps.shape[1]))
        some = i + 1 + np.flatnonzero(far <= radius)
        least, most = np.minimum(size[some], size[i]), np.maximum(size[some], size[i])
        some = some[(label[some] != label[i]) & (size[some] > 0) & (least >= similarity * most - 1e-9)]
        if not len(some):
            continue
        mark[ids[i]] = 1
        starts = np.cumsum(size[some]) - size[some]
        both = np.add.reduceat(mark[np.concatenate([ids[j] for j in some])], starts)
        mark[ids[i]] = 0
        for j in some[both >= similarity * (size[i] + size[some] - both) - 1e-9]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                found.append((i, int(j)))
    return found


def verified_links(docs: DataFrame, candidates: DataFrame, k: int, radius: int, words: int, similarity: float) -> DataFrame:
    """a, b: names of shingle sets that are linked; candidates: name, row_key (of a row that has the set), fp and root of
    the candidate component.

    A component of n sets is dealt over n / PIECE pieces, or SPREAD smaller ones, by the hashes of their names, and every two pieces are compared,
    so that no task holds more than two pieces, however large a component is."""
    n = checkpointed(candidates.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    pieces = F.greatest(F.ceil(F.col("n") / PIECE), F.least(F.lit(SPREAD), F.ceil(F.col("n") / LEAST_PIECE)))
    held = candidates.join(n, "root").withColumn("pieces", pieces.cast("int"))
    held = checkpointed(held.select("name", "row_key", "fp", "root", "pieces", F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int").alias("piece")))
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), "text").join(held.select(F.col("row_key").alias("rk")), "rk", "left_semi").dropDuplicates(["rk"])
    asked = texts.join(held, F.col("rk") == F.col("row_key")).select("name", "fp", "root", "pieces", "piece", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.sort(shingle_set(t, k)[1]).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], names=["name", "fp", "root", "pieces", "piece", "held"])

    sets = asked.mapInArrow(lean(hashed), "name string, fp string, root string, pieces int, piece int, held binary")
    other = F.when(F.col("pieces") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("pieces") - 1), F.col("piece")))
    units = sets.withColumn("other", F.explode(other)).select("root", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "name", "fp", "held")
    # the rows of a unit, about two pieces at most, follow each other
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.repartition(parts, "root", "p", "q").sortWithinPartitions("root", "p", "q", "name")

    def found(unit: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
        held = [np.frombuffer(x, dtype="<u8") for _, _, x in unit]
        pairs = verify(pack([f for _, f, _ in unit], words), held, radius, similarity)
        ends = [pa.array([unit[pair[e]][0] for pair in pairs], pa.string()) for e in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, unit = None, []
        for b in batches:
            for piece in slices([b]):
                names = zip(*(piece.column(c).to_pylist() for c in ("root", "p", "q")), strict=True)
                for name, *row in zip(names, *(piece.column(c).to_pylist() for c in ("name", "fp", "held")), strict=True):
                    if name != at:
                        if len(unit) > 1:
                            yield found(unit)
                        at, unit = name, []
                    unit.append(tuple(row))
        if len(unit) > 1:
            yield found(unit)

    return units.mapInArrow(lean(run), "a string, b string")


def _verified(docs: DataFrame, fp: DataFrame, k: int, radius: int, words: int, similarity: float) -> DataFrame:
    """key, name and root (a name) for each different shingle set of fp, the sketches of docs. A name is the least
    row_key of the rows with the set, and its key."""
    reps = fp.groupBy("key").agg(F.min("row_key").alias("row_key"), F.min("fp").alias("fp"), F.min("doc_id").alias("least"))
    reps = checkpointed(reps.select("key", "row_key", "fp", "least", F.concat_ws(":", "row_key", "key").alias("name")))
    found = checkpointed(roots(reps.groupBy("fp").agg(F.min("least").alias("least")), radius, words))
    candidates = checkpointed(reps.join(found, "fp").select("key", "name", "row_key", "fp", "root"))
    root = components(verified_links(docs, candidates.drop("key"), k, radius, words, similarity))
    return candidates.select("key", "row_key", "name").join(root.withColumnRenamed("node", "name"), "name", "left").select("key", "row_key", "name", F.coalesce("root", "name").alias("root"))


def verified_near_duplicates(docs: DataFrame, k: int, radius: int, words: int, similarity: float) -> DataFrame:
    """doc_id, fingerprint and component_id as near_duplicates gives them, but two documents are linked only if the
    Jaccard similarity of their sets of k-word shingles (compared by 64-bit hashes) is `similarity` at least.

    SimHashes of the sets within radius give the candidates. Equal sets, as those of null and empty texts, are one."""
    fp = checkpointed(sketches(docs, k, words))
    known = checkpointed(_verified(docs, fp, k, radius, words, similarity).select("key", ranked_id(F.col("root")).alias("component_id")))
    return fp.join(known, "key").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, k: int, radius: int, words: int, similarity: float) -> DataFrame:
    """row_key of one document of each group of verified_near_duplicates: of those with the least id (null ids last) the
    one with the least digest of its text. Groups are of rows, so different texts under one id are judged apart."""
    fp = checkpointed(sketches(docs, k, words))
    return _verified(docs, fp, k, radius, words, similarity).filter(F.col("name") == F.col("root")).select("row_key")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all of documents: 4-word shingles, 64 bits, links at 4 or fewer differing bits."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, radius=4)
