"""Operator 8: token ids as fixed-stride binary shards in training order.

1. Every document is encoded with a public tokenizer (a path, never part of the package) and followed by an end token.
   The ids are written as a packed table in the shared folder, each with its place in the tokens of its input partition.
2. The documents form one stream of tokens, cut every `length` tokens: sequence k holds the tokens k * length to
   (k + 1) * length - 1. Where a partition begins in the stream is the sum of the partitions before it.
3. A keyed Feistel permutation with cycle-walking gives every sequence a slot of the training order.
4. One shuffle by ranges of slots brings the pieces of a shard together; each range writes its shards: files of a fixed
   number of slots, a fixed number of bytes each, so that slot s begins at byte (s % per_shard) * stride of shard
   s // per_shard. A file of document ids by slot stands beside each shard.
5. read() opens the shard and byte of any slot and reads on from there; records() reads the shards back as rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, lean, read as table, shared_folder, slices, store, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary, in a form that never goes back over a run.
PATTERN = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END = 50256
LENGTH, PER_SHARD, KEY = 1024, 1024, "order-1"
#: Tokens that a task cuts at a time.
CHUNK = 1 << 23
#: Of zstd; from so many tokens on they are stored by their ranks.
LEVEL, RANKED = 3, 1 << 13


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = TOKENIZER) -> bytes:
    """The token ids of a whole text as little-endian uint16; null and empty texts have none."""
    return encoder(path).encode_to_numpy(text).astype("<u2").tobytes() if text else b""


# --- the permutation -----------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: two rounds of multiply and shift."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, n: int, key: str, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse) at x.

    A balanced Feistel network permutes the least power of four from n up; values that fall outside 0..n-1 walk on
    along their cycle until they are inside, under four steps on average."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (_mixed(a ^ k) & low), a
            else:
                a, b = b, a ^ (_mixed(b ^ k) & low)
        return (a << np.uint64(half)) | b

    out = np.asarray(x, dtype=np.uint64)
    if n <= 1:
        return out.astype(np.int64)
    out = once(out)
    while True:
        outside = np.nonzero(out >= np.uint64(n))[0]
        if not len(outside):
            return out.astype(np.int64)
        out[outside] = once(out[outside])


# --- the stream ----------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """uint16 tokens, compressed: the number of different ones, these by falling frequency, and the low and the high bytes
    of the tokens' ranks among them. Few tokens, for which the list doesn't pay, stand for themselves behind a 0."""
    codec = pa.Codec("zstd", LEVEL)
    if len(ids) < RANKED:
        return bytes(4) + codec.compress(ids.tobytes(), asbytes=True)
    count = np.bincount(ids, minlength=1 << 16)
    known = np.flatnonzero(count)
    known = known[np.argsort(-count[known], kind="stable")].astype("<u2")
    rank = np.zeros(1 << 16, dtype="<u2")
    rank[known] = np.arange(len(known))
    planes = rank[ids].view(np.uint8).reshape(-1, 2).T
    return len(known).to_bytes(4, "little") + codec.compress(known.tobytes() + planes.tobytes(), asbytes=True)


def unpack(body: bytes, n: int) -> np.ndarray:
    """The n tokens of pack()."""
    k = int.from_bytes(body[:4], "little")
    x = pa.Codec("zstd").decompress(body[4:], 2 * (k + n), asbytes=True)
    if not k:
        return np.frombuffer(x, dtype="<u2")
    planes = np.frombuffer(x, dtype=np.uint8, offset=2 * k).reshape(2, n)
    return np.frombuffer(x, dtype="<u2", count=k)[np.ascontiguousarray(planes.T).view("<u2")[:, 0]]


def encoded(docs: DataFrame, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """Rows of docs (doc_id, text), some at a time: part (the input partition), at (tokens of the partition before them),
    doc_ids, sizes (tokens of each with the end token), n (tokens of all) and ids (these tokens, packed)."""
    last = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            ids = [encode(t, path) + last for t in b.column("text").to_pylist()]
            sizes = pa.array([len(x) // 2 for x in ids], pa.int64())
            whole = np.frombuffer(b"".join(ids), dtype="<u2")
            ends = pa.array([0, len(ids)], pa.int32())
            who = b.column("doc_id").cast(pa.int64())
            cols = [
                pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.ListArray.from_arrays(ends, who), pa.ListArray.from_arrays(ends, sizes),
                pa.array([len(whole)], pa.int64()), pa.array([pack(whole)], pa.binary()),
            ]
            at += len(whole)
            yield pa.RecordBatch.from_arrays(cols, names=["part", "at", "doc_ids", "sizes", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "part int, at long, doc_ids array<long>, sizes array<long>, n long, ids binary")


def _pieces(at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents at `at` with n tokens, cut at multiples of length: the document, begin and end (in the stream) of each piece."""
    first, last = at // length, (at + n - 1) // length
    count = last - first + 1
    doc = np.repeat(np.arange(len(at)), count)
    seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, np.maximum(at[doc], seq * length), np.minimum((at + n)[doc], (seq + 1) * length)


_HEAD = np.dtype([("slot", "<i8"), ("place", "<i4"), ("n", "<i4"), ("doc", "<i8"), ("null", "?")])


def write_shards(docs: DataFrame, folder: str, path: str = TOKENIZER, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, end: int = END) -> DataFrame:
    """Writes the documents (doc_id, text; other columns are ignored) as shards and returns shard, path, records,
    sequences (of the whole order) and sha256 of each, as a table in the shared folder.

    folder: a URI that all executors reach (through pyarrow.fs). Null and empty texts give their end token alone; repeated
    rows are separate documents; an empty table gives no shards. The last sequence of the stream is padded with the end
    token. The stream follows the rows as they are stored, so reruns over the same files give the same bytes.

    A shard is one task's work and has a fixed size; it is written to a temporary name and moved, so a repeated task
    leaves a whole file. The ids' table is deleted when all shards stand."""
    spark = docs.sparkSession
    t = written(encoded(docs, path, end), compression="uncompressed")  # the ids are packed
    sums = written(t.groupBy("part").agg(F.sum("n").alias("n")))  # one row per input partition
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = -(-total // length)
    base = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = t.join(F.broadcast(base), "part").select((F.col("base") + F.col("at")).alias("at"), "doc_ids", "sizes", "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in slices([b], 1):
                held.append(row)
                size += row.column("n")[0].as_py()
                if size > CHUNK:
                    yield grouped(held)
                    held, size = [], 0
        if held:
            yield grouped(held)

    def grouped(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One row per shard that the documents have tokens for: the heads of the pieces and their tokens, both packed."""
        b = pa.Table.from_batches(held).combine_chunks()
        rows, totals = b.column("at").to_numpy(), b.column("n").to_numpy()
        ids = pa.concat_arrays([x.flatten() for x in b.column("doc_ids").chunks])
        sizes = pa.concat_arrays([x.flatten() for x in b.column("sizes").chunks]).to_numpy()
        null, who = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        tokens = np.concatenate([unpack(x, m) for x, m in zip(b.column("ids").to_pylist(), totals.tolist(), strict=True)])
        begins = np.cumsum(sizes) - sizes
        # a row's documents follow each other in the stream
        docs_of = np.array([len(x) for x in b.column("sizes").to_pylist()])
        at = begins + np.repeat(rows - (np.cumsum(totals) - totals), docs_of)
        doc, lo, hi = _pieces(at, sizes, length)
        slot = feistel(lo // length, n, key)
        head = np.zeros(len(doc), dtype=_HEAD)
        head["slot"], head["place"], head["n"], head["doc"], head["null"] = slot, lo % length, hi - lo, who[doc], null[doc]
        start = begins[doc] + lo - at[doc]
        shard = slot // per_shard
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)) if len(order) else []
        cols: list[list] = [[], [], [], []]
        codec = pa.Codec("zstd", LEVEL)
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            rows = order[x:y]
            body = np.concatenate([tokens[start[i] : start[i] + head["n"][i]] for i in rows])
            for c, v in zip(cols, (int(shard[rows[0]]), len(rows), codec.compress(head[rows].tobytes(), asbytes=True), pack(body)), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "pieces", "head", "body"])

    # the slots are 0..n-1, so even ranges of shards are known without a sample
    shards = -(-n // per_shard)
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = placed.mapInArrow(lean(cut), "shard long, pieces long, head binary, body binary")
    dealt = dealt.repartitionById(parts, F.floor(F.col("shard") * parts / max(1, shards)).cast("int")).sortWithinPartitions("shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = store(folder)
        where.create_dir(at, recursive=True)
        open_, held = None, []
        for b in batches:
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "pieces", "head", "body")), strict=True):
                if shard != open_ and held:
                    yield close(where, at, open_, held)
                    held = []
                open_ = shard
                held.append(tuple(row))
        if held:
            yield close(where, at, open_, held)

    def close(where, at: str, shard: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        records = min(per_shard, n - shard * per_shard)
        whole = np.full(records * length, end, dtype="<u2")
        heads, codec = [], pa.Codec("zstd")
        while held:
            count, head, body = held.pop()
            h = np.frombuffer(codec.decompress(head, count * _HEAD.itemsize, asbytes=True), dtype=_HEAD)
            tokens = unpack(body, int(h["n"].sum(dtype=np.int64)))
            to = (h["slot"] - shard * per_shard) * length + h["place"]
            ends = np.cumsum(h["n"].astype(np.int64))
            for a, m, e in zip(to.tolist(), h["n"].tolist(), ends.tolist(), strict=True):
                whole[a : a + m] = tokens[e - m : e]
            heads.append(h)
        h = np.concatenate(heads)
        h = h[np.lexsort([h["place"], h["slot"]])]
        ids = pa.table({"slot": h["slot"], "place": h["place"], "n": h["n"], "doc_id": pa.array(h["doc"], mask=h["null"].copy())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, ids.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(ids)
        name = _name(at, shard)
        for to, data in ((f"{name}.docs", sink.getvalue()), (name, pa.py_buffer(whole))):
            temp = f"{at}/.{shard:08d}-{uuid.uuid4().hex}"
            with where.open_output_stream(temp) as f:
                f.write(data)
            where.move(temp, to)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([name]), pa.array([records], pa.int64()), pa.array([n], pa.int64()), pa.array([hashlib.sha256(whole).hexdigest()])],
            names=["shard", "path", "records", "sequences", "sha256"])

    done = written(dealt.mapInArrow(lean(write), "shard long, path string, records long, sequences long, sha256 string"))
    dropped(t), dropped(sums)
    return done


def _name(at: str, shard: int) -> str:
    return f"{at}/shard-{shard:08d}.bin"


def read(folder: str, slot: int, records: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """`records` sequences from `slot` on, (records, length), fewer at the end of the order: opens the shard of the slot,
    seeks to its byte and reads on through the shards that follow. A reader that stopped after slot s resumes at s + 1."""
    where, at = store(folder)
    out, stride = [], 2 * length
    while records > 0:
        shard, begin = divmod(slot, per_shard)
        info = where.get_file_info(_name(at, shard))
        if not info.is_file or begin * stride >= info.size:
            break
        with where.open_input_file(info.path) as f:
            f.seek(begin * stride)
            got = np.frombuffer(f.read(min(records, per_shard - begin) * stride), dtype="<u2").reshape(-1, length)
        out.append(got)
        slot, records = slot + len(got), records - len(got)
    return np.concatenate(out) if out else np.zeros((0, length), dtype="<u2")


def records(shards: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY) -> DataFrame:
    """The rows of write_shards() read back from the files, one row per sequence: slot, shard, at_byte (in its shard),
    sequence, n_tokens (without padding), doc_ids (of its pieces, in order) and tokens (2 * length bytes)."""
    kinds = {"slot": pa.int64(), "shard": pa.int64(), "at_byte": pa.int64(), "sequence": pa.int64(), "n_tokens": pa.int32(), "doc_ids": pa.list_(pa.int64()), "tokens": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = store(folder)
        for b in batches:
            for shard, n in zip(b.column("shard").to_pylist(), b.column("sequences").to_pylist(), strict=True):
                first = shard * per_shard
                tokens = read(folder, first, per_shard, length, per_shard)
                with where.open_input_file(f"{_name(at, shard)}.docs") as f:
                    ids = pa.ipc.open_file(f).read_all()
                slot, size = ids.column("slot").to_numpy(), ids.column("n").to_numpy()
                count = np.bincount(slot - first, minlength=len(tokens))
                slots = np.arange(first, first + len(tokens))
                cols = [
                    pa.array(slots), pa.array(np.full(len(slots), shard)), pa.array((slots - first) * 2 * length), pa.array(feistel(slots, n, key, inverse=True)),
                    pa.array(np.bincount(slot - first, weights=size, minlength=len(tokens)).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), ids.column("doc_id").combine_chunks()),
                    pa.array([r.tobytes() for r in tokens], pa.binary()),
                ]
                whole = pa.RecordBatch.from_arrays(cols, names=list(kinds))
                yield from (whole.slice(i, 256) for i in range(0, whole.num_rows, 256))

    # a row is a shard's work
    dealt = shards.repartition(max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return dealt.mapInArrow(lean(run), "slot long, shard long, at_byte long, sequence long, n_tokens int, doc_ids array<long>, tokens binary")


def sequences(docs: DataFrame, folder: str | None = None, path: str = TOKENIZER, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, end: int = END) -> DataFrame:
    """Shards of docs in folder (a new one in the shared folder unless given), read back as records()."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    return records(write_shards(docs, folder, path, length, per_shard, key, end), folder, length, per_shard, key)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in shards in training order; the records are read back from the shards."""
    return sequences(table(spark, sf_dir, "documents"))
