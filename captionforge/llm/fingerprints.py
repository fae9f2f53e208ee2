"""Operator 7: document fingerprints by SimHash, and search by permuted block tables.

A document's terms are its words paired with the word that follows. Each occurrence votes with the term's 128 hash
bits, so a term weighs as much as it occurs; a bit of the fingerprint is set if over half of the votes are. The votes
are counted four bits to a long, in lanes of 16 bits, over chunks of terms too short to overflow a lane.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ascii_lower, checkpointed, read, words

BITS = 128
CHUNK = 60_000  # under 2**16, what a lane holds
#: Ranges of doc_id hold about so many rows; over FINE ranges they grow, up to MOST_ROWS rows each.
ROWS_A_BUCKET, FINE, MOST_ROWS = 64, 4096, 100_000
#: Hamming radius of the search that op7 makes.
RADIUS = 3
SPREAD, LANES = 0x0000200040008001, 0x0001000100010001


def terms(t: str) -> Column:
    """64-bit hashes of the terms, one per word. t: a column of words, not an expression, which would be evaluated
    again for each of them."""
    return F.transform(t, lambda x, i: F.xxhash64(x, F.get(F.col(t), i + 1)))


def _votes(h: Column) -> list[Column]:
    """For each four bits of the two hash words a long with the bits in four lanes."""
    out = []
    for word in (F.col(h), F.when(F.col(h).isNotNull(), F.xxhash64(F.col(h)))):  # no term, no vote
        for j in range(16):
            nibble = F.shiftrightunsigned(word, 4 * j).bitwiseAND(F.lit(15))
            out.append((nibble * F.lit(SPREAD)).bitwiseAND(F.lit(LANES)))
    return out


def simhash(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp (32 hexadecimal digits) per distinct keys of docs.

    Null and empty texts have fingerprint zero. Where docs is already distributed by some of the keys, nothing is
    shuffled; otherwise one row of partial votes per document is."""
    d = docs.select(*keys, words(ascii_lower(F.col(text))).alias("__t"))
    d = d.select(*keys, F.posexplode_outer(terms("__t")).alias("__at", "__h"))
    d = d.select(*keys, "__h", F.floor(F.coalesce("__at", F.lit(0)) / CHUNK).cast("int").alias("__chunk"))
    sums = [F.coalesce(F.sum(v), F.lit(0)).alias(f"__v{j}") for j, v in enumerate(_votes("__h"))]
    d = d.groupBy(*keys, "__chunk").agg(F.count("__h").alias("__n"), *sums)
    part = F.struct(F.col("__n").alias("n"), F.array(*[f"__v{j}" for j in range(BITS // 4)]).alias("v"))
    d = d.groupBy(*keys).agg(F.collect_list(part).alias("__parts"))
    total = F.aggregate("__parts", F.lit(0).cast("long"), lambda s, p: s + p.n)

    d = d.withColumn("__total", total)

    def votes(j: Column, k: int) -> Column:
        lane = lambda p: F.shiftrightunsigned(F.get(p.v, j), 16 * k).bitwiseAND(F.lit(65535))
        return F.aggregate("__parts", F.lit(0).cast("long"), lambda s, p: s + lane(p))

    def nibble(j: Column) -> Column:
        one = [F.when(votes(j, k) * 2 > F.col("__total"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(4)]
        return one[0] + one[1] + one[2] + one[3]

    hexed = F.transform(F.sequence(F.lit(BITS // 4 - 1), F.lit(0), F.lit(-1)), lambda j: F.lower(F.hex(nibble(j))))
    return d.select(*keys, F.array_join(hexed, "").alias("fp"))


def differing(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hexadecimal."""
    total = None
    for i in range(BITS // 32):
        x, y = (F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long") for c in (a, b))
        one = F.bit_count(x.bitwiseXOR(y))
        total = one if total is None else total + one
    return total


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return F.lit(1.0) - differing(a, b) / F.lit(float(BITS))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with bucket, rn, own, and nxt: the text of the next document by descending doc_id.

    Null ids come last; of equal ids the lesser text comes first; after the last document comes the first. The rows are
    cut into ranges of doc_id of about ROWS_A_BUCKET rows (up to MOST_ROWS, where there would be more than FINE ranges); a
    copy of each range's first row (own is false) goes to the range before, so that one shuffle by range brings every
    document and its successor together. What the driver gets is a cut point and a first id for each range."""
    ids = docs.select("doc_id")
    n = ids.count()
    nb = max(1, min(FINE, n // ROWS_A_BUCKET), n // MOST_ROWS)
    cuts: list[int] = []
    if nb > 1:
        got = ids.agg(F.percentile_approx("doc_id", [i / nb for i in range(1, nb)], max(10_000, 2 * nb))).first()[0]
        cuts = sorted(set(got or []))

    def bucket(c: Column) -> Column:
        """0 for null, else 1 + the number of cut points up to c; looked up in two steps."""
        if not cuts:
            return F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1))
        all_cuts = F.array(*[F.lit(int(x)).cast("long") for x in cuts])
        step = math.isqrt(len(cuts)) + 1
        heads = F.array(*[F.lit(int(x)).cast("long") for x in cuts[step - 1 :: step]]).cast("array<bigint>")
        outer = F.size(F.filter(heads, lambda x: x <= c))
        inner = F.size(F.filter(F.slice(all_cuts, outer * step + 1, step), lambda x: x <= c))
        return F.when(c.isNull(), F.lit(0)).otherwise(outer * step + inner + 1)

    firsts = ids.groupBy(bucket(F.col("doc_id")).alias("bucket")).agg(F.max("doc_id").alias("first")).orderBy(F.desc("bucket")).collect()
    # the first id of a range belongs also to the range before it, the very first to the last
    also = [(r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    table = docs.sparkSession.createDataFrame(also, "first long, also int")
    d = docs.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(bucket(F.col("doc_id")).alias("bucket"), F.lit(True).alias("own"))
    other = F.struct(F.col("also").alias("bucket"), F.lit(False).alias("own"))
    d = d.select("doc_id", "text", F.inline(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, other))))
    w = W.partitionBy("bucket").orderBy(F.desc("own"), F.desc_nulls_last("doc_id"), F.asc("text"))
    return d.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("nxt"))


def edited(text: Column, nxt: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many, or all, of nxt."""
    t, u = F.coalesce(text, F.lit("")), F.coalesce(nxt, F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.length(t) - half), F.substring(u, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp per row of docs (doc_id, text; other columns are ignored).

    Null and empty texts: fingerprint zero. Repeated rows stay repeated. An empty table gives an empty result."""
    keyed = docs.select("doc_id", F.xxhash64(F.col("text")).alias("__k"), F.coalesce(F.length("text"), F.lit(-1)).alias("__l"), "text")
    fps = simhash(keyed.dropDuplicates(["__k", "__l"]), ["__k", "__l"], "text")
    return keyed.drop("text").join(fps, ["__k", "__l"]).select("doc_id", "fp")


def within_radius(fps: DataFrame, queries: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """query and fp: all distinct fingerprints of fps.fp within radius bits of each distinct one of queries.fp.

    The bits are cut into `blocks` blocks (radius + 1 unless given); at most `radius` of them can differ, so for at least
    one choice of blocks - radius blocks a pair agrees on all of them. There is a table for every choice, keyed by the
    bits of its blocks; equal fingerprints are collapsed before, and Spark splits skewed keys of the join."""
    from itertools import combinations

    blocks = blocks or radius + 1
    digits = BITS // 4
    edge = [round(i * digits / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = [F.concat(F.lit(f"{n}:"), *[F.substring("fp", edge[b] + 1, edge[b + 1] - edge[b]) for b in c]) for n, c in enumerate(choices)]
        return df.select("fp").distinct().select(F.col("fp").alias(name), F.explode(F.array(*keys)).alias("key"))

    both = tables(queries, "query").join(tables(fps, "fp"), "key")
    return both.filter(differing(F.col("query"), F.col("fp")) <= radius).select("query", "fp").distinct()


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next's.

    n_near: for documents whose id is divisible by 20, how many others the block tables find within RADIUS bits; else null."""
    d = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    keys = ["bucket", "own", "rn", "doc_id", "n_chars", "sha"]
    e = edited(F.col("text"), F.col("nxt"))
    d = d.select("bucket", "own", "rn", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce("text", F.lit("")).alias("text"), e.alias("edited"))
    d = d.select("bucket", "own", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), F.inline(F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("which"), F.when(F.col("own"), F.col("edited")).alias("body")),
    )))
    fps = simhash(d, [*keys, "which"], "body")
    fps = fps.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"))
    w = W.partitionBy("bucket").orderBy("rn")
    out = fps.select("*", F.lead("fp").over(w).alias("nfp")).filter("own")
    out = checkpointed(out.select("doc_id", "n_chars", "sha", "fp", "efp", "nfp"))
    # the search: every document whose id is divisible by 20 against all, copies collapsed
    asked = out.filter(F.pmod("doc_id", F.lit(20)) == 0)
    size = out.groupBy(F.col("fp").alias("s_fp")).agg(F.count(F.lit(1)).alias("n"))
    near = within_radius(out.select("fp"), asked.select("fp"), RADIUS).join(size, F.col("fp") == F.col("s_fp"))
    near = checkpointed(near.groupBy("query").agg(F.sum("n").alias("n")))
    out = out.join(near, (F.col("fp") == F.col("query")) & (F.pmod("doc_id", F.lit(20)) == 0), "left")
    return out.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
        (F.col("n") - 1).alias("n_near"),
    )
