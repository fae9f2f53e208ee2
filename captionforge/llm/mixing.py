"""Operator 3: mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents are shuffled by a keyed hash and served in that order, twice at most. A copy's
virtual finish time is the tokens its source has served up to its end, divided by the source's target; time 1 is the
moment at which all flows together have served the whole budget. A range sort by finish time gives the order of the
mix, and the cut at time 1 truncates it at the budget: the one copy of each source in service then is taken in part.
The copies, their finish times and what is taken of them are computed once (copies); the mix and the query read them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpointed, hash_bucket, n_words, read

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, REPEATS, SEED = 1.5, 2, "mix-1"
ROWS_A_BUCKET = 512
#: Bucket sums up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source with source_size and target.

    sizes: columns source, source_size. Sources ordered by code point, null last, take the weights in turn. The
    budget share * total goes to them by weight; a target stops at repeats * source_size and the excess is shared
    anew. The fixed point is target = min(cap, level * weight): with sources in order of cap / weight, the level
    follows from what the sources before have been capped at."""
    w_all = W.orderBy("__ratio", "source").rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy(F.lit(1))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    d = sizes.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * repeats).cast("double"))
    d = d.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    d = d.withColumns({
        "__budget": F.sum("source_size").over(everyone) * F.lit(float(share)),
        "__capped": F.coalesce(F.sum("__cap").over(w_all), F.lit(0.0)),
        "__left_w": F.sum("__w").over(everyone) - F.coalesce(F.sum("__w").over(w_all), F.lit(0.0)),
    })
    # the level if this source is the first that isn't capped; later sources would give lower levels, so the largest holds
    d = d.withColumn("__level", (F.col("__budget") - F.col("__capped")) / F.col("__left_w"))
    d = d.withColumn("__true", F.max(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level"))).over(everyone))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__true"), F.lit(float("inf"))) * F.col("__w"))
    return d.select("source", "source_size", target.alias("target"))


def served(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """docs' rows with size, source_size, target, and start: the words its source serves before it in one pass.

    docs: columns doc_id, source, size, digest (of the text) and any others not beginning with two underscores. The order
    of service is that of a keyed hash of id and text, so rows that share an id, or have none, are dealt out too; only
    equal rows tie, and they are interchangeable."""
    buckets = max(1, -(-docs.count() // ROWS_A_BUCKET))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"), F.lit(seed)))
    d = docs.withColumn("__h", key).withColumn("__bucket", hash_bucket(F.col("__h"), buckets))
    # rows are brought together by (source, bucket) only, so a hot source is dealt over all tasks; what its buckets serve
    # before each other follows from sums of sums: over blocks of buckets, then over the buckets of a block
    sums = checkpointed(d.groupBy(F.col("source"), F.col("__bucket")).agg(F.sum("size").alias("__sum")))
    goal = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, share, repeats)
    width = max(1, math.isqrt(buckets))
    sums = sums.withColumn("__block", F.floor(F.col("__bucket") / width).cast("long"))
    before = lambda by, order: F.coalesce(F.sum("__sum").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("source", "__block").agg(F.sum("__sum").alias("__sum"))
    blocks = blocks.select(F.col("source").alias("__s"), F.col("__block").alias("__k"), before(["source"], "__block").alias("__early"))
    table = sums.select("source", "__block", "__bucket", before(["source", "__block"], "__bucket").alias("__late"))
    table = table.join(blocks, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__k")))
    table = table.select(F.col("source").alias("__source"), F.col("__bucket").alias("__b"), (F.col("__early") + F.col("__late")).alias("__ahead"))
    table = table.join(goal, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
    if sums.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    inside = F.sum("size").over(W.partitionBy("source", "__bucket").orderBy("__h", "size").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("__inside", inside).join(table, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))
    d = d.withColumn("start", F.col("__ahead") + F.col("__inside") - F.col("size"))
    return d.drop("__source", "__b", "__bucket", "__ahead", "__inside", "__h")


def copies(repeats: int = REPEATS) -> Column:
    """array<struct<copy, finish, taken>> for rows of served(): the copies that are in service before virtual time 1, with
    their finish times. A copy that finishes by then is taken whole; of one still in service the words served so far."""
    def one(i: int) -> Column:
        ahead = F.col("source_size") * F.lit(i) + F.col("start")
        finish = F.when(F.col("target") > 0, (ahead + F.col("size")) / F.col("target"))
        part = F.greatest(F.lit(0), F.floor(F.col("target")) - ahead)
        taken = F.when(finish <= 1, F.col("size")).otherwise(F.least(F.col("size"), part)).cast("long")
        return F.struct(F.lit(i).alias("copy"), finish.alias("finish"), taken.alias("taken"))

    return F.filter(F.array(*[one(i) for i in range(repeats)]), lambda x: x.taken > 0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """The mix itself: one row per copy taken, in order of virtual finish time, with the text it contributes.

    Columns: those of docs, plus copy (from 0), taken (words), finish (virtual time). A copy that is taken in part has
    its text cut after the last word taken. Null and empty texts have no words and are never taken; an empty table
    gives an empty mix; a null source is a source of its own; repeated rows are separate documents."""
    names = docs.columns
    d = docs.withColumnsRenamed({c: f"c__{c}" for c in names})
    d = d.withColumns({"doc_id": F.col("c__doc_id"), "source": F.col("c__source"), "size": n_words(F.col("c__text")), "digest": F.coalesce(F.md5("c__text"), F.lit(""))})
    d = served(d, weights, share, repeats, seed)
    d = d.select("*", F.inline(copies(repeats)))
    # the text up to the end of word number `taken`
    pieces = F.regexp_extract_all(F.col("c__text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("taken").cast("int")), "")).otherwise(F.col("c__text"))
    out = [(cut if c == "text" else F.length(cut).cast("long") if c == "n_chars" else F.col(f"c__{c}")).alias(c) for c in names]
    d = d.select(*out, F.col("copy").alias("mix_copy"), F.col("taken").alias("mix_taken"), F.col("finish").alias("mix_finish"), F.col("digest").alias("__digest"))
    order = ["mix_finish", "doc_id", "__digest", "mix_copy"]
    return (d.repartitionByRange(partitions, *order) if partitions else d.repartitionByRange(*order)).sortWithinPartitions(*order).drop("__digest")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words that the mix takes of it, over the whole of documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    d = served(docs).withColumn("copies", copies())
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda s, x: s + x.taken)
    return d.select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"),
        F.size("copies").cast("long").alias("n_copies"), F.get("copies", F.lit(0))["finish"].alias("finish"),
    )


ORACLE_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), '') || ':mix-1') AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS wt,
             CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / wt AS ratio,
        (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
          - coalesce(sum(cap) OVER (ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
      FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE level <= ratio), 'inf'::DOUBLE) * wt) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, start + size AS end1, source_size + start + size AS end2, floor(target)::BIGINT - start AS left1, floor(target)::BIGINT - source_size - start AS left2 FROM r),
k AS (SELECT *, CASE WHEN target > 0 AND end1 / target <= 1 THEN size ELSE greatest(0, least(size, left1)) END AS t1,
        CASE WHEN target > 0 AND end2 / target <= 1 THEN size ELSE greatest(0, least(size, left2)) END AS t2 FROM c)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 AS BIGINT) AS taken, CAST((t1 > 0)::INT + (t2 > 0)::INT AS BIGINT) AS n_copies,
  CASE WHEN t1 > 0 THEN CAST(end1 AS DOUBLE) / target WHEN t2 > 0 THEN CAST(end2 AS DOUBLE) / target END AS finish
FROM k
"""
