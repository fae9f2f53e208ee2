"""A training-data pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Null and empty texts pass the toxicity stage (no evidence), count as copies of each other, are never contaminated,
have no words for the mix, and so end there. Empty tables go through all stages. Columns beyond doc_id, text and
source are carried along untouched (n_chars follows a text that the mix cuts)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionforge.llm import decontam, mixing, neardup, tokenpack, toxicity
from captionforge.llm.common import checkpointed, read

SHINGLE, SIMILARITY, WORDS = 5, 0.8, 2
#: Ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def radius(similarity: float = SIMILARITY, bits: int = 64 * WORDS) -> int:
    """Bits in which the SimHashes of two sets with this Jaccard similarity differ, with three standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Null, empty and wordless texts stay, as do all if there are no labels;
    repeated rows are judged alike, and rows that share an id each by its own text."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("toxic_predicted") == 0).select(*[F.col(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8, candidates by 128-bit SimHash, each link
    verified) one document stays: of those with the least doc_id the one with the least digest of its text.

    Groups are of texts: rows that share an id but not their text are judged apart, and a null id comes last. Null, empty
    and wordless texts are copies of each other. Of rows with the same id and text the one with the least hash of all
    columns stays. An empty table gives an empty one."""
    kept = neardup.representatives(docs.select("doc_id", "text"), SHINGLE, radius(), WORDS, SIMILARITY)
    row = F.struct(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(docs.columns)])
    # rows of one key are combined before the shuffle, so many equal ones are few
    one = docs.select(neardup.row_key(F.col("doc_id"), F.col("text")).alias("row_key"), row.alias("row"), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("h"))
    one = one.groupBy("row_key").agg(F.min_by("row", "h").alias("row"))
    return one.join(kept, "row_key", "left_semi").select(*[F.col(f"row.`{i}`").alias(c) for i, c in enumerate(docs.columns)])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go. Null and empty texts stay; rows that share an id are judged
    each by its own text, repeated rows alike; an empty benchmark takes nothing away."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("k"), decontam.tokens(F.col("text")).alias("t"))
    hits = decontam.contaminated(keyed, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"))
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k")), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order of virtual finish time; a document taken twice has two rows, one taken in part a cut text. Texts
    without words aren't taken; a null source is a source of its own; repeated rows are separate documents."""
    return mixing.mix(docs).select(*[F.col(c) for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-stride shards in training order, written to the shared folder; their records, read back. Null and empty texts
    give their end token alone; repeated rows are separate documents; an empty table gives no records."""
    return tokenpack.sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: The toxicity and token stages can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is materialised in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
