"""A subtitle corpus from the documents table: lines decorated so that every text rule has something to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The decorations by (doc_id * 31 + line_no) % 16; L is the line.
PATTERNS = (
    "♪ L ♪", "♪L♪", "<i>♪ L ♪</i>", "♪ <i>L</i> ♪", "♫ L", "L ♫", "[MAN]L", "BOB: L",
    "… L", '" L "', "it ’ s L", "-[X]L", "Hi.L", "wolfDoctor L", "<i>L</i>", "... L",
)
#: In files of odd number these stand in their place.
TIGHT = {0: "♪L♪", 2: "<i>♪L♪</i>", 3: "♪<i>L</i>♪"}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, doc_id, line_no, raw, pattern and text. In files whose number 5 divides, even lines have ♫ for ♪."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the file's number once a document: in one step with the lines it would be looked for in each of them
    d = d.select("doc_id", F.col("source").alias("file_id"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("no"), "text")
    d = d.select("doc_id", "file_id", "no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    no = F.col("no")
    pattern = F.pmod(F.col("doc_id") * 31 + F.col("line_no"), F.lit(16)).cast("int")
    # looked up, not chosen by cases: a generated method that is too long for the JVM to compile stays interpreted
    parts = [form.split("L") for form in (*PATTERNS, *[TIGHT.get(i, form) for i, form in enumerate(PATTERNS)])]
    at = pattern + F.when(F.pmod(no, F.lit(2)) == 1, len(PATTERNS)).otherwise(0)
    before, after = (F.get(F.array(*[F.lit(x[side]) for x in parts]), at) for side in (0, 1))
    text = F.concat(before, F.col("raw"), after)
    swap = (F.pmod(no, F.lit(5)) == 0) & (F.pmod(F.col("line_no"), F.lit(2)) == 0)
    text = F.when(swap, F.replace(text, F.lit("♪"), F.lit("♫"))).otherwise(text)
    return d.select("file_id", "doc_id", F.col("line_no").cast("long").alias("line_no"), "raw", pattern.alias("pattern"), text.alias("text"))


def entries(decorated: DataFrame) -> DataFrame:
    """Two lines to an entry: file_id, idx (doc_id * 100000 + line_no div 2), start_ms, end_ms, text and vlm_lines (pattern 5)."""
    idx = F.col("doc_id") * 100000 + F.floor(F.col("line_no") / 2)
    each = F.array_sort(F.collect_list(F.struct("line_no", "text", (F.col("pattern") == 5).alias("vlm"))))
    d = decorated.groupBy("file_id", idx.alias("idx")).agg(each.alias("l"))
    return d.select(
        "file_id", "idx", (F.col("idx") * 40).alias("start_ms"), (F.col("idx") * 40 + 1500).alias("end_ms"),
        F.array_join(F.transform("l", lambda x: x.text), "\n").alias("text"), F.transform("l", lambda x: x.vlm).alias("vlm_lines"),
    )
