"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, so that the result has the same length in every engine."""
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column, gap: str = SPACE) -> Column:
    """Array of the pieces between matches of gap; null and empty texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a local master that names none gets a
    temporary folder; on a cluster that would be the driver's own disk, so it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="captionforge-checkpoint-"))
    return sc.getCheckpointDir()


def store(folder: str):
    """The pyarrow file system of a URI and the path in it."""
    from pyarrow import fs

    scheme, rest = folder.split(":", 1) if ":" in folder else ("file", folder)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a:", "s3:", 1))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, **options) -> DataFrame:
    """Cuts the lineage by a table in the shared folder. For loops: Spark plans the next round from the table's true
    size, where a checkpoint keeps an estimate that grows as a product from round to round. options: of the writer."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/table-" in folder:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def slices(batches, rows: int = 256):
    """Arrow batches in pieces, so that no more than `rows` texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, TypeError, OSError):  # other C libraries have none
    _trim = None


def give_back() -> None:
    """Returns memory to the system that nothing uses any more."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow and mapInPandas, with memory given back after each batch. Spark keeps Python workers for later
    tasks, and Arrow's pool keeps what the largest batch took: unless returned, an executor holds that once per worker."""

    def whole(batches: Iterator) -> Iterator:
        def each() -> Iterator:
            for b in batches:
                yield b
                del b
                give_back()

        yield from run(each())
        give_back()

    return whole


def hash_bucket(hex_key: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 that grows with a hexadecimal key (its first 8 digits decide)."""
    first = F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("long")
    return F.floor(first * F.lit(buckets) / F.lit(float(2**32))).cast("long")
