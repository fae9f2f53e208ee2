"""SubRip output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalars import srt_time
from ..functions.text_rules import is_blank


def join_lines(lines: DataFrame) -> DataFrame:
    """Entries from lines (file_id, idx, start_ms, end_ms, line_no, text, vlm): text joined by line feeds (null lines
    are empty), vlm_lines in the lines' order."""
    each = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("text", F.lit("")).alias("text"), "vlm")))
    d = lines.groupBy("file_id", "idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), each.alias("__l"))
    return d.select("file_id", "idx", "start_ms", "end_ms", F.array_join(F.transform("__l", lambda x: x.text), "\n").alias("text"), F.transform("__l", lambda x: x.vlm).alias("vlm_lines"))


def numbered(entries: DataFrame) -> DataFrame:
    """Without blank entries, with n: their place in the file's order by idx, from 1."""
    kept = entries.filter(~is_blank(F.col("text")))
    return kept.withColumn("n", F.row_number().over(W.partitionBy("file_id").orderBy("idx")))


def blocks(entries: DataFrame) -> DataFrame:
    """file_id, n and block: the lines of each entry as they stand in the file, with the empty line after them."""
    d = numbered(entries)
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return d.select("file_id", "n", block.alias("block"))


def write(entries: DataFrame, folder: str, language: str = "en") -> DataFrame:
    """Writes <file_id>.<language>.srt (UTF-8, no mark, replacing) for each file; returns file_id, path and entries.

    folder: a path or URI of a store that all executors reach. A file is one task's work, streamed in order, written
    under a temporary name and moved."""
    dealt = blocks(entries).repartition("file_id").sortWithinPartitions("file_id", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))
        where.create_dir(at, recursive=True)
        now, out, temp, n = None, None, "", 0

        def close() -> pd.DataFrame:
            out.close()
            path = f"{at}/{now}.{language}.srt"
            where.move(temp, path)
            return pd.DataFrame({"file_id": [now], "path": [path], "entries": [n]})

        for b in batches:
            for f, text in zip(b["file_id"], b["block"], strict=True):
                if out is None or f != now:
                    if out is not None:
                        yield close()
                    now, n, temp = f, 0, f"{at}/.{uuid.uuid4().hex}"
                    out = where.open_output_stream(temp)
                out.write(text.encode("utf-8"))
                n += 1
        if out is not None:
            yield close()

    return dealt.mapInPandas(run, "file_id string, path string, entries long")


def totals(line_lists: DataFrame) -> DataFrame:
    """file_id and lines: how many line images its sets have. Rows: file_id, lines (array)."""
    return line_lists.groupBy("file_id").agg(F.sum(F.size("lines")).cast("long").alias("lines"))
