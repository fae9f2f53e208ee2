"""Cutting a plan where several later branches read the same rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, materialised in the folder that spark.checkpoint.dir names (shared by all executors, so that a lost one costs
    nothing). Only a local master that names none gets a temporary folder; on a cluster that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="captionforge-"))
    return df.checkpoint(eager=True)
