"""Folding a stream of display sets as they arrive: state is the first set of each track's open run.

An extension of the batch operator: sets of a track must arrive in order, as they are read from a disc. A run is given
out when a set that doesn't match, or a clear set, closes it; the last run of a track is given out by a clear set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

STATE = "key string, seq long, start_pts long, end_pts long, idx long, n long"
OUT = "file_id string, track long, idx long, seq long, start_ms long, end_ms long, n long"


def fold_stream(sets: DataFrame) -> DataFrame:
    """Rows (file_id, track, seq, start_pts, end_pts, key) of a streaming DataFrame to closed runs, as fold_exact gives them."""

    def fold(group: tuple[Any, ...], batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        file_id, track = group
        key, seq, start, end, idx, n = state.get if state.exists else (None, 0, 0, 0, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples(index=False):
            if key is not None and r.key == key:
                n += 1
                continue
            if key is not None:
                closing = int(r.start_pts) // 90 if r.key is None else int(end) // 90
                out.append((file_id, track, idx, seq, int(start) // 90, closing, n))
                key = None
            if r.key is not None:
                key, seq, start = r.key, int(r.seq), int(r.start_pts)
                end = 0 if pd.isna(r.end_pts) else int(r.end_pts)
                idx, n = idx + 1, 1
        state.update((key, int(seq), int(start), int(end), int(idx), int(n)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return sets.groupBy("file_id", "track").applyInPandasWithState(fold, OUT, STATE, "append", "NoTimeout")
