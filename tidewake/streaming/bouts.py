"""Bouts of a stream of predictions. An extension: the analyses themselves are over finished recordings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bout_counts(stream: DataFrame) -> DataFrame:
    """clip_id, rows, bouts so far, updated as rows (clip_id string, t long, pred int) arrive in the order of t in each clip.

    State: last prediction, rows, bouts. Rows of one micro-batch are sorted; a row older than the last one seen is left out.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last, rows, bouts = state.get if state.exists else (-1, -1, 0, 0)
        for pdf in [pd.concat(list(parts))]:
            for t, p in pdf.sort_values("t")[["t", "pred"]].itertuples(index=False):
                if t > last_t:
                    bouts += rows == 0 or p != last
                    last_t, last, rows = int(t), int(p), rows + 1
        state.update((last_t, last, rows, int(bouts)))
        yield pd.DataFrame({"clip_id": [key[0]], "rows": [rows], "bouts": [int(bouts)]})

    return stream.groupBy("clip_id").applyInPandasWithState(step, "clip_id string, rows long, bouts long", "t long, pred int, rows long, bouts long", "update", GroupStateTimeout.NoTimeout)
