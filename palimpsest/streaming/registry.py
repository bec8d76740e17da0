"""The versioned key registry as a stream: one state per key, one output row per write."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def stream_versions(events: DataFrame, keys: list[str], order: str, value: str, value_type: str = "double") -> DataFrame:
    """keys, version, order, value, prior: as `operators.state.versions`, for a streaming frame whose batches come in order.

    Rows of one batch are taken in order; the state of a key is its version and the order of its last write. A row that comes in a later
    batch than rows of a greater order is the next version all the same. Rows with a null order take no part.
    """
    ship(events.sparkSession)
    rows = events.where(F.col(order).isNotNull()).select(*keys, order, value)
    types = dict(rows.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def write(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        version, prior = state.get if state.exists else (0, None)
        frame = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = frame[[*keys, order, value]].copy()
        out.insert(len(keys), "version", range(version + 1, version + 1 + len(frame)))
        out["prior"] = pd.array([prior, *frame[order].tolist()[:-1]], dtype="Int64")
        state.update((version + len(frame), int(frame[order].iloc[-1])))
        yield out

    return rows.groupBy(*keys).applyInPandasWithState(write, f"{head}, version long, {order} {types[order]}, {value} {value_type}, prior long", "version long, prior long", "append", "NoTimeout")
