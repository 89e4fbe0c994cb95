"""Sliding-window rate limit (ST3): rejected requests do not count against the limit, so it is a recurrence per key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def rate_limit(requests: DataFrame, key: str, at: str, order: str, most: int = 60, seconds: float = 60.0) -> DataFrame:
    """(key, order, allowed, retry_after) for each request.

    Keys are spread by hash and sorted within partitions; a partition is read as
    a stream of batches with one key's recent hits in memory, at most ``most``
    of them, so a key of any length needs bounded memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hits = None, deque()
        for frame in frames:
            allowed, retry = [], []
            for k, t in zip(frame[key], frame[at].astype("int64") / 1e9 if frame[at].dt.unit == "ns" else frame[at].astype("datetime64[ns, UTC]" if frame[at].dt.tz else "datetime64[ns]").astype("int64") / 1e9, strict=True):
                if k != current:
                    current, hits = k, deque()
                while hits and hits[0] <= t - seconds:
                    hits.popleft()
                ok = len(hits) < most
                allowed.append(ok)
                retry.append(0 if ok else int(hits[0] - (t - seconds)) + 1)
                if ok:
                    hits.append(t)
            yield pd.DataFrame({key: frame[key], order: frame[order], "allowed": allowed, "retry_after": retry})

    rows = requests.select(key, at, order).repartition(key).sortWithinPartitions(key, at, order)
    return rows.mapInPandas(run, f"{key} long, {order} long, allowed boolean, retry_after long")
