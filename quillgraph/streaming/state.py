"""Keyed state over streams (ST4, ST5): the newest rows of a session, and a cache with time to live and hit counts."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SESSION_OUT = "user_id long, n long, newest long"
SESSION_STATE = "ids array<bigint>"


def keep_newest(most: int = 20):
    """A function for ``applyInPandasWithState``: a session's ``most`` newest event ids."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids = list(state.get[0]) if state.exists else []
        for f in frames:
            ids = sorted({*ids, *f["event_id"].tolist()})[-most:]
        state.update((ids,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(ids)], "newest": [ids[-1]]})

    return update


def session_memory(stream: DataFrame, most: int = 20) -> DataFrame:
    """ST5: (user_id, n, newest) after each batch, with at most ``most`` ids of a session in state."""
    return stream.groupBy("user_id").applyInPandasWithState(keep_newest(most), SESSION_OUT, SESSION_STATE, "update", "NoTimeout")


class TimedCache:
    """ST4: least recently used entries go first, entries older than ``ttl`` seconds are misses."""

    def __init__(self, size: int = 128, ttl: float = 300.0, clock=None):
        import time

        self.size, self.ttl, self.clock = size, ttl, clock or time.monotonic
        self.rows: OrderedDict = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key):
        at, value = self.rows.get(key, (None, None))
        if at is None or self.clock() - at > self.ttl:
            self.rows.pop(key, None)
            self.misses += 1
            return None
        self.rows.move_to_end(key)
        self.hits += 1
        return value

    def put(self, key, value) -> None:
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.rows), "hits": self.hits, "misses": self.misses, "hit_rate": self.hits / asked if asked else 0.0}
