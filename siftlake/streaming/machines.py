"""Stateful operators of streams with state that is typed, bounded and forgotten in time; it lives in the state store and comes back from the checkpoint.

Nulls, ties and odd rows: a null key is a key of its own; changes that are not newer than the last seen of their root are left out, so a log that is read twice counts once; a fragment that
repeats (line, value) counts once; empty batches give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that such operators need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROOT = "root long, state string, last_seq long"


class RootMachine(StatefulProcessor):
    """One value for each root: its state, and the last change that made it."""

    def __init__(self, states: dict[str, dict[str, str]]):
        self._steps = states

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._now = handle.getValueState("now", "state string, last_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, last = self._now.get() if self._now.exists() else ("indexing", 0)
        frames = pd.concat(list(rows)).sort_values("seq")
        for kind, seq in zip(frames["kind"], frames["seq"], strict=True):
            if seq > last:
                now, last = self._steps[now].get(kind, now), int(seq)
        self._now.update((now, last))
        yield pd.DataFrame([(key[0], now, last)], columns=["root", "state", "last_seq"])

    def close(self) -> None:
        pass


class FragmentCache(StatefulProcessor):
    """The last ``most`` fragments of a path and prefix, by (line, value), as a map; the least one goes when there are more, and with ``hold_ms`` each by itself after so long."""

    def __init__(self, near: int, most: int, hold_ms: int | None):
        self._near, self._most, self._hold_ms = near, most, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getMapState("held", "line long, value string", "seen long", ttlDurationMs=self._hold_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(int(line), value) for line, value in self._held.keys()}
        found = []
        for frame in rows:
            for line, value in sorted(zip(frame["line"].astype(int), frame["value"], strict=True)):
                if (line, value) in held:
                    continue
                for other, text in sorted(held):
                    if abs(line - other) < self._near:
                        found += [(key[0], key[1], line, other, value + text), (key[0], key[1], other, line, text + value)]
                held.add((line, value))
                self._held.updateValue((line, value), (1,))
                if len(held) > self._most:
                    least = min(held)
                    held.remove(least)
                    self._held.removeKey(least)
        yield pd.DataFrame(found, columns=["path", "prefix", "line", "line_b", "joined"])

    def close(self) -> None:
        pass


def _machine(rows: DataFrame, keys: list[str], make: Callable[[], StatefulProcessor], schema: str, mode: str, time: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(*keys).transformWithStateInPandas(make(), schema, mode, time)


def root_machine(changes: DataFrame, states: dict[str, dict[str, str]]) -> DataFrame:
    """A stream of changes (root, kind, seq): root, state and last_seq after each batch."""
    return _machine(changes.select("root", "kind", "seq"), ["root"], lambda: RootMachine(states), ROOT, "Update", "None")


def fragment_cache(fragments: DataFrame, near: int = 100, most: int = 64, hold_ms: int | None = None) -> DataFrame:
    """A stream of fragments (path, prefix, line, value) joined, both ways, with those of the same path and prefix that are held and near.

    ``hold_ms``: how long a fragment is held. State that expires by the clock asks for batches without data, so such a stream runs on a timed trigger: one for what is available now would not end.
    """
    return _machine(fragments.select("path", "prefix", "line", "value"), ["path", "prefix"], lambda: FragmentCache(near, most, hold_ms), "path string, prefix string, line long, line_b long, joined string", "Append", "None" if hold_ms is None else "ProcessingTime")
