"""Stateful stream operators: snapshot diffs per url, a sliding-window rate limiter, and a keyed cache.

Each keeps its state in the state store by key (transformWithState), so state survives executors and is bounded per key.
The same processors run on batch tables through replay_*.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Requests that a key may make within a window of seconds.
LIMIT, WINDOW_S = 100, 86_400

_LIMIT_OUT = "key string, request_id long, ts double, accepted boolean"


class RateLimiter(StatefulProcessor):
    """Accepts a request if fewer than `limit` accepted ones of its key are younger than the window."""

    def __init__(self, limit: int = LIMIT, window_s: int = WINDOW_S) -> None:
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = list(self.times.get()[0]) if self.times.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        seen, out = accept(seen, batch["ts"].tolist(), self.limit, self.window_s)
        self.times.update((seen,))
        yield batch.assign(key=key[0], accepted=out)[["key", "request_id", "ts", "accepted"]]

    def close(self) -> None:
        pass


def accept(seen: list[float], times: list[float], limit: int, window_s: int) -> tuple[list[float], list[bool]]:
    """The accepted times still in the window, and the verdict on each new time, in order."""
    out = []
    for now in times:
        seen = [t for t in seen if now - t < window_s]
        out.append(len(seen) < limit)
        if out[-1]:
            seen.append(now)
    return seen, out


def limit_stream(requests: DataFrame, *, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """A stream of key, request_id, ts (seconds) with the verdict on each."""
    return requests.groupBy("key").transformWithStateInPandas(RateLimiter(limit, window_s), _LIMIT_OUT, "Append", "None")


def replay_limit(requests: DataFrame, *, limit: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """The same over a table, a key's requests in the order of their time. A key's requests go through one task in Arrow
    batches that are sorted before; only the accepted times of a window are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen = None, []
        for batch in batches:
            verdicts = []
            for k, t in zip(batch["key"], batch["ts"], strict=True):
                if k != key:
                    key, seen = k, []
                seen, one = accept(seen, [t], limit, window_s)
                verdicts += one
            yield batch.assign(accepted=verdicts)[["key", "request_id", "ts", "accepted"]]

    dealt = requests.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "request_id", "ts").repartition("key").sortWithinPartitions("key", "ts", "request_id")
    return dealt.mapInPandas(run, _LIMIT_OUT)


class SnapshotDiff(StatefulProcessor):
    """Emits what changed in a url's set of fingerprints since its last snapshot; the first snapshot is all new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, entries map<string,string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, old = self.last.get() if self.last.exists() else (None, None)
        old = dict(old) if old is not None else None
        out = []
        for at, snapshot in pd.concat(list(rows)).groupby("version", sort=True):
            if version is not None and at <= version:
                continue  # late: the baseline has moved on
            new = dict(zip(snapshot["fp"], snapshot["content_hash"], strict=True))
            out += [(key[0], int(at), kind, fp, old is None) for kind, fp in changes(old or {}, new)]
            version, old = int(at), new
        if version is not None:
            self.last.update((version, old))
        yield pd.DataFrame(out, columns=["url", "version", "change", "fp", "is_full"])

    def close(self) -> None:
        pass


def changes(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str]]:
    """(change, fingerprint) in order of kind and fingerprint."""
    appeared = [("appeared", k) for k in sorted(new.keys() - old.keys())]
    changed = [("changed", k) for k in sorted(new.keys() & old.keys()) if new[k] != old[k]]
    return appeared + changed + [("disappeared", k) for k in sorted(old.keys() - new.keys())]


def snapshot_stream(fingerprints: DataFrame) -> DataFrame:
    """A stream of url, version, fp, content_hash as a stream of changes."""
    return fingerprints.groupBy("url").transformWithStateInPandas(SnapshotDiff(), "url string, version long, change string, fp string, is_full boolean", "Append", "None")


class KeyedCache(StatefulProcessor):
    """Last write wins per key; a NULL value removes it. Emits the value after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "at double, selector string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("at").iloc[-1]
        if not self.value.exists() or self.value.get()[0] <= last["at"]:
            self.value.update((float(last["at"]), last["selector"]))
        at, selector = self.value.get()
        yield pd.DataFrame([(key[0], at, selector)], columns=["cache_key", "at", "selector"])

    def close(self) -> None:
        pass


def cache_stream(writes: DataFrame) -> DataFrame:
    """A stream of cache_key, at, selector as a stream of each key's value."""
    return writes.groupBy("cache_key").transformWithStateInPandas(KeyedCache(), "cache_key string, at double, selector string", "Update", "None")
