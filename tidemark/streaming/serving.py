"""Streams: request counters by window, and a cache with expiry and a capacity."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.serving import request_counters


def stream_counters(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Request counters of a stream; a window closes ``late`` after its end, later events are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return request_counters(timed.withWatermark(ts, late), ts, width)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what its source holds now, into a Parquet table at ``path``, and reads that.

    Progress is kept beside the table, so that a run that is broken off goes on where it was.
    """
    query = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


class _Cache(StatefulProcessor):
    """One shard's entries: a row of state each, written only when it changes, and a timer for its end.

    ``due`` has, for each expiry, the keys put with it.  A batch reads a shard's entries
    once, which the search by similarity needs anyway; the order of their last use is kept
    in memory meanwhile.
    """

    def __init__(self, threshold: float, ttl_us: int, capacity: int):
        self.threshold, self.ttl, self.capacity = threshold, ttl_us, capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "vector array<double>, put long, used long, nth long")
        self.due = handle.getMapState("due", "at long", "keys array<string>")
        self.clock = handle.getValueState("clock", "now long, nth long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, nth = self.clock.get() if self.clock.exists() else (None, 0)
        found = sorted(((k[0], list(v)) for k, v in self.entries.iterator()), key=lambda e: e[1][3])
        held = OrderedDict(found)  # in the order of putting
        order = OrderedDict((k, None) for k, _ in sorted(found, key=lambda e: (e[1][2], e[1][3])))  # of last use
        vectors = _Vectors()
        for k, v in found:
            vectors.add(k, _unit(v[0]))
        changed, gone, ends, out = set(), set(), {}, []

        def leave(name: str) -> None:
            del held[name], order[name]
            vectors.remove(name)
            gone.add(name)

        batch = pd.concat(list(rows)).sort_values(["t", "request_id"])
        for rid, name, t, vector in zip(batch["request_id"], batch["key"], batch["t"], batch["vector"], strict=True):
            now = int(t) if now is None else max(now, int(t))
            while held and next(iter(held.values()))[1] < now - self.ttl:
                leave(next(iter(held)))
            own = _unit(vector)
            hit, level, similarity, evicted = None, "miss", None, False
            if name in held:
                hit, level = name, "exact"
            elif own is not None:
                likest, s = vectors.best(own)
                if likest is not None and s >= self.threshold:
                    hit, level, similarity = likest, "semantic", s
            if hit is not None:
                held[hit][2] = now
                order.move_to_end(hit)
                changed.add(hit)
            elif name is not None:
                if evicted := len(held) >= self.capacity:
                    leave(next(iter(order)))
                nth += 1
                held[name] = [None if vector is None else [float(x) for x in vector], now, now, nth]
                order[name] = None
                vectors.add(name, own)
                changed.add(name)
                ends.setdefault((now + self.ttl) // 1000 + 1, []).append(name)
            out.append((key[0], rid, level, hit, similarity, evicted))
        for k in gone - held.keys():
            self.entries.removeKey((k,))
        for k in changed & held.keys():
            self.entries.updateValue((k,), tuple(held[k]))
        for at, names in ends.items():
            known = self.due.getValue((at,))[0] if self.due.containsKey((at,)) else []
            self.due.updateValue((at,), ([*known, *names],))
            self.handle.registerTimer(at)
        self.clock.update((now, nth))
        yield pd.DataFrame(out, columns=["shard", "request_id", "level", "matched", "similarity", "evicted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for k in self.due.getValue((at,))[0] if self.due.containsKey((at,)) else []:
            if self.entries.containsKey((k,)) and (self.entries.getValue((k,))[1] + self.ttl) // 1000 < at:
                self.entries.removeKey((k,))
        self.due.removeKey((at,))
        if not any(True for _ in self.due.keys()):
            self.clock.clear()
        return iter([])

    def close(self) -> None:
        pass


def _unit(vector) -> np.ndarray | None:
    """The vector at length 1; none for null, empty and zero vectors, which are like nothing."""
    if vector is None or not len(vector):
        return None
    v = np.asarray(vector, float)
    n = float(np.sqrt(v @ v))
    return v / n if n > 0 and np.isfinite(n) else None


class _Vectors:
    """Unit vectors by key in the order of their adding; rows of those removed are made up for now and then."""

    def __init__(self):
        self.keys: list[str | None] = []
        self.rows: np.ndarray | None = None
        self.place: dict[str, int] = {}

    def add(self, key: str, v: np.ndarray | None) -> None:
        if v is None:
            return
        if self.rows is None:
            self.rows = np.zeros((16, len(v)))
        if len(self.keys) == len(self.rows):
            live = [i for i, k in enumerate(self.keys) if k is not None]
            kept = self.rows[live]
            self.rows = np.zeros((max(16, 2 * len(live)), self.rows.shape[1]))
            self.rows[: len(live)] = kept
            self.keys = [self.keys[i] for i in live]
            self.place = {k: i for i, k in enumerate(self.keys)}
        self.place[key] = len(self.keys)
        self.rows[len(self.keys)] = v
        self.keys.append(key)

    def remove(self, key: str) -> None:
        if (at := self.place.pop(key, None)) is not None:
            self.keys[at] = None
            self.rows[at] = np.nan

    def best(self, v: np.ndarray) -> tuple[str | None, float]:
        """The likest key, of equals the one added first, and how like it is."""
        if not self.place:
            return None, 0.0
        s = np.nan_to_num(self.rows[: len(self.keys)] @ v, nan=-2.0)
        at = int(s.argmax())
        return self.keys[at], float(s[at])


def semantic_cache(requests: DataFrame, shard: str = "shard", threshold: float = 0.92, ttl_s: int = 3600, capacity: int = 1000, late: str = "10 minutes") -> DataFrame:
    """A cache of two levels over a stream of ``shard, request_id, ts, key, vector``.

    A request hits on an equal key, else on the most similar live vector (of equals the
    one put first) if the cosine is ``threshold`` or more; else it is put.  Entries live
    ``ttl_s`` seconds from their putting; beyond ``capacity`` the one that was used longest
    ago goes (``evicted``).  ``matched`` is the key of the entry that was hit.  The
    parameters of a request are part of its shard, so that a result is never taken for
    other parameters.

    Time is the requests' own: of a batch they are taken by ``ts`` and id, and a shard's
    clock never goes back, so that a replay of requests in order gives the same, however
    they fall into batches.  Entries leave the state by timers once the watermark, ``late``
    behind the newest request, has passed their end; a stream over what there is
    (``availableNow``) ends.  Requests later than the watermark or without a time get no
    answer, those without a key are never put, and a null vector is like none.

    State is kept by RocksDB (``cache_settings``).
    """
    kind = dict(requests.dtypes)[shard]
    ts = F.col("ts").cast("timestamp")
    rows = requests.select(F.col(shard).alias("shard"), F.col("request_id").cast("long").alias("request_id"), ts.alias("ts"), F.unix_micros(ts).alias("t"), F.col("key").cast("string").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    out = f"shard {kind}, request_id long, level string, matched string, similarity double, evicted boolean"
    return rows.withWatermark("ts", late).groupBy("shard").transformWithStateInPandas(_Cache(threshold, ttl_s * 1_000_000, capacity), out, "Append", "EventTime")


@contextmanager
def cache_settings(spark: SparkSession) -> Iterator[None]:
    """The state store that state by entry and timers need, for streams started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
