"""Keyed state of sensor streams: threshold alerts, and event-time hours with late readings told apart.

State lives in Spark's key-value store, typed and checkpointed; a batch writes what it adds and removes what falls out of the look-back
or has closed, and a silent station's state expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .readings import DEGREES, LOOK_BACK, MIN_READINGS, SIGMAS

#: Readings of a state cell: a batch rewrites the one it begins in and adds others.
CELL = 64
#: A station silent for so long begins anew (milliseconds).
SILENT_MS = 30 * 24 * 3600 * 1000
HOUR, LATE = 3_600_000_000, 600_000_000
TRIPS = "station_id string, seq long, delta double"
HOURS = "station_id string, kind string, start long, n long, total double"


@contextmanager
def key_value_store(spark: SparkSession):
    """Streams started inside keep their state in the key-value store that typed state asks for; settings return to what they were.

    Batches without data, by which timers run on, are off: with state that expires by the clock they would never end.
    """
    ours = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of a batch; its splits meet in no set order."""
    return pd.concat(list(batches)).sort_values(by, kind="stable")


class Trips(StatefulProcessor):
    """The last `look_back` values of a station, in cells of CELL, and how many came in all.

    Cells are numbered by count of readings.  A batch reads those of the look-back, judges its readings at once, writes the
    cells it touches and removes those that have left the look-back; cells that weren't written to for `silent_ms` expire.
    """

    def __init__(self, look_back: int = LOOK_BACK, silent_ms: int = SILENT_MS) -> None:
        self.look_back, self.silent_ms = look_back, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", self.silent_ms)
        self.cells = handle.getMapState("cells", "cell long", "values array<double>", self.silent_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["seq", "temp_c"])
        n = self.seen.get()[0] if self.seen.exists() else 0
        held = {k[0]: list(v[0]) for k, v in self.cells.iterator()} if n else {}
        old = [x for k in sorted(held) for x in held[k]][-self.look_back :]
        hit, delta = trips(np.array(old, float), new["temp_c"].to_numpy(float), self.look_back)
        values, at = held.get(n // CELL, []), n
        for x in new["temp_c"].tolist():
            if at % CELL == 0 and at > n:
                self.cells.updateValue((at // CELL - 1,), (values,))
                values = []
            values.append(x)
            at += 1
        self.cells.updateValue(((at - 1) // CELL,), (values,))
        keep = max(0, at - self.look_back) // CELL
        for k in held:
            if k < keep:
                self.cells.removeKey((k,))
        self.seen.update((at,))
        yield pd.DataFrame({"station_id": key[0], "seq": new["seq"].to_numpy(np.int64)[hit], "delta": delta[hit]})

    def close(self) -> None:
        pass


def trips(old: np.ndarray, new: np.ndarray, look_back: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the new values trip, given those before, and by how much each exceeds the mean of its look-back."""
    v = np.concatenate([old, new])
    at = np.arange(len(old), len(v))
    first = np.maximum(0, at - look_back)
    x = v - (v.mean() if len(v) else 0.0)
    s1, s2 = (np.concatenate([[0.0], np.cumsum(y)]) for y in (x, x * x))
    n = at - first
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (s1[at] - s1[first]) / n
        std = np.sqrt(np.maximum((s2[at] - s2[first]) / n - mean * mean, 0.0))
        delta = x[at] - mean
        hit = (n + 1 >= MIN_READINGS) & (delta >= DEGREES) & ((std == 0) | (delta >= SIGMAS * std))
    return hit, delta


def trip_stream(accepted: DataFrame, look_back: int = LOOK_BACK, silent_ms: int = SILENT_MS) -> DataFrame:
    """(station_id, seq, delta) of the readings that trip, as they arrive; start it within key_value_store()."""
    return accepted.groupBy("station_id").transformWithStateInPandas(Trips(look_back, silent_ms), TRIPS, "append", "ProcessingTime")


class Hours(StatefulProcessor):
    """Open hours of a station (readings and sum of temperatures), and the latest time it has told.

    A station's hour closes once the station itself has told a time that lies `late` behind the hour's end, so what is late depends on
    the order of arrival alone, not on how readings fall in batches or on other stations' clocks.  A reading of a closed hour is late: it's
    counted, not added.  Closed hours go out once and leave the state; open ones are told by open_hours().
    """

    def __init__(self, width: int = HOUR, late: int = LATE, silent_ms: int = SILENT_MS) -> None:
        self.width, self.late, self.silent_ms = width, late, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "us long", self.silent_ms)
        self.hours = handle.getMapState("hours", "start long", "n long, total double", self.silent_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["arrival", "seq"])
        us, temp = new["us"].to_numpy(np.int64), new["temp_c"].to_numpy(float)
        start = us - us % self.width
        before = self.told.get()[0] if self.told.exists() else np.iinfo(np.int64).min // 2
        latest = np.maximum.accumulate(np.append(before, us))
        late = start + self.width + self.late <= latest[:-1]
        out = []
        for s in np.unique(start[late]).tolist():
            mine = late & (start == s)
            out.append((key[0], "late", s, int(mine.sum()), float(temp[mine].sum())))
        for s in np.unique(start[~late]).tolist():
            mine = ~late & (start == s)
            n, total = self.hours.getValue((s,)) if self.hours.containsKey((s,)) else (0, 0.0)
            self.hours.updateValue((s,), (n + int(mine.sum()), total + float(temp[mine].sum())))
        now = int(latest[-1])
        for (s,), (n, total) in list(self.hours.iterator()):
            if s + self.width + self.late <= now:
                out.append((key[0], "closed", s, n, total))
                self.hours.removeKey((s,))
        self.told.update((now,))
        yield pd.DataFrame(out, columns=["station_id", "kind", "start", "n", "total"])

    def close(self) -> None:
        pass


def hour_stream(accepted: DataFrame, width: int = HOUR, late: int = LATE, silent_ms: int = SILENT_MS) -> DataFrame:
    """accepted(station_id, seq, arrival, us, temp_c): (station_id, kind, start, n, total), kind `closed` once an hour, `late` once a batch that brings any."""
    return accepted.groupBy("station_id").transformWithStateInPandas(Hours(width, late, silent_ms), HOURS, "append", "ProcessingTime")


def open_hours(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(station_id, kind `open`, start, n, total) of the hours that a stopped stream holds in its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "hours").load()
    held = F.col("user_map_value.value")
    return state.select("key.station_id", F.lit("open").alias("kind"), F.col("user_map_key.start").alias("start"), held["n"].alias("n"), held["total"].alias("total"))
