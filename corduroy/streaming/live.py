"""Live events as streams: windows, counters, duplicate suppression, incremental archive, replays of what is stored."""

from __future__ import annotations

from collections.abc import Iterator
from math import radians

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from ..functions.geo import EARTH_KM, KM_PER_DEGREE


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type, in append mode once the watermark has passed."""
    on = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(on.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user in append mode; what comes near one that is closed is a part of its own (see whole_sessions)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def whole_sessions(parts: DataFrame) -> DataFrame:
    """user_id, start, end, n of what sessions gave, with parts of a session that came out at different times joined.

    A row that is not late may lie within the gap of a session that the watermark has closed before; the stream gives it as a session
    of its own, which overlaps the closed one.
    """
    w = Window.partitionBy("user_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = parts.withColumn("_fresh", F.when(before > F.col("start"), 0).otherwise(1))
    each = fresh.withColumn("_s", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("user_id", "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_s")


def counters(alerts: DataFrame, by: str = "estado") -> DataFrame:
    """Live counters: alerts so far by state (for update or complete mode)."""
    return alerts.groupBy(by).agg(F.count("*").alias("n"))


def new_alerts(alerts: DataFrame, keys: list[str], stamp: str = "polled_at", keep: str = "30 days") -> DataFrame:
    """Alerts whose key has not been seen within the time; what is seen is kept as state and expires with the watermark."""
    return alerts.withWatermark(stamp, keep).dropDuplicatesWithinWatermark(keys)


def suppress_duplicates(reports: DataFrame, cell: float = 0.0015, within: str = "10 minutes") -> DataFrame:
    """The first report of a type in a cell within the time; neighbours across a cell's edge are not compared (see repeated_stream)."""
    cells = reports.withColumn("cell_lat", F.floor(F.col("lat") / cell)).withColumn("cell_lon", F.floor(F.col("lon") / cell))
    return cells.withWatermark("ts", within).dropDuplicatesWithinWatermark(["tipo", "cell_lat", "cell_lon"])


REPORT = "id long, tipo string, lat double, lon double, ts timestamp"
#: Cells are so many times as wide as the reach of a report, which thus comes to 1.9 cells on average.
CELL = 4
#: A report in state (t in microseconds), and the reports of one element of a list state.
KEPT, CHUNK = np.dtype([("id", "<i8"), ("t", "<i8"), ("lat", "<f8"), ("lon", "<f8")]), 10_000


class NearReports(StatefulProcessor):
    """Of the reports of a type that reach a cell, those that live in it, each with whether a smaller id lies near in place and time.

    Time is cut into spans of ``seconds`` and place into patches, so that all of one patch and span are near each other: but for the
    smallest id they are repeated, which is told at once for those of a batch. The others wait until the watermark has passed the span
    after theirs, so that all they are compared with have come; one of each patch and span is then compared with what was seen, the
    smallest id of each place and time. State is read once a span and let go when the watermark is three spans on.
    """

    def __init__(self, radius_km: float, seconds: int):
        self.radius_km, self.span = radius_km, seconds * 1_000_000
        self.patch = radius_km / radians(1) / EARTH_KM * 0.4995  # along a meridian, then a parallel: under the radius

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.seen = (handle.getListState(x, "reports binary") for x in ("waiting", "seen"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        due = set()
        for pdf in rows:
            own, new = pdf["own"].to_numpy(bool), _packed(pdf)
            placed = np.isfinite(new["lat"]) & np.isfinite(new["lon"])
            first = placed & self._first(new, own & placed)
            told = own & ~first
            if told.any():
                yield _told(new[told], key, placed[told])
            self._keep(self.waiting, new[own & first])
            self._keep(self.seen, _least(new[placed]))
            due |= {s + 2 for s in (new["t"][own & first] // self.span).tolist()} | {s + 3 for s in (new["t"][placed] // self.span).tolist()}
        for s in due:  # what waits is told two spans on, what was seen is of no use three spans on
            self.handle.registerTimer(s * self.span // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, seen = _unpacked(self.waiting), _unpacked(self.seen)
        due = waiting["t"] + self.span < now
        if due.any():
            yield _told(waiting[due], key, self._repeated(waiting[due], seen))
        for state, had, left in ((self.waiting, waiting, waiting[~due]), (self.seen, seen, _least(seen[seen["t"] + 2 * self.span >= now]))):
            if len(left) < len(had):
                state.clear()
                self._keep(state, left)

    def _first(self, reports, among):
        """Whether a report has the smallest id of those among the reports that lie in its patch and span."""
        at = pd.DataFrame({"y": np.floor(reports["lat"] / self.patch), "x": np.floor(reports["lon"] / self.patch), "s": reports["t"] // self.span, "id": reports["id"]})[among]
        out = np.zeros(len(reports), bool)
        out[among] = at["id"] == at.groupby(["y", "x", "s"], sort=False)["id"].transform("min")
        return out

    def _repeated(self, due, seen):
        """Whether a smaller id was seen near each of the reports."""
        seen, first = np.sort(seen, order="lat"), self._first(due, np.ones(len(due), bool))
        out, reach = ~first, self.radius_km / KM_PER_DEGREE
        lo, hi = (np.searchsorted(seen["lat"], due["lat"] + side * reach, which) for side, which in ((-1, "left"), (1, "right")))
        for i in np.flatnonzero(first):
            r, o = due[i], seen[lo[i] : hi[i]]
            o = o[(o["id"] < r["id"]) & (np.abs(o["t"] - r["t"]) <= self.span)]
            out[i] = (_haversine(o, r) <= self.radius_km).any()
        return out

    @staticmethod
    def _keep(state, reports) -> None:
        if len(reports):
            state.appendList([(reports[k : k + CHUNK].tobytes(),) for k in range(0, len(reports), CHUNK)])

    def close(self) -> None:
        pass


def _packed(pdf):
    out = np.empty(len(pdf), KEPT)
    for c in KEPT.names:
        out[c] = pdf[c]
    return out


def _unpacked(state):
    return np.frombuffer(b"".join(bytes(x) for (x,) in state.get()) if state.exists() else b"", KEPT)


def _least(reports):
    """The smallest id of each place and time."""
    return _packed(pd.DataFrame(reports).groupby(["t", "lat", "lon"], sort=False, as_index=False)["id"].min()) if len(reports) > 1 else reports


def _told(reports, key, repeated):
    return pd.DataFrame({"id": reports["id"], "tipo": key[0], "repeated": repeated})


def _haversine(a, b):
    y, v = np.radians(a["lat"]), np.radians(b["lat"])
    h = np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((np.radians(b["lon"]) - np.radians(a["lon"])) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def repeated_stream(reports: DataFrame, radius_km: float, seconds: int, late: str = "10 minutes") -> DataFrame:
    """id, tipo, repeated of a stream of reports (id, tipo, lat, lon, ts): whether a smaller id of the type lies near in place and time.

    The same as operators.live.repeated_reports gives for the rows that are not late. A report lives in a cell and is a witness in
    the cells that it reaches, so comparisons are exact across edges and no key holds more than a cell of a type; the reach is that of
    the radius at 60 degrees of latitude. Needs the RocksDB state store. Reports without place, time or type come back never.
    """
    reach = radius_km / KM_PER_DEGREE * 2
    size = reach * CELL
    known = reports.where("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL AND tipo IS NOT NULL").withWatermark("ts", late)
    touched = lambda c, far: F.explode(F.sequence(F.floor((F.col(c) - far) / size), F.floor((F.col(c) + far) / size)))
    spread = known.select("id", "tipo", "lat", "lon", "ts", F.unix_micros("ts").alias("t"), touched("lat", reach / 2).alias("cy")).select("*", touched("lon", reach).alias("cx"))
    own = (F.col("cy") == F.floor(F.col("lat") / size)) & (F.col("cx") == F.floor(F.col("lon") / size))
    return spread.withColumn("own", own).groupBy("tipo", "cy", "cx").transformWithStateInPandas(NearReports(radius_km, seconds), "id long, tipo string, repeated boolean", "append", "EventTime")


def archive_stream(alerts: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that appends unseen alerts (by key) to a Parquet archive; a repeated batch adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        from ..sources.sinks import archive_new, exists

        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/batch=*") if number and exists(spark, f"{path}/batch=*") else spark.createDataFrame([], batch.schema)
        if f"{path}/batch={number}" and exists(spark, f"{path}/batch={number}"):
            return
        archive_new(old, batch, keys, str(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return alerts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain what is there now into an in-memory table (tests and small replays)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What is there now, written as Parquet below path by a stream of its own and read back."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


#: Rows of a replayed file at least, where a batch has as many.
FILE_ROWS = 250_000


def replay(rows: DataFrame, batch: str, path: str, n: int) -> DataFrame:
    """A stream of rows by their number in ``batch`` (0 to n - 1): one batch a trigger, in that order.

    A batch is dealt to files by its rows, so that no task writes or reads the whole of a large one. A trigger takes as many files as
    the batch of the most has; the others are filled up with empty ones.
    """
    rows_of = {r[0]: r[1] for r in rows.where(F.col(batch).between(0, n - 1)).groupBy(batch).count().collect()}  # n rows
    files = [max(1, rows_of.get(k, 0) // FILE_ROWS) for k in range(n)]
    for k, parts in enumerate(files):
        own = rows.where(F.col(batch) == k)
        (own.repartition(parts) if parts > 1 else own.coalesce(1)).write.mode("append").parquet(f"{path}/in")
        for _ in range(max(files) - parts):
            own.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(files)).parquet(f"{path}/in")


def finished(start, rows: DataFrame, closing: DataFrame, batch: str, path: str, n: int, mode: str = "append") -> DataFrame:
    """All that a stream gives for the n batches of rows once a closing row has moved its watermark past them.

    start: from the stream of rows to the stream of results. The query stops after the batches and goes on from its checkpoint for
    the closing row. In append mode results are Parquet files; else the last state of them is written anew with each batch.
    """
    spark: SparkSession = rows.sparkSession
    out = None
    for last in (False, True):
        stream = replay(rows, batch, path, n) if not last else spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        if last:
            closing.coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = start(stream)
        sink = out.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            sink.format("parquet").start(f"{path}/out").awaitTermination()
        else:
            sink.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def late_rows(came: DataFrame, counted: DataFrame, n: str) -> DataFrame:
    """One row: n_rows that came, n_counted in the stream's results (the sum of ``n``) and n_late, the ones behind the watermark."""
    every, held = came.agg(F.count("*").alias("n_rows")), counted.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_counted"))
    return every.join(F.broadcast(held)).withColumn("n_late", F.col("n_rows") - F.col("n_counted"))  # one row each
