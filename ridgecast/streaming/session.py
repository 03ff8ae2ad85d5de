"""Observation sessions as Structured Streaming jobs: the same functions as in batch, on unbounded packet lines."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.catalog import merge_states, record_states, role_type
from ..sources.packets import packet_lines, packet_path, packet_positions, packet_roles

PACKET_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("arrival_ts", T.TimestampType()), T.StructField("raw", T.StringType())])


def packet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet rows (seq, arrival_ts, raw) from parquet files as they appear."""
    reader = spark.readStream.schema(PACKET_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def text_lines(files: DataFrame) -> DataFrame:
    """seq, arrival_ts, raw of whole text files (value, _metadata), of a batch or a stream: lines arrive as their files do, and in a file's order."""
    at, name = F.col("_metadata.file_modification_time"), F.col("_metadata.file_name")
    each = files.select(at.alias("at"), name.alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw"))
    return each.select(F.struct("at", "file", "pos").alias("seq"), F.col("at").alias("arrival_ts"), "raw")


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet rows from text files as they appear; seq is a file's time and name and the line's place in it."""
    reader = spark.readStream.option("wholetext", True)
    return text_lines((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).text(path))


def kafka_lines(records: DataFrame) -> DataFrame:
    """seq, arrival_ts, raw of records of Spark's Kafka source (value, timestamp, partition, offset)."""
    return records.select(F.struct("timestamp", "partition", "offset").alias("seq"), F.col("timestamp").alias("arrival_ts"), F.col("value").cast("string").alias("raw"))


def kafka_stream(spark: SparkSession, **options: str) -> DataFrame:
    """Packet rows from Kafka; the options are those of Spark's source, which has to be on the class path."""
    return kafka_lines(spark.readStream.format("kafka").options(**options).load())


def within_session(packets: DataFrame, start, seconds: float) -> DataFrame:
    """Packets that arrive before the session ends (replay by arrival time)."""
    return packets.filter(F.col("arrival_ts") < F.lit(start) + F.make_dt_interval(secs=F.lit(float(seconds))))


def sightings(lines: DataFrame) -> DataFrame:
    """One row for each role or position seen: call, role or position, seq. Both kinds feed one aggregate."""
    roles = packet_roles(lines).select("seq", "call", "role", F.lit(None).cast("struct<lat: double, lon: double, symbol: string>").alias("p"))
    spots = packet_positions(lines).select("seq", "call", F.when(F.col("symbol") == "#", "digi").alias("role"), F.struct("lat", "lon", "symbol").alias("p"))
    return roles.unionByName(spots)


def running_catalog(packets: DataFrame) -> DataFrame:
    """call, is_digi, is_igate, position, last: roles and positions may come in either order, any time apart.

    One row of state for each call, so the state is bounded by the number of stations, not by time or packets.
    """
    rows = sightings(packet_lines(packets))
    return rows.groupBy("call").agg(
        F.bool_or(F.coalesce(F.col("role") == "digi", F.lit(False))).alias("is_digi"), F.bool_or(F.coalesce(F.col("role") == "igate", F.lit(False))).alias("is_igate"),
        F.max_by("p", F.when(F.col("p").isNotNull(), F.col("seq"))).alias("p"), F.max("seq").alias("last"),
    )


def heard(catalog: DataFrame) -> DataFrame:
    """Calls of a running catalog with a role and a position."""
    return catalog.filter((F.col("is_digi") | F.col("is_igate")) & F.col("p").isNotNull()).select(F.col("call").alias("callsign"), role_type().alias("type"), "p.lat", "p.lon")


def packet_rate(packets: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Packets in each interval of arrival time (an extension; late packets beyond the watermark are dropped)."""
    return packet_lines(packets.withWatermark("arrival_ts", watermark)).groupBy(F.window("arrival_ts", width)).agg(F.count(F.lit(1)).alias("n_packets"))


def progress(packets: DataFrame, name: str = "session") -> DataFrame:
    """packets that report their counters as observed metrics."""
    used = F.size(packet_path(F.col("raw"))) > 0
    return packets.observe(name, F.count(F.lit(1)).alias("lines"), F.count_if(used).alias("with_path"))


class Counters(StreamingQueryListener):
    """The observed metrics of a query, added up over all its triggers; `seen` holds them as they stood, at most once in `every` seconds."""

    def __init__(self, name: str = "session", every: float = 1.0):
        self.name, self.every = name, every
        self.totals: dict[str, int] = {}
        self.triggers = 0
        self.seen: list[tuple[float, dict[str, int]]] = []
        self._began, self._batches, self._run, self._over = time.monotonic(), set(), None, threading.Event()

    def follow(self, query: StreamingQuery) -> Counters:
        """Count this query's triggers only. To be called before the listener is added or soon after the start: the id is compared on every event."""
        self._run = str(query.runId)
        return self

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name) if progress.observedMetrics else None
        if row is None or (str(progress.runId), progress.batchId) in self._batches:
            return
        self._batches.add((str(progress.runId), progress.batchId))
        self.triggers += 1
        for k, v in row.asDict().items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)
        now = time.monotonic() - self._began
        if not self.seen or now - self.seen[-1][0] >= self.every:
            self.seen.append((now, dict(self.totals)))

    def onQueryTerminated(self, event) -> None:
        if self._run is None or str(event.runId) == self._run:
            self._over.set()

    def wait(self, timeout: float = 60.0) -> dict[str, int]:
        """The totals once the query's last event has come."""
        self._over.wait(timeout)
        return self.totals


class Session:
    """A stream that runs until its input ends or its time is up.

    In complete mode every trigger leaves the whole result in a folder of its own and takes the one before away; result() is that of the last trigger that
    was written in full. In append mode rows are added. Executors write the rows; none pass through the driver.
    """

    def __init__(self, stream: DataFrame, path: str, checkpoint: str, mode: str = "complete", seconds: float | None = None, trigger: str = "1 second", counters: Counters | None = None):
        self.spark, self.path, self.mode, self.counters = stream.sparkSession, path, mode, counters
        self.schema, self.last = stream.schema, None
        if mode == "complete":
            writer = stream.writeStream.outputMode(mode).foreachBatch(self._epoch)
        else:
            writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        writer = writer.option("checkpointLocation", checkpoint)
        if counters:
            self.spark.streams.addListener(counters)
        try:
            self.query = (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=trigger)).start()
            if counters:
                counters.follow(self.query)
            self._run(seconds)
        finally:
            if counters:
                self.spark.streams.removeListener(counters)

    def _epoch(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch:010d}")
        before, self.last = self.last, epoch
        if before is not None and before != epoch:
            self._delete(f"{self.path}/epoch={before:010d}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _run(self, seconds: float | None) -> None:
        """Wait for the end; at the deadline the query is stopped, whatever its source goes on to bring."""
        if seconds is None:
            self.query.awaitTermination()
        else:
            if not self.query.awaitTermination(seconds):
                self.query.stop()
            if self.query.exception():
                raise self.query.exception()
        if self.counters:
            self.counters.wait()

    def result(self) -> DataFrame:
        if self.mode != "complete":
            return self.spark.read.schema(self.schema).parquet(self.path)
        return self.spark.createDataFrame([], self.schema) if self.last is None else self.spark.read.parquet(f"{self.path}/epoch={self.last:010d}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete", seconds: float | None = None, counters: Counters | None = None) -> Session:
    """Process what is available, or run for so many seconds, into Parquet."""
    return Session(stream, path, checkpoint, mode, seconds, counters=counters)


def upsert_catalog(load: Callable[[], DataFrame | None], save: Callable[[DataFrame], None], rank: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges the states of each batch of station rows into the stored states (catalog.record_states()).

    States keep where each value stood, so batches may cut and order the rows in any way: what is stored in the end is the state of all rows. Rows without
    group_rank have the given one; rows without ord come after those of earlier batches. save must not overwrite what load reads while it is being read.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        if "group_rank" not in batch.columns:
            batch = batch.withColumn("group_rank", F.lit(rank))
        if "ord" not in batch.columns:
            batch = batch.withColumn("ord", F.lit(epoch << 40) + F.monotonically_increasing_id())
        fresh, stored = record_states(batch), load()
        save(fresh if stored is None else merge_states(stored, fresh))

    return merge


def cache_is_valid(metadata: DataFrame, lat: float, lon: float, radius_km: float, as_of: int, max_age_s: int = 6 * 3600) -> DataFrame:
    """metadata rows (updated_at, center_lat, center_lon, radius_km) with valid: young enough and around the wanted circle."""
    from ..functions.geo import haversine_km

    offset = haversine_km(F.col("center_lat"), F.col("center_lon"), F.lit(lat), F.lit(lon))
    return metadata.withColumn("valid", (as_of - F.col("updated_at") <= max_age_s) & (offset + radius_km <= F.col("radius_km")))
