"""Registered streaming queries: a table's packets replayed as a stream, held against the batch twin's SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fixture
from ..operators.catalog import merged_values
from ..sources.scratch import scratch
from . import session

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The bounded session's start and length.
START, SECONDS = datetime.datetime(2024, 1, 1), 10 * 86_400


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets view as a stream of files."""
    path = scratch(spark, "replay")
    packets = fixture(spark, sf_dir, "fx_packets").withColumn("arrival_ts", F.col("arrival_ts").cast("timestamp"))
    packets.select("seq", "arrival_ts", "raw").repartition(4, "seq").write.parquet(path)
    return session.packet_stream(spark, path, files_per_trigger=2)


def _result(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return session.run_to_table(stream, scratch(spark, "stream"), scratch(spark, "progress")).result()


def stream_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and last sighting of every call, as a session's running state ends."""
    return _result(spark, session.running_catalog(_replay(spark, sf_dir))).filter("is_digi or is_igate").select("call", "is_digi", "is_igate")


def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = session.heard(_result(spark, session.running_catalog(_replay(spark, sf_dir))))
    return rows.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


def stream_packet_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result(spark, session.packet_rate(_replay(spark, sf_dir)))
    return rows.select(F.unix_timestamp("window.start").alias("start"), "n_packets")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles heard within a bounded session."""
    packets = session.within_session(_replay(spark, sf_dir), START, SECONDS)
    return _result(spark, session.running_catalog(packets)).filter("is_digi or is_igate").select("call", "is_digi", "is_igate")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that a session's triggers reported, added up by a listener."""
    counters = session.Counters()
    session.run_to_table(session.progress(session.packet_lines(_replay(spark, sf_dir))), scratch(spark, "stream"), scratch(spark, "progress"), mode="append", counters=counters)
    return spark.createDataFrame([(counters.totals["lines"], counters.totals["with_path"])], "lines long, with_path long")


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles from raw lines that come as text files, without numbers of their own."""
    path = scratch(spark, "lines")
    fixture(spark, sf_dir, "fx_packets").select(F.col("raw").alias("value")).repartition(5).write.text(path)
    found = session.running_catalog(session.text_stream(spark, path, files_per_trigger=2))
    return _result(spark, found).filter("is_digi or is_igate").select("call", "is_digi", "is_igate")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalog after the rows of all source groups have come in batches that cut across them."""
    source, stored = scratch(spark, "groups"), []
    rows = fixture(spark, sf_dir, "fx_stations_raw")

    def save(states: DataFrame) -> None:
        path = scratch(spark, "catalog")
        states.write.parquet(path)
        stored.append(path)

    merge, progress = session.upsert_catalog(lambda: spark.read.parquet(stored[-1]) if stored else None, save), scratch(spark, "progress")
    for k in range(4):
        rows.filter(F.pmod(F.xxhash64("ord"), F.lit(4)) == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return merged_values(spark.read.parquet(stored[-1])).select("callsign", "type", "lat", "lon", "comment", "lasttime", "source", "seed_only")


def _register() -> None:
    from .. import queries as batch

    paths = batch._PATH
    QUERIES.update({"stream_roles": stream_roles, "stream_catalog": stream_catalog, "stream_packet_rate": stream_packet_rate, "stream_session": stream_session, "stream_progress": stream_progress, "stream_lines": stream_lines, "stream_upsert": stream_upsert})
    SQL["stream_session"] = batch.with_views(f"with {paths.replace('from fx_packets where', f"from fx_packets where arrival_ts < timestamp '{START}' + interval {SECONDS} second and")} select * from sets")
    SQL["stream_progress"] = batch.with_views(f"with {paths} select (select count(*) from lines) as lines, (select count(*) from paths where len(path) > 0) as with_path")
    SQL["stream_upsert"] = batch.with_views(f"with {batch._MERGE} select callsign, type, lat, lon, comment, lasttime, source, seed_only from merged")
    SQL["stream_lines"] = batch.with_views(f"with {paths} select * from sets")
    SQL["stream_roles"] = batch.with_views(f"with {paths} select * from sets")
    SQL["stream_catalog"] = batch.with_views(f"with {paths} select call as callsign, case when is_digi then 'digi' else 'igate' end as type, round(lat, 6) as lat, round(lon, 6) as lon from sets join latest using (call)")
    SQL["stream_packet_rate"] = batch.with_views("select cast(floor(epoch(arrival_ts) / 3600) * 3600 as bigint) as start, count(*) as n_packets from fx_packets where raw not like '#%' group by 1")


_register()
