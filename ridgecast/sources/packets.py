"""Raw packet lines: roles and positions, for batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_call

#: The q-constructs whose next token is the receiving gateway, fixed values.
GATE_MARKS = ("QAR", "QAO", "QAS", "QAC")
POSITION = r"^(?:[!=]|[/@][0-9]{6}[hz/])([0-9]{2})([0-9]{2}\.[0-9]{2})([NS]).([0-9]{3})([0-9]{2}\.[0-9]{2})([EW])(.)(.*)$"


def packet_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Stripped lines without blanks and server comments.

    A line is a generated column, so that it is made once: conditions on a projected one move below it and make it, and all that it comes from, once for every mention.
    """
    line = F.explode(F.array(F.regexp_replace(raw, r"^\s+|\s+$", ""))).alias("__line")
    rows = df.select("*", line).select(*[F.col("__line").alias(c) if c == raw else F.col(c) for c in df.columns])
    return rows.filter((F.col(raw) != "") & ~F.col(raw).startswith("#"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return packet_lines(spark.read.text(path).withColumnRenamed("value", "raw"))


def packet_header(raw: Column) -> Column:
    """Everything before the first colon."""
    return F.substring_index(raw, ":", 1)


def packet_sender(raw: Column) -> Column:
    return normalize_call(F.substring_index(packet_header(raw), ">", 1))


def packet_path(raw: Column) -> Column:
    """Path tokens after the destination; none without '>'."""
    rest = F.split(F.get(F.split(packet_header(raw), ">", 2), F.lit(1)), ",")
    return F.coalesce(F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0))), F.array().cast("array<string>"))


def packet_roles(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each role seen: the line's columns, call and role (digi: a used path token; igate: the token after a gate mark)."""
    each = lines.withColumn("__path", packet_path(F.col(raw))).select(*lines.columns, "__path", F.posexplode("__path").alias("__k", "__t"))
    token = F.upper("__t")
    digi = token.endswith("*") & ~token.startswith("QA")
    gate = F.substring(token, 1, 3).isin(*GATE_MARKS)
    following = F.get("__path", F.col("__k") + 1)
    found = F.array_compact(F.array(F.when(digi, F.struct(normalize_call(F.col("__t")).alias("call"), F.lit("digi").alias("role"))), F.when(gate & following.isNotNull(), F.struct(normalize_call(following).alias("call"), F.lit("igate").alias("role")))))
    return each.withColumn("__found", found).select(*lines.columns, F.inline("__found")).filter("call <> ''")


def packet_positions(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines with an uncompressed position: their columns, call, lat, lon, symbol, comment."""
    body = F.when(F.contains(F.col(raw), F.lit(":")), F.substring(F.col(raw), F.length(packet_header(F.col(raw))) + 2, F.length(raw)))
    part = lambda k: F.regexp_extract(F.col("__body"), POSITION, k)
    rows = lines.withColumn("__body", body).filter(F.col("__body").rlike(POSITION))
    degrees = lambda d, m, side, minus: (part(d).cast("double") + part(m).cast("double") / 60) * F.when(part(side) == minus, -1).otherwise(1)
    return rows.select(*lines.columns, packet_sender(F.col(raw)).alias("call"), degrees(1, 2, 3, "S").alias("lat"), degrees(4, 5, 6, "W").alias("lon"), part(7).alias("symbol"), part(8).alias("comment"))
