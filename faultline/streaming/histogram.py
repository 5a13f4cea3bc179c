"""The same functions on a stream: minute counts and template counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions import instants, text as tx
from faultline.functions.levels import level_rank
from faultline.operators.log_entries import with_line_fields
from faultline.session import fence


def entries_of_stream(lines: DataFrame) -> DataFrame:
    """Header lines of a stream with a column raw: ts, level, component, template. A line without a time of its own is no entry; lines that follow an entry are
    not gathered, as a stream has no end at which an entry would be complete."""
    d = with_line_fields(lines.select("raw")).where("start and time_text is not null")
    d = fence(instants.with_instant(d, "time_text", "cast(null as string)", out="us"), "us").where("us is not null")
    return tx.with_template(d.withColumn("ts", F.timestamp_micros("us")), "raw").select("ts", "level", "component", "template")


def minute_counts(entries: DataFrame, late: str = "10 minutes", least: str = "WARN") -> DataFrame:
    """minute, level, count of entries of `least` level and above; an entry later than `late` behind the newest is left out, and state older than that is dropped."""
    rank = level_rank(F.lit(least))
    return entries.where(level_rank(F.col("level")) >= rank).withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "level").agg(
        F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("minute"), "level", "count")
