"""Times of alert payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions import instants
from faultline.session import fence, join_dimension


def alert_instants(alerts: DataFrame, feeds: DataFrame) -> DataFrame:
    """The columns of `alerts` plus shape, tz_name, field_name and utc_us.

    `startsAt` of alertmanager and no_fields payloads, `data.event.timestamp` of sentry; a time without zone is read
    in the feed's zone, the earlier instant of two. Missing and unreadable times, null or broken payloads
    and unknown feeds give a null utc_us; no row is lost and extra columns pass through."""
    dim = feeds.groupBy("feed_id").agg(F.max("shape").alias("shape"), instants.known_zone(F.max("tz_name")).alias("tz_name"))
    a = alerts.drop("shape", "tz_name", "field_name", "utc_us", "utc_us_shift", "utc_us_known")
    df = join_dimension(a, dim, "feed_id")
    starts = F.col("shape").isin("alertmanager", "no_fields")
    text = F.when(starts, F.get_json_object("payload", "$.alerts[0].startsAt")).when(
        F.col("shape") == "sentry", F.get_json_object("payload", "$.data.event.timestamp"))
    df = df.withColumn("__text", text)
    # a JSON reader may write a large number with an exponent
    df = df.withColumn("__text", F.when(F.col("__text").rlike(r"^\d(\.\d+)?[eE]\d+$"),
                                        F.col("__text").try_cast("decimal(30,6)").cast("string")).otherwise(F.col("__text")))
    df = instants.with_instant(df, "__text", "tz_name", out="utc_us")
    df = df.withColumn("field_name", F.when(starts, "starts_at").when(F.col("shape") == "sentry", "timestamp"))
    return fence(df.drop("__text", "utc_us_shift", "utc_us_known"), "utc_us")
