"""Queries p1, p3, p4 and p5 over whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.operators.alert_times import alert_instants
from faultline.operators.exactly_once import exactly_once
from faultline.operators.log_entries import entry_instants, log_entries
from faultline.operators.schema_drift import cast_report, schema_changes, whole_table
from faultline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus deliveries."""
    return exactly_once(table(spark, sf_dir, "alerts"), table(spark, sf_dir, "feeds"))[1].select("delivery_id")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that stay: one of each message, and all that identify none."""
    return exactly_once(table(spark, sf_dir, "alerts"), table(spark, sf_dir, "feeds"))[0].select("delivery_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of payload layout between neighbouring files."""
    return schema_changes(table(spark, sf_dir, "alerts"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All payloads in one table of consistent columns, every path and value."""
    return whole_table(table(spark, sf_dir, "alerts")).withColumn("failed", F.array_join("failed", ","))


def p3_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that did not fit their column, by file."""
    return cast_report(whole_table(table(spark, sf_dir, "alerts")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries."""
    return log_entries(table(spark, sf_dir, "log_lines")).select("file_id", "line_no", "n_lines", "log_level", "component")


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries with their instant and message."""
    e = log_entries(table(spark, sf_dir, "log_lines"))
    return entry_instants(e, table(spark, sf_dir, "log_files"), carry=("n_lines", "log_level", "component", "message"), undated=True).drop("line_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable times of alerts and log entries as one UTC instant each."""
    alerts = alert_instants(table(spark, sf_dir, "alerts"), table(spark, sf_dir, "feeds")).where("utc_us is not null").select(
        "field_name", F.col("delivery_id").alias("rec_id"), "utc_us")
    logs = entry_instants(log_entries(table(spark, sf_dir, "log_lines")), table(spark, sf_dir, "log_files")).select(
        F.lit("log").alias("field_name"), F.col("line_id").alias("rec_id"), "utc_us")
    return alerts.unionByName(logs)


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p3_found, p3_table, p3_failed_casts, p4_found, p4_entries, p5_found)}
SQL: dict[str, str] = {}
