"""Counts, groups, histograms and signatures of records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.functions import text as tx
from faultline.functions.levels import LEVEL_ORDER

WARN = LEVEL_ORDER.index("WARN") + 1
#: Bucket widths in minutes from which a histogram of a span is drawn.
BUCKETS = [1, 5, 15, 30, 60, 180, 720, 1440]


def groups(records: DataFrame) -> DataFrame:
    """One row per level and template: count, first and last time, whether all zones are known, the first record's text, number of sources; `n` numbers them
    in report order: warnings and above first, then by count, level and first occurrence. Records are combined before the shuffle, by source first, so that sources are counted exactly; the
    numbering sorts groups, not records."""
    at = F.struct("src", "entry", "line_no")
    key = ["level", "level_rank", "template"]
    part = tx.with_template(records).groupBy(*key, "source").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_and(F.when(F.col("ts").isNotNull(), F.col("tz_known"))).alias("tz_known"),
        F.min(F.struct(at.alias("at"), F.col("raw").alias("raw"))).alias("first"))
    g = part.groupBy(*key).agg(F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.bool_and("tz_known").alias("tz_known"),
                               F.min("first").alias("first"), F.count("source").alias("sources"))
    g = g.select(*key, "count", "first_ts", "last_ts", "tz_known", F.col("first.raw").alias("sample"), F.col("first.at").alias("at"), "sources")
    order = [(F.col("level_rank") >= WARN).desc(), F.col("count").desc(), F.col("level_rank").desc(), F.col("at").asc()]
    return g.withColumn("n", F.row_number().over(Window.orderBy(*order)))


def group_origins(records: DataFrame) -> DataFrame:
    """level, template, origin, count: the files of each group."""
    return tx.with_template(records).groupBy("level", "template", "origin").agg(F.count(F.lit(1)).alias("count"))


def group_sources(records: DataFrame) -> DataFrame:
    """level, template, source, count."""
    return tx.with_template(records).groupBy("level", "template", "source").agg(F.count(F.lit(1)).alias("count"))


def samples(records: DataFrame, template: str, level: str, most: int = 5) -> DataFrame:
    """The first records of one group."""
    return tx.with_template(records.where(F.col("level") == level)).where(F.col("template") == template).orderBy("src", "entry", "line_no").limit(most)


def counts(records: DataFrame, by: str) -> DataFrame:
    """Rows per value of a column, nulls left out, most first and then by first occurrence."""
    return records.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("src", "entry", "line_no")).alias("at")) \
        .orderBy(F.col("count").desc(), "at").drop("at")


def exception_counts(records: DataFrame) -> DataFrame:
    """Exception classes, each counted once per record."""
    x = records.select(F.explode(tx.exceptions(F.col("raw"))).alias("exception"), "src", "entry", "line_no")
    return counts(x, "exception")


def period(records: DataFrame) -> DataFrame:
    """One row: records, first and last time, times with and without a zone, whether both occur."""
    known = F.count_if(F.col("ts").isNotNull() & F.col("tz_known"))
    unknown = F.count_if(F.col("ts").isNotNull() & ~F.col("tz_known"))
    return records.agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), known.alias("tz_known"), unknown.alias("tz_unknown"),
                       ((known > 0) & (unknown > 0)).alias("mixed"))


def histogram(records: DataFrame, minutes: int = 1, least: str | None = None) -> DataFrame:
    """bucket, count of dated records, of `least` level and above if given."""
    r = records.where("ts is not null")
    if least:
        r = r.where(F.col("level_rank") >= LEVEL_ORDER.index(least) + 1)
    us = minutes * 60_000_000
    b = F.expr(f"cast(timestamp_micros(floor(unix_micros(cast(ts as timestamp)) / {us}) * {us}) as timestamp_ntz)")
    return r.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def drawn_histogram(minute_counts: DataFrame, most: int = 30) -> DataFrame:
    """Minute counts in the narrowest of BUCKETS that gives at most `most` buckets, with each bucket's share of the peak."""
    span = minute_counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    width = F.coalesce(*[F.when(F.expr(f"timestampdiff(MINUTE, a, b) / {m} <= {most}"), m) for m in BUCKETS], F.lit(BUCKETS[-1]))
    r = minute_counts.join(F.broadcast(span.select(width.alias("minutes"))))
    us = "cast(minutes as bigint) * 60000000L"
    b = F.expr(f"cast(timestamp_micros((unix_micros(cast(bucket as timestamp)) div ({us})) * {us}) as timestamp_ntz)")
    h = r.groupBy(b.alias("bucket"), "minutes").agg(F.sum("count").alias("count"))
    return h.withColumn("share", F.col("count") / F.max("count").over(Window.partitionBy()))


def trace_errors(records: DataFrame, most: int = 10) -> DataFrame:
    """Request ids with the most records of ERROR and above."""
    return counts(records.where(F.col("level_rank") > WARN), "trace").limit(most)


def signatures(records: DataFrame, most: int = 12) -> DataFrame:
    """ord, kind, value, count, level: up to 6 exceptions by count, statuses from 500 by number, then templates of warnings and above."""
    exc = exception_counts(records).limit(6).withColumn("rk", F.row_number().over(Window.orderBy(F.col("count").desc(), "exception"))).select(
        F.lit(1).alias("k"), "rk", F.lit("exception").alias("kind"), F.col("exception").alias("value"), "count", F.lit(None).cast("string").alias("level"))
    http = records.where("status >= 500").groupBy("status").agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(2).alias("k"), F.col("status").alias("rk"), F.lit("http").alias("kind"), F.concat(F.lit("http_status="), "status").alias("value"), "count", F.lit(None).cast("string").alias("level"))
    tmpl = groups(records).where(F.col("level_rank") >= WARN).orderBy("n").limit(most).select(
        F.lit(3).alias("k"), F.col("n").alias("rk"), F.lit("template").alias("kind"), F.concat(F.lit("tmpl:"), tx.short_template(F.col("template"))).alias("value"), "count", "level")
    every = exc.unionByName(http).unionByName(tmpl).withColumn("ord", F.row_number().over(Window.orderBy("k", "rk")))
    return every.where(F.col("ord") <= most).select("ord", "kind", "value", "count", "level")


def containing(records: DataFrame, needle: str) -> DataFrame:
    """All records that hold a text, such as a request id, in order of time, file and line; undated ones last."""
    return records.where(F.contains("raw", F.lit(needle))).orderBy(F.col("ts").asc_nulls_last(), "origin", "line_no")


#: Tables of a parse that later stages read, with their columns.
ARTIFACT = {
    "groups": "n int, level string, level_rank int, template string, count bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, tz_known boolean, sources bigint, sample string",
    "levels": "level string, count bigint", "formats": "fmt string, count bigint", "origins": "origin string, count bigint", "services": "source string, count bigint", "statuses": "status int, count bigint",
    "exceptions": "exception string, count bigint", "histogram": "bucket timestamp_ntz, count bigint", "signatures": "ord int, kind string, value string, count bigint, level string",
    "traces": "trace string, count bigint", "period": "records bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, tz_known bigint, tz_unknown bigint, mixed boolean",
}


def artifact(records: DataFrame) -> dict[str, DataFrame]:
    """The tables of ARTIFACT, whole."""
    t = {"groups": groups(records), "levels": counts(records, "level"), "formats": counts(records, "fmt"), "origins": counts(records, "origin"), "services": counts(records, "source"), "statuses": counts(records, "status"),
         "exceptions": exception_counts(records), "histogram": histogram(records, 1, "WARN"), "signatures": signatures(records), "traces": counts(records.where(F.col("level_rank") > WARN), "trace"), "period": period(records)}
    return {k: t[k].select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in columns.split(", ")]) for k, columns in ARTIFACT.items()}


def write_artifact(records: DataFrame, folder: str) -> None:
    """The tables of a parse as JSON lines, one folder each."""
    for name, df in artifact(records).items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def read_artifact(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that write_artifact() wrote, typed. A missing table or one with broken lines is an error."""
    out = {}
    for name, columns in ARTIFACT.items():
        try:
            df = spark.read.schema(columns + ", broken string").option("columnNameOfCorruptRecord", "broken").json(f"{folder}/{name}")
        except AnalysisException as e:
            raise ValueError(f"no parse in {folder}: {name} is missing") from e
        if df.select("broken", columns.split(" ")[0]).where("broken is not null").limit(1).collect():
            raise ValueError(f"no parse in {folder}: {name} is broken")
        out[name] = df.drop("broken")
    return out


def parsed_artifact(records: DataFrame, top: int = 100) -> DataFrame:
    """One row `json`: the summary of a parse as a document, with its `top` groups and exceptions and how many there are; write_artifact() holds all."""
    pack = lambda df, name: df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
    t = artifact(records)
    first = {"groups": t["groups"].where(F.col("n") <= top).drop("sample").orderBy("n"), "exceptions": t["exceptions"].limit(top), "services": t["services"].limit(20), "origins": t["origins"].limit(top),
             "traces": t["traces"].limit(10), "histogram": drawn_histogram(t["histogram"]).select("bucket", "minutes", "count").orderBy("bucket"), "signatures": t["signatures"].orderBy("ord")}
    parts = [pack(first.get(k, df), k) for k, df in t.items()]
    parts.append(t["groups"].agg(F.count(F.lit(1)).cast("string").alias("n_groups")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{c}":'), F.col(c)) for c in out.columns]), F.lit("}")).alias("json"))
