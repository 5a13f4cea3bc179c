"""Requests across services, clock differences, event feed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions import text as tx
from faultline.functions.levels import LEVEL_ORDER
from faultline.session import cut, proven_small

ERROR = LEVEL_ORDER.index("ERROR") + 1
WARN = LEVEL_ORDER.index("WARN") + 1


def trace_key(records: DataFrame) -> DataFrame:
    """Add `key`, the request id without quotes."""
    return records.withColumn("key", F.nullif(F.btrim("trace", F.lit("\"' ")), F.lit("")))


def with_offsets(records: DataFrame, offsets: dict[str, float], service: str = "service") -> DataFrame:
    """Times moved by the seconds given for their service; never on its own account."""
    if not offsets:
        return records
    shift = F.coalesce(*[F.when(F.col(service) == k, F.lit(float(v))) for k, v in offsets.items()], F.lit(0.0))
    return records.withColumn("__s", shift).withColumn("ts", F.expr("cast(timestamp_micros(unix_micros(cast(ts as timestamp)) + cast(__s * 1000000 as bigint)) as timestamp_ntz)")).drop("__s")


def trace_candidates(records: DataFrame, most: int | None = None) -> DataFrame:
    """key, records, errors, services, first_ts, last_ts of each request id; most errors, services and records first. Services of one request are few;
    they are combined before the shuffle."""
    c = records.where("key is not null").groupBy("key").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("level_rank") >= ERROR).alias("errors"), F.size(F.collect_set("service")).cast("long").alias("services"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if most is None:
        return c
    return c.orderBy(F.col("errors").desc(), F.col("services").desc(), F.col("records").desc(), "key").limit(most)


def hops(records: DataFrame) -> DataFrame:
    """One row per request id and service: first and last time, records, errors, worst level, the seconds since the hop before (negative: clocks differ) and whether the wait
    before it was the longest of its request, the earliest of equal ones."""
    h = records.where("key is not null").groupBy("key", "service").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("level_rank") >= ERROR).alias("errors"),
        F.max_by("level", "level_rank").alias("worst"))
    w = Window.partitionBy("key").orderBy(F.col("first_ts").asc_nulls_last(), "service")
    gap = (F.expr("unix_micros(cast(first_ts as timestamp))") - F.expr("unix_micros(cast(__before as timestamp))")) / 1e6
    return h.withColumn("hop", F.row_number().over(w)).withColumn("__before", F.lag("first_ts").over(w)).withColumn("gap_s", gap).drop("__before").withColumn(
        "slowest", F.coalesce((F.col("gap_s") > 0) & (F.row_number().over(Window.partitionBy("key").orderBy(F.col("gap_s").desc_nulls_last(), "hop")) == 1), F.lit(False)))


def hop_counts(records: DataFrame, by: str, most: int = 3) -> DataFrame:
    """key, service, value, count: the `most` frequent levels or statuses of each hop, smaller ones first among equals."""
    c = records.where(F.col("key").isNotNull() & F.col(by).isNotNull()).groupBy("key", "service", F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("key", "service").orderBy(F.col("count").desc(), "value")
    return c.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def chain(records: DataFrame, needle: str) -> DataFrame:
    """Hops of the records whose id or raw text holds `needle`, in any case."""
    hit = F.contains(F.lower(F.coalesce("key", F.lit(""))), F.lit(needle.lower())) | F.contains(F.lower("raw"), F.lit(needle.lower()))
    return hops(records.where(hit).withColumn("key", F.lit(needle)))


def break_points(records: DataFrame) -> DataFrame:
    """The earliest record of ERROR and above of each request id, undated ones last; pre-aggregated."""
    first = F.struct(F.col("ts").isNull().alias("undated"), "ts", "service", "line_no")
    return records.where((F.col("level_rank") >= ERROR) & F.col("key").isNotNull()).groupBy("key").agg(F.min(first).alias("x")).select(
        "key", F.col("x.ts").alias("ts"), F.col("x.service").alias("service"), F.col("x.line_no").alias("line_no"))


def clock_skew(records: DataFrame, least: int = 3, seconds: float = 2.0) -> DataFrame:
    """a, b, n, median_s, mad_s, systematic of each pair of services that share request ids: the median difference of their first times, reported from
    `least` shared ids and `seconds` on; systematic if differences stay within a quarter of it (half a second at least). Only pairs of services that meet in
    a request are formed, from one row per request and service."""
    e = records.where("key is not null and ts is not null and service is not null").groupBy("key", "service").agg(F.min(F.expr("unix_micros(cast(ts as timestamp))")).alias("us"))
    e = cut(e)  # one row per request and service, read four times
    a, b = e.select("key", F.col("service").alias("a"), F.col("us").alias("ua")), e.select("key", F.col("service").alias("b"), F.col("us").alias("ub"))
    d = a.join(b, "key").where("a < b").select("a", "b", ((F.col("ub") - F.col("ua")) / 1e6).alias("d"))
    m = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("median_s")).where((F.col("n") >= least) & (F.abs("median_s") >= seconds))
    m = cut(m)  # one row per pair of services: counted, then joined twice
    medians = m.select("a", "b", "median_s")
    dev = d.join(F.broadcast(medians) if proven_small(medians) else medians, ["a", "b"]).groupBy("a", "b").agg(F.median(F.abs(F.col("d") - F.col("median_s"))).alias("mad_s"))
    return m.join(dev, ["a", "b"]).withColumn("systematic", F.col("mad_s") <= F.greatest(F.abs("median_s") * 0.25, F.lit(0.5)))


def clock_skew_by_template(records: DataFrame, least: int = 3, seconds: float = 2.0) -> DataFrame:
    """The same where no request ids are shared: the first time that each service wrote a message of the same template."""
    t = tx.with_template(records.where("ts is not null and service is not null")).groupBy("template", "service").agg(F.min("ts").alias("ts"))
    return clock_skew(t.withColumnRenamed("template", "key"), least, seconds)


def _greedy(sorted_us: Column, gap_us: int, drop_equal: bool) -> Column:
    """Times of which each lies far enough after the last one kept."""
    near = (lambda x, a: x - a["last"] <= gap_us) if drop_equal else (lambda x, a: x - a["last"] < gap_us)
    return F.aggregate(sorted_us, F.struct(F.lit(-(1 << 60)).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept")),
                       lambda a, x: F.when(near(x, a), a).otherwise(F.struct(x.alias("last"), F.array_append(a["kept"], x).alias("kept"))), lambda a: a["kept"])


def spikes(minutes: DataFrame, series: str = "series", least: int = 5, factor: float = 3.0, more: int = 5, apart_minutes: int = 2, most: int = 8) -> DataFrame:
    """series, bucket, count of minutes that stand out: at least `least`, `factor` times the mean of up to five minutes before and `more` above it; the first never,
    series under three minutes never; not within `apart_minutes` of the last kept, at most `most` a series. Input: one row per series and minute with records."""
    w = Window.partitionBy(series).orderBy("bucket")
    base = F.avg("count").over(w.rowsBetween(-5, -1))
    d = minutes.withColumn("base", base).withColumn("rn", F.row_number().over(w)).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(series)))
    hot = d.where((F.col("rows") >= 3) & (F.col("rn") > 1) & (F.col("count") >= least) & (F.col("count") >= F.greatest(F.col("base") * factor, F.col("base") + more)))
    us = F.expr("unix_micros(cast(bucket as timestamp))")
    kept = hot.groupBy(series).agg(F.array_sort(F.collect_list(us)).alias("x"), F.collect_list(F.struct(us.alias("us"), "count")).alias("c")).withColumn(
        "k", F.slice(_greedy(F.col("x"), apart_minutes * 60_000_000, True), 1, most))
    out = kept.select(series, F.explode("k").alias("us"), "c")
    return out.select(series, F.expr("cast(timestamp_micros(us) as timestamp_ntz)").alias("bucket"), F.filter("c", lambda x: x["us"] == F.col("us"))[0]["count"].alias("count"))


def once_a_minute(events: DataFrame, by: list[str], gap_us: int = 60_000_000) -> DataFrame:
    """(by, us) of events without those that follow the last kept one of their kind within `gap_us`. Distinct times are combined before they are gathered per kind."""
    t = events.groupBy(*by).agg(F.array_sort(F.collect_set("us")).alias("x"))
    return t.select(*by, F.explode(_greedy(F.col("x"), gap_us, False)).alias("us"))


def parse_milestone(text: str) -> tuple[str, str]:
    """(time, text) of a milestone given as 'TIME|text' or 'TIME text'."""
    time, bar, rest = text.partition("|")
    if not bar:
        m = re.match(r"(\S+ \d{1,2}:\d{2}(?::\d{2})?|\S+)\s+(.*)", text, re.S)
        time, rest = (m.group(1), m.group(2)) if m else (text, "")
    return time.strip(), rest.strip()


def timeline(groups: DataFrame, spike_rows: DataFrame, source: str, milestones: DataFrame | None = None, commits: DataFrame | None = None, most_groups: int = 100,
             since: str | None = None, until: str | None = None) -> DataFrame:
    """ts, kind, level, text, source, seq, gap_s, pos in order of time: first occurrences of warning groups, spikes, milestones (ts, text) and commits (ts, text), within a window if
    given. An event of the same kind, source and first 60 letters within a minute after the last kept one is left out.
    Input is aggregated, so the ordering window is small whatever the logs."""
    first = groups.where((F.col("level_rank") >= WARN) & F.col("first_ts").isNotNull() & (F.col("n") <= most_groups)).select(
        F.col("first_ts").alias("ts"), F.lit("first_seen").alias("kind"), "level", F.substring("template", 1, 140).alias("text"), F.lit(source).alias("source"), F.col("n").cast("long").alias("seq"))
    hot = spike_rows.select(F.col("bucket").alias("ts"), F.lit("spike").alias("kind"), F.lit("WARN").alias("level"), F.concat(F.col("count"), F.lit(" records in a minute")).alias("text"),
                            F.lit(source).alias("source"), F.lit(10_000).cast("long").alias("seq"))
    out = first.unionByName(hot)
    for kind, df in (("milestone", milestones), ("commit", commits)):
        if df is not None:
            out = out.unionByName(df.select("ts", F.lit(kind).alias("kind"), F.lit("INFO").alias("level"), "text", F.lit(kind).alias("source"), F.lit(20_000).cast("long").alias("seq")))
    return ordered(out, since, until)


def ordered(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events of one or several feeds in one order, without repeats: what timeline() does with its parts."""
    out = events
    for bound, keep in ((since, lambda t, x: t >= x), (until, lambda t, x: t <= x)):
        if bound:
            out = out.where(keep(F.col("ts"), F.lit(bound).cast("timestamp_ntz")))
    out = out.withColumns({"us": F.expr("unix_micros(cast(ts as timestamp))"), "__t": F.substring("text", 1, 60)})
    kept = once_a_minute(out.where("us is not null"), ["kind", "source", "__t"])
    once = out.where("us is not null").join(kept, ["kind", "source", "__t", "us"], "left_semi").dropDuplicates(["kind", "source", "__t", "us"])
    out = once.unionByName(out.where("us is null"), allowMissingColumns=True).drop("us", "__t")
    w = Window.orderBy(F.col("ts").asc_nulls_last(), "source", "seq", "kind")
    gap = F.expr("(unix_micros(cast(ts as timestamp)) - unix_micros(cast(__b as timestamp))) / 1000000.0")
    return out.withColumn("__b", F.lag("ts").over(w)).withColumn("gap_s", F.when(gap >= 60, gap)).withColumn("pos", F.row_number().over(w)).drop("__b")


def first_event(feed: DataFrame) -> DataFrame:
    """The earliest first occurrence of the feed: where to look for the cause. None if there is none."""
    return feed.where("kind = 'first_seen'").orderBy("pos").limit(1)


def within_budget(items: DataFrame, length: str, order: list[Column], budget: int) -> DataFrame:
    """The prefix of ordered items whose lengths add up to at most `budget`; the first always. Items are a report's rows, few by nature."""
    w = Window.orderBy(*order)
    run = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("__run", run).withColumn("__rn", F.row_number().over(w)).where((F.col("__run") <= budget) | (F.col("__rn") == 1)).drop("__run", "__rn")


def within_budget_early(groups: DataFrame, length: str, budget: int, early: int = 2) -> DataFrame:
    """The same over report groups (n, first_ts): the first group, then the `early` earliest ones, which often name the cause, then the rest by n; in order of n."""
    w = Window.orderBy(F.col("first_ts").asc_nulls_last(), "n")
    d = groups.withColumn("__early", F.when(F.col("first_ts").isNotNull(), F.row_number().over(w)))
    d = d.withColumn("__o", F.when(F.col("n") == 1, 0).when(F.col("__early") <= early, 1).otherwise(2))
    kept = within_budget(d, length, [F.col("__o"), F.when(F.col("__o") == 1, F.col("__early")).otherwise(F.col("n"))], budget)
    return kept.drop("__early", "__o").orderBy("n")
