"""Queries of the log-forensics operators over the driver's tables, each with SQL where SQL can express it.

Log text is rendered from the events table in four formats, run through the operators, and checked against SQL that computes the answer straight from
the columns: the SQL needs no parser and shares nothing with ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.config import EngineConfig
from faultline.functions import scrub, text as tx
from faultline.functions.instants import with_instant
from faultline.operators import alert_cards, analyze, code, confidence, correlate, kb_search, records as rec
from faultline.operators.exactly_once import split_by_frequency
from faultline.operators.log_entries import log_entries
from faultline.session import table


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log entry: plain, JSON, key=value or access line by event_id; plain errors carry a stack trace of two more lines."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    k = F.col("event_id") % 900 + 10
    msg = (F.when(F.col("event_type") == "click", F.concat(F.lit("page opened in "), k, F.lit(" ms"))).when(F.col("event_type") == "view", F.concat(F.lit("cache warmed for user "), "user_id"))
           .when(F.col("event_type") == "error", F.concat(F.lit("PaymentError: timed out after "), k, F.lit(" ms"))).when(F.col("event_type") == "signup", F.concat(F.lit("signup throttled, retry "), k))
           .otherwise(F.concat(F.lit("order "), "event_id", F.lit(" paid"))))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    svc = F.concat(F.lit("svc-"), F.col("event_id") % 3)
    trace = F.concat(F.lit("req-"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    at = lambda p: F.date_format("ts", p)
    status = F.when(F.col("event_type") == "error", 502).when(F.col("event_type") == "signup", 404).otherwise(200)
    plain = F.concat(at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" ["), svc, F.lit("] "), msg, F.lit(" trace_id="), trace)
    json = F.concat(F.lit('{"timestamp":"'), at("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('Z","level":"'), F.lower(level), F.lit('","service":"'), svc, F.lit('","trace_id":"'), trace, F.lit('","message":"'), msg, F.lit('"}'))
    pairs = F.concat(F.lit("ts="), at("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z level="), F.lower(level), F.lit(" service="), svc, F.lit(" trace_id="), trace, F.lit(' msg="'), msg, F.lit('"'))
    access = F.concat(F.lit("10.0.0.1 - - ["), at("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /api/'), "event_type", F.lit(' HTTP/1.1" '), status, F.lit(" 512"))
    fmt = F.col("event_id") % 4
    lines = F.when(fmt == 0, F.when(F.col("event_type") == "error", F.array(plain, F.lit("java.io.IOException: boom"), F.lit("\tat com.acme.Svc.pay(Svc.java:142)"))).otherwise(F.array(plain))) \
        .when(fmt == 1, F.array(json)).when(fmt == 2, F.array(pairs)).otherwise(F.array(access))
    d = e.select((F.col("event_id") % 5).cast("int").alias("src"), F.lit(0).alias("entry"), F.col("event_id"), F.posexplode(lines).alias("p", "text"))
    return d.select("src", "entry", F.concat(F.lit("app-"), "src", F.lit(".log")).alias("origin"), (F.col("event_id") * 4 + F.col("p")).alias("line_no"), "text")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.read_records(rendered(spark, sf_dir), EngineConfig())


def _us(c: str) -> F.Column:
    return F.expr(f"unix_micros(cast({c} as timestamp))")


_BASE = """WITH base AS (SELECT event_id, user_id, event_type, event_id % 4 AS f,
  CASE WHEN event_id % 4 = 3 THEN (epoch_us(ts) // 1000000) * 1000000 ELSE (epoch_us(ts) // 1000) * 1000 END AS us FROM events),
r AS (SELECT *, CASE f WHEN 0 THEN 'plain' WHEN 1 THEN 'json' WHEN 2 THEN 'logfmt' ELSE 'access' END AS fmt,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' AND f <> 3 THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE WHEN f = 3 THEN 'access' ELSE 'svc-' || (event_id % 3) END AS source,
  CASE WHEN f = 3 THEN NULL ELSE 'req-' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS trace,
  CASE WHEN f <> 3 THEN NULL WHEN event_type = 'error' THEN 502 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS status,
  CASE WHEN f = 3 THEN 'GET <path> -> HTTP <n>' ELSE
    CASE event_type WHEN 'click' THEN 'page opened in <n> ms' WHEN 'view' THEN 'cache warmed for user <n>' WHEN 'error' THEN 'PaymentError: timed out after <n> ms'
      WHEN 'signup' THEN 'signup throttled, retry <n>' ELSE 'order <n> paid' END
    || CASE f WHEN 0 THEN ' trace_id=<n>' WHEN 2 THEN ' service=<n> trace_id=<n>' ELSE '' END
    || CASE WHEN f = 0 AND event_type = 'error' THEN ' | java.io.IOException: boom ⏎ at com.acme.Svc.pay(Svc.java:<n>)' ELSE '' END END AS template
  FROM base) """

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query(_BASE + "SELECT event_id * 4 AS line_no, us, f <> 0 AS tz_known, level, source, trace, status, fmt FROM r")
def parse_records(spark, sf_dir):
    """Every record's fields."""
    return records(spark, sf_dir).select("line_no", _us("ts").alias("us"), "tz_known", "level", "source", "trace", "status", "fmt")


@query(_BASE + """SELECT level, template, count(*) AS n_records, min(us) AS first_us, max(us) AS last_us,
  row_number() OVER (ORDER BY level IN ('WARN', 'ERROR') DESC, count(*) DESC, CASE level WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 3 WHEN 'INFO' THEN 2 ELSE 1 END DESC,
    min((event_id % 5) * 100000000000 + event_id)) AS n FROM r GROUP BY level, template""")
def group_templates(spark, sf_dir):
    """Groups by level and template in report order."""
    return analyze.groups(records(spark, sf_dir)).select("level", "template", F.col("count").alias("n_records"), _us("first_ts").alias("first_us"), _us("last_ts").alias("last_us"), F.col("n").cast("long").alias("n"))


def _count_query(name: str, by: str, what: str):
    def f(spark, sf_dir):
        return analyze.counts(records(spark, sf_dir), by).select(F.col(by).cast("string").alias("value"), F.col("count").alias("n_records"))

    f.__name__, f.__doc__ = name, what
    query(_BASE + f"SELECT CAST({by} AS VARCHAR) AS value, count(*) AS n_records FROM r WHERE {by} IS NOT NULL GROUP BY 1")(f)


_count_query("count_levels", "level", "A2: records by level.")
_count_query("count_formats", "fmt", "A3: records by format.")
_count_query("count_services", "source", "A5: records by service.")
_count_query("count_statuses", "status", "A6: records by HTTP status.")


@query("SELECT 'app-' || (event_id % 5) || '.log' AS value, count(*) AS n_records FROM events GROUP BY 1")
def count_origins(spark, sf_dir):
    """A4: records by file."""
    return analyze.counts(records(spark, sf_dir), "origin").select(F.col("origin").alias("value"), F.col("count").alias("n_records"))


@query(_BASE + """SELECT x AS exception, count(*) AS n_records FROM (SELECT unnest(CASE WHEN f = 0 THEN ['PaymentError', 'java.io.IOException'] ELSE ['PaymentError'] END) AS x
  FROM r WHERE event_type = 'error' AND f <> 3) GROUP BY 1""")
def count_exceptions(spark, sf_dir):
    """Exception classes, once per record."""
    return analyze.exception_counts(records(spark, sf_dir)).select("exception", F.col("count").alias("n_records"))


@query(_BASE + "SELECT count(*) AS records, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (f <> 0) AS known, count(*) FILTER (f = 0) AS unknown, count(*) FILTER (f = 0) > 0 AND count(*) FILTER (f <> 0) > 0 AS mixed FROM r")
def count_period(spark, sf_dir):
    """Period and zones."""
    return analyze.period(records(spark, sf_dir)).select("records", _us("first_ts").alias("first_us"), _us("last_ts").alias("last_us"), F.col("tz_known").alias("known"), F.col("tz_unknown").alias("unknown"), "mixed")


@query(_BASE + "SELECT (us // 60000000) * 60000000 AS bucket_us, count(*) AS n_records FROM r WHERE level IN ('WARN', 'ERROR') GROUP BY 1")
def histogram_minutes(spark, sf_dir):
    """Minutes of warnings and above."""
    return analyze.histogram(records(spark, sf_dir), 1, "WARN").select(_us("bucket").alias("bucket_us"), F.col("count").alias("n_records"))


@query(_BASE + """, m AS (SELECT (us // 60000000) * 60000000 AS b FROM r WHERE level IN ('WARN', 'ERROR')),
w AS (SELECT (max(b) - min(b)) // 60000000 AS span FROM m),
k AS (SELECT CASE WHEN span / 1 <= 30 THEN 1 WHEN span / 5 <= 30 THEN 5 WHEN span / 15 <= 30 THEN 15 WHEN span / 30 <= 30 THEN 30 WHEN span / 60 <= 30 THEN 60 WHEN span / 180 <= 30 THEN 180 WHEN span / 720 <= 30 THEN 720 ELSE 1440 END AS minutes FROM w)
SELECT (b // (minutes * 60000000::BIGINT)) * (minutes * 60000000::BIGINT) AS bucket_us, minutes, count(*) AS n_records FROM m, k GROUP BY 1, 2""")
def histogram_drawn(spark, sf_dir):
    """The same in buckets of fitting width."""
    return analyze.drawn_histogram(analyze.histogram(records(spark, sf_dir), 1, "WARN")).select(_us("bucket").alias("bucket_us"), F.col("minutes").cast("int").alias("minutes"), F.col("count").alias("n_records"))


@query(_BASE + "SELECT trace, n_errors FROM (SELECT trace, count(*) AS n_errors, min((event_id % 5) * 100000000000 + event_id) AS o FROM r WHERE level = 'ERROR' AND trace IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, o LIMIT 10)")
def trace_errors(spark, sf_dir):
    """Request ids with most errors, ten of them as the report shows."""
    return analyze.trace_errors(records(spark, sf_dir)).select("trace", F.col("count").alias("n_errors"))


@query(_BASE + """, x AS (SELECT unnest(CASE WHEN f = 0 THEN ['PaymentError', 'java.io.IOException'] ELSE ['PaymentError'] END) AS x FROM r WHERE event_type = 'error' AND f <> 3),
e AS (SELECT 1 AS k, row_number() OVER (ORDER BY count(*) DESC, x) AS rk, 'exception' AS kind, x AS value, count(*) AS n_records FROM x GROUP BY x),
h AS (SELECT 2 AS k, status AS rk, 'http' AS kind, 'http_status=' || status AS value, count(*) AS n_records FROM r WHERE status >= 500 GROUP BY status),
g AS (SELECT 3 AS k, row_number() OVER (ORDER BY count(*) DESC, level = 'ERROR' DESC, min((event_id % 5) * 100000000000 + event_id)) AS rk, 'template' AS kind, 'tmpl:' || split_part(template, ' | ', 1) AS value, count(*) AS n_records
  FROM r WHERE level IN ('WARN', 'ERROR') GROUP BY level, template)
SELECT row_number() OVER (ORDER BY k, rk) AS ord, kind, value, n_records FROM (SELECT * FROM e WHERE rk <= 6 UNION ALL SELECT * FROM h UNION ALL SELECT * FROM g) QUALIFY ord <= 12""")
def signatures(spark, sf_dir):
    """The signature of the incident, twelve at most."""
    return analyze.signatures(records(spark, sf_dir)).select(F.col("ord").cast("long").alias("ord"), "kind", "value", F.col("count").alias("n_records"))


@query(_BASE + "SELECT count(*) AS n_records FROM r WHERE level = 'ERROR'")
def filter_level(spark, sf_dir):
    """errors; records whose first line names a lower level are never put together or parsed."""
    return rec.read_records(rendered(spark, sf_dir), level="ERROR").agg(F.count(F.lit(1)).alias("n_records"))


@query(_BASE + "SELECT level, count(*) AS n_records FROM r WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-06 12:00:00') GROUP BY 1")
def filter_window(spark, sf_dir):
    """a window of time, both ends included."""
    return analyze.counts(rec.within(records(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-06 12:00:00"), "level").select("level", F.col("count").alias("n_records"))


@query(_BASE + "SELECT fmt, count(*) AS n_records FROM r WHERE event_type = 'signup' AND f <> 3 OR f = 3 AND event_type = 'signup' GROUP BY 1")
def filter_grep(spark, sf_dir):
    """a pattern in any case over whole records."""
    return analyze.counts(rec.grep(records(spark, sf_dir), "SIGNUP (throttled)|/signup"), "fmt").select("fmt", F.col("count").alias("n_records"))


def traced(spark, sf_dir) -> DataFrame:
    return correlate.trace_key(records(spark, sf_dir)).withColumn("service", F.col("source"))


@query(_BASE + "SELECT trace AS key, count(*) AS records, count(*) FILTER (level = 'ERROR') AS errors, count(DISTINCT source) AS services, min(us) AS first_us, max(us) AS last_us FROM r WHERE trace IS NOT NULL GROUP BY 1")
def trace_candidates(spark, sf_dir):
    """Request ids with records, errors and services."""
    return correlate.trace_candidates(traced(spark, sf_dir)).select("key", "records", "errors", "services", _us("first_ts").alias("first_us"), _us("last_ts").alias("last_us"))


@query(_BASE + """, h AS (SELECT trace AS key, source AS service, min(us) AS first_us, count(*) AS records, count(*) FILTER (level = 'ERROR') AS errors FROM r WHERE trace IS NOT NULL GROUP BY 1, 2)
SELECT key, service, first_us, records, errors, row_number() OVER w AS hop, first_us - lag(first_us) OVER w AS gap_us FROM h WINDOW w AS (PARTITION BY key ORDER BY first_us, service)""")
def trace_hops(spark, sf_dir):
    """Hops of each request with the gap to the hop before."""
    return correlate.hops(traced(spark, sf_dir)).select("key", "service", _us("first_ts").alias("first_us"), "records", "errors", F.col("hop").cast("long").alias("hop"), F.round(F.col("gap_s") * 1e6).cast("long").alias("gap_us"))


@query(_BASE + """SELECT key, us, service, line_no FROM (SELECT trace AS key, us, source AS service, event_id * 4 AS line_no, row_number() OVER (PARTITION BY trace ORDER BY us, source, event_id) AS n
  FROM r WHERE level = 'ERROR' AND trace IS NOT NULL) WHERE n = 1""")
def trace_break_points(spark, sf_dir):
    """Where each request first failed."""
    return correlate.break_points(traced(spark, sf_dir)).select("key", _us("ts").alias("us"), "service", "line_no")


@query("""WITH o AS (SELECT o_custkey AS key, 'orders' AS service, min(epoch_us(o_orderdate)) AS us FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS key, 'ship-' || CAST(l_linenumber AS VARCHAR) AS service, min(epoch_us(l_shipdate)) AS us FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
e AS (SELECT * FROM o UNION ALL SELECT * FROM l), d AS (SELECT x.service AS a, y.service AS b, (y.us - x.us) / 1000000.0 AS d FROM e x JOIN e y ON x.key = y.key AND x.service < y.service),
m AS (SELECT a, b, count(*) AS n, median(d) AS m FROM d GROUP BY 1, 2)
SELECT d.a, d.b, m.n, CAST(round(m.m) AS BIGINT) AS median_s, CAST(round(median(abs(d.d - m.m))) AS BIGINT) AS mad_s, median(abs(d.d - m.m)) <= greatest(abs(m.m) * 0.25, 0.5) AS systematic
FROM d JOIN m USING (a, b) WHERE m.n >= 3 AND abs(m.m) >= 2 GROUP BY 1, 2, 3, m.m""")
def clock_skew(spark, sf_dir):
    """Median and spread of time differences between sources with shared keys, over all lines of all orders, eight sources."""
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").cast("string").alias("key"), F.lit("orders").alias("service"), F.col("o_orderdate").alias("ts"))
    b = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("key"), F.concat(F.lit("ship-"), F.col("l_linenumber").cast("string")).alias("service"), F.col("l_shipdate").alias("ts"))
    return correlate.clock_skew(a.unionByName(b)).select("a", "b", "n", F.round("median_s").cast("long").alias("median_s"), F.round("mad_s").cast("long").alias("mad_s"), "systematic")


def _hours(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


@query("""WITH RECURSIVE m AS (SELECT event_type AS series, (epoch_us(ts) // 3600000000) * 3600000000 AS us, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT *, avg(n) OVER (PARTITION BY series ORDER BY us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base, row_number() OVER (PARTITION BY series ORDER BY us) AS rn, count(*) OVER (PARTITION BY series) AS total FROM m),
h AS (SELECT series, us, n, row_number() OVER (PARTITION BY series ORDER BY us) AS i FROM s WHERE total >= 3 AND rn > 1 AND n >= 5 AND n >= greatest(base * 1.2, base + 1)),
k AS (SELECT series, us, n, i, us AS last, true AS kept FROM h WHERE i = 1 UNION ALL
  SELECT h.series, h.us, h.n, h.i, CASE WHEN h.us - k.last <= 7200000000 THEN k.last ELSE h.us END, h.us - k.last > 7200000000 FROM k JOIN h ON h.series = k.series AND h.i = k.i + 1)
SELECT series, us, n AS n_records FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY us) AS q FROM k WHERE kept) WHERE q <= 8""")
def timeline_spikes(spark, sf_dir):
    """Hours that stand out, merged greedily."""
    return correlate.spikes(_hours(spark, sf_dir), "series", factor=1.2, more=1, apart_minutes=120).select("series", _us("bucket").alias("us"), F.col("count").alias("n_records"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT event_type AS kind, user_id AS who, epoch_us(ts) AS us FROM events WHERE user_id % 10 = user_id % 10),
o AS (SELECT *, row_number() OVER (PARTITION BY kind, who ORDER BY us) AS i FROM t),
k AS (SELECT kind, who, us, i, us AS last, true AS kept FROM o WHERE i = 1 UNION ALL
  SELECT o.kind, o.who, o.us, o.i, CASE WHEN o.us - k.last < 21600000000 THEN k.last ELSE o.us END, o.us - k.last >= 21600000000 FROM k JOIN o ON o.kind = k.kind AND o.who = k.who AND o.i = k.i + 1)
SELECT kind, who, us FROM k WHERE kept""")
def timeline_once(spark, sf_dir):
    """Events of one kind not repeated within a span after the last one kept."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("who"), _us("ts").alias("us"))
    return correlate.once_a_minute(e, ["kind", "who"], gap_us=21_600_000_000)


@query()
def timeline_feed(spark, sf_dir):
    """First occurrences and spikes in one feed."""
    r = records(spark, sf_dir)
    s = correlate.spikes(analyze.histogram(r, 60, "WARN").withColumn("series", F.lit("all")), factor=1.2, more=1, apart_minutes=120)
    return correlate.timeline(analyze.groups(r), s, "app").select("pos", _us("ts").alias("us"), "kind", "level", "text", "gap_s")


@query("SELECT value, count(*) AS n_entries FROM (SELECT DISTINCT kb_id, unnest(tags) AS value FROM kb_incidents WHERE coalesce(nullif(lower(trim(kind)), ''), 'incident') = 'incident') GROUP BY 1")
def kb_counts(spark, sf_dir):
    """Incidents by tag."""
    return kb_search.counts(kb_search.from_table(table(spark, sf_dir, "kb_incidents")), "tags").select("value", F.col("count").alias("n_entries"))


@query("""SELECT kb_id FROM kb_incidents WHERE coalesce(nullif(lower(trim(kind)), ''), 'incident') = 'incident' AND list_has_any(list_transform(coalesce(services, []), lambda x: lower(x)), ['payment-api', 'gateway'])
  AND NOT (len(coalesce(stands, [])) > 0 AND list_has_all(['dev'], list_transform(stands, lambda x: lower(x))))""")
def kb_filters(spark, sf_dir):
    """Entries of two services, not only on one stand."""
    e = kb_search.from_table(table(spark, sf_dir, "kb_incidents"))
    return kb_search.filtered(e, service=["Payment-API", "gateway"], exclude_stand=["dev"]).select("kb_id")


@query("""SELECT kb_id FROM (SELECT kb_id, inc_id, row_number() OVER (PARTITION BY inc_id ORDER BY recorded_at DESC NULLS LAST, kb_id DESC) AS n FROM kb_incidents) WHERE n = 1 OR inc_id IS NULL""")
def kb_latest(spark, sf_dir):
    """The newest revision of each entry."""
    return kb_search.latest_revision(table(spark, sf_dir, "kb_incidents")).select("kb_id")


@query("SELECT kb_id, CASE WHEN lower(trim(outcome)) IN ('confirmed', 'refuted') THEN lower(trim(outcome)) ELSE 'unverified' END AS outcome FROM kb_incidents")
def kb_outcomes(spark, sf_dir):
    """Outcome of every entry, unverified unless it says otherwise."""
    return table(spark, sf_dir, "kb_incidents").select("kb_id", kb_search.outcome(F.col("outcome")).alias("outcome"))


@query()
def kb_similar(spark, sf_dir):
    """Entries most like the signature of an incident, ten as the report shows."""
    e = kb_search.from_table(table(spark, sf_dir, "kb_incidents")).withColumn("id", F.concat_ws("#", "id", "kb_id"))
    return kb_search.search(e, "payment pool timeout", ["tmpl:ConnectionTimeoutError: timed out waiting for connection from pool after <n> ms", "PoolExhaustedError"])


@query()
def kb_similar_all(spark, sf_dir):
    """Every entry whose kb_id is divisible by 20 as a query, by title and signatures, against all entries."""
    kb = table(spark, sf_dir, "kb_incidents")
    e = kb_search.from_table(kb).withColumn("id", F.concat_ws("#", "id", "kb_id"))
    return kb_search.search_all(kb.where("kb_id % 20 = 0").select(F.col("kb_id").alias("query_id"), F.col("title").alias("text"), "signatures"), e)


@query("""SELECT delivery_id, CASE WHEN json_extract(payload, '$.alerts[0].labels') IS NOT NULL OR json_extract(payload, '$.alerts[0].startsAt') IS NOT NULL THEN 'alertmanager'
  WHEN json_extract(payload, '$.data.event') IS NOT NULL THEN 'sentry' WHEN json_extract(payload, '$.ruleName') IS NOT NULL OR json_extract(payload, '$.evalMatches') IS NOT NULL OR json_extract(payload, '$.ruleUrl') IS NOT NULL THEN 'grafana' END AS shape
  FROM alerts""")
def alert_shapes(spark, sf_dir):
    """The reader of each payload."""
    return table(spark, sf_dir, "alerts").select("delivery_id", alert_cards.shape(F.col("payload")).alias("shape"))


@query()
def alert_incidents(spark, sf_dir):
    """Incident cards of all deliveries."""
    c = alert_cards.cards(table(spark, sf_dir, "alerts"))
    return c.withColumn("missing", F.array_join("missing", ",")).withColumn("since", _us("since")).withColumn("until", _us("until"))


@query()
def code_frames(spark, sf_dir):
    """X11: frames of all seven expressions in all log lines, distinct by base and line."""
    return code.frames(table(spark, sf_dir, "log_lines")).select("base", "line", "path", "symbol", "records")


@query(r"""SELECT base, line, count(*) AS n_frames FROM (SELECT regexp_extract(x, '\(([\w$]+\.(?:java|kt|scala)):(\d+)\)', 1) AS base, CAST(regexp_extract(x, '\(([\w$]+\.(?:java|kt|scala)):(\d+)\)', 2) AS INTEGER) AS line
  FROM (SELECT unnest(regexp_extract_all(raw, 'at\s+[\w.$]+\.[\w$<>]+\([\w$]+\.(?:java|kt|scala):\d+\)')) AS x FROM log_lines)) GROUP BY 1, 2""")
def code_frames_java(spark, sf_dir):
    """X11: Java frames of all log lines, every one counted."""
    pattern, path, line, _ = tx.FRAMES[0]
    x = F.arrays_zip(F.regexp_extract_all("raw", F.lit(pattern), path).alias("base"), F.regexp_extract_all("raw", F.lit(pattern), line).alias("line"))
    return table(spark, sf_dir, "log_lines").select(F.explode(x).alias("x")).select("x.base", F.col("x.line").cast("int").alias("line")).groupBy("base", "line").agg(F.count(F.lit(1)).alias("n_frames"))


@query(r"""SELECT base, line, count(*) AS n_frames FROM (SELECT parse_filename(regexp_extract(x, 'File "([^"]+)", line (\d+)', 1)) AS base, CAST(regexp_extract(x, 'File "([^"]+)", line (\d+)', 2) AS INTEGER) AS line
  FROM (SELECT unnest(regexp_extract_all(raw, 'File "[^"]+", line \d+')) AS x FROM log_lines)) GROUP BY 1, 2""")
def code_frames_python(spark, sf_dir):
    """X11: Python frames of all log lines, every one counted."""
    pattern, path, line, _ = tx.FRAMES[1]
    x = F.arrays_zip(F.regexp_extract_all("raw", F.lit(pattern), path).alias("path"), F.regexp_extract_all("raw", F.lit(pattern), line).alias("line"))
    d = table(spark, sf_dir, "log_lines").select(F.explode(x).alias("x")).select(F.element_at(F.split("x.path", "/"), -1).alias("base"), F.col("x.line").cast("int").alias("line"))
    return d.groupBy("base", "line").agg(F.count(F.lit(1)).alias("n_frames"))


@query("SELECT p_brand AS base, p_size AS line, count(*) AS n FROM part GROUP BY 1, 2")
def code_join(spark, sf_dir):
    """Frames joined to files by name, here brands as names; the count checks that no row is lost or doubled."""
    p = table(spark, sf_dir, "part")
    frames = p.groupBy(F.col("p_brand").alias("base"), F.col("p_size").alias("line")).agg(F.count(F.lit(1)).alias("records"), F.first("p_brand").alias("path"))
    files = p.select(F.concat(F.lit("src/"), "p_brand").alias("path")).distinct()
    return code.resolve(frames, files).select("base", "line", F.col("records").alias("n"))


@query()
def scrub_texts(spark, sf_dir):
    """Secrets and personal data masked in one pass, with counts by kind, in both free texts of every entry."""
    kb = table(spark, sf_dir, "kb_incidents")
    t = kb.select("kb_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("symptoms", "root_cause")])).alias("x")).select("kb_id", "x.*")
    return t.select("kb_id", "field", scrub.scrub(F.col("text")).alias("text"), F.to_json(scrub.scrub_counts(F.col("text"))).alias("counts"))


@query("""SELECT event_type, CAST(round(total * 10000) AS BIGINT) AS total_e4, CASE WHEN total >= 0.7 THEN 'confirmed_by_data' WHEN total >= 0.4 THEN 'likely_cause' WHEN total > 0 THEN 'hypothesis' ELSE 'insufficient_data' END AS verdict FROM (
  SELECT event_type, 0.3 * least(1.0, 0.4 + CASE WHEN count(*) >= 3 THEN 0.3 WHEN count(*) > 0 THEN 0.15 ELSE 0 END + 0.1) + 0.3 * least(1.0, greatest(0.0, (count(DISTINCT user_id) / 10.0 - 3) / 17)) + 0.25 * 0.55 + 0.15 * 1.0 AS total FROM events GROUP BY 1)""")
def confidence_total(spark, sf_dir):
    """Contours and verdict."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"))
    e = e.select("event_type", confidence.logs_contour(F.lit(1), F.col("n"), F.lit(3), F.lit(1.0), F.lit(1.0)).alias("logs"),
                 confidence.kb_contour(F.col("u") / 10.0, F.lit("confirmed"), F.lit(True), F.lit(True)).alias("kb"),
                 confidence.code_contour(F.lit(1), F.lit(0), F.lit(0), F.lit(1)).alias("code"), confidence.trace_contour(F.lit(2), F.lit(True)).alias("trace"))
    return confidence.combine(e).select("event_type", F.round(F.col("total") * 10000).cast("long").alias("total_e4"), "verdict")


@query("""SELECT n_nationkey, n_name FROM (SELECT *, sum(len) OVER (ORDER BY n_name, n_nationkey ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (ORDER BY n_name, n_nationkey) AS q FROM (SELECT n_nationkey, n_name, length(n_name) AS len FROM nation)) WHERE s <= 60 OR q = 1""")
def report_budget(spark, sf_dir):
    """The items that fit a report's budget."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.length("n_name").alias("len"))
    return correlate.within_budget(n, "len", [F.col("n_name"), F.col("n_nationkey")], 60).select("n_nationkey", "n_name")


@query(_BASE + "SELECT coalesce(level, '') AS level, coalesce(source, '') AS source, count(*) AS n_records FROM r GROUP BY ROLLUP (level, source)")
def rollup_level_service(spark, sf_dir):
    """Extension: records by level and service with subtotals."""
    return records(spark, sf_dir).rollup("level", "source").agg(F.count(F.lit(1)).alias("n_records")).select(F.coalesce("level", F.lit("")).alias("level"), F.coalesce("source", F.lit("")).alias("source"), "n_records")


@query("SELECT c_custkey, 'SRC-' || lower(c_mktsegment) || '-' || regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS id FROM customer")
def text_slugs(spark, sf_dir):
    """Source-map identifiers."""
    return table(spark, sf_dir, "customer").select("c_custkey", tx.source_entry_id(F.col("c_mktsegment"), F.col("c_name")).alias("id"))


_STEM_SQL = (f"CASE WHEN length(w) <= 4 THEN w WHEN regexp_matches(w, '[а-яё]') THEN regexp_replace(w, '^(.{{4,}}?)(?:{'|'.join(tx.RU_ENDINGS)})$', '\\1') "
             f"WHEN length(w) > 6 THEN regexp_replace(w, '^(.{{4,}}?)(?:{'|'.join(tx.EN_ENDINGS)})$', '\\1') ELSE w END")


@query("SELECT " + _STEM_SQL + " AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[0-9a-zа-яё_]{2,}')) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN ("
       + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ") GROUP BY 1")
def text_tokens(spark, sf_dir):
    """Stems of all documents with their frequency."""
    return table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT kb_id, i, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(s)), '^tmpl:', ''), '<\w+>', '<v>', 'g'), '\s+', ' ', 'g'), ' .,:;|') AS signature
  FROM (SELECT kb_id, unnest(range(len(signatures))) AS i, unnest(signatures) AS s FROM kb_incidents)""")
def text_signatures(spark, sf_dir):
    """Every signature of the knowledge base in comparable form."""
    k = table(spark, sf_dir, "kb_incidents").select("kb_id", F.posexplode("signatures").alias("i", "s"))
    return k.select("kb_id", F.col("i").cast("long").alias("i"), tx.norm_signature(F.col("s")).alias("signature"))


#: A message for each mask, with {} for a number, and the template it has.
MASKED = [
    ("see https://a.b/c?d={} now", "see <url> now"), ("mail a.b{}@c.example sent", "mail <email> sent"), ("id 123e4567-e89b-12d3-a456-426614174000 of {}", "id <uuid> of <n>"), ("at 2026-07-28T12:00:00.5Z run {}", "at <ts> run <n>"),
    ("from 10.0.0.1:80 to {}", "from <ip> to <n>"), ("slot 12:34:56 of {}", "slot <time> of <n>"), ("file /var/log/x{}.log gone", "file <path> gone"), ("digest 0123456789abcdef part {}", "digest <hex> part <n>"), ("key \"abc\" in {}", "key <str> in <n>"),
    ("key ''abc'' in {}", "key <str> in <n>"), ("rows {}, 7, 8 left", "rows <n> left"), ("  spaced   out  {} :", "spaced out <n>"),
]


@query("SELECT CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(MASKED)) + " END AS template, count(*) AS n FROM events GROUP BY 1")
def text_templates(spark, sf_dir):
    """Every mask."""
    msg = F.element_at(F.array(*[F.lit(m.replace("''", "'")) for m, _ in MASKED]), (F.col("event_id") % 12 + 1).cast("int"))
    d = table(spark, sf_dir, "events").select(F.replace(msg, F.lit("{}"), (F.col("event_id") % 900 + 1).cast("string")).alias("message"))
    return tx.with_template(d).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n, CASE WHEN n IN (10, 20, 30, 40, 50) THEN CASE n WHEN 10 THEN 'DEBUG' WHEN 20 THEN 'INFO' WHEN 30 THEN 'WARN' WHEN 40 THEN 'ERROR' ELSE 'FATAL' END WHEN n BETWEEN 100 AND 599 THEN CASE WHEN n >= 500 THEN 'ERROR' WHEN n >= 400 THEN 'WARN' ELSE 'INFO' END
  WHEN n BETWEEN 0 AND 7 THEN ['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'NOTICE', 'INFO', 'DEBUG'][n + 1] END AS level, count(*) AS n_events FROM (SELECT event_id % 700 AS n FROM events) GROUP BY 1, 2""")
def level_numbers(spark, sf_dir):
    """Levels written as numbers."""
    d = table(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("n"))
    return d.groupBy("n", rec.norm_level(F.col("n").cast("string")).alias("level")).agg(F.count(F.lit(1)).alias("n_events"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000 WHEN 4 THEN epoch_us(ts) // 1000 * 1000 WHEN 5 THEN epoch_us(ts) ELSE epoch_us(ts) // 1000000 * 1000000 END AS us,
  event_id % 8 NOT IN (3, 7) AS has_zone FROM events""")
def instants_rendered(spark, sf_dir):
    """Eight notations of the same instants, with and without an offset."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    f = lambda p, hours=0: F.date_format(F.col("ts") + F.expr(f"make_dt_interval(0, {hours})"), p)
    us = F.expr("unix_micros(ts)")
    texts = [f("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.concat(f("yyyy-MM-dd HH:mm:ss,SSS", 3), F.lit("+03:00")), F.concat(f("dd/MMM/yyyy:HH:mm:ss", -2), F.lit(" -0200")), f("dd.MM.yyyy HH:mm:ss"), (us / 1000).cast("long").cast("string"),
             F.concat(F.expr("us div 1000000").cast("string"), F.lit("."), F.lpad((F.col("us") % 1000000).cast("string"), 6, "0")), F.concat(f("EEE, d MMM yyyy HH:mm:ss", 1), F.lit(" CET")), f("MMM dd, yyyy h:mm:ss a")]
    d = e.withColumn("us", us).select("event_id", F.element_at(F.array(*texts), (F.col("event_id") % 8 + 1).cast("int")).alias("t"))
    return with_instant(d, "t", "cast(null as string)", out="us").select("event_id", "us", F.col("us_known").alias("has_zone"))


@query(_BASE + """SELECT event_id * 4 AS line_no, CASE WHEN f = 0 AND event_type = 'error' THEN 3 ELSE 1 END AS n_lines,
  CASE WHEN f = 3 THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END ELSE level END AS log_level, source AS component,
  CASE WHEN f = 3 THEN 'GET /api/' || event_type || ' HTTP/1.1' ELSE CASE event_type WHEN 'click' THEN 'page opened in ' || (event_id % 900 + 10) || ' ms' WHEN 'view' THEN 'cache warmed for user ' || user_id
      WHEN 'error' THEN 'PaymentError: timed out after ' || (event_id % 900 + 10) || ' ms' WHEN 'signup' THEN 'signup throttled, retry ' || (event_id % 900 + 10) ELSE 'order ' || event_id || ' paid' END
    || CASE WHEN f = 0 THEN ' trace_id=' || trace ELSE '' END || CASE WHEN f = 0 AND event_type = 'error' THEN chr(10) || 'java.io.IOException: boom' || chr(10) || chr(9) || 'at com.acme.Svc.pay(Svc.java:142)' ELSE '' END END AS message FROM r""")
def entries_rendered(spark, sf_dir):
    """Problem 4 on rendered lines, some shipped twice: level, component and message of every entry."""
    lines = rendered(spark, sf_dir).select(F.col("src").cast("long").alias("file_id"), "line_no", F.xxhash64("src", "line_no").alias("line_id"), F.col("text").alias("raw"))
    return log_entries(lines.unionByName(lines.where("line_no % 3 = 0"))).select("line_no", "n_lines", "log_level", "component", "message")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def once_kept(spark, sf_dir):
    """Problem 1 on events: the first of each user and type."""
    return split_by_frequency(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])[0].select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n > 1")
def once_surplus(spark, sf_dir):
    """Problem 1 on events: all others."""
    return split_by_frequency(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])[1].select("event_id")


@query(_BASE + "SELECT event_id * 4 AS line_no, CASE WHEN f = 0 AND event_type = 'error' THEN 3 ELSE 1 END AS n_lines FROM r")
def stitch_blank_lines(spark, sf_dir):
    """Blank lines between all lines are no part of any record."""
    lines = rendered(spark, sf_dir).withColumn("line_no", F.col("line_no") * 2)
    blank = lines.withColumns({"line_no": F.col("line_no") + 1, "text": F.element_at(F.array(F.lit(""), F.lit("  \t"), F.lit(" ")), (F.col("line_no") % 3 + 1).cast("int"))})
    return rec.stitch(lines.unionByName(blank)).select(F.expr("line_no div 2").alias("line_no"), "n_lines")


@query(_BASE + "SELECT level, count(*) AS n_records FROM r WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-05 00:00:00') AND epoch_us(TIMESTAMP '2024-01-06 12:00:00') GROUP BY 1")
def filter_window_early(spark, sf_dir):
    """a window of time; records whose first line lies outside are never put together or parsed."""
    r = rec.read_records(rendered(spark, sf_dir), since="2024-01-05 00:00:00", until="2024-01-06 12:00:00")
    return analyze.counts(r, "level").select("level", F.col("count").alias("n_records"))


@query(_BASE + "SELECT level, template, source, count(*) AS n_records FROM r GROUP BY 1, 2, 3")
def group_sources(spark, sf_dir):
    """A1: records of each group by source."""
    return analyze.group_sources(records(spark, sf_dir)).select("level", "template", "source", F.col("count").alias("n_records"))


@query(_BASE + "SELECT level, template, 'app-' || (event_id % 5) || '.log' AS origin, count(*) AS n_records FROM r GROUP BY 1, 2, 3")
def group_origins(spark, sf_dir):
    """A1: records of each group by file."""
    return analyze.group_origins(records(spark, sf_dir)).select("level", "template", "origin", F.col("count").alias("n_records"))


@query(_BASE + """, c AS (SELECT trace AS key, source AS service, level AS value, count(*) AS n FROM r WHERE trace IS NOT NULL GROUP BY 1, 2, 3)
SELECT key, service, value, n AS n_records FROM c QUALIFY row_number() OVER (PARTITION BY key, service ORDER BY n DESC, value) <= 3""")
def hop_levels(spark, sf_dir):
    """Levels of each hop."""
    return correlate.hop_counts(traced(spark, sf_dir), "level").select("key", "service", "value", F.col("count").alias("n_records"))


@query(_BASE + """, h AS (SELECT trace AS key, source AS service, min(us) AS us FROM r WHERE trace IS NOT NULL GROUP BY 1, 2), g AS (SELECT key, service, us - lag(us) OVER (PARTITION BY key ORDER BY us, service) AS gap, row_number() OVER (PARTITION BY key ORDER BY us, service) AS hop FROM h)
SELECT key, service FROM g WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY gap DESC, hop) = 1""")
def hop_slowest(spark, sf_dir):
    """The longest wait of each request."""
    return correlate.hops(traced(spark, sf_dir)).where("slowest").select("key", "service")


@query(_BASE + """, e AS (SELECT template AS key, source AS service, min(us) AS us FROM r GROUP BY 1, 2), d AS (SELECT x.service AS a, y.service AS b, (y.us - x.us) / 1000000.0 AS d FROM e x JOIN e y ON x.key = y.key AND x.service < y.service),
m AS (SELECT a, b, count(*) AS n, median(d) AS m FROM d GROUP BY 1, 2) SELECT a, b, n, CAST(round(m * 1000) AS BIGINT) AS median_ms FROM m WHERE n >= 3 AND abs(m) >= 2""")
def clock_skew_by_template(spark, sf_dir):
    """Clock differences from messages of the same template."""
    r = records(spark, sf_dir).withColumn("service", F.col("source"))
    return correlate.clock_skew_by_template(r).select("a", "b", "n", F.round(F.col("median_s") * 1000).cast("long").alias("median_ms"))


@query(_BASE + "SELECT event_id * 4 AS line_no FROM r WHERE trace = 'req-000012'")
def trace_dump(spark, sf_dir):
    """K6: all records that hold an id."""
    return analyze.containing(records(spark, sf_dir), "req-000012").select("line_no")


@query("SELECT kb_id, row_number() OVER (ORDER BY inc_date DESC NULLS LAST, kb_id) AS pos FROM kb_incidents WHERE coalesce(nullif(lower(trim(kind)), ''), 'incident') = 'incident'")
def kb_by_date(spark, sf_dir):
    """Incidents, newest first; the position is worked out over the ordered list."""
    e = kb_search.from_table(table(spark, sf_dir, "kb_incidents")).withColumn("id", F.col("kb_id"))
    return kb_search.by_date(e).withColumn("pos", F.row_number().over(Window.orderBy(F.col("date").desc_nulls_last(), "kb_id")).cast("long")).select("kb_id", "pos")


@query()
def triage_report(spark, sf_dir):
    """The whole chain to one report document."""
    from faultline.plans.triage import report, triage

    e = kb_search.from_table(table(spark, sf_dir, "kb_incidents")).withColumn("id", F.concat_ws("#", "id", "kb_id"))
    return report(triage(rendered(spark, sf_dir), e))


@query(_BASE + """SELECT 'logs' AS contour, template AS detail, count(*) AS n_records FROM r WHERE level = 'ERROR' GROUP BY template ORDER BY count(*) DESC, min((event_id % 5) * 100000000000 + event_id) LIMIT 5""")
def triage_evidence(spark, sf_dir):
    """The evidence of the logs, five groups as the report shows."""
    from faultline.plans.triage import evidence, triage

    return evidence(triage(rendered(spark, sf_dir))).where("contour = 'logs'").select("contour", "detail", F.col("count").alias("n_records"))
