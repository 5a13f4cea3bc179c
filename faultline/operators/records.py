"""Lines of any mix of formats to records: stitching, format dispatch, field extraction, filters.

Input lines: src, entry (a file, or a member of an archive), origin, line_no, text. Every line's start test and time search happen once, before the
shuffle, and so do the tests that rule a record out by its first line. Lines are distributed by (src, entry, block) and put together to records within their
block, in the same shuffle; only the first and the last record of a block, which may go on in the next, take part in a second, small grouping by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.config import EngineConfig
from faultline.functions import instants, levels, text as tx
from faultline.session import fence

BLOCK_LINES = 8192

# Keys of JSON and key=value records, in order of preference.
TIME_KEYS = ["timestamp", "time", "@timestamp", "ts", "date", "datetime", "eventTime", "event_time", "asctime"]
LEVEL_KEYS = ["level", "severity", "lvl", "loglevel", "log_level", "levelname", "levelName", "status"]
MESSAGE_KEYS = ["message", "msg", "log", "short_message", "event", "text", "error", "err", "exception", "body"]
SOURCE_KEYS = ["logger", "logger_name", "loggerName", "source", "caller", "component", "service", "app", "application", "container", "kubernetes.container_name", "name"]
TRACE_KEYS = ["trace_id", "traceId", "traceID", "request_id", "requestId", "requestID", "correlation_id", "correlationId", "x-request-id", "rquid", "rqUID", "span_id", "spanId", "req_id"]
STATUS_KEYS = ["status_code", "statusCode", "http_status", "response_code"]
# Patterns of the formats.
ACCESS = r"^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+\"([A-Z]+)\s+(\S+)[^\"]*\"\s+(\d{3})\s+(\d+|-)"
PAIR = r"([A-Za-z_][\w.\-]*)=(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\s]*)"
TRACE_TEXT = r"(?i)(?:trace[_-]?id|request[_-]?id|correlation[_-]?id|rq[_-]?uid|x-request-id)\s*[=:]\s*[\"']?([\w\-]{6,})"
BRACKET_SOURCE = r"\[([\w.\-]{2,60})\]"
LEVEL_WORD = r"(?<![\w])(?i:" + levels.WORD_PATTERN + r"|erro)(?![\w])"

_ANYWHERE = "(?:" + "|".join(instants.PLAIN[k] for k in ("a", "b", "k", "n")) + ")"
_AT_START = r"^\W{0,2}" + instants.PLAIN["epoch"]


def _get(keys: list[str]) -> Column:
    """First non-empty value of `keys` in the record's map, in the case written, then in any case."""
    first = lambda m, ks: F.try_element_at(F.filter(F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: F.try_element_at(F.col(m), k)), lambda v: v != ""), F.lit(1))
    return F.when(F.col("m").isNotNull(), F.coalesce(first("m", keys), first("ml", [k.lower() for k in keys])))


def norm_level(x: Column) -> Column:
    """A level from a word, a number of Python's logging, an HTTP status or a syslog severity; else from a level word inside."""
    t = F.upper(F.trim(x))
    n = t.try_cast("int")
    one = F.create_map(*[F.lit(v) for kv in {"D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "ERRO": "ERROR"}.items() for v in kv])
    number = (F.when(n.isin(10, 20, 30, 40, 50), levels.level_of_python_number(n)).when(n.between(100, 599), levels.level_of_status(n))
              .when(n.between(0, 7), levels.level_of_priority(n)))
    return F.coalesce(levels.level_of_word(t), F.try_element_at(one, t), F.when(t.rlike(r"^\d+$"), number).otherwise(
        levels.level_of_word(F.nullif(F.regexp_extract(t, LEVEL_WORD, 0), F.lit("")))))


def with_start(lines: DataFrame) -> DataFrame:
    """Add `start`, `time_text` (the first time in the line's head) and `time_end` (where it ends)."""
    head = F.substring("text", 1, 64)
    found = F.coalesce(F.nullif(F.regexp_extract(head, _AT_START, 0), F.lit("")), F.nullif(F.regexp_extract(head, _ANYWHERE, 0), F.lit("")))
    df = lines.withColumn("time_text", F.regexp_replace(found, r"^\W+(?=\d{10})", ""))
    df = df.withColumn("time_end", F.when(F.col("time_text").isNotNull(), F.instr("text", F.col("time_text")) - 1 + F.char_length("time_text")))
    s = F.trim("text")
    start = (F.when(s.startswith("{") & s.endswith("}"), True).when(F.col("text").rlike(r"^[ \t]"), False)
             .when(F.col("time_end") <= 48, True).when(F.col("text").rlike(ACCESS), True)
             .when(s.startswith("Traceback (most recent call last)") | s.startswith("panic:") | s.startswith("fatal error:"), True)
             .when(s.rlike(r"^[A-Za-z_][\w.\-]*=") & F.substring(s, 1, 200).rlike(r"\b(level|severity|lvl|msg|message|time|ts)="), True).otherwise(False))
    return df.withColumn("start", start)


def ruled_out(level: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Whether the first line of a record, as with_start() gives it, says for certain that the record lies below `level` or outside the window. What is not
    certain stays: JSON, access and key=value lines, lines whose level is not the first word after the time, times with an offset or in other notations."""
    out = F.lit(False)
    # with fewer than two '=' a line is no key=value record; its level and time are those at its head
    free = (F.char_length("text") - F.char_length(F.replace("text", F.lit("="), F.lit(""))) < 2) & ~F.ltrim("text").startswith("{")
    if level:
        low = [w for w, x in levels.LEVEL_WORDS.items() if levels.LEVEL_ORDER.index(x) < levels.LEVEL_ORDER.index(level)]
        first = r"(?i)^[ \t]*\[?(?:" + "|".join(sorted(low, key=lambda w: (-len(w), w))) + r")(?![\w])"
        out = out | F.expr("substr(text, time_end + 1, 20)").rlike(first)
    if since or until:
        # wall-clock readings without an offset, and those marked Z, compare as text
        plain = F.col("time_text").rlike(r"^\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?Z?$")
        at = F.translate(F.substring("time_text", 1, 19), "/T", "- ")
        whole = lambda x: (x.replace("T", " ") + "0000-01-01 00:00:00"[len(x):])[:19]
        out = out | (plain & (at < whole(since) if since else F.lit(False))) | (plain & (at > whole(until) if until else F.lit(False)))
    return F.coalesce(free & out, F.lit(False))


def stitch(lines: DataFrame, config: EngineConfig = EngineConfig(), block_lines: int = BLOCK_LINES, level: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per record: src, entry, origin, line_no, first_line, time_text, time_end, raw (its lines; cut only as `config` says), tail, n_lines (kept).

    Records that are ruled_out() by their first line are left out before they are put together; the filters of the parsed records decide on the rest.
    The first line of a file begins a record. Null and blank lines are dropped; an empty table gives no rows; other columns are ignored."""
    text = F.substring("text", 1, config.max_line_chars) if config.max_line_chars else F.col("text")
    d = with_start(lines.select("src", "entry", "origin", "line_no", text.alias("text")).where(F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) != ""))
    d = d.withColumns({"block": F.expr(f"line_no div {block_lines}"), "out": F.col("start") & ruled_out(level, since, until)})
    block = Window.partitionBy("src", "entry", "block")
    d = d.withColumns({"head": F.last(F.when(F.col("start"), F.struct("line_no", "out")), True).over(block.orderBy("line_no")), "newest": F.max(F.when(F.col("start"), F.col("line_no"))).over(block)})
    if level or since or until:
        # of what is left out only the last start of a block stays, without its text: lines of the next block may belong to it
        d = d.where("head is null or not head.out or line_no = newest").withColumn("text", F.when(F.col("head.out"), F.lit("")).otherwise(F.col("text")))
    p = d.groupBy("src", "entry", "block", F.col("head.line_no").alias("rec")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "time_text", "time_end"))).alias("x"), F.min("origin").alias("origin"), F.bool_or("head.out").alias("out"), F.max("newest").alias("last"))
    body = ["src", "entry", "rec", "origin", "x"]
    inner = p.where("rec < last and not out").select(*body)
    # the lines before the first start of a block belong to the last record of a block before it
    v = Window.partitionBy("src", "entry").orderBy("block", F.col("rec").asc_nulls_first())
    edge = p.where("rec is null or rec = last")
    edge = edge.withColumns({"of": F.coalesce(F.last("rec", True).over(v), F.first(F.col("x")[0]["line_no"]).over(v)), "gone": F.coalesce(F.last("out", True).over(v), F.lit(False))})
    joined = edge.where("not gone").groupBy("src", "entry", F.col("of").alias("rec")).agg(F.min("origin").alias("origin"), F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    rows = inner.select(*body).unionByName(joined.select(*body))
    if config.max_record_lines:
        rows = rows.withColumn("x", F.slice("x", 1, config.max_record_lines))
    first = F.col("x")[0]
    whole = lambda x: F.array_join(F.transform(x, lambda l: l["text"]), "\n")
    return rows.select("src", "entry", "origin", F.col("rec").alias("line_no"), F.trim(first["text"]).alias("first_line"), first["time_text"].alias("time_text"),
                       first["time_end"].alias("time_end"), whole(F.col("x")).alias("raw"),
                       F.when(F.size("x") > 1, whole(F.slice("x", F.lit(2), F.size("x")))).otherwise("").alias("tail"), F.size("x").alias("n_lines"))


def parse(records: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Fields of stitched records: ts (UTC scale, microseconds), tz_known, level, message, source, trace, status, fmt, besides src, entry, origin,
    line_no, raw, n_lines. The level is never null. Times without a zone are taken as they stand and marked tz_known = false."""
    base = ["src", "entry", "origin", "line_no", "raw", "tail", "n_lines"]
    t = F.col("first_line")
    df = records.withColumn("j", F.when(t.startswith("{"), F.from_json("first_line", "map<string,string>")))
    df = df.withColumn("access", F.when(F.col("j").isNull() & t.rlike(ACCESS), True).otherwise(False))
    df = df.withColumn("keys", F.when(F.col("j").isNull() & ~F.col("access"), F.regexp_extract_all(t, F.lit(PAIR), 1)))
    df = df.withColumn("vals", F.when(F.size("keys") >= 2, F.regexp_extract_all(t, F.lit(PAIR), 2)))
    covered = F.aggregate(F.zip_with("keys", "vals", lambda k, v: F.char_length(k) + F.char_length(v) + 1), F.lit(0), lambda a, x: a + x)
    strong = F.size(F.array_intersect(F.transform("keys", F.lower), F.array(*[F.lit(x) for x in "level msg message severity lvl time ts".split()]))) > 0
    df = df.withColumn("kv", F.when(F.col("vals").isNotNull() & (strong | (covered >= F.char_length("first_line") * 0.5)), F.map_from_arrays(
        "keys", F.transform("vals", lambda v: F.when((F.char_length(v) >= 2) & v.rlike(r"^([\"']).*\1$"), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v)))))
    df = df.withColumn("m", F.coalesce("j", "kv"))
    df = df.withColumn("ml", F.transform_keys("m", lambda k, v: F.lower(k))).withColumn("fmt", F.when(F.col("j").isNotNull(), "json").when(F.col("access"), "access").when(F.col("kv").isNotNull(), "logfmt").otherwise("plain"))
    df = df.withColumn("mt", _get(TIME_KEYS))
    df = df.withColumn("when", F.coalesce(
        F.when(F.col("mt").rlike(r"^\d(\.\d+)?[eE]\d+$"), F.col("mt").try_cast("decimal(30,6)").cast("string")).otherwise(F.col("mt")),
        F.when(F.col("access"), F.regexp_extract("first_line", ACCESS, 3)), F.when(F.col("fmt") != "json", F.col("time_text"))))
    # the rest of a plain line: after the time, without the level word and the bracketed source
    df = df.withColumn("rest", F.when(F.col("fmt") == "plain", F.when(F.col("time_text").isNotNull(), F.expr("substr(first_line, time_end + 1)")).otherwise(t)))
    df = df.withColumn("word", F.nullif(F.regexp_extract(F.substring("rest", 1, 120), LEVEL_WORD, 0), F.lit("")))
    cut_first = lambda c, x: F.expr(f"if({x} is null, {c}, concat(substr({c}, 1, instr({c}, {x}) - 1), substr({c}, instr({c}, {x}) + length({x}))))")
    df = df.withColumn("rest", cut_first("rest", "word"))
    df = df.withColumn("br", F.nullif(F.regexp_extract(F.substring("rest", 1, 120), BRACKET_SOURCE, 0), F.lit("")))
    df = df.withColumn("br", F.when(~F.col("br").rlike(r"^\[\d+\]$"), F.col("br"))).withColumn("rest", cut_first("rest", "br"))
    status = F.when(F.col("access"), F.regexp_extract("first_line", ACCESS, 6).try_cast("int")).when(F.col("fmt") == "json", _get(STATUS_KEYS).try_cast("int"))
    df = df.withColumn("status", F.when(status.between(100, 599), status)).withColumn("said", _get(MESSAGE_KEYS))
    skip_json = F.array(*[F.lit(k) for k in TIME_KEYS + LEVEL_KEYS + SOURCE_KEYS])
    skip_kv = F.array(*[F.lit(k) for k in TIME_KEYS + LEVEL_KEYS + MESSAGE_KEYS])
    left = lambda m, skip: F.array_join(F.transform(F.filter(F.map_entries(m), lambda e: ~F.array_contains(skip, e["key"]) & (F.coalesce(e["value"], F.lit("")) != "")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    trace = _get(["stack_trace", "stacktrace", "exception"])
    message = (F.when(F.col("fmt") == "json", F.when(F.col("said").isNull(), left("j", skip_json)).otherwise(F.concat("said", F.when(
        trace.isNotNull() & ~F.contains(F.col("said"), trace), F.concat(F.lit(" | "), F.substring(trace, 1, 2000))).otherwise(""))))
        .when(F.col("access"), F.concat(F.regexp_extract("first_line", ACCESS, 4), F.lit(" "), F.regexp_extract("first_line", ACCESS, 5), F.lit(" -> HTTP "),
                                        F.expr("status div 100"), F.lit("xx")))
        .when(F.col("fmt") == "logfmt", F.concat(F.coalesce(F.concat("said", F.lit(" ")), F.lit("")), left("kv", skip_kv)))
        .otherwise(F.btrim("rest", F.lit(" \t|:-[]"))))
    df = df.withColumn("message", message)
    longer = F.concat("message", F.lit(" | "), F.trim("tail"))
    df = df.withColumn("message", F.when(F.col("n_lines") > 1, F.substring(longer, 1, config.max_message_chars) if config.max_message_chars else longer).otherwise(F.col("message")))
    raw4 = F.substring("raw", 1, 400)
    level = F.coalesce(
        F.when(F.col("access"), levels.level_of_status(F.col("status"))).when(F.col("m").isNotNull(), norm_level(_get(LEVEL_KEYS))).otherwise(norm_level(F.col("word"))),
        F.when(F.col("fmt") == "json", norm_level(F.substring("said", 1, 200))), F.when(F.col("n_lines") > 1, norm_level(F.substring("tail", 1, 200))),
        F.when(raw4.rlike("(?U)" + tx.EXCEPTION) | F.contains(raw4, F.lit("Traceback (most recent call last)")), "ERROR").otherwise("INFO"))
    source = F.substring(F.when(F.col("access"), "access").when(F.col("m").isNotNull(), _get(SOURCE_KEYS)).otherwise(F.btrim("br", F.lit("[]"))), 1, 60)
    df = df.withColumn("level", level).withColumn("source", source).withColumn("trace", F.coalesce(
        F.substring(_get(TRACE_KEYS), 1, 64), F.nullif(F.regexp_extract(F.substring("raw", 1, 1000), TRACE_TEXT, 1), F.lit(""))))
    df = df.withColumn("until", F.lit(config.now_us + 86_399_999_999))
    df = df.select(*base, "fmt", "level", "message", "source", "trace", "status", "when", "until")
    df = instants.with_instant(df, "when", "cast(null as string)", "until", "us", odd_zone_is_local=True).withColumnRenamed("us_known", "tz_known")
    df = fence(df, "us", "tz_known", "level", "message", "source", "trace", "status", "fmt")
    return df.select(*[c for c in base if c != "tail"], F.expr("cast(timestamp_micros(us) as timestamp_ntz)").alias("ts"), "tz_known", "level",
                     levels.level_rank(F.col("level")).cast("int").alias("level_rank"), "message", "source", "trace", "status", "fmt")


def read_records(lines: DataFrame, config: EngineConfig = EngineConfig(), block_lines: int = BLOCK_LINES, level: str | None = None, since: str | None = None,
                 until: str | None = None, pattern: str | None = None) -> DataFrame:
    """Stitched, parsed and filtered: a level or above, a window of time, a pattern. What the first line of a record rules out is never parsed."""
    stitched = stitch(lines, config, block_lines, level, since, until)
    records = parse(grep(stitched, pattern) if pattern else stitched, config)
    if level:
        records = at_least(records, level)
    return within(records, since, until) if since or until else records


def at_least(records: DataFrame, level: str) -> DataFrame:
    """Records of `level` or above."""
    return records.where(F.col("level_rank") >= levels.LEVEL_ORDER.index(level) + 1)


def within(records: DataFrame, since: str | None = None, until: str | None = None, keep_undated: bool = False) -> DataFrame:
    """Records whose time lies in a window, both ends included; undated ones only if asked for."""
    cond = F.lit(True)
    if since:
        cond = cond & (F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        cond = cond & (F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return records.where(F.coalesce(cond, F.lit(keep_undated)))


def grep(records: DataFrame, pattern: str) -> DataFrame:
    """Records whose raw text matches, in any case."""
    return records.where(F.col("raw").rlike("(?iuU)" + pattern))
