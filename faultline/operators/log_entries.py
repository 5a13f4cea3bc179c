"""Physical log lines to log entries: start detection, grouping, fields, and entry instants.

Plan shape: header expressions run per line on the map side, so the shuffle carries only extracted fields, and
the text of lines only where the message is asked for. Lines are distributed by (file, block of line numbers), so one file of any size spreads
over many tasks; inside a block a running count of starts numbers the entries. Only the first and last piece of
each block, two rows per block, are put together in a second, small grouping by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions import instants, levels
from faultline.session import fence, join_dimension

#: Line numbers per block: the unit of distribution of one file.
BLOCK_LINES = 8192

_SEP, _MARK = "\u0001", "\u0002"
_LV = f"(?i:{levels.WORD_PATTERN})"
_ISO, _EPOCH = instants.PLAIN["a"], instants.PLAIN["epoch"]
_DOT, _CLF, _NOYEAR = instants.PLAIN["k"], instants.PLAIN["b"], instants.PLAIN["n"]
_NAME = r"[\w$][\w.$/-]*"

# The ordered cascade. Fields: t time, l level word, c component, p syslog priority, q HTTP status, m request; what follows is the message.
_LAYOUTS = [
    rf"<(?<p@>\d{{1,3}})>\d (?<t@>{_ISO}) \S+ (?<c@>\S+) ",
    rf"(?:<(?<p@>\d{{1,3}})>)?(?<t@>{_NOYEAR}) \S+ (?<c@>[^\s:\[\]]+)(?:\[\d+\])?: (?:\[?(?<l@>{_LV})\b\]?)?",
    rf"\S+ \S+ \S+ \[(?<t@>{_CLF})\] \"(?<m@>(?:[^\"\\]|\\.)*)\" (?<q@>[1-5]\d\d)\b",
    rf"(?<t@>{_ISO}) \[(?<l@>{_LV})\] \d+#\d+:",
    rf"(?<t@>{_ISO}) - (?<c@>{_NAME}) - (?<l@>{_LV}) - ",
    rf"(?<t@>{_DOT}|{_ISO}) \[[^\]]*\] +(?<l@>{_LV}) +(?<c@>{_NAME}) +- ",
    rf"(?<t@>{_ISO}|{_EPOCH}|{_DOT}) +(?<l@>{_LV}) +\[(?<c@>[^\]\s]+)\]",
    rf"(?<t@>{_ISO}|{_EPOCH}|{_DOT}) +\[(?<c@>[^\]\s]+)\] +(?<l@>{_LV})\b",
    rf"(?<t@>{_ISO}|{_EPOCH}|{_DOT}) +(?<c@>{_NAME}): ",
    rf"(?<t@>{_ISO}|{_EPOCH}|{_DOT}) +(?<l@>{_LV}) +(?<c@>{_NAME})(?= )",
    rf"(?<t@>{_ISO}|{_EPOCH}|{_DOT}) +(?<c@>{_NAME}) +(?<l@>{_LV})\b",
    rf"(?<t@>{_ISO}|{_EPOCH}|{_DOT})(?: +\[?(?<l@>{_LV})\b\]?)?(?= |$)",
]
_HEADER = r"\A(?:" + "|".join(p.replace("@", str(i)) for i, p in enumerate(_LAYOUTS)) + r")(?<rest>(?s:.*))\z"
_ALL = lambda f: "".join(f"${{{f}{i}}}" for i, p in enumerate(_LAYOUTS) if f"(?<{f}@>" in p)
_FIELDS = _MARK + _SEP.join([*(_ALL(f) for f in "tlcpqm"), "${rest}"])

# Keys that carry each field in JSON and key=value records, most specific first.
TIME_KEYS = ["@timestamp", "timestamp", "time", "ts"]
LEVEL_KEYS = ["level", "severity", "lvl", "loglevel", "levelname"]
COMPONENT_KEYS = ["service", "component", "app", "logger", "program"]
MESSAGE_KEYS = ["message", "msg", "event", "text", "log"]


def _json_schema() -> str:
    return ", ".join(f"`{k}` string" for k in TIME_KEYS + LEVEL_KEYS + COMPONENT_KEYS + MESSAGE_KEYS)


def _json_level(word: Column) -> Column:
    return F.coalesce(levels.level_of_word(word), levels.level_of_python_number(word.try_cast("int")))


def _pair(raw: Column, keys: list[str]) -> Column:
    """Value of the first of `keys` in a key=value record."""
    return F.nullif(F.regexp_extract(raw, r"(?:^|\s)(?:" + "|".join(keys) + r")=\"?([^\s\"]+(?: [\d:.,]+Z?)?)", 1), F.lit("")) \
        if keys is TIME_KEYS else F.nullif(F.regexp_extract(raw, r"(?:^|\s)(?:" + "|".join(keys) + r")=\"?([^\s\"]+)", 1), F.lit(""))


def _quoted_pair(raw: Column, keys: list[str]) -> Column:
    """The same where the value may be a quoted text with spaces."""
    p = r"(?:^|\s)(?:" + "|".join(keys) + r")=(?:\"((?:[^\"\\]|\\.)*)\"|([^\s\"]+))"
    return F.nullif(F.concat(F.regexp_extract(raw, p, 1), F.regexp_extract(raw, p, 2)), F.lit(""))


def with_line_fields(lines: DataFrame) -> DataFrame:
    """Add `start` (does the line begin an entry), `open` (it is the opening brace of a record written over
    several lines), `time_text`, `level`, `component`, `said` (the message on a first line, without the header), and for lines inside such a record
    `in_time`, `in_level`, `in_component`, `in_said`. Null lines, blank lines and lines without a time of their own never start an entry."""
    raw = F.rtrim(F.col("raw"))
    df = lines.withColumn("__k", F.expr(
        r"""case when raw is null then 0 when startswith(raw, '{') then if(rtrim(raw) = '{', 2, 1)
                 when raw rlike '^[A-Za-z_@][\\w.@-]*=\\S' then 3
                 when raw rlike '^\\s+"' then 4
                 when raw rlike '^[<0-9A-Za-z:\\[]' then 5 else 0 end"""))
    k = F.col("__k")
    df = df.withColumn("__j", F.when(k == 1, F.from_json(F.col("raw"), _json_schema())))
    # the message of a key=value record may itself contain pairs
    df = df.withColumn("__p", F.when(k == 3, F.regexp_replace(
        F.col("raw"), r"(?:^|\s)(?:msg|message|err|error|text)=\"(?:[^\"\\]|\\.)*\"", " ")))
    df = df.withColumn("__h", F.when(k == 5, F.split(F.regexp_replace(raw, _HEADER, _FIELDS), _SEP)))
    df = df.withColumn("__i", F.when(k == 4, F.split(F.regexp_replace(
        raw, r"\A\s*\"([@\w.]+)\"\s*:\s*\"?((?:[^\"\\]|\\.)*?)\"?,?\z", _MARK + "$1" + _SEP + "$2"), _SEP)))
    pick = lambda keys: F.coalesce(*[F.nullif(F.col("__j").getField(x), F.lit("")) for x in keys])
    hit = (k == 5) & F.col("__h")[0].startswith(_MARK)
    h = lambda i: F.nullif(F.col("__h")[i], F.lit(""))
    inside = lambda keys: F.when((k == 4) & F.ltrim(F.col("__i")[0], F.lit(_MARK)).isin(keys), F.col("__i")[1])
    time = (F.when(k == 1, pick(TIME_KEYS)).when(k == 3, _pair(F.col("__p"), TIME_KEYS))
            .when(hit, F.substring(F.col("__h")[0], 2, 64)))
    numeric = r"^\d(\.\d+)?[eE]\d+$"
    df = df.withColumn("time_text", time)
    df = df.withColumn("time_text", F.when(F.col("time_text").rlike(numeric),
                                           F.col("time_text").try_cast("decimal(30,6)").cast("string")).otherwise(F.col("time_text")))
    return df.select(
        *lines.columns,
        ((k == 2) | F.coalesce(F.col("time_text") != "", F.lit(False))).alias("start"),
        (k == 2).alias("open"), "time_text",
        F.when(k == 1, _json_level(pick(LEVEL_KEYS))).when(k == 3, levels.level_of_word(_pair(F.col("__p"), LEVEL_KEYS)))
        .when(hit, F.coalesce(levels.level_of_word(h(1)), levels.level_of_priority(h(3).try_cast("int")),
                              levels.level_of_status(h(4).try_cast("int")))).alias("level"),
        F.when(k == 1, pick(COMPONENT_KEYS)).when(k == 3, _pair(F.col("__p"), COMPONENT_KEYS))
        .when(hit, F.when(h(4).isNotNull(), "access").otherwise(F.nullif(h(2), F.lit("-")))).alias("component"),
        F.when(k == 1, pick(MESSAGE_KEYS)).when(k == 3, _quoted_pair(F.col("raw"), MESSAGE_KEYS))
        .when(hit, F.coalesce(h(5), F.ltrim(F.col("__h")[6], F.lit(" -:")))).alias("said"),
        inside(TIME_KEYS).alias("in_time"), inside(LEVEL_KEYS).alias("in_level"), inside(COMPONENT_KEYS).alias("in_component"), inside(MESSAGE_KEYS).alias("in_said"))


def _pieces(lines: DataFrame, block_lines: int) -> DataFrame:
    """Parts of entries that lie within one block: one row per (file_id, block, seq)."""
    narrow = with_line_fields(lines.select("file_id", "line_no", "line_id", "raw")).select(
        "file_id", F.expr(f"line_no div {block_lines}").alias("block"), "line_no", "line_id",
        F.xxhash64("raw").alias("h"), "start", "open", "time_text", "level", "component", "in_time", "in_level", "in_component", "in_said",
        F.coalesce(F.when(F.col("start"), F.col("said")), "raw", F.lit("")).alias("text"))
    w = Window.partitionBy("file_id", "block").orderBy("line_no", "h", "line_id")
    once = narrow.withColumn("__again", (F.lag("line_no").over(w) == F.col("line_no")) & (F.lag("h").over(w) == F.col("h"))) \
        .where(~F.coalesce("__again", F.lit(False)))
    seq = once.withColumn("seq", F.sum(F.col("start").cast("long")).over(w))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c))).getField(c).alias(c)
    got = seq.groupBy("file_id", "block", "seq").agg(
        F.min(F.struct("line_no", "line_id")).alias("first"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("start"), F.struct("open", "time_text", "level", "component"))).alias("head"),
        first("in_time"), first("in_level"), first("in_component"), first("in_said"),
        F.array_sort(F.collect_list(F.struct("line_no", "h", "text"))).alias("texts"))
    got = got.withColumn("texts", F.array_join(F.transform("texts", lambda x: x["text"]), "\n"))
    return got.withColumn("last", F.max("seq").over(Window.partitionBy("file_id", "block")))


def log_entries(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per log entry: file_id, line_no, line_id (smallest of the first line), n_lines, time_text,
    log_level, component ('' where the entry states none), message (the first line without its header, the message key of structured
    records, the request of web access lines; then the lines that follow, as they are). Without the message no text leaves the scan.

    Lines shipped twice count once. Lines before a file's first start belong to no entry, null and blank lines
    count as lines of the entry they follow, an empty table gives no rows; other columns are ignored."""
    p = _pieces(lines, block_lines)
    body = ["file_id", "first", "n", "head", "in_time", "in_level", "in_component", "in_said", "texts"]
    inner = p.where("seq > 0 and seq < last").select(*body)
    edge = p.where("seq = 0 or seq = last")
    w = Window.partitionBy("file_id").orderBy("block", "seq")
    part = edge.withColumn("g", F.sum(F.when(F.col("seq") > 0, 1).otherwise(0)).over(w)).where("g > 0")
    by = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("block", "seq", c))).getField(c).alias(c)
    joined = part.groupBy("file_id", "g").agg(
        F.min("first").alias("first"), F.sum("n").alias("n"), by("head"), by("in_time"), by("in_level"), by("in_component"), by("in_said"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "texts"))), lambda x: x["texts"]), "\n").alias("texts")
    ).select(*body)
    e = inner.unionByName(joined)
    opened = F.col("head.open")
    return e.select(
        "file_id", F.col("first.line_no").alias("line_no"), F.col("first.line_id").alias("line_id"),
        F.col("n").cast("int").alias("n_lines"),
        F.when(opened, F.col("in_time")).otherwise(F.col("head.time_text")).alias("time_text"),
        F.coalesce(F.when(opened, _json_level(F.col("in_level"))).otherwise(F.col("head.level")), F.lit("")).alias("log_level"),
        F.coalesce(F.when(opened, F.col("in_component")).otherwise(F.col("head.component")), F.lit("")).alias("component"),
        F.coalesce(F.when(opened, F.col("in_said")), "texts").alias("message"))


def entry_instants(entries: DataFrame, files: DataFrame, block_lines: int = BLOCK_LINES, gap_us: int = 60_000_000, carry: tuple[str, ...] = (), undated: bool = False) -> DataFrame:
    """file_id, line_no, line_id, utc_us and the columns `carry` of every entry with a readable time, with a null utc_us also of the others if `undated`.

    A local time that occurs twice is the later instant if the entry before it lies more than `gap_us` after the
    earlier one. Whether that holds may depend on how the entry before was read, but only in one of three ways:
    certainly, certainly not, or 'as the one before'. So the answer is the last certain one, which a running
    last-value gives without walking the file; blocks are linked by their last rows only."""
    dim = files.groupBy("file_id").agg(instants.known_zone(F.max("tz_name")).alias("tz_name"),
                                       F.max(F.expr("unix_micros(cast(collected_at as timestamp))")).alias("until"))
    keep = ["file_id", "line_no", "line_id", *carry]
    df = join_dimension(entries.select(*keep, "time_text"), dim, "file_id")
    df = df.withColumn("until", F.coalesce("until", F.lit(253402300799000000)))
    df = fence(instants.with_instant(df, "time_text", "tz_name", "until", "e").withColumnRenamed("e_shift", "shift"), "e", "shift")
    none = df.where("e is null").select(*keep, F.col("e").alias("utc_us")) if undated else None
    df = df.where("e is not null")
    df = df.select(*keep, F.expr(f"line_no div {block_lines}").alias("block"), "e", "shift")
    w = Window.partitionBy("file_id", "block").orderBy("line_no", "line_id")

    def certain(over) -> Column:
        pe, ps = F.lag("e").over(over), F.lag("shift").over(over)
        return (F.when((F.col("shift") == 0) | (pe + ps - F.col("e") <= gap_us), 0)
                .when(pe - F.col("e") > gap_us, 1))

    d = df.withColumn("at", F.row_number().over(w)).withColumn("c", certain(w))
    d = d.withColumn("x", F.last("c", True).over(w)).withColumn("end", F.lead("line_no").over(w).isNull())
    done = d.where("x is not null").select(*keep, (F.col("e") + F.col("x") * F.col("shift")).alias("utc_us"))
    # What a block could not settle by itself, in the order of the file, with the last row of every block before it.
    v = Window.partitionBy("file_id").orderBy("block", "line_no", "line_id")
    rest = d.where("x is null or end")
    rest = rest.withColumn("c2", F.coalesce(F.col("x"), F.when(F.col("at") == 1, F.coalesce(certain(v),
                           F.when(F.lag("e").over(v).isNull(), 0)))))
    rest = rest.withColumn("x2", F.last("c2", True).over(v)).where("x is null")
    out = done.unionByName(rest.select(*keep, (F.col("e") + F.coalesce("x2", F.lit(0)) * F.col("shift")).alias("utc_us")))
    return out.unionByName(none) if undated else out
