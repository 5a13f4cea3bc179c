"""Stack frames and phrases against repository files, commits against the incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultline.functions import text as tx


def frames(records: DataFrame, text: str = "raw") -> DataFrame:
    """base, path, line, symbol, records: distinct frames of all records, most frequent first in later rankings. Combined before the shuffle. A record counts once
    for a frame, however many of the expressions match it; the first of them gives path and symbol."""
    f = records.select(tx.frames(F.col(text)).alias("fs")).where(F.size("fs") > 0).withColumn("keys", F.transform("fs", lambda x: F.struct(x["base"].alias("base"), x["line"].alias("line"))))
    once = F.filter("fs", lambda x, i: F.array_position("keys", F.struct(x["base"].alias("base"), x["line"].alias("line"))) == i + 1)
    f = f.select(F.explode(once).alias("f")).select("f.*").where("line is not null")
    return f.groupBy("base", "line").agg(F.min("path").alias("path"), F.max("symbol").alias("symbol"), F.count(F.lit(1)).alias("records"))


def resolve(frame_rows: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """Frames with up to `most` files of the same name, those sharing the longest end of the path first; Java and Kotlin frames fall back to a file of the same stem.
    `files` has path; both sides are keyed by file name, so this is one hash join."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    f = files.select(F.col("path").alias("file"), name.alias("base"), F.split(name, r"\.")[0].alias("stem"))
    fr = frame_rows.withColumn("stem", F.when(F.col("base").rlike(r"\.(java|kt)$"), F.split("base", r"\.")[0]))
    exact = fr.join(f.select("file", "base"), "base", "left")
    none = exact.where("file is null and stem is not null").drop("file").join(f.groupBy("stem").agg(F.min("file").alias("file")), "stem", "left")
    every = exact.where("file is not null or stem is null").unionByName(none)
    common = F.size(F.filter(F.zip_with(F.reverse(F.split("path", r"[/\\]")), F.reverse(F.split(F.coalesce("file", F.lit("")), r"[/\\]")), lambda a, b: a == b), lambda x: x))
    w = Window.partitionBy("base", "line").orderBy(F.col("common").desc(), "file")
    return every.withColumn("common", common).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("stem", "common")


def context(resolved: DataFrame, code_lines: DataFrame, around: int = 3) -> DataFrame:
    """The lines within `around` of each resolved frame: file, line, at, code. An equality join on exploded line numbers, no range join."""
    want = resolved.where("file is not null").select("file", "line", F.explode(F.expr(f"sequence(greatest(1, line - {around}), line + {around})")).alias("at"))
    return want.join(code_lines.select(F.col("path").alias("file"), F.col("line_no").cast("int").alias("at"), F.col("text").alias("code")), ["file", "at"])


def phrase_hits(phrases: list[str], code_lines: DataFrame, most: int = 12) -> DataFrame:
    """path, line_no, phrase: the first phrase each code line holds, in any case, in the order of path and line. Phrases travel in the plan."""
    if not phrases:
        return code_lines.where("false").select("path", "line_no", F.lit("").alias("phrase"))
    low = F.lower("text")
    hit = F.coalesce(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases])
    return code_lines.select("path", "line_no", hit.alias("phrase")).where("phrase is not null").orderBy("path", "line_no").limit(most)


def commits_in_window(commits: DataFrame, first: str | None, last: str | None, hours_before: int = 24, most: int = 15) -> DataFrame:
    """Commits (hash, at, subject, ...) from `hours_before` the first error to the last, newest first."""
    df = commits
    if first:
        df = df.where(F.col("at") >= F.lit(first).cast("timestamp_ntz") - F.expr(f"make_dt_interval(0, {hours_before})"))
    if last or first:
        df = df.where(F.col("at") <= F.lit(last or first).cast("timestamp_ntz"))
    return df.orderBy(F.col("at").desc(), "hash").limit(most)


def linked_commits(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """Commits that touched a resolved file, by the first seven letters of their hash."""
    return commits.withColumn("h7", F.substring("hash", 1, 7)).join(touched.select(F.substring("hash", 1, 7).alias("h7")).distinct(), "h7", "left_semi").drop("h7")


def exception_hits(exceptions: list[str], code_lines: DataFrame, most_classes: int = 6, most: int = 3) -> DataFrame:
    """exception, path, line_no: where the short names of the first distinct exception classes stand in the code, the first `most` lines each. Names travel in the plan."""
    names = list(dict.fromkeys(exceptions))[:most_classes]
    if not names:
        return code_lines.where("false").select(F.lit("").alias("exception"), "path", "line_no")
    low = F.lower("text")
    each = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x.rsplit(".", 1)[-1].lower())), F.lit(x)) for x in names]))
    w = Window.partitionBy("exception").orderBy("path", "line_no")
    d = code_lines.select(F.explode(each).alias("exception"), "path", "line_no")
    return d.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def changed_since(entries: DataFrame, touched: DataFrame) -> DataFrame:
    """Knowledge-base entries of which a file (`files`) was changed by a commit after the day of the entry; `touched` has path and at. Undated entries are none."""
    f = entries.where("date is not null").select("id", "date", F.explode("files").alias("path"))
    hit = f.join(touched.groupBy("path").agg(F.max("at").alias("at")), "path").where("cast(at as date) > date").select("id").distinct()
    return entries.join(hit, "id", "left_semi")
