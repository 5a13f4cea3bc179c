"""python -m faultline COMMAND: the operators at a terminal, Markdown or JSON lines on standard output. Exit codes: 0 found, 1 nothing found, 2 wrong arguments."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.config import EngineConfig, parse_now, parse_time
from faultline.operators import alert_cards, analyze, code, correlate, kb_search, records as rec
from faultline.plans import render, triage as plans
from faultline.session import cut, prepare
from faultline.sources import knowledge_base, loglines, repository

#: Names a file to which each run adds a line: time, command, names of the options given (never their values), exit code.
RUNS_VARIABLE, NOW_VARIABLE = "FAULTLINE_RUNS", "FAULTLINE_NOW"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="faultline")
    c = p.add_subparsers(dest="command", required=True)
    add = {n: c.add_parser(n) for n in ("parse", "trace", "timeline", "search", "code", "alert", "triage")}
    for n in ("parse", "trace", "timeline", "code", "triage"):
        add[n].add_argument("paths", nargs="+", help="files, folders, patterns, - or label=path")
        add[n].add_argument("--level"), add[n].add_argument("--since"), add[n].add_argument("--until"), add[n].add_argument("--grep"), add[n].add_argument("--encoding", default="utf-8")
    for n in ("code", "triage"):
        add[n].add_argument("--repo", default=None if n == "triage" else ".")
    for n in ("search", "triage"):
        add[n].add_argument("--kb"), add[n].add_argument("--stand"), add[n].add_argument("--service")
    add["parse"].add_argument("--save"), add["parse"].add_argument("--trace"), add["parse"].add_argument("--context", type=int), add["parse"].add_argument("--max-lines", type=int, default=0)
    add["trace"].add_argument("--id"), add["timeline"].add_argument("--event", action="append", default=[])
    for n in ("trace", "timeline"):
        add[n].add_argument("--offset", action="append", default=[], help="label=seconds")
    add["search"].add_argument("words", nargs="*"), add["search"].add_argument("--signature", action="append", default=[]), add["search"].add_argument("--list", action="store_true"), add["search"].add_argument("--sources", action="store_true")
    add["alert"].add_argument("file")
    for x in add.values():
        x.add_argument("--format", choices=["md", "json"], default="md"), x.add_argument("--max-chars", type=int, default=12_000)
    return p


def show(a, text, *tables: DataFrame) -> int:
    """Print Markdown, or the rows of the tables as JSON lines; 1 if there are none."""
    if a.format == "json":
        n = 0
        for df in tables:
            for row in df.toJSON().toLocalIterator():
                print(row)
                n += 1
        return 0 if n else 1
    print(text())
    return 0 if any(df.limit(1).collect() for df in tables) else 1


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    now = parse_now(os.environ[NOW_VARIABLE]) if NOW_VARIABLE in os.environ else datetime.now()
    config = EngineConfig(now=now)
    when = lambda x: str(parse_time(x, now)) if x else None
    if hasattr(a, "paths"):
        since, until = when(a.since), when(a.until)
        several = a.command in ("trace", "timeline")
        lines = loglines.labelled(spark, a.paths, a.encoding) if several else loglines.read_logs(spark, a.paths, a.encoding, getattr(a, "max_lines", 0))
        for w in loglines.log_warnings(spark, [p.partition("=")[2] or p for p in a.paths], a.encoding).collect():
            print(w["text"], file=sys.stderr)
        offsets = {k: float(v) for k, _, v in (o.partition("=") for o in getattr(a, "offset", []))}
        early = not (several or getattr(a, "trace", None) or getattr(a, "context", None))
        r = rec.read_records(lines, config, level=a.level, since=since if not offsets else None, until=until if not offsets else None, pattern=a.grep) if early or not several else None
        if several:
            labels = [p.partition("=")[0] if "=" in p else os.path.splitext(os.path.basename(p))[0] for p in a.paths]
            label = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("src") % len(labels) + 1).cast("int"))
            r = correlate.with_offsets(correlate.trace_key(rec.read_records(lines, config, level=a.level, pattern=a.grep)).withColumn("service", label), offsets)
            r = rec.within(r, since, until, keep_undated=a.command == "trace") if since or until else r
        r = cut(r)
    if a.command == "parse":
        if a.save:
            analyze.write_artifact(r, a.save)
        if a.trace:
            hits = analyze.containing(r, a.trace)
            return show(a, lambda: "\n".join(x["raw"] for x in hits.toLocalIterator()), hits)
        if a.context:
            g = analyze.groups(r).where(F.col("n") == a.context).first()
            rows = analyze.samples(r, g["template"], g["level"]) if g else r.where("false")
            return show(a, lambda: "\n\n".join(x["raw"] for x in rows.collect()), rows)
        return show(a, lambda: render.summary(r, a.max_chars), *(analyze.artifact(r).values() if a.format == "json" else [r]))
    if a.command == "trace":
        skew = correlate.clock_skew(r)
        if a.id:
            h = correlate.chain(r, a.id)
            return show(a, lambda: render.chain(h, correlate.break_points(r.where(F.contains("raw", F.lit(a.id))).withColumn("key", F.lit(a.id))), skew, a.max_chars), h)
        c = correlate.trace_candidates(r, 10)
        return show(a, lambda: render.candidates(c, a.max_chars), c)
    if a.command == "timeline":
        told = [(parse_time(t, now), text) for t, text in map(correlate.parse_milestone, a.event)]
        stones = spark.createDataFrame(told, "ts timestamp_ntz, text string") if told else None
        feeds = []
        for label in sorted({x["service"] for x in r.select("service").distinct().collect()}):
            mine = r.where(F.col("service") == label)
            feeds.append(correlate.timeline(analyze.groups(mine), correlate.spikes(analyze.histogram(mine, 1, "WARN").withColumn("series", F.lit(label))), label, stones if not feeds else None))
        feed = feeds[0] if feeds else None
        for f in feeds[1:]:
            feed = feed.unionByName(f)
        if feed is None:
            return 1
        feed = correlate.ordered(feed.drop("gap_s", "pos"), since, until)
        return show(a, lambda: render.timeline(feed, correlate.clock_skew_by_template(r), a.max_chars), feed)
    if a.command == "search":
        folder, _ = knowledge_base.knowledge_base_folder(a.kb)
        entries = knowledge_base.read_entries(spark, folder)
        if a.sources:
            s = kb_search.sources_for(entries, a.stand, a.service, str(now.date()))
            return show(a, lambda: render.source_map(s, a.max_chars), s)
        only = {"stand": [a.stand] if a.stand else None, "service": [a.service] if a.service else None}
        if a.list:
            df = kb_search.by_date(entries, **only)
            return show(a, lambda: render.kb_list(df, a.max_chars), df)
        df = kb_search.search(entries, " ".join(a.words), a.signature or None, **only)
        return show(a, lambda: render.kb_hits(df, a.max_chars), df)
    if a.command == "code":
        files, body = repository.read_code(spark, a.repo)
        g = analyze.groups(r)
        frames = code.resolve(code.frames(r), files)
        phrases, classes = code.phrase_hits(plans.phrases_of(g), body), code.exception_hits([x[0] for x in analyze.exception_counts(r).limit(6).collect()], body)
        span = analyze.period(rec.at_least(r, "WARN")).first()
        commits = code.commits_in_window(repository.commits(spark, a.repo), str(span["first_ts"]) if span["first_ts"] else None, str(span["last_ts"]) if span["last_ts"] else None)
        return show(a, lambda: render.code_hints(frames, phrases, classes, commits, a.max_chars), frames)
    if a.command == "alert":
        text = sys.stdin.read() if a.file == "-" else open(a.file, encoding="utf-8").read()
        card = alert_cards.cards(spark.createDataFrame([(1, text)], "delivery_id bigint, payload string"), config)
        row = card.first()
        print(card.toJSON().first() if a.format == "json" else "\n".join(f"{k}: {v}" for k, v in row.asDict().items() if v not in (None, []) and k != "delivery_id"))
        return 3 if row["shape"] is None else 0 if row["sufficient"] else 4
    entries = knowledge_base.read_entries(spark, knowledge_base.knowledge_base_folder(a.kb)[0]) if a.kb else None
    extra = {}
    if a.repo:
        extra["files"], extra["code_lines"] = repository.read_code(spark, a.repo)
        extra |= {"commits": repository.commits(spark, a.repo), "touched": repository.touched_files(spark, a.repo)}
    t = plans.triage(lines, entries, level=a.level, stand=a.stand, service=a.service, config=config, **extra)
    return show(a, lambda: render.triage(t, a.max_chars), plans.report(t))


def note_run(command: str, argv: list[str], code: int) -> None:
    """Add a line about a run to the file that RUNS_VARIABLE names, if any."""
    if os.environ.get(RUNS_VARIABLE):
        names = list(dict.fromkeys(x.split("=", 1)[0] for x in argv if x.startswith("--")))
        with open(os.environ[RUNS_VARIABLE], "a", encoding="utf-8") as f:
            f.write(f"{datetime.now():%Y-%m-%d %H:%M:%S}\t{command}\t{' '.join(names) or '-'}\trc={code}\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("faultline").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    code_ = 2
    try:
        code_ = run(prepare(spark), a)
    except ValueError as e:
        print(e, file=sys.stderr)
    note_run(a.command, argv, code_)
    return code_


if __name__ == "__main__":
    sys.exit(main())
