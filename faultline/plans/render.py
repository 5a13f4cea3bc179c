"""Summaries for people: Markdown of small, aggregated tables, fitted to a budget of characters. Every function collects at most a report's rows."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from faultline.operators import analyze, correlate
from faultline.session import cut

#: Groups shown in a summary, and rows of its lists.
TOP_GROUPS, TOP_ROWS = 10, 10


def span(seconds: float | None) -> str:
    """A span of time in its two largest units; '' for none."""
    if seconds is None:
        return ""
    s, sign = int(abs(seconds)), "-" if seconds < 0 else ""
    if s < 1:
        return f"{sign}{abs(seconds) * 1000:.0f} ms"
    parts = [(s // 86400, "d"), (s // 3600 % 24, "h"), (s // 60 % 60, "min"), (s % 60, "s")]
    first = next(i for i, (n, _) in enumerate(parts) if n)
    return sign + " ".join(f"{n} {u}" for n, u in parts[first:first + 2] if n)


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def fit(sections: list[tuple[str, list[str]]], budget: int) -> tuple[str, int]:
    """(Markdown, rows left out): sections (heading, rows) in order; the first row of all is always shown, a section that has no room is left out and later, shorter ones still
    get their turn."""
    out, used, hidden = [], 0, 0
    for heading, rows in sections:
        if not rows:
            continue
        head = f"## {heading}\n\n" if heading else ""
        kept: list[str] = []
        room = budget - used - len(head)
        for r in rows:
            if kept or out or not hidden:
                if room - len(r) - 1 < 0 and (kept or out):
                    break
            kept.append(r)
            room -= len(r) + 1
        hidden += len(rows) - len(kept)
        if kept:
            text = head + "\n".join(kept) + "\n"
            out.append(text)
            used += len(text) + 1
    if hidden:
        out.append(f"… {plural(hidden, 'row')} more, not shown\n")
    return "\n".join(out), hidden


def spill(rows: dict[str, list[dict]], name: str, folder: str | None = None) -> str:
    """Everything behind a summary that was cut, as JSON in a file of the driver; its path."""
    folder = folder or os.path.join(tempfile.gettempdir(), "faultline")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2, default=str)
    return path


def _rows(df: DataFrame, show: Callable) -> list[str]:
    return [show(r) for r in df.collect()]


def _at(t: datetime | None) -> str:
    return f"{t:%Y-%m-%d %H:%M:%S}" if t else "undated"


def bars(histogram: DataFrame, width: int = 30) -> list[str]:
    """Rows of a drawn histogram, the peak marked."""
    rows = histogram.orderBy("bucket").collect()
    return [f"- {r['bucket']:%m-%d %H:%M} {'█' * max(1, round(r['share'] * width))} {r['count']}{' ← peak' if r['share'] == 1 else ''}" for r in rows]


def summary(records: DataFrame, budget: int = 12_000, top: int = TOP_GROUPS) -> str:
    """What a parse found: period and zones, groups (two early ones kept whatever their frequency), exceptions, statuses, histogram, requests, signature."""
    p = analyze.period(records).first()
    head = [f"{plural(p['records'], 'record')}, {_at(p['first_ts'])} – {_at(p['last_ts'])} UTC", *(["Some times name a zone and some do not: their order may be wrong."] if p["mixed"] else [])]
    head.append("Levels: " + ", ".join(_rows(analyze.counts(records, "level"), lambda r: f"{r['level']} {r['count']}")))
    head.append("Formats: " + ", ".join(_rows(analyze.counts(records, "fmt"), lambda r: f"{r['fmt']} {r['count']}")))
    head.append("Files: " + ", ".join(_rows(analyze.counts(records, "origin").limit(8), lambda r: f"{r['origin']} {r['count']}")))
    head.append("Services: " + ", ".join(_rows(analyze.counts(records, "source").limit(6), lambda r: f"{r['source']} {r['count']}")))
    g = cut(analyze.groups(records))
    shown = lambda r: f"{r['n']}. **{r['level']}** ×{r['count']} {_at(r['first_ts'])} – {_at(r['last_ts'])} `{r['template']}`"
    early = g.where("first_ts is not null").orderBy("first_ts", "n").limit(2)
    few = g.orderBy("n").limit(top).unionByName(early).dropDuplicates(["n"]).withColumn("chars", F.char_length("template") + 70)
    groups = _rows(correlate.within_budget_early(few, "chars", budget * 2 // 3), shown)
    sections = [("", head), ("Groups", groups), ("Exceptions", _rows(analyze.exception_counts(records).limit(TOP_ROWS), lambda r: f"- {r['exception']} ×{r['count']}")),
                ("HTTP statuses", _rows(analyze.counts(records, "status").orderBy("status"), lambda r: f"- {r['status']} ×{r['count']}")), ("Warnings and errors by time", bars(analyze.drawn_histogram(analyze.histogram(records, 1, "WARN")))),
                ("Requests with errors", _rows(analyze.trace_errors(records, 5), lambda r: f"- {r['trace']} ×{r['count']}")), ("Signature", _rows(analyze.signatures(records).orderBy("ord"), lambda r: f"- {r['kind']}: {r['value']} ×{r['count']}"))]
    return fit(sections, budget)[0]


def timeline(feed: DataFrame, skew: DataFrame | None = None, budget: int = 12_000) -> str:
    """The feed in order of time with the pauses between events, clock differences, and where to look for the cause."""
    rows = [x for r in feed.orderBy("pos").collect() for x in ([f"- … {span(r['gap_s'])}"] if r["gap_s"] else []) + [f"- {_at(r['ts'])} {r['kind']} [{r['source']}] {r['level']} {r['text']}"]]
    first = correlate.first_event(feed).first()
    cause = [f"{_at(first['ts'])} {first['text'][:100]} ({first['source']}). Look for the cause here and before; what comes later is likely a consequence."] if first else []
    return fit([("Earliest new event", cause), ("Clocks", clocks(skew)), ("Timeline", rows)], budget)[0]


def clocks(skew: DataFrame | None) -> list[str]:
    return [] if skew is None else _rows(skew.orderBy("a", "b"), lambda r: f"- {r['b']} differs from {r['a']} by {r['median_s']:+.1f} s over {plural(r['n'], 'message')}, {'steadily' if r['systematic'] else 'not steadily'}")


def chain(hops: DataFrame, breaks: DataFrame | None = None, skew: DataFrame | None = None, budget: int = 12_000) -> str:
    """The hops of one request, the wait before each, the first failure."""
    rows = _rows(hops.orderBy("hop"), lambda r: f"{r['hop']}. {r['service']} {_at(r['first_ts'])} +{span(r['gap_s']) or '0'}, {plural(r['records'], 'record')}, {plural(r['errors'], 'error')}, worst {r['worst']}"
                 + (" ← longest wait" if r["slowest"] else "") + (" ← before the hop it follows: clocks differ" if (r["gap_s"] or 0) < 0 else ""))
    first = _rows(breaks, lambda r: f"{r['service']} at {_at(r['ts'])}, line {r['line_no']}") if breaks is not None else []
    return fit([("First failure", first), ("Clocks", clocks(skew)), ("Hops", rows)], budget)[0]


def candidates(c: DataFrame, budget: int = 12_000) -> str:
    """Requests worth following, most errors first."""
    return fit([("Requests", _rows(c, lambda r: f"- {r['key']}: {plural(r['errors'], 'error')}, {plural(r['services'], 'service')}, {plural(r['records'], 'record')}, from {_at(r['first_ts'])}"))], budget)[0]


def kb_hits(hits: DataFrame, budget: int = 12_000) -> str:
    """Entries found, with score and outcome; refuted ones are marked."""
    return fit([("Similar incidents", _rows(hits, lambda r: f"- {r['id']} ({r['score']}) {r['title']}" + {"refuted": " — refuted", "confirmed": " — confirmed"}.get(r["outcome"], "")))], budget)[0]


def kb_list(entries: DataFrame, budget: int = 12_000) -> str:
    return fit([("Entries", _rows(entries.limit(1000), lambda r: f"- {r['id']} {r['date'] or 'undated'} {r['title']}"))], budget)[0]


def source_map(entries: DataFrame, budget: int = 12_000) -> str:
    """Where logs are, stale entries marked (entries with age_days and stale)."""
    return fit([("Sources", _rows(entries.limit(1000), lambda r: f"- {r['id']} {', '.join(r['stands'] or [])} / {', '.join(r['services'] or [])}" + (" — not confirmed lately" if "stale" in r.asDict() and r["stale"] else "")))], budget)[0]


def code_hints(frames: DataFrame, phrases: DataFrame | None = None, exceptions: DataFrame | None = None, commits: DataFrame | None = None, budget: int = 12_000) -> str:
    """Frames with their files (two thirds of the room), phrases and exception classes in the code, commits in the window."""
    f = _rows(frames.orderBy(F.col("file").isNull(), F.col("records").desc(), "base", "line", "rank").limit(25), lambda r: f"- {r['path']}:{r['line']} {r['symbol'] or ''} → {r['file'] or 'not in the repository'}")
    while len(f) > 1 and sum(map(len, f)) > budget * 2 // 3:
        f.pop()
    hit = lambda df, c: [] if df is None else _rows(df, lambda r: f"- {r['path']}:{r['line_no']} {r[c]}")
    new = [] if commits is None else _rows(commits, lambda r: f"- {r['hash'][:7]} {_at(r['at'])} {r['subject']}")
    return fit([("Frames", f), ("Phrases", hit(phrases, "phrase")), ("Exception classes", hit(exceptions, "exception")), ("Commits", new)], budget)[0]


def confidence(row: DataFrame, skipped: dict[str, str] | None = None) -> str:
    """The verdict and what each contour adds to it."""
    from faultline.operators.confidence import WEIGHTS

    r = row.first()
    each = [f"- {c} (weight {w:.2f}): " + (f"{r[c]:.2f}, adds {r[c] * w:.2f}" if r[c] is not None else f"not given: {(skipped or {}).get(c, 'no input')}") for c, w in WEIGHTS.items()]
    return fit([("Confidence", [f"**{r['verdict']}**, {r['total']:.2f}", *each])], 4000)[0]


def triage(t, budget: int = 12_000) -> str:
    """The whole report: confidence and evidence first; sections that have no room are left out whole."""
    from faultline.plans import triage as T

    rows = T.evidence(t).collect()
    step = T.next_step(t.confidence.first()["verdict"], [r["source"] for r in rows if r["contour"] == "code"])
    seen = [f"- {r['contour']} {r['source'] or ''}: {r['detail']}" + (f" ×{r['count']}" if r["count"] else "") for r in rows]
    parts = [confidence(t.confidence, t.skipped), fit([("Evidence", seen), ("Next step", [step])], budget)[0], summary(t.records, budget // 2)]
    if t.hits is not None:
        parts.append(kb_hits(t.hits, budget // 4))
    if t.frames is not None:
        parts.append(code_hints(t.frames, t.phrases, t.exceptions, t.commits, budget // 4))
    out, used = [], 0
    for p in parts:
        if p.strip() and used + len(p) <= budget:
            out.append(p)
            used += len(p) + 1
    return "\n".join(out) or parts[0][:budget]
