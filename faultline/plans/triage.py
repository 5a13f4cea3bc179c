"""The whole investigation: logs, knowledge base, code, confidence, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from faultline.config import EngineConfig
from faultline.functions import scrub, text as tx
from faultline.operators import analyze, code, confidence, correlate, kb_search, records as rec
from faultline.session import cut

#: Rows of evidence of each kind that a report holds.
MOST_EVIDENCE = 5


@dataclass
class Triage:
    """Results of each stage; a stage without input is None, with the reason in `skipped`."""

    records: DataFrame
    groups: DataFrame
    signatures: DataFrame
    histogram: DataFrame
    traces: DataFrame
    hits: DataFrame | None = None
    frames: DataFrame | None = None
    phrases: DataFrame | None = None
    exceptions: DataFrame | None = None
    commits: DataFrame | None = None
    linked: DataFrame | None = None
    confidence: DataFrame | None = None
    skipped: dict[str, str] = field(default_factory=dict)
    scope: dict[str, str] = field(default_factory=dict)


def _fits(column: str, want: str | None) -> Column:
    """Whether an entry names the stand or service asked for; null where nothing is asked or the entry names none."""
    if not want:
        return F.lit(None).cast("boolean")
    have = F.transform(F.coalesce(column, F.expr("cast(array() as array<string>)")), F.lower)
    return F.when(F.size(have) > 0, F.array_contains(have, want.lower()))


def query_words(groups_of: DataFrame, services: DataFrame, exceptions: DataFrame) -> str:
    """Words to search the knowledge base with: the five most frequent exceptions and the three most frequent services but `access`. Both inputs are counted tables."""
    rows = [r[0] for r in exceptions.select("exception").limit(5).collect()] + [r[0] for r in services.select("source").limit(3).collect() if r[0].lower() != "access"]
    return " ".join(rows)


def phrases_of(groups_of: DataFrame, most: int = 6) -> list[str]:
    """Literal phrases of the first five warning groups, each once without regard to case, at most `most`."""
    rows = groups_of.where(F.col("level_rank") >= analyze.WARN).orderBy("n").limit(5).select(tx.literal_phrases(F.col("template"))).collect()
    seen = {p.lower(): p for r in rows[::-1] for p in r[0][::-1]}
    order = list(dict.fromkeys(p.lower() for r in rows for p in r[0]))
    return [seen[p] for p in order][:most]


def triage(lines: DataFrame, entries: DataFrame | None = None, files: DataFrame | None = None, code_lines: DataFrame | None = None, commits: DataFrame | None = None,
           touched: DataFrame | None = None, level: str | None = None, stand: str | None = None, service: str | None = None, config: EngineConfig = EngineConfig()) -> Triage:
    """Run the stages; each needs only what the stages before left in aggregated form. The parsed records are written to
    the shared folder once, as some fifteen branches read them.

    `stand` and `service` do not narrow the search, as a similar failure elsewhere is worth knowing; an entry of another stand or service counts less. `touched` (hash, path) tells
    which commits changed a file that a frame was found in."""
    records = cut(rec.read_records(lines, config, level=level))
    t = Triage(records, analyze.groups(records), analyze.signatures(records), analyze.histogram(records, 1, "WARN"),
               correlate.trace_candidates(correlate.trace_key(records).withColumn("service", F.col("source")), 10))
    t.scope = {k: v for k, v in (("stand", stand), ("service", service)) if v}
    sigs = [r["value"] for r in t.signatures.orderBy("ord").collect()]  # at most 12 rows
    classes = analyze.exception_counts(records)
    one = confidence.evidence_from_logs(t.signatures, t.groups, t.histogram)
    nothing = F.lit(None).cast("double")
    if entries is None:
        t.skipped["kb"] = "no knowledge base given"
        one = one.withColumn("kb", nothing)
    else:
        words = query_words(t.groups, analyze.counts(records, "source"), classes)
        t.hits = kb_search.search(entries, words, sigs or None, most=10)
        scoped = entries.select("id", _fits("stands", stand).alias("stand_fits"), _fits("services", service).alias("service_fits"))
        top = t.hits.limit(1).join(scoped, "id", "left").select(F.struct("score", "outcome", "stand_fits", "service_fits").alias("h")).limit(1)
        one = one.join(top, how="left").withColumn("kb", F.coalesce(confidence.kb_contour(F.col("h.score"), F.col("h.outcome"), F.col("h.stand_fits"), F.col("h.service_fits")), F.lit(0.0))).drop("h")
    if files is None:
        t.skipped["code"] = "no repository given"
        one = one.withColumn("code", nothing)
    else:
        t.frames = code.resolve(code.frames(rec.at_least(records, "WARN")), files)
        found = t.frames.where("file is not null")
        n = {"phrases": 0, "commits": 0, "linked": 0, "frames": found.limit(1).count()}
        if code_lines is not None:
            t.phrases = code.phrase_hits(phrases_of(t.groups), code_lines)
            t.exceptions = code.exception_hits([r[0] for r in classes.select("exception").limit(6).collect()], code_lines)
            n["phrases"] = t.phrases.count()
        if commits is not None:
            span = analyze.period(rec.at_least(records, "ERROR")).first()
            t.commits = code.commits_in_window(commits, str(span["first_ts"]) if span["first_ts"] else None, str(span["last_ts"]) if span["last_ts"] else None)
            n["commits"] = t.commits.count()
            if touched is not None:
                t.linked = code.linked_commits(t.commits, touched.join(found.select(F.col("file").alias("path")).distinct(), "path", "left_semi"))
                n["linked"] = t.linked.count()
        one = one.withColumn("code", confidence.code_contour(F.lit(n["frames"]), F.lit(n["phrases"]), F.lit(n["linked"]), F.lit(n["commits"])))
    t.skipped["trace"] = "not part of the triage chain"
    t.confidence = confidence.combine(one.withColumn("trace", nothing))
    return t


EVIDENCE = "contour string, source string, detail string, count bigint, score double, level string, first_ts timestamp_ntz, last_ts timestamp_ntz"


def evidence(t: Triage) -> DataFrame:
    """contour, source, detail, count, score, level, first_ts, last_ts: at most MOST_EVIDENCE rows of each contour, texts scrubbed."""
    void = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in EVIDENCE.split(", ")}

    def rows(df: DataFrame, contour: str, most: int = MOST_EVIDENCE, **cols: Column) -> DataFrame:
        out = df.limit(most).select(*[{**void, "contour": F.lit(contour), **cols}[c].alias(c) for c in void])
        return out.withColumn("detail", scrub.scrub(F.coalesce("detail", F.lit(""))))

    worst = t.groups.where(F.col("level_rank") >= 6).orderBy("n").limit(MOST_EVIDENCE)
    origins = analyze.group_origins(t.records).join(F.broadcast(worst.select("level", "template")), ["level", "template"], "left_semi").groupBy("level", "template").agg(
        F.array_join(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("count", "origin")))), lambda x: x["origin"]), 1, 3), ", ").alias("origins"))
    parts = [rows(worst.join(origins, ["level", "template"], "left").orderBy("n"), "logs", source=F.col("origins"), detail=F.col("template"), count=F.col("count"), level=F.col("level"), first_ts=F.col("first_ts"), last_ts=F.col("last_ts"))]
    if t.hits is not None:
        parts.append(rows(t.hits, "kb", source=F.col("id"), detail=F.col("title"), score=F.col("score"), level=F.col("outcome")))
    if t.frames is not None:
        best = t.frames.where("file is not null and rank = 1").orderBy(F.col("records").desc(), "file", "line")
        parts.append(rows(best, "code", source=F.concat_ws(":", "file", "line"), detail=F.coalesce(F.nullif("symbol", F.lit("")), F.lit("frame found in the repository")), count=F.col("records")))
    if t.phrases is not None:
        parts.append(rows(t.phrases.orderBy("path", "line_no"), "code", source=F.concat_ws(":", "path", "line_no"), detail=F.col("phrase")))
    if t.commits is not None:
        parts.append(rows(t.commits.orderBy(F.col("at").desc(), "hash"), "code", 2, source=F.concat(F.lit("commit "), F.substring("hash", 1, 7)), detail=F.col("subject"), first_ts=F.col("at")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def next_step(verdict: str, places: list[str], sufficient: bool = True) -> str:
    """fix where the cause is confirmed and a place in the code is known, bug where a cause is named, else investigate."""
    if not sufficient or verdict not in ("confirmed_by_data", "likely_cause"):
        return "investigate"
    return "fix" if verdict == "confirmed_by_data" and places else "bug"


def report_rows(t: Triage) -> DataFrame:
    """One row: verdict, total, the contours, evidence (array), next_step, missing (array), scope."""
    seen = evidence(t).agg(F.collect_list(F.struct("*")).alias("evidence"))  # at most MOST_EVIDENCE rows a kind
    missing = F.array(*[F.lit(f"{k}: {why}") for k, why in t.skipped.items()])
    d = t.confidence.crossJoin(seen)  # one row each
    has_place = F.exists("evidence", lambda e: e["contour"] == "code")
    step = F.when((F.col("verdict") == "confirmed_by_data") & has_place, "fix").when(F.col("verdict").isin("confirmed_by_data", "likely_cause"), "bug").otherwise("investigate")
    scope = F.create_map(*[F.lit(x) for kv in t.scope.items() for x in kv]) if t.scope else F.expr("cast(map() as map<string,string>)")
    return d.select("verdict", "total", "logs", "kb", "code", "trace", "evidence", step.alias("next_step"), missing.alias("missing"), scope.alias("scope"))


def report(t: Triage) -> DataFrame:
    """One row `json`: the report document."""
    logs = analyze.parsed_artifact(t.records).select(F.col("json").alias("parsed"))
    r = report_rows(t).select(F.to_json(F.struct("*")).alias("r"))
    return r.crossJoin(logs).select(F.concat(F.lit('{"schema":"report@1","parsed":'), F.col("parsed"), F.lit(","), F.expr("substr(r, 2)")).alias("json"))  # one row each
