"""Record parser and analysis on small logs written for the tests; the clock stands at 2026-07-28 20:00."""

import bz2
import gzip
import itertools
import json
import lzma
import re
import subprocess
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline.config import EngineConfig, parse_time
from faultline.functions import scrub, text as tx
from faultline.operators import alert_cards, analyze, code, confidence, correlate, kb_search, records as rec
from faultline.plans import render
from faultline.plans.reference import QUERIES
from faultline.sources import knowledge_base, loglines, repository

APP = [
    "2026-07-28 12:33:58 INFO [payment-api] request accepted", "2026-07-28 12:34:01 ERROR [payment-api] ConnectionTimeoutError: timed out after 3000 ms (order 17)", "2026-07-28 12:34:02 ERROR [payment-api] ConnectionTimeoutError: timed out after 3001 ms (order 18)",
    "java.io.IOException: closed", "\tat com.acme.Pay.run(Pay.java:42)", "  2026-07-28 12:00:00 indented time does not split", '{"timestamp":"2026-07-28T12:34:03Z","level":40,"service":"gw","trace_id":"req-7f3a9c","message":"declined \\"x\\""}',
    'ts=2026-07-28T12:34:04Z level=warn service=gw msg="level=3 slow" request_id=req-7f3a9c', '10.0.0.9 - - [28/Jul/2026:15:34:05 +0300] "GET /api/pay HTTP/1.1" 502 17', "Jul 28 12:34:06 host app[1]: WARN disk", "1785242047.5 ERROR late", "", "Feb 29 01:00:00 host app: INFO leap",
]


def lines(spark, rows):
    return spark.createDataFrame([(0, 0, "app.log", i, x) for i, x in enumerate(rows, 1)], loglines.SCHEMA)


@pytest.mark.parametrize("block", [2, 3, 8192])
def test_records(spark, block):
    r = {x["line_no"]: x for x in rec.read_records(lines(spark, APP), EngineConfig(), block).collect()}
    assert sorted(r) == [1, 2, 3, 7, 8, 9, 10, 11, 13]
    assert [r[n]["level"] for n in sorted(r)] == ["INFO", "ERROR", "ERROR", "ERROR", "WARN", "ERROR", "WARN", "ERROR", "INFO"]
    assert [r[n]["fmt"] for n in (1, 7, 8, 9)] == ["plain", "json", "logfmt", "access"]
    assert r[3]["n_lines"] == 4 and r[3]["source"] == "payment-api" and "Pay.java:42" in r[3]["message"]
    assert str(r[9]["ts"]) == "2026-07-28 12:34:05" and r[9]["tz_known"] and r[9]["status"] == 502 and not r[1]["tz_known"]
    assert str(r[10]["ts"]) == "2026-07-28 12:34:06" and str(r[13]["ts"]) == "2024-02-29 01:00:00" and r[7]["trace"] == r[8]["trace"] == "req-7f3a9c"


def test_analysis(spark):
    r = rec.read_records(lines(spark, APP)).persist()
    g = analyze.groups(r).orderBy("n").collect()
    assert g[0]["level"] == "ERROR" and {x["template"] for x in g} >= {"request accepted", "ConnectionTimeoutError: timed out after <n> ms (order <n>)", "GET <path> -> HTTP <n>"}
    assert {x["exception"]: x["count"] for x in analyze.exception_counts(r).collect()} == {"ConnectionTimeoutError": 2, "java.io.IOException": 1}
    s = [x["value"] for x in analyze.signatures(r).orderBy("ord").collect()]
    assert s[:3] == ["ConnectionTimeoutError", "java.io.IOException", "http_status=502"]
    p = analyze.period(r).first()
    assert p["mixed"] and p["records"] == 9
    assert rec.read_records(lines(spark, APP), level="ERROR").count() == rec.at_least(r, "ERROR").count() == 5
    doc = json.loads(analyze.parsed_artifact(r, top=2).first()["json"])
    assert len(doc["groups"]) == 2 and doc["n_groups"] == len(g) and doc["period"][0]["records"] == 9
    r.unpersist()


def test_artifact_is_whole_and_reads_back(spark, tmp_path):
    schema = "src int, entry int, origin string, line_no bigint, ts timestamp_ntz, tz_known boolean, level string, level_rank int, message string, source string, trace string, status int, fmt string, raw string, n_lines int"
    r = spark.range(1200).selectExpr("0 src", "0 entry", "'a.log' origin", "id line_no", "timestamp_ntz'2026-07-28 12:00:00' ts", "true tz_known", "'ERROR' level", "6 level_rank", "translate(cast(1000 + id as string), '0123456789', 'abcdefghij') message",
                                     "'pay' source", "cast(null as string) trace", "500 status", "'plain' fmt", "concat('x.', initcap(translate(cast(1000 + id as string), '0123456789', 'abcdefghij')), 'Exception') raw", "1 n_lines").to(spark.createDataFrame([], schema).schema)
    analyze.write_artifact(r, str(tmp_path / "a"))
    t = analyze.read_artifact(spark, str(tmp_path / "a"))
    assert t["groups"].count() == 1200 and t["exceptions"].count() == 1200 and t["period"].first()["records"] == 1200 and t["groups"].where("n = 1").first()["sources"] == 1
    with pytest.raises(ValueError):
        analyze.read_artifact(spark, str(tmp_path / "none"))
    (tmp_path / "a" / "levels" / "part-x.json").write_text("{oops\n")
    with pytest.raises(ValueError):
        analyze.read_artifact(spark, str(tmp_path / "a"))


@pytest.mark.parametrize("rows", [[], [""], ["free text"], ["no time", "  none here either"], ["2026-07-28 12:00:00 INFO " + "x" * 20000]])
def test_edges(spark, rows):
    r = rec.read_records(lines(spark, rows)).collect()
    assert len(r) == (1 if any(x.strip() for x in rows) else 0)
    assert [x["raw"] for x in r] == ["\n".join(rows)] * len(r)
    bounds = EngineConfig(max_line_chars=8192, max_record_lines=60, max_message_chars=4000)
    assert all(len(x["raw"]) <= 8192 for x in rec.read_records(lines(spark, rows), bounds).collect())


def test_whole_records_and_bounds(spark):
    rows = ["2026-07-28 12:00:00 ERROR boom", *[f"\tat a.B.c(B.java:{i})" for i in range(100)], "Caused by: x.y.LateException: z"]
    one = rec.read_records(lines(spark, rows)).first()
    assert one["n_lines"] == 102 and one["raw"] == "\n".join(rows)
    assert [x["exception"] for x in analyze.exception_counts(rec.read_records(lines(spark, rows))).collect()] == ["x.y.LateException"]
    cut = rec.read_records(lines(spark, rows), EngineConfig(max_record_lines=60)).first()
    assert cut["n_lines"] == 60


MIXED = ["orphan", "2026-07-28 12:00:00 INFO a", "  tail of a", "2026-07-28 12:00:01 DEBUG b", "tail of b", "tail of b", "tail of b", "2026-07-28 12:00:02 ERROR c", "tail of c", "tail of c", "tail of c", "2026-07-28 12:00:03 INFO e=IOError: f=g", "2026-07-28T12:00:04+03:00 INFO d",
         "2026-07-28 12:00:05 info e", "28.07.2026 12:00:06 ERROR f", "2026-07-28 12:00:07 no level, IOException", '{"level":"info","time":"2026-07-28T12:00:08Z","msg":"ERROR"}', "level=error ts=2026-07-28T12:00:09Z msg=x", "2026-07-28 12:00:10 INFO level=fatal a=b", "2026-07-28 12:00:11 WARN g", "tail of g"]


@pytest.mark.parametrize("block", [2, 8192])
def test_early_filters_lose_nothing(spark, block):
    key = lambda df: sorted((r["line_no"], r["raw"], r["level"]) for r in df.collect())
    every = rec.read_records(lines(spark, MIXED), EngineConfig(), block).persist()
    assert len(every.collect()) == 13 and rec.stitch(lines(spark, MIXED), block_lines=block, level="ERROR").count() < 11
    for level in ("WARN", "ERROR"):
        assert key(rec.read_records(lines(spark, MIXED), EngineConfig(), block, level=level)) == key(rec.at_least(every, level))
    for a, b in (("2026-07-28 12:00:02", "2026-07-28 12:00:05"), ("2026-07-28", None)):
        assert key(rec.read_records(lines(spark, MIXED), EngineConfig(), block, since=a, until=b)) == key(rec.within(every, a, b))
    assert key(rec.read_records(lines(spark, MIXED), EngineConfig(), block, pattern="IOE")) == key(rec.grep(every, "IOE"))
    every.unpersist()

def test_templates(spark):
    cases = {"see https://a.b/c?d=1 now": "see <url> now", "mail a.b@c.de": "mail <email>", "id 123e4567-e89b-12d3-a456-426614174000": "id <uuid>", "at 2026-07-28T12:00:00.5Z": "at <ts>", "from 10.0.0.1:80": "from <ip>",
             "/var/log/x.log gone": "<path> gone", "'abc' or \"de\"": "<str> or <str>", "1, 2, 3 left": "<n> left", "сбой7": "<n>", "": "<empty>", "a\nb": "a ⏎ b", "w" * 300: "w" * 180 + "…"}
    df = spark.createDataFrame([(k,) for k in cases], "message string")
    assert {r["message"]: r["template"] for r in tx.with_template(df).collect()} == cases == {r[0]: r[1] for r in df.select("message", tx.template(F.col("message"))).collect()}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.slug(F.lit("Ёлка & Щит 7!"))) == "elka-schit-7" and one(tx.slug(F.lit("…"))) == "incident"
    assert one(tx.tokens(F.lit("The pools were exhausted по причине таймаутами"))) == ["pools", "were", "exhaust", "причин", "таймаут"]
    sim = lambda a, b: one(tx.signature_similarity(tx.norm_signature(F.lit(a)), tx.norm_signature(F.lit(b))))
    assert sim("tmpl:A <n> b", "a <id> b") == 1.0 and sim("pool", "pool exhausted") == 0.85 and sim("alpha beta", "beta gamma") == pytest.approx(1 / 3) and sim("", "x") == 0.0
    assert one(tx.literal_phrases(F.lit("timed out waiting for <n> connections from pool"))) == ["connections from pool", "timed out waiting for"]


def test_scrub(spark):
    cases = {"mail a@b.com": "mail <email>", "+7 926 123-45-67 rang": "<phone> rang", "token=abc123secret": "token=<redacted>", "Authorization: Bearer eyJa.bc.de": "Authorization=<redacted>", "https://u:p@h/x": "https://<redacted>@h/x",
             "123-456-789 00": "<person_id>", "4111 1111 1111 1111 ok": "<card:…1111> ok", "1234567890123456 order": "1234567890123456 order", "req-12 v1.2.3 10.0.0.1": "req-12 v1.2.3 10.0.0.1", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", scrub.scrub(F.col("t"))).collect()} == cases


def test_frames_and_code(spark, tmp_path):
    text = 'at com.acme.Pay.run(Pay.java:2)\nFile "/app/svc/pay.py", line 3, in charge\n/srv/x/handler.go:88'
    f = code.frames(spark.createDataFrame([(text,)], "raw string"))
    assert {(r["base"], r["line"]) for r in f.collect()} == {("Pay.java", 2), ("pay.py", 3), ("handler.go", 88)}
    (tmp_path / "svc").mkdir()
    (tmp_path / "svc" / "pay.py").write_text("a\nb\nraise PoolEmpty\nd\n")
    (tmp_path / "Pay.kt").write_text("one\ntwo\n")
    files, body = repository.read_code(spark, str(tmp_path))
    got = code.resolve(f, files)
    assert {(r["base"], r["file"]) for r in got.collect()} == {("pay.py", "svc/pay.py"), ("Pay.java", "Pay.kt"), ("handler.go", None)}
    assert [r["code"] for r in code.context(got, body, 1).where("file = 'svc/pay.py'").orderBy("at").collect()] == ["b", "raise PoolEmpty", "d"]
    assert [tuple(r) for r in code.phrase_hits(["poolempty"], body).collect()] == [("svc/pay.py", 3, "poolempty")]
    assert repository.commits(spark, str(tmp_path)).count() == 0


def test_log_source(spark, tmp_path):
    data = b"one\r\ntwo \xff\n"
    for name, write in (("a.log", open), ("b.log.gz", gzip.open), ("c.log.bz2", bz2.open), ("d.log.xz", lzma.open)):
        with write(tmp_path / name, "wb") as f:
            f.write(data)
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x.log", data)
        z.writestr("y.log", data)
    (tmp_path / "bad.log.xz").write_bytes(b"no archive")
    (tmp_path / "core.12345").write_text("not a log")
    (tmp_path / "app.log.1").write_text("rotated\n")
    r = loglines.read_logs(spark, [str(tmp_path), str(tmp_path / "none*.log")]).collect()
    assert sorted({x["origin"] for x in r}) == ["a.log", "app.log.1", "b.log.gz", "c.log.bz2", "d.log.xz", "e.zip!x.log", "e.zip!y.log"]
    told = [x["text"] for x in loglines.log_warnings(spark, [str(tmp_path), str(tmp_path / "none*.log")]).collect()]
    assert len(told) == 2 and any("bad.log.xz" in x for x in told) and any("none*.log: no such file" in x for x in told)
    assert loglines.read_logs(spark, [str(tmp_path)], max_lines=4).count() == 4
    assert {x["text"] for x in r if x["origin"] == "a.log"} == {"one", "two �"}
    assert loglines.expand([str(tmp_path / "none*")])[1]


def test_knowledge_base(spark, tmp_path):
    e = {"id": "INC-2026-07-001", "title": "Pool exhausted", "date": "2026-07-01", "stands": ["prod"], "services": ["payment-api"], "tags": ["pool"], "signatures": ["ConnectionTimeoutError"], "status": "resolved", "outcome": "confirmed", "sections": {"Симптомы": "pool timeout"}}
    knowledge_base.upsert(e, str(tmp_path))
    knowledge_base.upsert({"id": e["id"], "tags": ["POOL", "db"], "sections": {"Причина": "leak"}}, str(tmp_path))
    knowledge_base.upsert({"id": "INC-2026-07-002", "title": "Disk full", "tags": [], "outcome": "refuted", "signatures": ["ConnectionTimeoutError"]}, str(tmp_path))
    (tmp_path / "README.md").write_text("no entry")
    with pytest.raises(ValueError):
        knowledge_base.upsert({"id": "x", "sections": {"Симптомы": "2026-07-28 12:00:00 ERROR x"}}, str(tmp_path))
    k = knowledge_base.read_entries(spark, str(tmp_path)).persist()
    one = k.where(F.col("id") == e["id"]).first()
    assert one["tags"] == ["pool", "db"] and one["sections"]["Причина"] == "leak" and one["stands"] == ["prod"] and one["meta"]["reuse_count"] == "1"
    assert [r["id"] for r in kb_search.search(k, "pool timeout", ["ConnectionTimeoutError"]).collect()] == [e["id"], "INC-2026-07-002"]
    assert kb_search.next_id(k, 2026, 7) == "INC-2026-07-003" and kb_search.same_signature(k, ["connectiontimeouterror"]).count() == 2
    assert {r["value"]: r["count"] for r in kb_search.counts(k, "tags").collect()} == {"pool": 1, "db": 1}


def test_header_values_read_back():
    values = ["plain", "", "a: b", "[x", "it's", 'say "x"', ["a", "b c", "d, e"], {"kind": "mcp", "server": "kibana-mcp", "url": "https://h:1/x"}, [{"source": "loki", "verdict": "empty", "note": "none, since May"}], {"a": {"b": ["c", "d"]}}]
    for v in values:
        want = json.loads(json.dumps(v).replace('\\"', "'"))
        assert knowledge_base.parse_value(knowledge_base.show(v)) == want, v


def test_updates_lose_nothing(tmp_path):
    kb = str(tmp_path)
    kb_entry = lambda i: knowledge_base.parse_entry((tmp_path / f"{i}.md").read_text(), f"{i}.md")["fields"]
    (tmp_path / "INC-1.md").write_text("---\nid: INC-1\nkind: incident\ntitle: T\ndate: 2026-07-01\nrelated: [INC-2, INC-3]\nowner: ops\nextra: {a: b}\nsignatures:\n  - \"Old: x\"\n---\n\n## Симптомы\n\nslow\n")
    knowledge_base.upsert({"id": "INC-1", "signatures": ["old: X", "New"], "outcome": "confirmed"}, kb, day="2026-07-28")
    f = kb_entry("INC-1")
    assert f["related"] == ["INC-2", "INC-3"] and f["owner"] == "ops" and f["extra"] == {"a": "b"} and f["signatures"] == ["Old: x", "New"] and f["outcome_date"] == f["reused_at"] == "2026-07-28" and f["reuse_count"] == "1"
    text = (tmp_path / "INC-1.md").read_text()
    assert "Повторилось 2026-07-28." in text and "slow" in text
    knowledge_base.upsert({"id": "INC-1", "status": "resolved"}, kb, day="2026-07-29")
    assert kb_entry("INC-1")["reuse_count"] == "1"
    knowledge_base.upsert({"id": "INC-9", "signatures": ["new"], "sections": {"Симптомы": "mail a@b.com"}}, kb, day="2026-07-30", by_signature=True, clean=lambda t: t.replace("a@b.com", "<email>"))
    assert not (tmp_path / "INC-9.md").exists() and kb_entry("INC-1")["id"] == "INC-1" and "_2026-07-30:_ mail <email>" in (tmp_path / "INC-1.md").read_text()
    knowledge_base.upsert_source("prod", ["pay"], kb, "SRC-prod-pay", source={"kind": "mcp", "server": "kibana"}, query="level:error", day="2026-07-01")
    knowledge_base.upsert_source("prod", ["PAY", "gw"], kb, "SRC-prod-pay", checked={"source": "loki", "verdict": "empty", "note": "old"}, day="2026-07-02")
    knowledge_base.upsert_source("prod", ["pay"], kb, "SRC-prod-pay", checked={"source": "Loki", "verdict": "unavailable"}, day="2026-07-03")
    m = kb_entry("SRC-prod-pay")
    assert m["confirmed"] == "2026-07-01" and m["services"] == ["pay", "gw"] and m["checked"] == [{"source": "Loki", "verdict": "unavailable", "date": "2026-07-03"}] and m["source"] == {"kind": "mcp", "server": "kibana"}
    for bad in ({"query": "a\nb"}, {"query": "12:00:00 ERROR x"}, {"checked": {"source": "x", "verdict": "good"}}):
        with pytest.raises(ValueError):
            knowledge_base.upsert_source("prod", ["pay"], kb, "SRC-prod-pay", **bad)
    with pytest.raises(ValueError):
        knowledge_base.upsert({"id": "SRC-prod-pay", "title": "x"}, kb)
    assert knowledge_base.knowledge_base_folder("/x", environ={})[1] == "given" and knowledge_base.knowledge_base_folder(None, environ={knowledge_base.KB_VARIABLE: "/y"}) == ("/y", "environment")
    assert knowledge_base.knowledge_base_folder(None, start=kb, environ={})[1] == "user"


def test_index(spark, tmp_path):
    kb, index = str(tmp_path / "kb"), str(tmp_path / "index")
    knowledge_base.upsert({"id": "INC-1", "title": "T", "tags": ["a"], "signatures": ["X"]}, kb)
    assert knowledge_base.read_index(spark, index, kb)[1] == "no index"
    knowledge_base.write_index(knowledge_base.read_entries(spark, kb), index, at=datetime.now().replace(year=2100))
    got, why = knowledge_base.read_index(spark, index, kb)
    assert why == "index" and got.first()["title"] == "T" and spark.read.parquet(f"{index}_counts").where("field = 'tags'").first()["value"] == "a"
    knowledge_base.upsert({"id": "INC-2", "title": "U"}, kb)
    assert knowledge_base.read_index(spark, index, kb)[1] == "index is stale"


def test_similar_signatures_are_all_found(spark):
    words = ["pool", "timeout", "read", "ab", "x", "spooler", "gate way", "way"]
    sigs = sorted({" ".join(w) for n in (1, 2, 3) for w in itertools.permutations(words, n) if hash_of(w) % 7 == 0} | set(words))
    df = spark.createDataFrame([(x,) for x in sigs], "s string")
    got = {(r["s"], r["c"]) for r in kb_search.similar_signatures(df.where("hash(s) % 3 = 0"), df).collect()}
    t = df.select("s", tx.tokens(F.col("s"), True).alias("t"))
    want = t.where("hash(s) % 3 = 0").crossJoin(t.select(F.col("s").alias("c"), F.col("t").alias("u"))).where(tx.signature_similarity(F.col("s"), F.col("c"), F.col("t"), F.col("u")) >= 0.5)
    assert got == {(r["s"], r["c"]) for r in want.collect()} and got


def hash_of(words):
    return sum(ord(c) * (i + 1) for i, c in enumerate(" ".join(words)))


def test_alert_cards(spark):
    rows = [(1, '{"alerts":[{"labels":{"alertname":"A","env":"staging","service":"pay"},"startsAt":"2026-07-28T12:00:00.123456789Z"}]}'), (2, '{"alerts":[{"labels":{"alertname":"A"},"startsAt":"0001-01-01T00:00:00Z"}]}'), (3, '{"kind":"x"}'), (4, None)]
    c = {r["delivery_id"]: r for r in alert_cards.cards(spark.createDataFrame(rows, "delivery_id bigint, payload string")).collect()}
    assert (c[1]["stand"], c[1]["service"], c[1]["sufficient"], c[1]["missing"]) == ("stage", "pay", True, []) and str(c[1]["since"]) == "2026-07-28 11:45:00.123456"
    assert c[2]["missing"] == ["stand", "service", "time"] and not c[2]["sufficient"] and str(c[2]["until"]) == "2026-07-28 20:15:00" and c[3]["shape"] is None and c[4]["shape"] is None


def test_correlation(spark):
    r = spark.sql("""select concat('k', i) key, s service, 'ERROR' level, 6 level_rank, timestamp_ntz'2026-07-28 16:00:00' + make_dt_interval(0, 0, i, if(s = 'beta', 5, 0)) ts, i line_no, '' raw
        from (select explode(sequence(0, 4)) i) cross join (select explode(array('alpha', 'beta')) s)""")
    c = correlate.clock_skew(r).first()
    assert (c["a"], c["b"], c["n"], c["median_s"], c["systematic"]) == ("alpha", "beta", 5, 5.0, True)
    assert correlate.clock_skew(correlate.with_offsets(r, {"beta": -5.0})).count() == 0
    assert [(h["service"], h["gap_s"]) for h in correlate.chain(r, "K3").orderBy("hop").collect()] == [("alpha", None), ("beta", 5.0)]
    assert correlate.break_points(r).where("key = 'k0'").first()["service"] == "alpha"
    m = spark.createDataFrame([("s", f"2026-01-01 00:{i:02d}:00", n) for i, n in enumerate([1, 1, 1, 30, 40, 1, 1, 50])], "series string, b string, count int").withColumn("bucket", F.col("b").cast("timestamp_ntz"))
    assert [str(x["bucket"])[14:16] for x in correlate.spikes(m).orderBy("bucket").collect()] == ["03", "07"]


def test_confidence(spark):
    e = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (1.0, None, 0.5, None), (0.0, 0.0, None, 0.0)], "logs double, kb double, code double, trace double")
    assert [(r["total"], r["verdict"]) for r in confidence.combine(e).collect()] == [(1.0, "confirmed_by_data"), (0.425, "likely_cause"), (0.0, "insufficient_data")]


def test_config():
    assert EngineConfig(now="2026-07-28 20:00").now_us == 1785268800000000
    with pytest.raises(ValueError):
        EngineConfig(now="soon")
    with pytest.raises(ValueError):
        EngineConfig(mode="other")
    now = datetime(2026, 7, 28, 20)
    for text, want in {"30m": "2026-07-28 19:30:00", "-2d": "2026-07-26 20:00:00", "12:10": "2026-07-28 12:10:00", "2026-07-27": "2026-07-27 00:00:00", "2026-07-27T10:00:00+03:00": "2026-07-27 07:00:00", "27.07.2026 10:00": "2026-07-27 10:00:00"}.items():
        assert str(parse_time(text, now)) == want
    with pytest.raises(ValueError):
        parse_time("soon", now)


def test_feeds_and_budgets(spark):
    e = spark.sql("""select timestamp_ntz'2026-07-28 12:00:00' + make_dt_interval(0, 0, 0, s) ts, kind, 'WARN' level, text, 'app' source, s seq from values (0, 'first_seen', 'a'), (30, 'first_seen', 'a'), (61, 'first_seen', 'a'), (200, 'spike', 'b'), (9999, 'milestone', 'c') v(s, kind, text)""").withColumn("seq", F.col("seq").cast("long"))
    rows = correlate.ordered(e).orderBy("pos").collect()
    assert [r["seq"] for r in rows] == [0, 61, 200, 9999] and [r["gap_s"] for r in rows] == [None, 61.0, 139.0, 9799.0]
    assert correlate.first_event(correlate.ordered(e)).first()["seq"] == 0 and correlate.ordered(e, since="2026-07-28 12:01:00", until="2026-07-28 12:10:00").count() == 2
    assert correlate.parse_milestone("2026-07-28 12:00|deploy") == ("2026-07-28 12:00", "deploy") and correlate.parse_milestone("12:00 deploy 1") == ("12:00", "deploy 1") and correlate.parse_milestone("2026-07-28 12:00:05 x y") == ("2026-07-28 12:00:05", "x y")
    g = spark.sql("select n, 10 as chars, timestamp_ntz'2026-07-28 12:00:00' - make_dt_interval(0, 0, n) first_ts from (select explode(sequence(1, 9)) n)")
    assert [r["n"] for r in correlate.within_budget_early(g, "chars", 45).collect()] == [1, 2, 8, 9]
    assert (render.span(None), render.span(0.25), render.span(61), render.span(-90061)) == ("", "250 ms", "1 min 1 s", "-1 d 1 h") and render.plural(1, "hop") == "1 hop" and render.plural(2, "hop") == "2 hops"
    text, hidden = render.fit([("A", ["x" * 50, "y" * 50]), ("B", ["z" * 500]), ("C", ["w" * 10])], 150)
    assert hidden == 1 and "w" * 10 in text and "z" not in text and len(text) < 190


def _repository(folder):
    (folder / "svc").mkdir(parents=True)
    (folder / "svc" / "Pay.java").write_text("a\nclass ConnectionTimeoutError\n")
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t.invalid", *a], check=True, capture_output=True, env={"GIT_COMMITTER_DATE": "2026-07-28T12:00:00Z", "GIT_AUTHOR_DATE": "2026-07-28T12:00:00Z", "PATH": "/usr/bin:/bin"})
    git("init", "-q"), git("add", "."), git("commit", "-qm", "pool of ten")
    return str(folder)


def test_triage(spark, tmp_path):
    from faultline.plans.triage import evidence, next_step, report, report_rows, triage

    root = _repository(tmp_path / "r")
    files, body = repository.read_code(spark, root)
    touched = repository.touched_files(spark, root)
    kb = spark.createDataFrame([("INC-1", "incident", "pool", ["stage"], ["pay"], ["ConnectionTimeoutError", "java.io.IOException", "http_status=502"], "confirmed", datetime(2026, 7, 1).date(), ["svc/Pay.java"]), ("INC-2", "incident", "disk", [], [], ["x"], None, None, [])],
                              "id string, kind string, title string, stands array<string>, services array<string>, signatures array<string>, outcome string, date date, files array<string>").withColumns({"tags": F.array().cast("array<string>"), "status": F.lit(""), "sections": F.create_map(F.lit("Симптомы"), F.lit("pool"))})
    t = triage(lines(spark, APP), kb, files, body, repository.commits(spark, root), touched, stand="prod", service="pay")
    one = t.confidence.first()
    assert one["code"] == 0.8 and 0 < one["kb"] < 1 and t.linked.count() == 1 and t.hits.first()["id"] == "INC-1"
    same = triage(lines(spark, APP), kb, stand="stage", service="pay").confidence.first()
    assert one["kb"] == pytest.approx(same["kb"] * 0.6)
    assert {r["contour"] for r in evidence(t).collect()} == {"logs", "kb", "code"} and report_rows(t).first()["scope"] == {"stand": "prod", "service": "pay"}
    doc = json.loads(report(t).first()["json"])
    assert doc["schema"] == "report@1" and doc["parsed"]["groups"] and doc["evidence"]
    assert next_step("confirmed_by_data", ["a:1"]) == "fix" and next_step("likely_cause", []) == "bug" and next_step("hypothesis", ["a"]) == next_step("likely_cause", [], False) == "investigate"
    text = render.triage(t)
    assert "ConnectionTimeoutError" in text and len(text) <= 12_000
    assert [tuple(r) for r in code.exception_hits(["x.ConnectionTimeoutError", "y.None"], body).collect()] == [("x.ConnectionTimeoutError", "svc/Pay.java", 2)]
    assert [r["id"] for r in code.changed_since(kb, touched).collect()] == ["INC-1"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from faultline.__main__ import main

    monkeypatch.setenv("FAULTLINE_NOW", "2026-07-28 20:00:00"), monkeypatch.setenv("FAULTLINE_RUNS", str(tmp_path / "runs"))
    log = tmp_path / "app.log"
    log.write_text("\n".join(APP))
    assert main(["parse", str(log), "--level", "ERROR", "--since", "12:00"], spark) == 0
    assert "ConnectionTimeoutError" in capsys.readouterr().out
    assert main(["trace", f"gw={log}", "--id", "req-7f3a9c"], spark) == 0 and "1. gw" in capsys.readouterr().out
    (tmp_path / "alert.json").write_text('{"kind": "x"}')
    assert main(["alert", str(tmp_path / "alert.json")], spark) == 3
    assert main(["parse", str(log), "--since", "soon"], spark) == 2
    assert (tmp_path / "runs").read_text().split("\n")[0].split("\t")[1:] == ["parse", "--level --since", "rc=0"]


def test_frames_of_all_languages_against_brute_force(spark, tmp_path):
    raws = ["at com.acme.Pay.run(Pay.java:2) at com.acme.Pay.run(Pay.java:2)", 'File "/app/svc/pay.py", line 3, in charge', "at go (/srv/web/a.tsx:7:1)", "/srv/x/handler.go:88", "in C:\\src\\A.cs:line 12", "./lib/b.rb:5", "see core/main.rs:9 and Pay.java:2", "plain", "", None]
    want = {}
    for raw in raws:
        seen = {}
        for pattern, path, line, symbol in tx.FRAMES:
            for m in re.finditer(pattern, raw or ""):
                seen.setdefault((re.split(r"[/\\\\]", m.group(path))[-1], int(m.group(line))), (m.group(path), (m.group(symbol) or "") if symbol else ""))
        for k, v in seen.items():
            want.setdefault(k, []).append(v)
    want = {k: (min(p for p, _ in v), max(s for _, s in v), len(v)) for k, v in want.items()}
    spark.createDataFrame([(r,) for r in raws], "raw string").write.parquet(str(tmp_path / "log_lines.parquet"))
    got = {(r["base"], r["line"]): (r["path"], r["symbol"], r["records"]) for r in QUERIES["code_frames"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 7 and want["Pay.java", 2][2] == 2


def test_clock_skew_reports_every_pair(spark):
    n = 143  # 10153 pairs
    r = spark.range(3 * n).selectExpr("cast(id % 3 as string) as key", "concat('s', lpad(cast(id div 3 as string), 3, '0')) as service", "cast(timestamp_seconds(10 * (id div 3)) as timestamp_ntz) as ts")
    got = correlate.clock_skew(r).collect()
    assert {(x["a"], x["b"]): (x["n"], x["median_s"], x["mad_s"]) for x in got} == {(f"s{i:03}", f"s{j:03}"): (3, 10.0 * (j - i), 0.0) for i in range(n) for j in range(i + 1, n)}


def test_clock_skew_has_every_source(spark, tmp_path):
    at = "cast(timestamp_seconds(id * 100) as timestamp_ntz)"
    spark.range(3).selectExpr("id as o_orderkey", "id as o_custkey", f"{at} as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3).selectExpr("id as l_orderkey", "explode(sequence(1, 7)) as l_linenumber", "id").selectExpr("l_orderkey", "l_linenumber", "cast(timestamp_seconds(id * 100 + 5 * l_linenumber) as timestamp_ntz) as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(x["a"], x["b"]): x["median_s"] for x in QUERIES["clock_skew"](spark, str(tmp_path)).collect()}
    when = {"orders": 0} | {f"ship-{k}": 5 * k for k in range(1, 8)}
    assert got == {(a, b): when[b] - when[a] for a in when for b in when if a < b}


def test_search_all_equals_single_searches(spark):
    kb = spark.read.parquet("/root/testdata/sf0.001/kb_incidents.parquet")
    e = kb_search.from_table(kb).withColumn("id", F.concat_ws("#", "id", "kb_id")).persist()
    got = {}
    for r in QUERIES["kb_similar_all"](spark, "/root/testdata/sf0.001").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["outcome"], round(r["score"], 1)))
    asked = kb.where("kb_id % 20 = 0").collect()
    want = {q["kb_id"]: [(r["id"], r["outcome"], round(r["score"], 1)) for r in kb_search.search(e, q["title"] or "", list(q["signatures"] or [])).collect()] for q in asked}
    assert got == {k: v for k, v in want.items() if v} and got
    e.unpersist()
