"""Core operators against brute force on small fixtures, with nulls, blanks, repeats, ties, empty tables and clashing columns."""

import json
from collections import defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from faultline.functions.instants import with_instant
from faultline.operators.alert_times import alert_instants
from faultline.operators.exactly_once import canonical_id, exactly_once, split_by_frequency
from faultline.operators.log_entries import entry_instants, log_entries
from faultline.operators.schema_drift import cast_report, leaves, schema_changes, table_columns, whole_table

LINES = "line_id bigint, file_id bigint, line_no bigint, raw string, shipped_at timestamp_ntz, start boolean, block int"
FILES = "file_id bigint, file_name string, tz_name string, collected_at timestamp_ntz"


def us(y, o, d, h=0, i=0, s=0, f=0, zone=timezone.utc, fold=0):
    t = datetime(y, o, d, h, i, s, tzinfo=zone, fold=fold)
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + f


BERLIN = ZoneInfo("Europe/Berlin")
TIMES = [
    ("2025-08-10 01:14:54,397+03", us(2025, 8, 9, 22, 14, 54, 397000)), ("2025-09-24T22:11:55.231781143Z", us(2025, 9, 24, 22, 11, 55, 231781)),
    ("13/Aug/2025:07:21:35 +0300", us(2025, 8, 13, 4, 21, 35)), ("Sun, 17 Aug 2025 00:00:45 +0300", us(2025, 8, 16, 21, 0, 45)), ("Oct 29, 2025 12:10:55 AM", us(2025, 10, 29, 0, 10, 55, zone=BERLIN)),
    ("Oct 29, 2025 12:10:55 PM", us(2025, 10, 29, 12, 10, 55, zone=BERLIN)), ("16.08.2025 00:02:45", us(2025, 8, 16, 0, 2, 45, zone=BERLIN)), ("1754685158", 1754685158000000), ("1756388270351", 1756388270351000),
    ("1755275243.629623", 1755275243629623), ("2025-08-06 16:42:45.144 MSK", us(2025, 8, 6, 13, 42, 45, 144000)), ("2025-10-26 02:30:00", us(2025, 10, 26, 2, 30, zone=BERLIN)),
    ("2025/08/13 07:21:35", us(2025, 8, 13, 5, 21, 35)), ("2024-02-29T00:00:00z", us(2024, 2, 29)), ("2026-02-30T10:00:00Z", None), ("0001-01-01T00:00:00Z", None), ("n/a", None), ("", None), (None, None),
    ("2025-13-01 00:00:00", None), ("2025-01-01 24:00:00", None), ("2025-01-01 00:00:60", None), ("Aug 31, 2025 13:19:16 PM", None), ("2025-08-10T01:14:54+99:99", None), ("2025-08-10T01:14:54+0300", us(2025, 8, 9, 22, 14, 54)),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, t, "Europe/Berlin") for i, (t, _) in enumerate(TIMES)], "i int, t string, z string")
    got = {r["i"]: r["us"] for r in with_instant(df, "t", "z").collect()}
    assert {TIMES[i][0]: got[i] for i in got} == dict(TIMES)


def test_no_year_takes_latest_not_after(spark):
    rows = [("Jul 28 12:33:44", us(2026, 7, 28, 12, 33, 44)), ("Jul 29 12:33:44", us(2025, 7, 29, 12, 33, 44)), ("Feb 29 01:00:00", us(2024, 2, 29, 1)), ("Feb 30 01:00:00", None)]
    df = spark.createDataFrame([(t, us(2026, 7, 28, 20)) for t, _ in rows], "t string, u bigint")
    assert {r["t"]: r["us"] for r in with_instant(df, "t", "'UTC'", "u").collect()} == dict(rows)


def _log(spark, rows):
    return spark.createDataFrame([(i + 1, f, n, raw, datetime(2026, 1, 1), True, 7) for i, (f, n, raw) in enumerate(rows)], LINES)


LOG = [
    "	at orphan.Frame.run(Frame.java:1)", "2025-08-30T10:19:46.927Z payment-api INFO started", "2025-08-30T10:19:47Z [gateway] ERROR boom", "java.io.IOException: socket closed", "	at a.B.c(B.java:1)", "  last success: 2025-12-30 04:15:29 from cache",
    '{"amount": 373, "retry": false}', "{", '  "time": 1735698673240,', '  "level": 40,', '  "app": "orders-api"', "}", "time=2025-01-01T00:12:02.275Z level=info service=billing msg=\"level=3 done service=x\"",
    '192.0.2.6 - - [01/Jan/2025:02:09:12 +0100] "GET /a HTTP/1.1" 502 1', "<139>1 2025-01-01T03:47:12.506374Z host engine 1 ID - x", "Dec 31 07:00:42 node rates-feed[8114]: INF ok", "2025/04/27 20:51:05 [emerg] 8028#0: *251 x",
    "2026-02-27 10:45:01,504 - search.jobs - WARNING - x", "31.12.2025 12:00:40 [pool-1] FATAL net.a.Client - x", "2025-12-21 10:12:16 report-builder: ERROR in text", "1735690917 search-proxy SEVERE x", None, "", '{"ts": 1732, "lvl": "info", "logger": "b.db", "msg": "m"}',
    "2025-03-08 22:59:47 WRN   [stock-keeper] x",
]
WANT = [(2, 1, "INFO", "payment-api"), (3, 5, "ERROR", "gateway"), (8, 5, "ERROR", "orders-api"), (13, 1, "INFO", "billing"), (14, 1, "ERROR", "access"), (15, 1, "ERROR", "engine"), (16, 1, "INFO", "rates-feed"),
        (17, 1, "FATAL", ""), (18, 1, "WARN", "search.jobs"), (19, 1, "FATAL", "net.a.Client"), (20, 1, "", "report-builder"), (21, 3, "ERROR", "search-proxy"), (24, 1, "INFO", "b.db"), (25, 1, "WARN", "stock-keeper")]


@pytest.mark.parametrize("block", [1, 2, 3, 8192])
def test_entries_whatever_the_blocks(spark, block):
    rows = [(1, n, raw) for n, raw in enumerate(LOG, 1)] + [(1, 4, LOG[3]), (1, 8, LOG[7]), (2, 1, "text without a time")]
    got = log_entries(_log(spark, rows), block).select("line_no", "n_lines", "log_level", "component").collect()
    assert sorted(map(tuple, got)) == WANT


SAID = {2: "started", 3: "boom\njava.io.IOException: socket closed\n	at a.B.c(B.java:1)\n  last success: 2025-12-30 04:15:29 from cache\n{\"amount\": 373, \"retry\": false}", 13: "level=3 done service=x", 14: "GET /a HTTP/1.1", 16: "ok",
        17: "*251 x", 18: "x", 19: "x", 20: "ERROR in text", 21: "x\n\n", 24: "m", 25: "x"}


@pytest.mark.parametrize("block", [1, 2, 3, 8192])
def test_messages_whatever_the_blocks(spark, block):
    rows = [(1, n, raw) for n, raw in enumerate(LOG, 1)] + [(1, 4, LOG[3]), (1, 8, LOG[7])]
    got = {r["line_no"]: r["message"] for r in log_entries(_log(spark, rows), block).collect()}
    assert {n: got[n] for n in SAID} == SAID and got[8] == "\n".join(LOG[7:12]) and "x" in got[15]


def test_carried_columns_and_undated_entries(spark):
    rows = [(1, 1, "2025-10-26 02:30:00 svc: x"), (1, 2, "2025-13-45 02:30:00 svc: y"), (2, 1, "2025-10-26T02:30:00+99:99 svc: z")]
    files = spark.createDataFrame([(1, "a", "Europe/Berlin", datetime(2026, 1, 1)), (2, "b", "Mars/Phobos", datetime(2026, 1, 1))], FILES)
    got = {(r["file_id"], r["line_no"]): (r["utc_us"], r["message"]) for r in entry_instants(log_entries(_log(spark, rows)), files, carry=("message",), undated=True).collect()}
    assert got[1, 1] == (us(2025, 10, 26, 2, 30, zone=BERLIN), "x") and got[1, 2] == (None, "y")


def test_unknown_zones_are_utc(spark):
    feeds = spark.createDataFrame([(1, "alertmanager", None, "Mars/Phobos"), (2, "alertmanager", None, "+03:00"), (3, "alertmanager", None, None)], FEEDS)
    got = {r["feed_id"]: r["utc_us"] for r in alert_instants(_alerts(spark, [(i, i, 1, 0, _am("a", "2025-08-19 20:00:00")) for i in (1, 2, 3)]), feeds).collect()}
    assert got == {1: us(2025, 8, 19, 20), 2: us(2025, 8, 19, 17), 3: us(2025, 8, 19, 20)}


def test_entries_of_an_empty_table(spark):
    assert log_entries(_log(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 8192])
def test_repeated_hour(spark, block):
    local = ["01:59:00", "02:10:00", "02:50:00", "02:05:00", "02:20:00", "02:21:00", "03:10:00", "02:40:00"]
    rows = [(1, n, f"2025-10-26 {t} svc: x") for n, t in enumerate(local, 1)] + [(2, 1, "2025-10-26 02:30:00 svc: x")]
    files = spark.createDataFrame([(1, "a", "Europe/Berlin", datetime(2026, 1, 1)), (2, "b", "Europe/Berlin", datetime(2026, 1, 1))], FILES)
    got = {(r["file_id"], r["line_no"]): r["utc_us"] for r in entry_instants(log_entries(_log(spark, rows)), files, block).collect()}
    before, want = None, {}
    for n, t in enumerate(local, 1):
        h, i, _ = map(int, t.split(":"))
        early, late = us(2025, 10, 26, h, i, zone=BERLIN), us(2025, 10, 26, h, i, zone=BERLIN, fold=1)
        before = late if before is not None and before - early > 60_000_000 else early
        want[1, n] = before
    want[2, 1] = us(2025, 10, 26, 2, 30, zone=BERLIN)
    assert got == want


FEEDS = "feed_id bigint, shape string, stand string, tz_name string"
ALERTS = "delivery_id bigint, feed_id bigint, file_no int, received_at timestamp_ntz, payload string, shape string, key bigint"


def _alerts(spark, rows):
    return spark.createDataFrame([(d, f, n, datetime(2026, 1, 1) + timedelta(seconds=s), p if p is None or isinstance(p, str) else json.dumps(p), "x", 1) for d, f, n, s, p in rows], ALERTS)


def _am(fp, at):
    return {"alerts": [{"fingerprint": fp, "startsAt": at}]}


def _sentry(e, t=1756318165.14):
    return {"data": {"event": {"event_id": e, "timestamp": t}}}


def test_exactly_once(spark):
    feeds = spark.createDataFrame([(1, "alertmanager", None, "Europe/Berlin"), (2, "sentry", None, "UTC"), (3, "alertmanager", None, "UTC"), (4, "no_fields", None, "UTC")], FEEDS)
    rows = [(1, 1, 1, 5, _am("ab12", "2025-08-30T10:00:00Z")), (2, 3, 2, 4, _am("AB-12", "2025-08-30T12:00:00+02:00")), (3, 1, 1, 4, _am("ab12", "2025-08-30 12:00:00")), (4, 1, 1, 9, _am("ab12", "2025-08-30T10:00:01Z")),
            (5, 1, 1, 9, _am("zz", "2025-08-30T10:00:00Z")), (6, 1, 1, 9, _am("zz", "2025-08-30T10:00:00Z")), (7, 1, 1, 9, _am("", "2025-08-30T10:00:00Z")), (8, 1, 1, 9, _am("ab12", "n/a")), (9, 1, 1, 9, _am("ab12", "n/a")),
            (10, 2, 1, 1, _sentry("0F-aa")), (11, 2, 1, 1, _sentry("0faa", None)), (12, 2, 1, 0, _sentry("0faA")), (13, 2, 1, 0, None), (14, 2, 1, 0, "{broken"), (15, 9, 1, 0, _sentry("0faa")), (16, 4, 1, 0, _am("ab12", "2025-08-30T10:00:00Z"))]
    kept, surplus = exactly_once(_alerts(spark, rows), feeds)
    assert sorted(r["delivery_id"] for r in surplus.collect()) == [1, 3, 10, 11]
    assert sorted(r["delivery_id"] for r in kept.collect()) == [2, 4, 5, 6, 7, 8, 9, 12, 13, 14, 15, 16]
    assert exactly_once(_alerts(spark, []), feeds)[1].count() == 0
    # a second run: copies of what is stored are surplus even if received earlier, a message of several alerts is kept
    more = [(20, 1, 1, -9, _am("ab12", "2025-08-30T10:00:01Z")), (21, 2, 1, 9, _sentry("0f-ab")), (22, 2, 1, 8, _sentry("0fab")), (23, 2, 1, 8, _sentry("0faa")), (24, 1, 1, 8, {"alerts": [{"fingerprint": "ab12", "startsAt": "2025-08-30T10:00:00Z"}] * 2})]
    again, dropped = exactly_once(_alerts(spark, more), feeds, stored=kept)
    assert sorted(r["delivery_id"] for r in dropped.collect()) == [20, 21, 23] and sorted(r["delivery_id"] for r in again.collect()) == [22, 24]
    assert exactly_once(_alerts(spark, []), feeds, stored=kept)[0].count() == 0


def test_hot_identifier(spark):
    m = spark.range(3000).select((F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 900)).alias("k"), F.col("id"))
    kept, surplus = split_by_frequency(m, ["k"], ["id"])
    first = defaultdict(lambda: 1 << 60)
    for r in m.collect():
        first[r["k"]] = min(first[r["k"]], r["id"])
    assert sorted(r["id"] for r in kept.collect()) == sorted(first.values()) and surplus.count() == 3000 - len(first)


def test_sieve_that_is_full_loses_nothing(spark, monkeypatch):
    from faultline.operators import exactly_once as module

    monkeypatch.setattr(module, "SIEVE_BITS", 8)
    test_hot_identifier(spark)


def test_intermediate_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from faultline.session import checkpoint_dir

    off = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="yarn", getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: off)))
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_ids(spark):
    df = spark.createDataFrame([("AB-12",), ("xyz",), ("",), (None,), (" 0f ",)], "t string")
    assert [r[0] for r in df.select(canonical_id(F.col("t"))).collect()] == ["ab12", None, None, None, "0f"]


def test_alert_times_keep_every_row(spark):
    feeds = spark.createDataFrame([(1, "alertmanager", None, "Asia/Kolkata")], FEEDS)
    got = alert_instants(_alerts(spark, [(1, 1, 1, 0, _am("a", "2025-08-19 20:08:07,059")), (2, None, 1, 0, None)]), feeds).collect()
    assert {r["delivery_id"]: r["utc_us"] for r in got} == {1: us(2025, 8, 19, 14, 38, 7, 59000), 2: None}


def test_leaves():
    assert leaves('{"a": {"b": [1, 1.0, true, null, ["x"]]}, "c": {}}') == [("a.b[]", "number", "1"), ("a.b[]", "number", "1"), ("a.b[]", "boolean", "true"), ("a.b[]", None, None), ("a.b[][]", "string", "x")]
    assert leaves(None) == leaves("") == leaves("{oops") == leaves("3") == []


def test_schema_changes(spark):
    f = {1: [{"a": 1, "b": "x", "n": None, "s": "q"}, {"a": 2}], 2: [{"a": "1", "c": "x", "n": 4, "t": 1}], 3: [{"a": "1", "c": "x", "n": "4", "t": 1}], 5: [{"z": 1}]}
    rows = [(i, 1, no, 0, p) for no, ps in f.items() for i, p in enumerate(ps)] + [(90, 1, 2, 0, None), (91, None, 1, 0, {"a": 1})]
    assert sorted(map(tuple, schema_changes(_alerts(spark, rows)).collect())) == sorted([
        (1, 2, "retyped", "a", "a"), (1, 2, "renamed", "b", "c"), (1, 2, "removed", "s", ""), (1, 2, "added", "", "t"), (1, 3, "retyped", "n", "n")])
    assert schema_changes(_alerts(spark, [])).count() == 0


def test_whole_table_has_every_path_and_value(spark):
    rows = [(1, 1, 1, 0, {"alerts": [{"fingerprint": "f1", "labels": {"svcX": "pay", "replicas": 3}}, {"fingerprint": "f2", "labels": {"svcX": "gw", "replicas": "many"}}], "A": 1}),
            (2, 1, 2, 0, {"alerts": [{"fingerprint": "f3", "labels": {"neverListed": "pay", "replicas": 4}}], "a": 1.5, "on": True}), (3, 1, 3, 0, {"n": None, "on": "maybe", "id": 12345678901234567890}), (4, None, None, 0, {"lost": ["x", "y"]}), (5, 1, 3, 0, None)]
    alerts = _alerts(spark, rows)
    cols = table_columns(alerts)
    assert sorted(p for c in cols for p in c.paths) == sorted({p for *_, x in rows for p, _, _ in leaves(json.dumps(x))})
    by = {p: c for c in cols for p in c.paths}
    assert by["alerts[].labels.svcX"] is by["alerts[].labels.neverListed"] and {by[p].type for p in ("alerts[].labels.replicas", "A")} == {"bigint"} and by["on"].type == by["id"].type == "string" and by["a"].type == "double"
    t = whole_table(alerts, cols)
    got = {r["delivery_id"]: r for r in t.collect()}
    assert len(got) == 5
    for d, *_, x in rows:
        want = defaultdict(list)
        for path, _, v in leaves(json.dumps(x)):
            want[by[path].name].append(v)
        for c in cols:
            v = got[d][c.name]
            assert (v is None) == (c.name not in want)
            assert [None if y is None else str(y) for y in v or []] == [None if y == "many" else y for y in want[c.name]]
    assert [tuple(r) for r in cast_report(t).collect()] == [(1, 1, "alerts_labels_replicas", 1)]
    assert whole_table(_alerts(spark, [])).count() == 0
