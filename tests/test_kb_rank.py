"""Queries ranked in blocks: scores equal single searches to the last digit, and pairs of a query and an entry stay where they are scored."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.operators import kb_rank, kb_search

ENTRY = "id string, kind string, title string, stands array<string>, services array<string>, tags array<string>, signatures array<string>, status string, outcome string, sections map<string,string>"
QUERY = "query_id bigint, text string, signatures array<string>"


def odd_entries():
    words = ["pool", "timeout", "вернули", "orders api", "", None, "Stale lease", "12 w7"]
    signs = [None, [], [None], ["", "PoolError"], ["tmpl:PoolError after <n> ms", "poolerror"], ["Error"], ["after 5 ms pool", "tmpl:ms after <x>", "LeaseError after <n> ms"], ["pool lease timeout gate", "pool lease"]]
    for i, ((a, b), s) in enumerate(itertools.product(itertools.product(words, words), signs)):
        title = None if a is None else f"{a} {b or ''}"
        yield (f"E{i * 7919 % 1000:04}-{i}", [None, "incident", " Incident ", "source"][i % 4 if i % 11 == 0 else i % 3], title, [None, ["stage", None], []][i % 3], [b], [a, "pool"] if i % 5 else None, s,
               ["Resolved", "wontfix", None][i % 3 if i % 4 else 2], ["refuted", " Refuted", "confirmed", None, "?"][i % 5], {"Симптомы": f"{b} lease", "Решение": a, "Заметки": "gate timeouts"} if i % 7 else None)


def asked():
    signs = [None, [], ["PoolError", None, "poolerror"], ["after <n> ms"], ["pool lease gate", "LeaseError", "PoolError", "Error", "tmpl:ms after <x>", "x"]]
    texts = [None, "", "pool timeout", "Timeout of the pool", "вернул stale lease w7 orders gate api"]
    return [(i, t, s) for i, (t, s) in enumerate(itertools.product(texts, signs))] + [(100, "pool timeout timeout", ["poolerror", "PoolError"])]


def test_scores_are_those_of_single_searches(spark, monkeypatch):
    monkeypatch.setattr(kb_search, "QUERY_BLOCK", 9)  # three blocks
    e = spark.createDataFrame(list(odd_entries()), ENTRY).repartition(3).persist()
    got = {}
    for r in kb_search.search_all(spark.createDataFrame(asked(), QUERY), e).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["title"], r["outcome"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {i: [tuple(r) for r in kb_search.search(e, t or "", s or None).collect()] for i, t, s in asked()}
    e.unpersist()
    assert got == {i: x for i, x in want.items() if x} and len(got) > 20


def test_pairs_are_not_shuffled(spark):
    """1,500 queries and entries that all share a word are 2.25 million pairs; what is moved are the queries and ten rows of each in each task."""
    kb = spark.range(0, 1500, 1, 2).select(F.concat(F.lit("E"), "id").alias("id"), F.lit("incident").alias("kind"), F.concat(F.lit("timeout w"), F.col("id") + 1000).alias("title"), *[F.array().cast("array<string>").alias(c) for c in ("stands", "services", "tags")],
                                           F.array(F.concat(F.lit("x"), F.col("id") % 50)).alias("signatures"), F.lit("open").alias("status"), F.lit("confirmed").alias("outcome"), F.lit(None).cast("map<string,string>").alias("sections"), F.col("id").alias("query_id"))

    def moved():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = sc._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = moved()
    rows = kb_search.search_all(kb.select("query_id", F.col("title").alias("text"), "signatures"), kb).collect()
    assert len(rows) == 15_000 and all(r["id"] == f"E{r['query_id']}" for r in rows if r["rank"] == 1)
    assert 0 < sum(n for k, n in moved().items() if k not in before) < 50_000


@pytest.mark.parametrize("rows", [1, 7, 64])
def test_blocks_of_entries_give_what_all_at_once_give(monkeypatch, rows):
    rng = np.random.default_rng(5)
    pick = lambda most, of: [f"w{x}" for x in rng.integers(0, of, rng.integers(0, most + 1))]
    n = 300
    s = [list(dict.fromkeys(pick(3, 5))) for _ in range(n)]
    entries = pa.RecordBatch.from_pydict({"id": [f"i{x:03}" for x in rng.permutation(n)], "title": ["t"] * n, "outcome": [("refuted", "confirmed")[x] for x in (rng.random(n) < 0.1).astype(int)], "factor": rng.choice([0.8, 1.0, 1.15], n),
                                          "t": pa.array([[pick(3, 6), pick(4, 6)] for _ in range(n)], pa.list_(pa.list_(pa.string()))), "s": pa.array(s, pa.list_(pa.string())), "st": pa.array([[[x] for x in y] for y in s], pa.list_(pa.list_(pa.string())))})
    q = [sorted(set(pick(4, 6))) for _ in range(40)]
    qs = [sorted(pick(6, 5)) for _ in range(40)]
    block = pa.table({"gid": [str(x) for x in range(40)], "q": pa.array(q, pa.list_(pa.string())), "s": pa.array(qs, pa.list_(pa.string())), "st": pa.array([[[x] for x in y] for y in qs], pa.list_(pa.list_(pa.string())))})

    def ranked():
        by = {}
        for b in kb_rank.Queries(block, [6.0, 2.5], 14.0).best(iter([entries.slice(0, 100), entries.slice(100, 0), entries.slice(100)]), 10, 1.0):
            for r in b.to_pylist():
                by.setdefault(r["gid"], []).append((r["outcome"] == "refuted", -r["score"], r["id"]))
        return {g: sorted(x)[:10] for g, x in by.items()}

    want = ranked()
    monkeypatch.setattr(kb_rank, "ROWS", rows)
    monkeypatch.setattr(kb_rank, "KEPT", 3)
    assert ranked() == want and len(want) > 30


def test_rounding_is_that_of_spark(spark):
    x = [k * 0.5 / n * f for n in range(1, 9) for k in range(0, 120, 7) for f in (0.8, 1.0, 1.15)] + [1.005, 2.675, 0.125, 18.055, 43.355]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 2)).collect()]
    assert kb_rank.rounded(np.array(x)).tolist() == want
