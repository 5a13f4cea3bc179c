"""Operators of the llm subpackage."""

import base64
import itertools
import random
from http import HTTPStatus
from pathlib import Path

import pyarrow as pa
import pytest
import regex as re
from pyspark.sql import functions as F

from faultline.llm import bpe_automaton, packing, pii, pii_train, residue, tokens
from faultline.llm.queries import QUERIES, place

import held_residue

VOCAB = tokens.vocabulary_path("byte_bpe_50k")
needs_vocab = pytest.mark.skipif(not Path(VOCAB).exists(), reason="no vocabulary files")
DOCS = "doc_id bigint, text string, ids int, window int"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)], DOCS)


def test_automaton_equals_merging():
    """On a small vocabulary the automaton gives what merging gives, for every word up to seven letters."""
    merges = [(b"a", b"b"), (b"b", b"a"), (b"a", b"a"), (b"ab", b"a"), (b"aa", b"aa"), (b"b", b"b"), (b"ba", b"b")]
    vocab = {b"a": 0, b"b": 1, **{u + v: i for i, (u, v) in enumerate(merges, 2)}}
    auto = bpe_automaton.BpeAutomaton(vocab, merges)

    def merge(word):
        parts = [bytes([c]) for c in word]
        for u, v in merges:
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == u and parts[i + 1] == v:
                    out.append(u + v)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(vocab[p] for p in parts)

    for n in range(1, 8):
        for w in itertools.product(b"ab", repeat=n):
            assert auto.encode_word(bytes(w)) == merge(bytes(w)), bytes(w)


def test_bytes_without_a_token_are_an_error():
    auto = bpe_automaton.BpeAutomaton({b"a": 0, b"b": 1, b"ab": 2}, [(b"a", b"b")])
    assert auto.encode_word(b"") == () and auto.encode_word(b"abb") == (2, 1)
    for word in (b"a~b", b"~", b"ab~"):
        with pytest.raises(ValueError):
            auto.encode_word(word)


@needs_vocab
def test_ids_equal_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB.replace(".json", ".tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=bpe_automaton.PRE_SPLIT, mergeable_ranks=ranks, special_tokens={})
    a, r = bpe_automaton.load(VOCAB), random.Random(3)
    pieces = ["a", "e", " ", "th", "in", "uu", "aa", "\n", "é", "ж", "中", "=", "-", "0", "  ", "\t", "er", "'s", "_", "😀", "<|endoftext|>"]
    for text in ["", "a" * 3000, "=" * 2000, " " * 999, "<|endoftext|>", *("".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(1500))]:
        ids = a.encode(text)
        assert ids == t.encode_ordinary(text) and a.count(text) == len(ids) and a.decode(ids) == text


@needs_vocab
def test_encode_rows(spark):
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(_docs(spark, [None, "", "hello world", "hello world", "x" * 20000])).collect()}
    assert got[0] == [] and got[1] == [] and got[2] == got[3] and len(got[2]) == 2 and len(got[4]) > 100
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(tokens.encode_texts(_docs(spark, [None, "Straße → 漢字\r\n"]))).collect()}
    assert back == {0: "", 1: "Straße → 漢字\r\n"}
    assert tokens.encode_texts(_docs(spark, [])).count() == 0


def test_one_container_is_filled_best():
    r = random.Random(5)
    for _ in range(300):
        cap = r.randint(5, 30)
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        took = packing.fill_one(counts, sorted(counts, reverse=True), cap)
        first, rest = max(items), sorted(items)
        rest.remove(first)
        best = max(first + sum(s) for n in range(len(rest) + 1) for s in itertools.combinations(rest, n) if first + sum(s) <= cap)
        assert sum(x * n for x, n in took) == best and all(n <= counts[x] for x, n in took)


@pytest.mark.parametrize("window", [3, 10, 6000])
def test_packing_places_everything_once(spark, window):
    r = random.Random(1)
    sizes = [(i, n) for i, n in enumerate([0, None, 1, 10, 11, 25, 30, *(r.randint(1, 12) for _ in range(60))])]
    df, specs = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), spark.createDataFrame([(1, 10), (2, 25)], "spec_id int, capacity int")
    rows = packing.pack(df, specs, window).collect()
    for spec, cap in ((1, 10), (2, 25)):
        got, fill = {}, {}
        for x in (x for x in rows if x["spec_id"] == spec):
            got.setdefault(x["doc_id"], []).append((x["token_start"], x["n_tokens"]))
            fill[x["container_id"]] = fill.get(x["container_id"], 0) + x["n_tokens"]
        assert max(fill.values()) <= cap
        for i, n in sizes:
            parts = sorted(got[i])
            assert sum(k for _, k in parts) == (n or 0) and [a for a, _ in parts] == [sum(k for _, k in parts[:j]) for j in range(len(parts))]
            assert len(parts) == max(1, -(-(n or 0) // cap))
    assert packing.pack(df.limit(0), specs).count() == 0


def test_specifications(spark):
    schema = "spec_id int, tokenizer string, capacity int"
    docs = _docs(spark, ["a b c", None, "d"])
    assert place(docs, spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, None, 10)], [(i, f"t{i}", 10) for i in range(101)]):
        with pytest.raises(ValueError):
            place(docs, spark.createDataFrame(rows, schema))


@needs_vocab
def test_containers_are_full(spark):
    """At sf0.1, at most one container in 200 more than the tokens need at least."""
    for r in QUERIES["p7_report"](spark, "/root/testdata/sf0.1").collect():
        assert r["containers"] <= r["fewest"] * 1.005 + 1, r


RESIDUE = {
    "page": ["404 Not Found\n\ngateway/1.2.3", "ops wiki\nYou need to enable JavaScript to run this app.", "<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center></body></html>",
             '{"error": "Service Unavailable", "code": 503, "request": "63deb8ef"}', "Сессия истекла. Войдите снова.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an."],
    "filler": ["# billing\n\nLorem ipsum dolor sit amet, consectetur elit.\n\nReal words about a queue here.", "The queue was full for hours.\n\nText to follow.", "test test test test", "Описание появится позже."],
    "placeholder": ["owner: {{ owner }}\nThe queue was full.", "The pool was small. __OWNER__", "| <insert owner here> | - |", "[TBD: root cause] was found in the pool", "Ursache: [hier Ursache einfügen]", "%LINK_TO_DASHBOARD%\n1. Check the pool"],
    None: [None, "", "  \n", "The script left `${STAND}` unexpanded in the unit file of billing.", "The proxy answered \"502 Bad Gateway\" although billing was alive and the pool was empty.", "Template ReadTimeoutError: waited <n> ms for <uuid> grew.",
           "```\n{{ owner }}\nlorem ipsum dolor\n```\nThe chart was rendered empty.", "Session expired messages rose to 738 per minute after the clock jumped on one host.", "2026 ERROR [billing] pool <|endoftext|> exhausted, queue at limit", "Users saw «Доступ запрещён» after the release of billing and called support."],
}


def test_residue_of_unseen_wording(spark):
    """Texts in no exemplar and no table: at least nine in ten are found, and content that talks about such things stays."""
    index = residue.build_index(*residue.document_frequencies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    label = lambda ts: [residue.residue_label(t, index) is not None for t in ts]
    for texts in (held_residue.PAGES, held_residue.FILLER, held_residue.MARKS):
        assert sum(label(texts)) >= 0.9 * len(texts), [t for t, hit in zip(texts, label(texts)) if not hit]
    assert sum(label(held_residue.CONTENT)) <= 1


def test_exemplars_are_not_in_the_tables(spark):
    """No exemplar of three words or more is found for standing in the tables itself; status phrases and printers' dummy text are common property."""
    common = {s.phrase for s in HTTPStatus} | {x for x in residue.X.FILLER if residue.stems(x.lower())[:1] in (["lorem"], ["ut"], ["duis"], ["except"])}
    texts = " ".join(r[0].lower() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect())
    same = [t for label, t in residue.EXEMPLARS if label in ("page", "filler") and t not in common and len(t.split()) >= 6 and t.lower() in texts]
    assert not same


def test_residue_labels(spark):
    index = residue.build_index({"the": 900, "of": 700, "is": 400, "servic": 300, "error": 300}, 1000)
    for label, texts in RESIDUE.items():
        for t in texts:
            assert residue.residue_label(t, index) == label, t
    texts = [t for ts in RESIDUE.values() for t in ts]
    got = [r["residue"] for r in residue.with_residue(_docs(spark, texts)).orderBy("doc_id").collect()]
    assert [bool(x) for x in got] == [bool(k) for k, ts in RESIDUE.items() for _ in ts]
    assert residue.with_residue(_docs(spark, [])).count() == 0


def test_pii_held_out_accuracy():
    for kind, (precision, recall) in pii_train.evaluate(pii.weights(), seed=123, n=400).items():
        assert min(precision, recall) > 0.9, (kind, precision, recall)


def test_marginals_agree_with_enumeration():
    cands = [(0, 2, "a", []), (1, 3, "b", []), (2, 4, "a", []), (5, 6, "b", [])]
    scores = [0.3, -0.2, 0.9, 0.1]
    total, each = 0.0, [0.0] * 4
    for on in itertools.product([0, 1], repeat=4):
        spans = sorted((cands[i][0], cands[i][1]) for i in range(4) if on[i])
        if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
            w = 2.718281828459045 ** sum(s for s, o in zip(scores, on) if o)
            total += w
            each = [e + w * o for e, o in zip(each, on)]
    assert pii_train.marginals(cands, scores) == pytest.approx([e / total for e in each])


PII = [
    ("Customer Yorick D. Dunwick (yorick.dunwick@corp.example) cannot log in.", ["name", "email"]), ("Рейс: +7 (926) 000-70-87", ["phone"]), ("SMS to 808.555.0152 not accepted by provider.", ["phone"]), ("KYC mismatch, SSN: 927012406, holder Jory Ormwick", ["person_id", "name"]),
    ("Parcel rerouted from 173 Kiln Lane, Ostermouth to 24B Ferry Ave.", ["address", "address"]), ("Сообщил г-н КРЕМНОВ САВЕЛИЙ, живёт: ул. Луговая, д. 144, кв. 2", ["name", "address"]), ("Lieferung an Ziegelplatz 136, Moorhausen abgelehnt.", ["address"]),
    ("mail to qtarn(at)mail(dot)example bounced", ["email"]), ("Payment Gateway and Velora Cache restarted.", []), ("Order-2026-7712756 moved to state HELD.", []), ("198.51.100.132 - - [13/Oct/2025:20:30:14 +0300] \"GET / HTTP/1.1\" 200 1", []), ("Fetch git@mirror-29:tools/route failed.", []), ("", []), (None, []),
]


def test_pii_examples(spark):
    lex = pii.Lexicon({"Yorick", "Jory"}, {"Dunwick", "Ormwick", "Кремнов"})
    for text, kinds in PII:
        assert [k for *_, k in pii.find(text, lex)] == kinds, text
    df = spark.createDataFrame([("raw", i, t) for i, (t, _) in enumerate(PII)], "field_name string, rec_id bigint, text string")
    got = sorted((r["rec_id"], r["kind"], r["occ_no"]) for r in pii.occurrences(df, lex).collect())
    assert got == sorted((i, k, ks[:n + 1].count(k)) for i, (_, ks) in enumerate(PII) for n, k in enumerate(ks))
    out = {r["rec_id"]: r["text"] for r in pii.masked(df, lex).collect()}
    assert out[6] == "Lieferung an <address> abgelehnt." and out[12] == "" and out[13] is None and out[8] == PII[8][0]


def test_bounds_are_chosen_among_cuts():
    lex = pii.Lexicon()
    spans = lambda t: [t[a:b] for a, b, _ in pii.find(t, lex)]
    assert spans("Boat owner (8 924 465 7831) waits") == ["8 924 465 7831"]
    assert spans("write to ann.low@inbox.invalid. Gestern war nichts") == ["ann.low@inbox.invalid"]
    long = "a" * 400 + "@mail.example"
    assert not any(b - a > pii.LONGEST for a, b, _ in pii.find(long, lex))


def test_training_texts_are_not_in_the_tables(spark):
    """No carrier or decoy stands in the tables with all its literal parts of six letters or more."""
    raw = spark.read.parquet("/root/testdata/sf0.01/log_lines.parquet").select("raw").where("raw is not null").distinct()
    kb = spark.read.parquet("/root/testdata/sf0.01/kb_incidents.parquet").select(F.explode(F.array("symptoms", "root_cause")).alias("raw")).where("raw is not null")
    texts = [r[0].lower() for r in raw.union(kb).collect()]
    lifted = []
    for c in [x for v in pii_train.CARRIERS.values() for x in v] + pii_train.DECOYS:
        parts = [p.lower() for p in re.split(r"\{\w+\}", c) if len(re.findall(r"\p{L}", p)) >= 6]
        if parts and any(all(p in t for p in parts) for t in texts):
            lifted.append(c)
    assert not lifted


def test_tests_in_the_jvm_lose_nothing(spark):
    r = random.Random(11)
    texts = [pii_train.compose(r)[0] for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, text string")
    left_out = {x["i"] for x in df.where(~F.coalesce(pii.may_hold(), F.lit(False))).collect()}
    assert left_out and not [texts[i] for i in left_out if pii.find(texts[i], pii.Lexicon())]


def test_tests_in_the_jvm_are_wider_than_the_candidates(spark):
    r = random.Random(5)
    texts = ["Tax ID: 123456789", "NAME AT MAIL DOT EXAMPLE", "name (At) mail.example", "name[At]mail.example", "name{AT}mail.example", "call 1-808-555-0152 now", "ref 07911123456", "seen 4510 № 123456", "4510 №123456", "Pass 123456789",
             "INFO-DESK KILN", "see /J. Kiln", "a.J. Kiln", "id٣٤٥ ٠١٢٣٤٥٦٧", "2025-08-10 01:14:54 INFO up", "10.0.0.9 - - x", "plain", "a@b", "x @ y.example"]
    for t in [pii_train.compose(r)[0] for _ in range(1000)]:
        texts += [t, t.upper(), t.lower(), t.swapcase(), t.replace(" ", "\u00a0"), t.replace("-", " "), t.replace(" ", "-"), t.replace(".", " ")]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    left_out = {x["i"] for x in df.where(~F.coalesce(pii.may_hold(), F.lit(False))).collect()}
    assert not [texts[i] for i in left_out if pii.candidates(texts[i].translate(pii._EVEN), pii.Lexicon())]
    assert {texts.index(t) for t in ("2025-08-10 01:14:54 INFO up", "10.0.0.9 - - x", "plain")} <= left_out


def test_patterns_are_tried_only_where_their_signs_stand():
    r = random.Random(8)
    texts = ["2025-08-10 01:14:54 INFO up", "2025-08-10 01 14 555 0152", "<134>1 2026-01-27T18:51:45Z up", "Ново- улица 5", "ſocial ſecurity 123456789", "Kiln‑Moor 5", "J.K. Kiln", "KILN, J.", "x %40 y", "a DOT b AT c dot d", "𝟏𝟐𝟑𝟒𝟓𝟔𝟕", ""]
    for t in [pii_train.compose(r)[0] for _ in range(400)]:
        texts += [t, t.upper(), t.lower(), t.swapcase(), t.replace(" ", "\u00a0"), t.replace("-", " "), t.replace(" ", "-"), t.replace(".", " "), "".join(r.choice("0189 -()/.+:T,[") for _ in range(30))]
    bits = pii.signs(pa.array([*texts, None])).tolist()
    lex = pii.Lexicon({"Yorick"}, {"Dunwick"})
    for t, may in zip(texts, bits):
        plain = pii._plain(t)
        assert pii.candidates(plain, lex, may) == pii.candidates(plain, lex), t
        assert pii.find(t, lex, may) == pii.best_segments(plain, lex, pii.weights()), t
    assert bits[0] == bits[-1] == 0 and len(set(bits)) > 20


def test_hopeless_numbers_are_left_out():
    for t in ("1736064714 up", "level=info ts=1735865692.488 up", "<134>1 2026-01-27T18:51:45Z up"):
        all_of, scored = (pii.candidates(t, pii.Lexicon(), pii.PHONE, b) for b in (None, pii.NumberBounds(pii.weights())))
        assert all_of and len(scored) < len(all_of) and all(pii.score(*x[2:], pii.weights()) <= 0 for x in all_of if x not in scored), t
    w = {"phone": -1.0, "phone prev=call": 1.5}
    assert [len(pii.candidates(t, pii.Lexicon(), bounds=pii.NumberBounds(w))) for t in ("call 1736064714", "pay 1736064714")] == [1, 1]
    assert not pii.candidates("call 1736064714", pii.Lexicon(), bounds=pii.NumberBounds(w | {"phone bare=True": -0.6}))


def test_texts_are_tested_once_beside_the_patterns(spark):
    """No pattern runs in the JVM, and batches put together lose no row and keep their order."""
    df = spark.createDataFrame([("raw", i, "SMS to 808.555.0152 sent" if i % 3 == 0 else None if i % 3 == 1 else "up") for i in range(700)], "field_name string, rec_id bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found, out = pii.occurrences(df, pii.Lexicon()), pii.masked(df, pii.Lexicon())
        for x in (found, out):
            plan = x._jdf.queryExecution().optimizedPlan().toString()
            assert "RLIKE" not in plan and "regexp" not in plan
        assert [r["rec_id"] for r in found.collect()] == list(range(0, 700, 3))
        assert [(r["rec_id"], r["text"]) for r in out.collect()] == [(i, ("SMS to <phone> sent", None, "up")[i % 3]) for i in range(700)]
        assert pii.occurrences(df.limit(0), pii.Lexicon()).count() == pii.masked(df.limit(0), pii.Lexicon()).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    b = pa.record_batch([pa.array(range(10))], names=["n"])
    assert [x.num_rows for x in pii._larger(iter([b, b, b, b]), rows=25)] == [20, 20] and [x.num_rows for x in pii._larger(iter([b, b]), size=100)] == [10, 10]
    assert not list(pii._larger(iter([])))


def test_queries_are_named_by_problem():
    assert {n.split("_")[0] for n in QUERIES} == {"p2", "p6", "p7", "p8"}
