"""Documents that are residue: template placeholders, filler, error pages, script notices.

Labelled exemplars are held in an inverted index from term to exemplars. A document is cut into passage windows: bracketed
marks, lines (entries), neighbouring lines together, and the whole text. Each window retrieves the exemplars that share a term with it and is scored by
TF-IDF containment, the weight of the terms shared with them against the weight of all the window's terms. Terms are word stems, so that other forms of a word
meet; a mark also has its brackets and the way it is written as terms. Term weights come from document frequencies over the whole corpus; only terms of the exemplars have
an entry, so what is sent to the workers is bounded by the exemplar list. Quoted text and code never count as content of the document itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm import residue_exemplars as X

#: Share of a window's weight that exemplars must cover: whole texts, passages, marks; and share of its own words that an asking exemplar must find in a mark.
WHOLE, PASSAGE, MARK, ASK = 0.6, 0.66, 0.35, 0.99
#: Share of its own weight from which an exemplar counts as matched in part, by label.
LEAST = {"page": 0.1, "filler": 0.12, "navigation": 0.0, "mark": 0.3, "ask": 0.0}
#: Letters of a word that make its stem.
STEM = 6
#: Lines that a passage window spans at most.
WINDOW_LINES = 3

_WORD = re.compile(r"(?<![a-z0-9][-_/.])(?<![\d_])[^\W\d_]++(?:['’][^\W\d_]++)*+(?![_\d])(?![-/.][a-z0-9])")
_NAME = re.compile(r"[^\W\d_]+")
_CONTROL = regex.compile(r"[​-‏­﻿⁠\p{Cc}--[\n\t\r]]", regex.V1)
_ODD_END = re.compile("\r\n?|[  \x85]")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_QUOTED = regex.compile(r"``[^`]+``|`[^`\n]*`|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|\"[^\"\n]*\"|‘[^’\n]*’|(?<![\p{L}\d])'[^'\n]{2,}?'(?![\p{L}\d])")
_QUOTE_SIGNS = re.compile("[`«“„\"‘']")
#: Brackets of marks: opening, closing, pattern of the whole.
_BRACKETS = [
    ("{{", "}}", r"\{\{[^{}\n]{0,80}\}\}"), ("{%", "%}", r"\{%[^{}\n]{0,80}%\}"), ("${", "}", r"\$\{[^{}\n]{1,80}\}"),
    ("<<", ">>", r"<<[^<>\n]{1,80}>>"), ("[[", "]]", r"\[\[[^\[\]\n]{1,80}\]\]"), ("@@", "@@", r"@@[^@\s]{1,80}@@"),
    ("__", "__", r"(?<![\w])__\p{L}[\p{L}\d_]*__(?![\w])"), ("%", "%", r"(?<![\w%])%\p{Lu}[\p{Lu}\d_ ]*%(?![\w%])"),
    ("[", "]", r"(?<![\[\w])\[[^\[\]\n]{2,80}\](?![\](])"), ("<", ">", r"(?<!<)<[^<>\n|/!][^<>\n|]{1,80}>(?!>)"),
]
_MARK = regex.compile("|".join(f"({p})" for *_, p in _BRACKETS))
_MARK_SIGNS = re.compile(r"[{\[<%]|@@|__")
_SINGLE = {"[", "<"}
_ENTRY = re.compile(r"(?:\s*(?:[-*+•>]|\d+[.)])\s+|\s*#{1,6}\s+|\s*\d{1,2}:\d{2}(?::\d{2})?\s+)*(?:[^\W\d_][^\W\d_ ]{0,24}(?: [^\W\d_ ]{1,24}){0,2}:\s+)?")
_HEADER = re.compile(r"\A---\n.*?\n---\n", re.S)


#: Signs between words, for counting documents in the JVM.
_APART = "\n\r\t.,;:!?()[]{}<>\"«»“”„=|/"


def _plain(text: str) -> str:
    # the reason phrase of status 504 is written in two ways
    return text.lower().replace("ё", "е").replace("time-out", "timeout")


def stems(plain: str) -> list[str]:
    """Stems of the words of a text in lower case, in order; identifiers, codes and numbers are none."""
    return [w[:STEM] for w in _WORD.findall(plain)]


def mark_terms(text: str) -> list[str]:
    """Terms of a mark: its brackets, the way it is written and the stems of its words. Empty for other text."""
    m = _MARK.fullmatch(text)
    if not m:
        return []
    opening, closing, _ = _BRACKETS[m.lastindex - 1]
    inner = text[len(opening):len(text) - len(closing)]
    written = "upper" if inner.isupper() else "lower" if inner.islower() else "mixed"
    return [f"open {opening}", f"close {closing}", f"written {written}", *[w[:STEM] for w in _NAME.findall(_plain(inner))]]


@dataclass
class Index:
    """Inverted index of the exemplars with term weights."""

    weight: dict[str, float]
    unknown: float
    postings: dict[str, dict[str, list[int]]] = field(default_factory=dict)  # label -> term -> exemplars
    norm: dict[int, float] = field(default_factory=dict)

    def retrieve(self, terms, label: str) -> dict[int, list[str]]:
        """Exemplars with `label` that share a term, each with the terms shared."""
        hits: dict[int, list[str]] = defaultdict(list)
        of = self.postings[label]
        for t in terms:
            for e in of.get(t, ()):
                hits[e].append(t)
        return hits

    def covered(self, terms: Counter, label: str, enough: float) -> bool:
        """Whether terms that retrieved exemplars hold make up the share `enough` of the window's TF-IDF weight. An exemplar counts from a share of its
        own weight on (LEAST), so that common words alone do not add up from many exemplars. Most windows fail on the first sum already."""
        of, weight, unknown = self.postings[label], self.weight, self.unknown
        total, known = 0.0, {}
        for t, n in terms.items():
            x = weight.get(t, unknown) if n == 1 else (1 + math.log(n)) * weight.get(t, unknown)
            total += x
            if t in of:
                known[t] = x
        if not total or sum(known.values()) < enough * total:
            return False
        shared: set[str] = set()
        for e, ts in self.retrieve(known, label).items():
            if sum(weight[t] for t in ts) >= LEAST[label] * self.norm[e]:
                shared.update(ts)
        return sum(known[t] for t in shared) >= enough * total

    def holds(self, terms: set[str], label: str) -> float:
        """Largest share of an exemplar's own weight that the window holds."""
        return max((sum(self.weight[t] for t in ts) / self.norm[e] for e, ts in self.retrieve(terms, label).items()), default=0.0)


EXEMPLARS = [(label, text) for label, texts in (("page", X.ERROR_PAGE + X.ACCESS_OR_OUTAGE + X.SCRIPT_NOTICE), ("navigation", X.NAVIGATION),
                                                ("filler", X.FILLER), ("mark", X.MARK), ("ask", X.ASK)) for text in texts]


def exemplar_terms(label: str, text: str) -> list[str]:
    return mark_terms(text) if label == "mark" else stems(_plain(text))


VOCABULARY = sorted({t for label, text in EXEMPLARS for t in exemplar_terms(label, text)})


def build_index(frequency: dict[str, int], n: int, exemplars: list[tuple[str, str]] | None = None) -> Index:
    """Index over `exemplars` (EXEMPLARS); `frequency` holds the documents with each term among the corpus of `n`."""
    idf = lambda f: math.log((1 + n) / (1 + f)) + 1
    index = Index({t: idf(min(n, frequency.get(t, 0))) if not t.startswith("written ") else 1.0 for t in VOCABULARY}, idf(n / 200))
    index.postings = {label: defaultdict(list) for label in LEAST}
    for e, (label, text) in enumerate(EXEMPLARS if exemplars is None else exemplars):
        terms = set(exemplar_terms(label, text))
        index.norm[e] = sum(index.weight[t] for t in terms) or 1.0
        for t in terms:
            index.postings[label][t].append(e)
    return index


def own_text(text: str) -> str:
    """The text without code and quotations, with line ends and invisible characters made plain."""
    if not text.isascii():
        text = _CONTROL.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    elif not text.isprintable():
        text = _CONTROL.sub("", text)
    text = _ODD_END.sub("\n", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n□\n", text)
    return _QUOTED.sub(" □ ", text) if _QUOTE_SIGNS.search(text) else text


def _without_entry(line: str, ws: list[str]) -> tuple[str, list[str]]:
    """A line and its stems without the bullet, number, time or label that begins an entry."""
    at = _ENTRY.match(line).end()
    return (line[at:].strip(), ws[len(stems(line[:at])):] if line[:at].strip(" -*+•>#.)0123456789:\t") else ws) if at else (line.strip(), ws)


def _is_filler(passages: list[tuple[str, list[str]]], index: Index) -> bool:
    """Whether a line, or neighbouring lines of one paragraph together, are filler."""
    for i, (line, ws) in enumerate(passages):
        if not ws:
            continue
        window: list[str] = []
        for j in range(i, min(i + WINDOW_LINES, len(passages))):
            if not passages[j][0] or "□" in passages[j][0]:
                break
            window = window + passages[j][1]
            if len(window) > 1 and index.covered(Counter(window), "filler", PASSAGE):
                return True
            if j == i and not any(w in index.postings["filler"] for w in window):
                break
    return False


def residue_label(text: str | None, index: Index) -> str | None:
    """'placeholder', 'filler', 'page' or null for one document. Null, empty and blank texts are none."""
    if not text or not text.strip():
        return None
    own = own_text(text)
    if _MARK_SIGNS.search(own):
        for m in _MARK.finditer(own):
            terms = mark_terms(m.group())
            if _BRACKETS[m.lastindex - 1][0] in _SINGLE:
                if index.holds(set(terms), "ask") >= ASK:
                    return "placeholder"
            elif index.covered(Counter(terms), "mark", MARK):
                return "placeholder"
    plain = _plain(own)
    body = _HEADER.sub("", plain) if plain.startswith("---\n") else plain
    lines = [(line, stems(line)) for line in body.split("\n")]
    if _is_filler([_without_entry(*x) for x in lines], index):
        return "filler"
    is_markup = text.lstrip()[:1] in ("<", "{")
    terms = Counter(stems(_plain(text)) if is_markup or body is not plain else [w for _, ws in lines for w in ws])
    page, nav = index.postings["page"], index.postings["navigation"]
    main = Counter({t: n for t, n in terms.items() if t not in nav or t in page})
    return "page" if main and (is_markup or "□" not in own) and index.covered(main, "page", WHOLE) else None


def _has(text: Column, sign: str) -> Column:
    """Whether a text has a bracket; where it is also a common sign, a whole mark."""
    has = F.contains(text, F.lit(sign))
    return has & text.rlike(next(p for o, _, p in _BRACKETS if o == sign)) if sign in ("%", "__") else has


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each exemplar term, over all documents, and their number, from one job. The result has at most one entry per exemplar term."""
    vocab = [t for t in VOCABULARY if not t.startswith(("open ", "close ", "written "))]
    signs = [t for t in VOCABULARY if t.startswith(("open ", "close "))]
    word = F.transform(F.split(F.translate(F.replace(F.lower(F.col(text)), F.lit("ё"), F.lit("е")), _APART, " " * len(_APART)), " "), lambda w: F.substring(w, 1, STEM))
    of_words = F.array_intersect(word, F.array(*[F.lit(t) for t in vocab]))
    of_signs = F.array_compact(F.array(*[F.when(_has(F.col(text), t.split(" ", 1)[1]), F.lit(t)) for t in signs]))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(F.concat(of_words, of_signs), F.expr("cast(array() as array<string>)")))).alias("t")).groupBy("t").count().collect()
    counts = {r["t"]: r["count"] for r in rows if r["t"]}
    return counts, next((r["count"] for r in rows if not r["t"]), 0)


def with_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, residue) of every document; `residue` is null for content. One narrow pass; the index is a few kB and travels with the code.

    Null, empty and blank texts are content of no kind (null); repeated rows give repeated results; an empty table gives none."""
    frequency, n = document_frequencies(docs, text)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = build_index(frequency, n)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "residue": [residue_label(x, index) for x in b["text"]]}, dtype=object)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(score, "doc_id bigint, residue string")
