"""Many queries against the knowledge base: every query is scored with every entry inside a block of entries, and only what can be among the best leaves the block.

A block of distinct queries travels to the workers; entries are read where they lie. Of entries, only words and signatures that a query asks for take part, so the scores of a query and a block are
a few additions over arrays. The arithmetic is that of kb_search.search(), operation by operation, so that scores are equal to the last digit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries scored at a time, and bytes of them from which a block is scored earlier.
ROWS, BYTES = 8192, 64 << 20
#: Similarities, and sums of them, that are kept for use again, one number for each entry.
KEPT = 256
#: More than the two digits of a score can hide.
NEAR = 0.0101


@lru_cache(100_000)
def _half_up(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def rounded(x: np.ndarray) -> np.ndarray:
    """Two digits as round() of Spark gives them: half up of the shortest decimal."""
    cents = x * 100
    low = np.floor(cents)
    out = np.where(cents - low < 0.5, low, low + 1) / 100
    for i in np.flatnonzero(np.abs(cents - low - 0.5) < 1e-6):
        out[i] = _half_up(float(x[i]))
    return out


class Known:
    """The distinct signatures of a block of entries, in comparable form, and how similar they are to one that is asked for."""

    def __init__(self, signatures: pa.Array, tokens: pa.Array, vocabulary: pa.Array, least: float) -> None:
        """Of each entry its distinct signatures and the distinct tokens of each; `vocabulary`: the tokens of all that can be asked for."""
        flat, counts = signatures.flatten().dictionary_encode(), signatures.value_lengths().to_numpy()
        self.n, self.least, self.codes, self.rows = len(signatures), least, flat.indices.to_numpy(), np.flatnonzero(counts)
        self.begin = (np.cumsum(counts) - counts)[self.rows]
        texts = flat.dictionary.to_pylist()
        self.number, self.lengths = {c: i for i, c in enumerate(texts)}, sorted({len(c) for c in texts})
        self.joined, self.starts = "".join(c + "\n" for c in texts), np.cumsum([0, *(len(c) + 1 for c in texts)]).tolist()  # a signature holds no line end
        own = tokens.flatten().take(pa.array(np.unique(self.codes, return_index=True)[1], pa.int64()))
        self.sizes = own.value_lengths().to_numpy()
        ids = pc.index_in(own.flatten(), value_set=vocabulary)
        holders = np.repeat(np.arange(len(texts)), self.sizes)[ids.is_valid().to_numpy(zero_copy_only=False)]
        ids = ids.drop_null().to_numpy()
        order = np.argsort(ids, kind="stable")
        self.holders, self.token_at = holders[order], np.searchsorted(ids[order], np.arange(len(vocabulary) + 1))

    def similar(self, s: str, tokens: list[int]) -> np.ndarray:
        """For each entry the similarity of its best signature as in text.signature_similarity(), 0 below `least`."""
        out = np.zeros(self.n)
        if not len(self.rows):
            return out
        each = np.zeros(len(self.sizes))
        if shares := [self.holders[self.token_at[t]:self.token_at[t + 1]] for t in tokens]:
            shared = np.bincount(np.concatenate(shares), minlength=len(each))
            each = shared / np.maximum(len(tokens) + self.sizes - shared, 1)
        for n in self.lengths:
            for p in range(len(s) - n + 1):
                if (i := self.number.get(s[p:p + n])) is not None:
                    each[i] = 0.85
        at = self.joined.find(s)
        while at >= 0:
            i = bisect_right(self.starts, at) - 1
            each[i] = 0.85
            at = self.joined.find(s, self.starts[i + 1])
        if s in self.number:
            each[self.number[s]] = 1.0
        each[each < self.least] = 0
        out[self.rows] = np.maximum.reduceat(each[self.codes], self.begin)
        return out


class Queries:
    """A block of distinct queries: a table of gid, q (distinct words), s (signatures in comparable form) and st (distinct tokens of each signature)."""

    def __init__(self, block: pa.Table, weights: list[float], signature_weight: float, best_signatures: int = 4, similar_from: float = 0.5) -> None:
        self.weights, self.signature_weight, self.best_signatures = weights, signature_weight, best_signatures
        rows = sorted(zip(*(block.column(c).to_pylist() for c in ("q", "s", "gid", "st"))), key=lambda r: r[:2])  # equal words follow each other
        self.gids = [r[2] for r in rows]
        words = {t: i for i, t in enumerate(dict.fromkeys(t for r in rows for t in r[0]))}
        self.words = [tuple(words[t] for t in r[0]) for r in rows]
        self.vocabulary = list(words)
        asked, self.similar_from = {s: t for r in rows for s, t in zip(r[1], r[3])}, similar_from
        tokens = {t: i for i, t in enumerate(dict.fromkeys(t for x in asked.values() for t in x))}
        self.tokens, self.asked = list(tokens), {s: [tokens[t] for t in x] for s, x in asked.items()}
        self.signatures = [tuple(r[1]) for r in rows]

    def best(self, batches: Iterator[pa.RecordBatch], most: int, least: float) -> Iterator[pa.RecordBatch]:
        """gid, id, title, outcome, score: for each query the entries that can be among the best `most` of all. Batches have id, title, outcome, factor, t (words of each field), s and st."""
        task = _Task(self, most, least)
        held, rows, size = [], 0, 0
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                held, rows, size = [*held, part], rows + len(part), size + part.nbytes
                if rows >= ROWS or size >= BYTES:
                    yield task.best(held)
                    held, rows, size = [], 0, 0
        if held:
            yield task.best(held)


class _Task:
    """One worker's pass. bar: for each query, the score of the last of `most` entries seen that are not refuted; what lies below it, or is refuted, is no longer wanted."""

    def __init__(self, queries: Queries, most: int, least: float) -> None:
        self.q, self.most, self.least = queries, most, least
        self.vocabulary, self.tokens = pa.array(queries.vocabulary, pa.string()), pa.array(queries.tokens, pa.string())
        self.bar = np.full(len(queries.gids), -np.inf)

    def best(self, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        order = table.select(["id"]).append_column("refuted", pc.equal(table.column("outcome"), "refuted"))
        table = table.take(pc.sort_indices(order, [("refuted", "ascending"), ("id", "ascending")], null_placement="at_start"))
        n, kept = len(table), pc.sum(pc.not_equal(table.column("outcome"), "refuted")).as_py()
        column = lambda c: table.column(c).combine_chunks()
        postings, known = self._postings(column("t"), n), Known(column("s"), column("st"), self.tokens, self.q.similar_from)
        factor, q = column("factor").to_numpy(), self.q
        at, of, scores, last, kept_sums, similar = [], [], [], None, {}, {}
        for i, (words, signatures) in enumerate(zip(q.words, q.signatures)):
            if words != last:
                last, said = words, self._words(words, postings, n)
            if signatures not in kept_sums:
                if len(kept_sums) >= KEPT:
                    kept_sums.clear()
                kept_sums[signatures] = self._sum(signatures, known, similar)
            score = (said + kept_sums[signatures]) * factor
            rows, x = self._top(score[:kept], self.bar[i], self.most)
            if len(rows) == self.most > 0:
                self.bar[i] = max(self.bar[i], x[-1])
            parts = [(rows, x)]
            if self.bar[i] == -np.inf:
                rows, x = self._top(score[kept:], -np.inf, self.most - len(rows))
                parts.append((rows + kept, x))
            for rows, x in parts:
                at.append(rows)
                scores.append(x)
                of.append(np.full(len(rows), i))
        put = lambda x, kind: pa.array(np.concatenate(x or [[]]).astype(kind))
        rows, gid = put(at, np.int64), pa.array(q.gids, pa.string()).take(put(of, np.int64))
        return pa.RecordBatch.from_arrays([gid, *(column(c).take(rows) for c in ("id", "title", "outcome")), put(scores, np.float64)], names=["gid", "id", "title", "outcome", "score"])

    def _postings(self, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that hold a word in a field, word by word and field by field, each once; where each word and field begins."""
        fields, wide = texts.flatten(), len(self.q.weights)
        ids = pc.index_in(fields.flatten(), value_set=self.vocabulary)
        place = np.repeat(np.arange(len(fields), dtype=np.int64), fields.value_lengths().to_numpy(zero_copy_only=False))
        place = place[ids.is_valid().to_numpy(zero_copy_only=False)]
        keys = np.unique((ids.drop_null().to_numpy().astype(np.int64) * wide + place % wide) * n + place // wide)
        return keys % n, np.searchsorted(keys, np.arange(len(self.vocabulary) * wide + 1, dtype=np.int64) * n)

    def _words(self, words: tuple[int, ...], postings: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        (rows, begin), wide, total = postings, len(self.q.weights), np.zeros(n)
        for f, w in enumerate(self.q.weights):
            own = [rows[begin[k]:begin[k + 1]] for t in words if begin[k := t * wide + f] < begin[k + 1]]
            if own:
                total += np.bincount(np.concatenate(own), minlength=n) / len(words) * w
        return total

    def _sum(self, signatures: tuple[str, ...], known: Known, similar: dict[str, np.ndarray]) -> np.ndarray:
        best = np.zeros((self.q.best_signatures, known.n))
        for s in signatures:
            if s not in similar:
                if len(similar) >= KEPT:
                    similar.clear()
                similar[s] = known.similar(s, self.q.asked[s])
            x = similar[s]
            for row in best:  # sorted from the best on
                row[:], x = np.maximum(row, x), np.minimum(row, x)
        total = np.zeros(known.n)
        for x in best:
            total += x
        return total * self.q.signature_weight

    def _top(self, score: np.ndarray, bar: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and rounded scores of the best, equal ones in the order of the rows."""
        at = np.flatnonzero(score >= max(bar, self.least, 0) - NEAR)
        if len(at) > most > 0:
            at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most] - NEAR]
        x = rounded(score[at])
        at, x = at[keep := (x > 0) & (x >= max(bar, self.least))], x[keep]
        order = np.argsort(-x, kind="stable")[:most]
        return at[order], x[order]
