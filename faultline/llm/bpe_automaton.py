"""A byte-pair vocabulary as a deterministic automaton over its tokens.

The automaton accepts exactly the token sequences that merging would produce. It starts as one state with a loop for
each byte. Each merge u v -> w is a gadget added in order: wherever u led to a state that v left, an arc w is
added past both, and the state behind u is split so that v can no longer follow u there. Applying the gadgets one after
the other keeps two facts: the state depends on the last token only, and an arc for w leaves a state exactly where an arc for u
left it when the gadget was added. The state behind w starts as a copy of the state behind v. So a state needs no
list of its arcs; an arc t2 out of the state behind t1 is closed if some gadget (a, b) closed it, with a on the
right edge of t1, b on the left edge of t2, before either was swallowed by a longer token. Arcs are opened or closed once, on
first use, and kept in a table.

A word is encoded by walking a byte automaton of the vocabulary (table-driven, one entry per state and byte) from every
position reached; among the tokens that end at a position exactly one has an open arc from the state before it. Decoding emits the
bytes each arc is labelled with.
"""

from __future__ import annotations

import json
from functools import lru_cache

import regex

# Fixed value: the pre-splitting pattern that belongs to the byte_bpe vocabularies.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids per worker; the table is emptied when full, so memory is bounded.
WORD_TABLE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable Latin-1 stands for itself, the other
    bytes take the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeAutomaton:
    """The compiled automaton. `vocab` maps byte strings to ids, `merges` lists pairs of byte strings in merge order."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.labels: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for b, i in vocab.items():
            self.labels[i] = b
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.time: dict[int, int] = {}  # when a token's gadget was added
        self.gadget: dict[tuple[int, int], int] = {}
        made = {i for b, i in vocab.items() if len(b) == 1}
        for n, (u, v) in enumerate(merges):
            w, u, v = vocab[u + v], vocab[u], vocab[v]
            # the gadget finds nothing to join where u or v never arises or v can no longer follow u
            if w in made or u not in made or v not in made or not self.arc(u, v):
                continue
            made.add(w)
            self.gadget[u, v] = n
            self.left[w], self.right[w], self.time[w] = u, v, n
        # byte automaton: entry (state, byte) -> state, and the token accepted in each state
        self.move: dict[int, int] = {}
        self.accept: list[int] = [-1]
        for b, i in vocab.items():
            if i not in made:
                continue
            s = 0
            for x in b:
                k = s << 8 | x
                t = self.move.get(k)
                if t is None:
                    t = self.move[k] = len(self.accept)
                    self.accept.append(-1)
                s = t
            self.accept[s] = i
        self.open: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PRE_SPLIT).findall

    def arc(self, t1: int, t2: int) -> bool:
        """Whether token t2 may follow token t1."""
        a, until_a, never = t1, 1 << 60, 1 << 60
        while True:
            b, until_b = t2, never
            while True:
                n = self.gadget.get((a, b), never)
                # the pair lies left of what t2 was made of, so at equal time it goes first
                if n < until_a and n <= until_b and n < never:
                    return False
                if b not in self.left:
                    break
                until_b, b = self.time[b], self.left[b]
            if a not in self.right:
                return True
            until_a, a = self.time[a], self.right[a]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word. A byte that the vocabulary has no token for is an error."""
        n = len(word)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        move, accept, opened = self.move, self.accept, self.open
        for j in range(n):
            before = last[j]
            if j and before < 0:
                continue
            s = 0
            for k in range(j, n):
                s = move.get(s << 8 | word[k], 0)
                if not s:
                    break
                t = accept[s]
                if t < 0 or last[k + 1] >= 0:
                    continue
                if j:
                    ok = opened.get((before, t))
                    if ok is None:
                        if len(opened) > 4_000_000:
                            opened.clear()
                        ok = opened[before, t] = self.arc(before, t)
                    if not ok:
                        continue
                last[k + 1], begin[k + 1] = t, j
        out = []
        if n and last[n] < 0:
            raise ValueError(f"the vocabulary has no tokens for {word!r}")
        while n:
            out.append(last[n])
            n = begin[n]
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none. Lone surrogates become U+FFFD, as in UTF-8 decoders."""
        if not text:
            return []
        ids: list[int] = []
        words, get = self.words, self.words.get
        for w in self.split(text):
            t = get(w)
            if t is None:
                if len(words) > WORD_TABLE:
                    words.clear()
                t = self.encode_word(w.encode("utf-8", "replace"))
                if len(w) < 64:
                    words[w] = t
            ids += t
        return ids

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        n = 0
        words, get = self.words, self.words.get
        for w in self.split(text):
            t = get(w)
            if t is None:
                if len(words) > WORD_TABLE:
                    words.clear()
                t = self.encode_word(w.encode("utf-8", "replace"))
                if len(w) < 64:
                    words[w] = t
            n += len(t)
        return n

    def decode(self, ids) -> str:
        """Text of the labels of `ids`, bytes that form no character replaced."""
        return b"".join([self.labels[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BpeAutomaton:
    """Compile the vocabulary file at `path` (a byte-level BPE in JSON), once per process."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda t: bytes(letters[c] for c in t)
    used = {t for t in model["vocab"] if all(c in letters for c in t)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    reachable = {u + v for u, v in merges} | {t for t in used if len(t) == 1}
    return BpeAutomaton({raw(t): i for t, i in model["vocab"].items() if t in reachable and t in used}, [(raw(u), raw(v)) for u, v in merges])
