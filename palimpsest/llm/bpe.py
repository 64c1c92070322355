"""Byte-level BPE of a public vocabulary as a lazily determinised transducer.

The merge list is compiled into (a) a trie of the tokens' bytes and (b) the merge trees' spines, from which it follows
whether two tokens may stand side by side: they may unless a merge across their border happens before both are complete.
The encoding of a word is the only chain of tokens in which all neighbours may stand side by side. A nondeterministic
transducer guesses where tokens end; its subset construction keeps, per hypothesis, the last token, the trie node of the
token being read and the output not yet common to all hypotheses. What is common is emitted, so that lookahead is bounded
by the longest token. Subset states are made when first reached and kept while memory allows (a full table is emptied,
which costs time and changes nothing).

Words come from the vocabulary's splitting pattern, computed over code-point classes for whole batches. Ids of known words
are kept; texts are cut only where a word ends. Defined results: null and empty texts have an empty list; special tokens'
strings are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from codecs import getincrementaldecoder
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: Code points handled at once, states and words kept, longest word kept.
CHUNK, STATES, WORDS, WORD_CHARS = 1 << 19, 1 << 19, 1 << 20, 64

LETTER, NUMBER, SPACE, OTHER, EDGE = range(5)
_CUT = re.compile(r"(?<=\S)\s")


def _byte_names() -> dict[str, int]:
    """The vocabulary file's printable name of each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point; EDGE stands behind the last one."""
    spaces = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(spaces)] = SPACE
    return np.append(out, np.uint8(EDGE))


def word_starts(c: np.ndarray) -> np.ndarray:
    """Where words start in code points ``c``; texts are set apart by the code point sys.maxunicode + 1, itself a word."""
    k = classes()[c]
    prev = np.empty_like(k)
    prev[0], prev[1:] = EDGE, k[:-1]
    after = np.empty_like(k)
    after[-1], after[:-1] = EDGE, k[1:]
    blank_before = np.empty(len(c), bool)
    blank_before[0], blank_before[1:] = False, c[:-1] == 32
    space = k == SPACE
    start = (k != prev) | (k == EDGE)
    # a lone blank goes with the word behind it; of several white spaces the last stands apart
    start &= space | ~blank_before | (k == EDGE)
    start |= space & (prev == SPACE) & (after != SPACE) & (after != EDGE)
    quote = np.flatnonzero((c == 39) & start & (after == LETTER))
    if len(quote):
        one = np.minimum(quote + 1, len(c) - 1)
        two = np.minimum(quote + 2, len(c) - 1)
        x, y = c[one], c[two]
        single = np.isin(x, (115, 116, 109, 100))  # 's 't 'm 'd
        double = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))  # 're 've 'll
        take = single | double
        start[one[take]] = False
        end = quote[take] + np.where(single[take], 2, 3)
        start[end[end < len(c)]] = True
    return np.flatnonzero(start)


class Transducer:
    """Encoder and decoder of one vocabulary file (``*.json`` with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        names, vocab = _byte_names(), model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for name, i in vocab.items():
            if all(ch in names for ch in name):
                self.bytes_of[i] = bytes(names[ch] for ch in name)
        self.born: dict[int, int] = {}  # order of the merge that makes a token; bytes: -1
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge: dict[int, int] = {}  # pair of ids -> order of the merge
        for order, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            whole = vocab[a + b]
            ia, ib = vocab[a], vocab[b]
            self.merge[ia << 20 | ib] = order
            if whole not in self.born:
                self.born[whole], self.left[whole], self.right[whole] = order, ia, ib
        # the trie: node 0 is the root; a step is node << 8 | byte
        self.step: dict[int, int] = {}
        self.token: list[int] = [-1]
        for i, bs in self.bytes_of.items():
            if len(bs) > 1 and i not in self.born:
                continue  # a special token's string: no merge makes it
            node = 0
            for b in bs:
                key = node << 8 | b
                if key not in self.step:
                    self.step[key] = len(self.token)
                    self.token.append(-1)
                node = self.step[key]
            self.token[node] = i
        self.beside: dict[int, bool] = {}
        self._clear()
        self.words: dict[str, int] = {}
        self._empty_pool()

    # --- which tokens may stand side by side -------------------------------------------------
    def _spine(self, t: int, child: dict[int, int]) -> list[tuple[int, float]]:
        """The tokens at one border of t's merge tree, each with the order of the merge that consumes it."""
        out, until = [], float("inf")
        while True:
            out.append((t, until))
            if t not in child:
                return out
            until, t = self.born[t], child[t]

    def may_touch(self, t: int, u: int) -> bool:
        key = t << 20 | u
        if (known := self.beside.get(key)) is None:
            known, merge = True, self.merge
            us = self._spine(u, self.left)
            for a, a_until in self._spine(t, self.right):
                for b, b_until in us:
                    r = merge.get(a << 20 | b)
                    # on a tie the merge further left goes first
                    if r is not None and r < a_until and r <= b_until:
                        known = False
                        break
                if not known:
                    break
            if len(self.beside) >= 4 * STATES:
                self.beside.clear()
            self.beside[key] = known
        return known

    # --- the determinised transducer ---------------------------------------------------------
    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.last: list[tuple[int, ...] | None] = []
        self._state(((-1, 0, ()),))

    def _state(self, hypotheses: tuple) -> int:
        s = self.ids.get(hypotheses)
        if s is None:
            s = self.ids[hypotheses] = len(self.states)
            self.states.append(hypotheses)
            self.last.append(next((rest for _, node, rest in hypotheses if node == 0), None))
        return s

    def _make(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of a subset state: the target state and the output common to all its hypotheses."""
        found = []
        for t, node, rest in self.states[s]:
            n = self.step.get(node << 8 | byte)
            if n is None:
                continue
            found.append((t, n, rest))
            u = self.token[n]
            if u >= 0 and (t < 0 or self.may_touch(t, u)):
                found.append((u, 0, (*rest, u)))
        first = found[0][2]
        common = len(first)
        for _, _, rest in found:
            k = 0
            while k < common and k < len(rest) and rest[k] == first[k]:
                k += 1
            common = k
        if common:
            found = [(t, n, rest[common:]) for t, n, rest in found]
        made = self.next[s << 8 | byte] = (self._state(tuple(found)), first[:common])
        return made

    def run(self, data: bytes) -> list[int]:
        """Ids of one word."""
        out: list[int] = []
        s, known = 0, self.next
        for byte in data:
            to = known.get(s << 8 | byte)
            if to is None:
                if len(self.states) >= STATES:  # also within a long word: the state it is in is the only one that stays
                    here = self.states[s]
                    self._clear()
                    s, known = self._state(here), self.next
                to = self._make(s, byte)
            s = to[0]
            if to[1]:
                out += to[1]
        out += self.last[s] or ()
        return out

    # --- whole texts ---------------------------------------------------------------------------
    def _empty_pool(self) -> None:
        self.words.clear()
        self.pool = np.zeros(1 << 16, np.int32)
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.filled = self.n_words = 0

    def _word(self, w: str) -> int:
        """Place of a word's ids in the pool."""
        ids = self.run(w.encode("utf-8", "surrogatepass"))
        if self.n_words == len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        i = self.n_words
        self.at[i], self.size[i] = self.filled, len(ids)
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.n_words += 1
        self.words[w] = i
        return i

    def encode_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if self.n_words >= WORDS:
            self._empty_pool()
        edge = np.array([sys.maxunicode + 1], np.uint32)
        parts = [x for t in texts for x in (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), edge)]
        c = np.concatenate(parts) if parts else edge[:0]
        if not len(c):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        starts = word_starts(c)
        joined = "\0".join(texts) + "\0"  # the same places; the words at the edges are left out
        real = c[starts] != sys.maxunicode + 1
        ends = np.append(starts[1:], len(c))
        text_of = np.cumsum(~real) - (~real)
        s, e, owner = starts[real], ends[real], text_of[real]
        known, place = self.words, self._word
        get = known.get
        words = [joined[a:b] for a, b in zip(s.tolist(), e.tolist())]
        where = [get(w, -1) for w in words]
        if -1 in where:
            where = [i if i >= 0 else (known[w] if w in known else place(w)) for i, w in zip(where, words)]
        where = np.array(where, np.int64)
        n = self.size[where].astype(np.int64)
        ends_out = np.cumsum(n)
        total = int(ends_out[-1]) if len(n) else 0
        src = np.arange(total, dtype=np.int64) + np.repeat(self.at[where] - (ends_out - n), n)
        for w in words:
            if len(w) > WORD_CHARS:
                known.pop(w, None)
        return self.pool[src], np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts in a row and the count of each, in bounded pieces."""
        ids, counts = [], np.zeros(len(texts), np.int64)
        piece: list[str] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if piece:
                got, n = self.encode_joined(piece)
                ids.append(got)
                np.add.at(counts, owner, n)
                piece.clear()
                owner.clear()
                held = 0

        for i, t in enumerate(texts):
            for part in pieces(t):
                piece.append(part)
                owner.append(i)
                held += len(part)
                if held >= CHUNK:
                    flush()
        flush()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), counts

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids as it becomes complete; bytes of a broken character come out as U+FFFD."""
        machine = getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.bytes_of[i]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece


def pieces(text: str | None, chunk: int = CHUNK) -> Iterator[str]:
    """A text in pieces of about ``chunk`` code points, cut in front of white space: no word spans such a place."""
    if not text:
        return
    at = 0
    while len(text) - at > 2 * chunk:
        cut = _CUT.search(text, at + chunk)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One per worker process and vocabulary; a file that isn't at its path here is the one shipped with the job."""
    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    return Transducer(path)


def shipped(spark: SparkSession, path: str) -> str:
    """The vocabulary's path, after the file was given to the workers where they don't share this machine's disk."""
    if not spark.sparkContext.master.startswith("local"):
        spark.sparkContext.addFile(path)
    return path


def vocabulary(name: str = "byte_bpe_50k", root: str = TOKENIZERS) -> str:
    return f"{root}/{name}.json"


def ids_of(path: str, key: str, text: str):
    """mapInArrow function: (key, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            keys, texts = b.column(b.schema.get_field_index(key)), b.column(b.schema.get_field_index(text)).to_pylist()
            for lo, hi in spans(texts):
                ids, n = t.encode_texts(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), lists], names=[key, "ids"])

    return run


def counts_of(path: str, key: str, text: str):
    """mapInArrow function: (key, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            keys, texts = b.column(b.schema.get_field_index(key)), b.column(b.schema.get_field_index(text)).to_pylist()
            n = [t.encode_texts(texts[lo:hi])[1] for lo, hi in spans(texts)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], names=[key, "n_tokens"])

    return run


def spans(texts: list[str | None], chunk: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chunk`` code points each (a longer text alone)."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chunk:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
