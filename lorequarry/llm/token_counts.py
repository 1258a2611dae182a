"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie whose nodes carry a failure link and the number of tokens
that following it completes (popped tokens). Reading a word is then one step a byte:
follow the edge, or else take the failure link and add its count. The sum is the
number of pieces that repeated longest-match-first would cut, in linear time.

The vocabulary comes from a byte-level file: tokens that begin with the space marker
may begin a word, the others continue one. All single bytes are tokens, so no word
is unknown. Words are runs without white space ([^\\x20\\x09-\\x0D]+).

Defined results: null and empty texts count 0; equal words get equal counts; extra
columns are kept by name; an empty table gives an empty table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .bpe import byte_alphabet

CACHE_ENTRIES = 400_000
#: A mark for the beginning of a word, in front of its bytes.
START = 256


class Automaton:
    """Trie nodes as dictionaries of edges; ``fail`` and ``popped`` as lists."""

    def __init__(self, tokens: dict[tuple[int, ...], int] | list[tuple[int, ...]]):
        self.edges: list[dict[int, int]] = [{}]
        self.token: list[bool] = [False]
        self.depth: list[int] = [0]
        for symbols in tokens:
            node = 0
            for s in symbols:
                nxt = self.edges[node].get(s)
                if nxt is None:
                    nxt = len(self.edges)
                    self.edges[node][s] = nxt
                    self.edges.append({})
                    self.token.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = True
        self.fail = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        self._link()

    def _link(self) -> None:
        """Breadth first: a token node pops itself; another node takes its parent's links
        as far as needed until the last symbol can be read (LinMaxMatch)."""
        queue = [(0, s, n) for s, n in self.edges[0].items()]
        for parent, symbol, node in queue:
            if self.token[node]:
                self.fail[node], self.popped[node] = 0, 1
            else:
                z, pops = self.fail[parent], self.popped[parent]
                while z >= 0 and symbol not in self.edges[z]:
                    pops += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.edges[z][symbol], pops
            queue.extend((node, s, n) for s, n in self.edges[node].items())

    def count(self, symbols) -> int | None:
        """Pieces of a word; None if it can't be cut."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for s in symbols:
            nxt = edges[node].get(s)
            while nxt is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return None
                nxt = edges[node].get(s)
            node = nxt
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total if node == 0 else None


def word_pieces(path: str) -> list[tuple[int, ...]]:
    """Tokens of a byte-level file as symbols: START then bytes for those that begin a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet, out = byte_alphabet(), []
    for token in vocab:
        data = [alphabet[c] for c in token]
        if data[0] == 32 and (len(data) == 1 or 32 not in data[1:]):
            out.append((START, *data[1:]))
        elif 32 not in data:
            out.append(tuple(data))
    return out


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(word_pieces(path))
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        n = self.automaton.count((START, *word))
        if len(word) <= 64:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        words = text.encode("utf-8", "replace").split() if text else []
        known, word = self.known, self.word
        return len(words), sum([known[w] if w in known else word(w) for w in words])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def forget() -> None:
    _COUNTERS.clear()


def _count_batches(batches, path):
    c = counter(path)
    for batch in batches:
        found = np.array([c.text(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 2)
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found[:, 0]), pa.array(found[:, 1])], names=[*names, "n_words", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Columns ``keep`` with ``n_words`` and ``n_tokens``; one narrow pass."""
    return common.per_text(docs, f"{__name__}:_count_batches", "n_words bigint, n_tokens bigint", keep, path=path)
