"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, again and again, the longest vocabulary
piece that the rest of a word starts with. A trie over the pieces gets failure
links: where a node has no child for the next byte, the pieces that are certain
by then are popped and matching goes on at the node for what remains. Only how
many are popped is kept for each node, so a word's length in pieces comes out
in time linear in its bytes, without building the pieces.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagtriage.llm.common import arrow_rows


class Automaton:
    """Trie of byte pieces with failure links and popped-piece counts. Every
    word counts as b" " + its bytes, so that pieces with a leading space are
    word starts and all others go on."""

    CACHE, LONG = 200_000, 64

    def __init__(self, pieces: list[bytes]):
        self.step: dict[int, int] = {}
        ends, parent, byte = [False], [0], [0]
        for p in pieces:
            v = 0
            for b in p:
                u = self.step.get(v << 8 | b)
                if u is None:
                    u = len(ends)
                    self.step[v << 8 | b] = u
                    ends.append(False)
                    parent.append(v)
                    byte.append(b)
                v = u
            ends[v] = bool(v)
        n = len(ends)
        # by depth: a node's links need its parent's and those of shorter strings
        self.fail, self.pops = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(1, n):  # parents have smaller numbers
            depth[v] = depth[parent[v]] + 1
        get = self.step.get
        for v in sorted(range(1, n), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, k = self.fail[parent[v]], self.pops[parent[v]]
            while z >= 0 and (u := get(z << 8 | byte[v])) is None:
                k += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = u, k
        self.cache: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of one word given with its leading space; -1 if it can't be
        split into pieces of the vocabulary."""
        get, fail, pops, v, k = self.step.get, self.fail, self.pops, 0, 0
        for b in word:
            while (u := get(v << 8 | b)) is None:
                if fail[v] < 0:
                    return -1
                k += pops[v]
                v = fail[v]
            v = u
        while v > 0:
            if fail[v] < 0:
                return -1
            k += pops[v]
            v = fail[v]
        return k

    def word(self, w: str) -> int:
        k = self.count(b" " + w.encode("utf-8"))
        k = 1 if k < 0 else k  # one unknown piece
        if len(w) <= self.LONG:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[w] = k
        return k

    def text(self, text: str | None) -> tuple[int, int]:
        """(words, pieces) of a text split at white space."""
        words = (text or "").split()
        cache, miss = self.cache.get, self.word
        got = map(cache, words)
        return len(words), sum([miss(w) if k is None else k for w, k in zip(words, got, strict=True)])


@functools.cache
def automaton(path: str) -> Automaton:
    with open(path, "rb") as f:
        return Automaton([base64.b64decode(line.split()[0]) for line in f if line.strip()])


def token_counts(docs: DataFrame, vocab_path: str, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the ``keep`` columns, ``n_words`` and ``n_tokens`` (long).
    Words are the runs without white space; a word that the pieces can't make
    counts as one token. Null and empty texts have none. Rows are independent:
    no shuffle, repeated rows and other columns need no care."""
    arrow_rows(docs.sparkSession)
    src = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]]
                       + ["n_words long", "n_tokens long"])

    def work(batches):
        auto = automaton(vocab_path)
        for b in batches:
            got = np.array([auto.text(t) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(got[:, 0]), pa.array(got[:, 1])],
                [*keep, "n_words", "n_tokens"])

    return src.mapInArrow(work, schema)
