"""Byte-level BPE encoding and decoding.

Pre-tokenisation is a finite automaton over codepoint classes. Each character
is a transition function on the automaton's states; functions compose
associatively, so the state after every character of a whole batch comes from
a blocked prefix scan over function numbers (one table look-up a character and
pass), with no regular expression. Boundaries follow from neighbouring states.
The slices go through pair merging with a bounded cache; their byte offsets
are kept, so ids decode to the exact bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagtriage.llm.common import arrow_rows, powers, row_spans, utf8_buffer

# ---- character classes
LETTER, STMD, RV, ELL, E, NUM, OTHER, APOS, SPACE, WHITE = range(10)
# ---- automaton states: what the last character was
BEGIN, S_WHITE, S_SPACE, S_LET, S_NUM, S_OTH, S_APOS, S_RV, S_ELL, S_DONE = range(10)
N_STATES = 10

# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    t = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            t[cp] = LETTER
        elif major == "N":
            t[cp] = NUM
    t[WHITE_SPACE] = WHITE
    t[0x20] = SPACE
    t[0x27] = APOS
    for chars, c in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", E)):
        for ch in chars:
            t[ord(ch)] = c
    return t


def step(state: int, cls: int) -> int:
    """Automaton: contractions ('s 't 'm 'd 're 've 'll) need an apostrophe that
    starts a run of other characters and does not follow a space."""
    if cls == SPACE:
        return S_SPACE
    if cls == WHITE:
        return S_WHITE
    if cls == NUM:
        return S_NUM
    if cls == OTHER:
        return S_OTH
    if cls == APOS:
        return S_OTH if state in (S_SPACE, S_OTH, S_APOS) else S_APOS
    if state == S_APOS:
        return {STMD: S_DONE, RV: S_RV, ELL: S_ELL}.get(cls, S_LET)
    if (state == S_RV and cls == E) or (state == S_ELL and cls == ELL):
        return S_DONE
    return S_LET


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """All compositions of the classes' transition functions, numbered.

    Returns (generators: function of a class, and at 10 + class the same from
    the beginning of a text, compose[f * m + g] = first f then g,
    apply[f * N_STATES + s], m)."""
    gens = [tuple(step(s, c) for s in range(N_STATES)) for c in range(10)]
    gens += [(g[BEGIN],) * N_STATES for g in gens]
    known = {f: i for i, f in enumerate(dict.fromkeys(gens))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[f[s]] for s in range(N_STATES))
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    m, funcs = len(known), list(known)
    comp = np.zeros(m * m, np.uint8 if m <= 256 else np.uint16)
    for f in funcs:
        for g in funcs:
            comp[known[f] * m + known[g]] = known[tuple(g[f[s]] for s in range(N_STATES))]
    apply = np.array([f[s] for f in funcs for s in range(N_STATES)], np.uint8)
    return np.array([known[g] for g in gens], comp.dtype), comp, apply, m


SCAN_BLOCK = 64


def scan(funcs: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of function numbers, by blocks: scan all
    blocks side by side, scan the blocks' totals, then apply each block's
    prefix. The functions compose associatively, so the blocking is free."""
    _, comp, _, m = monoid()
    n = len(funcs)
    if n <= SCAN_BLOCK:
        out = funcs.copy()
        for i in range(1, n):
            out[i] = comp[int(out[i - 1]) * m + int(funcs[i])]
        return out
    nb = -(-n // SCAN_BLOCK)
    lanes = np.zeros(nb * SCAN_BLOCK, funcs.dtype)
    lanes[:n] = funcs
    lanes = np.ascontiguousarray(lanes.reshape(nb, SCAN_BLOCK).T)
    wide = np.uint16 if m * m <= 65536 else np.uint32
    for i in range(1, SCAN_BLOCK):
        lanes[i] = comp[lanes[i - 1].astype(wide) * wide(m) + lanes[i]]
    before = np.zeros(nb, funcs.dtype)
    before[1:] = scan(lanes[-1])[:-1]
    lanes[:, 1:] = comp[before[1:].astype(wide) * wide(m) + lanes[:, 1:]]
    return lanes.T.reshape(-1)[:n]


def _edges() -> np.ndarray:
    """Token start by (state before, state after), white space apart."""
    kind = {BEGIN: "b", S_WHITE: "w", S_SPACE: "sp", S_LET: "l", S_NUM: "n", S_OTH: "o",
            S_APOS: "o", S_RV: "l", S_ELL: "l", S_DONE: "c"}
    t = np.zeros((N_STATES, N_STATES), bool)
    for a in range(N_STATES):
        for b in range(N_STATES):
            if a == S_SPACE:
                t[a, b] = False  # the space opens the token
            elif b == S_DONE:
                t[a, b] = False  # inside a contraction
            else:
                t[a, b] = kind[a] != kind[b]
    return t.reshape(-1)


EDGES = _edges()


def token_starts(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens start. ``cps``: code points of texts laid end
    to end; ``firsts``: where each non-empty text starts."""
    n = len(cps)
    if n == 0:
        return np.zeros(0, np.int64)
    gens, _, apply, _ = monoid()
    cls = class_table()[cps]
    sym = cls.copy()
    sym[firsts] += 10
    state = apply[scan(gens[sym]).astype(np.int32) * N_STATES + BEGIN]
    prev = np.empty(n, np.uint8)
    prev[0] = BEGIN
    prev[1:] = state[:-1]
    prev[firsts] = BEGIN
    start = EDGES[prev * np.uint8(N_STATES) + state]
    white = cls >= SPACE
    last = np.ones(n, bool)  # the text's last character
    last[:-1] = False
    last[firsts[1:] - 1] = True
    follows = np.zeros(n, bool)  # a character that isn't white comes next
    follows[:-1] = ~white[1:]
    follows &= ~last
    was = (prev == S_SPACE) | (prev == S_WHITE)
    start = np.where(white, ~was | follows, start)
    half = np.flatnonzero((prev == S_APOS) & ((state == S_RV) | (state == S_ELL)))
    if len(half):  # 'r 'v 'l: only a third letter makes a contraction
        nxt = np.minimum(half + 1, n - 1)
        start[half] = ~((state[nxt] == S_DONE) & ~last[half])
    return np.flatnonzero(start)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0] + lens[0]], then the next, laid end to end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if len(flat) < 1 << 31 and total < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Vocabulary:
    """Merge ranks, and a bounded cache of merged slices."""

    CACHE, LONG, NONE = 150_000, 48, np.int64(1 << 62)

    def __init__(self, path: str):
        self.ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    tok, rank = line.split()
                    self.ranks[base64.b64decode(tok)] = int(rank)
        size = max(self.ranks.values()) + 1
        toks = [b""] * size
        for t, r in self.ranks.items():
            toks[r] = t
        self.flat = np.frombuffer(b"".join(toks), np.uint8)
        self.lens = np.array([len(t) for t in toks], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        texts = [b"%d " % i for i in range(size)]
        self.dec_flat = np.frombuffer(b"".join(texts), np.uint8)
        self.dec_lens = np.array([len(t) for t in texts], np.int64)
        self.dec_starts = np.cumsum(self.dec_lens) - self.dec_lens
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = {a << 20 | b: r for t, r in self.ranks.items() for k in range(1, len(t))
                 if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None}
        self._hash(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.cache: dict[bytes, bytes] = {}

    # ---- pair ranks: an open-addressing table read with whole arrays
    BITS, MIX = 21, np.uint64(0x9E3779B97F4A7C15)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _hash(self, keys: np.ndarray, vals: np.ndarray) -> None:
        self.tk = np.full((1 << self.BITS) + 64, -1, np.int64)
        self.tv = np.full((1 << self.BITS) + 64, self.NONE, np.int64)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.tk[slot] < 0
            self.tk[slot[free]] = keys[free]  # of several keys for a slot one stays
            done = self.tk[slot] == keys
            self.tv[slot[done]] = vals[done]
            keys, vals, slot = keys[~done], vals[~done], slot[~done] + 1
            self.probes += 1

    def cost(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair of ids, NONE where there is none."""
        keys = left << 20 | right
        slot = self._slot(keys)
        hit = self.tk[slot] == keys
        out = np.where(hit, self.tv[slot], self.NONE)
        left_over = np.flatnonzero(~hit & (self.tk[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(left_over):
                break
            slot[left_over] += 1
            at = slot[left_over]
            hit = self.tk[at] == keys[left_over]
            out[left_over[hit]] = self.tv[at[hit]]
            left_over = left_over[~hit & (self.tk[at] >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of every piece. All pieces are merged side by side:
        a round joins, in each, the leftmost pair of the lowest rank."""
        out: list = [b""] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= self.LONG]
        for i, p in enumerate(pieces):
            if len(p) > self.LONG:
                out[i] = np.array(self.merge_long(p), np.int32).tobytes()
        if not short:
            return out
        lens = np.array([len(pieces[i]) for i in short], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)]
        seg = np.repeat(np.arange(len(short)), lens)
        cost = np.full(len(ids), self.NONE, np.int64)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        cost[inner] = self.cost(ids[inner], ids[inner + 1])
        done_ids, done_seg = [], []
        while len(ids):
            heads = np.flatnonzero(np.diff(seg, prepend=-1))
            sizes = np.diff(heads, append=len(seg))
            low = np.minimum.reduceat(cost, heads)
            ended = low == self.NONE
            if ended.any():
                rest = np.repeat(ended, sizes)
                done_ids.append(ids[rest])
                done_seg.append(seg[rest])
                ids, seg, cost, low, sizes = ids[~rest], seg[~rest], cost[~rest], low[~ended], sizes[~ended]
                if not len(ids):
                    break
            at = np.flatnonzero(cost == np.repeat(low, sizes))
            at = at[np.diff(seg[at], prepend=-1) != 0]  # the leftmost of each piece
            ids[at] = cost[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where they are once their partners are gone
            ids, seg, cost = ids[keep], seg[keep], cost[keep]
            left, right = at[at > 0] - 1, at[at < len(ids) - 1]
            left, right = left[seg[left] == seg[left + 1]], right[seg[right] == seg[right + 1]]
            cost[at] = self.NONE
            near = np.concatenate([left, right])
            cost[near] = self.cost(ids[near], ids[near + 1])
        ids, seg = np.concatenate(done_ids), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        raw = ids[order].astype(np.int32).tobytes()
        ends = np.cumsum(np.bincount(seg, minlength=len(short))) * 4
        a = 0
        for i, b in zip(short, ends.tolist(), strict=True):
            out[i] = raw[a:b]
            a = b
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for a long slice, by a heap over a linked list."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        toks = [piece[i:i + 1] for i in range(len(piece))]
        get, n = self.ranks.get, len(toks)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := get(toks[i] + toks[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if toks[i] is None or nxt[i] != j or get(toks[i] + toks[j]) != r:
                continue
            toks[i], toks[j] = toks[i] + toks[j], None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (q := get(toks[i] + toks[k])) is not None:
                    heapq.heappush(heap, (q, i, k))
            if (h := prv[i]) >= 0 and (q := get(toks[h] + toks[i])) is not None:
                heapq.heappush(heap, (q, h, i))
        return [get(t) for t in toks if t is not None]

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, through the cache."""
        cache = self.cache
        got = [cache.get(p) for p in pieces]
        miss = [i for i, g in enumerate(got) if g is None]
        if miss:
            if len(cache) > self.CACHE:
                cache.clear()
            for i, ids in zip(miss, self.merge([pieces[i] for i in miss]), strict=True):
                got[i] = ids
                if len(pieces[i]) <= self.LONG:
                    cache[pieces[i]] = ids
        return got

    def encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each slice) of the slices data[cuts[i]:cuts[i + 1]].
        Equal slices are looked up once; equality by hash is checked byte by byte."""
        a, lens = cuts[:-1], np.diff(cuts)
        power = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[1:len(data) + 1], out=total[1:])
        key = (total[cuts[1:]] - total[a]) * powers(len(data) + 1, inverse=True)[a]
        _, first, inv = np.unique(key, return_index=True, return_inverse=True)
        same = np.array_equal(lens, lens[first][inv]) and np.array_equal(
            data, ragged(data, a[first][inv], lens))
        if not same:  # two slices share a hash: look up each
            first = inv = np.arange(len(a))
        raw = data.tobytes()
        ids = self.lookup([raw[x:y] for x, y in zip(a[first].tolist(), cuts[1:][first].tolist(), strict=True)])
        n = np.array([len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        return ragged(flat, (np.cumsum(n) - n)[inv], n[inv]), n[inv]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids: one gather from the vocabulary laid end to end."""
        return ragged(self.flat, self.starts[ids], self.lens[ids])

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the decimal ids, each followed by a space."""
        return ragged(self.dec_flat, self.dec_starts[ids], self.dec_lens[ids])


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# Bytes of text that a worker lays end to end, and pre-tokens merged at a time
# (longer texts go through in several steps).
SPAN_BYTES, CHUNK = 1 << 20, 200_000


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset of each pre-token's start, first pre-token of each text) of
    UTF-8 texts laid end to end; the last entries close the lists."""
    text = data.tobytes().decode("utf-8")
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = np.ones(len(cps), np.uint8)
    for limit in (0x80, 0x800, 0x10000):
        width += cps >= limit
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    firsts = np.searchsorted(at, np.unique(offsets[:-1][np.diff(offsets) > 0]))
    starts = at[token_starts(cps, firsts)]
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


def encode_batch(voc: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(text number, ids, byte offset in the text) for texts laid end to end, in
    order; a text comes in several parts when it is long, and not at all when
    it is empty."""
    starts, first = pretokens(data, offsets)
    for a in range(0, len(starts) - 1, CHUNK):
        b = min(a + CHUNK, len(starts) - 1)
        cuts = starts[a:b + 1]
        ids, n = voc.encode(data[cuts[0]:cuts[-1]], cuts - cuts[0])
        at = np.append(0, np.cumsum(n))
        for k in range(int(np.searchsorted(first, a, side="right")) - 1, len(offsets) - 1):
            x, y = max(int(first[k]), a), min(int(first[k + 1]), b)
            if x >= b:
                break
            if x < y:
                yield k, ids[at[x - a]:at[y - a]], int(starts[x] - offsets[k])


def encode_text(voc: Vocabulary, text: str | None) -> list[int]:
    """Ids of one text (helper for tests and small inputs)."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    return [int(i) for _, ids, _ in encode_batch(voc, raw, np.array([0, len(raw)])) for i in ids]


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the ``keep`` columns, ``n_bytes``, ``n_tokens``, ``ids``
    (array<int>). Null texts are empty; empty texts give no ids. Rows are
    independent: no shuffle, any number of repeated rows, other columns ignored."""
    return _run(docs, vocab_path, text_col, keep, "ids", "n_bytes long, n_tokens long, ids array<int>")


def encode_decode_digests(docs: DataFrame, vocab_path: str, text_col: str = "text",
                          keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Per document: the ``keep`` columns, ``n_tokens``, ``ids_sha256`` of the
    decimal ids joined by a space, ``decoded_sha256`` of the bytes that the ids
    decode to, ``n_bytes`` decoded, and ``ids`` if wanted. Null and empty texts:
    no ids, hashes of nothing."""
    return _run(docs, vocab_path, text_col, keep, "digests",
                "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids)


def _run(docs, vocab_path, text_col, keep, what, cols):
    arrow_rows(docs.sparkSession)
    kept = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]] + [cols])

    def work(batches):
        voc = vocabulary(vocab_path)
        for batch in batches:
            data, off = utf8_buffer(batch.column(batch.num_columns - 1))
            for a, b in row_spans(off, SPAN_BYTES):
                head = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                tail = _ids(voc, data, off[a:b + 1]) if what == "ids" else _digests(
                    voc, data, off[a:b + 1], "ids array" in cols)
                yield pa.RecordBatch.from_arrays(head + tail, [*keep, *[c.split()[0] for c in cols.split(", ")]])

    return kept.mapInArrow(work, schema)


def _ids(voc, data, off):
    ids = [[] for _ in range(len(off) - 1)]
    for k, part, _ in encode_batch(voc, data[off[0]:off[-1]], off - off[0]):
        ids[k].extend(part.tolist())
    return [pa.array(np.diff(off)), pa.array([len(x) for x in ids], pa.int64()),
            pa.array(ids, pa.list_(pa.int32()))]


DECODE = 1 << 18  # ids decoded at a time


def _digests(voc, data, off, with_ids=False):
    n = len(off) - 1
    all_ids = [[] for _ in range(n)]
    n_tok, n_dec = np.zeros(n, np.int64), np.zeros(n, np.int64)
    h_ids = [hashlib.sha256() for _ in range(n)]
    h_dec = [hashlib.sha256() for _ in range(n)]
    for k, part, _ in encode_batch(voc, data[off[0]:off[-1]], off - off[0]):
        for i in range(0, len(part), DECODE):
            ids = part[i:i + DECODE]
            if with_ids:
                all_ids[k].extend(ids.tolist())
            text, raw = voc.decimals(ids), voc.decode(ids)
            if n_tok[k]:
                h_ids[k].update(b" ")
            h_ids[k].update(text[:-1])
            h_dec[k].update(raw)
            n_tok[k] += len(ids)
            n_dec[k] += len(raw)
    return [pa.array(n_tok), pa.array([h.hexdigest() for h in h_ids], pa.string()),
            pa.array([h.hexdigest() for h in h_dec], pa.string()), pa.array(n_dec)] + (
                [pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else [])
