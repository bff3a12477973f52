"""Byte-level BPE against the public tokenizer library."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tagtriage.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    voc = bpe.vocabulary(PATH)
    return voc, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})


PIECES = ["'", "s", "t", "re", "ve", "ll", "l", "r", "d", "m", "e", " ", "  ", "\n", "\t", " ", "\u0085", "　",
          "A", "é", "7", "٣", "½", "!", "..", "日本", "😀", "\x00", "x" * 60, "'S"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=12).map("".join), min_size=1, max_size=5))
def test_same_ids_as_the_library(both, texts):
    voc, enc = both
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    got = [[] for _ in texts]
    for k, ids, at in bpe.encode_batch(voc, np.frombuffer(b"".join(raw), np.uint8), off):
        assert bytes(voc.decode(ids)) == raw[k][at:at + len(voc.decode(ids))]
        got[k] += ids.tolist()
    assert got == [enc.encode_ordinary(t) for t in texts]


def test_scan_equals_stepping():
    rng = np.random.default_rng(0)
    gens, _, apply, _ = bpe.monoid()
    for n in (1, 5, 63, 64, 65, 200, 5000):
        sym = rng.integers(0, 20, n)
        state, want = bpe.BEGIN, []
        for c in sym.tolist():
            state = bpe.step(bpe.BEGIN if c >= 10 else state, c % 10)
            want.append(state)
        got = apply[bpe.scan(gens[sym]).astype(int) * bpe.N_STATES + bpe.BEGIN]
        assert got.tolist() == want


def test_long_slices_and_chunks(both, monkeypatch):
    voc, enc = both
    text = "ab" * 3000 + " it's " + "z" * 5000 + " word" * 300
    assert bpe.encode_text(voc, text) == enc.encode_ordinary(text)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    assert bpe.encode_text(voc, text) == enc.encode_ordinary(text)


def test_frame(spark, odd, empty, both):
    _, enc = both
    rows = bpe.encode_decode_digests(odd, PATH, with_ids=True).collect()
    want = {}
    for r in odd.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.setdefault(r.doc_id, []).append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                              hashlib.sha256((r.text or "").encode()).hexdigest(), ids))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.encode(empty, PATH).count() == 0
