"""The pipeline, stage by stage, against brute force on a small table with planted cases."""

import hashlib
import os
import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tagtriage.llm import bpe
from tests_llm_brute import brute_classes, brute_lines


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ta", "ri", "mo", "ken", "lu") for b in ("sel", "vor", "nim", "dra", "pe", "tho")]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    notice = "All rights reserved by the owners of this page."
    docs, labels = [], []
    for i in range(700):
        kind = rnd.choice(["good", "good", "good", "toxic", "poor"])
        lines = [prose(rnd.randint(8, 30)) for _ in range(rnd.randint(1, 5))]
        if kind == "toxic":
            lines = [x.replace(" ", " vileword ", 2) for x in lines]
        if kind == "poor":
            lines = [x.replace(" ", "%%% ") for x in lines]
        if i % 9 == 0:
            lines.insert(rnd.randint(0, len(lines)), notice)
        text = "\n".join(lines)
        docs.append((i, text, "en", f"s{i % 4}" if i % 3 else "hot", len(text)))
        labels.append((i, 0 if kind == "poor" else 1, int(kind == "toxic")))
    good = [d for d, x in zip(docs, labels, strict=True) if x[1] == 1 and x[2] == 0 and len(d[1].split()) > 60][:20]
    for k, d in enumerate(good):  # exact and near copies
        parts = d[1].split(" ")
        if k % 2:
            parts[len(parts) // 2] = "changed"
        docs.append((1000 + k, " ".join(parts), "en", "hot", 1))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    return folder, {d[0]: d[1] for d in docs}, {x[0]: x for x in labels}


def test_stages(spark, corpus):
    folder, text, labels = corpus
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet"))
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, folder), "test")
        assert docs.columns == before.columns
        got[name] = (before.collect(), docs.collect())
    before, after = got["quality classifier"]
    kept = {r.doc_id for r in after}
    good = {i for i in text if i >= 1000 or labels[i][1:] == (1, 0)}
    assert len(kept ^ good) <= 0.01 * len(text)
    before, after = got["line dedup"]
    want = {i: t for i, t, _, _ in brute_lines([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after) and sum(len(r.text) for r in after) < sum(len(r.text) for r in before)
    before, after = got["near-duplicate dedup"]
    classes = brute_classes([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == set(classes.values()) and len(after) < len(before)
    before, after = got["source mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    share = {k: sum(len(r.text) for r in after if r.source == k) for k in ("hot", "s1")}
    assert share["hot"] > 0 and share["s1"] > 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(rows) == len(after)
    voc = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})
    clean = {r.doc_id: r.text for r in after}
    for r in rows:
        assert list(r.ids) == enc.encode_ordinary(clean[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].encode()).hexdigest()


def test_run_equals_stages(spark, corpus):
    folder, _, _ = corpus
    a = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    b = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert a == b and a


def test_odd_rows(spark, odd, empty, corpus):
    folder, _, _ = corpus
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.store(stage(spark, docs, folder), "test")
            assert docs.dtypes == odd.dtypes
            for r in docs.select("keep", "n_lines", "copy", "place", "h", "ids").distinct().collect():
                assert tuple(r) == (7,) * 6  # what the input had there, not what an operator writes
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
