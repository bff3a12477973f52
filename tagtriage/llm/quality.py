"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K - 1 share one weight vector over hashed text features;
ordered thresholds t_1 < ... < t_{K-1} turn a document's score s into the tail
probabilities P(grade >= j) = sigmoid(s - t_j). The expected grade is their
sum; documents are selected by the tail probability of the wanted grade.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows

# Hash space of the words: wide, so that a clean word seldom shares the slot of a telling one.
DIMS = 1 << 22
# Documented bound of the training sample: about so many labelled rows, taken by a hash of the id.
SAMPLE = 12_000
# A feature gets a weight if it is in so many sampled documents and their mean grade is so many
# standard errors off: else the noise of hundreds of indifferent words outweighs a telling one.
MIN_DOCS, MIN_Z = 4, 4.5

WORD = re.compile(r"\w+")
DOUBLED = re.compile(r"([^\w\s])\1")
SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")
# Words whose weight a worker keeps.
CACHE = 150_000
# Letters of a word's start that weigh beside the word: unseen words share them.
STEM = 4


def level(x: float) -> int:
    """0 for none, then steps of doubling from 1/512."""
    return 0 if x <= 0 else max(1, 10 + int(np.floor(np.log2(min(x, 1.0)))))


def shapes(text: str, words: list[str]) -> list[str]:
    """Coarse marks of form, hashed beside the words: shares of capitals,
    symbols, digits, doubled symbols, repeated words, and word length."""
    n, m = max(len(text), 1), max(len(words), 1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    shares = (("caps", len(re.findall("[A-Z]", text)) / n), ("sym", len(SYMBOLS.findall(text)) / n),
              ("digit", len(re.findall("[0-9]", text)) / n), ("dbl", len(DOUBLED.findall(text)) / n),
              ("again", again / m))
    return [f"\x00{k}:{level(v)}" for k, v in shares] + [f"\x00len:{min(int(n / m), 20)}"]


def word_features(word: str) -> tuple[str, ...]:
    return (word, "\x01" + word[:STEM]) if len(word) >= STEM else (word,)


def features(text: str | None) -> list[str]:
    """Each distinct lower-cased word and its start, and the form marks; a start
    counts once for each distinct word that has it."""
    text = text or ""
    words = WORD.findall(text.lower())
    return [f for w in set(words) for f in word_features(w)] + shapes(text, words)


def slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % DIMS


@dataclass(frozen=True)
class OrdinalModel:
    """slots (sorted) and their weights; every other slot weighs nothing."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def known(self) -> dict[int, float]:
        return dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True))

    def scores(self, texts: list[str | None], known: dict[int, float], cache: dict[str, float]) -> np.ndarray:
        """Scores of texts. cache: weight of each word, for the next call."""
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            t = t or ""
            words = WORD.findall(t.lower())
            parts = [known.get(slot(f), 0.0) for f in shapes(t, words)]
            for w in set(words):
                v = cache.get(w)
                if v is None:
                    if len(cache) > CACHE:
                        cache.clear()
                    cache[w] = v = sum(known.get(slot(f), 0.0) for f in word_features(w))
                parts.append(v)
            out[i] = math.fsum(parts)  # whatever the order of the words
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j), j = 1 .. K - 1, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = 1e-3,
                steps: int = 150, rate: float = 0.15) -> OrdinalModel:
    """Maximum likelihood with a ridge, by full-batch Adam. rows: feature slots
    of each document. Thresholds are kept in order as a first one plus
    exponentials. Without rows the model has no opinion: every probability is
    one half, and everything is kept."""
    thresholds = np.arange(n_grades - 1, dtype=float) - (n_grades - 2) / 2
    if not rows:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(n_grades - 1))
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slots, inv = np.unique(np.concatenate(rows), return_inverse=True)
    once = np.ones(len(inv), bool)  # rows are sorted: a slot's repeats follow it
    once[1:] = (inv[1:] != inv[:-1]) | (doc[1:] != doc[:-1])
    df = np.bincount(inv[once], minlength=len(slots))
    mean = np.bincount(inv[once], weights=grades[doc[once]], minlength=len(slots)) / np.maximum(df, 1)
    z = np.abs(mean - grades.mean()) * np.sqrt(df) / max(float(grades.std()), 1e-9)
    keep = (df >= MIN_DOCS) & (z >= MIN_Z)
    col = np.cumsum(keep) - 1
    take = keep[inv]
    doc, inv, slots = doc[take], col[inv[take]], slots[keep]
    n, d, y = len(rows), len(slots), grades
    par = np.concatenate([np.zeros(d), [thresholds[0]], np.zeros(n_grades - 2)])
    m1, m2 = np.zeros_like(par), np.zeros_like(par)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for k in range(1, steps + 1):
        w, first, gaps = par[:d], par[d], np.exp(par[d + 1:])
        t = np.concatenate([[first], first + np.cumsum(gaps)])
        s = np.bincount(doc, weights=w[inv], minlength=n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        hi, lo = sig(edge[y + 1] - s), sig(edge[y] - s)  # P(grade <= y), P(grade < y)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dhi - dlo) / n  # of the negative log likelihood
        dt = (np.bincount(y, weights=-dhi, minlength=n_grades)[:-1]
              + np.bincount(y, weights=dlo, minlength=n_grades)[1:]) / n
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(inv, weights=ds[doc], minlength=d) + l2 * w, [tail[0]], tail[1:] * gaps])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        par = par - rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.999 ** k)) + 1e-8)
    t = np.concatenate([[par[d]], par[d] + np.cumsum(np.exp(par[d + 1:]))])
    return OrdinalModel(slots, par[:d], t)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Three grades from the two marks: 0 toxic, 1 poor, 2 good; null when both are."""
    return (F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)).cast("int")


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on a bounded sample of ``ratings`` (doc_id, grade): about ``sample``
    rows, chosen by a hash of the id. Null ids and grades take no part; a
    document with several ratings counts with each."""
    spark = docs.sparkSession
    arrow_rows(spark)
    ratings = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL")
    total = ratings.count()
    if total > sample:
        ratings = ratings.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample / total))
    ratings = ratings.select(F.col("doc_id").alias("__id"), F.col("grade").cast("int").alias("__grade"))
    # about ``sample`` rows of two numbers: bounded by the parameter
    picked = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
              .join(F.broadcast(ratings), F.col("doc_id") == F.col("__id"))
              .select("doc_id", "text", F.col("__grade").alias("grade")))

    def work(batches):
        for b in batches:
            slots = [sorted(slot(f) for f in features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(slots, pa.list_(pa.int32()))],
                                             ["doc_id", "grade", "slots"])

    got = picked.mapInArrow(work, "doc_id long, grade int, slots array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    lists = got["slots"].combine_chunks() if got.num_rows else None
    rows = [] if lists is None else np.split(lists.flatten().to_numpy(), np.cumsum(
        lists.value_lengths().to_numpy())[:-1])
    return fit_ordinal(rows, got["grade"].to_numpy().astype(np.int64), n_grades)


def classify(docs: DataFrame, model: OrdinalModel, wanted: int = 2, least: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ``expected_grade`` and ``tail_probability``
    (double: P(grade >= wanted)) and ``keep`` (boolean: at least ``least``).
    Null and empty texts have form marks only. Rows are independent, so ties and
    repeated rows need no care; a column of ``docs`` with one of the new names
    is replaced. The model is a parameter of bounded size (words of the sample)."""
    new = ["expected_grade", "tail_probability", "keep"]
    arrow_rows(docs.sparkSession)
    kept = [c for c in docs.columns if c not in new]
    src = docs.select(*[docs[c] for c in kept], docs["text"].cast("string").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]]
                       + ["expected_grade double", "tail_probability double", "keep boolean"])

    def work(batches):
        known, cache = model.known(), {}
        for b in batches:
            tails = model.tails(model.scores(b.column(b.num_columns - 1).to_pylist(), known, cache))
            p = tails[:, wanted - 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(kept))] + [pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= least)],
                kept + new)

    return src.mapInArrow(work, schema)
