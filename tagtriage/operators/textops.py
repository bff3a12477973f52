"""Text operators that need DataFrame-level work (D6/D7 joins, D14, D15).

Vocabulary jobs replace per-row library calls: distinct tokens are looked up
once by an equi-join against a (form, value) table, then the texts are
rebuilt. Phrase detection counts unigrams and adjacent pairs with partial
aggregates; pairs come from zipping each token array with its own shifted
copy inside the row, so no window or per-document shuffle is needed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.operators.skew import hot_join
from tagtriage.session import cut_lineage, stored


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` stored, with a row number of its own in ``_row``: ids may repeat or be
    null, and a row's words must come back to that row."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


def split_words(col: str) -> F.Column:
    return F.filter(F.split(F.trim(F.col(col)), r"\s+", -1), lambda w: w != "")


def apply_vocab(df: DataFrame, col: str, vocab: DataFrame, id_col: str = "id",
                out: str | None = None, form: str = "form", value: str = "value") -> DataFrame:
    """Split ``col`` on whitespace, map every word through ``vocab``
    (a row a form; identity when absent), re-join with one space.

    The words of a row stay together by a row number of its own, so repeated and
    null ids do no harm. A text looks up its distinct words only; words that a
    large share of the texts hold are dealt out (``hot_join``). Rows with no
    words come back as ''."""
    out = out or col
    keyed = _keyed(df)
    words = keyed.select("_row", F.explode(F.array_distinct(split_words(col))).alias("w"))
    v = vocab.select(F.col(form).alias("w"), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    # forms that are their own value change nothing
    known = (hot_join(words, v.where(F.col("w") != F.col("_v")), "w").groupBy("_row")
             .agg(F.collect_list(F.struct("w", "_v")).alias("_m")))
    return (keyed.join(known, "_row", "left")
            .withColumn(out, F.coalesce(_replaced()(split_words(col), F.col("_m.w"), F.col("_m._v")), F.lit("")))
            .drop("_m", "_row"))


def _replaced():
    """(words, forms, values) -> text: a hash look-up a word, where a map in an
    expression is searched from its start."""
    def replace(words: pd.Series, forms: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for ws, fs, vs in zip(words, forms, values):
            known = {} if fs is None else dict(zip(fs, vs))
            out.append(None if ws is None else " ".join([known.get(w, w) for w in ws]))
        return pd.Series(out)
    return F.pandas_udf(replace, "string")


def verb_lemmas(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame, word: str = "form") -> DataFrame:
    """D6 vocabulary of verb lemmas, (form, value), for the distinct ``words``:
    a form in ``exceptions`` (form, value) has its value there; a form in
    ``lexicon`` (form) is its own lemma; else the endings of DETACH are taken off
    in order, and the first result that ``lexicon`` holds is the lemma. Forms
    without lemma are left out (``apply_vocab`` keeps them as they are)."""
    forms = cut_lineage(words.select(F.col(word).alias("form")).where("form IS NOT NULL").distinct())
    tries = [F.struct(F.lit(0).alias("r"), F.col("form").alias("value"))]
    for r, (end, put) in enumerate(DETACH, 1):
        cut = F.concat(F.expr(f"substring(form, 1, length(form) - {len(end)})"), F.lit(put))
        tries.append(F.when(F.endswith("form", F.lit(end)) & (F.length("form") > len(end)),
                            F.struct(F.lit(r).alias("r"), cut.alias("value"))))
    rows = forms.select("form", F.explode(F.array_compact(F.array(*tries))).alias("t")).select("form", "t.r", "t.value")
    good = rows.join(lexicon.select(F.col("form").alias("value")).distinct(), "value", "left_semi")
    by_rule = good.groupBy("form").agg(F.min_by("value", "r").alias("value"))
    known = forms.join(exceptions.select("form", "value"), "form")
    return known.unionByName(by_rule.join(known, "form", "left_anti"))


# Endings of English verbs and what takes their place, in the order they are tried.
DETACH = [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")]


def adjacent_pairs(tokens: str) -> F.Column:
    t = F.col(tokens)
    n = F.size(t)
    pairs = F.arrays_zip(F.slice(t, 1, n - 1).alias("a"), F.slice(t, 2, n - 1).alias("b"))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def phrases(df: DataFrame, tokens: str, min_count: int = 5,
            threshold: float = 100.0) -> DataFrame:
    """Bigram phrases with the published count score
    ``(n_ab - min_count) * |vocab| / (n_a * n_b)`` > threshold, where the
    vocabulary counts distinct unigrams plus distinct bigrams.
    -> (a, b, n_ab, score).

    One pass over the texts counts words and pairs together; the stored counts
    serve the vocabulary size and both look-ups. Of pairs that can't score, the
    most of all, only their number is stored. Hot words of the joins are dealt out."""
    words = F.transform(tokens, lambda w: F.struct(w.alias("a"), F.lit(None).cast("string").alias("b")))
    every = df.select(F.inline(F.concat(words, adjacent_pairs(tokens)))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    kept = F.col("b").isNull() | (F.col("n") > min_count) if threshold >= 0 else F.lit(True)
    counts = stored(every.groupBy(kept.alias("kept"), F.when(kept, F.col("a")).alias("a"), F.when(kept, F.col("b")).alias("b"))
                    .agg(F.sum("n").alias("n"), F.count(every["a"]).alias("words")), free=True)
    bi = counts.where("kept AND b IS NOT NULL").select("a", "b", F.col("n").alias("n_ab"))
    uni = counts.where("kept AND a IS NOT NULL AND b IS NULL")
    vocab = counts.agg(F.sum("words")).first()[0] or 0
    one = hot_join(bi, uni.select("a", F.col("n").alias("n_a")), "a")
    two = hot_join(stored(one, free=True), uni.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
    scored = two.withColumn("score", (F.col("n_ab") - min_count) * F.lit(vocab) / (F.col("n_a") * F.col("n_b")))
    return scored.filter(F.col("score") > threshold).select("a", "b", "n_ab", "score")


WORDPUNCT_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def corpus_tokens(df: DataFrame, text: str, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Tokens of all texts after removing ASCII digits (word and
    punctuation runs), kept when their lower case is in ``vocab`` or when
    they are not purely alphabetic. -> (token, n) counts."""
    toks = df.select(F.explode(F.regexp_extract_all(
        F.regexp_replace(F.col(text), "[0-9]", ""), F.lit(WORDPUNCT_RE), 0)).alias("token"))
    alpha = F.col("token").rlike(r"^\p{L}+$")
    v = vocab.select(F.lower(F.col(word)).alias("_lw")).distinct()
    in_vocab = (toks.filter(alpha).withColumn("_lw", F.lower("token"))
                    .join(v, "_lw", "left_semi").drop("_lw"))
    kept = in_vocab.unionByName(toks.filter(~alpha))
    return kept.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def pair_key(a: F.Column, b: F.Column) -> F.Column:
    """One string a pair, no two pairs alike; null where a word is."""
    return F.concat(F.length(a).cast("string"), F.lit(" "), a, F.lit(" "), b)


def _merge_held(delimiter: str):
    """(tokens, keys of the row's phrases) -> tokens, merged left to right in one walk
    with a hash set: a map in an expression is searched from its start for every
    word, and an array that grows there is copied at every word."""
    def merge(tokens: pd.Series, held: pd.Series) -> pd.Series:
        out = []
        for ws, keys in zip(tokens, held):
            if ws is None or keys is None:
                out.append(ws)
                continue
            ws, keys, done, i = list(ws), set(keys), [], 0
            while i < len(ws):
                w, nxt = ws[i], ws[i + 1] if i + 1 < len(ws) else None
                if w is not None and nxt is not None and f"{len(w)} {w} {nxt}" in keys:
                    done.append(f"{w}{delimiter}{nxt}")
                    i += 2
                else:
                    if w is not None:
                        done.append(w)
                    i += 1
            out.append(done)
        return pd.Series(out)
    return F.pandas_udf(merge, "array<string>")


# phrases up to which every task holds them all, as two 64-bit hashes each (16 MB)
MOST_HELD = 1 << 20


def _hashes(a: Column, b: Column) -> list[Column]:
    """Two hashes of a pair: 128 bits together name it."""
    return [F.xxhash64(a, b), F.xxhash64(b, F.lit("then"), a)]


def _known(phrases_df: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The phrases' hashes in order of the first; None if there are more than MOST_HELD."""
    first, second = _hashes(F.col("a"), F.col("b"))
    rows = phrases_df.where("a IS NOT NULL AND b IS NOT NULL").select(first.alias("x"), second.alias("y")).distinct()
    held = rows.limit(MOST_HELD + 1).toPandas().sort_values(["x", "y"])
    return None if len(held) > MOST_HELD else (held["x"].to_numpy(np.int64), held["y"].to_numpy(np.int64))


def _is_known(known: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs with the hashes ``x`` and ``y`` are among ``known``."""
    hit = np.zeros(len(x), bool)
    start, end = np.searchsorted(known[0], x, "left"), np.searchsorted(known[0], x, "right")
    while (open_ := start < end).any():  # one round, unless phrases share a first hash
        hit[open_] |= known[1][start[open_]] == y[open_]
        start = start + 1
    return hit


def _merge_known(known, delimiter: str):
    """(tokens, both hashes of the adjacent pairs) -> tokens, merged left to right; a
    row without a phrase stays as it is. ``known``: a broadcast of ``_known``."""
    def merge(tokens: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        held, out = known.value, []
        for ws, x, y in zip(tokens, first, second):
            hits = () if ws is None or x is None or len(x) == 0 else _is_known(held, np.asarray(x, np.int64), np.asarray(y, np.int64))
            good = [i for i in np.flatnonzero(hits) if ws[i] is not None and ws[i + 1] is not None]
            if not good:
                out.append(ws)
                continue
            done, i = [], 0
            for g in good:
                if g >= i:
                    done += [w for w in ws[i:g] if w is not None]
                    done.append(f"{ws[g]}{delimiter}{ws[g + 1]}")
                    i = g + 2
            out.append(done + [w for w in ws[i:] if w is not None])
        return pd.Series(out)
    return F.pandas_udf(merge, "array<string>")


def _merged(df: DataFrame, tokens: str, phrases_df: DataFrame, delimiter: str, out: str) -> DataFrame:
    """``df`` with its phrases merged in ``out``: in place with the phrases' hashes
    sent to every task, by joins if there are more than MOST_HELD."""
    known = _known(phrases_df)
    if known is None:
        return _merged_by_join(_keyed(df), tokens, phrases_df, delimiter, out)
    merge = _merge_known(df.sparkSession.sparkContext.broadcast(known), delimiter)
    pairs = adjacent_pairs(tokens)
    first = F.transform(pairs, lambda p: _hashes(p["a"], p["b"])[0])
    second = F.transform(pairs, lambda p: _hashes(p["a"], p["b"])[1])
    return df.withColumn(out, F.coalesce(merge(F.col(tokens), first, second), F.array().cast("array<string>")))


def _merged_by_join(keyed: DataFrame, tokens: str, phrases_df: DataFrame, delimiter: str, out: str) -> DataFrame:
    """``_merged`` of a stored table with ``_row``: pairs look up the phrases."""
    # transformed from pairs to strings first: distinct structs are found by comparing each with each
    keys = F.array_distinct(F.transform(adjacent_pairs(tokens), lambda p: pair_key(p["a"], p["b"])))
    pairs = keyed.select("_row", F.explode(keys).alias("_p")).where("_p IS NOT NULL")
    wanted = phrases_df.select(pair_key(F.col("a"), F.col("b")).alias("_p"))
    held = hot_join(pairs, wanted, "_p", "left_semi").groupBy("_row").agg(F.collect_list("_p").alias("_ph"))
    return (keyed.join(held, "_row", "left")
            .withColumn(out, F.coalesce(_merge_held(delimiter)(F.col(tokens), F.col("_ph")), F.array().cast("array<string>")))
            .drop("_ph", "_row"))


def apply_phrases(df: DataFrame, tokens: str, phrases_df: DataFrame, id_col: str = "id",
                  delimiter: str = "_", out: str | None = None) -> DataFrame:
    """Merge detected bigrams into single tokens, left to right without
    overlap (``a b c`` with phrases ab and bc gives ``a_b c``).

    A row merges its tokens in one walk, in place; beyond MOST_HELD phrases those
    of a row are found by a join and come back by a row number of its own, so
    repeated and null ids do no harm. A null token array comes back empty."""
    return _merged(df, tokens, phrases_df, delimiter, out or tokens)


def trigram_phrases(df: DataFrame, tokens: str, min_count: int = 5, threshold: float = 100.0,
                    id_col: str = "id") -> DataFrame:
    """D14 second pass: bigram phrases, merged into the texts, then the same
    detection again on the merged tokens (pairs such as ``a_b c``). The tokens
    are stored once, for both passes."""
    texts = stored(df.select(tokens))
    bi = stored(phrases(texts, tokens, min_count, threshold), free=True)
    return phrases(_merged(texts, tokens, bi, "_", tokens), tokens, min_count, threshold)
