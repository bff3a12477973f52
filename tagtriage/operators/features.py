"""Features (G1-G7): social scaling and sparse text vectors in long form.

Text vectors are kept as long ``(doc, term, value)`` tables: every step is
an aggregation or an equi-join on the term or the document, so the work
spreads over the cluster and only non-zeros are ever touched. ``to_vectors``
turns them into spark.ml vectors when a model needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.functions.text import word_tokens
from tagtriage.operators.packed import Packed, pack_texts
from tagtriage.operators.skew import hot_join
from tagtriage.session import cut_lineage

SOCIAL_SCALED = ["user_friends_count", "user_followers_count", "retweet_count", "favorite_count"]
SOCIAL_PASS = ["user_verified", "number_of_hashtags"]


def social_features(df: DataFrame, scaled=SOCIAL_SCALED, passthrough=SOCIAL_PASS,
                    keep: list[str] | None = None) -> DataFrame:
    """G1: min-max scale the count columns over the frame being scored
    (a constant column keeps its raw value); flags pass through as double.
    The min/max row is one aggregate, cross-joined by broadcast."""
    mm = df.agg(*[F.min(c).alias(f"_mn_{c}") for c in scaled],
                *[F.max(c).alias(f"_mx_{c}") for c in scaled])
    j = df.crossJoin(F.broadcast(mm))
    cols = [F.col(c) for c in (keep or [])]
    for c in scaled:
        mn, mx = F.col(f"_mn_{c}"), F.col(f"_mx_{c}")
        cols.append(F.when(mx == mn, F.col(c).cast("double"))
                     .otherwise((F.col(c) - mn) / (mx - mn)).alias(c))
    cols += [F.col(c).cast("double").alias(c) for c in passthrough]
    return j.select(*cols)


def term_counts(df: DataFrame, text: str, doc: str = "id", tokens=None,
                stop: list[str] | None = None, by_doc: bool = False, packed: bool = False) -> DataFrame | Packed:
    """(doc, term, tf) counts; default tokens are lower-case runs of two
    or more word characters. With ``by_doc`` the texts are dealt out by ``doc``
    first and their terms counted there, so that texts move instead of a row a
    term, and steps by document that follow need no shuffle; for documents of
    one row or a few, not for pseudo-documents of many. ``packed``, for such
    documents too, gives the counts in blocks (``operators/packed.py``)."""
    if packed:
        if tokens is not None or stop:
            raise ValueError("packed counts are of the default tokens")
        return pack_texts(df, text, doc, word_tokens)
    toks = tokens if tokens is not None else word_tokens(F.col(text))
    if by_doc:
        df = df.repartition(doc)
    ex = df.select(doc, F.explode(toks).alias("term"))
    if stop:
        ex = ex.filter(~F.col("term").isin(*stop))
    return ex.groupBy(doc, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def l2_normalise(tv: DataFrame, doc: str = "id", value: str = "value") -> DataFrame:
    """Divide by the document's L2 norm. A window over the document (its
    distinct terms, bounded by the vocabulary) replaces an aggregate joined
    back, saving one shuffle."""
    from pyspark.sql import Window
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(doc)))
    return (tv.withColumn("_norm", norm)
              .withColumn(value, F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm"))
                          .otherwise(F.lit(0.0)))
              .drop("_norm"))


def tf_vectors(tc: DataFrame, doc: str = "id") -> DataFrame:
    """Term frequencies, L2-normalised per document."""
    return l2_normalise(tc.withColumnRenamed("tf", "value"), doc)


def idf_table(tc: DataFrame, n_docs: int | None = None, doc: str = "id",
              docs: DataFrame | None = None) -> DataFrame:
    """Smoothed idf ``ln((1 + n) / (1 + df)) + 1`` per term."""
    if n_docs is None:
        n_docs = (docs if docs is not None else tc.select(doc).distinct()).count()
    return (tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
              .withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))


def _tfidf_packed(tc: Packed, idf: DataFrame | None, max_features: int | None, n_docs: int | None, normalise: bool) -> Packed:
    terms = tc.terms()
    if idf is None:
        n = n_docs if n_docs is not None else tc.docs.count()
        idf = (terms.groupBy("term").agg(F.sum("df").alias("_df"), F.sum("total").alias("_ct"))
               .withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("_df"))) + 1.0))
        if max_features:
            idf = idf.orderBy(F.col("_ct").desc(), "term").limit(max_features)
    elif max_features:
        top = (terms.groupBy("term").agg(F.sum("total").alias("_ct")).orderBy(F.col("_ct").desc(), "term").limit(max_features))
        idf = idf.join(top.select("term"), "term", "left_semi")
    weights = terms.join(idf.select("term", F.col("idf").alias("w")), "term").select("block", "idx", "term", "w")
    return Packed(tc.docs, tc.doc, weights, normalise)


def tfidf(tc: DataFrame | Packed, doc: str = "id", idf: DataFrame | None = None,
          max_features: int | None = None, n_docs: int | None = None, normalise: bool = True) -> DataFrame | Packed:
    """TF-IDF with the smoothed idf, L2-normalised -> (doc, term, value).

    ``idf`` from a fitted corpus may be passed (terms outside it drop out).
    ``max_features`` keeps the terms with the largest corpus counts (ties by
    term), a distributed top-k over the term table. The counts are stored, as
    the idf table and the weights both read them; terms that a large share of
    the documents hold are dealt out in the join. Packed counts give packed
    weights: their join is by the terms of a block, not by a row a term."""
    if isinstance(tc, Packed):
        return _tfidf_packed(tc, idf, max_features, n_docs, normalise)
    tc = cut_lineage(tc)
    if max_features:
        top = (tc.groupBy("term").agg(F.sum("tf").alias("_ct"))
                 .orderBy(F.col("_ct").desc(), "term").limit(max_features).select("term"))
        tc = tc.join(top, "term", "left_semi")
    idf = idf if idf is not None else idf_table(tc, n_docs, doc)
    tv = hot_join(tc, idf.select("term", "idf"), "term").select(doc, "term", (F.col("tf") * F.col("idf")).alias("value"))
    return l2_normalise(tv, doc) if normalise else tv


def top_terms(tv: DataFrame, n: int, doc: str = "id", value: str = "value") -> DataFrame:
    """The n highest-weighted terms per document (ties by term)."""
    from tagtriage.operators.ranking import top_n_per_group
    return top_n_per_group(tv, [doc], [F.col(value).desc(), F.col("term")], n, out="rank")


def top_features(coefs: DataFrame, k: int, value: str = "weight") -> DataFrame:
    """The k model weights largest in absolute value, with term names."""
    return coefs.orderBy(F.abs(F.col(value)).desc(), "term").limit(k)
