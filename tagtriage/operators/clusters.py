"""K-means on sparse vectors (E11, E15): no centre or vocabulary is held anywhere
whole.

Vectors are packed by document in blocks (``operators/packed.py``), centres are
(cluster, term, value) rows. As |x - c|^2 = |x|^2 + |c|^2 - 2 x.c, a row's nearest
centre needs its products with the centres that share a term with it: a block
gets the centres' entries of its own terms, a row a term, gives its rows' nearest
centres and, a row a term again, its share of the new centres' sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtriage.operators.packed import Packed, pack_rows
from tagtriage.operators.sampling import uniform
from tagtriage.session import stored


def first_centres(vectors: Packed, k: int, seed: int = 1, hash: str = "xx") -> DataFrame:
    """The vectors of k rows drawn by seed, as centres 0 to k - 1."""
    ids = vectors.docs.select(F.col("doc").alias("id"))
    drawn = (ids.select("id", uniform("id", seed, hash).alias("_u")).orderBy("_u", "id").limit(k)
             .select("id", (F.row_number().over(Window.orderBy("_u", "id")) - 1).alias("cluster")))  # k rows
    return stored(vectors.of(drawn.withColumnRenamed("id", vectors.doc)).select("cluster", "term", "value"))


def nearest(vectors: Packed, centres: DataFrame, sums: bool = True) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of every row, ties to the smaller cluster, and the sums of the
    rows of each cluster, (term, cluster, s), a row a block, if asked for. One pass
    over the blocks, stored. Rows without an id have no part in the sums."""
    sq = {r["cluster"]: r["sq"] for r in centres.groupBy("cluster").agg(F.sum(F.col("value") * F.col("value")).alias("sq")).collect()}  # a number a cluster
    order = sorted(sq)
    kind = vectors.docs.schema["doc"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("term", T.StringType()),
                           T.StructField("clusters", T.ArrayType(T.IntegerType())), T.StructField("s", T.ArrayType(T.DoubleType())),
                           T.StructField("is_row", T.BooleanType())])

    def assign(doc, row, idx, val, terms, given):
        n, k = len(doc), len(terms)
        places = given.column("idx").to_numpy()
        lists = [given.column(c).combine_chunks() for c in ("clusters", "values")]
        lists = [pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        at = np.repeat(places, lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        cl, cv = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        by = np.argsort(cl, kind="stable")
        at, cl, cv = at[by], cl[by], cv[by]
        best, to = np.full(n, np.inf), np.full(n, order[0] if order else -1, "int32")
        for c in order:
            a, b = np.searchsorted(cl, [c, c + 1])
            col = np.zeros(k)
            np.add.at(col, at[a:b], cv[a:b])
            far = np.round(sq[c] - 2 * np.bincount(row, val * col[idx], minlength=n), 12)
            closer = far < best
            best[closer], to[closer] = far[closer], c
        held = np.zeros(n, bool)
        held[row] = True  # rows of which a term is known
        ids = pa.concat_arrays(doc.chunks)
        m = int(held.sum())
        empty = lambda j, t: pa.nulls(j, t)
        told = pa.table({"id": ids.filter(pa.array(held)), "cluster": pa.array(to[held], pa.int32(), mask=np.full(m, not order)), "term": empty(m, pa.string()),
                         "clusters": empty(m, pa.list_(pa.int32())), "s": empty(m, pa.list_(pa.float64())), "is_row": pa.array(np.ones(m, bool))})
        if not sums or not order:
            return told
        known = ids.is_valid().to_numpy(zero_copy_only=False)[row]
        width = order[-1] + 1
        key, place = np.unique(idx[known].astype("int64") * width + to[row[known]], return_inverse=True)
        s = np.bincount(place, val[known], minlength=len(key))
        term, cluster = np.divmod(key, width)
        held_terms, starts = np.unique(term, return_index=True)
        starts = pa.array(np.r_[starts, len(key)], pa.int32())
        j = len(held_terms)
        added = pa.table({"id": pa.nulls(j, ids.type), "cluster": empty(j, pa.int32()), "term": terms.take(pa.array(held_terms)),
                          "clusters": pa.ListArray.from_arrays(starts, pa.array(cluster.astype("int32"))), "s": pa.ListArray.from_arrays(starts, pa.array(s)),
                          "is_row": pa.array(np.zeros(j, bool))})
        return pa.concat_tables([told, added])

    entries = centres.groupBy("term").agg(F.collect_list(F.struct("cluster", "value")).alias("_c"))  # at most a pair a cluster
    given = vectors.weights.join(entries, "term", "left").select("block", "idx", "w", F.col("_c.cluster").alias("clusters"), F.col("_c.value").alias("values"))
    out = stored(vectors.by_block(assign, schema, given))
    added = out.filter(~F.col("is_row")).select("term", F.explode(F.arrays_zip("clusters", "s")).alias("_a"))
    return out.filter("is_row").select("id", "cluster"), added.select("term", F.col("_a.clusters").alias("cluster"), F.col("_a.s").alias("s"))


def moved(added: DataFrame, assigned: DataFrame, centres: DataFrame) -> DataFrame:
    """The mean vector of every cluster; a cluster without rows stays where it is."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    new = (added.groupBy("cluster", "term").agg(F.sum("s").alias("s"))
           .join(F.broadcast(sizes), "cluster").select("cluster", "term", (F.col("s") / F.col("n")).alias("value")))
    return new.unionByName(centres.join(F.broadcast(sizes.select("cluster")), "cluster", "left_anti"))


def kmeans(vectors: DataFrame | Packed, k: int = 13, rounds: int = 20, seed: int = 1, hash: str = "xx") -> tuple[DataFrame, DataFrame]:
    """Centres (cluster, term, value) and the rows' clusters (id, cluster) after
    ``rounds`` rounds, or when no row changes its cluster. ``vectors``: packed, or (id,
    term, value), a row a term; each round stores its two tables."""
    packed = vectors if isinstance(vectors, Packed) else pack_rows(vectors)
    weights = packed.weights if packed.weights is not None else packed.terms().select("block", "idx", "term", F.lit(1.0).alias("w"))
    # both lie where a round looks them up, so that only the centres' entries move in a round
    parts = int(packed.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = packed.docs.select("block", "doc", "idx", "val", "terms").repartition(parts, "block").persist(StorageLevel.DISK_ONLY)
    weights = stored(weights).repartition(parts, "term").persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(Packed(docs, packed.doc, weights, packed.normalise), k, rounds, seed, hash)
    finally:
        docs.unpersist()
        weights.unpersist()


def _fitted(packed: Packed, k: int, rounds: int, seed: int, hash: str) -> tuple[DataFrame, DataFrame]:
    centres = first_centres(packed, k, seed, hash)
    before = None
    for r in range(rounds + 1):
        assigned, added = nearest(packed, centres, sums=r < rounds)
        if r == rounds or before is not None and not assigned.join(before, ["id", "cluster"], "left_anti").limit(1).count():
            break
        centres, before = stored(moved(added, assigned, centres)), assigned
    return centres, assigned


def heaviest_terms(centres: DataFrame, n: int = 25) -> DataFrame:
    """(cluster, term, weight, rank), the n heaviest terms a centre, ties by term."""
    from tagtriage.operators.ranking import top_n_per_group
    top = top_n_per_group(centres, ["cluster"], [F.round("value", 12).desc(), F.col("term")], n, out="rank")
    return top.select("cluster", "term", F.col("value").alias("weight"), "rank")
