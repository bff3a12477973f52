"""Exact top-k search by inner product.

Candidates are put in order of descending length and cut into blocks; vectors
are turned by the singular vectors of the candidates, so that the first few
coordinates hold most of every product. A query visits blocks from the longest
on. Cauchy-Schwarz prunes twice: a block whose longest vector times the query
can't reach the query's k-th best score is never joined, and inside a block the
partial sum over the first coordinates plus the product of the two residual
lengths bounds each score. What remains is scored in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows, store

BLOCK = 8192  # candidates a block
QUERIES = 4096  # queries a block
HEAD = 16  # turned coordinates in the partial sums
SEEDS = 2048  # longest candidates that give the first k-th best scores
CHUNK = 1024  # candidates scored at a time


def quantised(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that
    is null or holds null or a non-finite component."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def rotation(cands: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the candidates, greatest singular value first:
    partial Gram matrices (dim x dim) are summed by Spark."""
    def grams(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim).astype(float)
            g += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g[i, j])], ["i", "j", "g"])

    if dim == 0:
        return np.zeros((0, 0))
    rows = (cands.select("v").mapInArrow(grams, "i long, j long, g double")
            .groupBy("i", "j").agg(F.sum("g").alias("g")).collect())  # dim * (dim + 1) / 2 numbers
    g = np.zeros((dim, dim))
    for r in rows:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return np.linalg.eigh(g)[1][:, ::-1].copy()


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where no sum leaves 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, id) of each query so far: higher scores first, then
    smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.n = n

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = (np.concatenate(x) for x in ((self.row, row), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, np.arange(self.n))
        rank = np.arange(len(row)) - first[row]
        keep = rank < self.k
        self.row, self.id, self.score = row[keep], ids[keep], score[keep]
        full = rank == self.k - 1
        self.least[row[full]] = np.maximum(self.least[row[full]], score[full])


def search_block(qid, q, least, cid, c, turn, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate id, score) of each query's best k in one block,
    without what can't reach ``least``."""
    norm_c, norm_q = np.sqrt((c.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
    order = np.argsort(-norm_c, kind="stable")
    c, cid, norm_c = c[order], cid[order], norm_c[order]
    h = min(HEAD, q.shape[1])
    tq, tc = q @ turn[:, :h], c @ turn[:, :h]
    # the residuals' lengths, and all sums, a little too long rather than too short
    rq = np.sqrt(np.maximum(norm_q ** 2 - (tq ** 2).sum(1), 0) + 1e-9 * norm_q ** 2)
    rc = np.sqrt(np.maximum(norm_c ** 2 - (tc ** 2).sum(1), 0) + 1e-9 * norm_c ** 2)
    best = Best(len(q), k, least)
    for a in range(0, len(c), CHUNK):
        live = np.flatnonzero(norm_q * norm_c[a] * (1 + 1e-9) + 1e-6 >= best.least)
        if not len(live):
            break  # all later candidates are shorter
        b = min(a + CHUNK, len(c))
        bound = tq[live] @ tc[a:b].T + rq[live, None] * rc[None, a:b]
        bound += 1e-6 + 1e-9 * norm_q[live, None] * norm_c[None, a:b]
        may = bound >= best.least[live, None]
        some = np.flatnonzero(may.any(1))
        cols = np.flatnonzero(may.any(0))
        if not len(some):
            continue
        rows, here = live[some], cid[a:b][cols]
        score = exact_product(q[rows], c[a:b][cols])
        ok = may[np.ix_(some, cols)] & (score >= best.least[rows, None]) & (here[None, :] != qid[rows, None])
        if ok.shape[1] > k:  # keep the k best a row before sorting; columns by id break ties
            by_id = np.argsort(here, kind="stable")
            here, score, ok = here[by_id], score[:, by_id], ok[:, by_id]
            low = np.iinfo(np.int64).min
            put = np.where(ok, score, low)
            kth = -np.partition(-put, k - 1, axis=1)[:, k - 1] if put.min() > low else _kth(put, k)
            above = put > kth[:, None]
            tie = ok & (put == kth[:, None])
            room = k - above.sum(1)
            ok = (above & ok) | (tie & (np.cumsum(tie, axis=1) <= room[:, None]))
        r, s = np.nonzero(ok)
        best.add(rows[r], here[s], score[r, s])
    return best.row, best.id, best.score


def _kth(put: np.ndarray, k: int) -> np.ndarray:
    """k-th greatest of each row, where the least number can't be negated."""
    return np.partition(put, put.shape[1] - k, axis=1)[:, put.shape[1] - k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """For each query (a row of ``vectors`` for which ``is_query`` holds) its k
    highest inner products with all other rows: query_id, rank (from 1), vec_id,
    score; all rows if there are fewer; ties go to the smaller id.

    ``vec_col`` holds array<long>; null vectors and null ids take no part, and
    vectors meet those of their own dimension only. Rows that share the query's
    id are the query's own; other repeated rows count once each. Equal vectors
    tie; a run of them is cut into blocks by id like any other. Other columns
    are ignored.

    Every pair (query block, candidate block) that the bound allows is one
    group of bounded size; per query at most k rows leave it."""
    arrow_rows(vectors.sparkSession, 4096)
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = store(rows.where("id IS NOT NULL AND v IS NOT NULL")
                 .withColumn("dim", F.size("v"))
                 .withColumn("len", F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double")),
                                                       F.lit(0.0), lambda s, x: s + x * x))), "vectors")
    schema = "query_id long, vec_id long, score long"
    parts = []
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():  # a row a dimension
        parts.append(_one_dimension(rows.where(F.col("dim") == r["dim"]), r["dim"], r["n"], k, schema))
    if not parts:
        best = spark.createDataFrame([], schema)
    else:
        best = parts[0]
        for p in parts[1:]:
            best = best.unionByName(p)
    # the k best of a query's blocks: at most k rows a block
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def block_pairs(blocks: DataFrame, asks: DataFrame, spans: DataFrame, q_blocks: int) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates), each row beside the blocks (qb, cb) where it is wanted.

    Queries are put into blocks by the length a candidate needs to reach their
    least score, so that a block's queries want much the same candidates. A
    candidate block goes to the query blocks that want it, not to all."""
    if q_blocks > 1:
        asks = store(asks.repartitionByRange(q_blocks, F.col("least") / F.greatest("len", F.lit(1e-300)), "id")
                     .withColumn("qb", F.spark_partition_id()), "query-blocks")
    else:
        asks = asks.withColumn("qb", F.lit(0))
    # every block that may still hold a score good enough (one row a block: the bound on its length)
    wanted = asks.join(F.broadcast(spans), F.col("len") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
    to = wanted.groupBy("cb").agg(F.collect_set("qb").alias("to"))  # at most q_blocks numbers a block
    given = (blocks.join(to, "cb").select(F.col("cb").alias("to_cb"), F.col("id").alias("cid"), F.col("v").alias("cv"),
                                          F.explode("to").alias("to_qb")))
    return wanted.select("qb", "cb", "id", "v", "least"), given


def _one_dimension(rows: DataFrame, dim: int, n: int, k: int, schema: str) -> DataFrame:
    spark = rows.sparkSession
    turn = rotation(rows, dim)
    n_blocks = -(-n // BLOCK)
    # blocks by descending length, ties by id
    blocks = (rows.repartitionByRange(n_blocks, F.col("len").desc(), "id")
              .withColumn("cb", F.spark_partition_id()).select("id", "v", "len", "cb")) if n_blocks > 1 else \
        rows.select("id", "v", "len", F.lit(0).alias("cb"))
    blocks = store(blocks, "blocks")
    spans = blocks.groupBy("cb").agg(F.max("len").alias("longest"))  # a row a block
    # first k-th best scores: the longest candidates (bounded by SEEDS) against all queries
    seeds = rows.orderBy(F.col("len").desc(), "id").limit(SEEDS).select("id", "v").toArrow()
    sid, sv = seeds["id"].to_numpy(), _matrix(seeds["v"], dim)

    def first(batches):
        for b in batches:
            qid, q = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            score = exact_product(q, sv).astype(float)
            score[qid[:, None] == sid[None, :]] = -np.inf
            if score.shape[1] > k:
                least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            else:
                least = np.full(len(qid), -np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(least)],
                                             ["id", "v", "len", "least"])

    asks = store(rows.where("asks").select("id", "v", "len")
                 .mapInArrow(first, "id long, v array<long>, len double, least double"), "queries")
    q_blocks = max(1, -(-asks.count() // QUERIES))
    wanted, given = block_pairs(blocks, asks, spans, q_blocks)
    shared = spark.sparkContext.broadcast(turn)  # dim x dim

    def pair(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if not qs.num_rows or not cs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64())})
        qid = qs["id"].to_numpy()
        row, cid, score = search_block(qid, _matrix(qs["v"], dim), qs["least"].to_numpy(), cs["cid"].to_numpy(),
                                       _matrix(cs["cv"], dim), shared.value, k)
        return pa.table({"query_id": qid[row], "vec_id": cid, "score": score})

    return (wanted.groupBy("qb", "cb")
            .cogroup(given.groupBy("to_qb", "to_cb")).applyInArrow(pair, schema))
