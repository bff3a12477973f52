"""Queries: submodular selection (M1-M21) on ``embeddings``.

Oracles unroll a few greedy rounds in SQL (k = 3) over the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtriage.operators import selection as sel
from tagtriage.operators.sampling import uniform_sql
from tagtriage.plans.util import rounded
from tagtriage.sources.tables import table

Q = {}
K = 3


def emb(spark, d, mode="raw"):
    e = table(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    if mode == "pos":
        x = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    elif mode == "bin":
        x = F.transform("embedding", lambda v: F.when(v > 0, 1.0).otherwise(0.0))
    return e.select(F.col("vec_id").alias("id"), x.alias("features"), "label",
                    (1.0 + F.col("label") % 3).alias("cost"))


FE_SQL = {
    "pos": "greatest(CAST(x AS DOUBLE), 0.0)",
    "bin": "CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END",
}


def _fe_base(mode):
    return (f"fe AS (SELECT id, d, {FE_SQL[mode]} AS x FROM (SELECT vec_id AS id, "
            "unnest(range(len(embedding))) AS d, unnest(embedding) AS x FROM embeddings)),\n"
            "cur0 AS (SELECT DISTINCT d, 0.0 AS v FROM fe)")


PHI_SQL = {"sqrt": "sqrt({x})", "min": "least({x}, 1.0)", "log": "ln(1 + {x})"}


def feature_greedy_sql(mode="pos", phi="sqrt", k=K, init_cur=None, exclude=None,
                       cost=False, budget=None, fixed_order=None):
    """SQL for greedy rounds of a feature-based objective."""
    p = PHI_SQL[phi]
    ctes = [_fe_base(mode)]
    if init_cur:
        ctes.append(init_cur)
        prev = "curI"
    else:
        prev = "cur0"
    if cost:
        ctes.append("costs AS (SELECT vec_id AS id, 1.0 + label % 3 AS c FROM embeddings)")
    picks = []
    rounds = k if not cost else int(budget / 1.0)
    for r in range(1, rounds + 1):
        excl = [f"(SELECT id FROM p{i})" for i in range(1, r)]
        cond = " AND ".join(f"fe.id NOT IN {e}" for e in excl) or "TRUE"
        if exclude:
            cond += f" AND fe.id NOT IN ({exclude})"
        gain = p.format(x=f"{prev}.v + fe.x") + " - " + p.format(x=f"{prev}.v")
        ctes.append(f"g{r} AS (SELECT fe.id, SUM({gain}) AS gain FROM fe JOIN {prev} USING (d) "
                    f"WHERE {cond} GROUP BY fe.id)")
        if fixed_order:
            ctes.append(f"p{r} AS (SELECT g{r}.id, g{r}.gain FROM g{r} JOIN ({fixed_order}) o "
                        f"ON g{r}.id = o.id WHERE o.rn = {r})")
        elif cost:
            spent = " + ".join(f"coalesce((SELECT c FROM costs WHERE id = (SELECT id FROM p{i})), 0)"
                               for i in range(1, r)) or "0"
            ctes.append(f"p{r} AS (SELECT g{r}.id, g{r}.gain FROM g{r} JOIN costs USING (id) "
                        f"WHERE costs.c <= {budget} - ({spent}) "
                        f"ORDER BY g{r}.gain / costs.c DESC, g{r}.id LIMIT 1)")
        else:
            ctes.append(f"p{r} AS (SELECT id, gain FROM g{r} ORDER BY gain DESC, id LIMIT 1)")
        ctes.append(f"cur{r} AS (SELECT {prev}.d, {prev}.v + coalesce(fe.x, 0.0) AS v FROM {prev} "
                    f"LEFT JOIN fe ON fe.d = {prev}.d AND fe.id = (SELECT id FROM p{r}))")
        prev = f"cur{r}"
        picks.append(f"SELECT id, CAST({r} AS INTEGER) AS rank, ROUND(gain, 6) AS gain FROM p{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(picks)


def _q(fn):
    return lambda s, d: rounded(fn(s, d))


Q["M7_feature_based_exact"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K)),
    feature_greedy_sql("pos", "sqrt"))

Q["M8_max_coverage"] = (
    _q(lambda s, d: sel.select(emb(s, d, "bin"), sel.MaxCoverage(), K)),
    feature_greedy_sql("bin", "min"))

Q["M7_feature_based_log"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("log"), K)),
    feature_greedy_sql("pos", "log"))

Q["M12_bounded"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K, strategy="bounded",
                               batch=8)),
    feature_greedy_sql("pos", "sqrt"))

Q["M13_two_stage"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K, strategy="two_stage",
                               n_first=1, batch=8)),
    feature_greedy_sql("pos", "sqrt"))

Q["M11_cost_budget"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), 4, cost="cost")),
    feature_greedy_sql("pos", "sqrt", cost=True, budget=4))

MODULAR_ORDER = """SELECT id, row_number() OVER (ORDER BY gain DESC, id) AS rn FROM (
  SELECT fe.id, SUM(sqrt(fe.x)) AS gain FROM fe GROUP BY fe.id) ORDER BY gain DESC, id LIMIT 3"""

Q["M17_modular"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K, strategy="modular")),
    feature_greedy_sql("pos", "sqrt", fixed_order=MODULAR_ORDER))

INITIAL_IDS = "SELECT MIN(vec_id) FROM embeddings GROUP BY label"


def _initial(s, d):
    e = emb(s, d, "pos")
    init = e.groupBy("label").agg(F.min("id").alias("id")).select("id")
    return sel.select(e, sel.FeatureBased("sqrt"), K, initial=init)


Q["M19_initial_subset"] = (_q(_initial), feature_greedy_sql(
    "pos", "sqrt", exclude=INITIAL_IDS,
    init_cur=f"""curI AS (SELECT cur0.d, SUM(coalesce(fe.x, 0.0)) AS v FROM cur0 LEFT JOIN fe
  ON fe.d = cur0.d AND fe.id IN ({INITIAL_IDS}) GROUP BY cur0.d)"""))


def _outside(s, d):
    """M19 with starting rows that are not in the table: the mean vector of each label."""
    e = emb(s, d, "pos")
    mean = F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda r: r["x"])
    init = (e.select("label", F.posexplode("features").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
            .groupBy("label").agg(mean.alias("features")).select(F.col("label").cast("long").alias("id"), "features"))
    return sel.select(e, sel.FeatureBased("sqrt"), K, initial=init)


Q["M19_outside_rows"] = (_q(_outside), feature_greedy_sql(
    "pos", "sqrt", init_cur="""means AS (SELECT label, d, avg(x) AS x FROM fe JOIN embeddings ON vec_id = id GROUP BY label, d),
curI AS (SELECT d, SUM(x) AS v FROM means GROUP BY d)"""))


def _with_source(s, d):
    e = emb(s, d, "pos")
    return sel.with_source(sel.select(e, sel.FeatureBased("sqrt"), K), e, cols=["label"])


Q["M20_picks_with_source"] = (_q(_with_source), "SELECT p.*, e.label FROM (" + feature_greedy_sql(
    "pos", "sqrt").replace("WITH ", "WITH ", 1) + ") p JOIN embeddings e ON p.id = e.vec_id")


def _m21(s, d):
    return rounded(sel.validate(emb(s, d, "raw"), K))


Q["M21_validate"] = (_m21, """SELECT COUNT(DISTINCT vec_id) AS n, ROUND(MIN(CAST(x AS DOUBLE)), 6) AS min_value,
  ROUND(MAX(CAST(x AS DOUBLE)), 6) AS max_value,
  3 >= 1 AND 3 <= COUNT(DISTINCT vec_id) AND NOT (MIN(x) < 0 AND MAX(x) > 0) AS valid
FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)""")

# ---- graph objectives with the cosine metric (pair-free on Spark) ----------
U_SQL = """u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / nrm) AS u
  FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm
        FROM (SELECT vec_id, EMB AS embedding FROM embeddings))),
S AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 1.0
        ELSE least(greatest(list_dot_product(a.u, b.u), -1.0), 1.0) ** 2 END AS s FROM u a, u b),
cs AS (SELECT i AS id, SUM(s) AS colsum FROM S GROUP BY i)"""


def graph_greedy_sql(kind="graph_cut", alpha=1.0, k=K, extra_feature=None):
    emb_expr = ("list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0))"
                if extra_feature else "embedding")
    ctes = [U_SQL.replace("EMB", emb_expr)]
    if extra_feature:
        ctes.append(_fe_base("pos"))
    picks = []
    for r in range(1, k + 1):
        prev = [f"(SELECT id FROM p{i})" for i in range(1, r)]
        red = (" + ".join(f"coalesce((SELECT s FROM S WHERE S.i = {p} AND S.j = cs.id), 0)" for p in prev)
               or "0")
        if kind == "graph_cut":
            gain = f"{alpha} * colsum - 1.0 - ({red})"
        else:
            gain = f"-(1.0 + 2 * ({red}))"
        cond = " AND ".join(f"cs.id NOT IN {p}" for p in prev) or "TRUE"
        if extra_feature:
            w, prevcur = extra_feature, ("cur0" if r == 1 else f"cur{r - 1}")
            ctes.append(f"f{r} AS (SELECT fe.id, SUM(sqrt({prevcur}.v + fe.x) - sqrt({prevcur}.v)) AS fg "
                        f"FROM fe JOIN {prevcur} USING (d) GROUP BY fe.id)")
            ctes.append(f"g{r} AS (SELECT cs.id, f{r}.fg + {w} * ({gain}) AS gain FROM cs "
                        f"JOIN f{r} ON f{r}.id = cs.id WHERE {cond})")
        else:
            ctes.append(f"g{r} AS (SELECT cs.id, {gain} AS gain FROM cs WHERE {cond})")
        ctes.append(f"p{r} AS (SELECT id, gain FROM g{r} ORDER BY gain DESC, id LIMIT 1)")
        if extra_feature:
            pc = "cur0" if r == 1 else f"cur{r - 1}"
            ctes.append(f"cur{r} AS (SELECT {pc}.d, {pc}.v + coalesce(fe.x, 0.0) AS v FROM {pc} "
                        f"LEFT JOIN fe ON fe.d = {pc}.d AND fe.id = (SELECT id FROM p{r}))")
        picks.append(f"SELECT id, CAST({r} AS INTEGER) AS rank, ROUND(gain, 6) AS gain FROM p{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(picks)


Q["M5_graph_cut"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.GraphCut(alpha=1.0), K, check=False)),
    graph_greedy_sql("graph_cut", 1.0))

Q["M6_sum_redundancy"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.SumRedundancy(), K, check=False)),
    graph_greedy_sql("sum_redundancy"))


def _mixture(s, d):
    e = emb(s, d, "pos")
    f = sel.Mixture([(sel.FeatureBased("sqrt"), 1.0), (sel.SumRedundancy(), 0.5)])
    return sel.select(e, f, K)


Q["M9_mixture"] = (_q(_mixture), graph_greedy_sql("sum_redundancy", extra_feature=0.5))


def _m1(s, d):
    """M1: cosine^2 similarity of every row to the k exact picks (a bounded,
    broadcast set; never all pairs)."""
    e = emb(s, d, "raw")
    picks = sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K)
    pv = e.join(picks.select("id", "rank"), "id").select("rank", sel._unit().alias("_p"))
    j = e.withColumn("_u", sel._unit()).crossJoin(F.broadcast(pv))
    sim = F.when(F.col("id").isNull(), None).otherwise(
        F.pow(F.least(F.greatest(sel._dot(F.col("_u"), F.col("_p")), F.lit(-1.0)), F.lit(1.0)), 2))
    return rounded(j.select("id", "rank", sim.alias("sim")))


def _m1_sql():
    g = feature_greedy_sql("pos", "sqrt")
    body, sels = g.split("\n", 1)[1].rsplit("\n", 0)[0], None
    picks = g[g.index("SELECT id, CAST(1"):]
    ctes = g[len("WITH "):g.index("SELECT id, CAST(1")].rstrip()
    return ("WITH " + ctes + ",\npk AS (" + picks + "),\n" + U_SQL + "\n"
            "SELECT u.id, pk.rank, ROUND(least(greatest(list_dot_product(u.u, pu.u), -1.0), 1.0) ** 2, 6) AS sim "
            "FROM u, pk JOIN u pu ON pu.id = pk.id").replace("EMB", "embedding")


Q["M1_similarity_to_picks"] = (_m1, _m1_sql())

# ---- randomised / partitioned strategies: rows-only -----------------------
Q["M14_stochastic"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), 10, strategy="stochastic",
                               seed=3)), None)
Q["M15_sample"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K, strategy="sample",
                               seed=3, hash="lcg")),
    feature_greedy_sql("pos", "sqrt", exclude="SELECT vec_id FROM embeddings WHERE NOT "
                       f"({uniform_sql('vec_id', 3)} < 0.9)"))
Q["M16_partitioned_facility"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.Facility(metric="cosine"), 10,
                               strategy="partitioned", part_rows=200, check=False)), None)
Q["M16_partitioned_saturated"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.Saturated(alpha=0.1), 10,
                               strategy="partitioned", part_rows=200, check=False)), None)
Q["M16_partitioned_feature"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), 10,
                               strategy="partitioned", part_rows=200)), None)
Q["M18_random"] = (
    _q(lambda s, d: sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), 10, strategy="random",
                               seed=5, hash="lcg")),
    f"""SELECT id, CAST(rn AS INTEGER) AS rank, 0.0::DOUBLE AS gain FROM (
  SELECT vec_id AS id, row_number() OVER (ORDER BY {uniform_sql('vec_id', 5)}, vec_id) AS rn FROM embeddings)
WHERE rn <= 10""")

Q["M2_partitioned_knn_facility"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.Facility(metric="euclidean", n_neighbors=10),
                               10, strategy="partitioned", part_rows=200, check=False)), None)


def _n9_phi(s, d):
    """A user-defined concave function given as a (Column, numpy) pair."""
    import numpy as np
    f = sel.FeatureBased(phi=(lambda x: F.sqrt(x), np.sqrt))
    return sel.select(emb(s, d, "pos"), f, K)


Q["N9_user_defined_phi"] = (_q(_n9_phi), feature_greedy_sql("pos", "sqrt"))


def _n9_strategy(s, d):
    """A user-defined strategy callable: skip rows whose features are
    all zero (they can add nothing), then run the built-in exact greedy."""
    def non_empty_rows(base, f, k, **kw):
        useful = base.filter(F.exists("features", lambda x: x != 0))
        return sel.select(useful, f, k, check=False)
    return sel.select(emb(s, d, "pos"), sel.FeatureBased("sqrt"), K, strategy=non_empty_rows)


Q["N9_user_defined_strategy"] = (_q(_n9_strategy), feature_greedy_sql("pos", "sqrt"))


def pairwise_greedy_sql(kind="facility", alpha=0.1, k=K):
    """Unrolled greedy rounds for facility location / saturated coverage
    over the full pairwise table (the oracle may build every pair)."""
    ctes = [U_SQL.replace("EMB", "embedding"),
            "cap AS (SELECT i AS j, " + str(alpha) + " * SUM(s) AS cap FROM S GROUP BY i)",
            "cur0 AS (SELECT j, 0.0 AS c FROM cap)"]
    picks = []
    for r in range(1, k + 1):
        prev = f"cur{r - 1}"
        excl = " AND ".join(f"S.i NOT IN (SELECT id FROM p{x})" for x in range(1, r)) or "TRUE"
        if kind == "facility":
            g = f"SUM(greatest(S.s, {prev}.c)) - (SELECT SUM(c) FROM {prev})"
            upd = f"greatest({prev}.c, S.s)"
            join_cap = ""
        else:
            g = f"SUM(least({prev}.c + S.s, cap.cap)) - (SELECT SUM(c) FROM {prev})"
            upd = f"least({prev}.c + S.s, cap.cap)"
            join_cap = f" JOIN cap ON cap.j = S.j"
        ctes.append(f"g{r} AS (SELECT S.i AS id, {g} AS gain FROM S JOIN {prev} ON S.j = {prev}.j"
                    f"{join_cap} WHERE {excl} GROUP BY S.i)")
        ctes.append(f"p{r} AS (SELECT id, gain FROM g{r} ORDER BY gain DESC, id LIMIT 1)")
        ctes.append(f"cur{r} AS (SELECT {prev}.j, {upd} AS c FROM {prev} JOIN S ON S.j = {prev}.j"
                    f"{join_cap if kind != 'facility' else ''} WHERE S.i = (SELECT id FROM p{r}))")
        picks.append(f"SELECT id, CAST({r} AS INTEGER) AS rank, ROUND(gain, 6) AS gain FROM p{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(picks)


Q["M3_facility_location"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.Facility(metric="cosine"), K, check=False)),
    pairwise_greedy_sql("facility"))

Q["M4_saturated_coverage"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.Saturated(alpha=0.1), K, check=False)),
    pairwise_greedy_sql("saturated", 0.1))


def knn_facility_sql(n_neighbors=10, k=K):
    """Greedy rounds over the kept neighbours: each row keeps itself and its
    nearest others; similarity counts from the largest kept distance."""
    ctes = ["""v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
dist AS (SELECT a.id AS i, b.id AS j, CASE WHEN a.id = b.id THEN 0.0 ELSE greatest(list_dot_product(a.e, a.e)
    + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e), 0.0) END AS d FROM v a, v b),
kept AS (SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY i <> j, d, j) AS r FROM dist)
  WHERE r <= """ + str(n_neighbors + 1) + """),
E AS (SELECT i, j, (SELECT max(d) FROM kept) - d AS s FROM kept),
cur0 AS (SELECT vec_id AS j, 0.0 AS c FROM embeddings)"""]
    picks = []
    for r in range(1, k + 1):
        prev = f"cur{r - 1}"
        cond = " AND ".join(f"E.i NOT IN (SELECT id FROM p{x})" for x in range(1, r)) or "TRUE"
        ctes.append(f"g{r} AS (SELECT E.i AS id, SUM(greatest(E.s, {prev}.c) - {prev}.c) AS gain "
                    f"FROM E JOIN {prev} USING (j) WHERE {cond} GROUP BY E.i)")
        ctes.append(f"p{r} AS (SELECT id, gain FROM g{r} ORDER BY gain DESC, id LIMIT 1)")
        ctes.append(f"cur{r} AS (SELECT {prev}.j, greatest({prev}.c, coalesce(E.s, 0.0)) AS c FROM {prev} "
                    f"LEFT JOIN E ON E.j = {prev}.j AND E.i = (SELECT id FROM p{r}))")
        picks.append(f"SELECT id, CAST({r} AS INTEGER) AS rank, ROUND(gain, 6) AS gain FROM p{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(picks)


Q["M2_knn_facility"] = (
    _q(lambda s, d: sel.select(emb(s, d, "raw"), sel.Facility(metric="euclidean", n_neighbors=10), K, check=False)),
    knn_facility_sql())


def _edges(s, d):
    """A similarity that the caller computes: how close the prices of two orders of
    one customer are."""
    o = table(s, d, "orders")
    a, b = (o.select("o_custkey", F.col("o_orderkey").alias(k), F.col("o_totalprice").cast("double").alias(f"p{k}")) for k in "ij")
    return a.join(b, "o_custkey").select("i", "j", (F.least("pi", "pj") / F.greatest("pi", "pj")).alias("s"))


EDGES_SQL = """S AS (SELECT a.o_orderkey AS i, b.o_orderkey AS j, least(a.o_totalprice::DOUBLE, b.o_totalprice::DOUBLE)
    / greatest(a.o_totalprice::DOUBLE, b.o_totalprice::DOUBLE) AS s FROM orders a JOIN orders b USING (o_custkey)),
cap AS (SELECT i AS j, 0.1 * sum(s) AS cap FROM S GROUP BY i),
cur0 AS (SELECT j, 0.0 AS c FROM cap)"""


def edge_greedy_sql(kind, k=K):
    ctes, picks = [EDGES_SQL], []
    for r in range(1, k + 1):
        prev = f"cur{r - 1}"
        new = f"greatest({prev}.c, S.s)" if kind == "facility" else f"least({prev}.c + S.s, cap.cap)"
        cond = " AND ".join(f"S.i NOT IN (SELECT id FROM p{x})" for x in range(1, r)) or "TRUE"
        ctes.append(f"""g{r} AS (SELECT S.i AS id, sum({new} - {prev}.c) AS gain FROM S JOIN {prev} USING (j) JOIN cap USING (j)
  WHERE {cond} GROUP BY S.i),
p{r} AS (SELECT id, gain FROM g{r} ORDER BY round(gain, 6) DESC, id LIMIT 1),
cur{r} AS (SELECT {prev}.j, CASE WHEN S.s IS NULL THEN {prev}.c ELSE {new} END AS c
  FROM {prev} JOIN cap USING (j) LEFT JOIN S ON S.j = {prev}.j AND S.i = (SELECT id FROM p{r}))""")
        picks.append(f"SELECT id, CAST({r} AS INTEGER) AS rank, ROUND(gain, 6) AS gain FROM p{r}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(picks)


Q["M1_precomputed_facility"] = (_q(lambda s, d: sel.select_edges(_edges(s, d), sel.Facility(), K)), edge_greedy_sql("facility"))
