"""Evaluation and annotator agreement.

All metrics are single aggregates (partial, map-side combined) or small
per-distinct-score tables; curves use ``ranking.running_totals`` instead of
a global window, so no step pulls the data into one task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.operators.ranking import top_n_per_group

from tagtriage.operators.ranking import running_totals


def _ratio(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def predicted(score, ge: bool = False, threshold: float = 0.5):
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= threshold if ge else s > threshold, F.lit(1)).otherwise(F.lit(0))


def prf(df: DataFrame, score: str, label: str = "label", pos: int = 1, ge: bool = False,
        group: list[str] | None = None) -> DataFrame:
    """Precision / recall / F1 of class ``pos``; prediction = score > 0.5
    (>= with ``ge``, as for the white list); zero denominators give 0."""
    p = predicted(score, ge)
    y = F.col(label)
    agg = (df.groupBy(*(group or []))
             .agg(F.sum(F.when((p == pos) & (y == pos), 1).otherwise(0)).alias("tp"),
                  F.sum(F.when((p == pos) & (y != pos), 1).otherwise(0)).alias("fp"),
                  F.sum(F.when((p != pos) & (y == pos), 1).otherwise(0)).alias("fn"),
                  F.sum(F.when((p != pos) & (y != pos), 1).otherwise(0)).alias("tn")))
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (agg.withColumn("precision", prec).withColumn("recall", rec)
               .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall")))
               .withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"),
                                              F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))))


def confusion(df: DataFrame, pred: str, label: str = "label") -> DataFrame:
    """Confusion counts of hard predictions with hand-computed P/R/F."""
    p, y = F.col(pred), F.col(label)
    agg = df.agg(F.sum(F.when((p == 1) & (y == 1), 1).otherwise(0)).alias("tp"),
                 F.sum(F.when((p == 1) & (y != 1), 1).otherwise(0)).alias("fp"),
                 F.sum(F.when((p != 1) & (y == 1), 1).otherwise(0)).alias("fn"),
                 F.sum(F.when((p != 1) & (y != 1), 1).otherwise(0)).alias("tn"))
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (agg.withColumn("precision", prec).withColumn("recall", rec)
               .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                        F.col("precision") + F.col("recall"))))


def score_counts(df: DataFrame, score: str, label: str = "label",
                 group: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score (the curve building block)."""
    y = F.col(label)
    return (df.groupBy(*(group or []), F.col(score).alias("score"))
              .agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"),
                   F.sum(F.when(y == 1, 0).otherwise(1)).alias("neg")))


def roc_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """Exact ROC AUC with ties counted half (Mann-Whitney)."""
    sc = score_counts(df, score, label)
    r = running_totals(sc, ["score"], ["neg"], inclusive=False)
    return r.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))),
                     F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, score: str, label: str = "label",
               drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) at the distinct scores, high to low, plus
    the (0, 0) start with a null threshold. With ``drop_intermediate`` a
    point is kept only when the curve bends there (its class counts differ
    from the next threshold's), the first and last always. The next
    threshold's counts come from an equi-join on the ranged row number."""
    sc = score_counts(df, score, label).withColumn("_one", F.lit(1))
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    r = running_totals(sc, ["score"], ["pos", "neg", "_one"], descending=True)
    if drop_intermediate:
        nxt = r.select((F.col("cum__one") - 1).alias("cum__one"), F.col("pos").alias("_npos"),
                       F.col("neg").alias("_nneg"))
        r = (r.join(nxt, "cum__one", "left")
              .filter((F.col("cum__one") == 1) | F.col("_npos").isNull()
                      | (F.col("_npos") != F.col("pos")) | (F.col("_nneg") != F.col("neg"))))
    pts = (r.crossJoin(F.broadcast(tot))
            .select(F.col("score").cast("double").alias("threshold"),
                    _ratio(F.col("cum_neg"), F.col("N")).alias("fpr"),
                    _ratio(F.col("cum_pos"), F.col("P")).alias("tpr")))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_points(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """(threshold, precision, recall) from the highest score down to the
    first threshold reaching full recall, plus the (1, 0) end point."""
    sc = score_counts(df, score, label)
    tot = sc.agg(F.sum("pos").alias("P"))
    r = running_totals(sc, ["score"], ["pos", "neg"], descending=True).crossJoin(F.broadcast(tot))
    pts = (r.filter(F.col("cum_pos") - F.col("pos") < F.col("P"))
            .select(F.col("score").cast("double").alias("threshold"),
                    _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
                    _ratio(F.col("cum_pos"), F.col("P")).alias("recall")))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def to_long(df: DataFrame, cols: list[str], id_cols: list[str], name: str = "model",
            value: str = "score") -> DataFrame:
    """Unpivot model columns to (id..., model, score)."""
    return df.unpivot(id_cols, cols, name, value)


def score_models(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """One report row per model column: P/R/F1/accuracy at 0.5 and AUC."""
    long = to_long(df.select(label, *cols), cols, [label])
    m = prf(long, "score", label, group=["model"])
    # AUC per model with ranged running totals (no window holding a whole
    # model's scores in one task); the model list is the caller's columns.
    aucs = None
    for c in cols:
        a = roc_auc(df.select(label, c), c, label).select(F.lit(c).alias("model"), "auc")
        aucs = a if aucs is None else aucs.unionByName(a)
    return m.join(aucs, "model")


def error_corr(df: DataFrame, cols: list[str], label: str = "label") -> DataFrame:
    """Pearson correlation of errors ``(p >= 0.5) - y`` for every model
    pair (upper triangle), in one aggregate."""
    errs = df.select(*[(F.when(F.col(c) >= 0.5, 1.0).otherwise(0.0) - F.col(label))
                       .alias(c) for c in cols])
    pairs = list(combinations(cols, 2))
    row = errs.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stacked = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {stacked}) as (model_a, model_b, corr)")


def merge_gold(df: DataFrame, gold: DataFrame, id_col: str = "id",
               gold_col: str = "avg_answer") -> DataFrame:
    """Inner join with crowd gold and recode it: hard 0 -> -1,
    hijacked -1 -> 1, valid 1 -> 0 (column ``g_label``)."""
    g = gold.select(F.col(id_col), F.col(gold_col).alias("_g"))
    rec = (F.when(F.col("_g") == 0, -1).when(F.col("_g") == -1, 1)
            .when(F.col("_g") == 1, 0).otherwise(F.col("_g")))
    return df.join(g, id_col, "inner").withColumn("g_label", rec.cast("int")).drop("_g")


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Total / hard (-1) / hijacked (1) / valid (0) counts."""
    y = F.col(label)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.sum(F.when(y == -1, 1).otherwise(0)).alias("hard"),
                  F.sum(F.when(y == 1, 1).otherwise(0)).alias("hijacked"),
                  F.sum(F.when(y == 0, 1).otherwise(0)).alias("valid"))


def label_conflicts(clean: DataFrame, noisy: DataFrame, id_col: str = "id",
                    label: str = "label") -> DataFrame:
    """Rows of ``clean`` whose noisy label differs (missing = conflict)."""
    n = noisy.select(F.col(id_col), F.col(label).alias("n_label"))
    return (clean.join(n, id_col, "left")
                 .filter(~F.col(label).eqNullSafe(F.col("n_label"))))


# ---- crowd votes: long table (item_id, worker_id, answer, pos) -------------

def first_two(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """The first two answers of each item by ``pos`` -> (item, a1, a2).

    The two smallest positions are ranked inside salted parts of an item first,
    so an item with a huge number of votes never lands whole in one task.
    """
    top = top_n_per_group(votes.select(item, "pos", "answer"), [item], [F.col("pos")], 2, out="_r")
    two = top.groupBy(item).agg(F.min_by("answer", "_r").alias("a1"), F.max_by("answer", "_r").alias("a2"), F.count(F.lit(1)).alias("_n"))
    return two.where("_n = 2").select(item, "a1", "a2")


def vote_conflicts(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """Items whose first two annotators disagree (``conflict`` = true)."""
    ft = first_two(votes, item)
    return ft.withColumn("conflict", F.col("a1") != F.col("a2"))


def cohen_kappa(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """Cohen's kappa between first and second annotator of each item."""
    ft = first_two(votes, item)
    n = F.count(F.lit(1))
    cats = [-1, 0, 1]
    agg = ft.agg(n.alias("n"),
                 F.sum(F.when(F.col("a1") == F.col("a2"), 1).otherwise(0)).alias("agree"),
                 *[F.sum(F.when(F.col("a1") == c, 1).otherwise(0)).alias(f"r{i}")
                   for i, c in enumerate(cats)],
                 *[F.sum(F.when(F.col("a2") == c, 1).otherwise(0)).alias(f"s{i}")
                   for i, c in enumerate(cats)])
    pe = F.try_divide(sum(F.col(f"r{i}") * F.col(f"s{i}") for i in range(len(cats))),
                      F.col("n") * F.col("n"))
    po = F.try_divide(F.col("agree"), F.col("n"))
    return agg.select(F.when(pe == 1, F.lit(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def vote_matrix(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item, how many votes said -1, 0 and 1."""
    a = F.col("answer")
    return votes.groupBy(item).agg(
        F.sum(F.when(a == -1, 1).otherwise(0)).alias("n_neg"),
        F.sum(F.when(a == 0, 1).otherwise(0)).alias("n_zero"),
        F.sum(F.when(a == 1, 1).otherwise(0)).alias("n_pos"))


def fleiss_kappa(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """Fleiss' kappa over the vote matrix. Every item must carry the
    same number of votes; otherwise the result is null (``equal`` = false)."""
    m = vote_matrix(votes, item).withColumn("_n", F.col("n_neg") + F.col("n_zero") + F.col("n_pos"))
    s = m.agg(F.count(F.lit(1)).alias("N"), F.min("_n").alias("nmin"), F.max("_n").alias("nmax"),
              F.sum("n_neg").alias("c0"), F.sum("n_zero").alias("c1"), F.sum("n_pos").alias("c2"),
              F.sum(F.col("n_neg") ** 2 + F.col("n_zero") ** 2 + F.col("n_pos") ** 2).alias("sq"))
    n = F.col("nmax").cast("double")
    tot = F.col("N") * n
    pbar = F.try_divide(F.col("sq") - F.col("N") * n, n * (n - 1) * F.col("N"))
    pe = (F.col("c0") / tot) ** 2 + (F.col("c1") / tot) ** 2 + (F.col("c2") / tot) ** 2
    # kappa is undefined with one vote per item or perfect chance agreement
    return s.select((F.col("nmin") == F.col("nmax")).alias("equal"),
                    F.when(F.col("nmin") == F.col("nmax"),
                           F.try_divide(pbar - pe, 1 - pe)).alias("kappa"))


def avg_answer(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """Plurality answer; ties prefer valid (1), then hijacked (-1),
    then hard (0)."""
    m = vote_matrix(votes, item)
    top = F.greatest("n_neg", "n_zero", "n_pos")
    return m.select(item, F.when(F.col("n_pos") == top, 1).when(F.col("n_neg") == top, -1)
                    .otherwise(0).alias("avg_answer"))


def most_frequent(votes: DataFrame, item: str = "item_id") -> DataFrame:
    """The reference's in-order majority-candidate scan (Boyer-Moore).

    The scan is order-dependent, so each item's answers are gathered in
    ``pos`` order. A crowd item carries the task's fixed number of
    assignments, so this per-item list is bounded by task design; the
    aggregate-based J11 is the skew-safe consensus for unbounded feeds.
    """
    arr = F.array_sort(F.collect_list(F.struct("pos", "answer")))
    g = votes.groupBy(item).agg(F.transform(arr, lambda s: s["answer"]).alias("_a"))
    init = F.struct(F.element_at("_a", 1).alias("cand"), F.lit(1).alias("ctr"))

    def step(acc, x):
        same = acc["cand"] == x
        return (F.when(same, F.struct(acc["cand"].alias("cand"), (acc["ctr"] + 1).alias("ctr")))
                 .when(acc["ctr"] == 1, F.struct(x.alias("cand"), F.lit(1).alias("ctr")))
                 .otherwise(F.struct(acc["cand"].alias("cand"), (acc["ctr"] - 1).alias("ctr"))))

    rest = F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(0)))
    return g.select(item, F.aggregate(rest, init, step)["cand"].alias("answer"))
