"""Weak supervision: crowd-vote features, labelling functions, label model
(L1-L14).

The label matrix is a long table ``(item_id, lf, vote)`` holding only
non-abstain votes -- the sparse form of the reference's dense matrix.
Summaries and majority labels are two-level aggregates over it; the label
model is Dawid-Skene EM whose E and M steps are each one aggregation, with
the per-function parameters (a few rows per function) broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtriage.functions import fixed
from tagtriage.session import cut_lineage, few_partials

ABSTAIN = -1


def change_answer(c) -> Column:
    """Crowd answer -> label: 1 (valid) -> 0, 0 (hard) -> -1,
    -1 (hijacked) -> 1, anything else -> -1."""
    a = F.col(c) if isinstance(c, str) else c
    return F.when(a == 1, 0).when(a == 0, -1).when(a == -1, 1).otherwise(-1)


def annotators(votes: DataFrame, threshold: int = 0, worker: str = "worker_id") -> DataFrame:
    """L1: votes per annotator, kept when the count exceeds ``threshold``."""
    return (votes.groupBy(worker).agg(F.count(F.lit(1)).alias("n_votes"))
                 .filter(F.col("n_votes") > threshold))


def annotator_summary(ann: DataFrame) -> DataFrame:
    """L1 report: number of annotators, largest and smallest vote count."""
    return ann.agg(F.count(F.lit(1)).alias("n_annotators"), F.max("n_votes").alias("max_votes"),
                   F.min("n_votes").alias("min_votes"))


def annotator_label_features(votes: DataFrame, ann: DataFrame | None = None,
                             item: str = "item_id", worker: str = "worker_id") -> DataFrame:
    """L2: one-hot (item, '<worker>_<recoded label>') presence, long form."""
    v = votes if ann is None else votes.join(ann.select(worker), worker, "left_semi")
    return (v.select(item, F.concat_ws("_", F.col(worker), change_answer("answer").cast("string"))
                     .alias("feature"))
             .distinct())


def annotator_features(votes: DataFrame, ann: DataFrame | None = None,
                       item: str = "item_id", worker: str = "worker_id") -> DataFrame:
    """L3: (item, worker) presence, long form."""
    v = votes if ann is None else votes.join(ann.select(worker), worker, "left_semi")
    return v.select(item, worker).distinct()


def labels_by_annotator(votes: DataFrame, item: str = "item_id",
                        worker: str = "worker_id") -> DataFrame:
    """L4: each annotator's recoded label per item; the later vote wins."""
    return (votes.groupBy(worker, item)
                 .agg(F.max_by(change_answer("answer"), F.col("pos")).alias("label")))


def vote_shares(votes: DataFrame, base: int = 7, item: str = "item_id") -> DataFrame:
    """Recoded votes hijacked / valid / other per item, each divided by
    a fixed base (7)."""
    r = change_answer("answer")
    return votes.groupBy(item).agg(
        (F.sum(F.when(r == 1, 1).otherwise(0)) / base).alias("hijacked_share"),
        (F.sum(F.when(r == 0, 1).otherwise(0)) / base).alias("valid_share"),
        (F.sum(F.when((r != 0) & (r != 1), 1).otherwise(0)) / base).alias("hard_share"))


def keyword_lfs(names: list[str] | None = None) -> list[tuple[str, Column]]:
    """Keyword labelling functions as (name, Column builder)."""
    names = names or fixed.ACTIVE_KEYWORD_LFS
    table = {n: (kws, v) for n, kws, v in fixed.KEYWORD_LFS}
    out = []
    for n in names:
        kws, v = table[n]
        out.append((f"keyword_{kws[0]}", (kws, v)))
    return out


def _keyword_vote(low: Column, kws: list[str], vote: int) -> Column:
    """``low`` is the lower-cased text; plain ORs of ``contains`` stay in
    generated code (no lambda)."""
    hit = F.lit(False)
    for k in kws:
        hit = hit | F.contains(low, F.lit(k))
    return F.when(hit, F.lit(vote)).otherwise(F.lit(ABSTAIN))


def apply_lfs(df: DataFrame, lfs: list, id_col: str = "id", text: str = "fulltext") -> DataFrame:
    """Apply Column labelling functions -> long (item_id, lf, vote),
    abstains dropped. ``lfs`` items are (name, (keywords, vote)) or
    (name, Column) for user-defined functions (N8)."""
    structs = []
    for name, spec in lfs:
        col = _keyword_vote(F.col("_low"), *spec) if isinstance(spec, tuple) else spec
        structs.append(F.struct(F.lit(name).alias("lf"), col.cast("int").alias("vote")))
    # the text is lower-cased once for every keyword function
    return (df.withColumn("_low", F.lower(F.col(text)))
              .select(F.col(id_col).alias("item_id"), F.inline(F.array(*structs)))
              .filter(F.col("vote") != ABSTAIN))


def worker_lfs(votes: DataFrame, items: DataFrame | None = None, id_col: str = "id",
               item: str = "item_id", worker: str = "worker_id") -> DataFrame:
    """Every annotator is a labelling function voting its (latest,
    recoded) label; long form (item_id, lf, vote), abstains dropped."""
    lab = labels_by_annotator(votes, item, worker)
    if items is not None:
        lab = lab.join(items.select(F.col(id_col).alias(item)), item, "left_semi")
    return (lab.filter(F.col("label") != ABSTAIN)
               .select(F.col(item).alias("item_id"),
                       F.concat(F.lit("worker_"), F.col(worker)).alias("lf"),
                       F.col("label").cast("int").alias("vote")))


def lf_summary(L: DataFrame, n_items: int | None = None, items: DataFrame | None = None) -> DataFrame:
    """Per function polarity, coverage, overlaps and conflicts.

    Fractions are over all items (``n_items`` or ``items.count()``), as in
    the dense matrix. Per-item vote counts are a partial aggregate joined
    back on the item."""
    L = cut_lineage(L)   # read twice below (per-item counts and the join back)
    if n_items is None:
        n_items = items.count() if items is not None else L.select("item_id").distinct().count()
    per_item = L.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"),
                                        F.sum(F.when(F.col("vote") == 0, 1).otherwise(0)).alias("_n0"),
                                        F.sum(F.when(F.col("vote") == 1, 1).otherwise(0)).alias("_n1"))
    j = L.join(per_item, "item_id")
    same = F.when(F.col("vote") == 0, F.col("_n0")).when(F.col("vote") == 1, F.col("_n1")) \
            .otherwise(F.lit(1))
    return j.groupBy("lf").agg(
        F.array_sort(F.collect_set("vote")).alias("polarity"),
        (F.count(F.lit(1)) / n_items).alias("coverage"),
        (F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)) / n_items).alias("overlaps"),
        (F.sum(F.when(F.col("_n") - same > 0, 1).otherwise(0)) / n_items).alias("conflicts"))


def lf_majority(L: DataFrame, items: DataFrame, id_col: str = "id") -> DataFrame:
    """Majority of non-abstain votes per item; ties and no votes -> -1."""
    c = L.groupBy("item_id").agg(F.sum(F.when(F.col("vote") == 1, 1).otherwise(0)).alias("_n1"),
                                 F.sum(F.when(F.col("vote") == 0, 1).otherwise(0)).alias("_n0"))
    return (items.select(F.col(id_col).alias("item_id")).join(c, "item_id", "left")
                 .select("item_id", F.when(F.col("_n1") > F.col("_n0"), 1)
                         .when(F.col("_n0") > F.col("_n1"), 0).otherwise(ABSTAIN).alias("label")))


def label_model(L: DataFrame, items: DataFrame, iters: int = 100, id_col: str = "id",
                smoothing: float = 1.0, tol: float = 1e-4) -> DataFrame:
    """Binary Dawid-Skene EM over the long label matrix, the slower way beside
    ``label_moments`` (which needs no rounds over the votes).

    E step: per item, log P(y=c) + sum of log P(vote | y=c) over its votes
    (one aggregation of L joined to the parameter table, whose size is
    functions x 2 x 2). M step: per (function, vote) sums of the
    item posteriors (one aggregation; a function's total is the sum of its
    votes'). Starts from majority votes and ends after ``iters`` rounds, or
    when no posterior moves by more than ``tol`` (looked at every fifth round).
    The posterior table feeds the next round twice, so it is checkpointed into
    the shared checkpoint folder every round; that keeps plans flat and lets a
    lost executor resume from the last round. L is laid out by item once.
    -> (item_id, p1, label); items without votes get the prior.
    """
    L = cut_lineage(L.select("item_id", "lf", "vote").repartition("item_id"))
    its = cut_lineage(items.select(F.col(id_col).alias("item_id")).distinct())
    maj = lf_majority(L, items, id_col)
    q = cut_lineage(maj.select("item_id", F.when(F.col("label") == 1, 0.9)
                               .when(F.col("label") == 0, 0.1).otherwise(0.5).alias("q1")))
    for it in range(iters):
        # M step: class prior and confusion of each function.
        prior = q.agg(F.avg("q1").alias("pi1"))
        theta = cut_lineage(L.join(q, "item_id").groupBy("lf", "vote").agg(
            F.sum("q1").alias("s1"), F.sum(1 - F.col("q1")).alias("s0")))
        tot = theta.groupBy("lf").agg(F.sum("s1").alias("t1"), F.sum("s0").alias("t0"))
        params = (theta.join(tot, "lf")
                       .select("lf", "vote",
                               F.log((F.col("s1") + smoothing) / (F.col("t1") + 2 * smoothing)).alias("l1"),
                               F.log((F.col("s0") + smoothing) / (F.col("t0") + 2 * smoothing)).alias("l0")))
        # E step: params has (functions x votes) rows; AQE broadcasts it when small
        ll = (L.join(params, ["lf", "vote"])
               .groupBy("item_id").agg(F.sum("l1").alias("a1"), F.sum("l0").alias("a0")))
        new = cut_lineage(its.join(ll, "item_id", "left").crossJoin(F.broadcast(prior))
                .select("item_id",
                        (F.coalesce("a1", F.lit(0.0)) + F.log("pi1")).alias("b1"),
                        (F.coalesce("a0", F.lit(0.0)) + F.log(1 - F.col("pi1"))).alias("b0"))
                .select("item_id", (1 / (1 + F.exp(F.col("b0") - F.col("b1")))).alias("q1")))
        if it % 5 == 4:
            moved = new.join(q.withColumnRenamed("q1", "q0"), "item_id").agg(F.max(F.abs(F.col("q1") - F.col("q0")))).first()[0]
            if moved is None or moved <= tol:
                q = new
                break
        q = new
    return q.select("item_id", F.col("q1").alias("p1"),
                    F.when(F.col("q1") > 0.5, 1).otherwise(0).alias("label"))


def agreement(L: DataFrame) -> DataFrame:
    """Agreement of every two functions that vote on the same items, both ways
    round: (i, j, n, m), n items and the mean m of the product of their votes,
    a vote being -1 or 1. Two functions that each know one class only always
    agree or never do, so they say nothing about each other and are left out.

    One pass over the votes: an item's votes meet in a self-join on the item
    (Spark splits an item of many votes), and pairs of functions are partial sums."""
    votes = L.select("item_id", "lf", (F.col("vote") * 2 - 1).alias("s"))
    both = votes.groupBy("lf").agg((F.min("s") < F.max("s")).alias("both"))
    a = votes.select("item_id", F.col("lf").alias("i"), F.col("s").alias("si"))
    b = votes.select("item_id", F.col("lf").alias("j"), F.col("s").alias("sj"))
    met = a.join(b, "item_id").where("i < j").groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("si") * F.col("sj")).alias("agreed"))
    met = (met.join(both.select(F.col("lf").alias("i"), F.col("both").alias("bi")), "i")
              .join(both.select(F.col("lf").alias("j"), F.col("both").alias("bj")), "j").where("bi OR bj")
              .select("i", "j", "n", (F.col("agreed") / F.col("n")).alias("m")))
    return cut_lineage(met.unionByName(met.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "m")))


def lf_accuracies(L: DataFrame, partners: int = 10, most: float = 0.98) -> DataFrame:
    """Accuracy of every function from moments alone: (lf, accuracy), accuracy
    being the mean of vote times truth, in -most..most.

    Where errors of functions are independent, the agreement of i and j is
    a_i * a_j. So each two partners j, k of i give m_ij m_ik = a_i^2 m_jk, and
    the least-squares a_i^2 over these triplets, each weighing as its rarest
    pair, is in closed form: sum(w m_ij m_ik m_jk) / sum(w m_jk^2). The partners
    are the ``partners`` functions that share most items with i. The sign is that
    of i's agreement with all others. A function in no triplet gets the value
    that all would have if they were equally good."""
    pairs = agreement(L)
    top = (pairs.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "j")))
           .where(F.col("r") <= partners).drop("r"))
    j, k = (top.select("i", F.col("j").alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")) for x in ("j", "k"))
    across = pairs.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("n").alias("n"), F.col("m").alias("m"))
    w = F.least("nj", "nk", "n")
    square = (j.join(k, "i").where("j < k").join(across, ["j", "k"]).groupBy(F.col("i").alias("lf"))
              .agg(F.try_divide(F.sum(w * F.col("mj") * F.col("mk") * F.col("m")), F.sum(w * F.col("m") * F.col("m"))).alias("square")))
    sign = pairs.groupBy(F.col("i").alias("lf")).agg(F.when(F.sum(F.col("n") * F.col("m")) < 0, -1.0).otherwise(1.0).alias("sign"))
    equal = pairs.agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("equal"))
    value = F.sqrt(F.least(F.greatest(F.coalesce("square", "equal", F.lit(0.0)), F.lit(0.0)), F.lit(most * most)))
    return (L.select("lf").distinct().join(square, "lf", "left").join(sign, "lf", "left").crossJoin(F.broadcast(equal))  # one row
            .select("lf", (F.coalesce("sign", F.lit(1.0)) * value).alias("accuracy")))


def label_moments(L: DataFrame, items: DataFrame, id_col: str = "id", partners: int = 10) -> DataFrame:
    """Label model by moments. The functions' accuracies come from their
    agreements (``lf_accuracies``: one pass over the votes, then tables of
    functions), classes being equally likely; an item's log odds are the sum of
    its votes' log((1 + a) / (1 - a)). -> (item_id, p1, label); an item without
    votes, or with even odds, has p1 = 0.5 and label 0."""
    L = cut_lineage(L.where(F.col("vote").isin(0, 1)).select("item_id", "lf", "vote"))
    acc = cut_lineage(lf_accuracies(L, partners))
    weight = acc.select("lf", F.log((1 + F.col("accuracy")) / (1 - F.col("accuracy"))).alias("w"))
    odds = L.join(weight, "lf").groupBy("item_id").agg(F.round(F.sum((F.col("vote") * 2 - 1) * F.col("w")), 9).alias("odds"))
    odd = F.coalesce("odds", F.lit(0.0))
    return (items.select(F.col(id_col).alias("item_id")).distinct().join(odds, "item_id", "left")
            .select("item_id", (1 / (1 + F.exp(-odd))).alias("p1"), F.when(odd > 0, 1).otherwise(0).alias("label")))


def trust_labels(train_votes: DataFrame, train_labels: DataFrame, test_votes: DataFrame,
                 item: str = "item_id", label: str = "avg_answer") -> DataFrame:
    """Logistic regression on who-voted-what features predicts an item's
    label -> (item_id, ann_label). Features: binary counts, in hash slots, of
    each item's set of '<worker>_<label>' tokens (a set, so its size is
    bounded by the distinct tokens, not by the number of votes)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from tagtriage.operators.classifiers import SLOTS, dense_weights

    def feats(v):
        return (annotator_label_features(v).groupBy(item)
                .agg(F.collect_set("feature").alias("toks")))

    slots = HashingTF(inputCol="toks", outputCol="features", binary=True, numFeatures=SLOTS)
    tr = slots.transform(feats(train_votes).join(train_labels.select(item, (F.col(label) + 1).cast("double").alias("y")), item))
    tr = few_partials(tr.select("y", "features")).persist()  # read by the count, the moments and the blocks of the fit
    try:
        n = max(1, tr.count())
        # an L2 penalty C = 1 on a summed loss equals regParam = 1 / n on Spark's mean loss.
        model = dense_weights(LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / n, maxIter=100).fit(tr))
    finally:
        tr.unpersist()
    return (model.transform(slots.transform(feats(test_votes)))
                 .select(item, (F.col("prediction") - 1).cast("int").alias("ann_label")))


def denoise(train: DataFrame, votes: DataFrame, val: DataFrame, val_votes: DataFrame,
            id_col: str = "id", text: str = "fulltext") -> DataFrame:
    """Drop validation ids from training, add the trust label, apply
    keyword + worker (+ trust) functions, fit the label model, append the
    validation rows with their gold labels. -> (id, label, source)."""
    from tagtriage.operators.evaluate import avg_answer
    tr = train.join(val.select(id_col), id_col, "left_anti")
    gold = avg_answer(val_votes)
    trust = trust_labels(val_votes, gold, votes)
    # votes first, so that the join that drops the validation ids moves no text
    kw = apply_lfs(train, keyword_lfs(), id_col, text).join(val.select(F.col(id_col).alias("item_id")), "item_id", "left_anti")
    wk = worker_lfs(votes, tr, id_col)
    tl = (trust.join(tr.select(F.col(id_col).alias("item_id")), "item_id", "left_semi")
               .select("item_id", F.lit("annotators_trust").alias("lf"),
                       F.col("ann_label").alias("vote"))
               .filter(F.col("vote").isin(0, 1)))
    L = kw.unionByName(wk).unionByName(tl)
    lm = label_moments(L, tr, id_col)
    out = lm.select(F.col("item_id").alias(id_col), "label", F.lit("label_model").alias("source"))
    return out.unionByName(val.select(id_col, "label", F.lit("validation").alias("source")))
