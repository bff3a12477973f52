"""Base classifiers on spark.ml (E1-E15) and a distributed Gaussian NB.

Models train where the data lives: spark.ml estimators run treeAggregate
passes over the partitions; only the fitted parameters (bounded by the
feature count) come back to the driver. Text models keep the smoothed-idf
rule of the reference: Spark's IDF gives ln((n+1)/(df+1)); we fit it and
scale TF by (idf + 1) with ElementwiseProduct.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, IDF, Normalizer,
                                RegexTokenizer, StopWordsRemover, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtriage.operators.boosting import BoostedGrid, fit_boosted
from tagtriage.operators.features import SOCIAL_PASS, SOCIAL_SCALED, social_features
from tagtriage.session import current_session, cut_lineage, few_partials, parallel_map

SOCIAL_COLS = SOCIAL_SCALED + SOCIAL_PASS


def _social_assembler():
    return VectorAssembler(inputCols=SOCIAL_COLS, outputCol="features", handleInvalid="keep")


def social_frame(df: DataFrame, keep: list[str]) -> DataFrame:
    return social_features(df, keep=keep)


def fit_lr(df: DataFrame, label: str = "label", n: int | None = None) -> PipelineModel:
    """Logistic regression on the social features (L2, C = 1 -> regParam 1/n)."""
    n = n or max(1, df.count())
    return Pipeline(stages=[_social_assembler(),
                            LogisticRegression(labelCol=label, regParam=1.0 / n,
                                               probabilityCol="p_lr", predictionCol="y_lr",
                                               rawPredictionCol="r_lr")]).fit(df)


def fit_rf(df: DataFrame, label: str = "label", trees: int = 100, depth: int = 2,
           seed: int = 0) -> PipelineModel:
    """Random forest, 100 trees of depth 2."""
    return Pipeline(stages=[_social_assembler(),
                            RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth,
                                                   seed=seed, probabilityCol="p_rf",
                                                   predictionCol="y_rf",
                                                   rawPredictionCol="r_rf")]).fit(df)


# ---- E2: Gaussian naive Bayes as aggregates (exact, distributed) -------------

def fit_gnb(df: DataFrame, cols: list[str] = SOCIAL_COLS, label: str = "label",
             var_smoothing: float = 1e-9) -> DataFrame:
    """Per-class prior, mean and variance of every feature, variance
    smoothed by ``var_smoothing`` x the largest feature variance.
    -> long parameter table (cls, feature, mean, var, log_prior)."""
    x = [F.col(c).cast("double").alias(c) for c in cols]
    rows = df.select(F.col(label).alias("cls"), *x)
    spread = rows.agg(F.greatest(*[F.var_pop(c) for c in cols], F.lit(0.0)).alias("v"), F.count("*").alias("n_all"))
    stats = rows.groupBy("cls").agg(F.count("*").alias("n_c"), F.array(*[
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.var_pop(c).alias("v")) for c in cols]).alias("f"))
    wide = stats.crossJoin(F.broadcast(spread.withColumnRenamed("v", "widest")))  # one row
    return (wide.select("cls", "n_c", "n_all", "widest", F.explode("f").alias("f"))
                .select("cls", "f.feature", "f.mean", (F.col("f.v") + F.col("widest") * var_smoothing).alias("var"),
                        F.log(F.col("n_c") / F.col("n_all")).alias("log_prior")))


def score_gnb(df: DataFrame, params: DataFrame, cols: list[str] = SOCIAL_COLS,
              id_col: str = "id", out: str = "nb_label") -> DataFrame:
    """E2 scoring: P(class 1 | x) as one column expression; the parameters
    (classes x features rows) are read into it."""
    rows = params.collect()
    if not rows:
        return df.withColumn(out, F.lit(0.0))
    by_class: dict = {}
    for r in rows:
        by_class.setdefault(r["cls"], []).append(r)
    jll = {}
    for cls, stats in by_class.items():
        total = F.lit(float(stats[0]["log_prior"]))
        for r in stats:
            d = F.col(r["feature"]).cast("double") - float(r["mean"])
            var = max(float(r["var"]), 1e-300)
            total = total - 0.5 * (math.log(2 * math.pi * var) + d * d / var)
        jll[cls] = total
    if 1 not in jll:
        return df.withColumn(out, F.lit(0.0))
    z = F.lit(1.0)
    for cls, total in jll.items():
        if cls != 1:
            z = z + F.exp(total - jll[1])
    return df.withColumn(out, 1.0 / z)


def fit_social(df: DataFrame, label: str = "label") -> dict:
    """The three social models fitted on one cached, scaled frame."""
    cached = df.persist()
    n = cached.count()
    models = {"lr": fit_lr(cached, label, n), "rf": fit_rf(cached, label),
              "nb": cut_lineage(fit_gnb(cached, label=label))}
    cached.unpersist()
    return models


def prob1(col: str):
    return vector_to_array(F.col(col))[1]


def score_social(df: DataFrame, models: dict, id_col: str = "id", prob: bool = True) -> DataFrame:
    """E5: rf / lr / nb scores (probability of class 1, or hard labels)."""
    out = models["lr"].transform(df)
    out = models["rf"].stages[-1].transform(out)
    out = (out.withColumn("lr_label", prob1("p_lr") if prob else F.col("y_lr"))
              .withColumn("rf_label", prob1("p_rf") if prob else F.col("y_rf"))
              .drop("features", "p_lr", "y_lr", "r_lr", "p_rf", "y_rf", "r_rf"))
    out = score_gnb(out, models["nb"], id_col=id_col)
    if not prob:
        out = out.withColumn("nb_label", F.when(F.col("nb_label") > 0.5, 1.0).otherwise(0.0))
    return out


# ---- text models -----------------------------------------------------------

# slots that text models count terms in, and those of cluster centres (k of them are held)
SLOTS, CLUSTER_SLOTS = 1 << 18, 1 << 16


def _tokens(col: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=col, outputCol="_tok", gaps=False,
                          pattern=r"[\p{L}\p{N}_]{2,}", toLowercase=True)


def slot_counts(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the counts of ``col``'s terms in SLOTS slots, as ``tfidf_model``
    counts them: fits that share rows need not count them again."""
    return HashingTF(inputCol="_tok", outputCol=out, numFeatures=SLOTS).transform(_tokens(col).transform(df)).drop("_tok")


def weighted(df: DataFrame, vec: PipelineModel, counted: str) -> DataFrame:
    """``df`` with the features of a fitted text pipeline from the counts in ``counted``."""
    return PipelineModel(stages=vec.stages[2:]).transform(df.withColumn("_tf", F.col(counted)))


def tfidf_model(df: DataFrame, col: str, mode: str = "tfidf", stop: list[str] | None = None,
                max_features: int | None = None, out: str = "features",
                slots: int = SLOTS, counted: str | None = None) -> PipelineModel:
    """G3-G5 as a fitted spark.ml pipeline: tokens of >= 2 word characters,
    counts, smoothed idf (+1), L2 norm. ``mode``: count | tf | tfidf.

    Terms are counted in ``slots`` hash slots, so that models of any corpus have
    the same size (2 MB of coefficients) and no vocabulary is built; terms that
    share a slot share its weight (``slot_terms`` names them). With
    ``max_features`` the vocabulary holds so many of the most frequent terms,
    without sharing. ``counted`` names a column that has the counts already
    (``slot_counts``)."""
    stages = [_tokens(col)]
    src = "_tok"
    if stop:
        stages.append(StopWordsRemover(inputCol="_tok", outputCol="_tok2", stopWords=stop))
        src = "_tok2"
    tf = "_tf" if mode != "count" else out
    if max_features:
        stages.append(CountVectorizer(inputCol=src, outputCol=tf, vocabSize=max_features, minDF=1.0))
    else:
        stages.append(HashingTF(inputCol=src, outputCol=tf, numFeatures=slots))
    rows = df.filter(F.col(counted or col).isNotNull())
    base = Pipeline(stages=stages).fit(rows)
    if mode == "count":
        return base
    tstages = list(base.stages)
    if mode == "tfidf":
        idf = IDF(inputCol="_tf", outputCol="_idf0").fit(
            rows.select(F.col(counted).alias("_tf")) if counted else few_partials(base.transform(rows)))
        scale = Vectors.dense(idf.idf.toArray() + 1.0)
        tstages.append(ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_tfidf"))
        tstages.append(Normalizer(inputCol="_tfidf", outputCol=out, p=2.0))
    else:
        tstages.append(Normalizer(inputCol="_tf", outputCol=out, p=2.0))
    return PipelineModel(stages=tstages)


def slot_terms(df: DataFrame, vec: PipelineModel) -> DataFrame:
    """(slot, term) of every distinct term of ``df``: the terms that a fitted text
    pipeline counts in a slot. A table, however many terms there are."""
    stage = next(s for s in vec.stages if isinstance(s, (HashingTF, CountVectorizerModel)))
    src = stage.getInputCol()
    tokens = PipelineModel(stages=vec.stages[:vec.stages.index(stage)]).transform(df)
    # stored: a filter on the slot would else be moved below the distinct, to a row a token
    terms = cut_lineage(tokens.select(F.explode(src).alias("term")).distinct()).withColumn(src, F.array("term"))
    slot = F.regexp_extract(F.col(stage.getOutputCol()).cast("string"), r"\[(\d+)\]", 1).try_cast("int")
    return (stage.transform(terms).select(slot.alias("slot"), "term").where("slot IS NOT NULL"))


def dense_weights(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """A fitted regression with its coefficients as dense arrays. Spark stores them
    sparse where that is smaller, and a row's score then walks the whole list of
    non-zero coefficients (up to SLOTS a class); a dense array is read at the
    row's own slots only. Scores are the same."""
    java, jvm = model._java_obj, current_session().sparkContext._jvm
    made = jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        java.uid(), java.coefficientMatrix().toDense(), java.interceptVector(), java.numClasses(),
        java.coefficientMatrix().numRows() > 1)
    return LogisticRegressionModel._from_java(java.copyValues(made, java.extractParamMap()))


def _drop_tmp(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_t") or c.startswith("_i")])


def fit_text(df: DataFrame, col: str = "processed_fulltext", label: str = "label",
             reg: float = 1e-4, out: str = "txt_label", max_iter: int = 50,
             tol: float = 1e-4, counted: str | None = None) -> tuple[PipelineModel, LogisticRegression]:
    """TF-IDF + logistic regression (SGD-like small L2) -> txt_label. The texts
    are counted once, or have their counts in ``counted``."""
    rows = df if counted else slot_counts(df, col, "counts")
    rows = few_partials(rows.select(label, F.col(counted or "counts").alias("counts"))).persist()
    try:
        vec = tfidf_model(rows, col, counted="counts")
        lr = LogisticRegression(labelCol=label, regParam=reg, probabilityCol="_p_txt",
                                predictionCol="_y_txt", rawPredictionCol="_r_txt",
                                maxIter=max_iter, tol=tol)
        return vec, dense_weights(lr.fit(weighted(few_partials(rows, rows.count()), vec, "counts")))
    finally:
        rows.unpersist()


def score_text(df: DataFrame, vec: PipelineModel, model, prob: bool = True,
               out: str = "txt_label", counted: str | None = None) -> DataFrame:
    s = model.transform(weighted(df, vec, counted) if counted else vec.transform(df))
    val = prob1("_p_txt") if prob else F.col("_y_txt")
    return _drop_tmp(s.withColumn(out, val).drop("features", "_p_txt", "_y_txt", "_r_txt"))


# slots in use up to which a model holds these alone: picking them costs a row a look at each
FEW_SLOTS = 4096


def _used_slots(vec: PipelineModel, n: int) -> tuple[PipelineModel, str]:
    """A fitted tfidf pipeline that ends with the slots its ``n`` rows use, and the
    column of them; as it is where more than FEW_SLOTS are in use. A slot without a
    training row has weight 0, so scores stay; a round of the fit moves the
    slots in use instead of all."""
    scale = next(s for s in vec.stages if isinstance(s, ElementwiseProduct))
    # an unused slot's idf is ln(n + 1), one used by a row less by ln 2
    used = np.flatnonzero(scale.getScalingVec().toArray() - 1.0 < math.log(n + 1.0) - 0.3)
    if not 0 < len(used) <= FEW_SLOTS:
        return vec, "features"
    pick = VectorSlicer(inputCol="features", outputCol="_tused", indices=used.tolist())
    return PipelineModel(stages=[*vec.stages, pick]), "_tused"


def fit_profile(df: DataFrame, col: str = "user_description", label: str = "label",
                mode: str = "tfidf"):
    """Profile model trained on rows with a description."""
    rows = few_partials(df.filter(F.col(col).isNotNull()).select(col, label)).persist()
    try:
        vec = tfidf_model(rows, col, mode)
        n = max(1, rows.count())
        vec, features = _used_slots(vec, n) if mode == "tfidf" else (vec, "features")
        lr = LogisticRegression(labelCol=label, featuresCol=features, regParam=1.0 / n, probabilityCol="_p_ud",
                                predictionCol="_y_ud", rawPredictionCol="_r_ud", maxIter=50, tol=1e-4)
        return vec, dense_weights(lr.fit(vec.transform(few_partials(rows, n))))
    finally:
        rows.unpersist()


def score_profile(df: DataFrame, vec, model, col: str = "user_description",
                  prob: bool = True, out: str = "ud_label") -> DataFrame:
    """Profile score; a missing description scores 1 (no row split:
    the null rows pass through the model and are overridden)."""
    filled = df.withColumn("_desc", F.coalesce(F.col(col), F.lit("")))
    vec2 = PipelineModel(stages=[_rebind(vec.stages[0], "_desc")] + list(vec.stages[1:]))
    s = model.transform(vec2.transform(filled))
    val = prob1("_p_ud") if prob else F.col("_y_ud")
    return _drop_tmp(s.withColumn(out, F.when(F.col(col).isNull(), F.lit(1.0)).otherwise(val))
                      .drop("features", "_p_ud", "_y_ud", "_r_ud", "_desc"))


def _rebind(tok: RegexTokenizer, col: str) -> RegexTokenizer:
    t = tok.copy()
    t.setInputCol(col)
    return t


def null_profile_rule(df: DataFrame, col: str, p: str, out: str = "ud_label") -> DataFrame:
    """E9 rule alone: null description -> 1.0, else the model score."""
    return df.withColumn(out, F.when(F.col(col).isNull(), F.lit(1.0)).otherwise(F.col(p)))


def cv_accuracy(df: DataFrame, fit_score, k: int = 5, seed: int = 0, label: str = "label",
                key: str = "id", parallelism: int = 4) -> DataFrame:
    """K-fold cross-validated accuracy -> (mean, 2 * std) over folds.
    ``fit_score(train, test) -> test with column 'pred'``."""
    from tagtriage.operators.sampling import kfold
    f = kfold(df, k, mode="shuffled", seed=seed, key=key).persist()

    def one_fold(i):
        pred = fit_score(f.filter(F.col("fold") != i), f.filter(F.col("fold") == i))
        return cut_lineage(pred.select(F.lit(i).alias("fold"),
                                       (F.col("pred") == F.col(label)).cast("double").alias("hit")))

    parts = parallel_map(one_fold, range(1, k + 1), parallelism)
    f.unpersist()
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    acc = allp.groupBy("fold").agg(F.avg("hit").alias("acc"))
    return acc.agg(F.avg("acc").alias("mean_accuracy"),
                   (2 * F.stddev_pop("acc")).alias("two_std"))


def fit_clusters(df: DataFrame, col: str = "processed_fulltext", k: int = 13, seed: int = 1):
    """K-means (k = 13) on TF-IDF vectors of the text."""
    vec = tfidf_model(df, col, slots=CLUSTER_SLOTS)
    feats = few_partials(vec.transform(df).select("features")).persist()
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(feats)
    feats.unpersist()
    return vec, km


def assign_clusters(df: DataFrame, vec, km) -> DataFrame:
    return _drop_tmp(km.transform(vec.transform(df)).drop("features"))


def cluster_label(df: DataFrame, t: float = 0.6, label: str = "label",
                  cluster: str = "cluster") -> DataFrame:
    """Valid share >= t -> 0, else hijacked share >= t -> 1, else -1
    (shares over every row of the cluster)."""
    g = df.groupBy(cluster).agg(F.avg(F.when(F.col(label) == 0, 1.0).otherwise(0.0)).alias("_v"),
                                F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("_h"))
    return g.select(cluster, F.when(F.col("_v") >= t, 0).when(F.col("_h") >= t, 1)
                    .otherwise(-1).alias("cl_label"))


def cluster_prob(df: DataFrame, t: float = 0.6, label: str = "label",
                 cluster: str = "cluster") -> DataFrame:
    """1 - valid share, or the hijacked share, else 0.5."""
    g = df.groupBy(cluster).agg(F.avg(F.when(F.col(label) == 0, 1.0).otherwise(0.0)).alias("_v"),
                                F.avg(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("_h"))
    return g.select(cluster, F.when(F.col("_v") >= t, 1 - F.col("_v"))
                    .when(F.col("_h") >= t, F.col("_h")).otherwise(0.5).alias("cl_label"))


def score_cluster(df: DataFrame, labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Attach the cluster score (inner join: clusters without a label
    drop their rows, as in the reference). The label table has one row per
    cluster (k rows), so it is broadcast."""
    return df.join(F.broadcast(labels), cluster, "inner")


def cluster_terms(km, vec: PipelineModel, df: DataFrame, n: int = 25) -> DataFrame:
    """The n heaviest terms of every cluster centre, (cluster, term, weight,
    rank); ``df`` has the texts that name the slots. A slot's weight goes to each
    of its terms; ties by term. Centres are k x slots on the driver, whatever
    the corpus; n slots a centre leave it."""
    rows = []
    for ci, c in enumerate(km.clusterCenters()):
        arr = np.asarray(c)
        least = np.partition(arr, -min(n, len(arr)))[-min(n, len(arr))]
        rows += [(ci, int(t), float(arr[t])) for t in np.flatnonzero((arr >= least) & (arr > 0))]
    heavy = df.sparkSession.createDataFrame(rows, "cluster int, slot int, weight double")
    w = Window.partitionBy("cluster").orderBy(F.col("weight").desc(), "term")
    named = slot_terms(df, vec).join(F.broadcast(heavy), "slot")  # about k x n rows
    return (named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("cluster", "term", "weight", "rank"))


def term_weights(model, vec: PipelineModel, df: DataFrame) -> DataFrame:
    """(term, weight) of a fitted text model for the terms of ``df``."""
    coefs = [(i, float(x)) for i, x in enumerate(model.coefficients.toArray()) if x]
    weights = df.sparkSession.createDataFrame(coefs, "slot int, weight double")  # SLOTS rows at most
    return slot_terms(df, vec).join(weights, "slot").select("term", "weight")


def fit_meta(oof: DataFrame, cols=("rf_label", "ud_label", "txt_label"), label: str = "label",
             rounds: int = 1000, depth: int = 3, subsample: float = 0.5, rate: float = 0.005,
             seed: int = 222) -> BoostedGrid:
    """H9: meta learner, boosted trees with exponential loss on a bounded grid of scores."""
    return fit_boosted(oof, list(cols), label, rounds, depth, subsample, rate, seed)
