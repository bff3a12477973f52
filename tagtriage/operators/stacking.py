"""Detectors, stacking, blending and the daily self-training loop.

Every fit is a spark.ml job over a cached frame, released after the fit; folds
are independent jobs. Lineage is cut between self-training rounds by
checkpointing the growing training table into the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.functions import text as tx
from tagtriage.operators import classifiers as cf
from tagtriage.operators import lists
from tagtriage.operators.ensemble import binarise, confident, override, vote_average, vote_majority, vote_weighted
from tagtriage.operators.evaluate import prf, roc_auc, score_models
from tagtriage.operators.features import social_features
from tagtriage.operators.sampling import balance, kfold, split
from tagtriage.session import current_session, cut_lineage, parallel_map
from tagtriage.sources.dicts import save_dict
from tagtriage.sources.models import ModelRegistry, save_grid, save_model

BASE = ("rf_label", "ud_label", "txt_label")
MODES = ("stacking", "majority", "average")


@dataclass
class Detectors:
    """Lists, word table and models of one fit. ``words`` holds the hijacked
    words that training uses, ``serve_words`` those of live scoring."""

    bl: DataFrame
    wl: DataFrame
    words: DataFrame
    serve_words: DataFrame
    rf: object
    profile: tuple
    text: tuple
    meta: object = None


@dataclass
class Settings:
    """Sizes of the fits."""

    bl_min: int = 5
    wl_min: int = 8
    word_threshold: float = 0.8
    serve_threshold: float = 0.6
    rf_trees: int = 100
    meta_rounds: int = 1000
    meta_rate: float = 0.005
    folds: int = 4
    parallelism: int = 4
    seed: int = 0


def prepare(df: DataFrame) -> DataFrame:
    """Normalised text for scoring (the scoring chain, D9)."""
    return df.withColumn("processed_fulltext", tx.normalise("fulltext", "score"))


# counts of the training chain's text (D10) in hash slots; not named "_t...": scoring drops those
COUNTS = "train_counts"


def counted(df: DataFrame) -> DataFrame:
    """``df`` with the term counts of the text that training reads: normalised and
    counted once for all fits that share rows."""
    if COUNTS in df.columns:
        return df
    text = df.withColumn("_train_text", tx.normalise("fulltext", "train"))
    return cf.slot_counts(text, "_train_text", COUNTS).drop("_train_text")


def fit_detectors(train: DataFrame, s: Settings = Settings(), kept: bool = False) -> Detectors:
    """Fit lists, word table and the three base models on one frame, which is
    cached unless the caller keeps it (``kept``). The lists and word tables are
    stored, so that later joins read a plain table."""
    train = counted(train)
    train = train if kept else train.persist()
    try:
        bl = cut_lineage(lists.black_list(train, s.bl_min))
        wl = cut_lineage(lists.white_list(train, s.wl_min))
        weights = cut_lineage(lists.word_weights(train))
        words = lists.word_tables(weights, s.word_threshold)[0]
        serve = lists.word_tables(weights, s.serve_threshold)[0]
        rf = cf.fit_rf(social_features(train, keep=["id", "label"]), trees=s.rf_trees, seed=s.seed)
        prof = cf.fit_profile(train)
        txt = cf.fit_text(train, "_train_text", counted=COUNTS)
    finally:
        if not kept:
            train.unpersist()
    return Detectors(bl, wl, words, serve, rf, prof, txt)


def base_scores(df: DataFrame, det: Detectors, live: bool = True) -> DataFrame:
    """H1: bl, wl, rf, ud, txt scores; rf, ud and txt are probabilities. The text
    learner reads the scoring chain's text and the serving word table when
    ``live``, the training chain's and the training table inside a fit (held-out
    folds). The models go first, so that where the caller asks for scores only,
    no text moves in the joins with the lists."""
    soc = social_features(df, keep=[c for c in df.columns if c not in cf.SOCIAL_COLS])
    rf = det.rf.transform(soc)
    out = (rf.withColumn("rf_label", vector_to_array("p_rf")[1])
             .drop("features", "p_rf", "y_rf", "r_rf"))
    out = cf.score_profile(out, *det.profile)
    if live:
        out = out.withColumn("_train_text", F.col("processed_fulltext"))
        out = cf.score_text(out, det.text[0], det.text[1], prob=True)
    else:
        out = cf.score_text(counted(out), det.text[0], det.text[1], prob=True, counted=COUNTS)
        out = out if COUNTS in df.columns else out.drop(COUNTS)
    out = lists.bl_score(out.drop("_train_text"), det.bl)
    return lists.wl_score(out, det.wl, det.serve_words if live else det.words)


def vote_stacking(df: DataFrame, meta, out: str = "result") -> DataFrame:
    """H7: meta-model probability on (rf, ud, txt), then the override."""
    return meta.transform(df, "_p_meta").withColumn(out, override(F.col("_p_meta"))).drop("_p_meta")


def _fit_meta(oof: DataFrame, s: Settings):
    return cf.fit_meta(oof, rounds=s.meta_rounds, rate=s.meta_rate, seed=222 + s.seed)


def fit_stacking(train: DataFrame, s: Settings = Settings(), key: str = "id",
                 fold_mode: str = "contiguous") -> Detectors:
    """H8: out-of-fold base scores from k folds (contiguous, or by the seeded
    hash), meta model on them, base models refitted on every row."""
    f = counted(kfold(train, s.folds, mode=fold_mode, seed=s.seed, key=key)).drop("fulltext").persist()

    def fold(i):
        if i == 0:      # the final refit on every row runs alongside the folds
            return fit_detectors(f.drop("fold"), s, kept=True)
        det = fit_detectors(f.filter(F.col("fold") != i), s, kept=True)
        return cut_lineage(base_scores(f.filter(F.col("fold") == i), det, live=False)
                           .select(key, "label", *BASE))

    f.count()  # cached once, before the fits read it side by side
    res = parallel_map(fold, range(0, s.folds + 1), s.parallelism + 1)  # so many folds and the refit
    f.unpersist()
    final, parts = res[0], res[1:]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    final.meta = _fit_meta(oof, s)
    return final


def fit_blending(train: DataFrame, s: Settings = Settings(), seed: int = 0,
                 key: str = "id") -> Detectors:
    """Base models on one half, meta model on the other, then refit
    the base models on every row."""
    a, b = split(train, 0.5, seed, key)
    det, final = parallel_map(lambda t: fit_detectors(t, s), [a, train], s.parallelism)
    held = cut_lineage(base_scores(b, det, live=False).select(key, "label", *BASE))
    final.meta = _fit_meta(held, s)
    return final


def annotate(df: DataFrame, det: Detectors, mode: str = "stacking") -> DataFrame:
    """Base scores, then the chosen vote in ``label_prob``; ``average`` gives
    the weighted average (H5) beside it in ``wavg_label_prob``."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    if mode == "stacking" and det.meta is None:
        raise ValueError("stacking needs a meta model: fit by fit_stacking or fit_blending")
    sc = base_scores(df, det)
    if mode == "stacking":
        return vote_stacking(sc, det.meta, "label_prob")
    if mode == "majority":
        return vote_majority(sc, out="label_prob")
    return vote_weighted(vote_average(sc, out="label_prob"), out="wavg_label_prob")


def label_and_score(df: DataFrame, det: Detectors, mode: str = "stacking") -> DataFrame:
    """Annotate, then P/R/F1 and AUC against the gold label column."""
    a = cut_lineage(annotate(df, det, mode).select("label", "label_prob"))
    return prf(a, "label_prob", "label").crossJoin(F.broadcast(roc_auc(a, "label_prob", "label")))  # one row each


def learner_weights(det: Detectors, day=None) -> DataFrame:
    """Meta-model feature importances as (day, learner, weight)."""
    spark = current_session()
    names = ["Social Classifier", "User Profile Classifier", "Tweet Text Classifier"]
    return spark.createDataFrame([(str(day), n, float(w)) for n, w in zip(names, det.meta.importances)],
                                 "day string, learner string, weight double")


def grow(training: DataFrame, batch: DataFrame, scored: DataFrame, lo: float = 0.3, hi: float = 0.7,
         balance_mode: str = "equal", key: str = "id", hash: str = "xx") -> DataFrame:
    """One step of self-training: the training rows plus the batch's confident rows
    (label 1 for p >= hi, 0 for p <= lo), balanced. ``scored``: (key, label_prob)."""
    conf = confident(scored.select(key, "label_prob"), "label_prob", lo, hi)
    picked = balance(conf.filter("label = 1"), conf.filter("label = 0"), balance_mode,
                     key=key, hash=hash).select(key, "label")
    new = batch.drop("label").join(picked, key).select(*training.columns)
    return training.unionByName(new)


def _fit(train: DataFrame, s: Settings, mode: str, key: str) -> Detectors:
    return fit_stacking(train, s, key) if mode == "stacking" else fit_detectors(train, s)


def self_train(training: DataFrame, live: DataFrame, s: Settings = Settings(),
               mode: str = "stacking", lo: float = 0.3, hi: float = 0.7,
               balance_mode: str = "equal", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """For each day of ``live`` in order: annotate, grow the training rows by
    the confident ones, refit. Returns (annotated live rows, learner weights per
    day; the weights are empty unless ``mode`` is stacking). The day list is a
    tiny distinct aggregate; the training table is checkpointed every day."""
    spark = training.sparkSession
    days = [r["day"] for r in live.select(F.to_date("created_at").alias("day")).distinct()
            .orderBy("day").collect()]
    # texts are counted once, not in every day's fits
    live = cut_lineage(counted(live))
    train = cut_lineage(counted(training))
    det = _fit(train, s, mode, key)
    res = spark.createDataFrame([], f"{key} long, day string, label_prob double")
    weights = spark.createDataFrame([], "day string, learner string, weight double")
    for day in days:
        batch = live.filter(F.to_date("created_at") == F.lit(day))
        ann = cut_lineage(annotate(batch, det, mode).select(key, "label_prob"))
        res = res.unionByName(ann.select(key, F.lit(str(day)).alias("day"), "label_prob"))
        train = cut_lineage(grow(train, batch, ann, lo, hi, balance_mode, key))
        det = _fit(train, s, mode, key)
        if det.meta is not None:
            weights = weights.unionByName(learner_weights(det, day))
    return res, weights


EIGHT = ("bl_label", "wl_label", "rf_label", "ud_label", "txt_label", "meta", "average", "majority")


def repeat_eval(train: DataFrame, test: DataFrame, repeats: int = 3,
                s: Settings = Settings(), key: str = "id") -> tuple[DataFrame, DataFrame]:
    """``repeats`` whole stacking fits, each with its own seed in the forest,
    the folds and the meta learner. Returns (rows, metrics): per test row the
    mean meta, average and majority scores; per score column the means over the
    runs of AUC, precision, recall and F1. Runs are averaged, so more of them
    only narrow the error (as 1 / sqrt(repeats)); three are the default."""
    def one_run(r):
        one = replace(s, seed=s.seed + r)
        det = fit_stacking(train, one, key, fold_mode="shuffled")
        sc = vote_stacking(base_scores(test, det), det.meta, "meta")
        sc = vote_majority(vote_average(sc, out="average"), out="majority")
        sc = cut_lineage(sc.select(key, "label", *EIGHT))
        flat = binarise(sc).select("label", *EIGHT)
        # the white list speaks for class 0
        flat = flat.withColumn("wl_label", 1 - F.col("wl_label"))
        return sc, cut_lineage(score_models(flat, list(EIGHT)))

    train = cut_lineage(counted(train))  # the runs share texts and counts
    runs = [one_run(r) for r in range(repeats)]  # a run's folds are parallel jobs already
    rows, metrics = runs[0]
    for a, b in runs[1:]:
        rows, metrics = rows.unionByName(a), metrics.unionByName(b)
    means = [F.avg(c).alias(f"mean_{c}") for c in ("meta", "average", "majority")]
    return (rows.groupBy(key, "label").agg(*means),
            metrics.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("auc", "precision", "recall", "f1")]))


# ---- the ensemble in a registry

def publish(det: Detectors, root: str, version: str) -> None:
    """Save every part of a fit as one version of a registry. Saving a version
    again replaces it, so a replayed batch publishes the same thing."""
    for name, df in (("black_list", det.bl), ("white_list", det.wl), ("hijacked_words", det.serve_words)):
        save_dict(df, f"{root}/{name}", version=version)
    parts = {"rf": det.rf, "profile": PipelineModel(stages=[*det.profile[0].stages, det.profile[1]]),
             "text": PipelineModel(stages=[*det.text[0].stages, det.text[1]])}
    for name, model in parts.items():
        save_model(model, f"{root}/models/{name}", version=version)
    if det.meta is not None:
        save_grid(det.meta, f"{root}/models/meta", version=version)


def from_registry(reg: ModelRegistry) -> Detectors:
    """The newest published fit, for live scoring."""
    apart = lambda m: (PipelineModel(stages=m.stages[:-1]), m.stages[-1])
    return Detectors(reg.tables["black_list"], reg.tables["white_list"], reg.tables["hijacked_words"],
                     reg.tables["hijacked_words"], reg.models["rf"], apart(reg.models["profile"]),
                     apart(reg.models["text"]), reg.models.get("meta"))
