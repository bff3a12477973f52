"""Steps that once moved a row a term, or a fixed share of the input to one task."""

import re

import numpy as np

from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tf_vectors_move_texts_only(spark):
    from tagtriage.operators import features as fe
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (None, "aa"), (2, None)], "id long, text string")
    tv = fe.tf_vectors(fe.term_counts(df, "text", by_doc=True))
    assert len(re.findall(r"Exchange hashpartitioning", _plan(tv))) == 1
    got = {(r["id"], r["term"]): round(r["value"] * 3, 6) for r in tv.collect()}
    assert got == {(1, "aa"): 2, (1, "bb"): 2, (1, "cc"): 1, (None, "aa"): 3}


def test_streams_are_cut_finer_as_they_grow(spark, tmp_path, monkeypatch):
    from tagtriage.plans import q_stream
    spark.createDataFrame([(i, "some words " * 20, "en", "src1", 220) for i in range(40)] + [(7, "again", "en", "src1", 5)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    small = sorted(r["id"] for r in q_stream._n1_n5(spark, str(tmp_path)).select(F.col("id")).collect())
    monkeypatch.setattr(q_stream, "SLICE_BYTES", 500)
    src, per = q_stream._slices(spark, str(tmp_path))
    assert per == 5 and spark.read.text(src).count() == 41
    fine = sorted(r["id"] for r in q_stream._n1_n5(spark, str(tmp_path)).select(F.col("id")).collect())
    assert fine == small == [i for i in range(40) if i != 7]


def test_rounds_of_text_fits_send_a_bounded_number_of_partials(spark):
    """Their partial sums (2 MB each) once were as many as the input's partitions."""
    from tagtriage.operators import classifiers as cf
    from tagtriage.session import few_partials
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(i, f"word{i % 3} and word{i % 5}", i % 2) for i in range(60)], "id long, t string, label int")
    wide = df.repartition(3 * cores, "id")
    assert few_partials(wide).rdd.getNumPartitions() <= cores
    vec, model = cf.fit_text(wide, "t")
    again, held = cf.fit_text(cf.slot_counts(wide, "t", "n"), "t", counted="n")
    assert abs(model.coefficients.toArray() - held.coefficients.toArray()).max() < 1e-6
    a = cf.score_text(df, vec, model).select("id", "txt_label").collect()
    b = dict((r["id"], r["txt_label"]) for r in cf.score_text(cf.slot_counts(df, "t", "n"), again, held, counted="n").collect())
    assert all(abs(r["txt_label"] - b[r["id"]]) < 1e-6 for r in a)


def test_slots_are_looked_up_once_a_term(spark):
    from tagtriage.operators import classifiers as cf
    df = spark.createDataFrame([(i, "aa bb cc") for i in range(40)], "id long, t string")
    vec = cf.tfidf_model(df, "t")
    named = cf.slot_terms(df, vec)
    plan = _plan(named)
    assert "BatchEvalPython" not in plan and "HashAggregate" not in plan  # the distinct terms are stored
    assert {r["term"]: r["slot"] for r in named.collect()} == {t: vec.stages[1].indexOf(t) for t in ("aa", "bb", "cc")}


def test_stacking_normalises_the_training_text_once(spark, monkeypatch):
    from tagtriage.operators import stacking as stk
    seen = []
    old = stk.tx.normalise
    monkeypatch.setattr(stk.tx, "normalise", lambda c, chain: (seen.append(chain), old(c, chain))[1])
    rows = [(i, i % 7, f"2024-01-{i % 27 + 1:02d}", f"story {i % 3} of word{i % 5}", "" if i % 4 else None, i, i % 11, i % 5, i % 2, bool(i % 2), i % 3, i % 2)
            for i in range(80)]
    df = stk.prepare(spark.createDataFrame(rows, "id long, user_id long, created_at string, fulltext string, user_description string, user_friends_count long, "
                                                 "user_followers_count long, retweet_count long, favorite_count long, user_verified boolean, number_of_hashtags int, label int")
                     .withColumn("created_at", F.col("created_at").cast("timestamp")))
    det = stk.fit_stacking(df, stk.Settings(rf_trees=2, meta_rounds=3, folds=2))
    assert seen.count("train") == 1
    got = stk.annotate(df, det).select("id", "label_prob").collect()
    assert sorted(r["id"] for r in got) == list(range(80)) and all(0 <= r["label_prob"] <= 1 for r in got)


def _long(rows):
    return {(r[0], r[1]): round(r[2], 9) for r in rows}


def test_packed_tfidf_looks_terms_up_once_a_block(spark, monkeypatch):
    """The idf join once moved a row a term of a document, twice."""
    from tagtriage.operators import features as fe
    from tagtriage.operators import packed as pk
    rows = [(i // 2 if i < 8 else i, f"word{i % 3} and Word{i % 5} and x" if i % 6 else None) for i in range(40)] + [(None, "and all"), (None, "all"), (77, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    for limit in (8_000_000, 9):  # one block a task, and blocks of a few documents
        monkeypatch.setattr(pk, "BLOCK", limit)
        counts = fe.term_counts(df, "text", packed=True)
        assert _long(fe.Packed(counts.docs, "id").long().collect()) == _long(fe.term_counts(df, "text").collect())
        for mf in (None, 3):
            old = fe.tfidf(fe.term_counts(df, "text", by_doc=True), n_docs=43, max_features=mf).collect()
            new = fe.tfidf(counts, n_docs=43, max_features=mf).long()
            got = new.collect()
            assert len(got) == len(old) and _long(got) == _long(old)
    # nothing but a block's documents and a row for each of its terms is moved
    assert "term" not in "".join(l for l in _plan(new).split("\n") if "Exchange hashpartitioning(block" in l)


def _kmeans_by_hand(vecs, first, rounds):
    """Plain k-means: {id: {term: value}}, first centres."""
    centres = [dict(vecs[i]) for i in first]
    for r in range(rounds + 1):
        to = {i: min(range(len(centres)), key=lambda c: (round(sum(x * x for x in centres[c].values())
                     - 2 * sum(x * centres[c].get(t, 0) for t, x in v.items()), 12), c)) for i, v in vecs.items()}
        if r < rounds:
            for c in range(len(centres)):
                own = [vecs[i] for i in vecs if to[i] == c]
                if own:
                    centres[c] = {t: sum(v.get(t, 0) for v in own) / len(own) for v in own for t in v}
    return to, centres


def test_kmeans_moves_a_row_a_term_of_a_block(spark, monkeypatch):
    """A round once made a row for each term of a text and centre."""
    from tagtriage.operators import clusters, packed as pk
    rows = [(i, f"t{(i * j) % 11}", float(1 + (i + j) % 4)) for i in range(30) for j in range(1, 5)]
    vecs = {}
    for i, t, x in rows:
        vecs.setdefault(i, {})
        vecs[i][t] = vecs[i].get(t, 0) + x
    df = spark.createDataFrame(rows, "id long, term string, value double")
    for limit in (8_000_000, 20):
        monkeypatch.setattr(pk, "BLOCK", limit)
        packed = pk.pack_rows(df)
        packed.weights = packed.terms().withColumn("w", F.lit(1.0)).select("block", "idx", "term", "w")
        first = clusters.first_centres(packed, 3, 1)
        drawn = {c: {r["term"]: r["value"] for r in first.filter(F.col("cluster") == c).groupBy("term").agg(F.sum("value").alias("value")).collect()} for c in range(3)}
        ids = [next(i for i in vecs if vecs[i] == drawn[c]) for c in range(3)]
        to, want = _kmeans_by_hand(vecs, ids, 2)
        centres, assigned = clusters.kmeans(df, k=3, rounds=2)
        assert {r["id"]: r["cluster"] for r in assigned.collect()} == to
        got = {}
        for r in centres.collect():
            got.setdefault(r["cluster"], {})[r["term"]] = r["value"]
        for c, v in enumerate(want):
            assert set(got[c]) == set(v) and all(abs(got[c][t] - x) < 1e-9 for t, x in v.items())
    # sums arrive added up: a row a block, cluster and term, not one a text
    _, added = clusters.nearest(pk.Packed(packed.docs, "id", packed.weights), centres)
    blocks = packed.docs.select("block").distinct().count()
    assert added.count() <= blocks * 3 * 11 and added.groupBy("term", "cluster").count().agg(F.max("count")).first()[0] <= blocks


def test_small_fits_send_few_partials(spark, monkeypatch):
    """A round's partials were as many as tasks run at once, however few the rows."""
    from tagtriage import session
    df = spark.range(60).repartition(4)
    assert session.few_partials(df, 60).rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "PARTIAL_ROWS", 20)
    assert session.few_partials(df, 60).rdd.getNumPartitions() == 3
    assert session.few_partials(df, 10 ** 9).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_profile_fit_holds_the_slots_in_use(spark, monkeypatch):
    """Its rounds moved all slots for a handful of words."""
    from tagtriage.operators import classifiers as cf
    df = spark.createDataFrame([(i, f"writes word{i % 3} of word{i % 5}" if i % 7 else None, int(i % 3 == 0)) for i in range(60)]
                               + [(60, "", 1), (61, "never seen", 0)], "id long, user_description string, label int")
    train = df.filter("id < 60")
    vec, model = cf.fit_profile(train)
    assert model.numFeatures == 7  # writes, of, word0 to word4
    few = {r["id"]: r["ud_label"] for r in cf.score_profile(df, vec, model).select("id", "ud_label").collect()}
    monkeypatch.setattr(cf, "FEW_SLOTS", 0)
    vec, model = cf.fit_profile(train)
    assert model.numFeatures == cf.SLOTS
    every = {r["id"]: r["ud_label"] for r in cf.score_profile(df, vec, model).select("id", "ud_label").collect()}
    assert len(few) == 62 and few.keys() == every.keys() and all(abs(few[i] - every[i]) < 1e-6 for i in few)


def test_bounded_picks_take_a_bounded_number_of_rounds(spark, monkeypatch):
    """A pick that lowered all gains alike once had all rows scored, a round's rows at a time."""
    from tagtriage.operators import selection as sel
    df = spark.createDataFrame([(i, [1.0 + (i * 7 % 300) / 3000.0, 1.0 + (i * 11 % 300) / 3000.0]) for i in range(300)], "id long, features array<double>")
    seen = []
    old = sel.FeatureBased.gain_row
    monkeypatch.setattr(sel.FeatureBased, "gain_row", lambda self, st, r: (seen.append(r["id"]), old(self, st, r))[1])
    want = [(r["id"], round(r["gain"], 9)) for r in sel.select(df, sel.FeatureBased(), 4).collect()]
    got = [(r["id"], round(r["gain"], 9)) for r in sel.select(df, sel.FeatureBased(), 4, strategy="bounded", batch=2).collect()]
    assert got == want and len(seen) <= 4 * (2 + 4 + 8 + 2)
    seen.clear()
    ties = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "id long, features array<double>")
    assert [r["id"] for r in sel.select(ties, sel.FeatureBased(), 3, strategy="bounded", batch=2).collect()] == [0, 1, 2]


def _nearest_by_hand(X, k):
    d = ((X[:, None] - X[None]) ** 2).sum(2)
    return {i: sorted((d[i, j] if j != i else -1.0, j) for j in range(len(X)))[:k + 1] for i in range(len(X))}


def test_blocks_meet_in_any_partition(spark, monkeypatch):
    """Block numbers were ints on one side and longs on the other: pairs of blocks met only
    where all partitions of the shuffle were read by one task."""
    from tagtriage.operators import selection as sel
    monkeypatch.setattr(sel, "PAIR_BLOCK", 8)
    X = np.random.default_rng(5).normal(size=(60, 4))
    X[9] = X[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, features array<double>").localCheckpoint()
    want = _nearest_by_hand(X, 3)
    some = spark.createDataFrame([(4,), (9,), (33,)], "id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r["i"], r["j"]) for r in sel._nearest(df, "id", "euclidean", 3).collect())
        few = sorted((r["i"], r["j"]) for r in sel._nearest(df, "id", "euclidean", 3, some).collect())
        top = sel._widest_kept(df, "id", 3)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == sorted((i, j) for i in want for _, j in want[i])
    assert few == [x for x in got if x[0] in (4, 9, 33)]
    assert abs(top - max(d for i in want for d, _ in want[i])) < 1e-9


def test_live_refits_share_counted_texts(spark, tmp_path, monkeypatch):
    """Every refit once normalised and counted all training texts again."""
    from tagtriage.operators import stacking as stk
    from tagtriage.plans import q_stream
    from tagtriage.sources import models
    spark.createDataFrame([(i, f"some words {i} " * 3, "en", "src1", 30) for i in range(24)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fits = []

    class Registry:
        def __init__(self, *a):
            pass

        def reload(self):
            pass

    monkeypatch.setattr(models, "ModelRegistry", Registry)
    monkeypatch.setattr(stk, "publish", lambda *a: None)
    monkeypatch.setattr(stk, "from_registry", lambda reg: None)
    monkeypatch.setattr(stk, "annotate", lambda df, det: df.withColumn("label_prob", (F.col("id") % 2).cast("double")))
    monkeypatch.setattr(stk, "fit_stacking", lambda t: fits.append((stk.COUNTS in t.columns, t.filter(F.col(stk.COUNTS).isNull()).count(),
                                                                    sorted(r["id"] for r in t.select("id").collect()))))
    got = q_stream._n7(spark, str(tmp_path))
    assert got.count() == 24
    assert all(has and nulls == 0 for has, nulls, _ in fits) and len(fits) == 3
    ids = [x for *_, x in fits]
    assert ids[0] == list(range(12)) and set(ids[0]) <= set(ids[1]) <= set(ids[2]) and len(ids[2]) > 12


def test_facility_rounds_take_more_candidates(spark, monkeypatch):
    """A round took PAIR_BLOCK candidates at the most; it takes 16 times as many now."""
    from tagtriage.operators import selection as sel
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(3).normal(size=(200, 6)))],
                               "id long, features array<double>").localCheckpoint()
    want = [(r["id"], round(r["gain"], 9)) for r in sel.select(df, sel.Facility(), 2, check=False).collect()]
    monkeypatch.setattr(sel, "PAIR_BLOCK", 4)
    monkeypatch.setattr(sel, "ROW_BLOCK", 7)
    rounds, old = [], sel._metric_rows
    monkeypatch.setattr(sel, "_metric_rows", lambda X, m: (rounds.append(len(X)), old(X, m))[1])  # on the driver: once a round
    got = [(r["id"], round(r["gain"], 9)) for r in sel.select(df, sel.Facility(), 2, check=False, batch=2).collect()]
    assert got == want and 0 < len(rounds) <= 12 and max(rounds) <= 64
