"""Sources: category from file-name prefix, missing dictionaries, models."""

import json
import os
import tempfile

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import types as T

from tagtriage.sources import dicts, messages as ms, models


def test_read_by_prefix(spark):
    d = tempfile.mkdtemp()
    for name, rows in {"Apple-2019.json": [1, 2], "Food-2019.json": [3]}.items():
        with open(os.path.join(d, name), "w") as fh:
            for i in rows:
                fh.write(json.dumps({"id": i, "fulltext": f"t{i}"}) + "\n")
    df = ms.read_by_prefix(spark, d, "id long, fulltext string")
    assert sorted((r["id"], r["category"]) for r in df.collect()) == [(1, "Apple"), (2, "Apple"),
                                                                      (3, "Food")]


def test_missing_dict_is_empty(spark):
    df = dicts.load_dict(spark, "/nonexistent/path/xyz")
    assert df.count() == 0 and df.columns == ["user_id", "counts"]


def test_model_round_trip(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    m = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]).fit(df)
    p = os.path.join(tempfile.mkdtemp(), "m")
    models.save_model(m, p)
    assert models.load_model(p) is not None
    assert models.load_model(p + "-missing") is None


def test_malformed_lines_dropped(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "x.json"), "w") as fh:
        fh.write('{"id": 1, "text": "ok"}\n{"id": 2, "text": \n{"id": 3, "text": "fine"}\n')
    df = ms.read_raw(spark, d, "id long, text string")
    assert sorted(r["id"] for r in df.collect()) == [1, 3]


def test_quarantine_leaves_the_schema_and_caches_nothing(spark):
    d = tempfile.mkdtemp()
    lines = ['{"id": 1, "fulltext": "a"}', '{"id": 2, "fulltext": ', "", "  ", "no json", '{"id": "x", "fulltext": "b"}', '{"id": 4}']
    with open(os.path.join(d, "part.json"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fulltext", T.StringType())])
    good, bad = ms.read_raw(spark, d, schema, on_error="quarantine")
    assert schema.fieldNames() == ["id", "fulltext"]
    assert sorted((r.id, r.fulltext) for r in good.collect()) == [(1, "a"), (4, None)]
    assert sorted(r._corrupt_record for r in bad.collect()) == sorted([lines[1], lines[4], lines[5]])
    assert bad.count() == 3 and good.count() == 2
    assert not good.storageLevel.useMemory and not bad.storageLevel.useMemory
    dropped = ms.read_raw(spark, d, schema)
    assert dropped.columns == ["id", "fulltext"] and sorted(r.id for r in dropped.collect()) == [1, 4]
