"""Fitted models and the hot-reload registry."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from tagtriage.operators.boosting import BoostedGrid
from tagtriage.session import current_session
from tagtriage.sources.dicts import USER_LIST_SCHEMA, WORD_TABLE_SCHEMA, load_dict
from tagtriage.sources.storage import children, exists, latest_version, mark_ready


def save_model(model, path: str, version: str | None = None) -> str:
    """Write a fitted pipeline (overwrite); with ``version`` under
    ``path/v=<version>``, published once it is whole."""
    target = f"{path}/v={version}" if version else path
    model.write().overwrite().save(target)
    if version:
        mark_ready(current_session(), target)
    return target


def save_grid(grid: BoostedGrid, path: str, version: str | None = None) -> str:
    """A11 for a boosted meta learner: one row of Parquet, under the same layout."""
    target = f"{path}/v={version}" if version else path
    grid.save(target)
    if version:
        mark_ready(current_session(), target)
    return target


def load_model(path: str, cls=PipelineModel):
    """Load a fitted pipeline (or boosted grid), or None when there is none.
    A model that is there but can't be read is an error."""
    spark = current_session()
    if not exists(spark, path):
        return None
    return cls.load(path) if exists(spark, f"{path}/metadata") else BoostedGrid.load(spark, path)


class ModelRegistry:
    """Lists, word tables and models under one versioned root; call
    ``reload()`` (e.g. at the start of every micro-batch) to pick up the
    newest version that the updater has published."""

    TABLES = {"black_list": USER_LIST_SCHEMA, "white_list": USER_LIST_SCHEMA, "hijacked_words": WORD_TABLE_SCHEMA}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.versions: dict[str, str] = {}
        self.tables: dict = {}
        self.models: dict = {}

    def _newest(self, name: str) -> str:
        path = f"{self.root}/{name}"
        return latest_version(self.spark, path) or path

    def reload(self) -> "ModelRegistry":
        """Tables are read anew; a model is loaded when its path has changed."""
        paths = {n: self._newest(n) for n in self.TABLES}
        self.tables = {n: load_dict(self.spark, paths[n], schema) for n, schema in self.TABLES.items()}
        for name in children(self.spark, f"{self.root}/models"):
            paths[f"models/{name}"] = path = self._newest(f"models/{name}")
            if self.versions.get(f"models/{name}") != path or path.endswith(f"models/{name}"):
                self.models[name] = load_model(path)
        self.versions = paths
        return self
