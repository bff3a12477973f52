"""tagtriage: Spark-native triage of topic-tagged message feeds.

Every operator takes and returns DataFrames; the heavy lifting is done by
Catalyst-planned DataFrame expressions, spark.ml estimators, and (only where
the semantics demand it) Arrow-batched pandas functions inside Spark tasks.
"""

from tagtriage.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
