"""All registered queries: name -> (spark_fn(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = ["q_lists", "q_clean", "q_text", "q_eval", "q_models", "q_select", "q_sources", "q_ml", "q_stream"]


def registry() -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"tagtriage.plans.{m}")
        for k, v in mod.Q.items():
            if k in out:
                raise ValueError(f"duplicate query {k}")
            out[k] = v
    return out
