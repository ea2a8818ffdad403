"""Saved feature and classifier models."""

from __future__ import annotations

from pyspark.ml import PipelineModel

from gullwatch.operators.classify import Scorer, Spec


def save_model(scorer: Scorer, path: str) -> None:
    """Always overwrites."""
    scorer.model.write().overwrite().save(path)


def load_model(path: str, spec: Spec) -> Scorer:
    return Scorer(spec, PipelineModel.load(path))
