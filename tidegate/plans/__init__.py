"""Registered queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES, Query

_TOPICS = (
    "source_queries", "cleaning_queries", "sampling_queries", "metric_queries", "model_queries", "study_queries", "twin_queries", "wide_queries", "null_queries",
    "stream_queries",
)


def _load() -> None:
    for topic in _TOPICS:
        importlib.import_module(f"{__name__}.{topic}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(sorted(QUERIES.items()))


def all_oracles() -> dict[str, str]:
    _load()
    return dict(sorted(ORACLES.items()))


def flagship(spark, sf_dir):
    _load()
    return QUERIES["flagship_slice_accuracy"](spark, sf_dir)
