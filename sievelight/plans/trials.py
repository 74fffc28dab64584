"""Timed runs of the whole rerank: cold, at several numbers of calls in flight, then warm from the score cache."""

from __future__ import annotations

import dataclasses
import time

from pyspark.sql import DataFrame

from ..operators import scoring
from . import rerank as plan


def trials(files: DataFrame, query: str, scorer: scoring.Scorer, in_flight=(1, 2, 4), repeats: int = 1) -> DataFrame:
    """(trial, in_flight, seconds, results): one row per run.  The warm run takes its scores from the table that the last cold run left."""
    spark, rows = files.sparkSession, []

    def timed(name, calls, used):
        for _ in range(repeats):
            began = time.perf_counter()
            n = plan.rerank(files, query, used).results.count()
            rows.append((name, calls, round(time.perf_counter() - began, 3), n))

    for calls in in_flight:
        used = dataclasses.replace(scorer, in_flight=calls) if hasattr(scorer, "in_flight") else scorer
        timed("cold", calls, used)
    timed("warm", 0, scorer)
    return spark.createDataFrame(rows, "trial string, in_flight int, seconds double, results long")
