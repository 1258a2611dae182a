"""Streaming forms of the schedule and of item deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import fixed as X

_STATE = "stage int, nextReviewAt bigint, attempts bigint, correct bigint, wrong bigint, lastReviewedAt bigint, lastCorrect boolean"
_OUT = f"point_id bigint, {_STATE}"


def step(state: tuple, ms: int, correct: bool) -> tuple:
    """One attempt, as ``operators.review.next_state`` has it."""
    stage, due_at, attempts, right, wrong, _, _ = state
    due = due_at <= ms
    if not correct or not attempts:
        stage = 0
    elif due:
        stage = min(stage + 1, len(X.REVIEW_INTERVALS_MS) - 1)
    if not (correct and attempts and not due):
        due_at = ms + X.REVIEW_INTERVALS_MS[stage]
    return stage, due_at, attempts + 1, right + correct, wrong + (not correct), ms, correct


def _update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, 0, 0, 0, 0, None, None)
    for row in pd.concat(batches).sort_values(["ts_ms", "ord"]).itertuples():
        now = step(now, int(row.ts_ms), bool(row.correct))
    now = (int(now[0]), int(now[1]), int(now[2]), int(now[3]), int(now[4]), int(now[5]), bool(now[6]))
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["point_id", "stage", "nextReviewAt", "attempts", "correct", "wrong", "lastReviewedAt", "lastCorrect"])


def fold_stream(attempts: DataFrame) -> DataFrame:
    """The schedule of each point that a micro-batch touches, in update mode.

    ``attempts`` streams (point_id, ts_ms, ord, correct); a point's state is seven numbers.
    """
    rows = attempts.select("point_id", "ts_ms", "ord", "correct")
    return rows.groupBy("point_id").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def first_of_stream(items: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """Items whose key wasn't seen within the watermark's delay."""
    return items.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def attempts_by_window(attempts: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Accuracy by window of event time, late rows within the delay included."""
    seen = attempts.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"))
    return seen.agg(F.count("*").alias("n_attempts"), F.count_if("correct").alias("n_correct")).select("w.start", "w.end", "n_attempts", "n_correct")
