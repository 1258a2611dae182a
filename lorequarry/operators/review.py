"""Spaced repetition: folding attempts into a schedule, and the views over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T

STATE = "struct<stage:int,nextReviewAt:bigint,attempts:bigint,correct:bigint,wrong:bigint,lastReviewedAt:bigint,lastCorrect:boolean>"


def empty_state() -> Column:
    return F.struct(
        F.lit(0).alias("stage"),
        F.lit(0).cast("bigint").alias("nextReviewAt"),
        F.lit(0).cast("bigint").alias("attempts"),
        F.lit(0).cast("bigint").alias("correct"),
        F.lit(0).cast("bigint").alias("wrong"),
        F.lit(None).cast("bigint").alias("lastReviewedAt"),
        F.lit(None).cast("boolean").alias("lastCorrect"),
    ).cast(STATE)


def next_state(state: Column, ms: Column, correct: Column) -> Column:
    """One attempt: the first and any wrong one go to stage 0; a right one advances if it was due."""
    first = state["attempts"] == 0
    due = state["nextReviewAt"] <= ms
    stage = F.when(~correct | first, 0).when(due, F.least(state["stage"] + 1, F.lit(len(X.REVIEW_INTERVALS_MS) - 1))).otherwise(state["stage"])
    wait = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in X.REVIEW_INTERVALS_MS]), stage + 1)
    return F.struct(
        stage.cast("int").alias("stage"),
        F.when(correct & ~first & ~due, state["nextReviewAt"]).otherwise(ms + wait).alias("nextReviewAt"),
        (state["attempts"] + 1).alias("attempts"),
        (state["correct"] + correct.cast("bigint")).alias("correct"),
        (state["wrong"] + (~correct).cast("bigint")).alias("wrong"),
        ms.alias("lastReviewedAt"),
        correct.alias("lastCorrect"),
    ).cast(STATE)


def fold(attempts: DataFrame, point: str = "point_id", time: str = "ts_ms", order: str = "ord", correct: str = "correct") -> DataFrame:
    """The schedule of each point after all of its attempts, in order of (time, order).

    The state feeds back into itself, so a point's attempts are folded in one expression
    over its sorted (time, order, correct) triples: 17 bytes an attempt. A point is one
    learner's item, which bounds its history.
    """
    history = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(order).alias("o"), F.col(correct).alias("c"))))
    folded = F.aggregate("_history", empty_state(), lambda s, a: next_state(s, a["t"], a["c"]))
    return attempts.groupBy(point).agg(history.alias("_history")).select(point, folded.alias("_s")).select(point, "_s.*")


def with_records(points: DataFrame, records: DataFrame, point: str = "point_id") -> DataFrame:
    """Every point with its record, or the initial one."""
    zero = F.lit(0)
    joined = points.join(records, point, "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("stage", "attempts", "correct", "wrong")})


def due(joined: DataFrame, now_ms: Column | int) -> DataFrame:
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return joined.where(F.col("nextReviewAt").isNull() | (F.col("attempts") == 0) | (F.col("nextReviewAt") <= now))


def queue(joined: DataFrame, point: str = "point_id", limit: int | None = None) -> DataFrame:
    """Points by next review, unscheduled ones first; a limited queue is a top-k, not a full sort."""
    out = joined.withColumn("due_at", F.coalesce("nextReviewAt", F.lit(0).cast("bigint"))).orderBy("due_at", point)
    return out.limit(limit) if limit else out


def accuracy(attempts: DataFrame, *by: str) -> DataFrame:
    right, n = F.count_if(F.col("correct")), F.count("*")
    return attempts.groupBy(*by).agg(right.alias("n_correct"), n.alias("n_attempts"), T.percentage(right, n).cast("bigint").alias("accuracy"))


def recent(attempts: DataFrame, limit: int = X.RECENT_ATTEMPTS, time: str = "ts_ms", tie: str = "ord") -> DataFrame:
    """The newest attempts, as a top-k."""
    return attempts.orderBy(F.desc(time), F.desc(tie)).limit(limit)
