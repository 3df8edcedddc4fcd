"""Online conformal calibration: a threshold that follows misses, with delayed receipts.

Predictions are issued in order; an outcome may come later, but outcomes are taken up once
and in the order of issue.  Each moves the key's threshold by lr * (miss - alpha).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidData

OUT = "key string, seq long, threshold double, missed boolean"


def step(threshold: float, score: float, alpha: float, rate: float) -> tuple[float, bool]:
    """The next threshold, and whether the score was above this one."""
    missed = score > threshold
    return max(threshold + rate * (float(missed) - alpha), 0.0), missed


def calibrated(df: DataFrame, alpha: float, rate: float, start: float = 0.0) -> DataFrame:
    """Batch form over (key, seq, score): every row with the threshold that held for it.  A key's rows must fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        if pdf["seq"].duplicated().any():
            raise InvalidData("a receipt was given twice")
        at, rows = start, []
        for key, seq, score in zip(pdf["key"], pdf["seq"], pdf["score"], strict=True):
            used = at
            at, missed = step(at, score, alpha, rate)
            rows.append((key, seq, used, missed))
        return pd.DataFrame(rows, columns=["key", "seq", "threshold", "missed"])

    return df.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("score").cast("double").alias("score")).groupBy("key").applyInPandas(run, OUT)


def calibrated_stream(stream: DataFrame, alpha: float, rate: float, start: float = 0.0) -> DataFrame:
    """Streaming form: state is a key's threshold, its next seq and the outcomes that came too early."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, next_, early = state.get if state.exists else (start, 0, "")
        waiting = {int(s): float(v) for s, _, v in (x.partition(":") for x in early.split(",") if x)}
        rows = []
        for pdf in batches:
            for seq, score in zip(pdf["seq"], pdf["score"], strict=True):
                if seq >= next_:  # a receipt for an earlier seq was taken up before
                    waiting.setdefault(int(seq), float(score))
        while next_ in waiting:
            used = at
            at, missed = step(at, waiting.pop(next_), alpha, rate)
            rows.append((key[0], next_, used, missed))
            next_ += 1
        state.update((at, next_, ",".join(f"{s}:{v!r}" for s, v in waiting.items())))
        yield pd.DataFrame(rows, columns=["key", "seq", "threshold", "missed"])

    thin = stream.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("score").cast("double").alias("score"))
    return thin.groupBy("key").applyInPandasWithState(run, OUT, "threshold double, next long, early string", "append", GroupStateTimeout.NoTimeout)
