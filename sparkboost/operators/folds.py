"""Cross-validation folds as tables (fold, row_id, role)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameter
from ..functions.rng import uniform
from .order import distinct_counts, running


def _roles(rows: DataFrame, test, train) -> DataFrame:
    return rows.select("fold", "row_id", F.when(test, "test").when(train, "train").alias("role")).where("role is not null")


def k_fold(df: DataFrame, row_id: str, folds: int, seed: int = 0) -> DataFrame:
    """Rows in a seeded order, dealt round robin: every row tests in one fold and trains in the others."""
    if folds < 2:
        raise InvalidParameter("there are at least two folds")
    rows = running(df.select(F.col(row_id).alias("row_id")), [uniform(F.col("row_id"), seed), "row_id"], {"place": F.lit(1)})
    all_ = rows.select("row_id", (F.col("place") % folds).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    return _roles(all_, F.col("own") == F.col("fold"), F.lit(True))


def query_folds(df: DataFrame, qid: str, row_id: str, folds: int, seed: int = 0) -> DataFrame:
    """Folds that keep the rows of a query together."""
    by = k_fold(df.select(qid).distinct(), qid, folds, seed).withColumnRenamed("row_id", "__q")
    return df.join(by, F.col(qid) == F.col("__q")).select("fold", F.col(row_id).alias("row_id"), "role")


def forward_chaining(df: DataFrame, row_id: str, splits: int, gap: int = 0) -> DataFrame:
    """Blocks of n // (splits + 1) rows in order: each tests once, what lies before it, but for a gap, trains."""
    n = df.count()
    size = n // (splits + 1)
    if not size:
        raise InvalidParameter("there are too few rows")
    rows = running(df.select(F.col(row_id).alias("row_id")), ["row_id"], {"place": F.lit(1)})
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    start = (F.col("fold") + 1) * size
    stop = F.when(F.col("fold") == splits - 1, n).otherwise((F.col("fold") + 2) * size)
    return _roles(rows, (F.col("place") >= start) & (F.col("place") < stop), F.col("place") < start - gap)


def purged_at(df: DataFrame, row_id: str, time: str, label_end: str, starts: Sequence[int]) -> DataFrame:
    """Blocks of test times from each start to the next: rows train whose label has ended by the start."""
    starts = sorted(starts)
    blocks = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(int(s)).alias("lo"), F.lit(int(starts[k + 1]) if k + 1 < len(starts) else None).cast("long").alias("hi")) for k, s in enumerate(starts)))
    rows = df.select(F.col(row_id).alias("row_id"), F.col(time).alias("t"), F.col(label_end).alias("e"), F.explode(blocks).alias("b")).select("row_id", "t", "e", "b.*")
    return _roles(rows, (F.col("t") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("t") < F.col("hi"))), (F.col("t") < F.col("lo")) & (F.col("e") <= F.col("lo")))


def purged_forward(df: DataFrame, row_id: str, time: str, label_end: str, splits: int, share: float = 0.5) -> DataFrame:
    """The last ``share`` of the distinct times in ``splits`` blocks of equal numbers of times."""
    times = distinct_counts(df.select(time).distinct(), F.col(time))
    n = times.count()
    tested = int(n * share)
    if tested < splits:
        raise InvalidParameter("there are too few distinct times")
    ranks = [n - tested + tested * k // splits for k in range(splits)]
    starts = [r["value"] for r in times.where(F.col("before").isin(*ranks)).orderBy("value").collect()]
    return purged_at(df, row_id, time, label_end, starts)


def purged_tail(df: DataFrame, row_id: str, time: str, label_end: str, share: float, by: str = "rows") -> DataFrame:
    """One fold: the last share of the rows, or of the span of time, tests; ended labels before it train."""
    if by == "span":
        row = df.agg(F.min(time).alias("a"), F.max(time).alias("z")).first()
        start = row["z"] - int((row["z"] - row["a"]) * share)
    else:
        counts = distinct_counts(df, F.col(time))
        start = counts.where(F.col("before") >= int(df.count() * (1 - share))).agg(F.min("value").alias("v")).first()["v"]
    return purged_at(df, row_id, time, label_end, [start])
