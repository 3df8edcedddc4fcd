"""Order statistics and running sums over all rows without a task that sees all of them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_held: list[DataFrame] = []
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def releasing() -> Iterator[None]:
    """Drops, at its end, the caches that ``running`` has made inside; results must have been collected by then."""
    before = len(_held)
    try:
        yield
    finally:
        for df in _held[before:]:
            df.unpersist()
        del _held[before:]


@contextmanager
def batches_of(spark, most: int) -> Iterator[None]:
    """Inside, tasks send Python up to so many bytes in a batch.

    Below 2**31 - 1 the writer measures its batch after every row, which costs more than sending a row of a few numbers.
    """
    old = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.set(_BYTES, old)


def hold(df: DataFrame) -> DataFrame:
    """df in the cache until the next end of ``releasing``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df


def running(df: DataFrame, keys: Sequence[Column | str], sums: dict[str, Column], *, after: bool = False) -> DataFrame:
    """df with, for each name in sums, the sum of the column over the rows before, in order of keys.

    after: the sum over the rows from this one on instead.  Rows are range partitioned and sorted
    (the one shuffle); each partition adds up its rows as they stream by, and the partitions'
    totals, a row for each, are added.  Keys must tell rows apart that sums are to tell apart: equal
    keys come in any order.  The numbered rows are cached, see ``releasing``.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    order = [c.desc() for c in cols] if after else cols
    whole = {name: df.select(c.alias("x")).schema["x"].dataType.typeName() in ("long", "integer", "short", "byte") for name, c in sums.items()}
    given = df.withColumns({f"__v_{name}": F.coalesce(c.cast("long" if whole[name] else "double"), F.lit(0).cast("long" if whole[name] else "double")) for name, c in sums.items()})
    given = given.withColumns({f"__k{k}": c for k, c in enumerate(cols)})
    order = [F.col(f"__k{k}").desc() if after else F.col(f"__k{k}") for k in range(len(cols))]
    ranged = given.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(*(f"__k{k}" for k in range(len(cols))))
    names = ranged.columns
    at = [(names.index(f"__v_{name}"), name) for name in sums]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in ranged.schema), T.StructField("__part", T.IntegerType()), *(T.StructField(f"__b_{name}", T.LongType() if whole[name] else T.DoubleType()) for name in sums)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = TaskContext.get().partitionId(), {name: 0 for _, name in at}
        for batch in batches:
            out = []
            for k, name in at:
                x = batch.column(k).to_numpy(zero_copy_only=False)
                run = np.cumsum(x) + total[name]
                out.append(pa.array(run if after else run - x))
                total[name] = run[-1] if len(run) else total[name]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, here, np.int32)), *out], names=[f.name for f in schema])

    parts = hold(ranged.mapInArrow(number, schema))
    totals = parts.groupBy("__part").agg(*(F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__t_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in sums))
    out = parts.join(F.broadcast(totals), "__part")
    return out.withColumns({name: F.col(f"__b_{name}") + F.col(f"__o_{name}") for name in sums}).drop("__part", *(f"__{c}_{name}" for name in sums for c in "vbo"))


def distinct_counts(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """(value, n, before): distinct values with the (weighted) number of rows at and below them."""
    n = F.count("*") if weight is None else F.sum(weight)
    by = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(n.alias("n"))
    return running(by, ["value"], {"before": F.col("n")})


def kth(df: DataFrame, value: Column, ranks: Sequence[int]) -> list[float | None]:
    """The values of those ranks, from 1 on, in ascending order; None beyond the last."""
    with releasing():
        counts = distinct_counts(df, value)
        return _ranks(counts, ranks)


def _ranks(counts: DataFrame, ranks: Sequence[int]) -> list[float | None]:
    wanted = [F.max(F.when((F.col("before") < r) & (F.col("before") + F.col("n") >= r), F.col("value"))).alias(f"r{k}") for k, r in enumerate(ranks)]
    row = counts.agg(*wanted).first()
    return [row[f"r{k}"] for k in range(len(ranks))]


def grid_quantiles(df: DataFrame, column: str, alphas: Sequence[float]) -> list[float]:
    """Quantiles by linear interpolation on the (n + 1) * alpha grid, clamped to the extremes."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return [float("nan")] * len(alphas)
    places = [min(max(a * (n + 1), 1.0), float(n)) for a in alphas]
    ranks = [r for x in places for r in (math.floor(x), min(math.floor(x) + 1, n))]
    values = kth(df, F.col(column).cast("double"), ranks)
    return [values[2 * k] + (x - math.floor(x)) * (values[2 * k + 1] - values[2 * k]) for k, x in enumerate(places)]
