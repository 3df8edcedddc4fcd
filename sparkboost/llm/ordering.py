"""Global positions in a sorted order, without any single task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches, written


def positioned(df: DataFrame, key: str, ties: list[str], size: str | None = None, within: str | None = None) -> DataFrame:
    """df with ``pos`` (0, 1, ... in order of key, ties broken by ``ties``) and ``nth`` (0, 1, ... among equal keys).

    within: a column, non-negative integers; positions then count separately for each of its values.
    size: a column of non-negative longs; ``before`` is then the sum of the sizes of all rows before.

    Rows are range partitioned by key, ties and their place in the input, so that a key that
    holds a third of all rows, or a row that is repeated so often, is dealt over partitions; the
    input's order must not change between runs (a scan's doesn't).  Every partition numbers its
    own rows as they stream by; the partitions' totals (a row for each partition and value of
    ``within``) are summed up by a window, and runs of a key that go on from one partition to the
    next are joined on the driver, from one row for each partition.
    """
    small_batches(df.sparkSession)
    given = df.withColumn("__place", F.monotonically_increasing_id())
    part = given.repartitionByRange(key, *ties, "__place").sortWithinPartitions(key, *ties).drop("__place")
    add = ["part", "row", "pos", "nth"] + (["before"] if size else [])
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"__{c}", T.LongType()) for c in add), T.StructField("__lead", T.BooleanType())])
    at = {c: df.columns.index(c) for c in (key, size, within) if c}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        seen: dict[int, tuple[int, int]] = {}
        last, run, done, leading = None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at[key])
            new = np.ones(n, dtype=bool)
            if n > 1:
                a, b = keys.slice(0, n - 1), keys.slice(1)
                same = pa.compute.fill_null(pa.compute.equal(a, b), False).to_numpy(zero_copy_only=False)
                both_null = pa.compute.and_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
                new[1:] = ~(same | both_null)
            first = (keys[0].as_py(),)
            new[0] = first != last
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            nth = np.where(start >= 0, np.arange(n) - start, np.arange(n) + run)
            last, run = (keys[n - 1].as_py(),), int(nth[-1]) + 1
            lead = np.cumsum(new) <= (0 if done else 1)
            lead &= leading
            leading = bool(lead[-1])
            group = batch.column(at[within]).to_numpy(zero_copy_only=False).astype(np.int64) if within else np.zeros(n, np.int64)
            sizes = batch.column(at[size]).to_numpy(zero_copy_only=False).astype(np.int64) if size else np.zeros(n, np.int64)
            pos, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                count, total = seen.get(int(g), (0, 0))
                pos[own] = count + np.arange(len(own))
                before[own] = total + np.cumsum(sizes[own]) - sizes[own]
                seen[int(g)] = count + len(own), total + int(sizes[own].sum())
            extra = [np.full(n, here, np.int64), done + np.arange(n), pos, nth] + ([before] if size else []) + [lead]
            done += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], names=[f.name for f in schema.fields])

    local = written(part.mapInArrow(number, schema), "positions")
    group = F.col(within) if within else F.lit(0)
    totals = local.groupBy("__part", group.alias("__group")).agg(F.count("*").alias("n"), *([F.sum(size).alias("s")] if size else []))
    earlier = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", "__group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), *([F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("__s")] if size else []))
    out = local.withColumn("__group", group).join(totals, ["__part", "__group"]).join(F.broadcast(_carries(local, key)), "__part")
    nth = F.col("__nth") + F.when(F.col("__lead"), F.col("__carry")).otherwise(0)
    return out.select(*df.columns, (F.col("__pos") + F.col("__n")).alias("pos"), nth.alias("nth"), *([(F.col("__before") + F.col("__s")).alias("before")] if size else []))


def _carries(local: DataFrame, key: str) -> DataFrame:
    """(__part, __carry): how many rows of a partition's first key lie in the partitions before."""
    ends = local.groupBy("__part").agg(
        F.min_by(F.struct(key), "__row").alias("first"), F.max_by(F.struct(key), "__row").alias("last"),
        (F.max_by("__nth", "__row") + 1).alias("run"), F.min("__lead").alias("one"),
    )
    carry, before, rows = 0, None, []
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):
        carry = carry if before == tuple(r["first"]) else 0
        rows.append((r["__part"], carry))
        carry = r["run"] + (carry if r["one"] else 0)
        before = tuple(r["last"])
    return local.sparkSession.createDataFrame(rows, "__part long, __carry long")
