"""Cut points of features and the bins of rows.

A feature's cuts ascend and never include its minimum; the last one lies above its maximum.
The bin of a value is the number of cuts that are not above it, the last bin at most; a split
at bin b sends the values below cut b to the left.  A missing value has no bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidData

#: Values of a feature that a summary holds: up to so many distinct ones all are exact, beyond, each
#: merge of summaries moves a rank by at most one part in so many.
SUMMARY = 8192
#: Bins (or categories) of a feature at most: codes have 16 bits and 0 is missing.
MOST_BINS = 65_534


@dataclass
class Cuts:
    """values: cuts of each feature; categorical: category codes in place of cuts."""

    features: list[str]
    values: list[np.ndarray]
    categorical: list[bool]

    def bins_of(self, f: int, x: np.ndarray) -> np.ndarray:
        """Bins of values, -1 for missing and unseen categories' rows in bin 0."""
        cuts = self.values[f]
        if self.categorical[f]:
            k = np.searchsorted(cuts, x)
            out = np.where(cuts[np.minimum(k, len(cuts) - 1)] == x, k, 0) if len(cuts) else np.zeros(len(x), np.int64)
        else:
            out = np.minimum(np.searchsorted(cuts, x, side="right"), max(len(cuts) - 1, 0))
        return np.where(np.isnan(x), -1, out)

    def rows(self) -> list[tuple[int, int, float, bool]]:
        """(feature, bin, cut_value, is_categorical) of all cuts."""
        return [(f, b, float(v), c) for f, (cuts, c) in enumerate(zip(self.values, self.categorical, strict=True)) for b, v in enumerate(cuts)]

    @property
    def sizes(self) -> list[int]:
        return [len(v) for v in self.values]

    @property
    def code(self) -> type:
        """Type of packed codes: a bin plus 1, 0 for a missing value."""
        return np.uint8 if max(self.sizes, default=0) < 256 else np.uint16

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) packed codes of raw features."""
        out = np.empty(x.shape, dtype=self.code)
        for f in range(x.shape[1]):
            out[:, f] = self.bins_of(f, x[:, f]) + 1
        return out


def clean(column: str) -> Column:
    """A feature as a 32-bit number, with NaN as missing."""
    x = F.col(column).cast("float")
    return F.when(~F.isnan(x), x)


def distinct_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value) of all distinct present values; features are unpivoted before one shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), clean(f).alias("value")) for k, f in enumerate(features))))
    return df.select(each.alias("e")).select("e.feature", "e.value").where("value is not null").distinct()


def summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with the sums of their weights."""
    values, at = np.unique(values, return_inverse=True)
    return values, np.bincount(at, weights=weights, minlength=len(values))


def pruned(values: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most size + 1 of the values: the least, and those at which the running weight reaches k / size of it all.

    The running weight at a value that is kept stays exact.
    """
    if len(values) <= size:
        return values, weights
    run = np.cumsum(weights)
    keep = np.unique(np.minimum(np.searchsorted(run, run[-1] * np.arange(0, size + 1) / size), len(values) - 1))
    return values[keep], np.diff(np.concatenate([[0.0], run[keep]]))


def summaries(df: DataFrame, features: Sequence[str], weight: Column | None = None, *, size: int = SUMMARY, whole: Sequence[int] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, weights) of each feature's weighted distribution, of bounded size.

    Each partition summarises its values as batches stream by; the summaries (one row for each
    partition and feature) are merged by feature in two steps, so that no task and not the driver
    reads a summary of every partition.  Features in ``whole`` are never pruned and may have
    MOST_BINS values.  Infinite values and rows of weight 0 or less aren't allowed and don't count.
    """
    n, spark = len(features), df.sparkSession
    source = df.select((F.lit(1.0) if weight is None else weight.cast("double")).alias("w"), *(clean(f).alias(f"f{k}") for k, f in enumerate(features)))
    kinds = "feature int, lane int, v binary, w binary"

    def shrunk(k: int, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if k not in whole:
            return pruned(values, weights, size)
        if len(values) > MOST_BINS:
            raise InvalidData(f"feature {features[k]!r} has more than {MOST_BINS} distinct values")
        return values, weights

    def out(held, lane) -> Iterator[pa.RecordBatch]:
        for k, (v, w) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([v.astype("<f4").tobytes()]), pa.array([w.astype("<f8").tobytes()])], names=["feature", "lane", "v", "w"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = {k: (np.zeros(0, np.float32), np.zeros(0)) for k in range(n)}
        waiting: dict[int, list] = {k: [] for k in range(n)}
        rows = 0

        def fold() -> None:
            for k in range(n):
                parts = [held[k], *waiting[k]]
                held[k] = shrunk(k, *summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
                waiting[k] = []

        for batch in batches:
            w = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(n):
                x = batch.column(k + 1).to_numpy(zero_copy_only=False).astype(np.float32)
                ok = ~np.isnan(x) & (w > 0)
                if np.isinf(x[ok]).any():
                    raise InvalidData("features must not be infinite")
                waiting[k].append((x[ok], w[ok]))
            rows += batch.num_rows
            if rows > 1 << 17:
                fold()
                rows = 0
        fold()
        yield from out(held, TaskContext.get().partitionId())

    def merged(lanes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            for batch in batches:
                for k, lane, v, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    held.setdefault((k, lane % lanes), []).append((lane, np.frombuffer(v.as_buffer(), "<f4"), np.frombuffer(w.as_buffer(), "<f8")))
            for (k, lane), parts in held.items():  # in order of partitions, whatever the order of arrival
                parts.sort(key=lambda x: x[0])
                yield from out({k: shrunk(k, *summed(np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])))}, lane)

        return run

    parts = source.mapInArrow(local, kinds)
    lanes = max(1, int(source.rdd.getNumPartitions() ** 0.5))
    if lanes > 4:
        parts = parts.repartition(min(lanes * n, 4096), "feature", F.pmod("lane", F.lit(lanes))).mapInArrow(merged(lanes), kinds)
    got = parts.repartition(min(n, spark.sparkContext.defaultParallelism), "feature").mapInArrow(merged(1), kinds).collect()
    found = {r["feature"]: (np.frombuffer(r["v"], "<f4"), np.frombuffer(r["w"], "<f8")) for r in got}
    return [found.get(k, (np.zeros(0, np.float32), np.zeros(0))) for k in range(n)]


def cuts_of(values: np.ndarray, weights: np.ndarray, max_bin: int) -> np.ndarray:
    """Cuts of one feature's distribution.

    Up to max_bin distinct values each is a cut (but the least); beyond, the cuts are the least
    values at which the running weight reaches 1, 2, ... parts of max_bin.
    """
    if not len(values):
        return np.zeros(0, dtype=np.float32)
    cut = values
    if len(values) > max_bin:
        run = np.cumsum(weights)
        cut = np.unique(values[np.minimum(np.searchsorted(run, run[-1] * np.arange(1, max_bin) / max_bin), len(values) - 1)])
    return _topped(cut[cut > values[0]], values)


def middle_cuts(values: np.ndarray) -> np.ndarray:
    """Cuts half way between all neighbouring values."""
    if not len(values):
        return np.zeros(0, dtype=np.float32)
    low, high = values[:-1].astype(np.float64), values[1:].astype(np.float64)
    middle = ((low + high) / 2).astype(np.float32)
    return _topped(np.where(middle > values[:-1], middle, values[1:]), values)


def _topped(cut: np.ndarray, values: np.ndarray) -> np.ndarray:
    top = values[-1]
    return np.append(cut.astype(np.float32), np.float32(top + abs(top) + np.float32(1e-5)))


def make_cuts(df: DataFrame, features: Sequence[str], *, max_bin: int = 256, categorical: Sequence[str] = (), weight: Column | None = None, exact: bool = False) -> Cuts:
    """Cuts of all features in one job.

    exact: cuts lie between all distinct values, of which a feature may have MOST_BINS.  Otherwise
    ``cuts_of`` the weighted distribution.  Categories are taken as they are.
    """
    cats = [k for k, f in enumerate(features) if f in categorical]
    seen = summaries(df, features, weight, size=max(SUMMARY, 8 * max_bin), whole=range(len(features)) if exact else cats)
    values = []
    for k, (v, w) in enumerate(seen):
        if k in cats:
            if len(v) and (v[0] < 0 or (v != np.floor(v)).any()):
                raise InvalidData(f"categories of {features[k]!r} must be non-negative whole numbers")
            values.append(v)
        else:
            values.append(middle_cuts(v) if exact else cuts_of(v, w, max_bin))
    return Cuts(list(features), values, [f in categorical for f in features])


def _mapped(df: DataFrame, cuts: Cuts, keep: Sequence[str], field: T.StructField, f) -> DataFrame:
    n = len(cuts.features)
    source = df.select(*keep, *(clean(c).alias(f"__f{k}") for k, c in enumerate(cuts.features)))
    schema = T.StructType([*(source.schema[c] for c in keep), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(np.float32) for k in range(n)]
            flat = cuts.codes(np.stack(x, axis=1) if n else np.zeros((batch.num_rows, 0), np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], f(flat)], names=schema.names)

    return source.mapInArrow(run, schema)


def binned(df: DataFrame, cuts: Cuts, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of df with ``bins``, an array of each feature's bin (null if missing)."""

    def lists(codes: np.ndarray) -> pa.Array:
        m, n = codes.shape
        flat = codes.ravel().astype(np.int32) - 1
        return pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * n), pa.array(flat, mask=flat < 0))

    return _mapped(df, cuts, keep, T.StructField("bins", T.ArrayType(T.IntegerType())), lists)


def packed(df: DataFrame, cuts: Cuts, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` of df with ``codes``: each row's packed codes as bytes."""
    return _mapped(df, cuts, keep, T.StructField("codes", T.BinaryType()), as_bytes)


def as_bytes(codes: np.ndarray) -> pa.Array:
    m, width = len(codes), codes.shape[1] * codes.itemsize
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(m + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(codes))])


def from_bytes(column: pa.Array, n: int, code: type) -> np.ndarray:
    """(rows, n) codes of a column of ``packed``, without a copy."""
    _, at, raw = column.buffers()
    first = np.frombuffer(at, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(raw, dtype=code, count=len(column) * n, offset=int(first)).reshape(len(column), n) if len(column) and n else np.zeros((len(column), n), code)


def unpacked(df: DataFrame, cuts: Cuts, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the array ``bins`` of rows that ``packed`` has made."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("bins", T.ArrayType(T.IntegerType()))])
    n, code = len(cuts.features), cuts.code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = from_bytes(batch.column(len(keep)), n, code).ravel().astype(np.int32) - 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(flat, mask=flat < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=schema.names)

    return df.select(*keep, "codes").mapInArrow(run, schema)
