"""Rows given as arrays of indices and values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import InvalidData


def dense(df: DataFrame, indices: str, values: str, n_features: int, keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and f0, f1, ...: an absent entry is missing, an explicit zero is present.

    Indices of a row are distinct and lie in 0..n_features - 1, else an error is raised; a null
    array has no entries.
    """
    keep = list(keep)
    source = df.select(*keep, indices, values)
    names = [*keep, *(f"f{k}" for k in range(n_features))]
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(f"f{k}", T.FloatType()) for k in range(n_features))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(len(keep) + j) for j in range(2)]
            size = [np.diff(x.offsets.to_numpy()) if len(x) else np.zeros(0, np.int64) for x in lists]
            if (size[0] != size[1]).any():
                raise InvalidData("a row has another number of indices than of values")
            row = np.repeat(np.arange(batch.num_rows), size[0])
            at = lists[0].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(at) and (at.min() < 0 or at.max() >= n_features):
                raise InvalidData("an index is out of range")
            cell = row * n_features + at
            if len(np.unique(cell)) < len(cell):
                raise InvalidData("a row repeats an index")
            out = np.full(batch.num_rows * n_features, np.nan, dtype=np.float32)
            out[cell] = lists[1].flatten().to_numpy(zero_copy_only=False)
            out = out.reshape(batch.num_rows, n_features)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c.copy(), mask=np.isnan(c)) for c in out.T)], names=names)

    return source.mapInArrow(run, schema)
