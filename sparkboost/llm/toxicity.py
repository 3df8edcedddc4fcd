"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of the first four and five bytes of words, in lower
case.  P(grade > k) = logistic(w.x - threshold_k) with one weight vector for all ordered
thresholds; the expected severity is the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import U64, mix, slices, span_hash, words

#: Labelled rows that the model is fitted on at most, features that it keeps, grades above 0.
FIT_ROWS, FEATURES, GRADES = 8000, 2048, 3
#: A feature is considered if at least so many labelled documents have it, and if the likelihood
#: ratio of its table with the labels reaches EVIDENCE (by chance, one feature in 600 does).
SUPPORT, EVIDENCE = 5, 10.0

_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[0x80:] = False
for _c in (*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)):
    _OUTSIDE[_c] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the words and prefixes of each row, with repeats."""
    data = _LOWER[data]
    start, end, row = words(data, off, _OUTSIDE)
    yield row, span_hash(data, start, end)
    for size, salt in ((4, U64(0x51ED270B)), (5, U64(0x2545F491))):
        long = np.flatnonzero(end - start > size)
        yield row[long], mix(span_hash(data, start[long], start[long] + size) + salt)


@dataclass
class Model:
    """keys: sorted feature hashes; weights by key; ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    reject_at: float = 0.5
    table: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def present(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature number) of the model's features in each row, once each."""
        found = []
        for row, h in features(data, off):
            may = np.flatnonzero(self.table[(h & U64(0xFFFF)).astype(np.int64)])
            row, h = row[may], h[may]
            k = np.searchsorted(self.keys, h)
            hit = np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] == h) if len(self.keys) else np.zeros(0, np.int64)
            found.append(row[hit] * FEATURES * 4 + k[hit])
        both = np.unique(np.concatenate(found))
        return both // (FEATURES * 4), both % (FEATURES * 4)

    def judge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the probabilities of ``above``, and whether it is toxic."""
        row, feature = self.present(data, off)
        n = len(off) - 1
        above = self.above(np.bincount(row, weights=self.weights[feature], minlength=n))
        return above, (np.bincount(row, minlength=n) > 0) & (above[:, 0] >= self.reject_at)

    def rejects(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.judge(data, off)[1]

    def above(self, score: np.ndarray) -> np.ndarray:
        """(n, grades) probabilities that the grade exceeds 0, 1, ..."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -500, 500)))


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int = GRADES, rounds: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the cumulative-link likelihood."""
    n = len(grade)
    share = np.clip([(grade > k).mean() for k in range(n_grades)], 1e-3, 1 - 1e-3)
    top = -np.log(share / (1 - share))
    # the first threshold, then logarithms of the gaps, so that thresholds stay in order
    x = np.concatenate([np.zeros(n_features), top[:1], np.log(np.maximum(np.diff(top), 0.1))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        w, gaps = x[:n_features], np.exp(x[n_features + 1 :])
        t = x[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, weights=w[feature], minlength=n)
        up = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(score[:, None] - t, -500, 500))), np.zeros((n, 1))], axis=1)
        hi, lo = up[np.arange(n), grade], up[np.arange(n), grade + 1]
        p = np.maximum(hi - lo, 1e-12)
        # derivative of -log p in the score, and in each threshold
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = -(d_hi - d_lo) / n
        dt = np.zeros(n_grades)
        np.add.at(dt, grade[grade > 0] - 1, d_hi[grade > 0] / n)
        np.add.at(dt, grade[grade < n_grades], -d_lo[grade < n_grades] / n)
        g = np.concatenate([np.bincount(feature, weights=ds[row], minlength=n_features) + ridge * w, [dt.sum()], gaps * np.cumsum(dt[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features] + np.concatenate([[0], np.cumsum(np.exp(x[n_features + 1 :]))])


def _tally(n_classes: int):
    """Documents with each feature, by class (column 2), for one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = np.zeros(0, U64), np.zeros((n_classes, 0), np.int64)
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, off in slices(batch.column(1)):
                for row, h in features(data, off):
                    order = np.lexsort((row, h))
                    row, h = row[order], h[order]
                    once = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
                    own = label[i:j][row[once]]
                    keys, inverse = np.unique(np.concatenate([keys, h[once]]), return_inverse=True)
                    seen = np.stack([np.bincount(inverse, weights=np.concatenate([seen[k], own == k]), minlength=len(keys)) for k in range(n_classes)]).astype(np.int64)
        for i in range(0, len(keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), *(pa.array(x[part].copy()) for x in seen)], names=["feature", *(f"c{k}" for k in range(n_classes))])

    return run


def selected(rows: DataFrame, n_features: int, n_classes: int = 2) -> tuple[Model, np.ndarray]:
    """A model without weights of the features that tell the classes of rows (doc_id, text, class) apart best.

    Features are ranked by the likelihood ratio of their table with the classes 0, 1, ....  Also
    given: which of them mark the last class.
    """
    total = {r[0]: r["count"] for r in rows.groupBy(rows.columns[2]).count().collect()}
    n = [total.get(k, 0) for k in range(n_classes)]
    if sum(x > 0 for x in n) < 2:
        return Model(np.zeros(0, U64), np.zeros(0), np.zeros(GRADES)), np.zeros(0, dtype=bool)
    counts = [f"c{k}" for k in range(n_classes)]
    seen = sum((F.col(c) for c in counts[1:]), F.col("c0"))
    stats = rows.mapInArrow(_tally(n_classes), "feature long, " + ", ".join(f"{c} long" for c in counts)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in counts)).where(seen >= SUPPORT)
    last = F.col(counts[-1])
    odds = F.log((last + 0.5) / (n[-1] + 1.0)) - F.log((seen - last + 0.5) / (sum(n[:-1]) + 1.0))
    term = lambda got, expected: F.when(got > 0, 2 * got * F.log(got / expected)).otherwise(0.0)
    share = seen / float(sum(n))
    ratio = sum((term(F.col(c), share * x) + term(x - F.col(c), (1 - share) * x) for c, x in zip(counts, n, strict=True) if x), F.lit(0.0))
    best = stats.where(seen < sum(n)).withColumn("odds", odds).withColumn("ratio", ratio).where(F.col("ratio") >= EVIDENCE).orderBy(F.desc("ratio"), "feature").limit(n_features).collect()
    keys = np.array([r["feature"] for r in best], dtype=np.int64).view(U64)
    order = np.argsort(keys)
    return Model(keys[order], np.zeros(len(keys)), np.zeros(GRADES)), np.array([r["odds"] for r in best], dtype=float)[order] > 2.0


def trained(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, n_features: int = FEATURES, n_grades: int = GRADES) -> Model:
    """Fits a model on labelled documents: at most ``fit_rows`` of them, those first in a hash order of doc_id.

    The labels' ``toxic`` is a grade of severity from 0 on, of repeated ids the highest; grades
    above n_grades count as n_grades.  If the labels say toxic or not only, the grades of the
    toxic documents are the quantile thirds of how many different features of the toxic class
    they have.  Only the sample's selected
    features come to the driver (fit_rows x n_features at most).  Without labels of both kinds
    the model finds nothing toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.greatest(F.least("toxic", F.lit(n_grades)), F.lit(0)).cast("long").alias("grade")), "toxicity-sample")
    draft, marks = selected(rows.select("doc_id", "text", (F.col("grade") > 0).cast("long").alias("toxic")), n_features)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                row, feature = draft.present(data, off)
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32)))], names=["doc_id", "grade", "features"])

    got = sorted(rows.mapInArrow(own, "doc_id long, grade long, features array<int>").collect(), key=lambda r: (r["doc_id"], r["features"]))
    sizes = np.array([len(r["features"]) for r in got], dtype=np.int64)
    feature = np.array([f for r in got for f in r["features"]], dtype=np.int64)
    row = np.repeat(np.arange(len(got)), sizes)
    grade = np.array([r["grade"] for r in got], dtype=np.int64)
    if not grade.any() or grade.all():
        return Model(np.zeros(0, U64), np.zeros(0), np.full(n_grades, np.inf))
    if grade.max() == 1:
        mass = np.bincount(row, weights=marks[feature], minlength=len(got))
        cuts = np.quantile(mass[grade > 0], np.arange(1, n_grades) / n_grades)
        grade = np.where(grade > 0, 1 + np.searchsorted(cuts, mass, side="left"), 0)
    weights, thresholds = fit(row, feature, grade, len(draft.keys), n_grades)
    return Model(draft.keys, weights, thresholds)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected severity, most likely grade and ``toxic`` (P(grade > 0) at least reject_at) of each row.

    Cases: null and empty texts have no features and so the score of a featureless text, never
    toxic; very long texts are scored whole, a text at a time; of equally likely grades the lowest
    is given; repeated rows score alike; a null doc_id is passed on; an empty table gives no rows;
    other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                above, toxic = model.judge(data, off)
                edge = np.concatenate([np.ones((j - i, 1)), above, np.zeros((j - i, 1))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(above.sum(axis=1)), pa.array((edge[:, :-1] - edge[:, 1:]).argmax(axis=1)), pa.array(toxic)],
                    names=["doc_id", "severity", "grade", "toxic"],
                )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, severity double, grade long, toxic boolean")
