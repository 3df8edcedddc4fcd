"""Mixing documents to target weights of domains by soft membership.

A classifier fitted on a labelled table predicts each document's posterior over domains.  A
document of n tokens and posterior p adds n * p to the domains' token totals; nonnegative
rates of the documents are fitted so that the expected totals meet targets, by projected
gradient descent on the squared error.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity
from .quality import COLUMNS, counts
from .store import small_batches, written
from .text import U64, mix, slices, span_hash

#: Labelled rows that the classifier is fitted on at most, and its text features.
FIT_ROWS, FEATURES = 6000, 512
#: Domains by the columns of the labelled table, and their target shares of all tokens.  A target of 0 would be
#: paid for by all documents with a trace of the domain, for a posterior is hardly ever exactly 0.
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.955, "low": 0.04, "toxic": 0.005}
#: Domains whose target is a ceiling, and how many times its tokens any other may be given at most.
CEILINGS, REPEATS = ("toxic",), 4.0
#: Sums over all documents at most, and how far from its target a domain may end (of its target, or of its tokens if that is 0).
STEPS, TOLERANCE = 200, 1e-3
#: Weight of the rates' distance from 1 against the squared errors: lowered tenfold until the targets are met.
HOLD, LEAST_HOLD = 1e-3, 1e-10


def domain_of(quality: F.Column, toxic: F.Column) -> F.Column:
    """Number of a labelled document's domain."""
    return F.when(toxic > 0, 2).when(quality > 0, 0).otherwise(1).cast("long")


def ratios(c: np.ndarray) -> np.ndarray:
    """Dense features of the counts of ``quality.counts``, each within about -1 to 1."""
    col = {name: c[:, k].astype(float) for k, name in enumerate(COLUMNS)}
    words, chars, letters = (np.maximum(col[x], 1) for x in ("n_words", "word_chars", "n_letters"))
    out = [
        np.minimum(10 * col["n_symbols"] / chars, 1),
        np.minimum(col["n_dup_lines"] / np.maximum(col["n_lines"], 1), 1),
        np.minimum(col["n_repeat_words"] / words, 1),
        np.clip(chars / words / 10, 0, 2),
        np.minimum(2 * col["n_upper"] / letters, 1),
        np.minimum(4 * col["n_digits"] / chars, 1),
        np.minimum(10 * col["n_stops"] / words, 1),
        col["n_distinct_words"] / words,
        (col["n_words"] < 50).astype(float),
        np.ones(len(c)),
    ]
    return np.stack(out, axis=1)


@dataclass
class Classifier:
    """Multinomial logistic regression on sparse text features and dense ratios."""

    words: toxicity.Model
    sparse: np.ndarray  # (features, domains)
    dense: np.ndarray  # (ratios, domains)
    known: np.ndarray  # whether the labelled rows have the domain; the posterior of any other is 0

    def posteriors(self, data: np.ndarray, off: np.ndarray, c: np.ndarray) -> np.ndarray:
        row, feature = self.words.present(data, off)
        score = ratios(c) @ self.dense
        for k in range(score.shape[1]):
            score[:, k] += np.bincount(row, weights=self.sparse[feature, k], minlength=len(c))
        score = np.where(self.known, score, -np.inf)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def fit(row: np.ndarray, feature: np.ndarray, dense: np.ndarray, domain: np.ndarray, n_features: int, n_domains: int, rounds: int = 1000, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    n = len(domain)
    y = np.eye(n_domains)[domain]
    x = np.zeros((n_features + dense.shape[1], n_domains))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        score = dense @ x[n_features:]
        for k in range(n_domains):
            score[:, k] += np.bincount(row, weights=x[feature, k], minlength=n)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - y) / n
        g = np.concatenate([np.stack([np.bincount(feature, weights=d[row, k], minlength=n_features) for k in range(n_domains)], axis=1), dense.T @ d]) + ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:n_features], x[n_features:]


def trained(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, n_features: int = FEATURES) -> Classifier:
    """Fits the classifier on at most ``fit_rows`` labelled documents, first in a hash order of doc_id.

    The text features are those that tell any of the domains apart best.  A domain that no
    labelled document has gets the posterior 0; without labels every posterior is the same for
    all domains.
    """
    small_batches(docs.sparkSession)
    rows = labels.where("doc_id is not null and toxic is not null and quality is not null")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(domain_of(F.lit(1), F.col("toxic"))).alias("t"), F.min(F.col("quality").cast("long")).alias("q"))
    rows = rows.select("doc_id", domain_of(F.col("q"), F.when(F.col("t") == 2, 1).otherwise(0)).alias("domain"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    own = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(own.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "domain"), "mixing-sample")
    words = toxicity.selected(own, n_features, len(DOMAINS))[0]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                row, feature = words.present(data, off)
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                dense = ratios(counts(data, off))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * dense.shape[1]), pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32))), lists], names=["doc_id", "domain", "features", "dense"])

    got = sorted(own.mapInArrow(facts, "doc_id long, domain long, features array<int>, dense array<double>").collect(), key=lambda r: (r["doc_id"], r["features"]))
    n_dense = len(ratios(np.zeros((1, len(COLUMNS))))[0])
    if not got:
        return Classifier(words, np.zeros((len(words.keys), len(DOMAINS))), np.zeros((n_dense, len(DOMAINS))), np.ones(len(DOMAINS), dtype=bool))
    feature = np.array([f for r in got for f in r["features"]], dtype=np.int64)
    row = np.repeat(np.arange(len(got)), np.array([len(r["features"]) for r in got], dtype=np.int64))
    domain = np.array([r["domain"] for r in got])
    sparse, dense = fit(row, feature, np.array([r["dense"] for r in got]), domain, len(words.keys), len(DOMAINS))
    return Classifier(words, sparse, dense, np.bincount(domain, minlength=len(DOMAINS)) > 0)


def members(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens (words of the whole text) and posteriors of each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                c = counts(data, off)
                p = model.posteriors(data, off, c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(c[:, 0].copy()), *(pa.array(p[:, k].copy()) for k in range(p.shape[1]))], names=["doc_id", "tokens", *(f"p_{d}" for d in DOMAINS)])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


@dataclass
class Rates:
    """Rates as a function of the posterior: 1 moved by the sum of all steps, projected."""

    moved: np.ndarray

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(1 - p @ self.moved, 0.0)


def solved(rows: DataFrame, targets: dict[str, float], *, steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """Projected gradient descent from rates of 1, over all documents, until every domain meets its own target.

    The domain with the largest target keeps the tokens that it has, and the others' totals
    follow in proportion: a domain with too many tokens gets rates below 1, one with too few gets
    rates above 1, but no more than REPEATS times its tokens, and of the domains in CEILINGS no more
    than it has.  A domain without any tokens takes no part: the other targets are scaled up.  A step
    is the residual times the inverse gram matrix of the documents whose rate isn't 0; steps
    are summed before they are projected, so a document's rate depends on its posterior and
    that sum alone, and the rates that meet the targets are those that differ least from 1.
    Nothing is kept between steps and each step is one sum over all documents.  Warns with the
    shortfall of each domain if no rates meet the targets or ``steps`` sums don't suffice.
    """
    names = [f"p_{d}" for d in DOMAINS]
    n = len(names)

    def total(rates: Rates):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, gram, squares = np.zeros(n), np.zeros((n, n)), 0.0
            for batch in batches:
                tokens = batch.column(0).to_numpy().astype(float)
                p = np.stack([batch.column(k + 1).to_numpy() for k in range(n)], axis=1) if batch.num_rows else np.zeros((0, n))
                x = rates.of(p)
                have += (tokens * x) @ p
                gram += p.T @ (p * (tokens * (x > 0))[:, None])
                squares += float(tokens @ (x * x))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(have), pa.array(np.full(n, squares)), *(pa.array(gram[:, k].copy()) for k in range(n))], names=["i", "have", "squares", *(f"g{k}" for k in range(n))])

        sums = ["have", "squares", *(f"g{k}" for k in range(n))]
        kinds = "i long, " + ", ".join(f"{c} double" for c in sums)
        got = rows.select("tokens", *names).mapInArrow(run, kinds).groupBy("i").agg(*(F.sum(c).alias(c) for c in sums)).collect()
        have, gram, squares = np.zeros(n), np.zeros((n, n)), 0.0
        for r in got:
            have[r["i"]] = r["have"]
            gram[r["i"]] = [r[f"g{k}"] for k in range(n)]
            squares = r["squares"]
        return have, gram, squares

    share = np.array([targets.get(d, 0.0) for d in DOMAINS])
    return descended(total, share / share.sum(), steps, tolerance)


def descended(total, share: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """total: (tokens by domain, gram matrix of documents above 0, sum of tokens * rate^2) of rates."""
    n = len(share)
    moved, taken = np.zeros(n), 1
    have, gram, squares = total(Rates(moved))
    if not gram.any():
        return Rates(moved)
    share = np.where(have > 0, share, 0.0)
    if not share.any():
        return Rates(moved)
    main = int(np.argmax(share))
    most = np.array([1.0 if d in CEILINGS else REPEATS for d in DOMAINS])
    most[main] = 1.0
    wanted = np.minimum(share * (have[main] / share[main]), most * have)
    scale = np.maximum(np.where(wanted > 0, wanted, have), 1e-12 * have.sum())
    hold, all_tokens = HOLD, have.sum()

    def value() -> float:
        """What the steps increase: concave in moved."""
        return -0.5 * squares - moved @ wanted - 0.5 * hold * all_tokens * (moved @ moved)

    while True:
        slope = have - wanted - hold * all_tokens * moved
        if (np.abs(slope) <= 0.1 * tolerance * scale).all():
            if (np.abs(have - wanted) <= tolerance * scale).all():
                return Rates(moved)
            if hold <= LEAST_HOLD:
                break
            hold /= 10
            continue
        step = np.linalg.solve(gram + hold * all_tokens * np.eye(n), slope)
        start, before, part = moved, value(), 1.0
        while taken < steps:
            moved = start + part * step
            have, gram, squares = total(Rates(moved))
            taken += 1
            if value() >= before + 1e-4 * part * (slope @ step) - 1e-12 * abs(before):
                break
            part /= 2
        if taken >= steps:
            break
    if (np.abs(have - wanted) > tolerance * scale).any():
        warnings.warn("mixing targets aren't met: " + ", ".join(f"{d} has {h:.6g} tokens, wanted {w:.6g}" for d, h, w in zip(DOMAINS, have, wanted, strict=True)), RuntimeWarning, stacklevel=3)
    return Rates(moved)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, posteriors and rate of every document.

    Cases: null and empty texts have no tokens, and a posterior and a rate like any other; very
    long texts are read whole, a text at a time; repeated rows are alike; a null doc_id is passed
    on; an empty table gives no rows; a domain that no label has, or no document, takes no part;
    other columns, whatever their names, are ignored.
    """
    rows = written(members(docs, trained(docs, labels)), "mixing-members")
    return rated(rows, solved(rows, targets))


def rated(rows: DataFrame, rates: Rates) -> DataFrame:
    names = [f"p_{d}" for d in DOMAINS]

    @F.pandas_udf("double")
    def rate(*p):
        import pandas as pd

        return pd.Series(rates.of(np.stack([x.to_numpy() for x in p], axis=1)))

    return rows.withColumn("rate", rate(*names))


def drawn(rate: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How often each document is taken: its rate rounded up or down by a uniform number."""
    whole = np.floor(rate)
    return (whole + (u < rate - whole)).astype(np.int64)


def sampled(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, all columns, that are drawn with their rates.

    A document's rate is rounded up if a uniform number that its doc_id and text decide is below
    its fraction; one of rate 1.3 comes once or twice.  No document is shuffled.

    Cases: as in ``mixed``; repeated rows share a number, so that all or none of them come.
    """
    model = trained(docs, labels)
    rows = written(members(docs, model), "mixing-members")
    rates = solved(rows, targets)
    place = docs.columns.index("text")
    id_at = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(place)):
                x = rates.of(model.posteriors(data, off, counts(data, off)))
                ids = batch.column(id_at).slice(i, j - i).cast(pa.int64()).fill_null(0).to_numpy().view(U64)
                u = mix(mix(ids) + span_hash(data, off[:-1], off[1:])) >> U64(11)
                yield batch.slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), drawn(x, u.astype(float) * 2.0**-53))))

    return docs.mapInArrow(run, docs.schema)
