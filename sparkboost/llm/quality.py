"""Quality verdicts by weak supervision.

Rules vote good, vote bad or abstain.  A two-class mixture over the vote patterns is fitted
by expectation-maximisation: it estimates, for every rule and class, how often the rule gives
each vote, and so how far its votes can be trusted.  The posterior probability of the good
class then decides, in place of a demand that all rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import U64, mix, row_sums, slices, span_hash, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that rules look at.
MORE = ("n_lines", "n_upper", "n_letters", "n_digits", "n_stops", "n_distinct_words", "n_letter_words")
COLUMNS = BASE + MORE

#: Share of all weight that stays with the start of the fit.
BELIEF = 0.02


@dataclass(frozen=True)
class Rule:
    """Votes bad outside [bad_low, bad_high] and good inside [good_low, good_high] of a ratio; else it abstains."""

    name: str
    above: str
    below: str
    good_low: float
    good_high: float
    bad_low: float
    bad_high: float
    least: int = 1  # abstains if the denominator is smaller

    def vote(self) -> F.Column:
        ratio = F.col(self.above) / F.when(F.col(self.below) >= self.least, F.col(self.below))
        return (
            F.when(ratio.isNull(), 0)
            .when((ratio < self.bad_low) | (ratio > self.bad_high), 2)
            .when((ratio >= self.good_low) & (ratio <= self.good_high), 1)
            .otherwise(0)
        )


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 0.0, 0.01, 0.0, 0.05),
    Rule("symbols_by_word", "n_symbols", "n_words", 0.0, 0.02, 0.0, 0.1),
    Rule("letter_words", "n_letter_words", "n_words", 0.9, 1.0, 0.8, 1.0),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.1, 0.0, 0.3, 4),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.15, 0.0, 0.35),
    Rule("word_length", "word_chars", "n_words", 3.0, 9.0, 2.2, 13.0),
    Rule("capitals", "n_upper", "n_letters", 0.0, 0.15, 0.0, 0.4),
    Rule("digits", "n_digits", "word_chars", 0.0, 0.08, 0.0, 0.25),
    Rule("sentences", "n_stops", "n_words", 0.02, 0.2, 0.002, 0.5, 40),
    Rule("variety", "n_distinct_words", "n_words", 0.25, 1.0, 0.08, 1.0, 20),
)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, len(COLUMNS)) of whole texts."""
    n = len(off) - 1
    out = np.zeros((n, len(COLUMNS)), np.int64)
    start, end, row = words(data, off)
    put = lambda name, x: out.__setitem__((slice(None), COLUMNS.index(name)), x)
    per = lambda of: np.bincount(of, minlength=n)
    kind = np.zeros(256, np.uint8)
    kind[[ord(c) for c in SYMBOLS]] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("a") : ord("z") + 1] = 3
    kind[ord("0") : ord("9") + 1] = 4
    kind[0x80:0xC0] = 5
    kinds = kind[data]
    upper, later = row_sums(kinds == 2, off), row_sums(kinds == 5, off)
    put("word_chars", np.bincount(row, weights=end - start, minlength=n).astype(np.int64) - later)
    put("n_words", per(row))
    put("n_symbols", row_sums(kinds == 1, off))
    put("n_upper", upper)
    put("n_letters", upper + row_sums(kinds == 3, off))
    put("n_digits", row_sums(kinds == 4, off))
    if not len(start):
        return out
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((kinds == 2) | (kinds == 3) | (data >= 0xC3), out=letters[1:])
    put("n_letter_words", per(row[letters[end] > letters[start]]))
    stop = np.zeros(256, bool)
    stop[[ord(c) for c in ".?!"]] = True
    put("n_stops", per(row[stop[data[end - 1]]]))
    # lines with a word, by the first word of each
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, start)
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])]))
    of, line = row[first], line[first]
    edge = np.concatenate([[-1], breaks, [len(data)]])
    h = span_hash(data, np.maximum(off[of], edge[line] + 1), np.minimum(off[of + 1], edge[line + 1]))
    put("n_lines", per(of))
    put("n_dup_lines", per(of) - per(_firsts(of, h)))
    w = span_hash(data, start, end)
    put("n_distinct_words", per(_firsts(row, w)))
    if len(w) > 2:
        at = np.flatnonzero(row[:-2] == row[2:])
        key = mix(mix(mix(w[at]) + w[at + 1]) + w[at + 2] + row[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        covered = np.zeros(len(w) + 2, bool)
        for k in range(3):
            covered[at[again] + k] = True
        put("n_repeat_words", per(row[covered[: len(w)]]))
    return out


def _firsts(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rows of distinct (row, key), one entry for each."""
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    key, row = key[order], row[order]
    return row[np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in slices(batch.column(1)):
            c = counts(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in c.T.copy())], names=["doc_id", *COLUMNS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; a null text counts as empty."""
    small_batches(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[float, np.ndarray]:
    """Prior of the good class and (rule, class, vote) probabilities by expectation-maximisation.

    patterns: (n, rules) votes 0 abstain, 1 good, 2 bad; class 1 is good.  The start says only
    that good votes are commoner in good texts and bad votes in bad ones; BELIEF of all
    documents' weight stays with that start, so that the classes can't trade places or
    split along something else than quality.
    """
    m = patterns.shape[1]
    prior, p = 0.8, np.empty((m, 2, 3))
    p[:, 0] = (0.2, 0.5, 0.3)
    p[:, 1] = (0.1, 0.89, 0.01)
    total = weight.sum()
    start = p * np.array([1 - prior, prior])[None, :, None] * BELIEF * total
    for _ in range(rounds if total else 0):
        good = posterior(patterns, prior, p)
        q = np.stack([(1 - good) * weight, good * weight])
        new = np.empty_like(p)
        for v in range(3):
            new[:, :, v] = ((patterns == v).T.astype(float) @ q.T) + start[:, :, v]
        new /= new.sum(axis=2, keepdims=True)
        now = float(np.clip((q[1].sum() + 1) / (total + 2), 1e-4, 1 - 1e-4))
        moved = max(abs(now - prior), float(np.abs(new - p).max()))
        prior, p = now, new
        if moved < tolerance:
            break
    return prior, p


def posterior(patterns: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    log = np.log(p)
    rules = np.arange(patterns.shape[1])
    bad, good = (np.log(x) + log[rules, c, patterns].sum(axis=1) for c, x in ((0, 1 - prior), (1, prior)))
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, the posterior ``p_good`` and ``kept`` of each document.

    The only thing that comes to the driver is the number of documents of each vote pattern, of
    which there are at most 3 ** len(rules), whatever the corpus.  base_failed: fewer than 50
    words, or over half of them in repeated three-word windows; such documents are never kept
    and take no part in the fit.

    Cases: null and empty texts have no words, so base_failed; very long texts are counted whole,
    a text at a time; a posterior equal to ``threshold`` keeps; repeated rows are judged alike, each
    giving a row; a null doc_id is passed on; an empty table gives no rows; other columns, whatever
    their names, are ignored.
    """
    facts = written(measured(docs).withColumn("pattern", sum(r.vote() * 3**k for k, r in enumerate(rules)).cast("long")), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    tally = facts.where(~failed).groupBy("pattern").count().orderBy("pattern").collect()
    spark = docs.sparkSession
    votes = np.array([[r["pattern"] // 3**k % 3 for k in range(len(rules))] for r in tally], dtype=np.int64).reshape(-1, len(rules))
    prior, p = fit(votes, np.array([r["count"] for r in tally], dtype=float))
    good = posterior(votes, prior, p)
    known = spark.createDataFrame([(r["pattern"], float(g)) for r, g in zip(tally, good, strict=True)], "pattern long, p_good double")
    out = facts.join(F.broadcast(known), "pattern", "left").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= threshold)
    return out.select("doc_id", *BASE, "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.col("p_good")).alias("p_good"), F.col("pattern").alias("votes"))
