"""URL verdicts by longest rule, and by a Bloom filter cascade where no rule fits.

The first filter of a cascade holds the listed keys, the second the unlisted keys that the
first takes for listed, the third the listed keys that the second holds by mistake, and so on
until a filter makes no mistake.  Over the universe of keys that it was built on, a cascade
answers without error and without a join.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import U64, mix

#: Bits of a first filter that are sent to executors; a larger list is worked off in segments of its keys.
SEGMENT_BITS = 1 << 28
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, below a path."""

    text: str
    verdict: str
    host: str = field(init=False)
    path: str = field(init=False)

    def __post_init__(self) -> None:
        host, slash, path = self.text.partition("/")
        object.__setattr__(self, "host", host)
        object.__setattr__(self, "path", slash + path)

    def fits(self, host: F.Column, path: F.Column) -> F.Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every page; JVM expressions only."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def longest_rule(rules: list[Rule], host: F.Column, path: F.Column) -> tuple[F.Column, F.Column]:
    """(text, verdict) of the longest rule that fits, else nulls; of equally long ones the first by text."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = r.fits(host, path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _pairs(columns) -> np.ndarray:
    """(n, 2) unsigned words of two columns of hashes."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for c in columns], axis=1)


@dataclass
class Bloom:
    bits: int
    hashes: int
    salt: int
    words: np.ndarray | None = None

    @classmethod
    def sized(cls, n: int, wrong: float, salt: int) -> Bloom:
        """For n keys, with the share ``wrong`` of other keys taken for members."""
        bits = max(64, math.ceil(n * -math.log(wrong) / math.log(2) ** 2))
        return cls(-(-bits // 64) * 64, max(1, round(bits / max(n, 1) * math.log(2))), salt)

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """Bits of keys, given as rows of two hashes."""
        salt = U64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        step, second = mix(h[:, 0] ^ salt), mix(h[:, 1] ^ salt) | U64(1)
        for _ in range(self.hashes):
            yield step % U64(self.bits)
            step = step + second

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for place in self.places(h):
            out &= (self.words[(place >> U64(6)).astype(np.int64)] >> (place & U64(63)) & U64(1)).astype(bool)
        return out

    def filled(self, keys: DataFrame) -> Bloom:
        """Sets the bits of the keys (columns h, h2); set words are merged by executors before they come here."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.unique(np.concatenate(list(self.places(_pairs(batch.columns[:2])))))
                word = (place >> U64(6)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
                mask = np.bitwise_or.reduceat(U64(1) << (place & U64(63)), first) if len(word) else np.zeros(0, U64)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(mask.view(np.int64))], names=["word", "mask"])

        got = keys.select("h", "h2").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
        self.words = np.zeros(self.bits // 64, dtype=U64)
        self.words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(U64)
        return self


@dataclass
class Cascade:
    levels: list[Bloom]

    def lists(self, h: np.ndarray) -> np.ndarray:
        """Whether each key (a row of two hashes) is listed; exact for keys of the universe."""
        out = np.zeros(len(h), dtype=bool)
        left = np.arange(len(h))
        for level, bloom in enumerate(self.levels):
            left = left[bloom.holds(h[left])]
            out[left] = level % 2 == 0
        return out

    def reached(self, keys: DataFrame) -> DataFrame:
        """Those keys that all levels hold."""
        levels = self.levels

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = _pairs(batch.columns[:2])
                ok = np.ones(len(h), dtype=bool)
                for bloom in levels:
                    ok &= bloom.holds(h)
                yield batch.filter(pa.array(ok))

        return keys.select("h", "h2").mapInArrow(run, "h long, h2 long")

    @classmethod
    def built(cls, listed: DataFrame, others: DataFrame) -> Cascade:
        """listed and others: the whole universe of distinct keys (columns h, h2)."""
        n, m = listed.count(), others.count()
        cascade = cls([])
        if not n:
            return cascade
        inside, outside = listed, others
        wrong = min(0.5, max(1e-6, n / (math.sqrt(2) * max(m, 1))))
        while n:
            if len(cascade.levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end: the lists share a key")
            cascade.levels.append(Bloom.sized(n, wrong, len(cascade.levels) + 1).filled(inside))
            inside, outside = cascade.reached(others if len(cascade.levels) % 2 else listed), inside
            n, wrong = inside.count(), 0.5
        return cascade


def listed_flags(rows: DataFrame, key: str, listed: DataFrame, *, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """rows with ``listed``: whether their key is among ``listed`` (column key).

    The universe is all distinct keys of rows and of the list.  Keys are told apart by 128 bits
    of two hashes, which no two of 10^12 keys share but with a probability of about 10^-15.
    """
    spark = rows.sparkSession
    small_batches(spark)
    hashes = [F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.lit("2nd"), F.col(key), F.length(key)).alias("h2")]
    on_list = listed.where(F.col(key).isNotNull()).select(*hashes, F.lit(1).alias("on"))
    keys = rows.where(F.col(key).isNotNull()).select(*hashes, F.lit(0).alias("on")).unionByName(on_list).groupBy("h", "h2").agg(F.max("on").alias("on"))
    keys = written(keys, "url-keys")
    n = keys.where("on = 1").count()
    segments = max(1, -(-Bloom.sized(n, 1e-6, 0).bits // segment_bits))
    out = None
    rows = rows.withColumns({"__h": hashes[0], "__h2": hashes[1]})
    for s in range(segments):
        own = F.pmod(F.xxhash64("h"), F.lit(segments)) == s
        cascade = Cascade.built(keys.where(own & (F.col("on") == 1)), keys.where(own & (F.col("on") == 0)))
        here = rows if segments == 1 else rows.where(F.pmod(F.xxhash64("__h"), F.lit(segments)) == s)
        shared = spark.sparkContext.broadcast(cascade)

        @F.pandas_udf("boolean")
        def lists(h, h2, shared=shared):
            import pandas as pd

            return pd.Series(shared.value.lists(np.stack([x.to_numpy().view(np.uint64) for x in (h, h2)], axis=1)))

        part = here.withColumn("listed", lists("__h", "__h2") & F.col(key).isNotNull()).drop("__h", "__h2")
        out = part if out is None else out.unionByName(part)
    return out


def verdicts(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and ``listed``.

    listed: keys (column key: host followed by path) that are blocked where no rule fits.

    Cases: a null url or one without ``://`` has an empty host and path, which no rule fits; it
    is allowed unless the empty key is listed.  Of rules of equal length the first by text wins.
    Very long urls are judged whole; repeated rows are judged alike; a null page_id is passed on;
    an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    rows = parsed(pages).withColumn("key", F.concat("host", "path"))
    rows = listed_flags(rows, "key", listed)
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
