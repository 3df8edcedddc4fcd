"""Token counts by source, language and tokenizer version, maintained from signed changes.

A batch holds documents that were inserted (sign 1), deleted (-1) or counted anew (the old
count with -1, the new with 1).  Batches are folded into additive totals; a batch id is
applied once, however often it is committed.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import slices
from .token_files import encoder

KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens", "chars")
TOTALS = "source string, lang string, version string, docs long, tokens long, chars long"


@dataclass(frozen=True)
class Vocabulary:
    """Counts ids by a public vocabulary file: a byte-level one of the tokenizers library, or ranks of tiktoken."""

    path: str

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Ids of each row of a slice; special tokens are neither added nor looked for in ranks."""
        if not self.path.endswith(".tiktoken"):
            return encoder(self.path).encode(data, off)[1]
        raw, code = data.tobytes(), _ranks(self.path)
        return np.array([len(code.encode_ordinary(raw[a:b].decode(errors="replace"))) for a, b in itertools.pairwise(off.tolist())], dtype=np.int64)


_loaded: dict[str, object] = {}


def _ranks(path: str):
    """tiktoken's encoding of a file of ranks, made once in each worker."""
    if path not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def counted(docs: DataFrame, vocabularies: dict[str, Vocabulary]) -> DataFrame:
    """doc_id, source, lang, hash of the text, chars, and the number of ids by each tokenizer version.

    Every text is read once and encoded once by each vocabulary, a bounded slice at a time.
    """
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.md5(text.cast("binary")).alias("hash"), F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long")).alias("chars"), text.alias("text"))
    names = [*thin.columns[:-1], *vocabularies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(5)):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(5)), *(pa.array(v.count(data, off)) for v in vocabularies.values())], names=names)

    return thin.mapInArrow(run, "doc_id long, source string, lang string, hash string, chars long, " + ", ".join(f"`{v}` long" for v in vocabularies))


def changes(counts: DataFrame, version: str, column: str, sign: int) -> DataFrame:
    """A signed change for each row of ``counted``: the ids in ``column`` under a tokenizer version."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.col(f"`{column}`").alias("tokens"), "chars", F.lit(sign).alias("sign"))


def delta(changes: DataFrame) -> DataFrame:
    """Totals of signed changes: columns of ``counted`` and sign; partial sums are made before the shuffle."""
    return changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"), F.sum(F.col("sign") * F.col("chars")).cast("long").alias("chars"))


class Rollup:
    """Totals in a folder of the store, one immutable folder for each version of them.

    ``commit`` writes the totals of the new version, then its manifest, which names the folder and
    the batch.  A manifest is written under another name and then renamed to its number, which
    fails if that number is taken: until then nothing that readers see has changed, so that a
    commit that is broken off at any point, repeated, or overtaken by another writer does no harm.
    (On stores without an atomic rename, one writer at a time.)  A batch id is known as applied by a
    marker file of its own; the marker of the last manifest is made good by the next commit.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _read(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    @staticmethod
    def _marker(batch: str) -> str:
        return f"applied/{hashlib.sha256(batch.encode()).hexdigest()}"

    def manifest(self) -> dict:
        """The latest: version, batch (the id that made it), totals (folder or null)."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return {"version": 0, "batch": None, "totals": None}
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return self._read(self._at(f"manifests/{names[-1]}")) if names else {"version": 0, "batch": None, "totals": None}

    def applied(self, batch: str) -> bool:
        return self.manifest()["batch"] == batch or self._fs.exists(self._at(self._marker(batch)))

    def totals(self) -> DataFrame:
        at = self.manifest()["totals"]
        return self.spark.read.schema(TOTALS).parquet(at) if at else self.spark.createDataFrame([], TOTALS)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of signed changes; False if it was applied before.  Cells that fall to no documents go."""
        old = self.manifest()
        if old["batch"] is not None:
            self._write(self._marker(old["batch"]), old["batch"])
        if old["batch"] == batch or self._fs.exists(self._at(self._marker(batch))):
            return False
        rows = delta(changes)
        if old["totals"]:
            rows = self.spark.read.schema(TOTALS).parquet(old["totals"]).unionByName(rows)
        rows = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 or tokens <> 0 or chars <> 0")
        unique, version = uuid.uuid4().hex, old["version"] + 1
        folder = f"{self.path}/totals/{version:012d}-{unique}"
        rows.write.parquet(folder)
        draft = f"drafts/{unique}"
        self._write(draft, json.dumps({"version": version, "batch": batch, "totals": folder}))
        self._fs.mkdirs(self._at("manifests"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        source, target = (context.makeQualified(self._fs.makeQualified(self._at(x))) for x in (draft, f"manifests/{version:012d}.json"))
        context.rename(source, target, none)  # fails if another writer was first
        self._write(self._marker(batch), batch)
        return True


def maintained(docs: DataFrame, path: str, first: Vocabulary, second: Vocabulary) -> DataFrame:
    """Totals of docs after a life of four batches, two of them committed twice.

    load: every document, counted by the first vocabulary as version bpe-1.  dedup: copies are
    deleted, that is every document with a text that a document with a smaller doc_id has.
    revise: German documents are counted anew, by the second vocabulary under the same
    version.  multi: what is left is inserted as version multi-1, by the second vocabulary.

    Cases: a null text has no tokens and is never a copy; null sources and languages are cells
    of their own; a null doc_id comes before all others; rows that repeat a doc_id with its text
    are no copies of each other; very long texts are counted whole, one at a time; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    rollup = Rollup(docs.sparkSession, path)
    thin = written(counted(docs, {"__first": first, "__second": second}), "token-counts")
    rollup.commit("load", changes(thin, "bpe-1", "__first", 1))
    rollup.commit("load", changes(thin, "bpe-1", "__first", 1))
    least = thin.where("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    copy = F.col("hash").isNotNull() & F.col("doc_id").isNotNull() & (F.col("unnamed") | (F.col("doc_id") > F.col("least")))
    marked = written(thin.join(least, "hash", "left").withColumn("copy", F.coalesce(copy, F.lit(False))), "token-copies")
    copies, rest = marked.where("copy"), marked.where("not copy")
    rollup.commit("dedup", changes(copies, "bpe-1", "__first", -1))
    german = rest.where("lang = 'de'")
    rollup.commit("revise", changes(german, "bpe-1", "__first", -1).unionByName(changes(german, "bpe-1", "__second", 1)))
    rollup.commit("dedup", changes(copies, "bpe-1", "__first", -1))
    rollup.commit("multi", changes(rest, "multi-1", "__second", 1))
    return rollup.totals()
