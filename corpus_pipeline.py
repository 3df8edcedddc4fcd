"""A training corpus from ``documents``: five stages, each on all that the one before kept.

1 toxicity: documents that the ordinal model rejects go.  2 near duplicates: one document of
each class stays.  3 decontamination: documents that hold a benchmark item go.  4 mixing: the
documents that their rates draw stay.  5 token files: the rest is encoded, written in
compressed blocks and read back.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkboost.llm import decontamination, mixing, near_dup, token_files, toxicity
from sparkboost.llm.queries import tokenizer_path
from sparkboost.llm.store import kept_rows, mark, release, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go; null and empty texts, which it never does, stay.

    Repeated rows share their verdict; without labels of both kinds all rows stay.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return kept_rows(docs, "text", lambda data, off: ~model.rejects(data, off))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, and all rows without a text; see ``near_dup.deduplicated``."""
    return near_dup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows go or stay together."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn with their rates, some more than once; see ``mixing.sampled`` and ``mixing.mixed`` for odd rows."""
    return mixing.sampled(docs, table(spark, sf_dir, "labels"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place and checksum in the token files; a null or empty text is the end id alone."""
    return token_files.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_files", tokenize),
]

#: Model fitting, signatures and the tokenizer can't be expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result but the last's is written and read again.

    What a stage has written besides its result goes once that is there.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        begun = mark()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}-{name}")
            release(spark, begun, keep=1)
    return docs
