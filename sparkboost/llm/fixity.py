"""Fixity audit of WARC record collections by Merkle trees over ordered offset ranges.

The first collection is the catalogue: its records are laid out in order of their id, and each
range of offsets is a leaf.  Each replica builds a tree from its own records alone: a record of
the second falls to the leaf whose records it lies among by its id.  A leaf's hash covers the
record digests of its range in order, an inner node's the hashes of its children.  The roots
are compared, and only children of nodes that differ are looked at further; the records of the
two replicas meet in the differing leaves and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positioned
from .store import small_batches, written

#: Bytes of a leaf's range of offsets, children of an inner node, and records that one hash of a leaf covers directly.
RANGE_BYTES, FAN_OUT, CHUNK = 1 << 20, 16, 4096


def records(pages: DataFrame) -> DataFrame:
    """record_id, length and digest (SHA-256, hexadecimal) of the WARC response record of each page.

    The record: version line, type, target URI, length of the content, an empty line, the
    content and two line ends, in UTF-8.  A null url or html is empty.  The text of the
    record is never shuffled.
    """
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    raw = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("record_id"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw.cast("binary"), 256).alias("digest"))


def manifest(rows: DataFrame) -> DataFrame:
    """record_id, nth, offset, length, digest, leaf and rank in the leaf of records in their stored order.

    nth tells repeated record_ids apart, in order of digest.
    """
    out = positioned(rows, "record_id", ["digest", "length"], size="length")
    out = out.select("record_id", "nth", F.col("before").alias("offset"), "length", "digest", F.floor(F.col("before") / RANGE_BYTES).cast("long").alias("leaf"))
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy("offset")) - 1  # a leaf's records are few: each has a length
    return written(out.withColumn("rank", rank.cast("long")), "fixity-manifest")


def placed(layout: DataFrame, rows: DataFrame) -> DataFrame:
    """record_id, nth, digest, leaf and rank in the leaf of a replica's own records.

    The first record of each of the layout's leaves marks its border; marks and records are put
    in one order by ranges, and each record takes the last mark before it.  No record of the
    layout but these marks is looked at.
    """
    small_batches(rows.sparkSession)
    own = positioned(rows, "record_id", ["digest", "length"]).select("record_id", "nth", "digest", F.lit(None).cast("long").alias("leaf"))
    marks = layout.where("rank = 0").select("record_id", "nth", F.lit(None).cast("string").alias("digest"), "leaf")
    both = own.unionByName(marks).withColumn("kind", F.col("leaf").isNull())
    part = both.repartitionByRange("record_id", "nth", "kind").sortWithinPartitions("record_id", "nth", "kind").drop("kind")
    names = ["record_id", "nth", "digest", "leaf", "rank", "part"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, leaf, done = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            given = batch.column(3).fill_null(-1).to_numpy(zero_copy_only=False)
            mark = given >= 0
            at = np.maximum.accumulate(np.where(mark, np.arange(n), -1))
            leaves = np.where(at >= 0, given[np.maximum(at, 0)], leaf)
            rank = np.where(at >= 0, np.arange(n) - at - 1, done + np.arange(n))
            leaf, done = int(leaves[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaves), pa.array(rank), pa.array(np.full(n, here))], names=names)

    local = written(part.mapInArrow(fill, "record_id long, nth long, digest string, leaf long, rank long, part long"), "fixity-places")
    ends = local.groupBy("part").agg(F.max("leaf").alias("leaf"), F.max(F.struct("leaf", "rank")).alias("last"))
    leaf, run, carries = 0, 0, []
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # a row for each partition
        carries.append((r["part"], leaf, run))
        leaf, run = (r["leaf"], r["last"]["rank"] + 1) if r["leaf"] >= 0 else (leaf, run + r["last"]["rank"] + 1)
    carried = rows.sparkSession.createDataFrame(carries, "part long, from_leaf long, from_rank long")
    out = local.where("digest is not null").join(F.broadcast(carried), "part")
    early = F.col("leaf") < 0
    return out.select("record_id", "nth", "digest", F.when(early, F.col("from_leaf")).otherwise(F.col("leaf")).alias("leaf"), (F.col("rank") + F.when(early, F.col("from_rank")).otherwise(0)).alias("rank"))


def _hashed(groups: DataFrame, of: str) -> DataFrame:
    return groups.withColumn("hash", F.sha2(F.concat_ws("", F.col(f"x.{of}")).cast("binary"), 256)).drop("x")


def tree(rows: DataFrame, height: int) -> list[DataFrame]:
    """``height`` levels of (node, hash) from the leaves to the root, of one replica's own records.

    A leaf's hash covers the hashes of its chunks of CHUNK records: what a replica has too much
    in one place is hashed by many tasks.
    """
    chunks = _hashed(rows.groupBy("leaf", F.floor(F.col("rank") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("x")), "digest")
    level = _hashed(chunks.groupBy(F.col("leaf").alias("node")).agg(F.sort_array(F.collect_list(F.struct("chunk", "hash"))).alias("x")), "hash")
    levels = [written(level, "fixity-level")]
    for _ in range(height - 1):
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN_OUT).cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("x"))
        levels.append(written(_hashed(up, "hash").withColumnRenamed("up", "node"), "fixity-level"))
    return levels


def mismatches(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame | None:
    """The leaves (column leaf) whose hashes differ, found from the roots down; None if the roots agree.

    Below the roots only children of differing nodes are read.
    """
    bad = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if bad is not None:
            children = bad.select(F.explode(F.sequence(F.col("node") * FAN_OUT, F.col("node") * FAN_OUT + FAN_OUT - 1)).alias("node"))
            a, b = (x.join(children, "node", "left_semi") for x in (a, b))
        bad = written(a.join(b.withColumnRenamed("hash", "other"), "node", "full_outer").where("not (hash <=> other)").select("node"), "fixity-bad")
        if bad.isEmpty():
            return None
    return bad.withColumnRenamed("node", "leaf")


def compared(layout: DataFrame, other: DataFrame, bad: DataFrame) -> DataFrame:
    """The records of the leaves in ``bad``, of both replicas, side by side."""
    l, r = (x.join(bad, "leaf", "left_semi").alias(n) for x, n in ((layout, "l"), (other, "r")))  # noqa: E741
    same = F.col("l.record_id").eqNullSafe(F.col("r.record_id")) & (F.col("l.nth") == F.col("r.nth"))
    out = l.join(r, same, "full_outer")
    status = F.when(F.col("l.digest").isNull(), "extra").when(F.col("r.digest").isNull(), "missing").when(F.col("l.digest") != F.col("r.digest"), "corrupt").otherwise("intact")
    pick = lambda c: F.when(F.col("l.digest").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    return out.select(pick("record_id"), pick("nth"), "l.offset", "l.length", "l.digest", F.col("r.digest").alias("found"), status.alias("status"))


def audited(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """A row of every record: record_id, nth, offset, length, digest, found, status.

    status: ``intact``; ``corrupt`` (the replica's digest differs), ``missing`` (in the replica),
    or ``extra`` (not in the first collection, so without a place).  Records in leaves that
    the descent doesn't reach are intact by the hash of a node above them: the replica's record
    isn't looked at, and its digest is that of the catalogue.

    Cases: repeated page_ids are told apart by nth, in order of digest, so that damage to one of
    them can move the others' places: then each of these is compared with the one in its place; a
    null page_id is an id like any other and comes first; ties can't be, for (page_id, nth) is
    unique; very long records are a leaf of their own; empty tables give no rows, or only
    missing or extra ones; other columns, whatever their names, are ignored.
    """
    layout = manifest(records(pages))
    other = written(placed(layout, records(replica)), "fixity-replica")
    top, height = layout.agg(F.max("leaf")).first()[0] or 0, 1
    while top:
        top, height = top // FAN_OUT, height + 1
    bad = mismatches(tree(layout, height), tree(other, height))
    columns = ["record_id", "nth", "offset", "length", "digest"]
    intact = layout if bad is None else layout.join(bad, "leaf", "left_anti")
    out = intact.select(*columns, F.col("digest").alias("found"), F.lit("intact").alias("status"))
    return out if bad is None else out.unionByName(compared(layout, other, bad))
