"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fixity, mixing, near_dup, quality, sharding, token_counts, token_files, toxicity, url_filter
from .store import new_path, table

Query = Callable[[SparkSession, str], DataFrame]


SHARDS = 8


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers that are installed beside this library."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and toxic flag of every document, by a model fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the weak-supervision verdict of every document."""
    return quality.judged(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its place."""
    return decontamination.contaminations(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


#: Bits of a replica that the audit is shown are flipped where the hash of a url begins so.
DAMAGED, LOST = "07", "5c"


def op4_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages' WARC records against a replica with planted damage.

    In the replica, records whose url has an MD5 that begins with DAMAGED end in another byte, and
    those with LOST are missing.
    """
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    mark = F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 2)
    html = F.when(mark == DAMAGED, F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html"))
    return fixity.audited(pages, pages.where(mark != LOST).withColumn("html", html))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8 and slot, and its shard of 9."""
    return sharding.assigned(table(spark, sf_dir, "documents", "doc_id", "text"), SHARDS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by source, language and tokenizer version after a life of four batches."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    first, second = (token_counts.Vocabulary(tokenizer_path(x)) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
    return token_counts.maintained(docs, new_path(spark, "token-counts"), first, second)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates: five words, similarity 0.8."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


URL_RULES = [url_filter.Rule(*x) for x in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]
#: First labels of hosts whose urls are on the list.
LISTED = ("spam-farm", "ads-track")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; the list holds the urls (host and path) of hosts that begin with LISTED."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    keys = url_filter.parsed(pages).where(F.substring_index("host", ".", 1).isin(*LISTED)).select(F.concat("host", "path").alias("key")).distinct()
    return url_filter.verdicts(pages, URL_RULES, keys)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document, for mixing.TARGETS."""
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the token files of all documents."""
    return token_files.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality": op2_quality,
        "op3_contamination": op3_contamination,
        "op4_fixity": op4_fixity,
        "op5_shards": op5_shards,
        "op6_token_counts": op6_token_counts,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_urls": op8_urls,
        "op9_mixing": op9_mixing,
        "op10_token_files": op10_token_files,
    }


def _crc() -> str:
    """The 256 remainders of the CRC-32 polynomial as a SQL list."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return str(out)


_SQL4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, substr(md5(coalesce(url, '')), 1, 2) AS mark FROM pages),
r AS (SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM p),
w AS (SELECT page_id, mark, head || octet_length(encode(html)) || gap || html || gap AS ours, head || (octet_length(encode(html)) + 1) || gap || html || '?' || gap AS theirs FROM r),
d AS (SELECT page_id, mark, octet_length(encode(ours))::BIGINT AS length, sha256(encode(ours)) AS digest, CASE WHEN mark = '{LOST}' THEN NULL WHEN mark = '{DAMAGED}' THEN sha256(encode(theirs)) ELSE sha256(encode(ours)) END AS found FROM w)
SELECT page_id AS record_id, row_number() OVER (PARTITION BY page_id ORDER BY digest, length) - 1 AS nth, (sum(length) OVER (ORDER BY page_id, digest, length ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length)::BIGINT AS "offset",
  length, digest, found, CASE WHEN found IS NULL THEN 'missing' WHEN found <> digest THEN 'corrupt' ELSE 'intact' END AS status FROM d"""

_SQL5 = f"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 0) AS k, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
j AS (SELECT r, n, (CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616 ELSE k::HUGEINT END) AS key, 0::BIGINT AS b, 0::BIGINT AS a FROM t CROSS JOIN (VALUES ({SHARDS}), ({SHARDS + 1})) AS v(n)
  UNION ALL SELECT r, n, x, a, floor((a + 1) * (2147483648.0::DOUBLE / ((x // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT r, n, a, (key * {sharding.MULTIPLIER} + 1) % 18446744073709551616 AS x FROM j WHERE a < n)),
s AS (SELECT r, max(CASE WHEN n = {SHARDS} THEN b END)::INTEGER AS shard, max(CASE WHEN n = {SHARDS + 1} THEN b END)::INTEGER AS grown_shard FROM j GROUP BY r),
c AS (SELECT t.r, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT)), lambda v, z: xor(v >> 8, {_crc()}[(xor(v, z) & 255) + 1])), 4294967295))::BIGINT AS crc FROM t)
SELECT doc_id, octet_length(raw)::BIGINT + 1 AS size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc) - 1 AS slot, grown_shard FROM t JOIN s USING (r) JOIN c USING (r)"""

_SQL8 = """WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']), {'host': '', 'path': ''}) AS x FROM pages),
p AS (SELECT page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM u),
r AS (SELECT * FROM (VALUES %s) AS v(rule, host, path, verdict)),
m AS (SELECT p.page_id, p.host, p.path, r.rule, r.verdict, split_part(p.host, '.', 1) IN (%s) AS listed, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM m WHERE k = 1""" % (
    ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES),
    ", ".join(f"'{x}'" for x in LISTED),
)


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; tests hold the other queries against brute force."""
    return {"op4_fixity": _SQL4, "op5_shards": _SQL5, "op8_urls": _SQL8}
