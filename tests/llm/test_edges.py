"""Nulls, empty and odd texts, repeated rows, empty tables and clashing column names, for all operators."""

import pytest

from sparkboost.llm import decontamination, fixity, mixing, near_dup, quality, sharding, token_counts, token_files, toxicity, url_filter
from sparkboost.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 700}x{i % 13}" for i in range(30_000))
TEXTS = [None, "", "   \n\t ", "one", "one", "two words", "a b c d e f", "a b c d e f", "\n\nline\nline\n", LONG, LONG + " end", "Ünï cødé “quotes” – dash\u00a0nbsp", "tab\tand  two blanks ", "a" * 50_000]
#: Names that operators use inside.
CLASH = "class_id long, shard long, label long, tokens long, bins long, key long, n long, part long, pos long, rep long, count long, features long, pattern long, row long, h long, listed long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(scope="module")
def docs(spark):
    extra = (None,) * len(CLASH.split(","))
    rows = [(i, t, "en" if i % 2 else None, "s", None, *extra) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, "no id here", "de", None, 1, *extra), (None, None, None, None, None, *extra), (-5, "negative id", "de", "s", 1, *extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1), (7, None, None), (3, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


N = len(TEXTS) + 5


def test_toxicity(spark, docs, none, labels):
    model = toxicity.trained(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == N and not any(r["toxic"] for r in rows if r["doc_id"] in (0, 1, 2))
    assert toxicity.scored(none, toxicity.trained(none, labels.limit(0))).count() == 0
    assert not any(r["toxic"] for r in toxicity.scored(docs, toxicity.trained(docs, labels.limit(0))).collect())


def test_quality(docs, none):
    rows = quality.judged(docs).collect()
    assert len(rows) == N and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_words"] == 0 and by[8]["n_dup_lines"] == 1 and by[13]["word_chars"] == 50_000
    assert quality.judged(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, LONG[:300]), (1, LONG[:300]), (2, None), (None, "x" * 40), (3, ""), (4, "short"), (5, "not there at all, " * 5)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(docs, bench).collect()} == {(9, 1), (10, 1)}
    assert decontamination.decontaminated(docs, bench).count() == N - 2
    assert decontamination.contaminations(none, bench).count() == 0
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


def test_fixity(spark):
    kinds = "page_id long, url string, html string, offset long, leaf long, digest string"
    pages = spark.createDataFrame([(1, "u", "h", 1, 1, "x"), (1, "u", "h", 1, 1, "x"), (None, None, None, None, None, None), (2, "é", "", 1, 1, "")], kinds)
    assert {r["status"] for r in fixity.audited(pages, pages).collect()} == {"intact"}
    assert sorted(r["status"] for r in fixity.audited(pages, pages.where("page_id = 1")).collect()) == ["intact", "intact", "missing", "missing"]
    assert sorted(r["status"] for r in fixity.audited(pages.where("page_id = 2"), pages).collect()) == ["extra", "extra", "extra", "intact"]
    empty = spark.createDataFrame([], kinds)
    assert fixity.audited(empty, empty).count() == 0


def test_sharding(docs, none):
    rows = sharding.assigned(docs, 4).collect()
    assert len(rows) == N
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.assigned(none, 4).count() == 0


def test_token_counts(spark, docs, none, tmp_path):
    both = [token_counts.Vocabulary(tokenizer_path(x)) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")]
    rows = token_counts.maintained(docs, str(tmp_path / "a"), *both).collect()
    for version in ("bpe-1", "multi-1"):
        assert sum(r["docs"] for r in rows if r["version"] == version) == N - 2  # documents 4 and 7 are copies of 3 and 6; rows of document 6 aren't copies of each other
    assert token_counts.maintained(none, str(tmp_path / "b"), *both).count() == 0


def test_near_duplicates(docs, none):
    rows = near_dup.near_duplicates(docs).collect()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(rows) == N and by[None] is None
    assert by[3] == by[4] == 3 and by[6] == by[7] == 6 and by[9] == by[10] == 9
    assert by[0] == 0 and by[1] == 1 and by[2] == 2 and by[5] == 5
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == N - 3 - 2  # documents 4, 7 and 10, and two of the rows of document 6
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.deduplicated(none).count() == 0


def test_repeated_and_missing_ids_with_different_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(9, text(1)), (9, text(2)), (3, text(2)), (None, text(4)), (None, text(4)), (None, text(1)), (None, text(5)), (5, text(5)), (9, text(1)), (7, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"] or -1), (r["class_id"] or -1)) for r in got) == [(-1, -1), (-1, -1), (-1, 5), (-1, 9), (3, 3), (5, 5), (7, 7), (7, 7), (9, 3), (9, 9), (9, 9)]
    kept = [tuple(r) for r in near_dup.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([(9, text(1)), (3, text(2)), (None, text(4)), (5, text(5)), (7, None), (7, None)], key=str)


def test_many_repeats_of_a_word_are_told_apart(spark):
    often = lambda k, n: " ".join([f"a{k}"] * n)
    texts = [often(1, 140_000), often(1, 70_000), often(1, 60_000) + " " + often(2, 80_000), often(1, 139_000)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}


def test_pipeline_stages(spark, docs, none, labels, tmp_path, monkeypatch):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LONG[:300])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            assert name == "token_files" or out.columns == given.columns
            n = out.count()
            assert n == given.count() if name in ("toxicity", "token_files") or given is none else n > 0
    given = docs.drop("class_id")
    given.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_urls(spark):
    kinds = "page_id long, url string, html string, host string, path string, key string, h long"
    pages = spark.createDataFrame([(1, None, "", "", "", "", 0), (2, "no scheme", "", "", "", "", 0), (3, "x://A.Bad/p?q", "", "", "", "", 0), (3, "x://A.Bad/p?q", "", "", "", "", 0), (None, "http://Ü.ORG", "", "", "", "", 0)], kinds)
    listed = spark.createDataFrame([("a.bad/p",), ("a.bad/p",), (None,), ("elsewhere/",)], "key string")
    rows = url_filter.verdicts(pages, [url_filter.Rule("org/", "block")], listed).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in rows) == [
        ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "a.bad", "/p", None, "block"), ("3", "a.bad", "/p", None, "block"), ("None", "Ü.org", "", None, "allow"),
    ]
    assert url_filter.verdicts(pages.limit(0), [], listed).count() == 0
    assert {r["verdict"] for r in url_filter.verdicts(pages, [], listed.limit(0)).collect()} == {"allow"}


def test_mixing(docs, none, labels):
    rows = mixing.mixed(docs, labels).collect()
    assert len(rows) == N and all(r["rate"] >= 0 for r in rows)
    assert mixing.mixed(none, labels).count() == 0
    assert mixing.sampled(docs, labels.limit(0)).columns == docs.columns


def test_token_files(docs, none):
    rows = token_files.round_trip(docs, tokenizer_path()).collect()
    assert len(rows) == N
    total = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (0, 1))
    assert token_files.round_trip(none, tokenizer_path()).count() == 0
