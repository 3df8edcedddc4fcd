"""Each training-data operator against brute force, a round trip or held-out accuracy."""

import collections
import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkboost.llm import decontamination, fixity, mixing, near_dup, quality, sharding, token_counts, token_files, toxicity, url_filter
from sparkboost.llm.graph import connected_components
from sparkboost.llm.queries import tokenizer_path
from sparkboost.llm.text import U64, slices

SMALL = "/root/testdata/sf0.001"


def texts(spark, name="documents"):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select("doc_id" if name == "documents" else "item_id", "text").collect()]


def shingle_counts(text, width=5):
    w = text.encode().split()
    return collections.Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else collections.Counter([tuple(w)] if w else [])


def test_near_duplicate_classes_are_those_of_all_pairs(spark):
    docs = texts(spark)
    rng = random.Random(5)
    base = docs[3][1].split(" ")
    for k in range(40):  # copies of one text with some words changed, some of them linked only by way of others
        w = list(base)
        for i in rng.sample(range(len(w)), max(1, len(w) // rng.choice([12, 30, 60]))):
            w[i] = f"x{rng.randrange(10**6)}"
        docs.append((10_000 + k, " ".join(w)))
    sets = {d: shingle_counts(t) for d, t in docs}
    head = {d: d for d in sets}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        common = sum((x & y).values())
        if common and common >= 0.8 * (sum(x.values()) + sum(y.values()) - common):
            p, q = sorted((find(a), find(b)))
            head[q] = p
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {d: find(d) for d in sets}


def test_joining_of_a_run_holds_few_bits_at_once():
    rng = np.random.default_rng(4)
    n, near = 1000, 1000
    sets = np.sort(rng.permutation(np.repeat(rng.choice(2**62, n * near // 2, replace=False).astype(U64), 2)).reshape(n, near), axis=1)
    sets[7, 50:] = sets[3, 50:]
    sets = [np.unique(x) for x in sets]
    comp = np.arange(n) // 2
    tracemalloc.start()
    links = list(near_dup._joining(comp, None, sets, 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == [(1, 3)]
    assert peak < 128 << 20  # the bits of all rows alone are 62 MB, and were held twice


def test_a_round_of_components_is_written_once(spark, monkeypatch):
    from sparkboost.llm import graph

    tables, digests = [], []
    monkeypatch.setattr(graph, "written", lambda df, name, f=graph.written: tables.append(name) or f(df, name))
    monkeypatch.setattr(graph, "_digest", lambda edges, f=graph._digest: digests.append(1) or f(edges))
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 107), (107, 103)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 103: 100, 107: 100}
    assert len(tables) == len(digests)


def test_bridges_join_components_and_single_rows(spark):
    comps = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "vertex long, component long")
    joined = connected_components(spark.createDataFrame([(5, 1), (3, 5), (10, 11)], "a long, b long"))
    got = sorted(tuple(r) for r in near_dup._merged(comps, joined).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (8, 8), (9, 8), (10, 10), (11, 10)]


def test_dart_signatures_agree_as_often_as_weighted_sets_overlap():
    rng = np.random.default_rng(2)
    keys, w = rng.integers(0, 2**48, 200).astype(U64), rng.integers(1, 6, 200) / 2
    other = w * rng.choice([1, 1, 1, 0.5], 200)
    want = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    row = np.repeat([0, 1], 200)
    got = [(s[0] == s[1]).mean() for k in range(12) for s in [near_dup.signatures(row, np.tile(keys + U64(k * 977), 2), np.concatenate([w, other]), 2)]]
    assert np.mean(got) == pytest.approx(want, abs=0.03)


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


def test_quality_counts_and_verdicts(spark):
    docs = texts(spark)
    rows = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, t in docs:
        w = t.encode().split()
        wins = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(len(x.decode()) for x in w), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = [(rows[d]["kept"], bool(q)) for d, q in labels.items() if not rows[d]["base_failed"]]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_quality_posteriors_are_those_of_plain_expectation_maximisation(spark):
    rows = quality.judged(spark.createDataFrame(texts(spark), "doc_id long, text string")).collect()
    votes = [[r["votes"] // 3**k % 3 for k in range(len(quality.RULES))] for r in rows if not r["base_failed"]]
    prior, p = 0.8, [[[0.2, 0.5, 0.3], [0.1, 0.89, 0.01]] for _ in quality.RULES]
    first = [[list(c) for c in r] for r in p]
    for _ in range(200):
        good = []
        for v in votes:
            odds = [1 - prior, prior]
            for k, x in enumerate(v):
                odds = [o * p[k][c][x] for c, o in enumerate(odds)]
            good.append(odds[1] / sum(odds))
        for k in range(len(p)):
            for c in range(2):
                start = quality.BELIEF * len(votes) * (0.8 if c else 0.2)
                new = [sum((g if c else 1 - g) for g, v in zip(good, votes, strict=True) if v[k] == x) + start * first[k][c][x] for x in range(3)]
                p[k][c] = [x / sum(new) for x in new]
        prior = (sum(good) + 1) / (len(votes) + 2)
    got = [r for r in rows if not r["base_failed"]]
    assert all(r["p_good"] == pytest.approx(g, abs=1e-5) and r["kept"] == (r["p_good"] >= 0.5) for r, g in zip(got, good, strict=True))
    assert len({r["kept"] for r in got}) == 2


def test_expectation_maximisation_finds_the_rules_that_guess():
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.7
    vote = lambda right: np.where(rng.random(4000) < right, np.where(good, 1, 2), np.where(good, 2, 1))
    votes = np.stack([vote(0.9), vote(0.85), vote(0.8), vote(0.5)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, p = quality.fit(patterns, counts.astype(float))
    assert p[0, 1, 1] > p[3, 1, 1] + 0.2 and p[0, 0, 2] > p[3, 0, 2] + 0.2


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def least_edits(item, text):
    """Edits of the item to its best place in the text, by the whole matrix."""
    codes = np.array([ord(c) for c in text], dtype=np.int64)
    ramp = np.arange(len(codes) + 1)
    d = np.zeros(len(codes) + 1, np.int64)
    for i, x in enumerate(item, 1):
        e = np.concatenate([[i], np.minimum(d[:-1] + (codes != ord(x)), d[1:] + 1)])
        d = np.minimum.accumulate(e - ramp) + ramp
    return int(d.min())


def flat(text):
    return "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text)


def spoiled(rng, text, edits):
    s = list(text)
    for _ in range(edits):
        i = rng.randrange(len(s))
        rng.choice([lambda i=i: s.pop(i), lambda i=i: s.insert(i, "#"), lambda i=i: s.__setitem__(i, "ж")])()
    return "".join(s)


def test_contaminations_are_those_of_a_whole_search(spark):
    items = texts(spark, "benchmark")[:8] + [(90, "Съешь ещё этих мягких французских булок, да выпей же чаю. " * 2), (91, "exactly so"), (92, "too short")]
    rng = random.Random(3)
    docs = [(k, "lead in " * 7 + spoiled(rng, text, rng.randrange(int(len(text) * 0.13) + 1)) + " and out" * 5) for k, (_, text) in enumerate(items * 4)]
    docs += [(100, "nothing of the kind " * 50), (101, items[0][1][: len(items[0][1]) // 2]), (102, items[8][1].upper()), (103, items[1][1].replace(" ", "\u3000"))]
    docs += [(1000 + d, t) for d, t in texts(spark)[:60]]
    got = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    best = {}
    for r in got:
        best[r["doc_id"], r["item_id"]] = min(r["edits"], best.get((r["doc_id"], r["item_id"]), 99))
        item, text = dict(items)[r["item_id"]], dict(docs)[r["doc_id"]]
        assert edit_distance(flat(item), flat(text)[r["start_char"] : r["end_char"]]) == r["edits"]
    want = {}
    for d, text in docs:
        for i, item in items:
            if len(item) >= decontamination.Q:
                n = least_edits(flat(item), flat(text))
                if n <= min(int(decontamination.EDITS * len(item)), (len(item) - decontamination.Q) // decontamination.Q):
                    want[d, i] = n
    assert best == want and len(want) > 20


def test_every_region_of_an_item_is_found_and_a_shared_opening_stays_small(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    opening = " ".join(word() for _ in range(13))
    items = [(k, opening + " " + " ".join(word() for _ in range(15))) for k in range(2000)]
    index = decontamination.Index.of_items([(i, t.encode()) for i, t in items])
    text = f"{items[5][1]} -- {items[5][1]} {items[7][1]} " + " ".join(opening for _ in range(60))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    chars, off = decontamination.folded(data, np.array([0, len(data)]))
    assert sum(index.first[r[2] + 1] - index.first[r[2]] for r in [tuple(x) for x in zip(*index.runs(chars, off), strict=True)]) < 63 * 2000 * 2  # not one for each q-gram
    got = index.search(data, np.array([0, len(data)]))
    n = len(items[5][1])
    assert [g for g in got if g[1] in (5, 7)] == [(0, 5, 0, n, 0), (0, 5, n + 4, 2 * n + 4, 0), (0, 7, 2 * n + 5, 2 * n + 5 + len(items[7][1]), 0)]


def test_toxicity_on_held_out_labels(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    model = toxicity.trained(d, fit)
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.scored(d, model).withColumnRenamed("toxic", "found").join(held, "doc_id").select("found", "toxic", "severity").collect()
    assert sum(r["found"] == bool(r["toxic"]) for r in rows) >= 0.93 * len(rows)
    assert not any(r["found"] for r in rows if not r["toxic"])


def test_given_grades_are_used(spark):
    docs = spark.createDataFrame([(i, "fine words here " * 3 + "vile " * (i % 4 > 0) + "vilest " * (i % 4 > 1) + "atrocious " * (i % 4 > 2)) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("toxic"))
    got = toxicity.scored(docs, toxicity.trained(docs, labels)).collect()
    assert np.mean([r["grade"] == r["doc_id"] % 4 for r in got]) > 0.95
    other = toxicity.scored(docs, toxicity.trained(docs, labels.withColumn("toxic", F.when(F.col("toxic") > 0, 4 - F.col("toxic")).otherwise(0)))).collect()
    assert np.mean([r["grade"] == (4 - r["doc_id"] % 4) % 4 for r in other]) > 0.9


def test_scores_of_a_model_by_hand(spark):
    import re

    docs = texts(spark)
    model = toxicity.trained(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    known = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for d, t in docs:
        seen = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))):
            data = np.frombuffer(w, dtype=np.uint8)
            for _, h in toxicity.features(data, np.array([0, len(data)])):
                seen |= set(h.tolist())
        hit = [known[h] for h in seen if h in known]
        above = 1 / (1 + np.exp(-(sum(hit) - model.thresholds)))
        assert got[d]["severity"] == pytest.approx(above.sum(), abs=1e-9) and got[d]["toxic"] == (bool(hit) and above[0] >= 0.5)


def test_cumulative_link_weights_order_grades():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.random((n, 3)) < 0.4
    grade = np.clip(x[:, 0].astype(int) + x[:, 1], 0, 2)
    row, feature = np.nonzero(x)
    w, t = toxicity.fit(row, feature, grade, 3, 2)
    assert w[0] > 1 and w[1] > 1 and abs(w[2]) < min(w[0], w[1]) / 3 and t[0] < t[1]


def test_fixity_finds_each_kind_of_damage(spark):
    pages = [(i, f"http://h/{i}", "body " * (i % 50)) for i in range(400)]
    kinds = "page_id long, url string, html string"
    bad = [(i, u, h + "!" if i in (7, 399) else h) for i, u, h in pages if i != 250] + [(1000, "u", "extra")]
    status = {r["record_id"]: r["status"] for r in fixity.audited(spark.createDataFrame(pages, kinds), spark.createDataFrame(bad, kinds)).collect()}
    assert {k: v for k, v in status.items() if v != "intact"} == {7: "corrupt", 399: "corrupt", 250: "missing", 1000: "extra"}


def test_extra_records_change_the_roots_and_the_descent_reads_few_records(spark):
    kinds = "page_id long, url string, html string"
    pages = spark.createDataFrame([(i if i >= 30 else None, f"http://h/{i}", "body " * 60_000) for i in range(120)], kinds).repartition(5)
    layout = fixity.manifest(fixity.records(pages))
    assert layout.agg(F.max("leaf")).first()[0] > 30
    same, more = (fixity.placed(layout, fixity.records(x)) for x in (pages, pages.unionByName(spark.createDataFrame([(77, "again", "x"), (5000, "u", "x")], kinds))))
    ours = fixity.tree(layout, 3)
    assert [r["hash"] for r in ours[-1].collect()] == [r["hash"] for r in fixity.tree(same, 3)[-1].collect()] and fixity.mismatches(ours, fixity.tree(same, 3)) is None
    bad = fixity.mismatches(ours, fixity.tree(more, 3))
    rows = fixity.compared(layout, more, bad).collect()
    assert len(rows) < 12 and sorted(r["record_id"] for r in rows if r["status"] == "extra") == [77, 5000]


def test_positions_of_keys_that_lie_in_many_partitions(spark):
    from sparkboost.llm.ordering import positioned

    rows = [(None if i % 3 else i // 50, i % 7, i % 2) for i in range(3000)]
    got = positioned(spark.createDataFrame(rows, "k long, t long, g long").repartition(6), "k", ["t"], size="t", within=None).collect()
    order = sorted(rows, key=lambda r: ((r[0] is not None), r[0] or 0, r[1]))
    assert sorted(r["pos"] for r in got) == list(range(3000))
    seen, total = collections.Counter(), 0
    for r, w in zip(sorted(got, key=lambda r: r["pos"]), order, strict=True):
        assert (r["k"], r["t"]) == w[:2] and r["before"] == total and r["nth"] == seen[r["k"]]
        seen[r["k"]] += 1
        total += r["t"]


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.arange(-2000, 20_000)
    for n in (1, 2, 8, 100):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and a.max() < n
        assert (a != b).mean() == pytest.approx(1 / (n + 1), rel=0.15)
    assert np.bincount(sharding.jump(keys, 8)).min() > 0.9 * len(keys) / 8


def test_rollup_commits_once(spark, tmp_path):
    rollup = token_counts.Rollup(spark, str(tmp_path / "r"))
    batch = spark.createDataFrame([("s", "en", "v", 5, 20, 1), ("s", "en", "v", 2, 9, 1)], "source string, lang string, version string, tokens long, chars long, sign int")
    assert rollup.commit("a", batch) and not rollup.commit("a", batch)
    assert rollup.commit("b", batch.where("tokens = 5").withColumn("sign", F.lit(-1)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 1, 2, 9)]
    assert rollup.commit("c", batch.where("tokens = 2").withColumn("sign", F.lit(-1))) and rollup.totals().isEmpty()
    again = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert all(again.applied(x) for x in "abc") and not again.applied("d") and again.manifest()["version"] == 3


def test_a_broken_or_overtaken_commit_does_no_harm(spark, tmp_path):
    batch = spark.createDataFrame([("s", "en", "v", 5, 20, 1)], "source string, lang string, version string, tokens long, chars long, sign int")
    rollup, other = (token_counts.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    assert rollup.commit("a", batch)
    write = rollup._write
    rollup._write = lambda name, text: (_ for _ in ()).throw(OSError("lost")) if name.startswith("drafts/") else write(name, text)
    with pytest.raises(OSError):
        rollup.commit("b", batch)
    rollup._write = write
    assert rollup.totals().first()["docs"] == 1 and rollup.commit("b", batch) and rollup.totals().first()["docs"] == 2
    old = rollup.manifest()
    assert other.commit("c", batch)
    rollup.manifest = lambda: old  # what a slower writer has seen
    with pytest.raises(Exception, match="(?i)exist"):
        rollup.commit("d", batch)
    assert other.totals().first()["docs"] == 3 and not other.applied("d")


def test_totals_of_two_vocabularies(spark, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(9000 + r[0], *r[1:]) for r in rows[:20]]  # copies
    one = Tokenizer.from_file(tokenizer_path())
    two = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=token_counts._ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))._mergeable_ranks, special_tokens={})
    want, seen = collections.defaultdict(lambda: [0, 0, 0]), set()
    for _, text, source, lang in sorted(rows):
        if text not in seen:
            seen.add(text)
            a, b = len(one.encode(text, add_special_tokens=False).ids), len(two.encode_ordinary(text))
            for version, n in (("bpe-1", b if lang == "de" else a), ("multi-1", b)):
                cell = want[source, lang, version]
                cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + n, cell[2] + len(text)
    both = [token_counts.Vocabulary(tokenizer_path(x)) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")]
    got = token_counts.maintained(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), str(tmp_path / "t"), *both).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == dict(want)


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit("/p")).alias("key"), "id")
    listed = keys.where("id % 7 = 0")
    for bits in (url_filter.SEGMENT_BITS, 4000):  # the second is worked off in segments
        rows = url_filter.listed_flags(keys, "key", listed.select("key"), segment_bits=bits).collect()
        assert len(rows) == 3000 and all(r["listed"] == (r["id"] % 7 == 0) for r in rows)


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    rows = spark.createDataFrame([(i, int(rng.integers(1, 900)), *map(float, p[i])) for i in range(500)], "doc_id long, tokens long, p_good double, p_low double, p_toxic double")
    targets = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    out = mixing.rated(rows, mixing.solved(rows, targets, steps=200)).agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")).alias(d) for d in targets), F.min("rate").alias("least")).first()
    total = sum(out[d] for d in targets)
    assert out["least"] >= 0 and all(out[d] / total == pytest.approx(s, abs=0.005) for d, s in targets.items())


def test_a_rare_domain_meets_its_target_with_the_defaults(spark):
    rng = np.random.default_rng(9)
    domain = rng.choice(3, 4000, p=[0.875, 0.12, 0.005])
    p = np.eye(3)[domain]
    rows = spark.createDataFrame([(i, int(rng.integers(1, 900)), *map(float, p[i])) for i in range(4000)], "doc_id long, tokens long, p_good double, p_low double, p_toxic double")
    out = mixing.rated(rows, mixing.solved(rows, mixing.TARGETS)).toPandas()
    have = {d: (out.rate * out.tokens * out[f"p_{d}"]).sum() for d in mixing.DOMAINS}
    good = out.tokens[domain == 0].sum()
    assert all(have[d] == pytest.approx(good * s / mixing.TARGETS["good"], rel=0.0011) for d, s in mixing.TARGETS.items())


def test_rates_are_those_of_a_plain_solver(spark):
    rng = np.random.default_rng(12)
    n = 60
    p, tokens = rng.dirichlet([2, 0.5, 0.3], n), rng.integers(1, 400, n).astype(float)
    rows = spark.createDataFrame([(i, int(tokens[i]), *map(float, p[i])) for i in range(n)], "doc_id long, tokens long, p_good double, p_low double, p_toxic double")
    rate = np.array([r["rate"] for r in mixing.rated(rows, mixing.solved(rows, mixing.TARGETS, tolerance=1e-7)).orderBy("doc_id").collect()])
    share = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    wanted = share / share[0] * (tokens @ p)[0]
    # the point of { x >= 0, totals as wanted } nearest to 1, by alternating projections with memory (Dykstra)
    a, x, y = (p * tokens[:, None]).T, np.ones(n), np.zeros(n)
    w = 1 / tokens  # distances count by tokens
    for _ in range(200_000):
        z = x + w * (a.T @ np.linalg.solve(a * w @ a.T, wanted - a @ x))
        x = np.maximum(z + y, 0)
        y = z + y - x
    assert rate == pytest.approx(x, abs=2e-3)


def test_a_domain_without_labels_or_documents_takes_no_part(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    clean = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    assert mixing.sampled(d, clean).count() == d.count()
    rows = mixing.mixed(d, labels.where("quality = 1 or toxic = 1")).toPandas()
    assert rows.p_low.max() == 0 and (rows.rate * rows.tokens * rows.p_good).sum() == pytest.approx((rows.tokens * rows.p_good).sum(), rel=0.002)
    held = labels.toPandas().merge(mixing.mixed(d, labels.where("doc_id % 3 > 0")).toPandas(), on="doc_id")
    held = held[held.doc_id % 3 == 0]
    truth = np.where(held.toxic > 0, 2, np.where(held.quality > 0, 0, 1))
    assert (held[[f"p_{x}" for x in mixing.DOMAINS]].values.argmax(axis=1) == truth).mean() > 0.85


def test_unmet_targets_are_reported_and_rates_above_one_are_drawn(spark):
    rows = spark.createDataFrame([(i, 10, 0.9, 0.05, 0.05) for i in range(20)], "doc_id long, tokens long, p_good double, p_low double, p_toxic double")
    with pytest.warns(RuntimeWarning, match="toxic has"):
        mixing.solved(rows, {"good": 0.7, "low": 0.2, "toxic": 0.1})
    u = (np.arange(1000) + 0.5) / 1000
    assert [int(mixing.drawn(np.full(1000, x), u).sum()) for x in (0.0, 0.3, 1.0, 2.25)] == [0, 300, 1000, 2250]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(8)
    for ids in (rng.integers(0, 9, 5000), np.zeros(501, int), np.arange(300), np.array([4])):
        last = np.zeros(len(ids), bool)
        last[np.append(rng.integers(0, len(ids), 5), len(ids) - 1)] = True
        grammar, symbols = token_files.repair(ids, last, 50_257, least=2)
        block = token_files.Block(token_files.pack(grammar, grammar.lengths()), symbols)
        at = np.concatenate([[0], np.flatnonzero(last) + 1])
        for k, (a, b) in enumerate(itertools.pairwise(at)):
            assert (block.document(k) == ids[a:b]).all()
            assert all(block.token(k, i) == ids[a + i] for i in range(0, b - a, 7))
            assert (block.span(k, (b - a) // 3, b - a) == ids[a + (b - a) // 3 : b]).all()
    with pytest.raises(ValueError):
        token_files.unpack(token_files.pack(grammar, grammar.lengths())[:-1] + b"\xff")


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(6)
    passages = [rng.integers(0, 5000, 65) for _ in range(20)]
    docs = [x for _ in range(800) for x in (rng.integers(0, 5000, 20), passages[rng.integers(20)])]
    ids, last = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(x) for x in docs])[1::2] - 1] = True
    grammar, symbols = token_files.repair(ids, last, 50_257)
    ends = np.zeros(len(grammar.sequence), bool)
    ends[np.cumsum(symbols) - 1] = True
    left = collections.Counter((a, b) for a, b, end in zip(grammar.sequence[:-1].tolist(), grammar.sequence[1:].tolist(), ends[:-1], strict=True) if not end)
    assert max(left.values()) < token_files.LEAST and grammar.lengths().max() >= 65
    assert (token_files.Block(token_files.pack(grammar, grammar.lengths()), symbols).expand(grammar.sequence) == ids).all()


def test_token_files_hold_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs = texts(spark)
    rows = token_files.round_trip(spark.createDataFrame(docs, "doc_id long, text string"), tokenizer_path()).collect()
    want, start = {}, 0
    for d, t in sorted(docs):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == want


def test_encoder_agrees_with_the_library_on_odd_white_space():
    code = token_files.encoder(tokenizer_path())
    odd = ["", " ", "  a", "a  b", "a b ", "a\nb", "a\n\nb", "a \n b", "\na", "it's don't, o'clock.x", "a.b ...d", "x y z", "“q” – r", "a\tb", "日本 語。", "1.5 2,5", "é.é", "<|endoftext|> a", "a<|endoftext|><|endoftext|>b\nc", "a!\nB", "a b", "a\x1cb", "a\x85b"]
    parts = []
    for _, _, data, off in slices(pa.array(odd)):
        ids, n = code.encode(data, off)
        parts += np.split(ids, np.cumsum(n)[:-1])
    from tokenizers import Tokenizer

    assert [p.tolist() for p in parts] == [x.ids for x in Tokenizer.from_file(tokenizer_path()).encode_batch(odd, add_special_tokens=False)]


def test_one_document_is_read_by_its_id(spark, tmp_path):
    docs = texts(spark)
    frame = spark.createDataFrame([*docs, (None, "no id"), (docs[4][0], "again")], "doc_id long, text string")
    token_files.write_tokens(frame, str(tmp_path / "t"), tokenizer_path(), block_ids=5000)
    library = token_files.encoder(tokenizer_path()).library
    for k in (0, 17, 90):
        ids = [*library.encode(docs[k][1], add_special_tokens=False).ids, 2]
        assert [r["ids"] for r in token_files.read_document(spark, str(tmp_path / "t"), docs[k][0]).collect()] == [ids]
        assert [r["ids"] for r in token_files.read_document(spark, str(tmp_path / "t"), docs[k][0], 10, 30).collect()] == [ids[10:30]]
    assert token_files.read_document(spark, str(tmp_path / "t"), docs[4][0]).count() == 2
    assert token_files.read_document(spark, str(tmp_path / "t"), -77).count() == 0


def test_pipeline_keeps_one_of_each_class_and_no_leak(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        assert after.items() <= before.items()
        if name != "mixing":
            assert out.count() == len(after)
        if name == "near_duplicates":
            assert len(set(after.values())) == len(after) and {t for t in after.values()} <= set(before.values())
        if name == "decontamination":
            items = [t for _, t in texts(spark, "benchmark")]
            assert {d for d in before if d not in after} >= {d for d, t in before.items() if any(i in t for i in items)}
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert math.isclose(len(ids), docs.count())
