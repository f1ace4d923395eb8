"""Sharding, mixing, line dedup, language, tokens, revisits and tool calls on small fixtures."""

import itertools
import json
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.llm import language, line_dedup, mixing, revisits, sharding, tokens, tools

# ---- sharding ----


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.lists(st.integers(0, 60), min_size=1, max_size=6))
@settings(max_examples=80)
def test_flow_moves_the_fewest_units(supply, demand):
    demand[0] += max(0, sum(supply) - sum(demand))
    flow = sharding.min_cost_flow(supply, demand, [[int(i != j) for j in range(len(demand))] for i in range(len(supply))])
    assert [sum(row) for row in flow] == supply
    assert all(sum(row[j] for row in flow) <= d for j, d in enumerate(demand))
    assert sum(flow[i][i] for i in range(min(len(supply), len(demand)))) == sum(map(min, supply, demand))


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 9)), min_size=1, max_size=7), st.integers(1, 3), st.integers(0, 12))
@settings(max_examples=60)
def test_blocks_stay_within_a_block_of_the_best_plan(sizes, n, slack):
    """Held against every way of dealing the blocks."""
    blocks = [(s, k, size) for k, (s, size) in enumerate(sizes)]
    total, largest = sum(size for _, size in sizes), max(size for _, size in sizes)
    capacity = [(total + slack) // n + (i < (total + slack) % n) for i in range(n)]
    plan = sharding.solve(blocks, capacity)
    assert sum(plan.new_bytes) == total and plan.moved_bytes == sum(size for s, k, size in blocks if plan.moves[s, k] != s)
    assert all(got < cap + largest for got, cap in zip(plan.new_bytes, capacity, strict=True))
    moved = []
    for way in itertools.product(range(n), repeat=len(blocks)):
        got = [sum(size for (_, _, size), j in zip(blocks, way, strict=True) if j == i) for i in range(n)]
        if all(g < c + largest for g, c in zip(got, capacity, strict=True)):
            moved.append(sum(size for (s, _, size), j in zip(blocks, way, strict=True) if j != s))
    assert plan.moved_bytes <= min(moved) + 2 * n * largest


def test_capacities_that_are_too_small_are_refused():
    with pytest.raises(ValueError):
        sharding.solve([(0, 0, 5)], [2, 2])


def test_flow_prefers_cheap_edges():
    assert sharding.min_cost_flow([5], [3, 4], [[7, 2]]) == [[1, 4]]


def laid(docs, old):
    return docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text", old.alias("old_shard"))


def test_shards_are_level_and_nothing_moves_twice(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randint(0, 400), f"s{min(r.randint(0, 30), 9)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old = sharding.old_layout(F.col("source"))
    out, plan = sharding.assign(spark, laid(docs, old))
    got = out.groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(x.b for x in got) / 16
    assert len(got) == 16 and max(abs(x.b - mean) for x in got) < 0.01 * mean
    surplus = sum(max(0, b - mean) for b in plan.old_bytes)
    assert plan.moved_bytes <= surplus * 1.05
    # Every row lies where the plan puts its block, and slots count up from 0.
    again = sharding.assign(spark, laid(docs.repartition(7), old))[0]
    assert sorted(tuple(x) for x in out.select("doc_id", "shard", "slot").collect()) == sorted(tuple(x) for x in again.select("doc_id", "shard", "slot").collect())
    slots = {}
    for x in out.collect():
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [sum(x.b for x in got if x.shard == i) for i in range(16)] == plan.new_bytes


@pytest.mark.parametrize("capacities", [[9000, 1000], [2500] * 5, [10000, 10000, 10000]])
def test_more_and_fewer_new_shards(spark, capacities):
    docs = spark.createDataFrame([(i, "x" * 9) for i in range(1000)], "doc_id long, text string")
    out, plan = sharding.assign(spark, laid(docs, F.pmod("doc_id", F.lit(3)).cast("int")), capacities, blocks=500)
    got = {x.shard: x.b for x in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert sum(got.values()) == 10000 and all(got.get(i, 0) <= c + 200 for i, c in enumerate(capacities))
    best = 10000 - sum(map(min, plan.old_bytes, capacities))
    assert best <= plan.moved_bytes <= best + 200 * len(capacities)


def test_repeats_of_one_row_are_spread(spark):
    docs = spark.createDataFrame([(None, "same text")] * 3000 + [(i, "other") for i in range(500)], "doc_id long, text string")
    out, _ = sharding.assign(spark, laid(docs, F.lit(0)), n_shards=4)
    got = [x.b for x in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(got) == 4 and max(got) < 1.1 * min(got)


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    rows = [(i, "x" * 10, "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old = F.pmod("doc_id", F.lit(3)).cast("int")
    docs.withColumn("shard", old).write.partitionBy("shard").parquet(f"{tmp_path}/old")
    staged = docs.withColumn("id", F.col("doc_id"))
    out, plan = sharding.assign(spark, staged.withColumn("old_shard", old), [1100, 3300], blocks=100)
    assert plan.affected == {1, 2}
    whole = staged.join(out.select("id", "shard", "slot"), "id").drop("id")
    where = sharding.rewrite(spark, f"{tmp_path}/old", whole, plan, f"{tmp_path}/new")
    assert where == {0: f"{tmp_path}/old/shard=0", 1: f"{tmp_path}/new/shard=1"}
    got = spark.read.parquet(where[0]).select("doc_id", "text").unionByName(spark.read.parquet(where[1]).select("doc_id", "text"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in docs.select("doc_id", "text").collect())


# ---- mixing ----


def test_every_source_gets_its_target(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(0, 300)), r.choice(["a", "b", "b", "b", "é", None])) for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0]
    total = sum(len(t.split()) for _, t, _ in rows)
    got = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert abs(sum(x.target for x in got) - total) < 1e-6 * total
    assert all(abs(x.taken - x.target) <= 1 and x.target <= 3 * x["size"] for x in got)
    assert out.filter("taken > 3 * size").count() == 0


@pytest.mark.parametrize("sizes", [[33, 3000], [5, 5, 5], [1, 0, 100_000, 2], [64, 64]])
def test_small_sources_get_their_targets(spark, sizes):
    rows = [(10 * k + i, " ".join(["w"] * (n // 5 + (i < n % 5))), f"s{k}") for k, n in enumerate(sizes) for i in range(5)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0]
    got = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x.taken - x.target) <= 0.5 for x in got) and out.filter("taken > 3 * size").count() == 0


def test_a_hot_id_is_spread_and_summed_in_order(spark):
    docs = spark.createDataFrame([(None, "a b c", "s")] * 400 + [(i, "d e", "s") for i in range(100)], "doc_id long, text string, source string")
    got = sorted((r.start, r.size) for r in mixing.mix(docs)[0].collect())
    at = 0
    for start, size in got:
        assert start == at
        at += size


@given(st.lists(st.integers(0, 400), min_size=1, max_size=9))
@settings(max_examples=12, deadline=None)
def test_targets_fill_up_by_weight(spark, sizes):
    rows = [(f"s{k}", n) for k, n in enumerate(sizes)]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want, open_, left = {}, {f"s{k}": (k % 3 + 1, 3 * n) for k, n in enumerate(sizes)}, float(sum(sizes))
    while open_:
        each = left / sum(w for w, _ in open_.values())
        full = {s: cap for s, (w, cap) in open_.items() if cap <= w * each}
        if not full:
            want |= {s: w * each for s, (w, _) in open_.items()}
            break
        want |= full
        left -= sum(full.values())
        open_ = {s: x for s, x in open_.items() if s not in full}
    assert got == pytest.approx(want)


def test_stage_decides_row_by_row(spark):
    rows = [(None if i % 2 else 7, " ".join(["w"] * (i + 1)), f"s{i % 3}") for i in range(60)] + [(None, "twice the same", "s1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, _ = mixing.mix(docs)
    want = sorted((r.source, r.size) for r in taken.collect() for _ in range(int(r.taken / r.size + 0.5)))
    got = sorted((r.source, len(r.text.split())) for r in mixing.stage(spark, docs, "").collect())
    assert got == want and len({r.doc_id for r in taken.collect()}) == 2


def test_schedule_spreads_each_source(spark):
    rows = [("a", 32_000), ("b", 32_000), ("c", 32_000)]
    sources = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"))
    slots = [x.sid for x in mixing.schedule(spark, sources).orderBy("slot").collect()]
    assert len(slots) == 3000
    for start in range(0, 3000, 300):
        part = slots[start : start + 300]
        assert abs(part.count(1) - 50) <= 4 and abs(part.count(3) - 150) <= 4


# ---- line dedup ----


def plain_dedup(docs, min_docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, (doc, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("n_batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines_drop_as_in_the_plain_way(spark, n_batches, fanout):
    r = random.Random(6)
    pool = [("É" if i % 3 else "e") * 3 + f" Shared Line number {i} " + "x" * (14 + i % 12) for i in range(25)]
    docs = []
    for i in range(80):
        lines = [r.choice(["", "  ", "\t"]) + (x.upper().replace("É", "É") if r.random() < 0.3 else x) + r.choice(["", " \r"]) for x in r.choices(pool, k=r.randint(0, 6))]
        docs.append((i * 3 % 80, "\n".join(lines + [f"own {i}"] * r.randint(0, 2)) if i else None))
    out = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), n_batches, fanout)
    assert sorted(tuple(x) for x in out.collect()) == plain_dedup(docs)


def test_runs_are_levelled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(9 - k, 1, 1), (9 - k, 2, k)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(x) for x in runs.frequent(5).collect()] == [(1, 1, 9)]
    runs.close()


def test_runs_meet_without_a_shuffle(spark, tmp_path):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=4)
        batch = spark.range(1000).selectExpr("id AS doc_id", "id % 70 AS h1", "id % 30 AS h2")
        runs.add(batch)
        runs.add(batch)
        shuffles = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (runs.merged(runs.runs()), runs.marked(batch))]
        assert shuffles == [0, 1]  # a batch's own aggregation
        runs.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# ---- language ----


def plain_prediction(model, text):
    """The model's answer, n-gram by n-gram."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    padded, low = f" {text.lower()} ", (1 << 32) - 1
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            h = 0
            for k in range(n):
                h = (h ^ ord(padded[i + k])) * int(language.FACTORS[k]) & low
                h ^= h >> 15
            feature = (h * 0x27D4EB2F & low) >> 16
            counts[feature] = counts.get(feature, 0) + 1
    total = sum(counts.values())
    z = [float(b) for b in model.bias]
    for feature, n in counts.items():
        for k in range(len(z)):
            z[k] += n / total * language.SCALE * float(model.weights[feature, k])
    e = [math.exp((x - max(z)) / model.temperature) for x in z]
    best = e.index(max(e))
    return model.langs[best], e[best] / sum(e)


def test_scores_equal_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    texts = dict(tuple(r) for r in docs.select("doc_id", "text").collect())
    got = language.op1_ftrl_language(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain_prediction(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_training_equals_plain_ftrl():
    r = np.random.default_rng(5)
    rows = [(np.sort(r.choice(40, 8, replace=False)).astype(np.uint16), r.random(8), int(r.integers(3))) for _ in range(60)]
    z, n = {}, {}

    def weight(f, k):
        s = z.get((f, k), 0.0)
        return 0.0 if abs(s) <= language.L1 else -(s - math.copysign(language.L1, s)) / ((language.BETA + math.sqrt(n[f, k])) / language.ALPHA + language.L2)

    for epoch in range(language.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            cells = [*((int(f), float(v)) for f, v in zip(at, x, strict=True)), ("bias", 1.0)]
            score = [sum(v * weight(f, k) for f, v in cells) for k in range(3)]
            e = [math.exp(s - max(score)) for s in score]
            steps = [(f, k, v * (e[k] / sum(e) - (k == y)), weight(f, k)) for f, v in cells for k in range(3)]
            for f, k, g, w in steps:
                old = n.get((f, k), 0.0)
                n[f, k] = old + g * g
                z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(n[f, k]) - math.sqrt(old)) / language.ALPHA * w
    weights, bias = language.train_ftrl(rows, 3, np.ones(language.DIM))
    assert bias == pytest.approx([weight("bias", k) for k in range(3)])
    assert weights[:40] == pytest.approx(np.array([[weight(f, k) for k in range(3)] for f in range(40)]))
    assert (weights[:40] == 0).any() and not weights[40:].any()


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    out = language.predict(docs.withColumn("held_out", language.held_out(F.col("doc_id"))).withColumnRenamed("lang", "truth"), model)
    held = out.filter("held_out AND lang_pred <> 'und'")
    assert held.filter("truth = lang_pred").count() >= 0.97 * held.count() > 100
    assert (model.weights != 0).mean() < 0.5


def test_more_than_64_labels_are_all_learnt(spark):
    r = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    alphabets = {f"l{k:02}": r.sample(letters, 12) for k in range(90)}
    rows = [(f"{lang}", "".join(r.choice(own) for _ in range(60))) for k, (lang, own) in enumerate(alphabets.items()) for _ in range(12 if k else 1)]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(docs.withColumn("doc_id", F.lit(None).cast("long")))  # nothing held out
    assert model.langs == sorted(alphabets)
    fresh = [(lang, "".join(r.choice(own) for _ in range(80))) for lang, own in alphabets.items() for _ in range(3)]
    right = [model.predict(text)[0] == lang for lang, text in fresh]
    assert sum(right) > 0.95 * len(right)


def test_slices_hold_each_ngram_once(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(500))
    whole = np.sort(language.grams(language.codes(text)))
    monkeypatch.setattr(language, "SLICE", 64)
    assert np.array_equal(whole, np.sort(np.concatenate(list(language.gram_slices(text)))))


def test_temperature_calms_overconfidence():
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 4000)
    z = np.where((r.random(4000) < 0.8)[:, None], np.eye(2)[y], np.eye(2)[1 - y]) * 20
    p = language.softmax(z / language.fit_temperature(z, y)).max(axis=1)
    assert abs(p.mean() - 0.8) < 0.02


# ---- tokens ----


@given(st.text("ab \n'stlé1.,", max_size=60), st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), st.text("ab \n'tl1é", max_size=6)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_edited_counts_equal_counting_anew(text, edits):
    count = tokens.counter().__getitem__
    tree = tokens.Tree(text, count)
    for start, end, new in edits:
        a = min(max(0, start), len(text))
        b = min(max(a, end), len(text))
        text = text[:a] + new + text[b:]
        tree.edit(start, end, new)
        pieces = tokens.PIECES.findall(text)
        assert (tree.text, tree.pieces, tree.tokens) == (text, len(pieces), sum(map(count, pieces)))
        assert tree.tokens == tree.sums[1] and tree.chars[1] == len(text)


def test_kept_trees_are_edited_without_encoding_the_rest(spark, tmp_path):
    """A second run loads what the first one left."""
    text = "The quick brown fox jumps over it. " * 3000
    tokens.plant(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).write.parquet(f"{tmp_path}/trees0")
    count = tokens.counter().__getitem__
    for k in range(2):
        trees = spark.read.parquet(f"{tmp_path}/trees{k}")
        revised = tokens.revise(trees.withColumn("edits", tokens.sample_edits())).cache()
        got = {r.doc_id: r for r in revised.collect()}
        assert got[1].n_reencoded < 60 < got[1].n_pieces
        assert got[1].n_tokens_after == sum(map(count, tokens.PIECES.findall(got[1].text)))
        assert (got[2].n_tokens, got[2].n_tokens_after, got[2].text) == (0, 0, None)
        tokens.kept(revised).write.parquet(f"{tmp_path}/trees{k + 1}")


def test_a_kept_tree_encodes_only_what_an_edit_touches():
    count = tokens.counter().__getitem__
    text = "one two three, " * 500
    leaves = tokens.Tree(text, count).packed()
    asked = []
    tree = tokens.Tree(text, lambda piece: asked.append(piece) or count(piece), leaves)
    assert not asked and tree.tokens == sum(map(count, tokens.PIECES.findall(text)))
    tree.edit(3000, 3003, "four")
    assert 0 < len(asked) < 8 and tree.tokens == sum(map(count, tokens.PIECES.findall(tree.text)))


# ---- revisits ----


def record(i, url, ts, kind, digest=None, **headers):
    return (i, url, ts, kind, digest, {k.replace("_", "-"): v for k, v in headers.items()})


RECORD = "record_id long, url string, ts long, kind string, digest string, headers map<string,string>"


def test_revisits_find_the_latest_earlier_response(spark):
    rows = [
        record(1, "HTTP://Ex.com:80", 10, "response", "d1", ETag='"a"', Content_Length="5", Cache_Control="x"),
        record(2, "http://ex.com/#frag", 20, "response", "d2", ETag='W/"b"'),
        record(3, "http://ex.com/", 15, "revisit", None, ETag='W/"a"', Cache_Control="y", Content_Length="0"),
        record(4, "http://ex.com/", 20, "revisit", "d1"),
        record(5, "http://ex.com/", 99, "revisit", "d1"),
        record(6, "http://ex.com/", 5, "revisit", "d1"),
        record(7, "http://ex.com/?b=1&a=2", 50, "response", None, Last_Modified="m"),
        record(8, "http://ex.com/?a=2&b=1", 60, "revisit", None, Last_Modified="m"),
        record(9, None, 60, "revisit", "d1"),
        record(10, "http://ex.com/", None, "revisit", "d1"),
        record(11, "http://ex.com/?a=2&b=1", 61, "revisit"),
    ]
    for buckets in (1, 4, 256):
        got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, RECORD), buckets).collect()}
        assert {k: (r.response_id, r.validator, r.resolved) for k, r in got.items()} == {
            3: (1, "etag", True), 4: (1, "digest", True), 5: (2, "digest", False), 6: (None, "none", False), 8: (7, "last-modified", True),
            9: (None, "none", False), 10: (None, "none", False), 11: (7, "none", False),
        }
        assert got[3].headers == {"etag": 'W/"a"', "cache-control": "y", "content-length": "5"}


def test_resolution_equals_a_plain_scan(spark):
    r = random.Random(8)
    rows = [record(i, f"http://h/{min(r.randint(0, 30), 3)}", r.randint(0, 200), r.choice(["response", "revisit"]), r.choice("ab")) for i in range(400)]
    got = {x.record_id: (x.response_id, x.resolved) for x in revisits.resolve(spark.createDataFrame(rows, RECORD), 16).collect()}
    for i, url, ts, kind, digest, _ in rows:
        if kind == "revisit":
            earlier = [(t, j, d) for j, u, t, k, d, _ in rows if k == "response" and u == url and t < ts]
            want = (max(earlier)[1], max(earlier)[2] == digest) if earlier else (None, False)
            assert got[i] == want


# ---- tool calls ----

CALL = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULT = "conv_id long, call_id string, turn long, content string"


def test_long_chains_and_cycles_are_ordered_exactly(spark):
    chain = [(1, f"k{i:02}", i, [f"k{i + 1:02}"] if i < 69 else []) for i in range(70)]  # each call needs the next turn's
    cycle = [(2, "a", 0, ["c"]), (2, "b", 1, ["a"]), (2, "c", 2, ["b"]), (2, "behind", 1000, ["a"]), (2, "free", 3, []), (2, "self", 4, ["self"]), (2, "both", 1, ["free", "late"]), (2, "late", 9, [])]
    null = [(None, "x", 1, ["y"]), (None, "y", 1, []), (3, "p", 0, []), (3, "q", 1, ["p"])]
    rows = chain + cycle + null
    got = {(r.conv_id, r.call_id): r for r in tools.placed(spark, spark.createDataFrame(rows, "conv_id long, call_id string, turn int, depends_on array<string>")).collect()}
    assert [got[1, f"k{i:02}"].position for i in range(70)] == list(range(69, -1, -1)) and all(got[1, f"k{i:02}"].ordered for i in range(70))
    assert {c: got[2, c].ordered for _, c, _, _ in cycle} == {"a": False, "b": False, "c": False, "behind": False, "self": False, "free": True, "both": True, "late": True}
    assert [c for _, c in sorted((got[2, c].position, c) for _, c, _, _ in cycle)] == ["free", "late", "both", "a", "b", "c", "self", "behind"]
    assert got[None, "y"].position == 0 and got[None, "x"].position == 1 and got[3, "q"].position == 1


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [
        (1, "a", 3, "search", '{"turn":1,"query":"q"}', ["b"]),
        (1, "b", 5, "search", '{"query":"","turn":-1,"more":1}', ["c", "zz"]),
        (1, "c", 1, "nope", "[1]", []),
        (1, "d", 2, "search", '{"query":7,"turn":null}', None),
        (2, "a", 1, "search", "not json", ["b"]),
        (2, "b", 2, "search", '{"turn":2,"query":"x"}', ["a"]),
        (None, None, None, None, None, None),
    ]
    results = [(1, "a", 9, "late"), (1, "a", 4, "early"), (1, "x", 1, "stray"), (2, "b", 3, None)]
    got = {(r.conv_id, r.call_id): r for r in tools.format_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT)).collect()}
    assert len(got) == len(calls)
    assert {k: r.position for k, r in got.items() if k[0] == 1} == {(1, "c"): 0, (1, "d"): 1, (1, "b"): 2, (1, "a"): 3}
    assert got[1, "a"].n_results == 2 and json.loads(got[1, "a"].json) == {"arguments": {"query": "q", "turn": 1}, "call_id": "a", "errors": [], "name": "search", "result": "early"}
    assert got[1, "a"].json.startswith('{"arguments":{"query":"q","turn":1},"call_id"')
    assert list(got[1, "b"].errors) == ["unknown: more", "query: min_length 1", "turn: minimum 0", "unknown dependency: zz"]
    assert list(got[1, "c"].errors) == ["unknown tool", "arguments are no object"]
    assert list(got[1, "d"].errors) == ["query: not string", "turn: missing"]
    assert not got[2, "a"].ordered or not got[2, "b"].ordered


def test_times_far_apart_and_missing_urls_do_not_gather(spark):
    """One record at time 0 and the others close together; a third without URL."""
    rows = [record(1, "http://a/", 0, "response", "d0")]
    rows += [record(10 + i, "http://a/", 10**12 + i, "revisit" if i % 2 else "response", f"d{i // 2}") for i in range(200)]
    rows += [record(1000 + i, None, 10**12 + i, "revisit") for i in range(100)]
    found = revisits.as_of(spark.createDataFrame(rows, RECORD), 16)
    got = {r.record_id: r.found.record_id if r.found else None for r in found.collect()}
    assert got == {**{10 + i: 9 + i for i in range(1, 200, 2)}, **{1000 + i: None for i in range(100)}}
