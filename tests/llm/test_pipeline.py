import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_decontaminate import brute as hits_of
from test_jaccard import brute as components_of
from test_others import plain_prediction

from spindle.llm import decontaminate, jaccard, language
from spindle.llm.common import table
from spindle.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
    single = seen["n-gram Jaccard join"]
    groups = jaccard.clusters(single).filter("n_shingles > 0")
    assert groups.groupBy("component_id").count().filter("count > 1").count() == 0
    clean = decontaminate.verdicts(decontaminate.scan(seen["benchmark decontamination"], table(spark, SF, "benchmark")))
    assert clean.filter("contaminated").count() == 0
    last = seen["sharding"]
    assert last.groupBy("shard").agg((F.max("slot") - F.count("slot")).alias("d")).filter("d <> -1").count() == 0
    assert last.count() == seen["mixing sources to target weights"].count()


def test_language_stage_hands_each_text_over_once(spark):
    docs = table(spark, SF, "documents").select("lang", F.lit("x").alias("lang_pred"), "text", "doc_id")
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows * 6, docs.schema).coalesce(1)  # more rows than go back at once
    out = language.stage(spark, docs, SF)
    handed = re.findall(r"MapInArrow \w+\(([^)]*)\)", out._jdf.queryExecution().optimizedPlan().toString())
    assert [re.sub(r"#\d+", "", x) for x in handed] == ["row"]
    model = language.train(docs.select("doc_id", "text", "lang"))
    wanted = [r for r in rows if (p := plain_prediction(model, r[2]))[0] != "und" and p[1] >= language.MIN_SCORE] * 6
    assert len(wanted) > language.SENT and Counter(tuple(r) for r in out.collect()) == Counter(wanted) and out.columns == docs.columns


def test_language_stage_reads_texts_of_other_types(spark):
    rows = [(k, t.encode(), "aa" if k % 2 else "bb") for k, t in enumerate(["lorem ipsum dolor", "zwölf boxkämpfer jagen"] * 8)]
    docs = spark.createDataFrame([*rows, (99, None, "aa")], "doc_id long, text binary, lang string")
    model = language.train(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    wanted = {k for k, t, _ in rows if model.predict(t.decode())[1] >= language.MIN_SCORE}
    assert {r.doc_id for r in language.stage(spark, docs.withColumn("text", F.col("text").cast("binary")), SF).collect()} == wanted


def test_one_of_each_group_stays_whatever_its_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree"
    near = text + " more"
    rows = [(None, text, 1), (7, near, 2), (7, text, 3), (None, "p " + near, 4), (None, "a b c", 5), (None, "a b c", 6), (None, None, 7), (None, "", 8), (None, None, 9)]
    lone = [(None, text.upper().replace("E", "x"), 10), (None, near.upper().replace("E", "x"), 11)]
    docs = spark.createDataFrame(rows + lone, "doc_id long, text string, k int")
    kept = sorted(r.k for r in jaccard.stage(spark, docs, SF).collect())
    assert sum(k in (2, 3) for k in kept) == 1 and sum(k in (10, 11) for k in kept) == 1
    assert sum(k in (5, 6) for k in kept) == 1 and sum(k in (7, 9) for k in kept) == 1 and 8 in kept and not {1, 4} & set(kept)


def plain_copies(rows):
    """How often each (doc_id, text, source) stays in the mix; doc_ids are unique."""
    sizes = {d: len((t or "").split()) for d, t, _ in rows}
    by_source = defaultdict(list)
    for d, _, s in rows:
        by_source[s].append(d)
    names = sorted(by_source, key=lambda s: (s is None, s))
    total = {s: sum(sizes[d] for d in by_source[s]) for s in names}
    open_, left, target = {s: k % 3 + 1 for k, s in enumerate(names)}, float(sum(total.values())), {}
    while open_:
        each = left / sum(open_.values())
        full = [s for s, w in open_.items() if 3 * total[s] <= w * each]
        for s in full or list(open_):
            target[s] = 3 * total[s] if full else open_[s] * each
            left -= target[s]
            del open_[s]
    out = {}
    for s in names:
        start, quota = 0, int(target[s] + 0.5)
        for d in sorted(by_source[s], key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)):
            passes, rest = divmod(quota, max(total[s], 1))
            taken = passes * sizes[d] + min(max(rest - start, 0), sizes[d])
            out[d] = int(taken / sizes[d] + 0.5) if sizes[d] else 1
            start += sizes[d]
    return out


def test_run_equals_the_plain_way(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    model = language.train(table(spark, SF, "documents").select("doc_id", "text", "lang"))
    rows = [r for r in rows if (p := plain_prediction(model, r[1]))[0] != "und" and p[1] >= language.MIN_SCORE]
    heads = {d for d, _, component in components_of([r[:2] for r in rows]) if d == component}
    rows = [r for r in rows if r[0] in heads]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {d for d, n, hit, _ in hits_of([r[:2] for r in rows], items, 13) if not (hit and 20 * hit >= n)}
    rows = [r for r in rows if r[0] in clean]
    copies = plain_copies(rows)
    wanted = Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
    got = corpus_pipeline.run(spark, SF).select("doc_id", "text", "source", "shard", "slot").collect()
    assert Counter(tuple(r)[:3] for r in got) == wanted
    slots, size = defaultdict(list), np.zeros(16, int)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += len((r.text or "").encode()) + 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    # Shards are level to within the largest document, which no plan can split.
    assert size.max() - size.min() <= max(len((r.text or "").encode()) + 1 for r in got)


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(SQL) < set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
