"""Every training-data operator over empty tables, nulls, repeats, long texts and clashing column names."""

import pytest
from pyspark.sql import functions as F

from spindle.llm import decontaminate, jaccard, language, line_dedup, media, mixing, revisits, sharding, tokens, tools

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Alpha beta gamma delta epsilon. " * 6000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, "  \n\t \n", "en", None, 6),
    (4, "one two", "en", "s1", 7),
    (4, "one two", "en", "s1", 7),
    (None, "one two three four five six seven", "de", "s2", 33),
    (None, None, None, "s2", None),
    (7, LONG, "fr", "s2", len(LONG)),
    (8, LONG, "fr", "s1", len(LONG)),
    (9, "Ünïcödé \U0001f600 é \x00 zero", "de", "\U00010000", 20),
    (10, "1234 -- ++", "en", "￿", 10),
]
#: Names that the operators use inside.
CLASHING = (
    "size", "shard", "slot", "c", "n", "target", "sid", "_row", "_copies", "key", "items", "score", "lang_pred", "_text", "_id", "_old", "_bad", "_block", "_size", "_crc", "_key", "_n",
    "row", "id", "me", "bad", "kept", "block", "before", "_range", "_sum", "_earlier", "_own", "component_id", "text_key", "old_shard", "copies", "begin", "end", "words", "a.b",
)


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    rows = ROWS if request.param == "rows" else []
    out = spark.createDataFrame(rows, DOCS)
    return out.withColumns({c: F.lit("x") for c in CLASHING})


def write_tables(spark, tmp_path, docs_rows, benchmark=()):
    spark.createDataFrame(docs_rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_operators_keep_every_row(spark, docs):
    n = docs.count()
    assert media.media(docs).count() == n
    assert sharding.shards(docs).count() == n
    assert mixing.mix(docs)[0].count() == n
    assert line_dedup.dedup(docs).count() == n
    assert jaccard.clusters(docs).count() == n
    assert tokens.revise(tokens.plant(docs).withColumn("edits", tokens.sample_edits())).count() == n
    model = language.train(docs)
    assert language.predict(docs.select("doc_id", "text"), model).count() == n
    benchmark = spark.createDataFrame([(1, "alpha beta gamma"), (None, "one two"), (3, None), (4, "--")], "item_id long, text string")
    assert decontaminate.verdicts(decontaminate.scan(docs, benchmark)).count() == n


def test_empty_benchmark_leaves_documents_clean(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.verdicts(decontaminate.scan(docs, none))
    assert out.filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_keep_the_columns_and_their_values(spark, tmp_path, rows):
    sf_dir = write_tables(spark, tmp_path, rows, [(1, "alpha beta")])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("null"))) for c in CLASHING})
    whole = {tuple(r) for r in docs.collect()}
    for k, stage in enumerate((language.stage, jaccard.stage, decontaminate.stage, mixing.stage)):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/out{k}")
        out = spark.read.parquet(f"{tmp_path}/out{k}")
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= whole
        assert not rows or out.count()
    sharding.stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/last")
    last = spark.read.parquet(f"{tmp_path}/last")
    others = [c for c in docs.columns if c not in ("shard", "slot")]
    assert last.columns == [*others, "shard", "slot"] and last.count() == len(rows)
    quoted = [f"`{c}`" for c in others]
    assert {tuple(r) for r in last.select(quoted).collect()} == {tuple(r) for r in docs.select(quoted).collect()}


def test_mixing_values_of_the_edges(spark):
    got = {(r.doc_id, r.size): r for r in mixing.mix(spark.createDataFrame(ROWS, DOCS))[0].collect()}
    assert got[1, 0].taken == 0 and got[2, 0].taken == 0
    assert got[7, 30000].source_size == 30007 and got[8, 30000].source_size == 30004


def test_sharding_values_of_the_edges(spark):
    got = sharding.shards(spark.createDataFrame(ROWS, DOCS)).collect()
    null = [r for r in got if r.doc_id == 1][0]
    assert (null["size"], null.text_crc32, null.law, null.grown_shard) == (1, 0, "bytes", None)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs.select("doc_id", "text"), language.train(docs)).collect()]
    assert (1, "und", 0.0) in got and (3, "und", 0.0) in got and (10, "und", 0.0) in got
    assert all(0 <= s <= 1 for _, _, s in got)


def test_empty_records_and_calls(spark):
    records = spark.createDataFrame([], "record_id long, url string, ts long, kind string, digest string, headers map<string,string>, extra int")
    assert revisits.resolve(records).count() == 0
    calls = spark.createDataFrame([], "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, rank int")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string, result int")
    assert tools.format_calls(calls, results).count() == 0
