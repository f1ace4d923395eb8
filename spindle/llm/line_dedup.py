"""Line dedup by levelled sorted runs of line hashes.

The index is a set of runs: tables of (h1, h2, n_docs, keeper, fresh), dealt by
hash into buckets and sorted in them. A batch of documents is aggregated to one
row a key, merged with each run in turn, and written as a run of level 0: keys
that no run has yet (an anti-join's rows) are fresh and carry their keeper, the
largest ``doc_id`` of the batch that holds them; known keys add their count alone. ``FANOUT`` runs of one level are compacted to
one run of the next, so a key is rewritten a logarithmic number of times.

Batches go by descending ``doc_id``: the batch in which a key is fresh then
holds the largest ``doc_id`` of all, whatever comes later.

A key is known by two 64-bit hashes. Work is by key and document; a key in a
third of all documents is pre-aggregated before its counts are shuffled.

Defined cases: null and empty texts are one empty line; a line shorter than
``MIN_CHARS`` after stripping is never dropped; a line that a document repeats
counts once for that document and all its repeats go or stay together; rows of
equal ``doc_id`` count as documents each, and all of them are the keeper if one
is; a null ``doc_id`` is smaller than any other; an empty table gives an empty
result. Other columns are unused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, cut, discard, scratch, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower(line: Column) -> Column:
    """A-Z lower-cased; the quick way where a line is ASCII and both ways agree."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(ascii_lower(line))


def hashes_of(lines: Column) -> Column:
    """For each line two hashes of it stripped and lower-cased, or null if it is too short to be a key.

    Steps are arrays, one made of the other, so that each line is worked on once.
    """
    stripped = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))
    keys = F.transform(stripped, lambda x: F.when(F.length(x) >= MIN_CHARS, lower(x)))
    return F.transform(keys, lambda k: F.when(k.isNotNull(), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))


def keys_of(docs: DataFrame) -> DataFrame:
    """doc_id, t, h1, h2: a row for each distinct key of each row of ``docs``; t names the text."""
    keys = F.array_distinct(F.array_compact(hashes_of(lines_of(F.col("text")))))
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.explode(keys).alias("k")).select("doc_id", "t", "k.h1", "k.h2")


class LineRuns:
    """The runs by level, in a shared folder.

    All runs are dealt alike, by hash of the key to ``spark.sql.shuffle.partitions``
    buckets of one sorted file each. A batch is aggregated into the same deal, so it
    meets the runs, and runs meet each other, bucket by bucket without a shuffle.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or scratch(spark, "lines"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"lines_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, keys: DataFrame) -> None:
        """One batch's keys (doc_id, h1, h2; a row for each document and key)."""
        self._write(self.marked(keys), 0)
        self.compact()

    def marked(self, keys: DataFrame) -> DataFrame:
        """The run of a batch: its keys once, fresh unless a run has them."""
        own = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).withColumn("fresh", F.lit(True))
        for name in self.runs():
            known = self.spark.table(name).filter("fresh").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
            own = own.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").withColumn("fresh", F.col("fresh") & F.col("k1").isNull()).drop("k1", "k2")
        return own.withColumn("keeper", F.when(F.col("fresh"), F.col("keeper")))

    def compact(self) -> None:
        """Merge a level's runs into one of the next level wherever a level is full."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level], []
                self._write(self.merged(merged), level + 1)
                self._drop(merged)
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        """One row a key; of its runs only the one where it was fresh has a keeper."""
        first, *others = (self.spark.table(n) for n in names)
        for other in others:
            pair = first.alias("x").join(other.alias("y"), ["h1", "h2"], "full_outer")
            total = F.coalesce("x.n_docs", F.lit(0)) + F.coalesce("y.n_docs", F.lit(0))
            fresh = F.coalesce("x.fresh", F.lit(False)) | F.coalesce("y.fresh", F.lit(False))
            first = pair.select("h1", "h2", total.alias("n_docs"), F.coalesce("x.keeper", "y.keeper").alias("keeper"), fresh.alias("fresh"))
        return first

    def _drop(self, names: list[str]) -> None:
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """h1, h2, keeper of the keys in at least ``min_docs`` documents."""
        return self.merged(self.runs()).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def batches(keys: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """``keys`` by descending ranges of ``doc_id``, nulls in the last; every row is in one."""
    at = keys.select(F.percentile_approx("doc_id", [k / n for k in range(n - 1, 0, -1)], 10_000)).head()[0] or []
    bounds = list(dict.fromkeys(at))
    c, out, above = F.col("doc_id"), [], None
    for b in bounds:
        out.append(keys.filter(c > b if above is None else (c > b) & (c <= above)))
        above = b
    return [*out, keys if above is None else keys.filter(c.isNull() | (c <= above))]


def dedup(docs: DataFrame, n_batches: int = BATCHES, fanout: int = FANOUT, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text without the dropped lines."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = cut(spark, keys_of(docs), "keys")
    runs = LineRuns(spark, fanout=fanout)
    try:
        for batch in batches(keys, n_batches):
            runs.add(batch)
        # Plainly written: a join with raw keys must be free to split those of a common line.
        frequent = cut(spark, runs.frequent(min_docs), "frequent")
    finally:
        runs.close()
    # Which documents lose which keys; rows of one id and text have one list, no longer than their lines.
    lost = keys.join(frequent, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("h1", "h2")).alias("_lost"))
    rows = docs.join(lost, docs["doc_id"].eqNullSafe(lost["_id"]) & (F.xxhash64(docs["text"]) == lost["_t"]), "left").withColumn("_lines", lines_of(F.col("text")))
    zipped = F.arrays_zip(F.col("_lines").alias("line"), hashes_of(F.col("_lines")).alias("h"))
    stays = F.filter(zipped, lambda z: ~F.coalesce(F.array_contains(F.col("_lost"), z["h"]), F.lit(False)))
    kept = F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(F.transform(stays, lambda z: z["line"]))
    rows = rows.withColumn("_kept", kept)
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))


def op8_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, len(x) AS n_lines, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5),
judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
