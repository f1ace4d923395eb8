"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule has the golden-ratio point ``k * 2654435769 mod 2**32``;
the source whose interval of cumulative weights holds the point serves the
slot. Slots of a source are ranked in order of k, and rank r takes block
``r mod n_blocks`` of that source: its documents in a shuffled order (by MD5 of
``doc_id``) are one stream of words, cut into blocks of ``BLOCK_WORDS``. So any
stretch of slots holds each source in about its share.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, ...; they
share the corpus' words, none gets more than ``MAX_PASSES`` times its own, and
what is cut off is shared anew by weight. With sources sorted by cap over
weight, prefix sums give the level directly.

Each source takes its target rounded to a word, and its interval is as wide as
the slots that this needs, the last of which takes only the words still missing
from its block. Points that fall to a source that has all its slots serve none;
the few slots that points leave a source short of follow at the end.

No group is handled whole: streams are summed by ranges of rows, slots by chunks
of numbers, and only the sums of these are added up in order, so a source with a
third of all rows, or an id that a third of all rows share, is spread.

Defined cases: null or wordless text has size 0 and takes 0; null source is a
source of its own; a source without words has target 0; rows of equal
``doc_id`` are ordered by size, and rows equal in both are interchangeable;
null ``doc_id`` sorts first; an empty table gives an empty result; other
columns are unused, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, numbered, release, running, table

BLOCK_WORDS = 32
MAX_PASSES = 3
GOLDEN = 2654435769
POINTS = 1 << 32
SLOT_CHUNK = 1 << 16
#: Cells of the unit interval, by which points meet the sources' intervals.
CELLS = 4096


def n_words(text: Column) -> Column:
    """Runs of anything but blanks and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, sid, source_size, weight, target, the words to take (quota), its slots, and the interval [low, high) of points.

    sizes: a row for each source. Windows without partition run over these
    rows alone.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumn("weight", (F.pmod(F.col("_rank") - 1, F.lit(3)) + 1).cast("long"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = ranked.withColumn("_cap", MAX_PASSES * F.col("source_size")).withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = capped.withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0))).withColumn("_used", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    # A source is full if its cap is below its part of what those before it leave.
    full = F.col("_cap") * (F.col("_weights") - F.col("_used")) <= F.col("weight") * (F.col("_all") - F.col("_full"))
    level = level.withColumn("_is_full", full)
    level = level.withColumn("_rest", F.col("_all") - F.sum(F.when(F.col("_is_full"), F.col("_cap")).otherwise(0)).over(everything))
    level = level.withColumn("_open", F.sum(F.when(F.col("_is_full"), 0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("_is_full"), F.col("_cap").cast("double")).otherwise((F.col("weight") * F.col("_rest")).cast("double") / F.col("_open"))
    level = level.withColumn("target", target)
    level = level.withColumn("quota", F.coalesce(F.round("target"), F.lit(0)).cast("long"))
    n_blocks, words = F.ceil(F.col("source_size") / block_words), F.greatest("source_size", F.lit(1))
    level = level.withColumn("slots", (F.floor(F.col("quota") / words) * n_blocks + F.ceil(F.pmod("quota", words) / block_words)).cast("long"))
    upto = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    level = level.withColumn("high", F.floor(F.sum("slots").over(upto) / F.greatest(F.sum("slots").over(everything), F.lit(1)) * POINTS))
    level = level.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("_rank")), F.lit(0).cast("long")))
    return level.select("source", F.col("_rank").alias("sid"), "source_size", "weight", "target", "quota", "slots", "low", "high")


def schedule(spark: SparkSession, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, sid, rank, block, words: which block of which source each slot takes, and how many of its words.

    Each source has exactly its number of slots; points beyond that serve none.
    """
    n_slots = sources.agg(F.sum("slots")).head()[0] or 0
    slots = spark.range(n_slots).withColumnRenamed("id", "slot")
    point = (F.col("slot").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(GOLDEN)).bitwiseAND(F.lit(POINTS - 1))
    width = POINTS // CELLS
    slots = slots.withColumn("_point", point).withColumn("_cell", F.floor(F.col("_point") / width))
    spread = sources.filter("high > low").select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("_cell"))
    served = slots.join(spread, (slots["_cell"] == spread["_cell"]) & (F.col("_point") >= F.col("low")) & (F.col("_point") < F.col("high"))).select("slot", "sid").withColumn("_chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    served = cut(spark, served, "slots")
    per_chunk = served.groupBy("sid", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("sid", "_chunk").orderBy("slot")) - 1
    ranked = served.withColumn("_inside", inside).join(per_chunk.select("sid", "_chunk", before.alias("_before")), ["sid", "_chunk"]).select("slot", "sid", (F.col("_before") + F.col("_inside")).alias("rank"))
    # What points leave a source short of: some slots a source, whatever its size.
    found = sources.join(per_chunk.groupBy("sid").agg(F.sum("_n").alias("_n")), "sid", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter("_n < slots")
    late = found.select("sid", F.explode(F.sequence("_n", F.col("slots") - 1)).alias("rank"))
    late = late.select((F.row_number().over(Window.orderBy("rank", "sid")) - 1 + n_slots).cast("long").alias("slot"), "sid", "rank")
    every = ranked.unionByName(late).join(sources.select("sid", "source_size", "quota", "slots"), "sid").filter("rank < slots")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    every = every.withColumn("block", F.pmod("rank", n_blocks)).withColumn("_pass", F.floor(F.col("rank") / n_blocks))
    left = F.col("quota") - F.col("_pass") * F.col("source_size") - F.col("block") * block_words
    whole = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return every.select("slot", "sid", "rank", "block", F.least(whole, left).alias("words"))


def streams(spark: SparkSession, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row (doc_id, source, size) with its place [start, start + size) in its source's shuffled stream."""
    named = sources.select(F.col("source").alias("_name"), "sid", "source_size", "target")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    rows = rows.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    return running(spark, rows, ["sid"], ["_hash", "doc_id", "size", "_row"], "size", "streams").withColumnRenamed("before", "start").drop("_hash")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and block that it reaches into: where in the block it begins and ends."""
    end = F.col("start") + F.col("size")
    each = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    base = F.col("block") * block_words
    return each.withColumn("begin", F.greatest(F.col("start") - base, F.lit(0))).withColumn("end", F.least(end - base, F.lit(block_words)))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, *carried: str) -> tuple[DataFrame, DataFrame]:
    """(a row for each document with what the mix takes of it and the carried columns, the schedule)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), *carried)
    rows = cut(spark, rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    sources = cut(spark, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), block_words), "targets")
    slots = schedule(spark, sources, block_words)
    takes = slots.groupBy("sid", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    placed = streams(spark, rows, sources)
    discard(rows)
    each = pieces(placed, block_words).join(takes, ["sid", "block"])
    served = F.greatest(F.least("end", "words") - F.col("begin"), F.lit(0)) * F.col("times")
    taken = each.groupBy("_row").agg(F.sum(served).alias("taken"))
    return placed.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source", "start", "_row", *carried), slots


def op3_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes half of it or more, none, once or more.

    A document is whole or absent: ``taken / size`` is rounded to whole copies.
    Documents without words have no part in a mix by words and stay once. Each row
    has its own decision, also if ``doc_id`` is null or repeated.
    """
    release(spark)
    staged = numbered(spark, docs, "mixed")
    rows, _ = mix(staged.select("id", "row.doc_id", "row.source", "row.text"), BLOCK_WORDS, "id")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    counts = rows.select("id", copies.alias("copies")).filter("copies > 0")
    return staged.join(counts, "id").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
names AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM sized GROUP BY source),
weighed AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS words, sum((sid - 1) % 3 + 1) OVER () AS weights FROM names),
ratio AS (
  SELECT *, coalesce(sum(cap) OVER r, 0) AS taken_up, coalesce(sum(weight) OVER r, 0) AS used FROM weighed
  WINDOW r AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * (weights - used) <= weight * (words - taken_up) AS is_full FROM ratio),
level AS (
  SELECT *, words - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open FROM marked),
aimed AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / open END AS target FROM level),
sources AS (SELECT *, round(target)::BIGINT AS quota FROM aimed),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.quota,
    sum(d.size) OVER (PARTITION BY s.sid ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (quota // greatest(source_size, 1) * size + least(greatest(quota % greatest(source_size, 1) - start, 0), size))::BIGINT AS taken
FROM placed
"""
