"""Benchmark decontamination: a distributed positional inverted index.

The training documents are cut into index shards of about ``SHARD_WORDS``
words. A stored row of the index holds one shard: its documents with their
lengths, and for every term of theirs the ascending list of positions
(delta-coded, compressed). A term is known by two independent 64-bit hashes of
its word, so the index answers any phrase, whatever benchmark is asked. A phrase
is looked up shard by shard: its rarest term (by count over the whole corpus)
gives the candidate starts, and the other terms' lists, shifted by their offsets
in the phrase, thin them out from the rarest to the commonest until none or
exact matches are left. With ``slop`` above 0 each term may stand that far from
its place: proximity matches.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, as many as
it needs; one block at a time is on the driver and broadcast, and what it hits
is written before the next. Nothing is shuffled but the counts of the block's
terms (found by a bit set of fixed size) and the hits.

Defined cases: null or wordless text has no words and is never contaminated;
a benchmark item without words has no window; a null ``item_id`` counts as the
empty string; items with equal id are one item; a repeated or null ``doc_id``
is judged row by row; an empty benchmark leaves every document clean and an
empty corpus gives an empty result. Other columns are unused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIRST, SECOND, WORD_BYTES, cut, discard, run_hashes, table, tidy

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_BYTES = 16_000_000
VOCABULARY_BITS = 24

INDEX = "shard string, doc_ids array<long>, keys array<long>, lens array<int>, terms array<long>, checks array<long>, counts array<int>, postings binary"
INDEX_ARROW = pa.schema([("shard", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
HITS = "shard string, place int, spans array<int>, items array<string>"
HITS_ARROW = pa.schema([("shard", pa.string()), ("place", pa.int32()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def hashed_words(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the two hashes of its lower-cased words: runs of ASCII letters and digits and of characters beyond ASCII."""
    texts = list(texts)
    return zip(run_hashes(texts, WORD_BYTES, 1, FIRST), run_hashes(texts, WORD_BYTES, 1, SECOND), strict=True)


class Phrases:
    """Distinct windows of one block of the benchmark, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        found: dict[tuple, set] = {}
        for (item, _), (h, check) in zip(items, hashed_words(t for _, t in items), strict=True):
            both = list(zip(h.tolist(), check.tolist(), strict=True))
            for start in range(max(1, len(both) - size + 1) if both else 0):
                found.setdefault(tuple(both[start : start + size]), set()).add(item)
        self.names = sorted({x for s in found.values() for x in s})
        at = {x: i for i, x in enumerate(self.names)}
        self.lens = np.array([len(w) for w in found], np.int64)
        self.terms, self.checks = np.zeros((2, len(found), size), np.uint64)
        for k, w in enumerate(found):
            self.terms[k, : len(w)], self.checks[k, : len(w)] = zip(*w, strict=True)
        self.item_of = [np.array(sorted(at[x] for x in s), np.int64) for s in found.values()]
        self.order = np.tile(np.arange(size), (len(found), 1))

    def vocabulary(self) -> np.ndarray:
        used = np.arange(self.terms.shape[1]) < self.lens[:, None]
        return np.unique(self.terms[used])

    def rarest_first(self, terms: np.ndarray, counts: np.ndarray) -> None:
        """terms, ascending, with their counts over the corpus; other terms occur nowhere."""
        if not len(self.lens):
            return
        at = np.searchsorted(terms, self.terms).clip(0, max(0, len(terms) - 1))
        known = terms[at] == self.terms if len(terms) else np.zeros(self.terms.shape, bool)
        n = np.where(known, counts[at] if len(terms) else 0, 0).astype(np.float64)
        n[np.arange(self.terms.shape[1]) >= self.lens[:, None]] = np.inf
        self.order = np.argsort(n, axis=1, kind="stable")


def bit_set(hashes: np.ndarray) -> np.ndarray:
    """A set of hashes as 2**VOCABULARY_BITS flags, packed."""
    flags = np.zeros(1 << VOCABULARY_BITS, bool)
    flags[(hashes >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)] = True
    return np.packbits(flags)


def in_set(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit set has them; it may say so of others."""
    k = (hashes >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)
    return (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)


def pack_postings(hashes: np.ndarray, checks: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Terms by hash and check, how many positions each has, and the positions by term as packed deltas."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():  # words that share the first hash alone
        order = np.lexsort((positions, checks, hashes))
        h, c = hashes[order], checks[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
    delta = np.diff(positions[order], prepend=0)
    delta[first] = positions[order][first]
    planes = delta.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    return h[first], c[first], np.diff(first, append=len(h)), zstandard.compress(planes.tobytes(), 1)


def unpack_postings(counts: np.ndarray, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions by term, and the offset at which each term's begin (one more at the end)."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    total = np.cumsum(planes.T.copy().view("<u4").ravel().astype(np.int64))
    before = np.concatenate([[0], total])[ends[:-1]]
    return total - np.repeat(before, counts), ends


def build_index(docs: DataFrame, shard_words: int = SHARD_WORDS, key: Column | None = None) -> DataFrame:
    """The index of ``docs`` (doc_id, text), which may carry a key: all words of all texts."""
    key = F.lit(None) if key is None else key

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            lens = np.array([len(h) for h, _ in held], np.int64)
            hashes, checks = (np.concatenate([x[k] for x in held]) for k in range(2))
            # One position stays free behind each document, so that no phrase runs into the next.
            at = np.arange(len(hashes)) + np.repeat(np.arange(len(lens)), lens)
            terms, checks, counts, blob = pack_postings(hashes, checks, at)
            row = ([uuid.uuid4().hex], [ids], [keys], [lens], [terms.view(np.int64)], [checks.view(np.int64)], [counts], [blob])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, INDEX_ARROW, strict=True)], schema=INDEX_ARROW)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, key, found in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), hashed_words(t.as_py() for t in part.column(1)), strict=True):
                    ids.append(doc_id)
                    keys.append(key)
                    held.append(found)
                    total += len(found[0]) + 1
                    if total >= shard_words:
                        yield shard()
                        ids, keys, held, total = [], [], [], 0
        if ids:
            yield shard()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.cast("long").alias("key"))
    return source.mapInArrow(tidy(build), INDEX)


def near(starts: np.ndarray, places: np.ndarray, offset: int, slop: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a position of the list is within ``slop`` of start + offset and in the start's document [begin, end)."""
    if not len(starts) or not len(places):
        return np.zeros(len(starts), bool)
    low = np.searchsorted(places, np.maximum(starts + offset - slop, begin))
    hit = places[low.clip(0, len(places) - 1)]
    return (low < len(places)) & (hit <= starts + offset + slop) & (hit < end)


def places_of(phrases: Phrases, terms: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where each term of each phrase stands among a shard's terms, or -1."""
    at = np.searchsorted(terms, phrases.terms)
    while True:
        here = at.clip(0, len(terms) - 1)
        same = (at < len(terms)) & (terms[here] == phrases.terms)
        other = same & (checks[here] != phrases.checks)
        if not other.any():
            return np.where(same, at, -1)
        at = at + other


def lookup(phrases: Phrases, terms: np.ndarray, checks: np.ndarray, places: np.ndarray, ends: np.ndarray, base: np.ndarray, lens: np.ndarray, slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, starts, documents) of each window that one shard's lists match; a proximity match may start before its document."""
    if not len(terms) or not len(phrases.lens):
        return
    at = places_of(phrases, terms, checks)
    used = np.arange(phrases.terms.shape[1]) < phrases.lens[:, None]
    there = ((at >= 0) | ~used).all(axis=1)
    for w in np.flatnonzero(there):
        order = phrases.order[w][: phrases.lens[w]]
        first = order[0]
        starts = places[ends[at[w, first]] : ends[at[w, first] + 1]] - first
        doc = np.searchsorted(base, starts + first, side="right") - 1
        for k in order[1:]:
            ok = near(starts, places[ends[at[w, k]] : ends[at[w, k] + 1]], k, slop, base[doc], base[doc] + lens[doc])
            starts, doc = starts[ok], doc[ok]
            if not len(starts):
                break
        if len(starts):
            yield int(w), starts, doc


def search(index: DataFrame, block, slop: int = 0) -> DataFrame:
    """The documents that one block of phrases hits: spans (start, end, start, ...: word positions) and items.

    block: broadcast ``Phrases``. A span of a proximity match has the window's length, cut to the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                lens, terms, checks, counts = (np.array(batch.column(k)[r].values) for k in range(1, 5))
                yield one(block.value, batch.column(0)[r].as_py(), lens, terms.view(np.uint64), checks.view(np.uint64), counts, batch.column(5)[r].as_py())

    def one(phrases: Phrases, shard: str, lens: np.ndarray, terms: np.ndarray, checks: np.ndarray, counts: np.ndarray, blob: bytes) -> pa.RecordBatch:
        base = np.concatenate([[0], np.cumsum(lens.astype(np.int64) + 1)])
        places, ends = unpack_postings(counts, blob)
        edge, pairs = np.zeros(base[-1] + 1, np.int64), []
        for w, starts, doc in lookup(phrases, terms, checks, places, ends, base, lens, slop):
            np.add.at(edge, np.maximum(starts, base[doc]), 1)
            np.add.at(edge, np.minimum(starts + int(phrases.lens[w]), base[doc] + lens[doc]), -1)
            for item in phrases.item_of[w]:
                pairs.append(np.unique(doc) * (1 << 32) + item)
        inside = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        span_doc = np.searchsorted(base, turns[::2], side="right") - 1
        spans: dict[int, list[int]] = {}
        for d, a, b in zip(span_doc.tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            spans.setdefault(d, []).extend((a - int(base[d]), b - int(base[d])))
        items: dict[int, list[str]] = {}
        for key in np.unique(np.concatenate(pairs)).tolist() if pairs else ():
            items.setdefault(key >> 32, []).append(phrases.names[key & 0xFFFFFFFF])
        hit = sorted(spans)
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array([spans[d] for d in hit], pa.list_(pa.int32())), pa.array([items[d] for d in hit], pa.list_(pa.string()))], schema=HITS_ARROW)

    return index.select("shard", "lens", "terms", "checks", "counts", "postings").mapInArrow(tidy(run), HITS)


def term_counts(index: DataFrame, bits) -> DataFrame:
    """term, n: how often the terms of a broadcast bit set (and some others) occur in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                terms = np.array(batch.column(0)[r].values)
                asked = in_set(terms.view(np.uint64), bits.value)
                yield pa.RecordBatch.from_arrays([pa.array(terms[asked]), pa.array(np.array(batch.column(1)[r].values)[asked], pa.int64())], names=["term", "n"])

    return index.select("terms", "counts").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, size: int = WINDOW) -> Iterator[Phrases]:
    """The benchmark's windows, block by block; each block is collected alone."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Phrases([(r.item_id, r.text) for r in block.collect()], size)


def merged(spans: list[int]) -> list[int]:
    """Spans (start, end, start, ...) in any order as ascending ones that do not touch."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.set_column(2, "spans", pa.array([merged(x) for x in batch.column(2).to_pylist()], pa.list_(pa.int32())))


def scan(docs: DataFrame, benchmark: DataFrame, slop: int = 0, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, size: int = WINDOW, key: Column | None = None) -> DataFrame:
    """Per row of ``docs``: its key, n_words, the spans that benchmark windows cover, the items found."""
    spark = docs.sparkSession
    index = cut(spark, build_index(docs, shard_words, key), "postings")
    found = spark.createDataFrame([], HITS)
    for phrases in benchmark_blocks(benchmark, block_bytes, size):
        found = found.unionByName(_hits(spark, index, phrases, slop))
    both = found.groupBy("shard", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "keys", "lens")).alias("place", "doc")).select("shard", "place", "doc.doc_ids", "doc.keys", F.col("doc.lens").cast("long").alias("n_words"))
    each = cut(spark, each, "lengths")
    discard(index)
    rows = each.join(both.mapInArrow(tidy(_merged), HITS), ["shard", "place"], "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
    return rows.select(F.col("doc_ids").alias("doc_id"), F.col("keys").alias("key"), "n_words", none(F.col("spans"), "int").alias("spans"), none(F.col("items"), "string").alias("items"))


def _hits(spark: SparkSession, index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    """What one block of the benchmark hits, written."""
    vocabulary = phrases.vocabulary()
    bits = spark.sparkContext.broadcast(bit_set(vocabulary))
    asked = spark.createDataFrame([(int(x),) for x in vocabulary.view(np.int64)], "term long")
    got = {int(t) & 0xFFFFFFFFFFFFFFFF: n for t, n in term_counts(index, bits).join(asked, "term", "left_semi").collect()}
    phrases.rarest_first(vocabulary, np.array([got.get(int(x), 0) for x in vocabulary], np.int64))
    shared = spark.sparkContext.broadcast(phrases)
    out = cut(spark, search(index, shared, slop), "hits")
    bits.destroy()
    shared.destroy()
    return out


def verdicts(hits: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``'s rows, and the spans and items themselves."""
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x).cast("long")
    out = hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans", "items", "key",
    )


def op4_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return verdicts(hits).drop("spans", "items", "key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a twentieth or more of their words inside benchmark windows go."""
    judged = verdicts(scan(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), key=_text_key(F.col("text"))))
    bad = judged.filter("contaminated").select(F.struct("doc_id", "key").alias("bad")).distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumn("me", F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), _text_key(F.col("row.text")).alias("key")))
    return rows.join(bad, F.col("me").eqNullSafe(F.col("bad")), "left_anti").select("row.*")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


SQL = r"""
WITH item_words AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, least(n, 13) AS size, array_to_string(w[i : i + least(n, 13) - 1], ' ') AS phrase
  FROM item_words, unnest(range(1, greatest(n - 13, 0) + 2)) AS t(i)),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
starts AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM doc_words, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - size + 2)) AS t(i)),
found AS (SELECT doc_id, item, i, size FROM starts JOIN windows USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc_words d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""
