"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document's set is its distinct five-word shingles, each a 64-bit hash made of
its words' hashes. Documents with equal sets form a class, known by the 128-bit
digest of the set, and only classes are joined. A class goes by the digest's
first half; of classes that clash there all but one get another name, by a list
that is expected to be empty below 1e9 classes and a dozen long at 2e10.

1. Every class names the least shingles of its set as its prefix: the smallest
   number that any set with Jaccard similarity 3/4 must share one of. The order
   is by hash, with shingles that many documents share put last; any common
   order is right, this one keeps common passages out of the tiles. A shingle's
   rank in the set bounds what can follow it, and drops rows of a tile early.
2. A tile is the classes that name one shingle, sorted by set size. Sets of
   which the smaller has less than 3/4 of the larger's size are never compared.
3. Each class has a bitmap that holds the parity of its hashes by position; the
   bits in which two bitmaps differ are at most the shingles in which the sets
   differ, so they bound the overlap from above. Bitmaps grow with the size band
   (one to two bits a shingle); the wider is folded onto the narrower.
4. What the bound leaves is decided by intersecting the sorted arrays.

Copies in a tile are not expanded into pairs, and no step writes more rows than
the tiles have. First each class is decided against two others: of those that
stand before it in a tile, and of those that lead one, the one it meets most
often. The links found are contracted to components. Then, in tiles that still
hold several components, each class is decided against the one of another
component whose bitmap is nearest, and links are contracted again. What is left
is decided inside the tiles: the rows that still have a partner of another
component get their arrays, and a tile (or two of its blocks) returns a spanning
forest of its similar pairs. A tile of more than ``BLOCK`` rows is dealt by hash:
blocks of its largest component meet the other rows' blocks and not each other.
The links of this way are enough to connect what is similar, and no more.

``join(docs, every=True)`` is the whole join: no contraction, every tile compared
in full, so the links are all similar pairs of classes and ``degrees`` counts
each document's similar documents. Its work grows with the number of those pairs,
the square of a group's size; op10 needs components alone and contracts.

Defined cases: a text of one to four words has its whole word sequence as the
only shingle; texts without words and null texts have an empty set, link with
nothing and are their own component; rows are documents, also if ``doc_id`` is
null or repeated (a component's id is its least non-null ``doc_id``); an empty
table gives an empty result; other columns are unused.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACED_BYTES, cut, discard, release, run_hashes, table, tidy
from .graph import components

SHINGLE = 5
#: Rows of a tile that one task compares with each other or with as many others.
BLOCK = 1024
#: Shingles that are put last in the order: at most so many (16 MB broadcast).
MOST_COMMON = 1 << 21
#: A shingle is common if it is in more than one of so many documents that a task sees together.
COMMON_SHARE = 512
SEEN = 1 << 18
#: Of a class's tiles that are compared in full, so many tell where a pair meets first.
FIRSTS = 8
#: Classes whose arrays are wanted are found by a bit set of 64 bits each, at most 2**27 (16 MB broadcast).
WANTED_BITS = 27


def distinct(h: np.ndarray) -> np.ndarray:
    """Ascending; sorting is quicker here than hashing."""
    h = np.sort(h)
    return h if len(h) < 2 else h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingles(texts) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    return map(distinct, run_hashes(texts, SPACED_BYTES, SHINGLE))


def strings(column: pa.Array) -> Iterator[str | None]:
    return (x.as_py() for x in column)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two numbers for a set."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes(), len(s)))


def first_mask(bits: int) -> int:
    """What of a class's first number counts; all of it but in tests of clashes."""
    return -1 if bits == 64 else (1 << bits) - 1


class Names(dict):
    """The name of a class by its two numbers: the first, but for those listed here."""

    def __missing__(self, key: tuple[int, int]) -> int:
        return key[0]

    def column(self, c: Column, c2: Column) -> Column:
        out = c
        for (first, second), name in self.items():
            out = F.when((c == first) & (c2 == second), F.lit(name)).otherwise(out)
        return out


def names_of(pairs: DataFrame) -> Names:
    """pairs: c, c2 of the classes. Where several have one first number, all but the least second get another."""
    clash = pairs.groupBy("c").agg(F.min("c2").alias("least"), F.max("c2").alias("most")).filter("least <> most")
    rows = pairs.join(clash, "c").filter("c2 <> least").select("c", "c2").distinct().collect()
    return Names({(r.c, r.c2): struct.unpack("<q", xxhash.xxh3_64_digest(struct.pack("<qq", r.c, r.c2)))[0] for r in rows})


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the hashes at each of 64 to 32,768 positions, one to two a shingle."""
    width = min(max(6, int(len(s) - 1).bit_length()), 15)
    n = np.bincount((s >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(n.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(m: np.ndarray) -> np.ndarray:
    """Bitmaps (a row each) of half the width: neighbouring bits added, as their hashes' prefixes are shorter by one."""
    x = m ^ (m >> np.uint64(1))
    x &= np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x[..., 0::2] | (x[..., 1::2] << np.uint64(32))


def prefix_size(n: int) -> int:
    """A set of n shares at least ceil(3n/4) with any similar one, so one of its first n - that + 1."""
    return n - -(-3 * n // 4) + 1


def similar(a: int, b: int, both: int) -> bool:
    return 100 * both >= 75 * (a + b - both)


# ---- reading the documents ----

SETS = "kind byte, doc_id long, text_key long, n long, c long, c2 long, bitmap binary"
SETS_ARROW = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("bitmap", pa.binary())])


class Once(set):
    """Classes that this task has met; forgets all when it holds SEEN."""

    def new(self, c) -> bool:
        if c in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(c)
        return True


def sets(source: DataFrame, first_bits: int = 64) -> DataFrame:
    """kind 0: each document's class and, once a task, its bitmap. kind 1: common shingles (c) with counts (n).

    first_bits: how much of a class's first number is used (fewer for tests).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, held, size, mask = Once(), [], 0, first_mask(first_bits)
        for batch in batches:
            ns, cs, c2s, maps = [], [], [], []
            for s in shingles(strings(batch.column(1))):
                c, c2 = class_of(s)
                c &= mask
                ns.append(len(s))
                cs.append(c)
                c2s.append(c2)
                maps.append(bitmap(s).tobytes() if len(s) and once.new(c2) else None)
                if maps[-1]:
                    held.append(s)
                    size += len(s)
                    if size > 2_000_000:
                        yield _common(held)
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int8)), batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.array(c2s, pa.int64()), pa.array(maps, pa.binary())], schema=SETS_ARROW)
        if held:
            yield _common(held)

    return source.mapInArrow(tidy(run), SETS)


def _common(held: list[np.ndarray]) -> pa.RecordBatch:
    every = np.sort(np.concatenate(held))
    turns = np.concatenate([np.flatnonzero(np.diff(every)) + 1, [len(every)]])
    at, n = every[turns - 1], np.diff(turns, prepend=0)
    many = n > max(3, len(held) // COMMON_SHARE)
    at, n = at[many].view(np.int64), n[many]
    none = pa.nulls(len(at), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), none, none, pa.array(n, pa.int64()), pa.array(at, pa.int64()), none, none.cast(pa.string()).cast(pa.binary())], schema=SETS_ARROW)


PREFIX = pa.schema([("c", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])


@dataclass
class Source:
    """The documents (doc_id, text, text_key) and how their classes are named."""

    rows: DataFrame
    names: Names
    first_bits: int = 64

    def namer(self) -> Callable[[np.ndarray], int]:
        """Gives a set's class its name, in workers."""
        names, mask = self.names, first_mask(self.first_bits)

        def name(s: np.ndarray) -> int:
            c, c2 = class_of(s)
            return names[c & mask, c2]

        return name


def prefixes(source: Source, common) -> DataFrame:
    """tok, c, place: the prefix of each class, at least once for each class.

    place is twice the set's size, and one more if the shingle stands behind the set's first seventh.

    common: broadcast ascending array of the shingles that come last.
    """
    name = source.namer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, last = Once(), common.value
        for batch in batches:
            cs, ns, out = [], [], []
            for s in shingles(strings(batch.column(1))):
                if len(s) and once.new(c := name(s)):
                    k = prefix_size(len(s))
                    if len(last):
                        at = np.searchsorted(last, s).clip(0, len(last) - 1)
                        late = last[at] == s
                        head = s[~late][:k]
                        head = np.concatenate([head, s[late][: k - len(head)]]) if len(head) < k else head
                    else:
                        head = s[:k]
                    cs.append(c)
                    ns.append(len(s))
                    out.append(head.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ns, pa.int64()), pa.array(out, pa.list_(pa.int64()))], schema=PREFIX)

    lists = source.rows.mapInArrow(tidy(run), "c long, n long, prefix array<long>")
    each = lists.select("c", "n", F.posexplode("prefix").alias("pos", "tok"))
    return each.selectExpr("tok", "c", "2 * n + int(7 * pos > n) AS place")


def arrays(source: Source, wanted) -> DataFrame:
    """c, items: the sorted arrays of the texts whose key a broadcast packed bit set has (it may let others by)."""
    name = source.namer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, bits = Once(), wanted.value
        for batch in batches:
            keys = batch.column(2).to_numpy() & (32 * len(bits) - 1)
            hit = np.flatnonzero(bits[keys >> 5] >> (keys & 31).astype(np.uint32) & np.uint32(1))
            cs, out = [], []
            for s in shingles(batch.column(1)[i].as_py() for i in hit):
                if len(s) and once.new(c := name(s)):
                    cs.append(c)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(out, pa.binary())], names=["c", "items"])

    return source.rows.mapInArrow(tidy(run), "c long, items binary")


def wanted_bits(keys: DataFrame) -> np.ndarray:
    """The bit set of the text keys: 64 bits or more each, up to 2**WANTED_BITS; more keys let more others by."""
    bits = min(WANTED_BITS, max(12, keys.count().bit_length() + 6))
    k = F.col("text_key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(k.alias("k")).selectExpr("shiftright(k, 5) AS w", "shiftleft(1L, int(k & 31)) AS b")
    out = np.zeros(1 << (bits - 5), np.uint32)
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).astype(np.uint32)
    return out


# ---- comparing ----


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which bitmaps differ, row by row, broadcast."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def may_be(apart: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be similar: 7 times the differing bits at most both sizes."""
    return (7 * apart <= nx + ny) & (4 * np.minimum(nx, ny) >= 3 * np.maximum(nx, ny))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, xa, xb) that their bitmaps do not rule out."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy() for k in (2, 3))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (4, 5))
            while len(x) > len(y):
                x = fold(x)
            while len(y) > len(x):
                y = fold(y)
            keep[i] = may_be(differing(x, y), na[i], nb[i])
        yield batch.select([0, 1]).filter(pa.array(keep))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    return int((y[at.clip(0, len(y) - 1)] == x).sum())


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, xa, xb) whose arrays are similar, with their similarity."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
            both = overlap(x, y)
            if similar(len(x), len(y), both):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), both / (len(x) + len(y) - both)))
        yield _links(rows)


def _links(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])


class Tile:
    """Rows of one tile, or of two of its blocks."""

    def __init__(self, rows: pa.Table):
        self.tok, self.one, self.two = (rows.column(k)[0].as_py() for k in range(3))
        self.block, self.c, self.n, self.comp = (rows.column(k).to_numpy() for k in range(3, 7))
        self.maps = rows.column(7).to_pylist()
        self.firsts = np.full((rows.num_rows, FIRSTS), self.tok, np.int64)
        for i, firsts in enumerate(rows.column(8).to_pylist() if rows.num_columns > 8 else ()):
            self.firsts[i, : len(firsts)] = firsts
        self.items = rows.column(9).to_pylist() if rows.num_columns > 9 else None

    def pairs(self, everywhere: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows p, q and their differing bits: pairs of other components each that the bounds leave, a part at a time.

        Pairs that meet in an earlier tile are left to that one, unless ``everywhere``.
        """
        width = np.array([len(m) for m in self.maps])
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            x = self._bits(mine)
            for v in (w, 2 * w):
                theirs = np.flatnonzero(width == v)
                if not len(theirs):
                    continue
                y = x if v == w else fold(self._bits(theirs))
                step = max(1, (1 << 20) // y.size)
                for s in range(0, len(mine), step):
                    i = mine[s : s + step]
                    apart = differing(x[s : s + step][:, None], y[None])
                    ok = (self.comp[i][:, None] != self.comp[theirs]) & may_be(apart, self.n[i][:, None], self.n[theirs][None])
                    if v == w:
                        ok &= i[:, None] < theirs
                    if self.one != self.two:
                        ok &= self.block[i][:, None] != self.block[theirs]
                    p, q = np.nonzero(ok)
                    p, q, d = i[p], theirs[q], apart[p, q]
                    if len(p):
                        yield (p, q, d) if everywhere else self._first_met(p, q, d)

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self.maps[i] for i in rows), np.uint64).reshape(len(rows), -1)

    def _first_met(self, p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        met = np.zeros(len(p), bool)
        for s in range(0, len(p), 1 << 16):
            i, j = p[s : s + (1 << 16)], q[s : s + (1 << 16)]
            met[s : s + (1 << 16)] = ((self.firsts[i][:, :, None] == self.firsts[j][:, None, :]) & (self.firsts[i] < self.tok)[:, :, None]).any(axis=(1, 2))
        return p[~met], q[~met], apart[~met]

    def all_pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.minimum(self.c[p], self.c[q]), np.maximum(self.c[p], self.c[q])) for p, q, _ in self.pairs()]

    def nearest(self) -> tuple[np.ndarray, ...]:
        """tok, c, n, o, apart of each row that has a pair: the row of another component with the fewest differing bits, and these."""
        best = np.full(len(self.c), 1 << 40, np.int64)
        other = np.zeros(len(self.c), np.int64)
        for p, q, apart in self.pairs(everywhere=True):
            for i, j in ((p, q), (q, p)):
                order = np.lexsort((self.c[j], apart, i))
                i, j, d = i[order], j[order], apart[order]
                first = np.diff(i, prepend=-1) != 0
                i, j, d = i[first], j[first], d[first]
                less = (d < best[i]) | ((d == best[i]) & (self.c[j] < self.c[other[i]]))
                best[i[less]], other[i[less]] = d[less], j[less]
        has = best < 1 << 40
        return np.full(int(has.sum()), self.tok), self.c[has], self.n[has], self.c[other[has]], best[has]

    def open_rows(self) -> np.ndarray:
        """Classes that have a pair here."""
        out = np.zeros(len(self.c), bool)
        for p, q, _ in self.pairs():
            out[p] = out[q] = True
        return out

    def forest(self) -> list[tuple[int, int, float]]:
        """Similar pairs that connect the tile's components as far as any similar pairs do: fewer than its rows."""
        up = {x: x for x in self.comp.tolist()}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out, comp = [], self.comp.tolist()
        for p, q, apart in self.pairs():
            order = np.argsort(apart, kind="stable")
            for i, j in zip(p[order].tolist(), q[order].tolist(), strict=True):
                a, b = root(comp[i]), root(comp[j])
                if a != b:
                    x, y = (np.frombuffer(self.items[k], np.uint64) for k in (i, j))
                    both = overlap(x, y)
                    if similar(len(x), len(y), both):
                        up[a] = b
                        out.append((int(self.c[i]), int(self.c[j]), both / (len(x) + len(y) - both)))
        return out


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """The tables of rows that agree in the first three columns, by which they are sorted; those of a batch together."""

    def split(t: pa.Table) -> list[pa.Table]:
        key = [t.column(k).to_numpy() for k in range(3)]
        turns = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in key])) + 1
        return [t.slice(s, e - s) for s, e in zip([0, *turns.tolist()], [*turns.tolist(), t.num_rows], strict=True)]

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if t.num_rows:
            *done, rest = split(t)
            yield done
    if rest is not None:
        yield [rest]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tok, one, two, block, c, n, comp, bitmap, firsts): surviving pairs (a, b) of each tile."""
    for tables in by_tile(batches):
        for t in tables:
            found = Tile(t).all_pairs() if t.num_rows > 1 else []
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, without ``firsts``: those that have a pair in their tile, with the nearest."""
    for tables in by_tile(batches):
        found = [Tile(t).nearest() for t in tables if t.num_rows > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["tok", "c", "n", "o", "apart"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows: those that have a pair in their tile, without bitmap."""
    for tables in by_tile(batches):
        for t in tables:
            if t.num_rows > 1 and (has := Tile(t).open_rows()).any():
                yield from t.select([0, 1, 2, 3, 4, 5, 6]).filter(pa.array(has)).combine_chunks().to_batches()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with arrays: the links (a, b, similarity) of each tile's forest."""
    for tables in by_tile(batches):
        for t in tables:
            if t.num_rows > 1:
                yield _links(Tile(t).forest())


# ---- the join ----


@dataclass
class Join:
    """documents: doc_id, text_key, n, c. links: a, b (classes), similarity; enough of them to
    connect all that is similar, or all there are. classes: c, rep, component (least doc_id) and
    group (the component's number, never null)."""

    documents: DataFrame
    links: DataFrame
    classes: DataFrame


def join(docs: DataFrame, block: int = BLOCK, every: bool = False, first_bits: int = 64) -> Join:
    """every: all links and not only enough of them to connect."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    found = cut(spark, sets(rows, first_bits), "sets")
    reps = found.filter("kind = 0 AND n > 0").groupBy("c", "c2").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.max("bitmap").alias("bitmap"))
    reps = cut(spark, reps, "classes")
    names = names_of(reps)
    name = names.column(F.col("c"), F.col("c2"))
    documents = found.filter("kind = 0").select("doc_id", "text_key", "n", name.alias("c"))
    reps = reps.withColumn("c", name).drop("c2")
    source = Source(rows, names, first_bits)
    counts = found.filter("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(MOST_COMMON)
    common = np.sort(counts.select("c").toPandas()["c"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(common)
    tiles = _tile_rows(spark, prefixes(source, shared))
    shared.destroy()
    release(spark)
    links, found = _every(spark, source, tiles, reps, block) if every else _connecting(spark, source, tiles, reps, block)
    release(spark)
    named = reps.join(found.withColumnRenamed("node", "c"), "c", "left").select("c", "rep", F.coalesce("component", "c").alias("_comp"))
    least = named.groupBy("_comp").agg(F.min("rep").alias("component"))
    return Join(documents, links, named.join(least, "_comp").select("c", "rep", "component", F.col("_comp").alias("group")))


def _connecting(spark: SparkSession, source: Source, tiles: DataFrame, reps: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Links that connect all that is similar, and the components."""
    # Each class with the one that most often stands before it in a tile, and with the one that most often leads.
    each = tiles.select("c", "n", F.posexplode(F.array("before", "least")).alias("k", "o")).filter("o.c <> c AND 4 * least(n, o.n) >= 3 * greatest(n, o.n)")
    often = each.groupBy("c", "k", "o.c").agg(F.count(F.lit(1)).alias("times")).toDF("c", "k", "o", "times")
    met = often.groupBy("c", "k").agg(F.max(F.struct("times", "o")).alias("m")).select(F.least("c", "m.o").alias("a"), F.greatest("c", "m.o").alias("b")).distinct()
    met = cut(spark, met, "met")
    links = _verify(source, cut(spark, _bound(met, reps), "bounded"), reps)
    found = components(spark, links)
    held = cut(spark, _mixed(tiles, found, block), "mixed")
    discard(tiles)
    release(spark)
    near = cut(spark, _dealt(held, reps, firsts=False).mapInArrow(tidy(_nearest), "tok long, c long, n long, o long, apart long"), "nearest")
    discard(held)
    best = near.groupBy("c").agg(F.min(F.struct("apart", "o")).alias("m")).select(F.least("c", "m.o").alias("a"), F.greatest("c", "m.o").alias("b")).distinct()
    late = _verify(source, cut(spark, best.join(met, ["a", "b"], "left_anti"), "best"), reps)
    if not late.isEmpty():
        links = links.unionByName(late)
        found = components(spark, links)
    # Bitmaps and components leave a row without a partner in its tile once and for all.
    held = cut(spark, _mixed(near.select("tok", "c", "n").distinct(), found, block), "mixed")
    discard(near)
    left = cut(spark, _dealt(held, reps).mapInArrow(tidy(_open), "tok long, one long, two long, block long, c long, n long, comp long"), "open")
    discard(held)
    with _items(source, left.select("c").distinct(), reps) as items:
        if items is not None:
            late = cut(spark, _dealt(left, reps, items).mapInArrow(tidy(_forests), LINKS), "links")
            if not late.isEmpty():
                links = links.unionByName(late)
                found = components(spark, links)
    return links, found


def _every(spark: SparkSession, source: Source, tiles: DataFrame, reps: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """All links, and the components. As long as each class is its own component, no tile and no pair is left out."""
    alone = reps.select(F.col("c").alias("node"), F.col("c").alias("component"))
    held = cut(spark, _mixed(tiles, alone, block), "every")
    discard(tiles)
    pairs = cut(spark, _dealt(held, reps).mapInArrow(tidy(_tiles), "a long, b long").distinct(), "pairs")
    discard(held)
    links = _verify(source, pairs, reps)
    return links, components(spark, links)


def degrees(found: Join) -> DataFrame:
    """doc_id, text_key, n_links of every row: how many other rows are similar to it, equal sets included. Needs all links."""
    rows = found.documents.filter("n > 0").groupBy("c").agg(F.count(F.lit(1)).alias("rows"))
    both = found.links.select(F.col("a").alias("of"), F.col("b").alias("c")).unionByName(found.links.select(F.col("b").alias("of"), F.col("a").alias("c")))
    others = both.join(rows, "c").groupBy(F.col("of").alias("c")).agg(F.sum("rows").alias("others"))
    totals = rows.join(others, "c", "left").select("c", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return found.documents.join(totals, "c", "left").select("doc_id", "text_key", F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).alias("n_links"))


def _mixed(tiles: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """tok, one, two, block, c, n, comp: rows of the tiles that hold several components.

    A tile of at most ``block`` rows is its own block 0. The rows of a larger one
    are dealt by hash: those of its largest component to some blocks, all others
    to blocks before these. Each pair of blocks (one, two), but two of the largest
    component, has the rows of both.
    """
    rows = tiles.select("tok", "c", "n").join(found.withColumnRenamed("node", "c"), "c", "left").select("tok", "c", "n", F.coalesce("component", "c").alias("comp"))
    sizes = rows.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("tok").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("rows"), F.count(F.lit(1)).alias("comps"))
    sizes = sizes.filter("comps > 1").select("tok", "rows", F.col("top.comp").alias("hot"), F.col("top.k").alias("most"))
    split = F.col("rows") > block
    blocks = lambda n: F.ceil(n / block).cast("long")
    sizes = sizes.withColumn("others", F.when(split, blocks(F.col("rows") - F.col("most"))).otherwise(F.lit(1)).cast("long"))
    sizes = sizes.withColumn("hots", F.when(split, blocks(F.col("most"))).otherwise(F.lit(0)).cast("long"))
    is_hot = (F.col("hots") > 0) & (F.col("comp") == F.col("hot"))
    dealt = F.when(is_hot, F.col("others") + F.pmod(F.xxhash64("c"), F.greatest("hots", F.lit(1)))).otherwise(F.pmod(F.xxhash64("c"), F.col("others")))
    ranked = rows.join(sizes, "tok").withColumn("block", dealt)
    last = F.when(is_hot, F.col("others") - 1).otherwise(F.col("others") + F.col("hots") - 1)
    each = ranked.select("tok", "c", "n", "comp", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    return each.select("tok", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "c", "n", "comp")


def _dealt(held: DataFrame, reps: DataFrame, items: DataFrame | None = None, firsts: bool = True) -> DataFrame:
    """The rows of ``_mixed`` with bitmaps and perhaps first tiles and arrays, each tile's together."""
    signed, more = reps.select("c", "bitmap"), ["bitmap"]
    if firsts:
        signed, more = signed.join(held.groupBy("c").agg(F.slice(F.array_sort(F.collect_set("tok")), 1, FIRSTS).alias("firsts")), "c"), [*more, "firsts"]
    if items is not None:
        signed, more = signed.join(items, "c"), [*more, "items"]
    rows = held.join(signed, "c").select("tok", "one", "two", "block", "c", "n", "comp", *more)
    return rows.repartition("tok", "one", "two").sortWithinPartitions("tok", "one", "two")


def _tile_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """tok, c, n, before, least of the rows that may have a similar one in their tile.

    Where a pair's first common shingle stands, the smaller set has ranked at
    most a seventh of itself; a row stays if it is such a one and the next set
    is not too large, or if there is such a one before it that is not too small.
    """
    by_size = Window.partitionBy("tok").orderBy("place", "c")
    rows = rows.withColumn("n", F.shiftright("place", 1))
    early = F.col("place") == 2 * F.col("n")
    smaller = F.max(F.when(early, F.col("n"))).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    larger = F.lead("n").over(by_size)
    kept = rows.withColumn("_smaller", smaller).withColumn("_larger", larger).filter((4 * F.col("_smaller") >= 3 * F.col("n")) | (early & (3 * F.col("_larger") <= 4 * F.col("n"))))
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("c", "n")
    out = kept.withColumn("before", F.lag(me).over(by_size)).withColumn("least", F.min(me).over(whole)).withColumn("_most", F.max("c").over(whole))
    return cut(spark, out.filter("least.c <> _most").select("tok", "c", "n", "before", "least"), "tiles")


def _bound(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    x = reps.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("xa"))
    y = reps.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("xb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(tidy(_bounded), "a long, b long")


LINKS = "a long, b long, similarity double"


@contextmanager
def _items(source: Source, ends: DataFrame, reps: DataFrame) -> Iterator[DataFrame | None]:
    """c, items: the arrays of the classes ``ends`` (c, a row each), or None without any. Of each one text is read again."""
    spark = source.rows.sparkSession
    bits = wanted_bits(reps.join(ends, "c", "left_semi"))
    if not bits.any():
        yield None
        return
    shared = spark.sparkContext.broadcast(bits)
    items = cut(spark, arrays(source, shared).join(ends, "c", "left_semi").groupBy("c").agg(F.first("items").alias("items")), "arrays")
    shared.destroy()
    yield items
    discard(items)


def _verify(source: Source, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that are similar in truth."""
    spark = source.rows.sparkSession
    with _items(source, pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), reps) as items:
        if items is None:
            return spark.createDataFrame([], LINKS)
        x = items.select(F.col("c").alias("a"), F.col("items").alias("xa"))
        y = items.select(F.col("c").alias("b"), F.col("items").alias("xb"))
        return cut(spark, pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(tidy(_exact), LINKS), "links")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id, component_id, group (null for empty sets) of every row."""
    found = join(docs)
    out = found.documents.join(found.classes, "c", "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "group")


def op10_banded_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the least id stays.

    A null id is larger than any other; of rows with one id the least text hash
    stays. Rows equal in ``doc_id`` and text stay once, those without words too.
    """
    empty = F.when(F.col("n_shingles") == 0, F.struct("doc_id", "text_key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m")
    kept = clusters(docs).groupBy("group", empty.alias("empty")).agg(least).select("m.doc_id", "m.text_key")
    kept = kept.select(F.struct("doc_id", "text_key").alias("kept"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row.text").alias("text_key")))
    return rows.join(kept, F.col("key").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["key"]).select("row.*")


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM worded, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ t JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * t.n >= 75 * (p.n + q.n - t.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
