"""Media columns: content-defined payload chunking.

A payload is cut where a rolling gear hash of its last 32 bytes has its top
bits zero; equal passages of some length therefore give equal chunks wherever
they stand. Chunks carry SHA-256 digests. A Spark aggregation over digests
finds the chunks that several documents share; each of those is stored once,
under its digest, and documents hold ordered chunk lists that point at it.
Chunks that no other document has stay packed with their document's list, so
the bulk of the bytes is written once and never shuffled. ``media_bytes`` and
``media_sha256`` describe the canonical export form of a payload (its chunk list
with all chunk bodies), made of what was read back, not of a stored object. Reading back joins
the shared chunks to the lists, puts each payload together in order and checks
every digest; a chunk that is missing or altered raises ``ValueError``.

The list of shared digests goes to the executors as a broadcast array only if
it has at most ``SHARED_LIMIT`` entries; beyond that the same marks reach the
documents through a shuffled join on the row's key. Both ways give one result.

Defined cases: null text is the empty text; an empty text is padded to one
frame of 192 blanks; repeated rows and null or repeated ``doc_id`` are kept
row by row (rows with equal ``doc_id`` and text share all chunks); an empty
table gives an empty result; columns besides ``doc_id`` and ``text`` are unused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

FRAME = 192
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 8192, 10
#: 24 bytes of digest and owner a shared chunk: 72 MB at most.
SHARED_LIMIT = 3_000_000
#: A chunk that more than one of so many references means is hot, and dealt to so many tasks.
HOT_SHARE, HOT_PARTS = 1000, 64
MAGIC = b"CDC1"

STORED = "kind byte, row_key binary, doc_id long, n_bytes long, refs array<struct<digest: binary, len: int, own: boolean>>, body binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gear_table() -> np.ndarray:
    """256 pseudo-random 32-bit numbers, by a splitmix step a byte value."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j in 0..31, modulo 2**32.

    Doubling: a sum over 2k bytes is one over k bytes plus the one k bytes
    earlier, shifted by k.
    """
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            earlier = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += earlier
    return h


def cuts(payload: bytes) -> list[int]:
    """End offsets of the chunks: at least MIN_CHUNK and at most MAX_CHUNK bytes, but for the last."""
    h = gear_hashes(np.frombuffer(payload, np.uint8))
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, start, size = [], 0, len(payload)
    for at in marks:
        while at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if at - start >= MIN_CHUNK:
            start = at
            ends.append(start)
    while size - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if start < size:
        ends.append(size)
    return ends


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the text's own length in bytes."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    full = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw + b" " * (full - len(raw)), len(raw)


def chunked(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, chunk) in order."""
    out, start = [], 0
    for end in cuts(payload):
        piece = payload[start:end]
        out.append((hashlib.sha256(piece).digest(), piece))
        start = end
    return out


def container(payload: bytes, refs: list[tuple[bytes, int]]) -> bytes:
    """The stored form of one payload: magic, chunk list, chunks as 8-bit samples."""
    head = MAGIC + struct.pack("<I", len(refs)) + b"".join(struct.pack("<I", n) + d for d, n in refs)
    return head + payload


def feature(payload: bytes, n_chunks: int) -> str:
    """Of the samples read back: chunks, mean, energy and sign changes about the middle, in integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    turns = int(np.count_nonzero(np.diff((x >= 96).astype(np.int8))))
    return f"chunks={n_chunks};mean_milli={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};turns={turns}"


def described(doc_id, n_bytes: int, payload: bytes, refs: list[tuple[bytes, int]]) -> tuple:
    media = container(payload, refs)
    return (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, len(refs)))


def row_key(doc_id, payload: bytes) -> bytes:
    """Names a row by id and content: rows that share it are copies in full."""
    return hashlib.blake2b(payload, digest_size=16, key=b"" if doc_id is None else struct.pack("<q", doc_id)).digest()


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


LISTED = pa.schema([("name", pa.binary()), ("owner", pa.int64())])
STORED_ARROW = pa.schema([
    ("kind", pa.int8()), ("row_key", pa.binary()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
    ("refs", pa.list_(pa.struct([("digest", pa.binary()), ("len", pa.int32()), ("own", pa.bool_())]))), ("body", pa.binary()),
])
RESULT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def _name(digest: bytes) -> bytes:
    """What a chunk is found by among the shared ones: 128 bits of its digest."""
    return digest[:16]


def _owner(key: bytes) -> int:
    """A row by 64 bits: rows that clash would each store what they share, and the copies go when read."""
    return int.from_bytes(key[:8], "little", signed=True)


def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, owner) of every distinct chunk of every row."""
    for batch in batches:
        name, owner = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            payload, _ = payload_of(text.as_py())
            found = {_name(d) for d, _ in chunked(payload)}
            name.extend(found)
            owner.extend([_owner(row_key(doc_id, payload))] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(owner, pa.int64())], schema=LISTED)


def _stored_rows(doc_id, text, owner_of) -> Iterator[tuple]:
    """The list of one row with its own chunks, and the shared chunks that it owns."""
    payload, n = payload_of(text)
    key = row_key(doc_id, payload)
    me, refs, body, given = _owner(key), [], [], set()
    for digest, piece in chunked(payload):
        owner = owner_of(_name(digest))
        refs.append({"digest": digest, "len": len(piece), "own": owner is None})
        if owner is None:
            body.append(piece)
        elif owner == me and digest not in given:
            given.add(digest)
            yield (1, digest, None, None, None, zstandard.compress(piece, 3))
    yield (0, key, doc_id, n, refs, zstandard.compress(b"".join(body), 3))


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5]) + 100
        if size > 8_000_000:
            yield _batches(held, STORED_ARROW)
            held, size = [], 0
    if held:
        yield _batches(held, STORED_ARROW)


def store(docs: DataFrame, shared_limit: int = SHARED_LIMIT) -> DataFrame:
    """The store of all rows' payloads: kind 0 are chunk lists, kind 1 shared chunks, each once."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = docs.mapInArrow(list_chunks, "name binary, owner long")
    shared = listed.groupBy("name").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("_n"))
    shared = cut(spark, shared.filter("_n > 1").select("name", "owner"), "shared")
    if shared.count() <= shared_limit:
        pairs = shared.toArrow()
        name = np.array(pairs.column("name").to_pylist(), "S16")
        order = np.argsort(name)
        table_ = spark.sparkContext.broadcast((name[order], pairs.column("owner").to_numpy()[order]))

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, owner = table_.value

            def owner_of(p: bytes):
                p = np.bytes_(p)
                k = int(np.searchsorted(name, p))
                return int(owner[k]) if k < len(name) and name[k] == p else None

            yield from _emit(r for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for r in _stored_rows(i, t.as_py(), owner_of))

        return docs.mapInArrow(by_broadcast, STORED)
    named = docs.mapInArrow(_with_key, "me long, doc_id long, text string")
    marks = listed.join(shared.withColumnRenamed("owner", "first"), "name").groupBy(F.col("owner").alias("me")).agg(F.collect_set(F.struct("name", "first")).alias("marks"))

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = [{m["name"]: m["first"] for m in x or ()} for x in b.column(2).to_pylist()]
            yield from _emit(r for i, t, own in zip(b.column(0).to_pylist(), b.column(1), owners, strict=True) for r in _stored_rows(i, t.as_py(), own.get))

    return named.join(marks, "me", "left").select("doc_id", "text", "marks").mapInArrow(by_join, STORED)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        me = [_owner(row_key(i, payload_of(t.as_py())[0])) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(me, pa.int64()), b.column(0).cast(pa.int64()), b.column(1).cast(pa.string())], names=["me", "doc_id", "text"])


def assemble(refs: list[dict], own: bytes, fetched: dict[bytes, bytes]) -> bytes:
    """The payload of an ordered chunk list; every chunk is held against its digest."""
    out, at = [], 0
    for ref in refs:
        if ref["own"]:
            piece, at = own[at : at + ref["len"]], at + ref["len"]
        else:
            piece = fetched.get(ref["digest"], b"")
        if len(piece) != ref["len"] or hashlib.sha256(piece).digest() != ref["digest"]:
            raise ValueError(f"chunk {ref['digest'].hex()} is missing or altered")
        out.append(piece)
    return b"".join(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, n_bytes, refs, body, chunks: the contract's row of each."""
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            doc_id, n, refs, body, chunks = (b.column(k)[i].as_py() for k in range(5))
            payload = assemble(refs, unpack(body), {c["digest"]: unpack(c["body"]) for c in chunks or ()})
            rows.append(described(doc_id, n, payload, [(r["digest"], r["len"]) for r in refs]))
        yield _batches(rows, RESULT_ARROW)


def _salted(wanted: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: references to a hot chunk are dealt over parts, each of which has a copy of it.

    A chunk is hot by its share of all references, so fewer than HOT_SHARE are.
    """
    total = wanted.count()
    hot = wanted.groupBy("digest").count().filter((F.col("count") * HOT_SHARE > total) & (F.col("count") > HOT_PARTS)).select("digest", F.lit(HOT_PARTS).alias("parts"))
    hot = F.broadcast(wanted.sparkSession.createDataFrame(hot.collect(), "digest binary, parts int"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = wanted.join(hot, "digest", "left").select("_row", "digest", F.pmod(F.xxhash64("_row"), parts).cast("int").alias("part"))
    return dealt, chunks.join(hot, "digest", "left").select("digest", "chunk", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))


def read_back(stored: DataFrame) -> DataFrame:
    """Every payload of the store, put together from its chunk list and verified."""
    lists = stored.filter("kind = 0").withColumn("_row", F.monotonically_increasing_id())
    alone = lists.filter(F.forall("refs", lambda r: r["own"]))
    mixed = lists.filter(F.exists("refs", lambda r: ~r["own"]))
    chunks = stored.filter("kind = 1").dropDuplicates(["row_key"]).select(F.col("row_key").alias("digest"), F.col("body").alias("chunk"))
    wanted = mixed.select("_row", F.explode(F.array_distinct(F.transform(F.filter("refs", lambda r: ~r["own"]), lambda r: r["digest"]))).alias("digest"))
    wanted, chunks = _salted(cut(stored.sparkSession, wanted, "wanted"), chunks)
    got = wanted.join(chunks, ["digest", "part"]).groupBy("_row").agg(F.collect_list(F.struct("digest", F.col("chunk").alias("body"))).alias("chunks"))
    mixed = mixed.join(got, "_row", "left").select("doc_id", "n_bytes", "refs", "body", "chunks")
    none = F.lit(None).cast("array<struct<digest: binary, body: binary>>").alias("chunks")
    alone = alone.select("doc_id", "n_bytes", "refs", "body", none)
    return alone.mapInArrow(_read, RESULT).unionByName(mixed.mapInArrow(_read, RESULT))


def media(docs: DataFrame, shared_limit: int = SHARED_LIMIT) -> DataFrame:
    spark = docs.sparkSession
    return read_back(cut(spark, store(docs, shared_limit), "media"))


def op5_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
