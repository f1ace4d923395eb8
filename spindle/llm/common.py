"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space as the word and line contracts define it: blank and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes.translate table of the decontamination words: A-Z lower-cased, ASCII
#: letters, digits and all bytes of non-ASCII characters kept, the rest blanks.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder that the cluster names; it goes when the application ends.

    ``spark.checkpoint.dir`` is read from the session; where it is unset the
    folder lies in the warehouse, which all machines of a session share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/spindle-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    path = scratch(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects garbage, which a driver with room to spare
    puts off while executors' disks fill.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


#: bytes.translate table of the shingles' words: A-Z lower-cased, white space to blanks.
SPACED_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if chr(c) in SPACE else c for c in range(256))
#: Bytes of text whose words are hashed at once.
SEGMENT = 1 << 20
#: Seeds of two hashes that have nothing to do with each other, and what is added between words of a run.
FIRST, SECOND, STEP = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)
#: The low bytes of a lane that belong to a word, by how many of its bytes are left.
LANES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits stirred, one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def stretch_hashes(data: bytes, starts: np.ndarray, lens: np.ndarray, seed: np.uint64 = FIRST) -> np.ndarray:
    """A hash of each stretch of bytes, a lane of 8 bytes of all stretches at a time.

    Length goes in first; each lane is stirred before it meets the hash so far
    and after, so no sum or polynomial of the bytes decides. Two stretches of one
    length up to 8 bytes never share a hash.
    """
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    h = mixed(lens.astype(np.uint64) + seed)
    at, left, which = starts, lens, slice(None)
    while len(at):
        h[which] = mixed(h[which] ^ mixed((lanes[at] & LANES[np.minimum(left, 8)]) + seed))
        more = left > 8
        which = np.flatnonzero(more) if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def _segments(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    start = 0
    while start < len(raw):
        stop = len(raw) if len(raw) - start <= SEGMENT else raw.rfind(b" ", start + 1, start + SEGMENT)
        if stop < 0:
            stop = raw.find(b" ", start + SEGMENT)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop]
        start = stop


def _hashed(raws: list[bytes], seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's end."""
    data = b" ".join(raws)
    inside = np.frombuffer(data, np.uint8) != 0x20
    turns = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts = turns[::2]
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))
    return stretch_hashes(data, starts, turns[1::2] - starts, seed), ends


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` numbers, stirred in one by one."""
    n = max(0, len(h) - size + 1)
    out = mixed(h[:n] + STEP)
    for k in range(1, size):
        out = mixed((out ^ h[k : k + n]) + STEP)
    return out


def run_hashes(texts: Iterable[str | None], table: bytes, size: int, seed: np.uint64 = FIRST) -> Iterator[np.ndarray]:
    """For each text a hash of each run of ``size`` successive words in order; of fewer words, one of them all.

    table: bytes.translate table that leaves blanks between words. Texts are
    worked on together, about ``SEGMENT`` bytes at a time, and long ones in parts.
    """

    def hashed(raws: list[bytes]) -> Iterator[np.ndarray]:
        if len(raws) == 1 and len(raws[0]) > SEGMENT:
            h = np.concatenate([_hashed([part], seed)[0] for part in _segments(raws[0])])
            ends = np.array([len(h)])
        else:
            h, ends = _hashed(raws, seed)
        every, begin = _runs(h, size), 0
        for end in ends.tolist():
            n = end - begin
            yield every[begin : end - size + 1] if n >= size else _runs(h[begin:end], n) if n else np.zeros(0, np.uint64)
            begin = end

    held: list[bytes] = []
    total = 0
    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(table)
        if held and total + len(raw) > SEGMENT:
            yield from hashed(held)
            held, total = [], 0
        held.append(raw)
        total += len(raw) + 1
    if held:
        yield from hashed(held)


def numbered(spark: SparkSession, docs: DataFrame, label: str) -> DataFrame:
    """id, row: the rows of ``docs``, each one struct, written with a number of their own.

    Whatever the columns are called, they clash with no name outside the struct;
    ``row.*`` gives them back.
    """
    return cut(spark, docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), label)


def running(spark: SparkSession, rows: DataFrame, group: list[str], order: list[str], amount: str | None, label: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` (or number of rows) that stands before each in its group; written.

    Rows are dealt to tasks by ranges of group and order, so that a group of any
    size is spread; only a sum for each group and range is added up in order.
    ``order`` must tell rows apart.
    """
    dealt = cut(spark, rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), label)
    total = F.sum(amount) if amount else F.count(F.lit(1))
    sums = dealt.groupBy(*group, "_range").agg(total.alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    own = F.sum(amount or F.lit(1)).over(Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_own", F.coalesce(own, F.lit(0))).join(sums, [*group, "_range"])
    out = cut(spark, out.withColumn("before", F.col("_earlier") + F.col("_own")).drop("_range", "_own", "_earlier"), label)
    discard(dealt)
    return out


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving free memory back to the system at the end of each task: workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped
