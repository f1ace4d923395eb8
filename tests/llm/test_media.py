import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spindle.llm import media


def brute(doc, text):
    raw = (text or "").encode()
    payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
    return doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


def texts():
    r = random.Random(5)
    blob = "".join(r.choice("abcdefgh ") for _ in range(20000))
    rows = [(0, None), (1, ""), (2, "é" * 400), (3, blob), (4, blob), (5, "intro " + blob), (6, blob[:9000] + "X" + blob[9000:]), (6, blob), (None, blob), (7, "z" * 50000)]
    return rows + [(100 + i, blob[i * 50 : i * 50 + 4000]) for i in range(30)]


@pytest.mark.parametrize("limit", [media.SHARED_LIMIT, 0])
def test_read_back_equals_the_payloads(spark, limit):
    rows = texts()
    got = media.media(spark.createDataFrame(rows, "doc_id long, text string"), shared_limit=limit).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted((brute(*r) for r in rows), key=key)
    forms = {}
    for r in got:
        forms.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert all(len(x) == 1 for x in forms.values())


def test_hot_chunks_are_read_in_parts(spark):
    blob = texts()[3][1]
    rows = [(i, blob[:3000] + f" {i}") for i in range(150)]
    got = media.media(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute(*r) for r in rows)


def test_chunks_are_named_by_128_bits():
    text, other = "first " * 60, "second " * 60
    names = {media._name(d) for t in (text, other) for d, _ in media.chunked(media.payload_of(t)[0])}
    assert len(names) == 2 and all(len(n) == 16 for n in names)


def test_shared_chunks_are_stored_once(spark):
    rows = texts()
    stored = media.store(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    shared = stored.filter("kind = 1").select("row_key").collect()
    refs = stored.filter("kind = 0").select(F.explode("refs").alias("r")).filter("NOT r.own").select("r.digest").distinct().collect()
    assert {bytes(r.digest) for r in refs} == {bytes(r.row_key) for r in shared}
    kept = sum(r.n for r in stored.select(F.octet_length("body").alias("n")).collect())
    assert kept < sum(len((t or "").encode()) for _, t in rows)


def test_damage_is_found(spark):
    stored = media.store(spark.createDataFrame([(1, "a" * 9000), (2, "a" * 9000)], "doc_id long, text string"))
    lost = stored.filter("kind = 0")
    with pytest.raises(Exception, match="missing or altered"):
        media.read_back(lost).collect()


def test_cuts_depend_on_content_and_respect_the_bounds():
    r = random.Random(2)
    data = bytes(r.randrange(256) for _ in range(200_000))
    a, b = media.chunked(data), media.chunked(b"123" + data)
    assert b"".join(p for _, p in a) == data
    assert all(media.MIN_CHUNK <= len(p) <= media.MAX_CHUNK for _, p in a[:-1])
    assert len({d for d, _ in a} - {d for d, _ in b}) <= 2
