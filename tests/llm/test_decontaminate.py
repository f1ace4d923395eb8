import random
import re

import numpy as np
import pytest

from spindle.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("seed,block_bytes,shard_words", [(1, 10**6, 10**6), (2, 200, 50), (3, 10**6, 1)])
def test_matches_equal_a_plain_search(spark, seed, block_bytes, shard_words):
    r = random.Random(seed)
    vocabulary = ["a", "the", "Of", "É", "x1", "été", "lone", "Zz"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "\n", "!"]) for _ in range(n))
    items = [(i, text(r.randint(0, 9))) for i in range(14)] + [(50, None), (51, "--"), (3, "lone x1")]
    docs = [(i, text(r.randint(0, 60))) for i in range(25)] + [(98, None), (99, items[2][1] + " " + items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.verdicts(d.scan(frame, bench, block_bytes=block_bytes, shard_words=shard_words, size=5)).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in got) == brute(docs, items, 5)


def test_matches_stay_inside_a_document(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert d.verdicts(d.scan(frame, bench)).filter("n_hit > 0").count() == 0


def test_proximity_finds_what_the_exact_search_misses(spark):
    frame = spark.createDataFrame([(1, "red green big blue car"), (2, "red car")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red green blue car")], "item_id long, text string")
    assert d.scan(frame, bench).filter("size(items) > 0").count() == 0
    assert [r.doc_id for r in d.scan(frame, bench, slop=1).filter("size(items) > 0").collect()] == [1]


def test_proximity_holds_at_the_edges_of_documents(spark):
    docs = spark.createDataFrame([(1, "b a d c"), (2, "b a c"), (3, "d x x"), (4, "a b c")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    got = {r.doc_id: (list(r.items), list(r.spans)) for r in d.scan(docs, bench, slop=2).collect()}
    assert got[1] == (["i"], [0, 3]) and all(got[k] == ([], []) for k in (2, 3, 4))


def test_words_that_clash_under_polynomial_hashes_are_told_apart(spark):
    for n in (1024, 2048):
        word = "a"
        while len(word) < n:
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        bench = spark.createDataFrame([(1, other)], "item_id long, text string")
        got = d.verdicts(d.scan(spark.createDataFrame([(0, word), (1, other)], "doc_id long, text string"), bench)).collect()
        assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in got) == [(0, 0, False), (1, 1, True)]


def test_spans_of_several_blocks_are_merged():
    assert d.merged([5, 9, 0, 2, 8, 12, 2, 3, 20, 21]) == [0, 3, 5, 12, 20, 21]


def test_postings_round_trip():
    """Terms 3 and 7 are words that share the first hash."""
    r = np.random.default_rng(1)
    words = r.integers(0, 50, 1000)
    hashes, checks = np.where(words == 7, 3, words).astype(np.uint64), words.astype(np.uint64)
    at = np.sort(r.choice(10**6, 1000, replace=False))
    terms, found, counts, blob = d.pack_postings(hashes, checks, at)
    places, ends = d.unpack_postings(counts, blob)
    assert len(terms) == len(set(words.tolist())) and terms[found == 7] == 3
    for k, t in enumerate(found):
        assert places[ends[k] : ends[k + 1]].tolist() == at[words == t].tolist()
    asked = d.Phrases([], 2)
    asked.terms, asked.checks = np.array([[3, 3], [3, 60]], np.uint64), np.array([[7, 3], [9, 60]], np.uint64)
    at = d.places_of(asked, terms, found)
    assert found[at[0]].tolist() == [7, 3] and at[1].tolist() == [-1, -1]
