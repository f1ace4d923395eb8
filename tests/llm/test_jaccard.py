import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from spindle.llm import common, jaccard
from spindle.llm.graph import components

WORDS = [f"w{i}" for i in range(60)]


def sets_of(text):
    words = [] if text is None else text.encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """(n_shingles, component) of each row by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, groups=12, per_group=14):
    r = random.Random(seed)
    rows, doc = [], 0
    passage = [r.choice(WORDS) for _ in range(30)]
    for _ in range(groups):
        base = [r.choice(WORDS) for _ in range(r.randint(1, 120))]
        if r.random() < 0.5:
            base = passage + base
        for _ in range(r.randint(1, per_group)):
            words = base[:]
            for _ in range(r.randint(0, max(1, len(words) // 18))):
                words[r.randrange(len(words))] = r.choice(WORDS)
            rows.append((doc, " ".join(words)))
            doc += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,first_bits", [(1, 4096, 64), (2, 3, 64), (3, 2, 64), (4, 4096, 3)])
def test_components_equal_all_pairs(spark, seed, block, first_bits):
    """first_bits 3: nearly all classes clash in their first number."""
    rows = corpus(seed)
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block=block, first_bits=first_bits)
    out = found.documents.join(found.classes, "c", "left").select("doc_id", "n", "component")
    got = sorted((r.doc_id, r.n, r.component if r.n else r.doc_id) for r in out.collect())
    assert got == brute(rows)


def test_large_group_of_near_copies_meets_across_blocks(spark):
    """Copies that are similar to a few others only, so that blocks decide."""
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(60):
        words = base[:]
        for k in range(r.randint(0, 5)):
            words[r.randrange(100)] = f"x{i}{k}"
        rows.append((i, " ".join(words)))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block=8)
    got = sorted((x.doc_id, x.n, x.component) for x in found.documents.join(found.classes, "c").select("doc_id", "n", "component").collect())
    assert got == brute(rows)


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3), (5, 2)])
def test_every_link_and_count_equals_all_pairs(spark, seed, block):
    rows = corpus(seed) + [(1000, None), (1001, "")]
    rows += [(1002 + i, rows[i][1]) for i in range(20)]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block=block, every=True)
    sets = {doc: sets_of(t) for doc, t in rows}
    alike = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    classes = {}
    for r in found.documents.filter("n > 0").collect():
        classes.setdefault(r.c, []).append(r.doc_id)
    links = [(r.a, r.b) for r in found.links.collect()]
    assert len(links) == len(set(links))
    got = {tuple(sorted((x, y))) for a, b in links for x in classes[a] for y in classes[b]}
    assert got | {p for c in classes.values() for p in itertools.combinations(sorted(c), 2)} == alike
    assert {r.doc_id: r.n_links for r in jaccard.degrees(found).collect()} == {d: sum(d in p for p in alike) for d in sets}
    out = found.documents.join(found.classes, "c", "left").select("doc_id", "n", "component")
    assert sorted((r.doc_id, r.n, r.component if r.n else r.doc_id) for r in out.collect()) == brute(rows)


@given(st.integers(1, 3000))
def test_prefix_leaves_too_few_to_be_similar(n):
    k = jaccard.prefix_size(n)
    assert not jaccard.similar(n, n, n - k) if n - k else True
    assert 4 * (n - k) < 3 * n


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True), st.lists(st.integers(0, 2**64 - 1), max_size=60, unique=True), st.integers(0, 60))
def test_bitmaps_bound_the_difference(items, added, dropped):
    a = np.unique(np.array(items, np.uint64))
    b = np.unique(np.array(items[dropped:] + added, np.uint64))
    if not len(b):
        return
    x, y = jaccard.bitmap(a), jaccard.bitmap(b)
    while len(x) > len(y):
        x = jaccard.fold(x)
    while len(y) > len(x):
        y = jaccard.fold(y)
    assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def shingles(text):
    return next(jaccard.shingles([text]))


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_ascii_lowered_and_split():
    assert np.array_equal(shingles("A\x0bB c d É"), shingles("a b\tC D É"))
    assert not np.array_equal(shingles("É"), shingles("é"))
    assert not np.array_equal(shingles("a b"), shingles("b a"))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_that_clash_under_polynomial_hashes_are_told_apart(spark, n):
    rows = list(enumerate(thue_morse(n)))
    found = jaccard.clusters(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == [(0, 1, 0), (1, 1, 1)]


def test_long_texts_and_words_are_cut_without_loss(monkeypatch):
    r = random.Random(7)
    text = " ".join(r.choice(WORDS) + r.choice(["", "y" * 30]) for _ in range(3000)) + " " + "z" * 9000 + " a b c d e"
    whole = shingles(text)
    assert len(whole) == len(sets_of(text))
    monkeypatch.setattr(common, "SEGMENT", 700)
    assert np.array_equal(whole, shingles(text))


@pytest.mark.parametrize("block", [1024, 4])
def test_steps_write_no_more_rows_than_tiles_have(spark, block, monkeypatch):
    """A chain of near copies of which few pairs are similar: pairs verified grow with the rows."""
    r = random.Random(3)
    rows, words = [], [f"v{i}" for i in range(80)]
    for i in range(150):
        words[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    verified = []
    verify = jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda source, pairs, reps: verified.append(pairs.count()) or verify(source, pairs, reps))
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    got = sorted((x.doc_id, x.n, x.component) for x in found.documents.join(found.classes, "c").select("doc_id", "n", "component").collect())
    assert got == brute(rows)
    assert all(n <= 2 * len(rows) for n in verified) and found.links.count() < 5 * len(rows)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame([(b, a) for a, b in path] + star, "a long, b long")
    got = dict(tuple(r) for r in components(spark, edges).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
