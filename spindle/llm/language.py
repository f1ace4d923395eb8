"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; their n-grams of 1 to 3 code points are hashed to
``DIM`` features. A feature's weight is its share among the text's n-grams
times its inverse document frequency, counted over all training rows. The
weights of the languages are trained by follow-the-regularised-leader with
per-coordinate rates and elastic-net penalties (L1 leaves most of them 0), on
at most about ``PER_LANG`` rows of each language, chosen by hash. A temperature
fitted on rows the weights have not seen makes the scores honest.

Every non-null label is learnt. The sample is the only bounded part: ``SAMPLE``
rows and about ``SAMPLE_FEATURES`` features in all, shared out evenly over the
labels, but at least one row of each. With more
than ``DENSE_LANGS`` labels a label has weights only for features that its
sampled rows have, so that weights take no more room than the sample. What the
driver gets of a sampled row is its sparse counts (at most ``DIM`` of them), not
its text.

Defined cases: ``und`` with score 0 for null texts and texts without a letter,
and for all texts if no row has a language to learn from; rows with null
``lang`` train nothing but are predicted; repeated and null ``doc_id`` are
predicted row by row (null counts as held in, its remainder being unknown); an
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy

DIM_BITS = 16
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
PER_LANG = 1500
#: Rows of all languages; with more languages than 64, fewer rows of each.
SAMPLE = 64 * PER_LANG
#: Features of all sampled rows together, 6 bytes each on the driver: where texts are long, fewer rows.
SAMPLE_FEATURES = 48_000_000
#: With more languages than this, weights are kept for the pairs that occur.
DENSE_LANGS = 64
#: Scores of set-aside rows that the temperature is fitted on, at 50 rows or more.
FIT_CELLS = 1 << 22
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: Below this a text is no more one language than another.
MIN_SCORE = 0.35
#: Code points handled at once.
SLICE = 1 << 19
#: Rows that go back to the JVM at once, with all their columns.
SENT = 1000

LETTER = regex.compile(r"\p{L}")
FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """Feature of every n-gram of 1, 2 and 3 code points, in no order."""
    out, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * FACTORS[n - 1]
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - DIM_BITS))
    return np.concatenate(out)


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """``grams`` of a whole text, a slice of it at a time; each n-gram once."""
    c = codes(text)
    if len(c) <= SLICE:
        yield grams(c)
        return
    most = ORDERS[-1]
    for start in range(0, len(c), SLICE):
        part = c[start : start + SLICE + most - 1]
        out = [grams(part)]
        if start + SLICE < len(c):  # n-grams that begin in the overlap belong to the next slice
            out.append(grams(c[start + SLICE : start + SLICE + most - 1]))
        yield out[0] if len(out) == 1 else _less(out[0], out[1])


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.bincount(a, minlength=DIM) - np.bincount(b, minlength=DIM)
    return np.repeat(np.arange(DIM, dtype=np.uint32), n)


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text, ascending, and how often each occurs."""
    total = None
    for g in gram_slices(text):
        if total is None and len(g) < DIM // 4:
            return np.unique(g, return_counts=True)
        n = np.bincount(g, minlength=DIM)
        total = n if total is None else total + n
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Pairs:
    """Values of (feature, language) pairs, by feature; those of all others are 0."""

    starts: np.ndarray  # of each feature's pairs, and their number
    lang: np.ndarray
    value: np.ndarray

    def of(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the features' pairs, and how many each feature has."""
        n = self.starts[features + 1] - self.starts[features]
        return np.arange(n.sum()) + np.repeat(self.starts[features] - (np.cumsum(n) - n), n), n

    def times(self, features: np.ndarray, x: np.ndarray, n_langs: int) -> np.ndarray:
        at, n = self.of(features)
        return np.bincount(self.lang[at], self.value[at] * np.repeat(x, n), n_langs)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray | Pairs  # DIM x languages: idf times weight
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        if isinstance(self.weights, Pairs):
            at, counts = text_counts(text)
            return self.weights.times(at.astype(np.int64), counts / counts.sum() * SCALE, len(self.langs)) + self.bias
        total, n = np.zeros(len(self.langs)), 0
        for g in gram_slices(text):
            for start in range(0, len(g), SLICE):
                total += self.weights[g[start : start + SLICE]].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / n * SCALE + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


#: Shares of n-grams are small numbers; the model sees them times this.
SCALE = 16.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL's weights of summed gradients and squares; 0 while the gradients stay within L1."""
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def train_pairs(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, scale: np.ndarray, epochs: int = EPOCHS) -> tuple[Pairs, np.ndarray]:
    """``train_ftrl`` with weights for those pairs alone of which a row of the language has the feature."""
    by_lang: dict[int, list[np.ndarray]] = {}
    for at, _, y in rows:
        by_lang.setdefault(y, []).append(at)
    own = [(y, np.unique(np.concatenate(found)).astype(np.int32)) for y, found in by_lang.items()]
    feature, lang = np.concatenate([a for _, a in own]), np.concatenate([np.full(len(a), y, np.int32) for y, a in own])
    order = np.lexsort((lang, feature))
    pairs = Pairs(np.searchsorted(feature[order], np.arange(DIM + 1)), lang[order], np.zeros(len(lang)))
    z, n, z_bias, n_bias = np.zeros(len(lang)), np.zeros(len(lang)), np.zeros(n_langs), np.zeros(n_langs)

    def step(z: np.ndarray, n: np.ndarray, at, w: np.ndarray, g: np.ndarray) -> None:
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
        n[at] += g * g

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            features, share, y = rows[i]
            features = features.astype(np.int64)
            at, many = pairs.of(features)
            x, k = np.repeat(share * scale[features], many), pairs.lang[at]
            w, w_bias = solved(z[at], n[at]), solved(z_bias, n_bias)
            p = softmax(np.bincount(k, x * w, n_langs) + w_bias)
            p[y] -= 1
            step(z, n, at, w, x * p[k])
            step(z_bias, n_bias, slice(None), w_bias, p)
    pairs.value = solved(z, n)
    return pairs, solved(z_bias, n_bias)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, scale: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over rows (features, shares, language), a share times its feature's scale: weights and bias.

    A weight is 0 while its summed gradients stay within L1.
    """
    z, n = np.zeros((DIM + 1, n_langs)), np.zeros((DIM + 1, n_langs))

    def weights(at) -> np.ndarray:
        return solved(z[at], n[at])

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, share, y = rows[i]
            at, x = np.append(at.astype(np.int64), DIM), np.append(share * scale[at], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean())

    low, high, r = -1.5, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id) -> F.Column:
    """Whether the contract keeps the row from training: crc32 of its id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of the task have each feature; row DIM is the number of texts."""
    total = np.zeros(DIM + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            at, _ = text_counts(text.as_py())
            total[at] += 1
            total[DIM] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_counts(t.as_py()) for t in batch.column(0)]
        at = pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary())
        share = pa.array([(n / n.sum()).astype("<f4").tobytes() for _, n in found], pa.binary())
        yield pa.RecordBatch.from_arrays([at, share, batch.column(1), batch.column(2)], names=["at", "share", "lang", "h"])


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model of the training rows of ``docs`` (doc_id, text, lang)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("text", F.col("lang").cast("string").alias("lang"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)).alias("h"))
    most = F.least(F.lit(len(ORDERS)) * (F.length("text") + 2), F.lit(DIM))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"), F.avg(most).alias("features")).collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0), 1.0)
    each = max(1, min(per_lang, SAMPLE // len(langs)))
    wanted = {r["lang"]: min(each, SAMPLE_FEATURES / len(langs) / r["features"]) for r in sizes}
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, wanted[r["lang"]] / r["n"]), r["least"]) for r in sizes], "_lang string, _share double, _least double")
    chosen = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter("h < _share OR h = _least").select("text", "lang", "h")
    counted = rows.select("text").mapInArrow(tidy(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequency = np.zeros(DIM + 1)
    for feature, n in counted.collect():
        frequency[feature] = n
    idf = np.log((1 + frequency[DIM]) / (1 + frequency[:DIM])) + 1
    sample = chosen.mapInArrow(tidy(_features), "at binary, share binary, lang string, h double").collect()
    sample.sort(key=lambda r: (r["h"], r["lang"]))
    number = {lang: k for k, lang in enumerate(langs)}
    vectors = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["share"], "<f4"), number[r["lang"]]) for r in sample]
    scale = idf * SCALE
    # A language of which all rows would be set aside keeps them.
    kept = {y for i, (_, _, y) in enumerate(vectors) if i % 5}
    aside = [v for v in vectors[::5] if v[2] in kept] if len(vectors) >= 50 else []
    learnt = [v for i, v in enumerate(vectors) if not aside or i % 5 or v[2] not in kept]
    aside = aside[: max(50, FIT_CELLS // len(langs))]
    truth = np.array([y for _, _, y in aside], np.int64)
    if len(langs) > DENSE_LANGS:
        pairs, bias = train_pairs(learnt, len(langs), scale)
        logits = np.array([pairs.times(at.astype(np.int64), share * scale[at], len(langs)) + bias for at, share, _ in aside])
        held = np.flatnonzero(pairs.value)
        feature = np.searchsorted(pairs.starts, held, side="right") - 1
        weights = Pairs(np.searchsorted(feature, np.arange(DIM + 1)), pairs.lang[held], (pairs.value[held] * idf[feature]).astype(np.float32))
        return Model(langs, weights, bias, fit_temperature(logits, truth))
    weights, bias = train_ftrl(learnt, len(langs), scale)
    logits = np.array([(share * scale[at]) @ weights[at] + bias for at, share, _ in aside])
    return Model(langs, (weights * idf[:, None]).astype(np.float32), bias, fit_temperature(logits, truth))


def predict(docs: DataFrame, model: Model, inside: int | None = None) -> DataFrame:
    """All columns of ``docs`` but its text, with lang_pred and score; the text alone decides.

    inside: the text is this field of the first column, a struct, and stays there;
    so rows that are to keep their text hand it over once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    kept = docs.select(*others)
    source = kept if inside is not None else docs.select(*others, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SENT):
                batch = whole.slice(start, SENT)
                texts = batch.column(len(others)) if inside is None else batch.column(0).field(inside)
                found = [shared.value.predict(t.as_py()) for t in texts]
                columns = [*batch.columns[: len(others)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "lang_pred", "score"])

    return source.mapInArrow(tidy(run), schema)


def op1_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents go that have no language or whose score is below ``MIN_SCORE``."""
    model = train(docs.select("doc_id", "text", "lang"))
    row = F.struct("*").alias("row")
    inside = next((k for k, f in enumerate(docs.schema) if f.name == "text" and isinstance(f.dataType, T.StringType)), None)
    rows = docs.select(row, "text") if inside is None else docs.select(row)
    return predict(rows, model, inside).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")
