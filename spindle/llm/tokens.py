"""Token counts: edit-aware counting.

A document is a tree over its pre-tokens (the pieces that the tokenizer's
pattern cuts before merging): leaves hold runs of pieces with their lengths and
token counts, inner nodes the sums. An edit re-encodes from a little before the
place it touches, as far as the pattern may have looked, up to the first place
after it where old and new pieces begin together; from there on nothing can
differ. Then the sums above the touched leaves are made anew.

``plant`` makes the trees of a table and ``revise`` edits kept ones: a row of a
tree table has the text and its leaves, packed, so a later run loads the trees
and encodes nothing but what its edits touch.

Defined cases: null text has no tokens and takes no edits; an edit's ends are
cut to the text, and an end before its start counts as the start; edits apply
in order, each to the text that the one before it left; rows with null edits
stay as they are; repeated rows are counted each; an empty table gives an empty
result; other columns are unused.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pre-token pattern (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How far past a piece's end the pattern looks to find that end.
LOOK = 2
LEAF = 128
MEMO = 400_000


class Counter(dict):
    """piece -> its number of tokens; forgets all when it holds MEMO pieces."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.encode = encoding._encode_single_piece

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = n = len(self.encode(piece.encode("utf-8", "replace")))
        return n


@lru_cache(maxsize=2)
def counter(path: str = VOCABULARY) -> Counter:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Counter(tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))


PIECES = regex.compile(PATTERN)


class Tree:
    """The pieces of one text. ``tokens`` is the root's sum.

    leaves[i] is (lengths, counts); chars and sums are binary heaps over the leaves.
    """

    def __init__(self, text: str, count: Callable[[str], int], leaves: bytes | None = None):
        """leaves: those of a kept tree of this text, which is then not encoded."""
        self.text, self.count, self.encoded = text, count, 0
        if leaves is None:
            pieces = PIECES.findall(text)
            lengths, counts = [len(p) for p in pieces], list(map(count, pieces))
        else:
            planes = np.frombuffer(zstandard.decompress(leaves), np.uint8).reshape(4, -1)
            lengths, counts = planes.T.copy().view("<u4").reshape(2, -1).tolist()
        self._build(lengths, counts)
        self.pieces = len(lengths)

    def packed(self) -> bytes:
        """The leaves' lengths and counts, as planes of bytes, of which the upper ones are nearly empty."""
        flat = [[x for leaf in self.leaves for x in leaf[k]] for k in range(2)]
        return zstandard.compress(np.array(flat, "<u4").reshape(-1, 1).view(np.uint8).T.copy().tobytes(), 3)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.half = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.half), [0] * (2 * self.half)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.half + i], self.sums[self.half + i] = sum(a), sum(b)
        for k in range(self.half - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset at which it begins) of the character ``at``, or the last leaf."""
        k, begin = 1, 0
        while k < self.half:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.half, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by ``new``."""
        start = min(max(0, start), len(self.text))
        end = min(max(start, end), len(self.text))
        if start == end and not new:
            return
        leaf, at = self._find(max(0, start - LOOK - 1))
        first, begin, i = leaf, at, 0
        lengths, counts = self.leaves[first]
        # Pieces that end, with what the pattern looks at, before the edit stay.
        while i < len(lengths) and begin + lengths[i] + LOOK <= start:
            begin += lengths[i]
            i += 1
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        kept = (lengths[:i], counts[:i])
        # Old beginnings of pieces at or after the edit's end, leaf by leaf.
        old, old_at, j = first, begin, i
        fresh_lengths, fresh_counts, pos = [], [], begin
        while True:
            while old < len(self.leaves) and (j >= len(self.leaves[old][0]) or old_at + shift < pos or old_at < end):
                if j >= len(self.leaves[old][0]):
                    if old + 1 == len(self.leaves):
                        break
                    old, j = old + 1, 0
                else:
                    old_at += self.leaves[old][0][j]
                    j += 1
            if pos >= len(self.text) or (old_at >= end and old_at + shift == pos and pos >= start + len(new) and j < len(self.leaves[old][0])):
                break
            piece = PIECES.match(self.text, pos).group()
            fresh_lengths.append(len(piece))
            fresh_counts.append(self.count(piece))
            pos += len(piece)
        if pos >= len(self.text):
            old, j = len(self.leaves) - 1, len(self.leaves[-1][0])
        tail = (self.leaves[old][0][j:], self.leaves[old][1][j:])
        gone = sum(len(self.leaves[k][0]) for k in range(first, old + 1)) - len(kept[0]) - len(tail[0])
        self.encoded += len(fresh_lengths)
        self.pieces += len(fresh_lengths) - gone
        merged = (kept[0] + fresh_lengths + tail[0], kept[1] + fresh_counts + tail[1])
        if len(merged[0]) > 8 * LEAF:
            flat = [self.leaves[k] for k in range(first)] + [merged] + [self.leaves[k] for k in range(old + 1, len(self.leaves))]
            self._build([x for a, _ in flat for x in a], [x for _, b in flat for x in b])
            return
        for k in range(first, old + 1):
            self.leaves[k] = merged if k == first else ([], [])
            self.chars[self.half + k], self.sums[self.half + k] = sum(self.leaves[k][0]), sum(self.leaves[k][1])
        above = {(self.half + k) // 2 for k in range(first, old + 1)}
        while above and 0 not in above:
            for k in above:
                self._sum(k)
            above = {k // 2 for k in above}


EDITS = "array<struct<start: long, end: long, new: string>>"
TREES = "doc_id long, text string, n_tokens long, n_pieces long, leaves binary"
RESULT = TREES + ", n_tokens_after long, n_pieces_after long, n_reencoded long"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that not too many trees are packed at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            yield batch.slice(start, 512)


def plant(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees of ``docs`` (doc_id, text), to be kept: text, its counts and leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).__getitem__
        for part in _parts(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tree = Tree(text or "", count)
                rows.append((doc_id, text, tree.tokens, tree.pieces, tree.packed()))
            yield _arrow(rows, TREES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def revise(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Kept trees with ``edits`` (array<struct<start, end, new>>) after these: text and leaves anew, the counts before
    (n_tokens, n_pieces) and after, and how many pieces were encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).__getitem__
        for part in _parts(batches):
            rows = []
            for doc_id, text, tokens, pieces, leaves, edits in zip(*(c.to_pylist() for c in part.columns), strict=True):
                tree = Tree(text or "", count, leaves)
                for e in (edits or ()) if text is not None else ():
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["new"] or "")
                rows.append((doc_id, None if text is None else tree.text, tokens, pieces, tree.packed(), tree.tokens, tree.pieces, tree.encoded))
            yield _arrow(rows, RESULT)

    return trees.select("doc_id", "text", "n_tokens", "n_pieces", "leaves", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, RESULT)


def kept(revised: DataFrame) -> DataFrame:
    """The tree table that ``revise`` leaves, for the next edits."""
    return revised.select("doc_id", "text", F.col("n_tokens_after").alias("n_tokens"), F.col("n_pieces_after").alias("n_pieces"), "leaves")


def sample_edits():
    """Three edits of a text, by its length: a sentence put in, a stretch taken out, a word replaced."""
    n = F.length("text").cast("long")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("new"))
    return F.array(
        edit(F.floor(n / 4), F.floor(n / 4), " It was added later, in 2024."),
        edit(F.floor(n / 2), F.floor(n / 2) + 40, ""),
        edit(F.floor(n * 3 / 4), F.floor(n * 3 / 4) + 5, "édité"),
    )


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants the trees of all documents, keeps them in the shared folder, and edits the kept ones."""
    trees = cut(spark, plant(table(spark, sf_dir, "documents")), "trees", compression="zstd")
    out = revise(trees.withColumn("edits", sample_edits()))
    return out.select("doc_id", "n_tokens", "n_pieces", "n_tokens_after", "n_pieces_after", "n_reencoded")
