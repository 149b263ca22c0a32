"""Filling training sequences of fixed capacity with whole documents.

Method: best-two-fit. A sequence is filled greedily with the longest items that fit; then its smallest item
is taken out and replaced by the two unpacked items that fill the widened gap more tightly, if there are such.

Documents are split by a hash of their id into blocks of about ``BLOCK_ITEMS`` items, each packed on its own
from lengths alone; texts never move. A block leaves at most a few sequences part-filled, so the loss is
about 1/BLOCK_ITEMS of the sequences whatever the size of the corpus.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.session import materialize

CAPACITY = 2048
BLOCK_ITEMS = 20_000
#: Documents counted at a time within an Arrow batch, and pieces whose counts a task remembers at most.
CHUNK = 512
CACHE = 400_000

#: A public byte-level vocabulary for many languages, and the pattern its merges were learnt with.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TokenCounter:
    """Exact token counts of whole texts.

    The pattern never matches across a single space between two other characters, so a text is the sum of
    its space-separated pieces, each with its leading space; those recur and are counted once. Texts with
    runs of spaces are encoded whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("weftline", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        if first == "" or "" in rest:
            return len(self.encode(text))
        known, total = self.known, len(self.encode(first))
        try:
            return total + sum(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for x in rest:
                if x not in known:
                    known[x] = len(self.encode(" " + x))
            return total + sum(map(known.__getitem__, rest))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each document; null and empty texts have 0 tokens. One narrow pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                n = [counter.count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")


class Unpacked:
    """Items not yet packed, by length: their indexes, and the lengths that are left in rising order."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")[::-1]
        self.of: dict[int, list[int]] = {}
        for i in order.tolist():
            self.of.setdefault(int(sizes[i]), []).append(i)
        self.lengths = sorted(self.of)

    def largest(self, gap: int) -> int:
        """The greatest length left that fits the gap, or 0."""
        at = bisect_right(self.lengths, gap)
        return self.lengths[at - 1] if at else 0

    def take(self, length: int) -> int:
        own = self.of[length]
        i = own.pop()
        if not own:
            del self.of[length], self.lengths[bisect_right(self.lengths, length) - 1]
        return i

    def give(self, length: int, i: int) -> None:
        if length not in self.of:
            self.of[length] = []
            self.lengths.insert(bisect_right(self.lengths, length), length)
        self.of[length].append(i)

    def best_two(self, gap: int) -> tuple[int, int]:
        """The two lengths left with the greatest sum within the gap, or (0, 0)."""
        lens = self.lengths
        lo, hi, best, pair = 0, bisect_right(lens, gap) - 1, 0, (0, 0)
        while lo <= hi:
            a, b = lens[lo], lens[hi]
            if a + b > gap:
                hi -= 1
                continue
            if (lo < hi or len(self.of[a]) > 1) and a + b > best:
                best, pair = a + b, (a, b)
                if best == gap:
                    break
            lo += 1
        return pair


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; sizes are between 1 and the capacity."""
    left, bins, b = Unpacked(sizes), np.zeros(len(sizes), np.int64), 0
    while left.lengths:
        gap, own = capacity, []
        while size := left.largest(gap):
            own.append((size, left.take(size)))
            gap -= size
        if gap and len(own) > 1 and left.lengths:
            size, i = min(own)
            one, two = left.best_two(gap + size)
            if one + two > size:
                own.remove((size, i))
                own += [(one, left.take(one)), (two, left.take(two))]
                left.give(size, i)
        for _, i in own:
            bins[i] = b
        b += 1
    return bins


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, n_tokens, sequence_id, start): each document's pieces and where they stand.

    Only texts longer than the capacity are cut, into full sequences and one rest. Defined cases: null and
    empty texts have one piece 0 of 0 tokens in no sequence (sequence_id and start null); repeated documents
    are packed each time; a text that fits exactly fills a sequence; an empty table gives an empty result;
    columns other than doc_id and text are never read.
    """
    counts = materialize(token_counts(documents, vocabulary), "pack-counts")
    n_items = counts.agg(F.coalesce(F.sum(F.ceil(F.col("n_tokens") / capacity)), F.lit(0))).first()[0]
    blocks = max(1, round(n_items / BLOCK_ITEMS))
    whole = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") - whole * capacity
    sizes = F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    items = counts.where("n_tokens > 0").select("doc_id", F.posexplode(sizes).alias("piece", "n_tokens"))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
        bins = best_two_fit(pdf["n_tokens"].to_numpy(), capacity)
        pdf["sequence_id"] = bins + (int(pdf["block"].iloc[0]) << 32) if len(pdf) else bins
        pdf["start"] = pdf.groupby("sequence_id")["n_tokens"].cumsum() - pdf["n_tokens"]
        return pdf[["doc_id", "piece", "n_tokens", "sequence_id", "start"]]

    schema = "doc_id long, piece long, n_tokens long, sequence_id long, start long"
    packed = items.select("doc_id", F.col("piece").cast("long").alias("piece"), "n_tokens", "block").groupBy("block").applyInPandas(fill, schema)
    empty = counts.where("n_tokens = 0").select("doc_id", F.lit(0).cast("long"), "n_tokens", F.lit(None).cast("long"), F.lit(None).cast("long"))
    return packed.union(empty)
