"""Reading level of each document, on the scale of human ratings.

Method: one interpolated n-gram model per level is trained on rated documents. Over the full text of a document each
sentence's surprisal per word is taken under every model; the level at which a sentence surprises least (softly, see
``SHARPNESS``) is its own, and the words' mean over the distribution of all sentences is the document's difficulty,
which isotonic regression maps monotonically to the raters' scale.

The models are fitted on all rated documents. Their whole texts are counted and scored on the executors, which also pool
the scores to the blocks of the isotonic map; the driver takes in counts of words and pairs that come more than once, and
the blocks. Scoring is one narrow pass over all documents and whole texts: no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftline.session import materialize

#: Number of rated documents to fit on, for trials on fewer of them. None: all, as every query has it.
TRAIN_DOCS: int | None = None
LEVELS = 5
#: How sharply a sentence is given to the level of least surprisal, for each nat per word.
SHARPNESS = 8.0
#: Shares of pair, word and even chance that the models may have. Those are taken that grade held-out texts best; the
#: ones that make held-out texts likeliest give nearly all to the pairs and tell the levels apart less well.
WEIGHTS = [(0.4, 0.57, 0.03), (0.6, 0.38, 0.02), (0.8, 0.19, 0.01)]
#: Documents scored at a time within an Arrow batch.
CHUNK = 256

_MARKUP = re.compile(r"<[^<>]*>|&#?\w+;")
_WORD = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")


def words_and_stops(text: str) -> list[str]:
    """Lower-case words and sentence ends of a whole text; markup, digits and other marks are left out."""
    text = text.lower()
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text)


def pool(rows: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: rows (left, right, total, weight, squared error) of rising, separate ranges become blocks
    whose means, total / weight, rise too. Any run of rows may be pooled before: the blocks of blocks are those of the rows."""
    out: list[tuple[float, ...]] = []
    for left, right, total, weight, error in rows.tolist():
        while out and out[-1][2] / out[-1][3] >= total / weight:
            l0, _, t0, w0, e0 = out.pop()
            error += e0 + (t0 / w0 - total / weight) ** 2 * w0 * weight / (w0 + weight)
            left, total, weight = l0, t0 + total, w0 + weight
        out.append((left, right, total, weight, error))
    return np.array(out).reshape(-1, 5)


def knots(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of each block, and its mean at either."""
    return blocks[:, :2].ravel(), np.repeat(blocks[:, 2] / blocks[:, 3], 2)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: block means of y that never fall as x rises; (x of the knots, values). Equal x are one
    point, so their order doesn't matter."""
    points, at = np.unique(x, return_inverse=True)
    return knots(pool(np.column_stack([points, points, np.bincount(at, y * w), np.bincount(at, w), np.zeros(len(points))])))


@dataclass
class Scores:
    """Per text: words; mean and spread over its sentences, weighted by their known words, of the least surprisal per
    word; difficulty (nan without known words)."""

    words: np.ndarray
    surprisal: np.ndarray
    spread: np.ndarray
    difficulty: np.ndarray


@dataclass
class LevelModels:
    """Interpolated bigram models of all levels over one vocabulary.

    ``uni`` has each word's log probability per level where the pair is unseen, ``pairs`` the sorted keys of
    seen pairs and ``bi`` their interpolated log probabilities.
    """

    vocab: dict[str, int] = field(default_factory=dict)
    uni: np.ndarray = field(default_factory=lambda: np.zeros((1, LEVELS), np.float32))
    pairs: np.ndarray = field(default_factory=lambda: np.array([-1]))
    bi: np.ndarray = field(default_factory=lambda: np.zeros((1, LEVELS), np.float32))
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts in a row (0 unknown, -1 sentence end, -2 text end) and words per text."""
        get, ids, counts = self.vocab.get, [], []
        for t in texts:
            own = [get(x, 0) for x in words_and_stops(t)]
            counts.append(len(own) - own.count(-1))
            ids += own
            ids.append(-2)
        return np.array(ids, np.int64), np.array(counts, np.int64)

    def surprisals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence of encoded texts: the text it stands in, its known words, and their surprisal per word (nats)
        under each level's model."""
        prev = np.concatenate([[0], ids[:-1]])
        key = np.where((prev > 0) & (ids > 0), prev * (len(self.vocab) + 1) + ids, -2)
        at = np.searchsorted(self.pairs, key).clip(max=len(self.pairs) - 1)
        logp = np.where((self.pairs[at] == key)[:, None], self.bi[at], self.uni[ids.clip(min=0)])
        known = (ids > 0).astype(np.float64)
        ends = np.flatnonzero(ids < 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        per = np.add.reduceat(np.vstack([logp * known[:, None], np.zeros((1, LEVELS))]), starts)[: len(ends)] if len(ids) else np.zeros((0, LEVELS))
        n = np.add.reduceat(np.append(known, 0), starts)[: len(ends)]
        text_of = np.cumsum(np.concatenate([[0], ids[ends][:-1] == -2])) if len(ends) else np.zeros(0, int)
        return text_of, n, -per / np.maximum(n, 1)[:, None]

    def difficulty(self, texts: list[str]) -> Scores:
        return self.scores(*self.encode(texts))

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> Scores:
        text_of, n, nats = self.surprisals(ids)
        near = np.exp(SHARPNESS * (nats.min(axis=1, keepdims=True) - nats))
        level = (near / near.sum(axis=1, keepdims=True)) @ np.arange(1, LEVELS + 1)
        least = nats.min(axis=1)
        total = np.bincount(text_of, n, len(counts))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = lambda x: np.bincount(text_of, n * x, len(counts)) / total
            surprisal = mean(least)
            return Scores(counts, surprisal, np.sqrt(np.maximum(mean(least**2) - surprisal**2, 0)), mean(level))

    def graded(self, difficulty: np.ndarray) -> np.ndarray:
        return np.interp(difficulty, *self.knots) if self.knots else np.full(len(difficulty), np.nan)


@dataclass
class Counts:
    """Counts per level: words x levels (row 0: unknown), sorted keys of adjacent pairs, pairs x levels."""

    uni: np.ndarray
    keys: np.ndarray
    pairs: np.ndarray

    @classmethod
    def sum(cls, parts: list[Counts]) -> Counts:
        keys = np.unique(np.concatenate([p.keys for p in parts]))
        pairs = np.zeros((len(keys), LEVELS))
        for p in parts:
            pairs[np.searchsorted(keys, p.keys)] += p.pairs
        return cls(sum(p.uni for p in parts), keys, pairs)


def chances(own: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each word, and of each seen pair's second word after its first, per level."""
    v = len(own.uni)
    p1 = (own.uni + 0.1) / (own.uni.sum(axis=0) + 0.1 * v)
    ctx = np.zeros((v, LEVELS))
    np.add.at(ctx, own.keys // v, own.pairs)
    return p1, own.pairs / np.maximum(ctx[own.keys // v], 1e-9)


def interpolated(vocab: dict[str, int], own: Counts, lam: tuple[float, float, float]) -> LevelModels:
    v = len(own.uni)
    p1, p2 = chances(own)
    model = LevelModels(vocab, np.log(lam[1] * p1 + lam[2] / v + lam[0] * 1e-6).astype(np.float32))
    if len(own.keys):
        model.pairs, model.bi = own.keys, np.log(lam[0] * p2 + lam[1] * p1[own.keys % v] + lam[2] / v).astype(np.float32)
    return model


def training_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, level, raters, text) of all rated documents: mean rating, number of ratings, and one of two halves by the
    hash of the id; of a repeated id the least text counts."""
    rated = labels.where("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 5").groupBy("doc_id").agg(F.avg("reading_level").alias("level"), F.count("*").alias("raters"))
    if TRAIN_DOCS is not None:
        rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = documents.where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).join(rated, "doc_id")
    return texts.select(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold"), "level", "raters", "text")


def ngram_counts(training: DataFrame) -> DataFrame:
    """(fold, a, b, docs, l1 to l5): words b (a empty) and adjacent pairs of the texts of a fold, each with the documents
    it stands in and its count per level; a mean rating between two levels counts for both in proportion."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            docs: Counter = Counter()
            for fold, level, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ws = words_and_stops(text)
                own = Counter(("", w) for w in ws if w not in _STOPS)
                own.update((a, b) for a, b in zip(ws, ws[1:], strict=False) if a not in _STOPS and b not in _STOPS)
                for (a, b), k in own.items():
                    n[fold, level, a, b] += k
                    docs[fold, level, a, b] += 1
            cols = list(zip(*n, strict=True)) if n else [[], [], [], []]
            types = [pa.int32(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(list(n.values()), pa.int64()), pa.array(list(docs.values()), pa.int64())], names=["fold", "level", "a", "b", "n", "docs"])

    found = training.select("fold", "level", "text").mapInArrow(count, "fold int, level double, a string, b string, n long, docs long")
    shares = [F.sum(F.col("n") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("level") - k))).cast("double").alias(f"l{k}") for k in range(1, LEVELS + 1)]
    return found.groupBy("fold", "a", "b").agg(F.sum("docs").alias("docs"), *shares)


def fold_counts(grams: DataFrame) -> tuple[dict[str, int], list[Counts]]:
    """The vocabulary (words of two or more documents) and each fold's counts. Only pairs of such words that come more
    than once reach the driver."""
    spark = grams.sparkSession
    levels = [f"l{k}" for k in range(1, LEVELS + 1)]
    vocab = grams.where("a = ''").groupBy("b").agg(F.sum("docs").alias("n")).where("n > 1").orderBy("b")
    words = [r.b for r in vocab.select("b").collect()]
    number = {w: i for i, w in enumerate(words, 1)}
    v = len(words) + 1
    ids = F.broadcast(spark.createDataFrame(list(number.items()), "w string, i long"))
    single = grams.where("a = ''").join(ids, F.col("b") == F.col("w")).select("fold", "i", *levels).toPandas()
    pairs = grams.where("a <> ''").join(ids.select(F.col("w").alias("a"), F.col("i").alias("ia")), "a").join(ids.select(F.col("w").alias("b"), F.col("i").alias("ib")), "b")
    often = pairs.select((F.col("ia") * v + F.col("ib")).alias("key"), "fold", *levels).groupBy("key").agg(F.collect_list(F.struct("fold", *levels)).alias("own"), F.sum(sum(F.col(c) for c in levels)).alias("all"))
    both = often.where("all > 1.5").select("key", F.inline("own")).toPandas().sort_values(["fold", "key"])
    out = []
    for k in (0, 1):
        uni, one, two = np.zeros((v, LEVELS)), single[single["fold"] == k], both[both["fold"] == k]
        uni[one["i"].to_numpy(np.int64)] = one[levels].to_numpy(float)
        out.append(Counts(uni, two["key"].to_numpy(np.int64), two[levels].to_numpy(float).reshape(-1, LEVELS)))
    return number | dict.fromkeys(_STOPS, -1), out


def residual(scores: np.ndarray, levels: np.ndarray, raters: np.ndarray) -> float:
    """Squared error that is left when the scores are mapped monotonically to the levels."""
    return float((raters * (np.interp(scores, *isotonic(scores, levels, raters)) - levels) ** 2).sum())


def score_blocks(scored: DataFrame, names: list[str]) -> list[np.ndarray]:
    """For each of the named scores, the blocks (see ``pool``) of the levels by that score. They are pooled within ranges
    of the score on the executors, and only what is left of a range reaches the driver."""

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            k, x, total, w, error = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = np.column_stack([x, x, total, w, error])
            for i in np.unique(k).tolist():
                own[i] = pool(np.concatenate([own.get(i, rows[:0]), rows[k == i]]))
        for i, blocks in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), i, np.int32)), *map(pa.array, blocks.T)], names=["k", "x0", "x1", "total", "weight", "error"])

    total = F.round(F.col("level") * F.col("raters"))  # ratings are whole numbers: their sums are exact in any order
    rows = scored.select(F.posexplode(F.array(*names)).alias("k", "x"), total.alias("total"), F.col("raters").cast("double").alias("w"))
    points = rows.groupBy("k", "x").agg(F.sum("total").alias("t"), F.sum("w").alias("w"), F.sum(F.expr("total * total / w")).alias("squares")).select("k", "x", "t", "w", F.expr("squares - t * t / w").alias("error"))
    found = points.repartitionByRange("k", "x").sortWithinPartitions("k", "x").mapInArrow(pooled, "k int, x0 double, x1 double, total double, weight double, error double")
    blocks = found.toPandas().sort_values(["k", "x0"])
    return [blocks[blocks["k"] == k].drop(columns="k").to_numpy() for k in range(len(names))]


def fit(training: DataFrame) -> LevelModels:
    """Models of all rated texts. The texts of either fold are scored by models of the other one; by these scores the
    interpolation is chosen and the isotonic map is fitted."""
    vocab, counts = fold_counts(materialize(ngram_counts(training), "level-counts"))
    halves = training.sparkSession.sparkContext.broadcast([[interpolated(vocab, own, w) for own in counts] for w in WEIGHTS])
    names = [f"d{k}" for k in range(len(WEIGHTS))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.array(batch.column(0).to_pylist(), int)
            texts = batch.column(3).to_pylist()
            d = np.full((len(WEIGHTS), len(texts)), np.nan)
            for k in (0, 1):
                at = np.flatnonzero(fold == k)
                if len(at):
                    words = halves.value[0][1 - k].encode([texts[i] for i in at])  # one vocabulary in all
                    for own, models in zip(d, halves.value, strict=True):
                        own[at] = models[1 - k].scores(*words).difficulty
            yield pa.RecordBatch.from_arrays([*map(pa.array, d), batch.column(1), batch.column(2)], names=[*names, "level", "raters"])

    scored = training.select("fold", "level", "raters", "text").mapInArrow(score, ", ".join(f"{x} double" for x in names) + ", level double, raters long")
    scored = materialize(scored.where("NOT isnan(d0)"), "level-scores")
    if len(scored.head(2)) < 2:
        return interpolated(vocab, Counts.sum(counts), WEIGHTS[0])
    blocks = score_blocks(scored, names)
    left = [b[:, 4].sum() + residual(b[:, 0], b[:, 2] / b[:, 3], b[:, 3]) for b in blocks]
    best = int(np.argmin(left))
    model = interpolated(vocab, Counts.sum(counts), WEIGHTS[best])
    model.knots = knots(pool(blocks[best]))
    return model


SCHEMA = "doc_id long, n_words long, surprisal double, spread double, difficulty double, level double"


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, surprisal, spread, difficulty, level), one row per document: words, mean and spread of the
    sentences' least surprisal per word, level of least surprisal, and the reading level it is mapped to.

    Defined cases: null, blank and wordless texts have 0 words and null scores and level; so have texts without
    any known word; without ratings, or with a single rated text, every level is null; repeated documents are each
    scored; very long texts are scored whole; columns other than doc_id and text are never read.
    """
    fitted = fit(materialize(training_texts(documents, labels), "level-texts"))
    model = documents.sparkSession.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                own = m.difficulty([t or "" for t in part.column(1).to_pylist()])
                nan = np.isnan(own.difficulty)
                numbers = [pa.array(x, mask=nan) for x in (own.surprisal, own.spread, own.difficulty)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.words), *numbers, pa.array(g := m.graded(own.difficulty), mask=np.isnan(g))],
                                                 names=["doc_id", "n_words", "surprisal", "spread", "difficulty", "level"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCHEMA)
