"""Evaluation texts that leaked into training text.

Method: template canonicalization. Numbers, units and names become typed placeholders, by their form on either side:
digits are numbers; item words that stand with a capital within a sentence and never without one are names, and so is,
in a document, every word that no item has. Windows of template words are hash-joined with the windows of every
document. In the items met, shorter template windows are aligned and the slots behind their placeholders are compared:
windows with the same fillers that stand in order are the item's own text, windows with a one-to-one exchange of
fillers a re-parameterised item.

The placeholders come from all items before these are cut into shards of at most ``SHARD_CHARS`` characters. One
narrow pass over all documents and whole texts finds the candidates of a single shard; of several, it keeps the documents
with a window in a bit filter over all items' windows, and each shard reads only those. Nothing of the corpus is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from weftline.session import materialize

SHARD_CHARS = 4_000_000
#: Words of a template window that finds candidates, and content words it must hold.
WINDOW = 4
CONTENT = 2
#: Words of a template window that is aligned, with at least one content word.
ALIGNED = 3
#: Words of an item in order that make a leak; a shorter item must be held wholly.
LEAST_WORDS = 14
CHUNK = 256
#: Bits of the filter for each window of the items, and its most bits (beyond, more documents pass it, none less).
FILTER_ROOM = 16
FILTER_BITS = 1 << 30

NUM, NAME, UNIT = 1, 2, 3
#: Words for units after a number (fixed values).
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "g", "kg", "mg", "lb", "oz", "ml", "cl", "l", "euro", "eur", "usd", "percent", "prozent"]

_MARKUP = re.compile(r"<[^<>]*>|&#?\w+;")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.?!\n]+")


def plain(text: str) -> str:
    """Composed text without markup and invisible characters."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    return _MARKUP.sub(" ", text) if "<" in text or "&" in text else text


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text).casefold())


def is_number(w: str) -> bool:
    return w[0].isdigit() and w.isdigit()


class Kinds(dict):
    """Number of each template word; placeholders for the others, by form."""

    def __missing__(self, w: str) -> int:
        return NUM if w.isdigit() else NAME


def kinds(flags: list[tuple[str, bool, bool]]) -> Kinds:
    """From all items' words with whether they stand in lower case, and with a capital within a sentence."""
    out = Kinds({w: NAME for w, lower, capital in flags if capital and not lower and not is_number(w)} | dict.fromkeys(UNITS, UNIT))
    for w in sorted(w for w, _, _ in flags if w not in out and not is_number(w)):
        out[w] = len(out) + 4
    return out


def window_codes(ids: np.ndarray, width: int, least: int) -> np.ndarray:
    """Hash of the template window that starts at each word; -1 where it holds a text's end (0) or too little content."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, content, whole = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(width):
        part = ids[k : k + n]
        code = (code ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
        content += part > UNIT
        whole &= part > 0
    return np.where(whole & (content >= least), (code >> np.uint64(1)).astype(np.int64), -1)


class Items:
    """The template windows and words of a shard of items."""

    def __init__(self, rows: list[Row], kind: Kinds, stock: set[str]):
        self.kind = kind
        self.ids = [r.item_id for r in rows]  # items are known by their place in it, as an id may come again with another text
        self.words: dict[int, list[str]] = {}
        self.starts: dict[str, list[tuple[list[str], int]]] = defaultdict(list)
        self.windows: dict[int, set[int]] = defaultdict(set)
        self.places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.filled: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for n, r in enumerate(rows):
            own = [w for w in map(words, _SENTENCE.split(plain(r.text))) if w]
            if len(own) > 1 and " ".join(own[0]) in stock:
                own = own[1:]
            ws = self.words[n] = [w for x in own for w in x]
            if 0 < len(ws) < LEAST_WORDS:
                self.starts[ws[0]].append((ws, n))
                continue
            ids = np.array([kind[w] for w in ws], np.int64)
            for c in set(window_codes(ids, WINDOW, CONTENT).tolist()) - {-1}:
                self.windows[c].add(n)
            codes = window_codes(ids, ALIGNED, 1)
            order = np.lexsort((-np.arange(len(codes)), codes))  # of one code the last place first, so that a chain takes one of them
            order = order[codes[order] >= 0]
            self.places[n] = (codes[order], order)
            for three in set(zip(ws, ws[1:], ws[2:], strict=False)):
                self.filled[three].append(n)
        self.filled = dict(self.filled)
        self.known = np.array(sorted(self.windows), np.int64)

    def candidates(self, docs: list[list[str]]) -> tuple[dict[int, Counter[int]], np.ndarray, list[int]]:
        """Items with template windows in common and how many, by document index; the documents' word numbers in a
        row and where each one ends."""
        kind, ids, ends = self.kind.__getitem__, [], []
        for ws in docs:
            ids += map(kind, ws)
            ids.append(0)  # no window across documents
            ends.append(len(ids))
        row = np.array(ids, np.int64)
        codes = window_codes(row, WINDOW, CONTENT)
        found: dict[int, Counter[int]] = defaultdict(Counter)
        if len(self.known) and len(codes):
            hit = np.flatnonzero(codes >= 0)
            at = np.searchsorted(self.known, codes[hit]).clip(max=len(self.known) - 1)
            hit = hit[self.known[at] == codes[hit]]
            for d, c in zip(np.searchsorted(ends, hit, side="right").tolist(), codes[hit].tolist(), strict=True):
                found[d].update(self.windows[c])
        return found, row, ends

    def worth_comparing(self, found: Counter[int], ws: list[str]) -> list[int]:
        """Those of the items met that have enough windows in common for either kind of leak: with the same fillers, or
        with any."""
        filled, n = self.filled, Counter()
        for three in zip(ws, ws[1:], ws[2:], strict=False):
            if three in filled:
                n.update(filled[three])
        return [item for item, any_ in sorted(found.items()) if ALIGNED * n[item] >= LEAST_WORDS or any_ >= LEAST_WORDS]

    def held_short(self, ws: list[str]) -> set[int]:
        """Short items that stand wholly in the document."""
        starts = self.starts
        return {item for p, w in enumerate(ws) if w in starts for own, item in starts[w] if ws[p : p + len(own)] == own} if starts else set()

    def compared(self, item: int, ws: list[str], codes: np.ndarray) -> tuple[int, int, int, bool]:
        """Words of the item that stand in order with the same fillers; template words in order with any fillers;
        exchanged fillers among them, and whether the exchange is one to one."""
        mine, (known, place) = self.words[item], self.places[item]
        at = np.flatnonzero(codes >= 0)
        first, last = np.searchsorted(known, codes[at]), np.searchsorted(known, codes[at], side="right")
        met = np.flatnonzero(last > first)
        pairs = [(p, q) for p, a, b in zip(at[met].tolist(), first[met].tolist(), last[met].tolist(), strict=True) for q in place[a:b].tolist()]
        same = [(p, q) for p, q in pairs if ws[p : p + ALIGNED] == mine[q : q + ALIGNED]]
        own = len(self._covered(same))
        if own < LEAST_WORDS and ALIGNED * len(pairs) < 2 * LEAST_WORDS:  # too few for either kind
            return own, own, 0, True
        covered = self._covered(pairs)
        slots = {(mine[q], ws[p]) for q, p in covered.items() if self.kind[mine[q]] <= UNIT}
        names = {(a, b) for a, b in slots if not is_number(a)}
        one_to_one = len({a for a, _ in names}) == len(names) == len({b for _, b in names})
        return own, len(covered), sum(a != b for a, b in slots), one_to_one

    @staticmethod
    def _covered(pairs: list[tuple[int, int]]) -> dict[int, int]:
        """Item places covered by the longest chain of windows that rises in both texts, with the document's places."""
        tails, tail_hit, back = [], [], []
        for n, (_, q) in enumerate(pairs):
            k = bisect_left(tails, q)
            back.append(tail_hit[k - 1] if k else -1)
            tails[k : k + 1], tail_hit[k : k + 1] = [q], [n]
        covered, n = {}, tail_hit[-1] if tail_hit else -1
        while n >= 0:
            p, q = pairs[n]
            for k in range(ALIGNED):
                covered.setdefault(q + k, p + k)
            n = back[n]
        return covered


def word_flags(items: DataFrame) -> DataFrame:
    """(word, lower, capital): the distinct words of all items, whether they stand in lower case anywhere, and with a
    capital within a sentence."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[bool]] = defaultdict(lambda: [False, False])
            for t in batch.column(0).to_pylist():
                for sentence in _SENTENCE.split(plain(t)):
                    for i, w in enumerate(_WORD.findall(sentence)):
                        for x in _WORD.findall(w.casefold()):
                            own[x][0] |= w.islower()
                            own[x][1] |= i > 0 and w.istitle()
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), *(pa.array([f[k] for f in own.values()], pa.bool_()) for k in (0, 1))], names=["word", "lower", "capital"])

    flags = items.select("text").mapInArrow(read, "word string, lower boolean, capital boolean")
    return flags.groupBy("word").agg(F.max("lower").alias("lower"), F.max("capital").alias("capital"))


def shared_openings(items: DataFrame) -> DataFrame:
    """(sentence): first sentences, folded, that several items begin with."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [next((" ".join(w) for w in map(words, _SENTENCE.split(plain(t))) if w), None) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=["item_id", "sentence"])

    firsts = items.select("item_id", "text").mapInArrow(first, "item_id long, sentence string").where("sentence IS NOT NULL")
    return firsts.groupBy("sentence").agg((F.min("item_id") < F.max("item_id")).alias("shared")).where("shared").select("sentence")


class WindowFilter:
    """Bits of all items' windows: no window that an item has is missed."""

    def __init__(self, n: int):
        self.bits = np.zeros(max(1024, min(FILTER_BITS, 1 << max(0, n * FILTER_ROOM - 1).bit_length())), np.bool_)

    def _at(self, codes: np.ndarray) -> list[np.ndarray]:
        return [(codes >> s) & (len(self.bits) - 1) for s in (0, 31)]

    def add(self, codes: np.ndarray) -> None:
        for at in self._at(codes):
            self.bits[at] = True

    def packed(self) -> np.ndarray:
        return np.packbits(self.bits)

    @classmethod
    def unpacked(cls, packed: np.ndarray) -> WindowFilter:
        out = cls(0)
        out.bits = np.unpackbits(packed).astype(np.bool_)
        return out

    def holds(self, codes: np.ndarray) -> np.ndarray:
        return (codes >= 0) & np.logical_and.reduce([self.bits[at] for at in self._at(codes)])


SCHEMA = "doc_id long, item_id long, own_words int, template_words int, changed_slots int, kind string"


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, own_words, template_words, changed_slots, kind) of every document and leaked item.

    kind is ``own text`` where at least LEAST_WORDS words of the item stand in the document in order with the same
    fillers, or a shorter item stands there wholly; else ``other fillers`` where twice as many template words do and
    fillers are exchanged one for one. An opening sentence that several items share and that has no number is a
    stock instruction line and counts for none (unless it is the whole item); anything else that items share, the
    further sentences of a common passage among it, counts for every item that holds it. Defined cases: null, blank and wordless texts hold nothing; null items and items
    without words leak nowhere; equal items leak together; an item id with
    several texts leaks by any of them; repeated documents are each reported; empty tables give
    an empty result; other columns are never read.
    """
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // SHARD_CHARS))
    sc = documents.sparkSession.sparkContext
    kind = kinds([(r.word, r.lower, r.capital) for r in word_flags(rows).collect()])  # the items' distinct words
    stock = {r.sentence for r in shared_openings(rows).collect() if not any(map(is_number, r.sentence.split()))}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = []
    for n in range(shards):
        own = Items((rows if shards == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == n)).collect(), kind, stock)
        held.append((sc.broadcast(own), own.known, set(own.starts)))
    if shards > 1:
        docs = _marked(docs, [codes for _, codes, _ in held], set().union(*(starts for _, _, starts in held)), kind)
    return reduce(DataFrame.union, [docs.mapInArrow(_finder(own), SCHEMA) for own, _, _ in held])


def _marked(docs: DataFrame, codes: list[np.ndarray], starts: set[str], kind: Kinds) -> DataFrame:
    """The documents that may have a window or a short item in common with any shard, written as a table."""
    bits = WindowFilter(sum(map(len, codes)))
    for own in codes:
        bits.add(own)
    held = docs.sparkSession.sparkContext.broadcast((kind, bits.packed(), starts))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, packed, starts = held.value
        bits, number = WindowFilter.unpacked(packed), kind.__getitem__
        for batch in batches:
            keep = []
            for t in batch.column(1).to_pylist():
                ws = words(t or "")
                keep.append(bits.holds(window_codes(np.array([number(w) for w in ws], np.int64), WINDOW, CONTENT)).any() or not starts.isdisjoint(ws))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return materialize(docs.mapInArrow(mark, docs.schema), "leak-marked")


def _finder(held):  # noqa: ANN001, ANN202
    """The pass of one shard's items over documents."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                ids = batch.column(0).slice(i, CHUNK).to_pylist()
                docs = [words(t or "") for t in batch.column(1).slice(i, CHUNK).to_pylist()]
                found, row, ends = known.candidates(docs)
                best: dict[tuple[int, int], tuple] = {}
                hits = [(d, item, (len(known.words[item]), len(known.words[item]), 0, "own text")) for d, ws in enumerate(docs) for item in sorted(known.held_short(ws))]
                for d, items in found.items():
                    codes = window_codes(row[(ends[d - 1] if d else 0) : ends[d] - 1], ALIGNED, 1)
                    for item in known.worth_comparing(items, docs[d]):
                        own, template, changed, consistent = known.compared(item, docs[d], codes)
                        if own >= LEAST_WORDS:
                            hits.append((d, item, (own, template, changed, "own text")))
                        elif template >= 2 * LEAST_WORDS and changed and consistent:
                            hits.append((d, item, (own, template, changed, "other fillers")))
                for d, item, what in hits:  # of an id with several texts the one that most words are held of
                    best[d, known.ids[item]] = max(what, best.get((d, known.ids[item]), what))
                out = [(ids[d], item, *what) for (d, item), what in best.items()]
                if out:
                    cols = list(zip(*out, strict=True))
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "own_words", "template_words", "changed_slots", "kind"])

    return find
