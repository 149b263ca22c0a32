"""Freely entered values mapped to the entries of a reference list, unmatched ones reported.

Method: a BK-tree over the reference entries under a true metric (unrestricted Damerau-Levenshtein). The
triangle inequality prunes the tree, yet every entry within the threshold is returned; the closest wins.

A value is read in several ways before the search: without numbering, units and remarks around it, with its
parts turned back ("price, retail"), with shortened words completed from the list's own words, and as the two
languages that stand side by side. Each reading is searched; a reading counts only if all its parts mean the
same entry, so a value that shares a word with an entry and goes on differently stays unmatched.

A list of at most ``TREE_ENTRIES`` entries is one tree, sent to all executors; a longer one is cut into shards
by hash. Then a value's texts (its readings' parts, completed by the whole list's words) are looked up in every
shard, the nearest entries of all shards are merged text by text, ties included, and only then is the value read:
the result doesn't depend on how the list is cut.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.session import materialize

TREE_ENTRIES = 20_000
#: Values whose answer a task remembers at most.
CACHE = 200_000
#: Words around a header that say nothing about its meaning: remarks and units (fixed values).
REMARKS = {"pflicht", "obligatoire", "optional", "eur", "usd", "mm", "cm", "m", "g", "kg", "in", "ml", "l", "pflichtfeld", "required", "mandatory", "obligatorio"}
#: Digits written for letters (fixed values).
LEET = str.maketrans("013457", "oieast")


def distance(a: str, b: str, limit: int | None = None) -> int:
    """Damerau-Levenshtein distance with transpositions of any kind; a true metric.

    With a limit, limit + 1 stands for every distance above it; cells further than the limit from the diagonal
    can't lead to a smaller one and are left out.
    """
    if a == b:
        return 0
    n, m = len(a), len(b)
    top = n + m if limit is None else limit + 1
    band = top
    if abs(n - m) >= top:
        return top
    last: dict[str, int] = {}
    rows = [[top] * (m + 2), [min(top, j - 1) for j in range(m + 2)]]
    rows[1][0] = top
    for i in range(1, n + 1):
        row, before, match = [top] * (m + 2), rows[i], 0
        if i < top:
            row[1] = i
        x, least = a[i - 1], top
        first = i - band if i > band else 1
        for y in b[: first - 1]:  # where the letter stood last before the band
            if x == y:
                match = first - 1
        for j in range(first, min(m, i + band) + 1):
            y = b[j - 1]
            if x == y:
                v, k, col, match = before[j], 0, 0, j
            else:
                k, col = last.get(y, 0), match
                v = before[j] + 1
            w = row[j] if row[j] < before[j + 1] else before[j + 1]
            if w < v - 1:
                v = w + 1
            if k and col:
                w = rows[k][col] + (i - k) + (j - col) - 1
                if w < v:
                    v = w
            if v < top:
                row[j + 1] = v
                if v < least:
                    least = v
        last[x] = i
        rows.append(row)
        if least >= top and i > 1 and min(before[1:]) >= top:
            return top
    return min(top, rows[n + 1][m + 1])


def fold(text: str) -> str:
    """Letters and digits of a text, lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if c.isalnum())


def threshold(length: int) -> int:
    """Edits allowed for a folded text of this length: two at most, whole words differ by more."""
    return 0 if length < 4 else 1 if length < 6 else 2


class BKTree:
    """Burkhard-Keller tree: the children of a node stand under their distance from it.

    Each entry also has a set of bits, one for a letter's first occurrence, one for its second and so on. As many
    letters as one text has beyond another, so many edits lie between them at least, and no more than the longer one
    has letters. Where these bounds show that a node is too far and little stands below it, the triangle inequality
    is taken with them; else with the distance.
    """

    #: Entries below a node from which its exact distance is worth taking.
    MANY = 64

    def __init__(self, keys: list[str]):
        self.root: tuple[str, int, dict, list[int]] | None = None
        self.bit: dict[tuple[str, int], int] = {}
        for k in keys:
            self.add(k)

    def letters(self, text: str) -> int:
        bits, seen = 0, {}
        for c in text:
            n = seen[c] = seen.get(c, 0) + 1
            bits |= 1 << self.bit.setdefault((c, n), len(self.bit))
        return bits

    def add(self, key: str) -> None:
        own = (key, self.letters(key), {}, [1])
        if self.root is None:
            self.root = own
            return
        node, path = self.root, []
        while d := distance(key, node[0]):
            path.append(node)
            if d not in node[2]:
                node[2][d] = own
                for above in path:
                    above[3][0] += 1
                return
            node = node[2][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str]]:
        """Every entry within the radius: only children at d-radius to d+radius can hold any."""
        found, stack, mine = [], [self.root] if self.root else [], self.letters(key)
        while stack:
            entry, theirs, children, below = stack.pop()
            low, high = max((mine & ~theirs).bit_count(), (theirs & ~mine).bit_count()), max(len(key), len(entry))
            if children and low > radius + max(children) or not children and low > radius:
                continue
            if low <= radius or below[0] > self.MANY:
                low = high = d = distance(key, entry, None if children else radius)
                if d <= radius:
                    found.append((d, entry))
            stack += [child for at, child in children.items() if low - radius <= at <= high + radius]
        return found


def words_of(entries: list[tuple[str, str]]) -> set[str]:
    """The folded words of a list's entries."""
    return {f for t, _ in entries for w in re.findall(r"[^\W_]+", t) if (f := fold(w))}


class Reader:
    """How a value is read, given the list's words (sorted) and the nearest entry of a text."""

    def __init__(self, words: list[str]):
        self.words = words

    def nearest(self, key: str) -> tuple[int, str] | None:
        """Distance and id of the closest entry within the threshold; None if there is none or ids tie."""
        raise NotImplementedError

    def completions(self, token: str) -> list[str]:
        if len(token) < 2:
            return []
        at = bisect_right(self.words, token)
        return list(itertools.takewhile(lambda w: w.startswith(token), itertools.islice(self.words, at, None)))

    def part(self, text: str) -> tuple[int, str] | None:
        """Closest entry of one reading's part, in its order or turned back at a comma, shortened or full."""
        orders = [text]
        if "," in text:
            head, _, tail = text.partition(",")
            orders.append(f"{tail} {head}")
        best = None
        for order in orders:
            tokens = re.findall(r"[^\W_]+\.?", order)
            plain = [fold(t) for t in tokens]
            options = [[p, *self.completions(p)] if t.endswith(".") else [p] for t, p in zip(tokens, plain, strict=True)]
            for words in itertools.product(*options):
                hit = self.nearest("".join(words))
                # letters that a completion added are no evidence: the edits must suit what was written
                if hit and hit[0] <= threshold(sum(map(len, plain))) and (best is None or hit < best):
                    best = hit
        return best

    def match(self, raw: str) -> tuple[int, str] | None:
        """(distance, id) of the entry that the raw value means, or None."""
        best = None
        for parts in readings(raw):
            hits = [self.part(p) for p in parts]
            if all(hits) and len({i for _, i in hits}) == 1:
                hit = (max(d for d, _ in hits), hits[0][1])
                if best is None or hit < best:
                    best = hit
        if best is None:
            best = self._side_by_side(readings(raw)[0])
        return best

    def _side_by_side(self, parts: list[str]) -> tuple[int, str] | None:
        """Two entries of one meaning in a row without a mark between them."""
        if len(parts) != 1:
            return None
        tokens, best = parts[0].split(), None
        for k in range(1, len(tokens)):
            a, b = self.part(" ".join(tokens[:k])), self.part(" ".join(tokens[k:]))
            if a and b and a[1] == b[1] and (best is None or (a[0] + b[0], a[1]) < best):
                best = (a[0] + b[0], a[1])
        return best


class Reference(Reader):
    """A list, or a shard of it: its tree, the ids behind each folded entry and its words."""

    def __init__(self, entries: list[tuple[str, str]]):
        super().__init__(sorted(words_of(entries)))
        self.ids: dict[str, set[str]] = {}
        for term, ident in entries:
            if key := fold(term):
                self.ids.setdefault(key, set()).add(ident)
        self.tree = BKTree(sorted(self.ids))
        self.cache: dict[str, tuple[int, str] | None] = {}

    def closest(self, key: str) -> tuple[int, set[str]] | None:
        """Distance and ids of the closest entries within the threshold, ties included."""
        if key in self.ids:
            return 0, self.ids[key]
        found = self.tree.within(key, threshold(len(key)))
        best = min((d for d, _ in found), default=None)
        return None if best is None else (best, {i for d, e in found if d == best for i in self.ids[e]})

    def nearest(self, key: str) -> tuple[int, str] | None:
        if key not in self.cache:
            if len(self.cache) > CACHE:
                self.cache.clear()
            found = self.closest(key)
            self.cache[key] = (found[0], min(found[1])) if found and len(found[1]) == 1 else None
        return self.cache[key]


class Asked(Reader):
    """Gathers every text whose nearest entry a value's readings may ask for; those too long for any entry are left out."""

    def __init__(self, words: list[str], longest: int):
        super().__init__(words)
        self.longest = longest
        self.keys: set[str] = set()

    def nearest(self, key: str) -> None:
        if len(key) - threshold(len(key)) <= self.longest:
            self.keys.add(key)

    def of(self, raw: str) -> set[str]:
        self.keys = set()
        self.match(raw)
        return self.keys


class Answered(Reader):
    """Reads a value by the answers that all shards gave together."""

    answers: dict[str, tuple[int, str]] = {}

    def nearest(self, key: str) -> tuple[int, str] | None:
        return self.answers.get(key)


def repaired(raw: str) -> str:
    """Composed text; UTF-8 that was read as a single-byte code is read again."""
    if "Ã" in raw or "Â" in raw or "â€" in raw:
        for code in ("cp1252", "latin-1"):
            try:
                raw = raw.encode(code).decode("utf-8")
                break
            except UnicodeError:
                pass
    return unicodedata.normalize("NFC", raw)


def _words_read(text: str) -> str:
    def word(m: re.Match) -> str:
        w = m.group()
        return w.translate(LEET) if any(c.isalpha() for c in w) and any(c.isdigit() for c in w) else w

    return re.sub(r"[^\W_]+", word, text)


def readings(raw: str) -> list[list[str]]:
    """Ways to read a raw value, each as the parts that must mean the same."""
    text = re.sub(r"\s+", " ", repaired(raw)).strip()
    # marks that stand for spaces: "a---b" and "a.-.b" part, "a-b", "a_b" and "a.b" join
    text = re.sub(r"(?<=\S)([-_.])-\1(?=\S)", " - ", text)
    text = re.sub(r"[_]", " ", text)
    text = re.sub(r"(?<=[^\W\d_])\.(?=[^\W\d_])", ". ", text)
    text = re.sub(r"^\s*\(?\d+\s*[).:\-]+[\s\-_.]*(?=\D)", "", text)
    text = _words_read(text)
    text = re.sub(r"(?i)[\s\-]*\bin\s*[\-.]?\s*%", "", text)
    brackets = re.findall(r"[(\[{]([^)\]}]*)[)\]}]?", text)
    main = re.sub(r"[(\[{][^)\]}]*[)\]}]?", " ", text)
    parts = [p for p in re.split(r"\s+[-–—]+\s+|\s*[/|]\s*", main) if re.search(r"[^\W\d_]", p)]
    own = [p for p in parts if fold(p) not in REMARKS]
    inside = [b for b in brackets if re.search(r"[^\W\d_]", b) and fold(b) not in REMARKS]
    # a single hyphen joins words or parts a word and a remark: "launch-date", "lining-pflicht"
    own = [re.sub(r"(?i)[\s\-.]+(?:" + "|".join(sorted(REMARKS - {"in", "m", "g", "l"})) + r")\s*$", "", p) for p in own]
    own = [p for p in own if p.strip()]
    out = [own + inside] if own + inside else []
    if inside and own:
        out.append(["".join(own) + " " + " ".join(inside)])
    if len(own) > 1:
        out.append([" ".join(own)] + inside)
    return out or [[text]]


def map_values(df: DataFrame, value: str, reference: DataFrame, term: str, ident: str) -> DataFrame:
    """``df`` with ``match_id`` ('none' where unmatched, null where the value is null or blank) and ``match_distance``.

    Defined cases: null and blank values stay null; entries that are null or without letter or digit are
    ignored; equal entries of several ids tie and match nothing; ties between ids are unmatched; very long
    values match nothing that is shorter by more than the threshold; an empty list leaves all unmatched;
    all columns of ``df`` are kept and none but ``value`` is read (columns that bear the results' names are replaced).
    """
    entries = reference.where(F.col(term).isNotNull() & F.col(ident).isNotNull()).select(F.col(term).cast("string").alias("t"), F.col(ident).cast("string").alias("i"))
    n = entries.count()
    sc = df.sparkSession.sparkContext
    schema = "distance int, id string"
    if n <= TREE_ENTRIES:
        held = sc.broadcast(sorted((r.t, r.i) for r in entries.collect()))

        @F.pandas_udf(schema)
        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            ref = Reference(held.value)
            seen: dict[str, tuple[int, str] | None] = {}
            for values in batches:
                if len(seen) > CACHE:
                    seen.clear()
                for v in values.dropna().unique():
                    if v not in seen:
                        seen[v] = ref.match(v)
                hits = [seen.get(v) if v is not None else None for v in values]
                yield pd.DataFrame({"distance": pd.array([h[0] if h else None for h in hits], "Int32"), "id": [h[1] if h else None for h in hits]})

        found = df.withColumn("_hit", look_up(F.col(value)))
    else:
        found = _sharded(df, value, entries, -(-n // TREE_ENTRIES))
    filled = F.col(value).rlike("[^\\s\\p{Z}]")
    return found.withColumn("match_id", F.when(filled, F.coalesce("_hit.id", F.lit("none")))).withColumn("match_distance", F.col("_hit.distance")).drop("_hit")


def _sharded(df: DataFrame, value: str, entries: DataFrame, shards: int) -> DataFrame:
    """The texts that the distinct values' readings ask for are searched in every shard of the list, each once; the
    nearest entries of all shards are merged by text, and the values are read from the merged answers. A search task
    holds its own shard only, the reading tasks the list's distinct words; values stream past them in batches."""
    sc = df.sparkSession.sparkContext
    held, words, longest = [], set(), 0
    for s in range(shards):
        own = sorted((r.t, r.i) for r in entries.where(F.pmod(F.xxhash64("t"), F.lit(shards)) == s).collect())
        words |= words_of(own)
        longest = max([longest, *(len(fold(t)) for t, _ in own)])
        held.append(sc.broadcast(own))
    known = sc.broadcast(sorted(words))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Asked(known.value, longest)
        for pdf in batches:
            yield pd.DataFrame([(v, k) for v in pdf["v"] for k in sorted(reader.of(v))], columns=["v", "key"])

    values = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct()
    asked = materialize(values.mapInPandas(ask, "v string, key string"), "vocabulary-asked")
    keys = materialize(asked.select("key").distinct(), "vocabulary-keys")
    found = None
    for own in held:

        def search(batches: Iterator[pd.DataFrame], own=own) -> Iterator[pd.DataFrame]:
            ref = Reference(own.value)
            for pdf in batches:
                hits = [(k, h[0], min(h[1]), max(h[1])) for k in pdf["key"] if (h := ref.closest(k))]
                yield pd.DataFrame(hits, columns=["key", "distance", "lo", "hi"])

        one = keys.mapInPandas(search, "key string, distance int, lo string, hi string")
        found = one if found is None else found.union(one)
    near = found.groupBy("key").agg(F.min(F.struct("distance", "lo")).alias("a"), F.max(F.struct((-F.col("distance")).alias("d"), "hi")).alias("b"))
    near = near.where("a.lo = b.hi").select("key", "a.distance", F.col("a.lo").alias("id"))
    answers = asked.join(near, "key").groupBy("v").agg(F.collect_list(F.struct("key", "distance", "id")).alias("hits"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Answered(known.value)
        for pdf in batches:
            out = []
            for v, hits in zip(pdf["v"], pdf["hits"], strict=True):
                reader.answers = {h["key"]: (int(h["distance"]), h["id"]) for h in hits}
                if hit := reader.match(v):
                    out.append((v, *hit))
            yield pd.DataFrame(out, columns=["v", "distance", "id"])

    best = answers.mapInPandas(read, "v string, distance int, id string").select(F.col("v").alias("_value"), F.struct("distance", "id").alias("_hit"))
    return df.join(best, df[value] == best["_value"], "left").drop("_value")
