"""Several values packed in one field: one value per row, with its position.

Method: expectation-maximisation segmentation. A field is cut at its sure marks (line breaks, semicolons,
bars, bullets) and at doubled commas and slashes; single commas, slashes, plus signs and spaced dashes may
cut or belong to a value (decimals, dates, ranges). They span a lattice over the field, quoted spans and
full dates being atomic. The model has, for each column (property), the frequency of each value and of each value shape, and
how often each kind of mark cuts; it is learned from all fields of the column by forward-backward counts and
renewed in a few rounds; Viterbi then takes the likeliest cuts.

The lattices of the distinct ambiguous fields are made once and written: each segment with the hashes of its value
and of its shapes. A round looks their counts up and adds up, by hash, what is expected of each. Only keys that such
segments ask for and that stand more than once are in the model, exactly, at 16 bytes each; a key that stands once says
nothing to the field that it comes from. Values longer than ``JOINED`` undecided marks may be as long as they are; they
are valued by their length alone, in linear time.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import materialize

#: Undecided marks up to which a value's own frequency is learned.
JOINED = 12
#: Cut fields that a task remembers at most.
CACHE = 200_000
#: Keys that are sent to all tasks at most (16 bytes each). Where more are asked for and stand more than once, their
#: counts are joined to the lattices instead, with the same result.
MODEL_KEYS = 20_000_000

#: Weight in the first rounds, and from then on, of what a kind of mark mostly does in its column against the values
#: beside it: at first mostly the values decide; at the end the marks weigh more, else values that return
#: together in a few records are taken for one.
ROUND_WEIGHTS = (1.0, 3.0)
MARK_WEIGHT = 6.0
#: Share of the marks whose expected cuts may still move when the rounds end.
SETTLED = 1e-4

_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“", "‘": "’", "‹": "›", "”": "”"}
_SURE = re.compile(r"\s*(?:\\r\\n|\\n|\\r|\\t|[\r\n\t  \x0b\x0c]|[;|•·]|,,+|//+)\s*")
_MAYBE = re.compile(r"\s*[,/+]\s*|\s+[-–—]+\s+|^[-–—]\s+|\s+[-–—]$")
#: Without any of these an entry is one value.
_ANY_MARK = "[\\\\;|•·,/+\\t\\r\\n\\x0b\\x0c\\u0085\\u2028\\u2029]|[-–—][\\s\\p{Z}\\x1c-\\x1f\\u0085]|[\\s\\p{Z}\\x1c-\\x1f\\u0085][-–—]"
#: Runs in which nothing begins or ends, and of digits.
_DULL = re.compile(r"[^\s,/+\-–—;|•·\\\d" + "".join(map(re.escape, _QUOTES)) + r"]+")
_DIGITS = re.compile(r"\d+")
#: A full date is one atom.
_DATE = re.compile(r"(?:(?:0?[1-9]|[12]\d|3[01])([/.\-])(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d|(?:19|20)\d\d([/.\-])(?:0?[1-9]|1[0-2])\2(?:0?[1-9]|[12]\d|3[01]))(?!\d)")


def _quoted_end(s: str, i: int) -> int:
    """Where the quoted span that begins at i ends (behind its closing mark), or -1 if it is none."""
    close = _QUOTES[s[i]]
    j = s.find(close, i + 1)
    while j > 0:
        rest = s[j + 1 :]
        if not rest.strip() or _SURE.match(rest) or _MAYBE.match(rest):
            return j + 1 if s[i + 1 : j].strip() else -1
        j = s.find(close, j + 1)
    return -1


def fields(entry: str) -> list[list[str]]:
    """The fields of an entry between sure marks; each is [atom, mark, atom, mark, ..., atom].

    Atoms are trimmed; a quoted span keeps its quotes and is one atom, and so is a full date; empty atoms at either side of a mark
    that may cut are dropped with the mark.
    """
    out, own, start, i, fresh = [], [], 0, 0, True
    n = len(entry)
    while i < n:
        if m := _DULL.match(entry, i):
            i, fresh = m.end(), False
            continue
        c = entry[i]
        if fresh and c in _QUOTES and (j := _quoted_end(entry, i)) > 0:
            i, fresh = j, False
            continue
        if c.isdigit() and not (i > start and entry[i - 1].isdigit()) and (m := _DATE.match(entry, i) or _DIGITS.match(entry, i)):
            i, fresh = m.end(), False
            continue
        if m := _SURE.match(entry, i):
            own.append(entry[start:i].strip())
            out.append(own)
            own, i, fresh = [], m.end(), True
            start = i
            continue
        if m := (_MAYBE.match(entry, i) if c in ",/+-–—" or c.isspace() else None):
            own += [entry[start:i].strip(), m.group()]
            i, fresh = m.end(), True
            start = i
            continue
        if not c.isspace():
            fresh = False
        i += 1
    own.append(entry[start:].strip())
    out.append(own)
    return [t for t in map(_trimmed, out) if t]


def _trimmed(f: list[str]) -> list[str]:
    """Without empty atoms, each with one of the marks beside it."""
    atoms: list[str] = []
    for k in range(0, len(f), 2):
        if f[k]:
            if atoms:
                atoms.append(f[k - 1])
            atoms.append(f[k])
    return atoms


def unquoted(v: str) -> str:
    v = v.strip()
    if len(v) > 1 and v[0] in _QUOTES and v[-1] == _QUOTES[v[0]]:
        return v[1:-1].strip()
    return v


def is_quoted(atom: str) -> bool:
    return len(atom) > 1 and atom[0] in _QUOTES and atom[-1] == _QUOTES[atom[0]]


_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")


def shapes(v: str) -> tuple[str, float, str, float]:
    """A value with its numbers masked (whole or decimal), and with its words masked too; each with the log
    chance of what is masked. Masked numbers make 3,5% cotton one of a kind with 43% cotton."""
    digits, letters = sum(map(str.isdigit, v)), sum(map(str.isalpha, v))
    masked, numbers = _NUMBER.subn("#", v)
    marks = len(v) - len(masked) - digits + numbers
    return masked, -2.303 * digits - marks, re.sub(r"[^\W\d_]+", "a", masked), -2.303 * digits - marks - 3.0 * letters


def prior(kind: str) -> float:
    """How likely a kind of mark cuts before anything is learned: commas between digits are mostly decimal
    marks, spaced marks mostly cut."""
    return 0.1 if kind == ",0000" else 0.9 if kind[1:3] == "11" else 0.5


def _kind(mark: str, left: str, right: str) -> str:
    """Kind of a mark: the mark, whether it is spaced, and what stands beside it."""
    side = lambda c: "0" if c.isdigit() else "a" if c.isalpha() else "q" if c in _QUOTES or c in _QUOTES.values() else "."
    return f"{mark.strip()}{int(mark[:1].isspace())}{int(mark[-1:].isspace())}{side(left[-1:])}{side(right[:1])}"


def key_hash(kind: str, col: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{col}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def value_keys(col: str, v: str) -> tuple[int, int, int, float, float, float]:
    """Hashes of a value, of it with masked numbers and of its form, the log chances of what is masked, and the log
    chance of a value never seen, by its length."""
    key = unquoted(v).casefold()
    masked, digits, form, chance = shapes(key)
    return key_hash("v", col, key), key_hash("d", col, masked), key_hash("s", col, form), digits, chance, UNSEEN - PER_CHARACTER * (len(key) + 1)


#: Log share of values never seen, and what each of their characters costs.
UNSEEN = math.log(0.05)
PER_CHARACTER = 3.5


@dataclass
class Lattices:
    """Fields of a batch as flat arrays: segments of one field after another (by end, from the nearest start on), the
    marks of one field after another, and what long values need of fields that can have them."""

    cols: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    segments: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    hv: list[int] = field(default_factory=list)
    hd: list[int] = field(default_factory=list)
    hs: list[int] = field(default_factory=list)
    digits: list[float] = field(default_factory=list)
    form: list[float] = field(default_factory=list)
    floor: list[float] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    lengths: list[list[int] | None] = field(default_factory=list)
    quoted: list[list[bool] | None] = field(default_factory=list)
    seen: np.ndarray | None = None  # counts of hv, hd and hs, where they were joined

    def add(self, col: str, f: list[str]) -> None:
        n, before = len(f) // 2 + 1, len(self.start)
        quoted = [is_quoted(f[2 * k]) for k in range(n)]
        for end in range(n):
            for start in range(end, max(-1, end - JOINED - 1), -1):
                if start < end and (quoted[start] or quoted[end]):
                    break
                hv, hd, hs, digits, form, floor = value_keys(col, "".join(f[2 * start : 2 * end + 1]))
                self.start.append(start); self.end.append(end); self.hv.append(hv); self.hd.append(hd); self.hs.append(hs)  # noqa: E702
                self.digits.append(digits); self.form.append(form); self.floor.append(floor)  # noqa: E702
        self.cols.append(col)
        self.sizes.append(n)
        self.segments.append(len(self.start) - before)
        self.kinds += [_kind(f[2 * k + 1], f[2 * k], f[2 * k + 2]) for k in range(n - 1)]
        long = n > JOINED + 1
        self.lengths.append([len(x) for x in f] if long else None)
        self.quoted.append(quoted if long else None)

    #: Per field, as a table holds it.
    SCHEMA = ("col string, size int, start array<int>, end array<int>, hv array<long>, hd array<long>, hs array<long>, digits array<double>, form array<double>, floor array<double>, "
              "kinds array<string>, lengths array<int>, quoted array<boolean>")

    def frame(self) -> pd.DataFrame:
        at = np.concatenate([[0], np.cumsum(self.segments)])
        mark = np.concatenate([[0], np.cumsum([n - 1 for n in self.sizes])])
        cut = lambda xs, where: [xs[a:b] for a, b in zip(where, where[1:], strict=False)]
        return pd.DataFrame({"col": self.cols, "size": self.sizes, **{k: cut(getattr(self, k), at) for k in ("start", "end", "hv", "hd", "hs", "digits", "form", "floor")},
                             "kinds": cut(self.kinds, mark), "lengths": self.lengths, "quoted": self.quoted})

    @classmethod
    def of_frame(cls, pdf: pd.DataFrame) -> Lattices:
        flat = lambda name: np.concatenate([np.asarray(x) for x in pdf[name]]) if len(pdf) else np.zeros(0)
        m = [len(x) for x in pdf["start"]]
        seen = np.hstack([np.asarray(x, float).reshape(3, n) for x, n in zip(pdf["seen"], m, strict=True)]) if "seen" in pdf and len(pdf) else None
        return cls(pdf["col"].tolist(), pdf["size"].tolist(), m, *(flat(k) for k in ("start", "end", "hv", "hd", "hs", "digits", "form", "floor")),
                   [k for own in pdf["kinds"] for k in own], list(pdf["lengths"]), list(pdf["quoted"]), seen)

    def some(self, at: np.ndarray) -> Lattices:
        """The fields at these places."""
        segment = np.concatenate([[0], np.cumsum(self.segments)])
        mark = np.concatenate([[0], np.cumsum(np.asarray(self.sizes) - 1)])
        rows = np.concatenate([np.arange(segment[j], segment[j + 1]) for j in at])
        return Lattices(*([getattr(self, name)[j] for j in at] for name in ("cols", "sizes", "segments")), *(np.asarray(getattr(self, name))[rows] for name in ("start", "end", "hv", "hd", "hs", "digits", "form", "floor")),
                        [x for j in at for x in self.kinds[mark[j] : mark[j + 1]]], [self.lengths[j] for j in at], [self.quoted[j] for j in at], None if self.seen is None else self.seen[:, rows])


@dataclass
class Model:
    """Counts of values and shapes by hash (sorted; those of more than one), values per column, and per column and kind
    of mark how often it cut of how many."""

    keys: np.ndarray
    counts: np.ndarray
    values: dict[str, float]
    cuts: dict[tuple[str, str], tuple[float, float]]
    mark_weight: float = MARK_WEIGHT

    def got(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each key, less what the field at hand gave itself."""
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.searchsorted(self.keys, hashes).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, np.maximum(0.0, self.counts[at] - 1), 0.0)

    def segment_values(self, own: Lattices) -> np.ndarray:
        """Log chance of each segment as a value."""
        n = np.repeat([self.values.get(c, 0.0) + 1 for c in own.cols], own.segments)
        counts = [self.got(np.asarray(h, np.int64)) for h in (own.hv, own.hd, own.hs)] if own.seen is None else np.maximum(0.0, own.seen - 1)
        seen = [c / n for c in counts]
        known = 0.4 * seen[0] + 0.4 * seen[1] * np.exp(np.maximum(-600, own.digits)) + 0.15 * seen[2] * np.exp(np.maximum(-600, own.form))
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(known), own.floor)

    def cut(self, col: str, kind: str) -> tuple[float, float]:
        """Log chances that a mark of this kind cuts, and that it doesn't."""
        p = prior(kind)  # then all columns' share, then the column's own
        for c in ("*", col):
            yes, every = self.cuts.get((c, kind), (0.0, 0.0))
            p = (yes + 4 * p) / (max(every, yes) + 4)
        p = min(max(p, 1e-3), 1 - 1e-3)
        return self.mark_weight * math.log(p), self.mark_weight * math.log(1 - p)

    def mark_cuts(self, own: Lattices) -> tuple[list[float], list[float]]:
        known: dict[tuple[str, str], tuple[float, float]] = {}
        cuts, keeps, k = [], [], 0
        for col, n in zip(own.cols, own.sizes, strict=True):
            for kind in own.kinds[k : k + n - 1]:
                if (col, kind) not in known:
                    known[col, kind] = self.cut(col, kind)
                cuts.append(known[col, kind][0])
                keeps.append(known[col, kind][1])
            k += n - 1
        return cuts, keeps


@dataclass
class Long:
    """What a value of more than JOINED marks gains at its start and at its end; quoted atoms part such values."""

    at_start: list[float]
    at_end: list[float]
    quoted: list[bool]

    @classmethod
    def of(cls, lengths: list[int] | None, quoted: list[bool] | None, keeps: list[float]) -> Long | None:
        if lengths is None:
            return None
        ends = np.cumsum(lengths)[::2]  # characters up to each atom's end
        starts = ends - np.asarray(lengths)[::2]
        inside = np.concatenate([[0.0], np.cumsum(keeps)])
        return cls((PER_CHARACTER * starts - inside).tolist(), (UNSEEN - PER_CHARACTER * (ends + 1) + inside).tolist(), list(quoted))


def best_path(starts: list[list[tuple[int, float]]], cuts: list[float], long: Long | None) -> list[tuple[int, int]]:
    """The likeliest segments of a field (Viterbi), (start, end) from the first on; ties go to fewer cuts. ``starts`` has,
    for each end, the starts with the segment's log weight."""
    best: list[tuple[float, int]] = []
    top, waiting = (-math.inf, 0), 0  # the best start of a long value so far, and the first that it may have
    for end, own in enumerate(starts):
        found = max(((best[s - 1][0] + cuts[s - 1] if s else 0.0) + w, -s) for s, w in own)
        if long:
            if long.quoted[end]:
                top, waiting = (-math.inf, 0), end + 1
            elif (s := end - JOINED - 1) >= waiting:
                top = max(top, ((best[s - 1][0] + cuts[s - 1] if s else 0.0) + long.at_start[s], -s))
            if top[0] > -math.inf:
                found = max(found, (top[0] + long.at_end[end], top[1]))
        best.append(found)
    path, end = [], len(starts) - 1
    while end >= 0:
        path.append((-best[end][1], end))
        end = path[-1][0] - 1
    return path[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def chances(starts: list[list[tuple[int, float]]], cuts: list[float], long: Long | None) -> tuple[list[list[float]], list[float]]:
    """Chance of each segment, and that each mark cuts (forward-backward)."""
    size = len(starts)
    ahead: list[float] = []
    total, waiting = -math.inf, 0
    for end, own in enumerate(starts):
        found = -math.inf
        for s, w in own:
            found = _log_add(found, (ahead[s - 1] + cuts[s - 1] if s else 0.0) + w)
        if long:
            if long.quoted[end]:
                total, waiting = -math.inf, end + 1
            elif (s := end - JOINED - 1) >= waiting:
                total = _log_add(total, (ahead[s - 1] + cuts[s - 1] if s else 0.0) + long.at_start[s])
            found = _log_add(found, total + long.at_end[end])
        ahead.append(found)
    after = [-math.inf] * size  # weight of all that follows a cut before each atom
    back = [-math.inf] * size  # and of all that follows each end
    back[-1] = 0.0
    closing, limit = -math.inf, size  # long values that may end behind a start, and where the next quoted atom is
    for end in range(size - 1, -1, -1):
        if end + 1 < size:
            back[end] = cuts[end] + after[end + 1]
        for s, w in starts[end]:
            after[s] = _log_add(after[s], w + back[end])
        if long:
            if long.quoted[end]:
                closing, limit = -math.inf, end
            elif (e := end + JOINED + 1) < limit:
                closing = _log_add(closing, long.at_end[e] + back[e])
                after[end] = _log_add(after[end], long.at_start[end] + closing)
    every = ahead[-1]
    own = [[math.exp(min(0.0, (ahead[s - 1] + cuts[s - 1] if s else 0.0) + w + back[end] - every)) for s, w in of_end] for end, of_end in enumerate(starts)]
    return own, [math.exp(min(0.0, ahead[k] + back[k] - every)) for k in range(size - 1)]


def column_key(name: Column) -> Column:
    """Columns are the same if their names' letters and digits are."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "[^\\p{L}\\p{Nd}]+", ""))


def paths(model: Model, own: Lattices, fn) -> list:
    """``fn(starts, cuts, long)`` of each field of a batch."""
    weights = model.segment_values(own).tolist()
    cuts, keeps = model.mark_cuts(own)
    out, i, k = [], 0, 0
    for n, m, lengths, quoted in zip(own.sizes, own.segments, own.lengths, own.quoted, strict=True):
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        inside = [0.0]
        for x in keeps[k : k + n - 1]:
            inside.append(inside[-1] + x)
        for s, e, w in zip(own.start[i : i + m], own.end[i : i + m], weights[i : i + m], strict=True):
            starts[e].append((int(s), w + inside[e] - inside[s]))
        out.append(fn(starts, cuts[k : k + n - 1], Long.of(lengths, quoted, keeps[k : k + n - 1])))
        i, k = i + m, k + n - 1
    return out


def expected(model: Model, own: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each segment and of each mark's cut, fields one after another. Fields of one mark, by far the most, are
    reckoned at once."""
    n, m = np.asarray(own.sizes), np.asarray(own.segments)
    segment, mark = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(n - 1)])
    of_segment, of_mark = np.ones(segment[-1]), np.ones(mark[-1])
    two = (n == 2) & (m == 3)  # else a quoted atom: the mark cuts
    if two.any():
        w, (cuts, keeps) = model.segment_values(own), model.mark_cuts(own)
        at, k = segment[:-1][two], mark[:-1][two]  # first atom, second atom, both
        joined = w[at + 2] + np.asarray(keeps)[k] - w[at] - w[at + 1] - np.asarray(cuts)[k]
        p = 1 / (1 + np.exp(np.minimum(700, joined)))
        of_segment[at], of_segment[at + 1], of_segment[at + 2], of_mark[k] = p, p, 1 - p, p
    rest = np.flatnonzero(n > 2)
    if len(rest):
        for j, (ps, qs) in zip(rest, paths(model, own.some(rest), chances), strict=True):
            of_segment[segment[j] : segment[j + 1]] = [p for of_end in ps for p in of_end]
            of_mark[mark[j] : mark[j + 1]] = qs
    return of_segment, of_mark


#: A count: of a hashed key, or of a column ("n") or a column's kind of mark (cuts "c", marks "m").
COUNT_SCHEMA = "hash long, what string, col string, kind string, n double"


def _counts(hashes: np.ndarray, n: np.ndarray, small: dict[tuple[str, str, str], float]) -> pd.DataFrame:
    keys, at = np.unique(hashes, return_inverse=True)
    both = pd.DataFrame({"hash": pd.array(keys, "Int64"), "n": np.bincount(at, n, len(keys)) if len(keys) else np.zeros(0)})
    rest = pd.DataFrame([(w, c, k, x) for (w, c, k), x in small.items()], columns=["what", "col", "kind", "n"])
    return pd.concat([both, rest])[["hash", "what", "col", "kind", "n"]].astype({"hash": "Int64", "n": float})


def sure_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of fields without undecided marks (col, atoms, n), as often as they stand."""
    keys = [value_keys(col, atoms[0])[:3] for col, atoms in zip(pdf["col"], pdf["atoms"], strict=True)]
    return _counts(np.array(keys, np.int64).reshape(-1), np.repeat(pdf["n"].to_numpy(float), 3), {("n", c, ""): x for c, x in pdf.groupby("col")["n"].sum().items()})


def expected_counts(model: Model, own: Lattices) -> pd.DataFrame:
    """Of ambiguous fields, once each: a field that is repeated is no further evidence."""
    p, q = expected(model, own)
    p = np.where(p > 1e-4, p, 0.0)
    small: dict[tuple[str, str, str], float] = defaultdict(float)
    cols = np.repeat(np.asarray(own.cols, object), own.segments)
    for c in set(own.cols):
        small["n", c, ""] = float(p[cols == c].sum())
    marks = np.repeat(np.asarray(own.cols, object), np.asarray(own.sizes) - 1)
    for c, kind, x in zip(marks, own.kinds, q.tolist(), strict=True):
        for of in ("*", c):
            small["c", of, kind] += x
            small["m", of, kind] += 1.0
    some = p > 0
    return _counts(np.concatenate([np.asarray(h, np.int64)[some] for h in (own.hv, own.hd, own.hs)]), np.tile(p[some], 3), small)


def _model(counts: DataFrame) -> tuple[Model, DataFrame | None]:
    """The model, and (hash, n) of the keys of more than one if there are too many to be sent to all tasks."""
    total = materialize(counts.groupBy("hash", "what", "col", "kind").agg(F.sum("n").alias("n")), "packed-counts")
    several = total.where("hash IS NOT NULL AND n > 1").select("hash", "n")
    joined = several if several.count() > MODEL_KEYS else None
    keys = several.limit(0 if joined is not None else MODEL_KEYS).toPandas().sort_values("hash")  # no more are there
    model = Model(keys["hash"].to_numpy(np.int64), keys["n"].to_numpy(float), {}, {})
    marks: dict[tuple[str, str, str], float] = {}
    for r in total.where("hash IS NULL").collect():
        if r.what == "n":
            model.values[r.col] = r.n
        else:
            marks[r.what, r.col, r.kind] = r.n
    model.cuts = {(c, k): (x, marks.get(("m", c, k), 0.0)) for (what, c, k), x in marks.items() if what == "c"}
    return model, joined


def moved(a: Model, b: Model) -> float:
    """Share of all columns' marks that are expected to cut in one model and not in the other."""
    kinds = {k for c, k in (*a.cuts, *b.cuts) if c == "*"}
    change = sum(abs(a.cuts.get(("*", k), (0.0, 0.0))[0] - b.cuts.get(("*", k), (0.0, 0.0))[0]) for k in kinds)
    return change / max(1.0, sum(b.cuts.get(("*", k), (0.0, 0.0))[1] for k in kinds))


def with_counts(ambiguous: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The lattices with the counts of their keys, if these are to be joined: a key is one row on one side, so a popular
    one is a hot key that adaptive execution splits."""
    if keys is None:
        return ambiguous
    asked = ambiguous.select("id", F.posexplode(F.concat("hv", "hd", "hs")).alias("k", "hash"))
    seen = asked.join(keys, "hash", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0.0)).alias("n")))).alias("seen"))
    return ambiguous.join(seen.select("id", F.transform("seen", lambda x: x["n"]).alias("seen")), "id")


@dataclass
class Learned:
    """The model, the ambiguous fields' lattices, and the keys' counts where they are joined."""

    model: Model
    ambiguous: DataFrame
    keys: DataFrame | None


def learn(entries: DataFrame) -> Learned:
    """What all entries (columns ``col``, ``entry``) tell."""
    sc = entries.sparkSession.sparkContext

    def cut_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(col, f) for col, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in fields(entry)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([f for _, f in found], pa.list_(pa.string()))], names=["col", "atoms"])

    def lattices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = Lattices()
            for col, atoms in zip(pdf["col"], pdf["atoms"], strict=True):
                own.add(col, list(atoms))
            yield own.frame().assign(atoms=list(pdf["atoms"]))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(sure_counts, batches)

    split = entries.select("col", "entry").mapInArrow(cut_fields, "col string, atoms array<string>")
    distinct = materialize(split.groupBy("col", "atoms").agg(F.count("*").cast("double").alias("n")), "packed-fields")
    ambiguous = materialize(distinct.where("size(atoms) > 1").select("col", "atoms").mapInPandas(lattices, Lattices.SCHEMA + ", atoms array<string>").withColumn("id", F.monotonically_increasing_id()), "packed-lattices")
    asked = ambiguous.select(F.explode(F.array_distinct(F.concat("hv", "hd", "hs"))).alias("hash")).distinct()
    base = distinct.where("size(atoms) = 1").mapInPandas(counted, COUNT_SCHEMA).groupBy("hash", "what", "col", "kind").agg(F.sum("n").alias("n"))
    base = base.where("hash IS NULL").union(base.where("hash IS NOT NULL").join(asked, "hash", "left_semi").select("hash", "what", "col", "kind", "n"))
    base = materialize(base, "packed-sure")
    model, keys = _model(base)
    for weight in itertools.chain(ROUND_WEIGHTS, itertools.repeat(MARK_WEIGHT)):
        model.mark_weight, before = weight, model
        held = sc.broadcast(model)

        def count_expected(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield expected_counts(held.value, Lattices.of_frame(pdf))

        model, keys = _model(base.union(with_counts(ambiguous, keys).drop("atoms").mapInPandas(count_expected, COUNT_SCHEMA)))
        held.unpersist()
        if weight == MARK_WEIGHT and moved(before, model) <= SETTLED:
            break
    model.mark_weight = MARK_WEIGHT
    return Learned(model, ambiguous, keys)


def cut_fields_of(model: Model, wanted: list[tuple[str, list[str]]]) -> list[list[str]]:
    """The likeliest values of ambiguous fields (column, atoms and marks)."""
    own = Lattices()
    for col, f in wanted:
        own.add(col, f)
    return [["".join(f[2 * s : 2 * e + 1]) for s, e in path] for (_, f), path in zip(wanted, paths(model, own, best_path), strict=True)]


def split_values(tables: list[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """(table_name, record_id, pos, value_text): all values of each record of which an entry holds several.

    ``tables`` has (name, rows, id column, column-name column, entries column); the model is learned from all
    of them. Defined cases: null arrays, null and blank entries hold no value; empty pieces are not counted;
    equal values are all kept; a quote that isn't closed is an ordinary character; unpaired or nested quotes
    stay in the text; a null column name is a column of its own; repeated records are each split; very long
    entries are split whole; an empty table gives an empty result; other columns are never read.
    """
    rows = None
    for name, df, ident, column, values in tables:
        part = df.select(F.lit(name).alias("table_name"), F.col(ident).cast("long").alias("record_id"), column_key(F.col(column)).alias("col"), F.col(values).alias("entries"))
        rows = part if rows is None else rows.union(part)
    rows = rows.where("size(entries) > 0")
    entries = rows.select("col", F.explode("entries").alias("entry")).where("entry IS NOT NULL")
    learned = learn(entries)
    rows = rows.where(F.exists("entries", lambda e: e.rlike(_ANY_MARK)))  # others hold no entry of several values
    if learned.keys is not None:
        return _cut_by_join(rows, learned)
    held = rows.sparkSession.sparkContext.broadcast(learned.model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, tuple[str, ...]], list[str]] = {}
        for batch in batches:
            if len(known) > CACHE:
                known.clear()
            names, idents, cols, lists = (c.to_pylist() for c in batch.columns)
            split = [[[(col, tuple(f)) for f in fields(entry)] for entry in own if entry is not None] for col, own in zip(cols, lists, strict=True)]
            new = list(dict.fromkeys(f for own in split for entry in own for f in entry if len(f[1]) > 1 and f not in known))
            known.update(zip(new, cut_fields_of(held.value, [(c, list(f)) for c, f in new]), strict=True))
            out: tuple[list, ...] = ([], [], [], [])
            for name, ident, own in zip(names, idents, split, strict=True):
                found = [[v for f in entry for x in known.get(f, f[1]) if (v := unquoted(x))] for entry in own]
                if any(len(values) > 1 for values in found):
                    values = [v for values in found for v in values]
                    for to, xs in zip(out, ([name] * len(values), [ident] * len(values), range(1, len(values) + 1), values), strict=True):
                        to += xs
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["table_name", "record_id", "pos", "value_text"])

    return rows.mapInArrow(cut, "table_name string, record_id long, pos long, value_text string")


def _cut_by_join(rows: DataFrame, learned: Learned) -> DataFrame:
    """The records' values where the model is too large to be sent: each distinct ambiguous field is cut once, and the
    records' fields look their values up by a join."""
    held = rows.sparkSession.sparkContext.broadcast(learned.model)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = paths(held.value, Lattices.of_frame(pdf), best_path)
                values = [[v for s, e in path if (v := unquoted("".join(f[2 * s : 2 * e + 1])))] for f, path in zip(pdf["atoms"], found, strict=True)]
                yield pd.DataFrame({"col": pdf["col"], "atoms": pdf["atoms"], "values": values})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row, n, k, col, f, [v] if len(f) == 1 and (v := unquoted(f[0])) else [])
                   for row, col, own in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, entry in enumerate(own) if entry is not None for k, f in enumerate(fields(entry))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["row", "entry", "field", "col", "atoms", "own"])

    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "packed-rows")
    parts = rows.select("row", "col", "entries").mapInArrow(split, "row long, entry long, field long, col string, atoms array<string>, own array<string>")
    known = materialize(with_counts(learned.ambiguous, learned.keys).mapInPandas(cut, "col string, atoms array<string>, values array<string>"), "packed-cut")
    told = parts.join(known, ["col", "atoms"], "left").select("row", "entry", "field", F.coalesce("values", "own").alias("values"))
    entries = told.groupBy("row", "entry").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("field", "values"))), lambda x: x["values"])).alias("values"))
    whole = entries.groupBy("row").agg(F.max(F.size("values")).alias("most"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("entry", "values"))), lambda x: x["values"])).alias("values")).where("most > 1")
    out = whole.join(rows.select("row", "table_name", "record_id"), "row").select("table_name", "record_id", F.posexplode("values").alias("pos", "value_text"))
    return out.select("table_name", "record_id", (F.col("pos") + 1).cast("long").alias("pos"), "value_text")
