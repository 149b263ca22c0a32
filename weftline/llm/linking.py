"""Matching entities across sources without keys: images of a job to the families its tokens describe.

Method: a deterministic cascade of rules. Each pass is an exact join within the job on weaker combinations of
attributes; it resolves the records that a rule leads to exactly one family (the first such rule counts) and takes
them out (anti-join) before the next pass makes its keys. A match's confidence is its rule's precision, smoothed, on
the records whose family is known; those go through all passes, so that every rule is measured that applies to any.

Attributes are read from a file name with its folders and from the image summary: family numbers, article
numbers (EAN), references in the shapes that the families' own references have, their leading part, words
(also written with digits for letters or run together), colours and product types in any listed language.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.session import materialize, work_root

#: Digits written for letters, prefixes that cameras and scanners give and season prefixes (fixed values).
LEET = str.maketrans("0134578", "oieastb")
CAMERA = {"img", "dsc", "dscf", "dscn", "pxl", "scan", "mvi", "gopr", "p10", "p", "bild", "photo", "foto", "image", "untitled", "kopie", "von", "neu", "finale", "client", "choix", "dcim", "snap"}
SEASON = re.compile(r"^(?:ss|aw|fw|hw|pe|ai)\d{2}", re.I)
#: Single letters for views that stand glued behind a reference (fixed values).
VIEWS = "abf"
#: Letters that a word must have to be taken for a damaged name.
LEAST_NAME = 5
#: Prior right and wrong matches in a rule's precision.
PRIOR = (1.0, 1.0)

#: Properties of families that rules read.
PROPERTIES = ["refco", "ean", "label", "color", "producttype"]

IMAGE_ATTRIBUTES = ["numbers", "eans", "refs", "near", "glued", "stems", "names", "joined", "colors", "types"]
FAMILY_ATTRIBUTES = ["family", "eans", "refs", "near", "glued", "stems", "names", "colors", "types"]
SHAPE_SCHEMA = "kind string, s string"


def folded(s: str) -> str:
    if s.isascii():
        return s.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c))


def compact(s: str) -> str:
    return "".join(c for c in folded(s) if c.isalnum())


def shape(s: str) -> str:
    return "".join("0" if c.isdigit() else "a" for c in s)


def shortened(s: str) -> list[str]:
    """All texts with one character less."""
    return list({s[:i] + s[i + 1 :] for i in range(len(s))})


class Lexicon:
    """Terms of colours and product types by their compact text; the longest first when words are joined."""

    def __init__(self, terms: list[tuple[str, str, str]]):
        self.of = {compact(t): (d, i) for d, i, t in terms if d in ("color", "producttype") and t and compact(t)}
        self.starts: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for t, hit in self.of.items():
            for n in range(4, len(t)):
                self.starts[t[:n]].add(hit)

    def read(self, words: list[str]) -> tuple[set[str], set[str], list[str]]:
        """Colours, types and the other words; neighbouring words may form one term, types may be shortened."""
        found: dict[str, set[str]] = {"color": set(), "producttype": set()}
        rest, i = [], 0
        while i < len(words):
            pair = words[i] + words[i + 1] if i + 1 < len(words) else ""
            if pair in self.of:
                domain, ident = self.of[pair]
                i += 2
            elif words[i] in self.of:
                domain, ident = self.of[words[i]]
                i += 1
            else:
                starts = self.starts.get(words[i], set())
                if len(starts) == 1 and next(iter(starts))[0] == "producttype":
                    found["producttype"].add(next(iter(starts))[1])
                elif (cut := self._run_together(words[i])) or (cut := self._run_together(pair)):
                    found[cut[1][0]].add(cut[1][1])
                    rest += [words[i], cut[0]]
                else:
                    rest.append(words[i])
                i += 1
                continue
            found[domain].add(ident)
        return found["color"], found["producttype"], rest


    def _run_together(self, word: str) -> tuple[str, tuple[str, str]] | None:
        """A name and a term without a mark between them: the longest term at either end."""
        for n in range(len(word) - 4, 3, -1):
            for name, term in ((word[:-n], word[-n:]), (word[n:], word[:n])):
                if term in self.of and len(name) > 4:
                    return name, self.of[term]
        return None


def words_of(text: str) -> list[str]:
    """Words of a file name, cut at marks, digits and capitals; those with digits read as letters come first, so
    that the words of one term stay side by side."""
    read, plain = [], []
    for token in re.split(r"[^\w]|_", text):
        if not token:
            continue
        for stem in dict.fromkeys([re.sub(r"(?<=[A-Za-z])0\d$", "", token), re.sub(r"(?i)(?:det|f)\d$|0\d$", "", token)]):  # without a view or counter
            if re.fullmatch(r"[A-Za-z0134578]+", stem) and re.search(r"[A-Za-z]\d|\d[A-Za-z]", stem) and len(re.findall("[A-Za-z]", stem)) > 1:
                spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z0-9])", " ", stem) if re.search("[a-z]", stem) else stem
                read += spaced.translate(LEET).split()
        for part in re.findall(r"[^\W\d_]+", token):
            plain += re.sub(r"(?<=[^\W\dA-Z_])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][^\W\dA-Z_])", " ", part).split()
    return [compact(w) for w in (*read, *plain) if compact(w)]


class Shapes:
    """References looked for by the shapes that the families' references have."""

    def __init__(self, shapes: list[tuple[str, str]]):
        self.full = sorted({s for kind, s in shapes if kind == "full"}, key=len, reverse=True)
        self.stem = sorted({s for kind, s in shapes if kind == "stem"}, key=len, reverse=True)
        self.counted = [x + "00" for x in self.full]
        self.near = sorted({t for s in self.full for t in shortened(s)} - set(self.full), key=len, reverse=True)

    @staticmethod
    def runs(text: str) -> tuple[str, list[bool], list[bool]]:
        """Folded letters and digits of a text; for each place whether a run of letters or digits begins there,
        and whether a word does (a run, or a capital within letters)."""
        chars, runs, words, last = [], [], [], ""
        for k, c in enumerate(text):
            if c.isalnum():
                kind = "0" if c.isdigit() else "a"
                capital = c.isupper() and bool(last) and (text[k - 1].islower() or text[k + 1 : k + 2].islower())
                runs.append(kind != last)
                words.append(kind != last or capital)
                chars.append(folded(c)[:1] or c)
                last = kind
            else:
                last = ""
        return "".join(chars), [*runs, True], [*words, True]

    @staticmethod
    def windows(runs_of: tuple[str, list[bool], list[bool]], shapes: list[str], taken: set[int] | None = None, within: list[tuple[int, int]] = ()) -> list[tuple[int, str]]:
        """Places and texts of the given shapes in a text's ``runs``. Digits at either end must not go on beyond it, letters at the
        end only as a new word or a view letter; letters before a reference may be glued to it. Texts that touch a
        ``taken`` place or lie in one of the stretches ``within`` are left out."""
        s, runs, words = runs_of
        form, out = shape(s), []
        for want in shapes:
            i = form.find(want)
            while i >= 0:
                j = i + len(want)
                ends = runs[j] if want[-1] == "0" else words[j] or (s[j] in VIEWS and words[j + 1])
                if (want[0] == "a" or runs[i]) and ends and not (taken and taken & set(range(i, j))) and not any(a <= i and j <= b for a, b in within):
                    out.append((i, s[i:j]))
                i = form.find(want, i + 1)
        return out


def image_keys(name: str, summary: str, lex: Lexicon, shapes: Shapes) -> dict:
    """All attributes that a file name (folders included) and an image summary give."""
    name = unicodedata.normalize("NFC", name or "")
    base = re.sub(r"\.(?:jpe?g|png|tiff?|gif|bmp|webp)$", "", name, flags=re.I)
    numbers, eans, refs, near, glued, stems, words = set(), set(), set(), set(), set(), set(), []
    for part in base.split("/"):
        tokens = [SEASON.sub("", t) for t in re.split(r"[\s_.\-]+", re.sub(r"\(\d+\)", " ", part))]
        text = " ".join(t for t in tokens if t)
        low = folded(text)
        for run in re.findall(r"\d+", low):
            if len(run) == 8:
                numbers.add(run)
            if len(run) in (13, 14) and len(run.lstrip("0")) in (12, 13):
                eans.add(run[-13:])
            elif 11 < len(run) < 15:
                near.add("e" + run)
            if len(run) in (10, 15):
                glued.add(run[:-2])
            bare = run[1:-2] if run[0] == "0" else run[:-2]  # before a counter
            if len(bare) == 13:
                glued.add(bare)
            elif len(bare) == 12:
                near.add("e" + bare)
        parts = shapes.runs(text)
        full = shapes.windows(parts, shapes.full)
        refs |= {r for _, r in full}
        taken = {k for i, r in full for k in range(i, i + len(r))}
        glued |= {r[:-2] for _, r in shapes.windows(parts, shapes.counted)}
        less = shapes.windows(parts, shapes.near, taken)
        near |= {"r" + r for _, r in less}
        whole = [(i, i + len(r)) for i, r in [*full, *less] if len(r) > 6]
        camera = {m.start(1) for m in re.finditer(r"(?:^|[^a-z])(?:" + "|".join(sorted(CAMERA, key=len, reverse=True)) + r")\s*(\d{3,})", low)}
        squeezed = {sum(c.isalnum() for c in low[:k]) for k in camera}
        stems |= {r for i, r in shapes.windows(parts, shapes.stem, within=whole) if i not in squeezed}
        words += words_of(text)
    colors, types, rest = lex.read(words)
    for field, value in re.findall(r"(\w+)=([^;]+)", summary or ""):
        hit = lex.of.get(compact(value))
        if field == "color" and hit:
            colors = colors or {hit[1]}
        if field == "type" and hit:
            types = types or {hit[1]}
    names = sorted({w for w in rest if len(w) > 3 and w not in CAMERA})
    joined = sorted({a + b for a, b in zip(rest, rest[1:], strict=False)})
    return {"numbers": sorted(numbers), "eans": sorted(eans), "refs": sorted(refs), "near": sorted(near), "glued": sorted(glued), "stems": sorted(stems),
            "names": names, "joined": joined, "colors": sorted(colors), "types": sorted(types)}


def reference_forms(tokens: list[str]) -> tuple[set[str], set[str]]:
    """Full references and their leading parts from a family's reference tokens, whole or cut in two.

    Tokens with two or more runs apart are whole; the pieces of a cut one are joined in both orders.
    """
    parts = [p for t in tokens if (p := compact(t))]
    full, stems = set(), set()
    kinds = {shape(p) for p in parts}
    for t in tokens:
        pieces = [compact(x) for x in re.split(r"[^\w]|_", t) if compact(x)]
        if len(pieces) > 2 or (len(pieces) == 2 and all(x.isdigit() for x in pieces)):
            full.add("".join(pieces))
            stems.add("".join(pieces[:-1]))
        elif len(pieces) == 1 and len(pieces[0]) > 10:
            full.add(pieces[0])
            stems.add(pieces[0][:-4])
    if not full and len(set(parts)) > 1:
        for a in dict.fromkeys(parts):
            for b in dict.fromkeys(parts):
                if a != b and (len(kinds) == 1 or len(a) >= len(b)) and len(a + b) > 6:
                    full.add(a + b)
                    stems.add(a)
    elif not full:
        stems |= {p for p in parts if len(p) > 3}
    return full, stems


def family_keys(tokens: list[tuple[str, str]], lex: Lexicon) -> dict:
    """All attributes that a family's tokens (property, text) give."""
    by: dict[str, list[str]] = defaultdict(list)
    for prop, token in tokens:
        by[prop].append(token)
    full, stems = reference_forms(by.get("refco", []))
    eans = {c for t in by.get("ean", []) if len(c := compact(t)) == 13}
    ordered = [compact(w) for t in by.get("color", []) for w in t.split()]
    pairs = {a + b for a in ordered for b in ordered}
    colors = {lex.of[w][1] for w in {*pairs, *ordered} if lex.of.get(w, ("",))[0] == "color"}
    if pairs & set(lex.of):  # pieces of a two-word colour are not colours of their own
        whole = {w for w in pairs if lex.of.get(w, ("",))[0] == "color"}
        colors = {lex.of[w][1] for w in whole} | {lex.of[w][1] for w in ordered if lex.of.get(w, ("",))[0] == "color" and not any(w in x for x in whole)}
    types = {lex.of[c][1] for t in by.get("producttype", []) if lex.of.get(c := compact(t), ("",))[0] == "producttype"}
    names = {c for t in by.get("label", []) if len(c := compact(t)) > 3}
    whole = {"r" + r for r in full} | {"e" + e for e in eans}
    return {"eans": sorted(eans), "refs": sorted(full), "near": sorted(whole), "glued": sorted(full | eans), "stems": sorted(stems), "names": sorted(names), "colors": sorted(colors), "types": sorted(types)}


#: The cascade's passes, each with its rules in order: name, attribute of the image, attribute of the family, the
#: forms in which they may differ, what stands beside it in the key, and whether colours and types that are not in
#: the key must at least not contradict each other.
PASSES: list[list[tuple[str, str, str, str, tuple[str, ...], bool]]] = [
    [
        ("family number", "numbers", "family", "same", (), False),
        ("article number", "eans", "eans", "same", (), False),
        ("reference", "refs", "refs", "same", (), False),
        ("name, colour and type", "names", "names", "same", ("colors", "types"), False),
        ("name and colour", "names", "names", "same", ("colors",), True),
        ("joined name and colour", "joined", "names", "same", ("colors",), True),
    ],
    [
        ("damaged name, colour and type", "names", "names", "shorter", ("colors", "types"), False),
        ("damaged name and colour", "names", "names", "shorter", ("colors",), True),
        ("leading reference, colour and type", "stems", "stems", "same", ("colors", "types"), False),
        ("leading reference and colour", "stems", "stems", "same", ("colors",), True),
        ("name and type", "names", "names", "same", ("types",), True),
        ("name", "names", "names", "same", (), True),
    ],
    [
        ("damaged name", "names", "names", "shorter", (), True),
        ("leading reference and type", "stems", "stems", "same", ("types",), True),
        ("leading reference", "stems", "stems", "same", (), True),
        ("reference with a counter", "glued", "glued", "same", (), False),
        ("family number with a counter", "glued", "family", "same", (), False),
        ("damaged reference", "near", "near", "lost", (), True),
        ("changed reference and colour", "refs", "refs", "changed", ("colors",), True),
    ],
]
RULES = [rule for rules in PASSES for rule in rules]


def _without(s: Column, mark: str = "") -> Column:
    """The text's variants with one character less, or with ``mark`` for it."""
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.lit(mark), F.substring(s, i + 1, F.length(s))))


def _swapped(s: Column) -> Column:
    """For each two neighbours, the text with both in alphabetical order behind a mark: equal for a text and for
    the same with these two exchanged."""
    at = lambda i: F.substring(s, i, F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.lit("~"), F.least(at(i), at(i + 1)), F.greatest(at(i), at(i + 1)), F.substring(s, i + 2, F.length(s))))
    return F.when(F.length(s) > 1, pairs).otherwise(F.array().cast("array<string>"))


def forms(texts: Column, how: str, of_family: bool) -> Column:
    """The keys under which texts meet that are the same, differ by edits that deleting one character on either
    side explains (shorter), lack one character in the image (lost), or have one character changed or two
    neighbours exchanged (changed)."""
    if how == "shorter":
        texts = F.filter(texts, lambda s: F.length(s) >= LEAST_NAME)
        return F.array_distinct(F.flatten(F.transform(texts, lambda s: F.concat(F.array(s), _without(s)))))
    if how == "lost" and of_family:  # the first character tells the kind
        return F.array_distinct(F.flatten(F.transform(texts, lambda s: F.transform(_without(F.substring(s, F.lit(2), F.length(s))), lambda v: F.concat(F.substring(s, 1, 1), v)))))
    if how == "changed":
        return F.array_distinct(F.flatten(F.transform(texts, lambda s: F.concat(_without(s, "*"), _swapped(s)))))
    return texts


def _beside(keys: Column, values: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.transform(values, lambda v: F.concat_ws("|", k, v))))


def _with_rule(keys: Column, n: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(n).alias("rule"), k.alias("key")))


def rule_keys(own: DataFrame, first: int, rules: list[tuple], of_family: bool) -> DataFrame:
    """``own`` with one row per rule and key: an attribute's forms with each value that stands beside them. A key
    is null, and its row left out, where one of them is missing."""
    side, arrays = (2 if of_family else 1), []
    made: dict[tuple[str, str], str] = {}
    for rule in rules:  # forms that several rules share are made once
        if (what := (rule[side], rule[3])) not in made:
            made[what] = f"_{rule[side]}_{rule[3]}"
    own = own.select("*", *[forms(F.col(attr), how, of_family).alias(name) for (attr, how), name in made.items()])
    for n, rule in enumerate(rules, first):
        keys = F.col(made[rule[side], rule[3]])
        for beside in rule[4]:
            keys = _beside(keys, F.col(beside))
        arrays.append(_with_rule(keys, n))
    return own.select("*", F.inline(F.concat(*arrays)))


def gathered_tokens(tokens: DataFrame) -> DataFrame:
    """(job, family, own) with a family's distinct tokens in the order of their first place.

    Only properties that rules read are taken; of those a family has few different values, however many rows
    repeat them. Repeats are dropped, map-side, before the shuffle gathers a family's own; the order tells which
    piece of a cut value leads.
    """
    slim = tokens.where("job_id IS NOT NULL AND family_id IS NOT NULL AND family_token IS NOT NULL").where(F.lower("property_name").isin(PROPERTIES))
    slim = slim.groupBy(F.col("job_id").alias("job"), F.col("family_id").alias("family"), F.lower(F.coalesce("property_name", F.lit(""))).alias("prop"), F.lower("family_token").alias("token")).agg(F.min("token_id").alias("at"))
    return slim.groupBy("job", "family").agg(F.sort_array(F.collect_list(F.struct("at", "prop", "token"))).alias("own"))


def family_attributes(gathered: DataFrame, lex_rows: list[tuple[str, str, str]]) -> DataFrame:
    """(job, family, attributes), one row per family of a job."""
    held = gathered.sparkSession.sparkContext.broadcast(lex_rows)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(held.value)
        for pdf in batches:
            rows = [family_keys([(x["prop"], x["token"]) for x in tokens], lex) | {"job": j, "family": [f]} for j, f, tokens in zip(pdf["job"], pdf["family"], pdf["own"], strict=True)]
            yield pd.DataFrame(rows, columns=["job", *FAMILY_ATTRIBUTES])

    return gathered.mapInPandas(read, "job string, " + ", ".join(f"{a} array<string>" for a in FAMILY_ATTRIBUTES))


def image_attributes(evidence: DataFrame, lex_rows: list[tuple[str, str, str]], shape_rows: list[tuple[str, str]]) -> DataFrame:
    """(id, job, known, attributes), one row per image."""
    held = evidence.sparkSession.sparkContext.broadcast((lex_rows, shape_rows))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, shapes = Lexicon(held.value[0]), Shapes(held.value[1])
        for pdf in batches:
            rows = [image_keys(name, summary, lex, shapes) for name, summary in zip(pdf["source_filename"], pdf["image_ngp_summary"], strict=True)]
            yield pd.DataFrame(rows, columns=IMAGE_ATTRIBUTES).assign(id=pdf["evidence_id"], job=pdf["job_id"], known=pdf["final_family_id"])

    slim = evidence.where("evidence_id IS NOT NULL AND job_id IS NOT NULL").select(F.col("evidence_id").cast("long").alias("evidence_id"), "job_id", "final_family_id", "source_filename", "image_ngp_summary")
    return slim.mapInPandas(read, ", ".join(f"{a} array<string>" for a in IMAGE_ATTRIBUTES) + ", id long, job string, known string")


def reference_shapes(gathered: DataFrame) -> DataFrame:
    """(kind, s): the distinct shapes of whole references and of their leading parts."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for pdf in batches:
            for tokens in pdf["own"]:
                full, stems = reference_forms([x["token"] for x in tokens if x["prop"] == "refco"])
                seen |= {("full", shape(r)) for r in full} | {("stem", shape(r)) for r in stems}
        yield pd.DataFrame(sorted(seen), columns=["kind", "s"])

    return gathered.mapInPandas(shapes, SHAPE_SCHEMA).where("length(s) > 3").distinct()


def hashed() -> list[Column]:
    """128 bits of a key within its job and rule: fixed in width, so that sorting and grouping are cheap."""
    return [F.xxhash64("job", "rule", "key").alias("h1"), F.xxhash64(F.lit("second half"), "key", "rule", "job").alias("h2")]


def cascade(images: DataFrame, families: DataFrame) -> DataFrame:
    """(id, known, family, rule): for images without a family one row, of the first rule that leads to exactly one;
    for the others one row of each rule that does, by which the rules' precision is taken.

    A pass is an exact join of its rules' keys with an index that has each key once, with the least and greatest
    number of a family that holds it: a key that many images share is a hot key of one side only, which Spark's
    adaptive execution splits. Images that a pass resolved are taken out before the next one makes its keys.
    """
    spark = images.sparkSession
    place = f"{work_root(spark)}/link-found-{uuid.uuid4().hex[:8]}"
    schema, first = "id long, known string, family string, rule int", 0
    whose = images.select("row", "id", "known", "colors", "types")
    own = families.select("number", F.element_at("family", 1).alias("family"), F.col("colors").alias("f_colors"), F.col("types").alias("f_types"))
    for n, rules in enumerate(PASSES):
        left = images
        if n:
            done = spark.read.schema(schema + ", pass int").option("basePath", place).parquet(place).where("known IS NULL").select("id")
            left = images.join(done, "id", "left_anti")
        keys = rule_keys(families, first, rules, True)
        index = keys.select(*hashed(), "number").groupBy("h1", "h2").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
        keys = rule_keys(left, first, rules, False)
        pairs = keys.select(*hashed(), "row", "rule").join(index, ["h1", "h2"])
        alone = pairs.groupBy("row", "rule").agg(F.min("lo").alias("number"), F.max("hi").alias("other")).where("number = other").drop("other")
        strict = [k for k, rule in enumerate(rules, first) if rule[5]]
        found = alone.join(whose, "row").join(own, "number")
        found = found.where(~F.col("rule").isin(strict) | F.expr(_NO_CLASH))
        best = found.groupBy("id").agg(F.min("known").alias("known"), F.min(F.struct("rule", "family")).alias("first"), F.collect_list(F.struct("rule", "family")).alias("all"))
        best = best.select("id", "known", F.inline(F.expr("if(known IS NULL, array(first), all)")))
        best.select("id", "known", "family", "rule").write.parquet(f"{place}/pass={n}")
        first += len(rules)
    return spark.read.schema(schema + ", pass int").option("basePath", place).parquet(place).drop("pass")


#: Colours and types do not contradict each other: one side says nothing, or they share a value.
_NO_CLASH = " AND ".join(f"(size({x}) = 0 OR size(f_{x}) = 0 OR arrays_overlap({x}, f_{x}))" for x in ("colors", "types"))


def link(evidence: DataFrame, tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(evidence_id, family_id, rule, confidence) of the images without a family that the cascade resolves.

    Defined cases: null names give nothing to join on; images without job, and tokens without job, family or
    text, are left out; names that lead to several families by a rule go on to the next; repeated images are one,
    resolved by the first rule that resolves any of them; empty tables give an empty result; columns other than those named are never read.
    """
    lex_rows = [(r[0], r[1], r[2]) for r in terms.where("term_domain IN ('color', 'producttype')").select("term_domain", "canonical_id", "term").collect()]
    gathered = materialize(gathered_tokens(tokens), "link-families")
    shape_rows = [(r.kind, r.s) for r in reference_shapes(gathered).collect()]
    families = materialize(family_attributes(gathered, lex_rows).withColumn("number", F.monotonically_increasing_id()), "link-attributes")
    images = materialize(image_attributes(evidence, lex_rows, shape_rows).withColumn("row", F.monotonically_increasing_id()), "link-images")
    found = cascade(images, families)
    right, wrong = PRIOR
    precision = found.where("known IS NOT NULL").groupBy("rule").agg(((F.count_if(F.col("known") == F.col("family")) + right) / (F.count("*") + right + wrong)).alias("confidence"))
    names = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("rule") + 1)
    out = found.where("known IS NULL").join(F.broadcast(precision.limit(len(RULES))), "rule", "left")
    return out.select(F.col("id").alias("evidence_id"), F.col("family").alias("family_id"), names.alias("rule"), F.coalesce("confidence", F.lit(right / (right + wrong))).alias("confidence"))
