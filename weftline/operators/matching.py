"""Matching names to catalogue records by digits and words, within a group such as a job.

All joins are equi-joins on (group, key). An index is reduced before it is joined: for each key it says only
which record holds it, or that several do, so a key that many records and many names share costs one row
per name and never a product of both.
"""

from __future__ import annotations

from itertools import combinations, permutations
from collections.abc import Iterator

import math
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weftline.functions.strings import basename, collapsed_stem, concatenation_distance, digit_runs, digits_only, extension, filename_tokens, profile_tokens, stem
from weftline.session import materialize

MIN_DIGITS = 5
MAX_DIGITS = 18
MIN_CONTAINED = 7
MAX_DISTANCE = 1.478
MAX_DISTANCE_PERMUTED = 4.5
PERMUTED_TOKENS = 12
MIN_WORDS = 2
IDENTIFIER_LENGTH = 4
FUZZY_LENGTH = 4
PAIRED_WORDS = 64
#: Endings of pictures (fixed values).
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp"]


def catalogue(tokens: DataFrame) -> DataFrame:
    """(grp, rec, prop, value) from a token table; the record's own number is a value of it."""
    rows = tokens.where("job_id IS NOT NULL AND family_id IS NOT NULL")
    own = rows.select(F.col("job_id").alias("grp"), F.col("family_id").alias("rec"), F.lit("family_id").alias("prop"), F.col("family_id").alias("value"))
    rest = rows.where("family_token IS NOT NULL").select(F.col("job_id").alias("grp"), F.col("family_id").alias("rec"), F.col("property_name").alias("prop"), F.col("family_token").alias("value"))
    return own.union(rest)


def names(images: DataFrame) -> DataFrame:
    """(id, grp, name) from an image table."""
    return images.where("job_id IS NOT NULL AND source_filename IS NOT NULL").select(F.col("evidence_id").alias("id"), F.col("job_id").alias("grp"), F.col("source_filename").alias("name"))


def digit_postings(cat: DataFrame) -> DataFrame:
    """(grp, key, rec): the whole digits of each value (at most MAX_DIGITS) and its runs of MIN_DIGITS or more."""
    whole = digits_only(F.col("value"))
    keys = F.array_union(
        F.when(F.length(whole).between(1, MAX_DIGITS), F.array(whole)).otherwise(F.array().cast("array<string>")),
        F.filter(F.coalesce(digit_runs(F.col("value")), F.array().cast("array<string>")), lambda r: F.length(r) >= MIN_DIGITS))
    return cat.select("grp", "rec", F.explode(keys).alias("key")).distinct()


def holders(postings: DataFrame) -> DataFrame:
    """(grp, key, lo, hi): the least and greatest record of a key; equal if just one holds it."""
    return postings.groupBy("grp", "key").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"))


def digit_tokens(name: Column) -> Column:
    """Runs of MIN_DIGITS or more digits in a name's stem, and all its digits together."""
    whole = digits_only(stem(name))
    return F.array_distinct(F.filter(F.concat(digit_runs(stem(name)), F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array().cast("array<string>"))), lambda t: F.length(t) >= MIN_DIGITS))


def _sole(pairs: DataFrame, *extra: Column) -> DataFrame:
    """(id, rec) of the names whose keys all lead to one record."""
    agg = pairs.groupBy("id").agg(F.min("lo").alias("rec"), F.max("hi").alias("other"), *extra)
    return agg.where("rec = other").drop("other")


def by_digits(img: DataFrame, index: DataFrame) -> DataFrame:
    """(id, rec): names whose digit tokens are keys of exactly one record."""
    tokens = img.select("id", "grp", F.explode(digit_tokens(F.col("name"))).alias("key"))
    return _sole(tokens.join(index, ["grp", "key"]))


def by_concatenation(img: DataFrame, index: DataFrame) -> DataFrame:
    """(id, rec, distance): names in which neighbouring digit runs together form a key of exactly one record.

    The distance of n runs is n - 1 at least, so windows that can be near enough hold few runs, of any length.
    """
    runs = img.select("id", "grp", digit_runs(stem(F.col("name"))).alias("runs")).where("size(runs) >= 2")
    starts = runs.select("id", "grp", "runs", F.explode(F.sequence(F.lit(1), F.size("runs") - 1)).alias("i"))
    windows = starts.select("id", "grp", F.explode(F.transform(F.sequence(F.lit(2), F.least(F.size("runs") - F.col("i") + 1, F.lit(1 + math.floor(MAX_DISTANCE)))), lambda n: F.slice("runs", F.col("i"), n))).alias("tokens"))
    keyed = windows.select("id", "grp", F.array_join("tokens", "").alias("key"), concatenation_distance(F.col("tokens")).alias("d"))
    keyed = keyed.where(F.col("d") <= MAX_DISTANCE)
    return _sole(keyed.join(index, ["grp", "key"]), F.min("d").alias("distance"))


def kendall_distance(tokens: list[str], target: str) -> float:
    """Concatenation distance in any order: the distance in order plus the least inversions that spell the target."""
    n = len(tokens)
    if n == 1:
        return 0.0 if tokens[0] == target else math.inf
    if sum(map(len, tokens)) != len(target):
        return math.inf
    best = min((sum(a > b for a, b in combinations(p, 2)) for p in permutations(range(n)) if "".join(tokens[i] for i in p) == target), default=None)
    if best is None:
        return math.inf
    shares = [len(t) / len(target) for t in tokens]
    return (n - 1) * (2 + sum(s * math.log(s) for s in shares if s) / math.log(n)) + best


def by_permutation(img: DataFrame, index: DataFrame) -> DataFrame:
    """(id, rec): names of which some digit runs in any order form a key of exactly one record.

    The distance grows by at least one per run, so sets of more than five runs can't be near enough. Sets are
    blocked by their sorted digits; a Python function spells out the orders of the few that share a block.
    """
    runs = img.select("id", "grp", digit_runs(stem(F.col("name"))).alias("runs")).where(f"size(runs) BETWEEN 2 AND {PERMUTED_TOKENS}")

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, g, own in zip(pdf["id"], pdf["grp"], pdf["runs"], strict=True):
                for n in range(2, 6):
                    for s in combinations(list(own), n):
                        out.append((i, g, list(s), "".join(sorted("".join(s)))))
            yield pd.DataFrame(out, columns=["id", "grp", "tokens", "block"])

    sets = runs.mapInPandas(subsets, T.StructType([T.StructField("id", T.LongType()), T.StructField("grp", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("block", T.StringType())])).distinct()
    keys = index.withColumn("block", F.array_join(F.array_sort(F.split("key", "(?!^)")), ""))

    def near(tokens: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([kendall_distance(list(t), k) for t, k in zip(tokens, key, strict=True)])

    distance = F.pandas_udf(near, T.DoubleType())
    return _sole(sets.join(keys, ["grp", "block"]).withColumn("d", distance("tokens", "key")).where(f"d <= {MAX_DISTANCE_PERMUTED}"), F.min("d").alias("distance"))


def by_intersection(img: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, rec): names with two or more digit tokens that are keys, all of which exactly one record holds.

    Names with equal tokens are taken once. Each is expanded by its rarest token only; the others are then
    looked up record by record.
    """
    tokens = img.select("id", "grp", F.array_sort(digit_tokens(F.col("name"))).alias("tokens")).where("size(tokens) >= 2")
    sets = tokens.select("grp", "tokens").distinct()
    held = postings.groupBy("grp", "key").agg(F.count("*").alias("n"))
    hits = sets.select("grp", "tokens", F.explode("tokens").alias("key")).join(held, ["grp", "key"])
    per = hits.groupBy("grp", "tokens").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("hits")).where("size(hits) >= 2")
    first = per.select("grp", "tokens", F.col("hits")[0]["key"].alias("key"), F.transform(F.slice("hits", F.lit(2), F.size("hits")), lambda h: h["key"]).alias("rest"))
    found = first.join(postings, ["grp", "key"]).select("grp", "tokens", "rec", F.size("rest").alias("want"), F.explode("rest").alias("key"))
    full = found.join(postings, ["grp", "key", "rec"]).groupBy("grp", "tokens", "rec", "want").agg(F.count("*").alias("got")).where("want = got")
    sole = full.groupBy("grp", "tokens").agg(F.min("rec").alias("rec"), F.max("rec").alias("other")).where("rec = other")
    return tokens.join(sole, ["grp", "tokens"]).select("id", "rec")


def by_containment(img: DataFrame, index: DataFrame) -> DataFrame:
    """(id, rec): names whose long digit tokens stand within longer keys of one record, each of them alone.

    A key of at most MAX_DIGITS digits has a bounded number of parts; these are listed, which makes the
    containment an equi-join. Longer keys, which only single long runs give, are met by the parts of MIN_CONTAINED
    digits instead, of which they have no more than digits, and looked through.
    """
    size = F.length("key")
    tokens = img.select("id", "grp", F.explode(digit_tokens(F.col("name"))).alias("key")).where(F.length("key") >= MIN_CONTAINED)
    longer = index.where(size.between(MIN_CONTAINED + 1, MAX_DIGITS))
    parts = longer.select("grp", "lo", "hi", "key", F.explode(F.sequence(F.lit(MIN_CONTAINED), size - 1)).alias("n"))
    parts = parts.select("grp", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - F.col("n") + 1), lambda i: F.substr("key", i, F.col("n")))).alias("key"))
    inner = parts.groupBy("grp", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    grams = index.where(size > MAX_DIGITS).select("grp", "lo", "hi", F.col("key").alias("whole"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size - MIN_CONTAINED + 1), lambda i: F.substr("key", i, F.lit(MIN_CONTAINED))))).alias("gram"))
    met = tokens.select("grp", "key").distinct().withColumn("gram", F.substring("key", 1, MIN_CONTAINED)).join(grams, ["grp", "gram"]).where("contains(whole, key) AND length(whole) > length(key)")
    inner = inner.union(met.groupBy("grp", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    return _sole(tokens.join(inner, ["grp", "key"]))


def word_postings(cat: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(grp, key, rec): the words of each record's values; a word of a synonym group stands for its group."""
    words = cat.where("prop <> 'family_id'").select("grp", "rec", F.explode(F.split(F.lower("value"), "[^a-zà-öø-ÿ0-9]+")).alias("key"))
    words = words.where((F.length("key") >= 2) & ~F.col("key").rlike("^[0-9]+$"))
    return grouped_words(words, synonyms).distinct()


def grouped_words(words: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """``key`` replaced by the id of its synonym group, if it has one. The synonym list is a small dimension."""
    if synonyms is None:
        return words
    s = synonyms.groupBy(F.col("term").alias("key")).agg(F.min("group_id").alias("group_id"))
    return words.join(s, "key", "left").withColumn("key", F.coalesce("group_id", "key")).drop("group_id")


def unknown_codes(img: DataFrame, postings: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(id): names in which a code of letters and digits is held by no record at all."""
    words = img.select("id", "grp", F.explode(filename_tokens(F.col("name"))).alias("word"))
    keyed = grouped_words(words.withColumn("key", F.col("word")), synonyms)
    codes = keyed.where((F.length("word") >= IDENTIFIER_LENGTH) & F.col("word").rlike("[0-9]") & F.col("word").rlike("[^0-9]"))
    return codes.join(postings.select("grp", "key").distinct(), ["grp", "key"], "left_anti").select("id").distinct()


def number_postings(cat: DataFrame) -> DataFrame:
    """(grp, key, rec): the words of each record's values that are numbers."""
    words = cat.where("prop <> 'family_id'").select("grp", "rec", F.explode(F.split(F.lower("value"), "[^a-zà-öø-ÿ0-9]+")).alias("key"))
    return words.where(F.col("key").rlike("^[0-9]+$")).distinct()


def by_words(img: DataFrame, postings: DataFrame, synonyms: DataFrame | None = None, near: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """(id, rec, matched): names of which one record alone holds the most words, at least MIN_WORDS of them.

    Of records that hold as many, the one is taken that alone among them holds a number of the name, if all such
    numbers tell the same (``numbers``, see number_postings). A name none of whose records holds two of its words is
    matched by a single one if that is a code of letters and digits of one record only, and its other words lead
    to no other record.

    Names whose known words are the same are taken once. They and the records meet on pairs of words: a single common
    word (a colour, a brand) joins nothing, and from
    the pairs that match follows how many words match. Records of more than PAIRED_WORDS words (few: each needs
    that many postings) are met word by word instead, so their pairs are never listed. Names in which a code of letters and digits is held by
    no record at all are left out: the code names something that isn't there. ``near`` (grp, word, key) gives
    words that stand for one that no record has.
    """
    index = holders(postings)
    words = img.select("id", "grp", F.explode(filename_tokens(F.col("name"))).alias("word"))
    # each word meets the index once; what follows reads the table of that, which keeps its plans small
    keyed = materialize(grouped_words(words.withColumn("key", F.col("word")), synonyms).join(index, ["grp", "key"], "left").select("id", "grp", "word", "key", "lo", "hi"), "held-words")
    if near is not None:
        lacks = keyed.where("lo IS NULL").select("id", "grp", "word")
        keyed = keyed.unionByName(materialize(grouped_words(lacks.join(near, ["grp", "word"]), synonyms).distinct().join(index, ["grp", "key"]).select("id", "grp", "word", "key", "lo", "hi"), "near-held-words"))
    is_code = (F.length("word") >= IDENTIFIER_LENGTH) & F.col("word").rlike("[0-9]") & F.col("word").rlike("[^0-9]")
    by_name = keyed.repartition("id", "grp").groupBy("id", "grp", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(is_code).alias("code"), F.count("*").alias("n"), F.collect_set("word").alias("words"))
    held_key = F.when(F.col("lo").isNotNull(), F.struct("key", "n") if near is None else F.struct("key", "n", F.array_sort("words").alias("words")))
    by_name = by_name.groupBy("id", "grp").agg(F.array_sort(F.collect_list(held_key)).alias("keys"), F.bool_or(F.col("lo").isNull() & F.col("code")).alias("unknown"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or(F.col("lo").isNotNull() & F.col("code")).alias("code"))
    told_by = F.concat_ws("\n", "grp", F.array_join(F.transform("keys", lambda k: F.concat_ws("|", k["key"], k["n"].cast("string"))), ","))
    named = materialize(by_name.where("NOT unknown AND size(keys) > 0").withColumn("sid", F.md5(told_by) if near is None else F.col("id").cast("string")).drop("unknown"), "word-sets")
    sets = named.groupBy(F.col("sid").alias("id")).agg(F.first("grp").alias("grp"), F.first("keys").alias("keys"))
    mine = sets.select("id", "grp", F.explode("keys").alias("a"), "keys").select("id", "grp", "a", F.explode("keys").alias("b")).where("a.key < b.key OR (a.key = b.key AND a.n > 1)")
    wordy = postings.groupBy("grp", "rec").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED_WORDS).select("grp", "rec")
    theirs = postings.join(wordy, ["grp", "rec"], "left_anti").groupBy("grp", "rec").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    theirs = theirs.select("grp", "rec", F.explode("keys").alias("a"), "keys").select("grp", "rec", "a", F.explode("keys").alias("b")).where("a <= b")
    pairs = mine.select("id", "grp", F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"), "a", "b").join(theirs.select("grp", "rec", F.col("a").alias("key_a"), F.col("b").alias("key_b")), ["grp", "key_a", "key_b"])
    ends = pairs.select("id", "rec", F.explode(F.array("a", "b")).alias("e"))
    single = sets.select("id", "grp", F.explode("keys").alias("e")).withColumn("key", F.col("e.key")).join(postings.join(wordy, ["grp", "rec"], "left_semi"), ["grp", "key"]).select("id", "rec", "e")
    # with near words a word may stand for several keys, yet counts once
    matched = F.sum("e.n") if near is None else F.size(F.array_distinct(F.flatten(F.collect_list("e.words")))).cast("long")
    scored = ends.union(single).repartition("id", "rec").distinct().groupBy("id", "rec").agg(matched.alias("matched"))
    scored = materialize(scored.where(f"matched >= {MIN_WORDS}"), "word-scores")
    best = scored.groupBy("id").agg(F.max(F.struct("matched", "rec")).alias("top"), F.min(F.struct((-F.col("matched")).alias("neg"), F.col("rec"))).alias("alt"))
    best = materialize(best.select(F.col("id").alias("sid"), F.col("alt.rec").alias("rec"), F.col("top.rec").alias("other"), F.col("top.matched").alias("matched")), "word-best")
    top = named.select("id", "sid").join(best, "sid")
    out = top.where("rec = other").select("id", "rec", "matched")
    if numbers is not None:
        told = img.select("id", "grp", F.explode(F.array_distinct(F.filter(F.split(F.lower(stem(F.col("name"))), "[^a-zà-öø-ÿ0-9]+"), lambda t: t.rlike("^[0-9]+$")))).alias("key"))
        told = materialize(told.join(top.where("rec < other").select("id", "sid", "matched"), "id"), "told-numbers")
        tied = scored.withColumnRenamed("id", "sid").join(best.where("rec < other").select("sid", "matched"), ["sid", "matched"]).select("sid", "rec")
        held = told.select("sid", "grp", "key").distinct().join(tied, "sid").join(numbers, ["grp", "key", "rec"], "left_semi")
        telling = held.groupBy("sid", "key").agg(F.min("rec").alias("rec"), F.max("rec").alias("other")).where("rec = other").select("sid", "key", "rec")
        agreed = told.join(telling, ["sid", "key"]).groupBy("id").agg(F.min("rec").alias("rec"), F.max("rec").alias("other"), F.first("matched").alias("matched"))
        out = out.union(materialize(agreed.where("rec = other").select("id", "rec", "matched"), "told-records"))
    alone = named.where("lo = hi AND code").join(best.select("sid"), "sid", "left_anti")
    return out.union(alone.select("id", F.col("lo").alias("rec"), F.lit(1).cast("long").alias("matched")))


def near_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(grp, word, key): lexicon words one edit away from a word that the lexicon lacks, both of FUZZY_LENGTH or more.

    Words at distance one share a text with at most one character left out; that makes the search an equi-join.
    """
    lacks = words.where(F.length("word") >= FUZZY_LENGTH).select("grp", "word").distinct().join(lexicon.select("grp", F.col("key").alias("word")), ["grp", "word"], "left_anti")

    def less(c: str) -> Column:
        return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.substr(F.col(c), i + 1)))))

    a = lacks.select("grp", "word", F.explode(less("word")).alias("part"))
    b = lexicon.where(F.length("key") >= FUZZY_LENGTH).select("grp", "key").distinct().select("grp", "key", F.explode(less("key")).alias("part"))
    return a.join(b, ["grp", "part"]).select("grp", "word", "key").distinct().where("levenshtein(word, key) = 1")


def neighbour_words(cat: DataFrame) -> DataFrame:
    """(grp, key, rec): neighbouring words of a value written together, in either order; not two numbers."""
    words = cat.where("prop <> 'family_id'").select("grp", "rec", F.filter(F.split(F.lower("value"), "[^a-zà-öø-ÿ0-9]+"), lambda t: F.length(t) >= 2).alias("w")).where("size(w) >= 2")
    pairs = words.select("grp", "rec", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))).alias("p"))
    pairs = pairs.where("NOT (p.a RLIKE '^[0-9]+$' AND p.b RLIKE '^[0-9]+$')")
    return pairs.select("grp", "rec", F.explode(F.array(F.concat("p.a", "p.b"), F.concat("p.b", "p.a"))).alias("key")).distinct()


def feature_candidates(images: DataFrame, tokens: DataFrame, terms: DataFrame, used: DataFrame) -> DataFrame:
    """(id, grp, rec): names with the records of their group in the same colour and type that no name is matched to.

    ``images`` has (id, grp, color, type), ``terms`` the terms of both domains, ``used`` the (grp, rec) that are taken.
    """
    terms = terms.where("term_domain IN ('color', 'producttype')").select("term_domain", F.lower("term").alias("term"), "canonical_id").distinct()
    tokens = tokens.where("job_id IS NOT NULL AND family_id IS NOT NULL")

    def canon(domain: str, prop: str) -> tuple[DataFrame, DataFrame]:
        t = terms.where(F.col("term_domain") == domain).select("term", "canonical_id")
        fam = tokens.where(F.col("property_name") == prop).select(F.col("job_id").alias("grp"), F.col("family_id").alias("rec"), F.lower("family_token").alias("term")).join(t, "term").select("grp", "rec", F.col("canonical_id").alias(f"{prop}_id")).distinct()
        return t.select(F.col("term").alias(f"{prop}_term"), F.col("canonical_id").alias(f"{prop}_id")), fam

    ct, cf = canon("color", "color")
    pt, pf = canon("producttype", "producttype")
    fam = cf.join(pf, ["grp", "rec"]).join(used, ["grp", "rec"], "left_anti")
    own = images.join(ct, images["color"] == ct["color_term"]).join(pt, images["type"] == pt["producttype_term"]).select("id", "grp", "color_id", "producttype_id")
    return own.join(fam, ["grp", "color_id", "producttype_id"]).select("id", "grp", "rec").distinct()


def by_cell(img: DataFrame, sheet_rows: DataFrame) -> DataFrame:
    """(id, rec): names that a sheet's cell holds, all such rows having one and the same record number.

    A name is looked for as it is (base name with extension), then by its stem, then by its collapsed stem; the first
    way in which any cell holds it decides, also where its rows have several numbers and it stays unmatched.
    """
    # a row's one number is found in its array; each piece is taken apart once, however many rows hold it
    number = F.array_distinct(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c.rlike("^[0-9]{8}$")))
    rows = sheet_rows.select("cells", number.alias("n")).where("size(n) = 1").select(F.col("n")[0].alias("rec"), F.explode("cells").alias("c")).where("c IS NOT NULL")
    pieces = rows.select("rec", F.explode(F.split(F.lower(F.trim("c")), "[\\s,;]+")).alias("p")).where("length(p) >= 6").groupBy("p").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    piece = basename(F.col("p"))
    bare = F.when(extension(F.col("p")).isin(IMAGE_EXTENSIONS), stem(F.col("p"))).otherwise(piece)
    collapsed = F.translate(bare, " _-.", "")
    usable = (F.length(collapsed) >= 6) & ~collapsed.rlike("^[0-9]{8}$")

    def ways(*keys: Column) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(n).alias("way"), k.alias("key")) for n, k in enumerate(keys)]))

    index = pieces.where(usable).select("lo", "hi", ways(piece, bare, collapsed)).groupBy("way", "key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    asked = img.select("id", ways(F.lower(basename(F.col("name"))), F.lower(stem(F.col("name"))), collapsed_stem(F.col("name"))))
    first = asked.join(index, ["way", "key"]).groupBy("id").agg(F.min(F.struct("way", "lo", "hi")).alias("f"))
    return first.where("f.lo = f.hi").select("id", F.col("f.lo").alias("rec"))


def by_cell_start(img: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, rec): names whose collapsed stem starts with a reference of exactly one record of their group.

    The stem's leading parts are listed and joined, which makes the search for starts an equi-join.
    """
    stems = img.select("id", "grp", collapsed_stem(F.col("name")).alias("s"))
    starts = stems.where("length(s) >= 5").select("id", "grp", F.explode(F.transform(F.sequence(F.lit(5), F.length("s")), lambda n: F.substr("s", F.lit(1), n))).alias("key"))
    cat = tokens.where("property_name = 'refco' AND job_id IS NOT NULL AND family_token IS NOT NULL")
    index = cat.select(F.col("job_id").alias("grp"), F.col("family_id").alias("rec"), F.translate(F.lower("family_token"), " _-.", "").alias("key")).where("length(key) >= 5")
    return _sole(starts.join(holders(index), ["grp", "key"]))


def rare_profiles(img: DataFrame, ratio: float = 0.5, floor: int = 10) -> DataFrame:
    """(id, grp, profile): each name's profile words without those that more than ``ratio`` of the group (and
    ``floor``) carry."""
    words = img.select("id", "grp", F.explode(profile_tokens(F.col("name"))).alias("word"))
    size = img.groupBy("grp").agg(F.count("*").alias("total"))
    counts = words.groupBy("grp", "word").agg(F.count("*").alias("n")).where(f"n > {floor}").join(size, "grp").where(f"n > {ratio} * total").select("grp", "word")
    kept = words.join(counts, ["grp", "word"], "left_anti")
    return kept.groupBy("id", "grp").agg(F.array_sort(F.collect_set("word")).alias("profile"))


def by_equal_profile(profiles: DataFrame, known: DataFrame) -> DataFrame:
    """(id, rec): unmatched names whose profile the matched names of exactly one record have."""
    owned = profiles.join(known, "id").groupBy("grp", "profile").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo = hi")
    left = profiles.join(known.select("id"), "id", "left_anti")
    return left.join(owned, ["grp", "profile"]).select("id", F.col("lo").alias("rec"))


def by_related_profile(profiles: DataFrame, known: DataFrame, min_common: int = 2, reference_length: int = 5) -> DataFrame:
    """(id, rec): unmatched names whose profile contains, or is contained in, profiles of one record's names.

    The two must share ``min_common`` words or one of ``reference_length`` letters. Profiles are compared once
    each, not per name, and meet on the smaller one's rarest word: a contained profile's every word is shared.
    """
    own = materialize(profiles.join(known, "id").groupBy("grp", "profile").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")), "own-profiles")
    left = materialize(profiles.join(known.select("id"), "id", "left_anti"), "open-profiles")
    asked = left.select("grp", "profile").distinct()
    sets = asked.select("grp", "profile").union(own.select("grp", "profile")).distinct()
    freq = materialize(sets.select("grp", F.explode("profile").alias("word")).groupBy("grp", "word").agg(F.count("*").alias("n")), "word-frequencies")

    def rarest(df: DataFrame, *cols: str) -> DataFrame:
        ranked = df.select("grp", "profile", *cols, F.explode("profile").alias("word")).join(freq, ["grp", "word"])
        return ranked.groupBy("grp", "profile", *cols).agg(F.min(F.struct("n", "word"))["word"].alias("word"))

    o, a = own.select("grp", F.col("profile").alias("theirs"), "lo", "hi"), asked
    in_theirs = rarest(a).join(o.select("grp", "theirs", "lo", "hi", F.explode("theirs").alias("word")), ["grp", "word"]).where("size(array_except(profile, theirs)) = 0")
    in_mine = rarest(own, "lo", "hi").withColumnRenamed("profile", "theirs").join(a.select("grp", "profile", F.explode("profile").alias("word")), ["grp", "word"]).where("size(array_except(theirs, profile)) = 0")
    cols = ["grp", "profile", "theirs", "lo", "hi"]
    both = in_theirs.select(*cols).union(in_mine.select(*cols))
    enough = f"size(array_intersect(profile, theirs)) >= {min_common} OR exists(array_intersect(profile, theirs), w -> length(w) >= {reference_length})"
    sole = both.where(enough).groupBy("grp", "profile").agg(F.min("lo").alias("rec"), F.max("hi").alias("other")).where("rec = other").drop("other")
    return left.join(sole, ["grp", "profile"]).select("id", "rec")


def first_bracket(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, bracket, rec): each name's match by the first bracket in the list that found one."""
    all_ = None
    for n, (name, df) in enumerate(found):
        part = df.select("id", "rec", F.lit(n).alias("n"), F.lit(name).alias("bracket"))
        all_ = part if all_ is None else all_.union(part)
    best = all_.groupBy("id").agg(F.min(F.struct("n", "bracket", "rec")).alias("m"))
    return best.select("id", "m.bracket", "m.rec")


def outcome(img: DataFrame, matched: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, rec, bracket, reason): every name with its match, or why it has none.

    Without a match: several records hold its digit keys; it shows a number of eight digits that none has; or
    nothing was found.
    """
    index = holders(postings)
    tokens = img.select("id", "grp", F.explode(digit_tokens(F.col("name"))).alias("key"))
    several = tokens.join(index, ["grp", "key"]).groupBy("id").agg((F.min("lo") != F.max("hi")).alias("several"))
    eight = img.select("id", "grp", F.explode(digit_runs(stem(F.col("name")))).alias("key")).where(F.length("key") == 8).distinct()
    absent = eight.join(index.select("grp", "key"), ["grp", "key"], "left_anti").select("id", F.lit(True).alias("absent")).distinct()
    out = img.join(matched, "id", "left").join(several, "id", "left").join(absent, "id", "left")
    reason = F.when(F.col("rec").isNotNull(), F.lit(None).cast("string")).when(F.coalesce("several", F.lit(False)), "several records").when(F.coalesce("absent", F.lit(False)), "number not in catalogue").otherwise("nothing found")
    return out.select("id", "rec", "bracket", reason.alias("reason"))


def best_by_record(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def meaningful_folders(img: DataFrame, vocabulary: DataFrame, noise: list[str], least_siblings: int = 2) -> DataFrame:
    """(grp, parent, folder): folders that tell products apart: they hold a word of the vocabulary, and so many
    folders beside them hold words that mean something. ``img`` has (id, grp, name), ``vocabulary`` (grp, key)."""
    from weftline.functions.strings import BOUNDARY, CAMERA_PREFIXES, folded

    path = img.select("grp", F.regexp_extract("name", "^(.*)[/\\\\][^/\\\\]*$", 1).alias("path")).where("path <> ''").distinct()
    split = path.select("grp", F.regexp_extract("path", "^(.*?)[/\\\\]?[^/\\\\]*$", 1).alias("parent"), F.regexp_extract("path", "([^/\\\\]*)$", 1).alias("folder"))
    words = F.flatten(F.transform(F.split(folded(F.col("folder")), "[^a-z0-9]+"), lambda t: F.split(t, BOUNDARY)))
    dull = F.array(*[F.lit(w) for w in [*noise, *CAMERA_PREFIXES]])
    telling = split.select("grp", "parent", "folder", F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~F.array_contains(dull, t) & (~t.rlike("^[0-9]+$") | (F.length(t) >= MIN_DIGITS)))).alias("words")).where("size(words) > 0")
    crowd = telling.groupBy("grp", "parent").agg(F.count("*").alias("n")).where(F.col("n") >= least_siblings).select("grp", "parent")
    held = telling.select("grp", "parent", "folder", F.explode("words").alias("key")).join(vocabulary.select("grp", "key").distinct(), ["grp", "key"]).select("grp", "parent", "folder").distinct()
    return held.join(crowd, ["grp", "parent"], "left_semi")


def narrowed(candidates: DataFrame, tokens: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, grp, rec): each name's candidates narrowed by its tokens in their order; a token counts only if some,
    but not all, of the candidates that are left hold it. ``tokens`` has (id, grp, n, key), n from 0.

    One pass per place in the names, of which there are few; no candidate list is gathered.
    """
    last = tokens.agg(F.max("n")).first()[0]
    left = candidates.select("id", "grp", "rec")
    for n in range(0 if last is None else last + 1):
        key = tokens.where(F.col("n") == n).select("id", "key")
        held = left.join(key, "id").join(postings.select("grp", "key", "rec", F.lit(1).alias("has")), ["grp", "key", "rec"], "left")
        share = held.groupBy("id").agg(F.count("has").alias("some"), F.count("*").alias("all")).where("some > 0 AND some < all").select("id")
        keep = held.where("has = 1").join(share, "id", "left_semi").select("id", "grp", "rec")
        left = materialize(left.join(share, "id", "left_anti").union(keep), "narrowed")
    return left
