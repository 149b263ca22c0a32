"""Profiles of columns, and records collated from many rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import strip

FILL_RATIO = 0.2
OVERLAP = 0.2
CATEGORY_VALUES = 100
CATEGORY_LENGTH = 20
KEY_LENGTH = 8


def long_form(df: DataFrame, name: str) -> DataFrame:
    """(tab, col, value): every column of a table as text, in one pass."""
    cols = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    return df.select(F.lit(name).alias("tab"), F.inline(cols))


def profile(long: DataFrame) -> DataFrame:
    """(tab, col, n_rows, filled, n_values, max_length, kind, kept) of each column.

    Values are counted once per column and value, by 128 bits of it and what is asked of it, so that a value that fills
    a column is one row and long texts aren't moved. Kinds: key (all values distinct digits, long enough), number, mixed (letters and digits in one
    value), category (few short values), text, and empty. A column that is filled too rarely is not kept.
    """
    v = F.when(strip(F.col("value")) != "", strip(F.col("value")))
    told = long.select("tab", "col", v.alias("v")).select(
        "tab", "col", F.col("v").isNotNull().alias("filled"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second half"), "v").alias("h2"), F.length("v").alias("length"),
        F.col("v").rlike("^[+-]?[0-9]+([.][0-9]+)?$").alias("number"), (F.col("v").rlike("[A-Za-z]") & F.col("v").rlike("[0-9]")).alias("mixed"), F.col("v").rlike(f"^[0-9]{{{KEY_LENGTH},}}$").alias("digits"))
    counts = told.groupBy("tab", "col", "filled", "h1", "h2", "length", "number", "mixed", "digits").agg(F.count("*").alias("n"))
    out = counts.groupBy("tab", "col").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("filled"), F.col("n")).otherwise(0)).alias("filled"), F.count_if("filled").alias("n_values"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_length"), F.coalesce(F.bool_and("number"), F.lit(False)).alias("numbers"), F.coalesce(F.bool_or("mixed"), F.lit(False)).alias("mixed"),
        F.coalesce(F.bool_and("digits"), F.lit(False)).alias("digits"))
    kind = (F.when(F.col("n_values") == 0, "empty").when(F.col("digits") & (F.col("n_values") == F.col("filled")), "key").when(F.col("numbers"), "number").when(F.col("mixed"), "mixed")
            .when((F.col("n_values") <= CATEGORY_VALUES) & (F.col("max_length") <= CATEGORY_LENGTH), "category").otherwise("text"))
    return out.select("tab", "col", "n_rows", "filled", "n_values", "max_length", kind.alias("kind"), (F.col("filled") >= FILL_RATIO * F.col("n_rows")).alias("kept"))


def overlaps(values: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """(a, b, shared, ratio) of columns that share more than ``threshold`` of the smaller one's distinct values.

    ``values`` has (col, value). A value joins at most once per pair of columns that hold it, never per row.
    """
    distinct = values.where("value IS NOT NULL AND value <> ''").distinct()
    sizes = distinct.groupBy("col").agg(F.count("*").alias("n"))
    per = distinct.groupBy("value").agg(F.array_sort(F.collect_set("col")).alias("cols")).where("size(cols) > 1")
    pairs = per.select(F.explode("cols").alias("a"), "cols").select("a", F.explode("cols").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = pairs.join(sizes.select(F.col("col").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("col").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("ratio")).where(F.col("ratio") > threshold)


def merged_groups(order: list[str], pairs: list[tuple[str, str]]) -> dict[str, str]:
    """First column of each column's group: from left to right, a column joins the first group one of whose
    members it overlaps. Works on the few column names of a table, not on data."""
    linked = {frozenset(p) for p in pairs}
    groups: list[list[str]] = []
    for c in order:
        home = next((g for g in groups if any(frozenset((c, m)) in linked for m in g)), None)
        if home is None:
            groups.append([c])
        else:
            home.append(c)
    return {c: g[0] for g in groups for c in g}


def collate(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key: its distinct values (without case), their tokens, the canonical value and if they conflict.

    A single value is canonical as it is; several are replaced by all their tokens in order. Values are made
    distinct, map-side, before any group is gathered; a record's row then holds all of them, as its definition asks.
    """
    distinct = values.where(strip(F.col(value)) != "").groupBy(*keys, F.lower(strip(F.col(value))).alias("_low")).agg(F.min(strip(F.col(value))).alias("_v"))
    gathered = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("values"), F.collect_list("_low").alias("_lows"))
    tokens = F.array_sort(F.array_distinct(F.flatten(F.transform("_lows", lambda v: F.filter(F.split(v, "[^\\p{L}\\p{Nd}]+"), lambda t: t != "")))))
    out = gathered.withColumn("tokens", tokens)
    several = F.size("values") > 1
    return out.select(*keys, "values", "tokens", F.when(several, F.array_join("tokens", " ")).otherwise(F.element_at("values", 1)).alias("canonical"), several.alias("conflict"))


def header_matches(cells: DataFrame, terms: DataFrame, stop_words: list[str]) -> DataFrame:
    """(header_id, canonical_id, confidence): what a header cell's folded text or words mean, at best.

    ``cells`` has (header_id, phrase, words), ``terms`` (canonical_id, term). A phrase that is a term has
    confidence 1, and so has a word of a term; a word of four letters one edit from a term's word has 0.75.
    """
    from weftline.operators.matching import near_words

    phrases = cells.join(terms.select(F.col("term").alias("phrase"), "canonical_id"), "phrase").select("header_id", "canonical_id", F.lit(1.0).alias("confidence"))
    vocabulary = terms.select("canonical_id", F.explode(F.split("term", " ")).alias("key")).where(~F.col("key").isin(stop_words)).distinct()
    words = cells.select("header_id", F.explode("words").alias("word")).where(~F.col("word").isin(stop_words)).distinct()
    exact = words.join(vocabulary, words["word"] == vocabulary["key"]).select("header_id", "canonical_id", F.lit(1.0).alias("confidence"))
    lexicon = vocabulary.select(F.lit("").alias("grp"), "key").distinct()
    near = near_words(words.select(F.lit("").alias("grp"), "word"), lexicon)
    fuzzy = words.join(near, "word").join(vocabulary, "key").select("header_id", "canonical_id", F.lit(0.75).alias("confidence"))
    return phrases.union(exact).union(fuzzy).groupBy("header_id", "canonical_id").agg(F.max("confidence").alias("confidence"))


def whole_header_ids(cells: DataFrame, terms: DataFrame, stop_words: list[str]) -> DataFrame:
    """(header_id, canonical): the one id that the whole phrase, else every significant word, stands for; else the
    raw header with single spaces, or ColumnN if it is blank."""
    phrase = terms.groupBy(F.col("term").alias("phrase")).agg(F.min("canonical_id").alias("by_phrase"))
    vocabulary = terms.select("canonical_id", F.explode(F.split("term", " ")).alias("word")).where(~F.col("word").isin(stop_words)).distinct()
    owners = vocabulary.groupBy("word").agg(F.min("canonical_id").alias("lo"), F.max("canonical_id").alias("hi"))
    words = cells.select("header_id", F.explode("words").alias("word")).where(~F.col("word").isin(stop_words)).distinct().join(owners, "word", "left")
    sole = words.groupBy("header_id").agg(F.bool_and(F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))).alias("all_known"), F.min("lo").alias("by_words"), F.max("hi").alias("other")).where("all_known AND by_words = other")
    spaced = strip(F.regexp_replace("raw", "\\s+", " "))
    raw = F.when(spaced != "", spaced).otherwise(F.concat(F.lit("Column"), F.col("column_index")))
    return cells.join(phrase, "phrase", "left").join(sole.select("header_id", "by_words"), "header_id", "left").select("header_id", F.coalesce("by_phrase", "by_words", raw).alias("canonical"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def orphan_owner(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(row_id, rec): the record that the keys of a row without one lead to, if it is the only one."""
    held = index.groupBy("key").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    agg = keys.join(held, "key").groupBy("row_id").agg(F.min("lo").alias("rec"), F.max("hi").alias("other"))
    return agg.where("rec = other").select("row_id", "rec")


def digit_keys(value: Column, low: int = 6, high: int = 18) -> Column:
    """All digits of a value if their number fits, and its longer digit runs."""
    whole = F.regexp_replace(value, "[^0-9]", "")
    runs = F.filter(F.regexp_extract_all(value, F.lit("[0-9]+"), 0), lambda r: F.length(r) >= low)
    return F.array_union(F.when(F.length(whole).between(low, high), F.array(whole)).otherwise(F.array().cast("array<string>")), runs)


def sole_words(terms: DataFrame, ident: str, stop_words: list[str]) -> DataFrame:
    """(word): the words of terms that stand for ``ident`` and for no other id."""
    words = terms.select("canonical_id", F.explode(F.split("term", " ")).alias("word")).where(~F.col("word").isin(stop_words))
    return words.groupBy("word").agg(F.min("canonical_id").alias("lo"), F.max("canonical_id").alias("hi")).where((F.col("lo") == ident) & (F.col("hi") == ident)).select("word")


def header_row(cells: DataFrame, least_share: float = 0.4, least_matched: int = 2) -> DataFrame:
    """(file, sheet, row, row_id, filled, matched, confidence): the row of each sheet that is taken for its header.

    ``cells`` has (file, sheet, row, row_id, col, confidence, is_key) of the filled cells of the rows and columns that
    are searched; confidence is null where a cell isn't understood. A row qualifies by the share of its cells that are
    understood, or by a key header beside at least one other; the most understood cells win, then their mean
    confidence, then the first row (and the smallest id of rows that stand at one place).
    """
    rows = cells.groupBy("file", "sheet", "row", "row_id").agg(F.count("*").alias("filled"), F.count("confidence").alias("matched"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.bool_or("is_key").alias("has_key"))
    rows = rows.where((F.col("matched") >= least_share * F.col("filled")) | (F.col("has_key") & (F.col("matched") >= least_matched)))
    best = F.max(F.struct("matched", F.round("confidence", 9).alias("confidence"), (-F.col("row")).alias("row"), (-F.col("row_id")).alias("row_id"), "filled")).alias("b")
    return rows.groupBy("file", "sheet").agg(best).select("file", "sheet", (-F.col("b.row")).alias("row"), (-F.col("b.row_id")).alias("row_id"), "b.filled", "b.matched", "b.confidence")


def key_column(headers: DataFrame, values: DataFrame, pattern: str = "^[0-9]{8}$") -> DataFrame:
    """(file, sheet, key_col): the column that holds each sheet's keys, null where none does.

    ``headers`` has (file, sheet, col, is_key) of the header rows' filled cells, ``values`` (file, sheet, col, value) of
    the rows below. The one key header's column it is; of several the leftmost whose values all fit the pattern and
    differ, else the leftmost; without a key header the only column whose values do. Values are counted once per
    column and value before a column is judged, so a value that fills it is one row.
    """
    counted = values.where(strip(F.col("value")) != "").groupBy("file", "sheet", "col", F.lower(strip(F.col("value"))).alias("value")).agg(F.count("*").alias("n"))
    fit = counted.groupBy("file", "sheet", "col").agg((F.bool_and(F.col("value").rlike(pattern)) & (F.max("n") == 1)).alias("fits"))
    own = headers.join(fit, ["file", "sheet", "col"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))
    named, both = F.when(F.col("is_key"), F.col("col")), F.when(F.col("is_key") & F.col("fits"), F.col("col"))
    per = own.groupBy("file", "sheet").agg(F.count(named).alias("n"), F.min(named).alias("named"), F.min(both).alias("both"), F.count(F.when(F.col("fits"), 1)).alias("n_fit"), F.min(F.when(F.col("fits"), F.col("col"))).alias("fit"))
    chosen = F.when(F.col("n") == 1, F.col("named")).when(F.col("n") > 1, F.coalesce("both", "named")).when(F.col("n_fit") == 1, F.col("fit"))
    return per.select("file", "sheet", chosen.alias("key_col"))
