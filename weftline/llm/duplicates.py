"""Records that differ only in writing: one record each, with its number of copies.

Method: canonicalize characters, case, whitespace, punctuation and part order; hash to 128 bits;
count with map-side combining; check every hash for collisions by an independent digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import SEP, canonical_parts, canonical_text
from weftline.session import materialize

#: At most so many groups can each hold more than 1/HOT_GROUPS of all rows; those are joined by broadcast.
HOT_GROUPS = 1024
#: A group below this many rows is never treated as hot.
HOT_LEAST = 10_000

KEYS = ["table_name", "h1", "h2", "h3"]


def keyed(df: DataFrame, table_name: str, id_col: str, key: Column) -> DataFrame:
    """(table_name, id, h1, h2, h3) of the rows whose canonical ``key`` isn't null.

    h1 and h2 are the 128-bit hash, h3 an independent check digest (other function seed and the length).
    """
    # exploding keeps the filled keys only; a filter on the key would be pushed below and compute it twice
    slim = df.select(F.col(id_col).cast("long").alias("id"), key.alias("key")).where("id IS NOT NULL").select("id", F.explode(F.array_compact(F.array("key"))).alias("key"))
    return slim.select(
        F.lit(table_name).alias("table_name"), "id",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second half"), "key").alias("h2"),
        (F.xxhash64(F.length("key"), F.crc32(F.col("key").cast("binary")), F.lit("check"), "key")).alias("h3"),
    )


def unordered_key(parts: Column, least: int = 1) -> Column:
    """Canonical key of an array whose order does not count; null with fewer than ``least`` filled parts."""
    canon = canonical_parts(parts)
    return F.when(F.size(canon) >= least, F.array_join(canon, SEP))


def worksheet_keys(df: DataFrame) -> DataFrame:
    """Rows of a worksheet: cells agree in any order; fewer than three filled cells are no record."""
    return keyed(df, "worksheet_rows", "row_id", unordered_key(df["cells"], 3))


def property_keys(df: DataFrame) -> DataFrame:
    """Properties: family, property name and the entries in any order; without values they are no record."""
    entries = unordered_key(df["source_values"])
    head = canonical_text(F.concat_ws(SEP, F.translate(F.coalesce(df["family_id"], F.lit("")), SEP, " "), F.translate(F.coalesce(df["property_name"], F.lit("")), SEP, " ")))
    return keyed(df, "property_values", "value_id", F.when(entries.isNotNull(), F.concat_ws(SEP, head, F.lit(""), entries)))


def count_copies(keys: DataFrame) -> DataFrame:
    """One row per record: (table_name, h1, h2, h3, first_id, copies).

    Partial counts are made before the shuffle, so a key that holds a third of all rows sends one row per
    task. Rows of one 128-bit hash whose check digests differ are different records: they are told apart
    by grouping on the digest as well, and ``collision_report`` shows them.
    """
    return keys.groupBy(*KEYS).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))


def collision_report(counts: DataFrame) -> DataFrame:
    """128-bit hashes under which more than one record stands (expected: none)."""
    return counts.groupBy("table_name", "h1", "h2").agg(F.count("*").alias("records")).where("records > 1")


def further_copies(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id), one row per further copy.

    ``keys`` and ``counts`` are tables written before. Records with the most copies (at most HOT_GROUPS)
    are joined by broadcast, which leaves no key with more than 1/HOT_GROUPS of the rows to the shuffle.
    """
    many = counts.where("copies > 1").select(*KEYS, "first_id", "copies")
    hot = many.where(F.col("copies") >= HOT_LEAST).orderBy(F.desc("copies"), *KEYS).limit(HOT_GROUPS)
    hot = F.broadcast(hot.select(*KEYS, F.col("first_id").alias("hot_id")))
    marked = keys.join(hot, KEYS, "left")
    of_hot = marked.where("hot_id IS NOT NULL").select("table_name", F.col("hot_id").alias("first_id"), F.col("id").alias("copy_id"))
    rest = marked.where("hot_id IS NULL").join(many.select(*KEYS, "first_id"), KEYS).select("table_name", "first_id", F.col("id").alias("copy_id"))
    return of_hot.union(rest).where("copy_id <> first_id")


def duplicate_copies(keys: DataFrame) -> DataFrame:
    """The further copies of all records in ``keys``, the operator's result.

    Defined cases: null or empty arrays, null and blank parts and rows with too few filled parts are no
    records; a null family or property name counts as an empty one; repeated parts count as often as they
    stand; ids may repeat (the smallest is the first, equal ids are the same row); an empty table gives
    empty results; other columns are never read.
    """
    slim = materialize(keys, "dup-keys")
    counts = materialize(count_copies(slim).where("copies > 1"), "dup-counts")
    return further_copies(slim, counts)
