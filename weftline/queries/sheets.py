"""Sheets whose header is not known: which row it is, and which column holds the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import strings as S
from weftline.functions.text import strip
from weftline.operators import profile as P
from weftline.queries.strings import FOLD
from weftline.session import materialize, table

#: Last row and column in which a header is looked for, from 0 (fixed values), and what keys are called.
LAST_ROW, LAST_COLUMN = 20, 20
KEY = "family_number"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """(file, sheet, row, row_id, col, raw): the filled cells of all worksheet rows, and of all header cells as row 0."""
    rows = table(spark, d, "worksheet_rows").select(F.col("source_file").alias("file"), F.col("sheet_name").alias("sheet"), F.col("row_index").alias("row"), "row_id", F.posexplode("cells").alias("col", "raw"))
    heads = table(spark, d, "header_cells").select("source_file", "sheet_name", F.lit(0), F.lit(0).cast("long"), "column_index", "raw_header")
    return rows.union(heads).where(strip(F.col("raw")) != "")


def _understood(spark: SparkSession, d: str, cells: DataFrame) -> DataFrame:
    """``cells`` with ``confidence`` and ``is_key``; each phrase is looked up once."""
    terms = table(spark, d, "translation_terms").where("term_domain = 'header'").select("canonical_id", F.array_join(S.header_tokens(F.col("term")), " ").alias("term"))
    cells = materialize(cells.withColumn("phrase", F.array_join(S.header_tokens(F.col("raw")), " ")), "sheet-cells")
    phrases = cells.select("phrase").distinct().select(F.col("phrase").alias("header_id"), "phrase", F.split("phrase", " ").alias("words"))
    known = P.header_matches(phrases, terms, S.STOP_GENERAL).groupBy(F.col("header_id").alias("phrase")).agg(F.max("confidence").alias("confidence"))
    words = phrases.select("phrase", F.explode("words").alias("word")).join(P.sole_words(terms, KEY, S.STOP_GENERAL), "word").select("phrase", F.lit(True).alias("is_key")).distinct()
    return cells.join(known, "phrase", "left").join(words, "phrase", "left").withColumn("is_key", F.coalesce("is_key", F.lit(False))).drop("phrase")


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return materialize(_understood(spark, d, _cells(spark, d).where(f"row BETWEEN 0 AND {LAST_ROW} AND col BETWEEN 0 AND {LAST_COLUMN}")), "sheet-searched")


def header_search(spark: SparkSession, d: str) -> DataFrame:
    """The row of each sheet that is taken for its header."""
    return P.header_row(_searched(spark, d))


def sheet_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key column of each sheet with a header row; null where no column is one."""
    searched = _searched(spark, d)
    found = materialize(P.header_row(searched).select("file", "sheet", F.col("row").alias("at"), F.col("row_id").alias("at_id")), "sheet-headers")
    headers = searched.join(found, ["file", "sheet"]).where("row = at AND row_id = at_id").select("file", "sheet", "col", "is_key")
    below = _cells(spark, d).join(found, ["file", "sheet"]).where("row > at").select("file", "sheet", "col", F.col("raw").alias("value"))
    return P.key_column(headers, below)


QUERIES = {f.__name__: f for f in (header_search, sheet_keys)}

_TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in S.STOP_GENERAL)
_SHEETS = f"""cells AS (SELECT * FROM (
  SELECT source_file AS file, sheet_name AS sheet, row_index AS row, row_id, CAST(generate_subscripts(cells, 1) - 1 AS INT) AS col, unnest(cells) AS raw FROM worksheet_rows
  UNION ALL SELECT source_file, sheet_name, 0, 0, column_index, raw_header FROM header_cells) WHERE {_TRIM.format(x='raw')} <> ''),
near AS (SELECT *, array_to_string(regexp_extract_all({FOLD.format(x='raw')}, '[a-z0-9]+'), ' ') AS phrase FROM cells WHERE row BETWEEN 0 AND 20 AND col BETWEEN 0 AND 20),
terms AS (SELECT canonical_id, array_to_string(regexp_extract_all({FOLD.format(x='term')}, '[a-z0-9]+'), ' ') AS term FROM translation_terms WHERE term_domain = 'header'),
vocab AS (SELECT DISTINCT canonical_id, key FROM (SELECT canonical_id, unnest(string_split(term, ' ')) AS key FROM terms) WHERE key NOT IN ({_STOP})),
words AS (SELECT DISTINCT phrase, word FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS word FROM (SELECT DISTINCT phrase FROM near)) WHERE word NOT IN ({_STOP})),
fuzzy AS (SELECT DISTINCT word FROM words JOIN (SELECT DISTINCT key FROM vocab) ON len(word) >= 4 AND len(key) >= 4 AND levenshtein(word, key) = 1 WHERE word NOT IN (SELECT key FROM vocab)),
conf AS (SELECT phrase, max(c) AS confidence FROM (SELECT phrase, 1.0 AS c FROM words WHERE word IN (SELECT key FROM vocab) UNION ALL SELECT term, 1.0 FROM terms UNION ALL SELECT phrase, 0.75 FROM words WHERE word IN (SELECT word FROM fuzzy)) GROUP BY 1),
keyed AS (SELECT DISTINCT phrase FROM words WHERE word IN (SELECT key FROM vocab GROUP BY 1 HAVING min(canonical_id) = '{KEY}' AND max(canonical_id) = '{KEY}')),
searched AS (SELECT near.*, CAST(confidence AS DOUBLE) AS confidence, phrase IN (SELECT phrase FROM keyed) AS is_key FROM near LEFT JOIN conf USING (phrase)),
head AS (SELECT file, sheet, row, row_id, filled, matched, round(confidence, 9) AS confidence FROM (SELECT file, sheet, row, row_id, count(*) AS filled, count(confidence) AS matched, coalesce(avg(confidence), 0.0) AS confidence, bool_or(is_key) AS has_key FROM searched GROUP BY ALL)
  WHERE matched >= 0.4 * filled OR (has_key AND matched >= 2) QUALIFY row_number() OVER (PARTITION BY file, sheet ORDER BY matched DESC, round(confidence, 9) DESC, row, row_id) = 1)"""
ORACLE = {
    "header_search": f"WITH {_SHEETS} SELECT * FROM head",
    "sheet_keys": f"""WITH {_SHEETS}, h AS (SELECT s.file, s.sheet, s.col, s.is_key FROM searched s JOIN head USING (file, sheet, row, row_id)),
v AS (SELECT c.file, c.sheet, c.col, lower({_TRIM.format(x='c.raw')}) AS v FROM cells c JOIN head ON c.file = head.file AND c.sheet = head.sheet AND c.row > head.row),
f AS (SELECT file, sheet, col FROM v GROUP BY ALL HAVING bool_and(regexp_matches(v, '^[0-9]{{8}}$')) AND count(*) = count(DISTINCT v)),
o AS (SELECT h.*, f.col IS NOT NULL AS fits FROM h LEFT JOIN f USING (file, sheet, col))
SELECT file, sheet, CASE WHEN count(*) FILTER (is_key) = 1 THEN min(col) FILTER (is_key) WHEN count(*) FILTER (is_key) > 1 THEN coalesce(min(col) FILTER (is_key AND fits), min(col) FILTER (is_key)) WHEN count(*) FILTER (fits) = 1 THEN min(col) FILTER (fits) END AS key_col FROM o GROUP BY 1, 2""",
}
