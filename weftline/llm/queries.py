"""The registered queries of this subpackage and, where SQL can express them, their equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import duplicates, leakage, linking, packing, reading_level, survivors, vocabulary
from weftline.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys = duplicates.worksheet_keys(table(spark, d, "worksheet_rows")).union(duplicates.property_keys(table(spark, d, "property_values")))
    return duplicates.duplicate_copies(keys)


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its number of copies."""
    keys = duplicates.worksheet_keys(table(spark, d, "worksheet_rows")).union(duplicates.property_keys(table(spark, d, "property_values")))
    return duplicates.count_copies(keys).select("table_name", "first_id", "copies")


def p2_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every header cell with the entry it means and its distance."""
    heads, terms = table(spark, d, "header_cells"), table(spark, d, "translation_terms").where("term_domain = 'header'")
    return vocabulary.map_values(heads.select("header_id", "raw_header"), "raw_header", terms, "term", "canonical_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_mapped(spark, d).where("match_id IS NOT NULL").select("header_id", F.col("match_id").alias("canonical_id"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Every image without a family that the cascade resolves, with the rule and its confidence."""
    return linking.link(*(table(spark, d, t) for t in ("match_evidence", "token_evidence", "translation_terms")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("evidence_id", "family_id")


def _member_fields(df: DataFrame) -> survivors.Fields:
    area = df["normalized_width"].cast("long") * df["normalized_height"].cast("long")
    sized = F.when((df["normalized_width"] > 0) & (df["normalized_height"] > 0), area)
    return survivors.Fields(df["group_id"], df["member_id"], df["source_kind"], df["delivered_at"],
                            {c: df[c] for c in ("family_id", "color_name", "product_type", "caption")}, sized)


def _conflict_fields(df: DataFrame) -> survivors.Fields:
    group = F.concat(df["family_id"], F.lit("|"), df["property_name"])
    return survivors.Fields(group, df["conflict_id"], df["source_kind"], df["recorded_at"], {"reason_code": df["reason_code"]})


def _p5(spark: SparkSession, d: str) -> DataFrame:
    members, conflicts, trust = (table(spark, d, t) for t in ("dedup_members", "family_conflicts", "source_trust"))
    out = [survivors.survivors(df, trust, spec).select(F.lit(name).alias("table_name"), "*")
           for name, df, spec in (("dedup_members", members, _member_fields(members)), ("family_conflicts", conflicts, _conflict_fields(conflicts)))]
    return out[0].union(out[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("table_name", "group_key", "field_name", "value_text")


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per image group, its gaps filled from the group's other records."""
    members = table(spark, d, "dedup_members")
    return survivors.surviving_records(members, table(spark, d, "source_trust"), _member_fields(members)).drop("undominated")


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each document and the training sequences they stand in."""
    return packing.pack(table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item with the kind of the leak."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "benchmark_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("kind = 'own text'").select("doc_id", "item_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document."""
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).where("n_words >= 25 AND level >= 3.5").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_mapped, p4_found, p4_links, p5_found, p5_survivors, p6_sequences, p7_found, p7_leaks, p8_found, p8_levels)}



def _canon(x: str) -> str:
    mark = "([0-9])[.,]([0-9])"
    e = f"nfc_normalize(replace({x}, '\u00a4', ' '))"
    for _ in range(2):  # twice, as neighbouring marks share a digit
        e = f"regexp_replace({e}, '{mark}', '\\1\u00a4\\2', 'g')"
    e = f"regexp_replace({e}, '[^\\p{{L}}\\p{{Nd}}\u00a4]', '', 'g')"
    return f"replace(lower(replace({e}, '\u00a4', '.')), '\u00df', 'ss')"


_P1 = f"""
WITH w AS (
  SELECT row_id AS id, list_sort([y for y in [{_canon('x')} for x in cells] if y <> '']) AS k FROM worksheet_rows
), v AS (
  SELECT value_id AS id, {_canon("coalesce(family_id, '')")} AS f, {_canon("coalesce(property_name, '')")} AS p,
         list_sort([y for y in [{_canon('x')} for x in source_values] if y <> '']) AS k FROM property_values
), r AS (
  SELECT 'worksheet_rows' AS table_name, id, '' AS f, '' AS p, k FROM w WHERE len(k) >= 3
  UNION ALL SELECT 'property_values', id, f, p, k FROM v WHERE len(k) >= 1
), g AS (SELECT table_name, f, p, k, min(id) AS first_id, count(*) AS copies FROM r GROUP BY ALL)
"""

_MISSING = "('" + "', '".join(survivors.MISSING) + "')"


def _best(table_name: str, key: str, ident: str, time: str, field: str, value: str) -> str:
    v = f"regexp_replace({value}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    return f"""SELECT '{table_name}' AS table_name, k AS group_key, '{field}' AS field_name, v AS value_text FROM (
      SELECT {key} AS k, {v} AS v, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(trust_rank, 2147483647), {time} DESC NULLS LAST, {ident}) AS rn
      FROM {table_name} m LEFT JOIN source_trust t ON lower(trim(m.source_kind)) = t.source_kind
      WHERE {key} IN (SELECT {key} FROM {table_name} GROUP BY 1 HAVING count(*) > 1)
        AND {v} <> '' AND lower({v}) NOT IN {_MISSING}) WHERE rn = 1"""


_FIELDS = ("family_id", "color_name", "product_type", "caption")
_HELD = "CASE WHEN {v} <> '' AND lower({v}) NOT IN " + _MISSING + " THEN {v} END"
_COUNT = "(" + " + ".join(f"({f} IS NOT NULL)::INT" for f in _FIELDS) + ")"
#: Layers by peeling: a record's layer is the length of the longest chain of records that dominate one another down to it.
_SURVIVORS = "WITH RECURSIVE m AS (SELECT CAST(group_id AS VARCHAR) AS group_key, member_id, coalesce(trust_rank, 2147483647) AS rank, coalesce(delivered_at, TIMESTAMP '0001-01-01') AS t, " + ", ".join(
    _HELD.format(v=f"regexp_replace({f}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')") + f" AS {f}" for f in _FIELDS) + f""" FROM dedup_members m LEFT JOIN source_trust t ON lower(trim(m.source_kind)) = t.source_kind
  WHERE group_id IN (SELECT group_id FROM dedup_members GROUP BY 1 HAVING count(*) > 1)),
r AS (SELECT *, {_COUNT} AS n FROM m QUALIFY row_number() OVER (PARTITION BY group_key, rank, {', '.join(f + ' IS NULL' for f in _FIELDS)} ORDER BY t DESC, member_id) = 1),
d AS (SELECT x.member_id AS id, y.member_id AS over FROM r x JOIN r y ON x.group_key = y.group_key AND y.rank <= x.rank AND y.t >= x.t AND y.n >= x.n AND (y.rank < x.rank OR y.t > x.t OR y.n > x.n)),
l AS (SELECT member_id AS id, 1 AS layer FROM r UNION SELECT d.id, l.layer + 1 FROM l JOIN d ON d.over = l.id),
k AS (SELECT r.*, layer FROM r JOIN (SELECT id, max(layer) AS layer FROM l GROUP BY 1) ON id = member_id),
s AS (SELECT group_key, member_id AS survivor_id, """ + ", ".join(f"{f} AS o_{f}" for f in _FIELDS) + """ FROM k QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY layer, rank, t DESC, n DESC, member_id) = 1)""" + "".join(
    f", f_{f} AS (SELECT group_key, {f} FROM k WHERE {f} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY layer, rank, t DESC, n DESC, member_id) = 1)" for f in _FIELDS) + \
    " SELECT group_key, survivor_id, " + ", ".join(_FIELDS) + ", " + " + ".join(f"(o_{f} IS NULL AND {f} IS NOT NULL)::INT" for f in _FIELDS) + " AS filled FROM s" + "".join(f" LEFT JOIN f_{f} USING (group_key)" for f in _FIELDS)

ORACLE = {
    "p5_survivors": _SURVIVORS,
    "p1_found": _P1 + "SELECT r.table_name, g.first_id, r.id AS copy_id FROM r JOIN g USING (table_name, f, p, k) WHERE r.id <> g.first_id",
    "p1_records": _P1 + "SELECT table_name, first_id, copies FROM g",
    "p5_found": " UNION ALL ".join(
        [_best("dedup_members", "CAST(group_id AS VARCHAR)", "member_id", "delivered_at", f, f) for f in ("family_id", "color_name", "product_type", "caption")]
        + [_best("family_conflicts", "family_id || '|' || property_name", "conflict_id", "recorded_at", "reason_code", "reason_code")]
        + ["""SELECT 'dedup_members', k, 'canonical', CAST(member_id AS VARCHAR) FROM (
      SELECT CAST(group_id AS VARCHAR) AS k, member_id, row_number() OVER (PARTITION BY group_id ORDER BY CAST(normalized_width AS BIGINT) * normalized_height DESC,
        coalesce(trust_rank, 2147483647), delivered_at DESC NULLS LAST, member_id) AS rn
      FROM dedup_members m LEFT JOIN source_trust t ON lower(trim(m.source_kind)) = t.source_kind
      WHERE group_id IN (SELECT group_id FROM dedup_members GROUP BY 1 HAVING count(*) > 1) AND normalized_width > 0 AND normalized_height > 0) WHERE rn = 1"""]),
}
