"""Registered queries of the core operators with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators.packed_values import split_values
from weftline.queries import matching, more, sheets, streams, strings, tables, whole
from weftline.session import table


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Value coverage of each property: filled rows, families and share of rows with several entries."""
    v = table(spark, d, "property_values")
    name = F.lower(F.regexp_replace("property_name", "[^\\p{L}\\p{Nd}]+", ""))
    filled = F.coalesce(F.size("source_values"), F.lit(0)) > 0
    return v.groupBy(name.alias("property")).agg(F.count("*").alias("n_rows"), F.count_if(filled).alias("n_filled"),
                                                 F.countDistinct("family_id").alias("n_families"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All values of the records in which an entry holds several."""
    return split_values([
        ("property_values", table(spark, d, "property_values"), "value_id", "property_name", "source_values"),
        ("family_conflicts", table(spark, d, "family_conflicts"), "conflict_id", "property_name", "source_values"),
    ])


QUERIES: dict = {"property_coverage": flagship, "p3_found": p3_found}
ORACLE: dict = {
    "property_coverage": "SELECT lower(regexp_replace(property_name, '[^\\p{L}\\p{Nd}]+', '', 'g')) AS property, count(*) AS n_rows, "
    "count(*) FILTER (WHERE len(source_values) > 0) AS n_filled, count(DISTINCT family_id) AS n_families FROM property_values GROUP BY 1",
}
for _module in (strings, matching, tables, streams, more, sheets):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
ORACLE |= whole.ORACLE
