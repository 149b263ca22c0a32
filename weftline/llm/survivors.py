"""Best representative of each duplicate group: one value per field, or one record filled from the others.

Method: skyline selection. Records compete with three qualities: completeness, recency and the trust in their
source. A record that another one beats in one quality and equals in the rest is dominated. The undominated ones
are the first layer; without them, the next undominated ones are the second, and so on. In a layer a lexicographic
policy decides: trust, recency, completeness, smallest id.

``surviving_records`` takes the policy's first record of the first layer and fills its nulls from layer after layer.
``survivors`` answers field by field; there completeness is to hold the field, so the policy's first holder is in the
first layer always, and the further layers can't change a value.

A group may be of any size. Trust has few ranks (those of the trust table and one for all others) and few sets of
fields can be held, so each group is first reduced, with map-side combining, to the newest record per rank and set of
held fields (per rank, for one field). Older ones of the same rank and set hold nothing that their newest doesn't, so
layers are taken over the newest, in one short array per group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.text import strip

#: Texts that stand for a missing value, compared trimmed and without case (fixed values of the task).
MISSING = ["n/a", "#n/a", "-", "--", "?", "unknown", "tbd", "none", "(leer)"]
#: Rank of null and unlisted sources: after all others.
UNLISTED = 2_147_483_647


@dataclass(frozen=True)
class Fields:
    """What a table is resolved by. ``size`` (if any) is a positive number whose largest holder gives the
    field ``canonical``, as its id."""

    group: Column
    id: Column
    source: Column
    time: Column
    values: dict[str, Column]
    size: Column | None = None


def present(c: Column) -> Column:
    """The trimmed value, or null if it is missing."""
    v = strip(c.cast("string"))
    return F.when((v != "") & ~F.lower(v).isin(MISSING), v)


def ranked(df: DataFrame, trust: DataFrame, spec: Fields) -> DataFrame:
    """Qualities of each record. The trust table is small and fixed; Spark broadcasts it by its size."""
    rank = trust.select(F.lower(strip(F.col("source_kind"))).alias("_kind"), F.col("trust_rank").cast("int").alias("_rank"))
    rank = rank.where("_kind IS NOT NULL").groupBy("_kind").agg(F.min("_rank").alias("_rank"))
    base = df.select(
        spec.group.cast("string").alias("group_key"), spec.id.cast("long").alias("_id"),
        F.lower(strip(spec.source)).alias("_kind"), spec.time.alias("_time"),
        *[present(c).alias(f"v_{f}") for f, c in spec.values.items()],
        *([F.when(spec.size > 0, spec.size.cast("long")).alias("v_canonical")] if spec.size is not None else []),
    ).where("group_key IS NOT NULL")
    return base.join(rank, "_kind", "left").withColumn("_rank", F.coalesce("_rank", F.lit(UNLISTED))).drop("_kind")


def holders(base: DataFrame, names: list[str]) -> DataFrame:
    """Per group and trust rank: its rows, and the best holder of each field in that rank.

    Holders are structs that order by the policy: size (1 where sizes don't compete), trust, recency
    (null first, so the oldest), smallest id.
    """

    def best(f: str) -> Column:
        sized = f == "canonical"
        holder = F.struct(
            (F.col("v_canonical") if sized else F.lit(1).cast("long")).alias("size"), (-F.col("_rank")).alias("trust"),
            F.col("_time").alias("time"), (-F.col("_id")).alias("neg_id"),
            (F.col("_id").cast("string") if sized else F.col(f"v_{f}")).alias("value"))
        return F.max(F.when(F.col(f"v_{f}").isNotNull(), holder)).alias(f)

    return base.groupBy("group_key", "_rank").agg(F.count("*").alias("_rows"), *[best(f) for f in names])


def _dominates(y: Column, x: Column) -> Column:
    """y beats x in size, recency or trust and is worse in none; a null time is the oldest."""
    newer = F.when(x["time"].isNull(), y["time"].isNotNull()).otherwise(F.coalesce(y["time"] > x["time"], F.lit(False)))
    as_new = x["time"].isNull() | F.coalesce(y["time"] >= x["time"], F.lit(False))
    no_worse = (y["size"] >= x["size"]) & as_new & (y["trust"] >= x["trust"])
    return no_worse & ((y["size"] > x["size"]) | newer | (y["trust"] > x["trust"]))


def skyline(candidates: Column) -> Column:
    """The undominated entries of a short array of holders."""
    return F.filter(candidates, lambda x: ~F.exists(candidates, lambda y: _dominates(y, x)))


def survivors(df: DataFrame, trust: DataFrame, spec: Fields, least_rows: int = 2) -> DataFrame:
    """One row per group of at least ``least_rows`` rows and field that some record holds:
    (group_key, field_name, value_text, from_id, undominated), the last being the size of the first layer.

    Defined cases: null groups are left out; null, blank and placeholder values are missing; a field that
    is missing everywhere gives no row; null times are the oldest and null or unlisted sources the least
    trusted; null or non-positive sizes do not compete; full ties go to the smallest id, repeated ids to
    the greater text; empty tables give an empty result; other columns are never read.
    """
    names = [*spec.values, *(["canonical"] if spec.size is not None else [])]
    cells = holders(ranked(df, trust, spec), names)
    groups = cells.groupBy("group_key").agg(F.sum("_rows").alias("_rows"), *[F.collect_list(f).alias(f) for f in names])
    layers = groups.where(F.col("_rows") >= least_rows).select("group_key", *[skyline(F.col(f)).alias(f) for f in names])
    fields = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.array_max(f)["value"].alias("value_text"),
                 (-F.array_max(f)["neg_id"]).alias("from_id"), F.size(f).alias("undominated"))
        for f in names
    ])
    return layers.select("group_key", F.inline(fields)).where("value_text IS NOT NULL")


def layered(cells: Column) -> Column:
    """The entries of a short array (trust, time, size, ...) by layer (first -1, then -2, ...) and in the policy's order
    within it. An entry's layer comes next after the last one that has an entry which dominates it; dominating
    entries come before it in the policy's order."""
    start = F.filter(F.transform(cells, lambda c: F.struct(F.lit(0).alias("layer"), c.alias("cell"))), lambda c: F.lit(False))

    def put(done: Column, c: Column) -> Column:
        above = F.filter(done, lambda y: _dominates(y["cell"], c))
        return F.concat(done, F.array(F.struct((F.coalesce(F.array_min(F.transform(above, lambda y: y["layer"])), F.lit(0)) - 1).alias("layer"), c.alias("cell"))))

    return F.sort_array(F.aggregate(F.sort_array(cells, asc=False), start, put), asc=False)


def surviving_records(df: DataFrame, trust: DataFrame, spec: Fields, least_rows: int = 2) -> DataFrame:
    """One record per group: (group_key, survivor_id, undominated, its fields, filled).

    The survivor is the policy's first among the records that no other dominates in completeness (how many fields it
    holds), recency and trust. Its own values stay; each null is filled from the first layer that holds the field, by
    the policy within it. ``filled`` counts them, ``undominated`` the first layer. Defined cases as of ``survivors``;
    where no record holds a field it is null, and a group without any value has a survivor of nulls.
    """
    base = ranked(df, trust, spec)
    names = list(spec.values)
    held = [F.col(f"v_{f}").isNotNull().cast("long") for f in names]
    newest = F.max(F.struct(F.col("_time").alias("time"), (-F.col("_id")).alias("neg_id"), *[F.col(f"v_{f}").alias(f) for f in names])).alias("newest")
    cells = base.groupBy("group_key", "_rank", *[h.alias(f"h_{f}") for h, f in zip(held, names, strict=True)]).agg(F.count("*").alias("_rows"), newest)
    size = sum((F.col(f"h_{f}") for f in names), F.lit(0).cast("long")).alias("size")
    cell = F.struct((-F.col("_rank")).alias("trust"), F.col("newest.time").alias("time"), size, F.col("newest.neg_id").alias("neg_id"), *[F.col("newest")[f].alias(f) for f in names])
    groups = cells.groupBy("group_key").agg(F.sum("_rows").alias("_rows"), F.collect_list(cell).alias("cells")).where(F.col("_rows") >= least_rows)
    groups = groups.select("group_key", layered(F.col("cells")).alias("layers"))
    first = F.col("layers")[0]["cell"]
    fill = {f: _first_held(f) for f in names}
    return groups.select(
        "group_key", (-first["neg_id"]).alias("survivor_id"), F.size(F.filter("layers", lambda c: c["layer"] == -1)).alias("undominated"),
        *[fill[f].alias(f) for f in names],
        sum((F.when(first[f].isNull() & fill[f].isNotNull(), 1).otherwise(0) for f in names), F.lit(0)).alias("filled"))


def _first_held(f: str) -> Column:
    return F.get(F.filter(F.transform("layers", lambda c: c["cell"][f]), lambda v: v.isNotNull()), F.lit(0))
