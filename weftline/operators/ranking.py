"""Numbers and choices within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import materialize


def numbered(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's 1-based place within its group.

    A window would bring a whole group into one task. Here the rows are split by ranges of (group, order), a
    group over as many tasks as its rows need; each task numbers its own, and the counts of the pieces (one row
    per group and task) give where each begins. The order must tell all rows apart for a fixed result.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "numbered")
    pieces = placed.groupBy("_task", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a group's pieces are few: at most one per task
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = placed.join(offsets, (placed["_task"] == offsets["_task"]) & placed[group].eqNullSafe(offsets["_group"]))
    return out.select(*[placed[c] for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def cumulated(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """``df`` (one row per group and value) with ``upto``: the sum of weights of the group's values up to its own,
    and ``total``. Groups are split over tasks as in ``numbered``; a window sees one task's piece of a group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, group, value).withColumn("_task", F.spark_partition_id())
    placed = materialize(ranged, "cumulated")
    pieces = placed.groupBy("_task", group).agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_task", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("total"))
    own = Window.partitionBy("_task", group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_own", F.sum(weight).over(own)).join(offsets, ["_task", group]).select(*df.columns, (F.col("_before") + F.col("_own")).alias("upto"), "total")


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the exact median of each group of any size, from counts of its distinct values."""
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cum = cumulated(counts, group, "_v", "_c")
    low, high = F.floor((F.col("total") + 1) / 2), F.ceil((F.col("total") + 1) / 2)
    return cum.groupBy(group).agg(((F.min(F.when(F.col("upto") >= low, F.col("_v"))) + F.min(F.when(F.col("upto") >= high, F.col("_v")))) / 2).alias("median"))


def first_of(df: DataFrame, group: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group by ``order``, as an aggregate with map-side combining."""
    key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("row"))
    return df.groupBy(*group).agg(F.min(key)["row"].alias("_row")).select(*group, *[F.col("_row")[k].alias(k) for k in keep if k not in group])


def fill_slots(candidates: DataFrame, slots: list[int], group: str, item: str, order: list[str]) -> DataFrame:
    """(group, item, slot): slots in rising order each take their best item that none before has taken.

    ``candidates`` has a row per item and slot that it may take, and orders by ``order``. One pass per slot, of
    which there are few; each is an aggregate per group.
    """
    taken = None
    for s in slots:
        left = candidates.where(F.col("slot") == s)
        if taken is not None:
            left = left.join(taken.select(group, item), [group, item], "left_anti")
        best = left.groupBy(group).agg(F.min(F.struct(*order, item))[item].alias(item)).select(group, item, F.lit(s).alias("slot"))
        best = materialize(best, "slot")
        taken = best if taken is None else taken.union(best)
    return taken
