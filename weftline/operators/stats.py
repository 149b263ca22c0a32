"""Aggregates over scores, colours and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def softmax(values: Column) -> Column:
    """An array of scores as shares of their exponentials, stable for great scores."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda e: e / total)


def winner(names: Column, scores: Column) -> Column:
    """(name, score) of the greatest score; the first of equal ones."""
    ranked = F.transform(F.arrays_zip(scores.alias("s"), names.alias("n")), lambda x, i: F.struct((-x["s"]).alias("neg"), i.alias("i"), x["n"].alias("name"), x["s"].alias("score")))
    best = F.array_min(ranked)
    return F.struct(best["name"].alias("name"), best["score"].alias("score"))


def convergence(score: Column, kinds: list[Column], bonus: float = 0.25) -> Column:
    """A score raised by a bonus, to 1 at most, if two or more kinds of evidence are present."""
    present = sum(F.when(k, 1).otherwise(0) for k in kinds)
    return F.when(present >= 2, F.least(F.lit(1.0), score + bonus)).otherwise(score)


def top_buckets(df: DataFrame, group: str, r: str, g: str, b: str, least: float = 0.02, k: int = 4, step: int = 32) -> DataFrame:
    """(group, bucket, n, share, rank): each group's most frequent colour buckets (8 per channel).

    A group has at most 512 buckets, counted map-side; the choice among them is a short array.
    """
    bucket = F.floor(F.col(r) / step) * 64 + F.floor(F.col(g) / step) * 8 + F.floor(F.col(b) / step)
    counts = df.groupBy(group, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    own = counts.groupBy(group).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "bucket"))).alias("all"))
    top = own.select(group, "total", F.posexplode(F.slice(F.filter("all", lambda x: -x["neg"] >= least * F.col("total")), 1, k)).alias("pos", "x"))
    return top.select(group, F.col("x.bucket").alias("bucket"), (-F.col("x.neg")).alias("n"), (-F.col("x.neg") / F.col("total")).alias("share"), (F.col("pos") + 1).alias("rank"))


def moments(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, mean and variance (E[x²] - E[x]²) of each group."""
    x = F.col(value).cast("double")
    return df.groupBy(*group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.avg(x * x) - F.avg(x) * F.avg(x)).alias("variance"))


def robust(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, spread): the exact median of each group and the exact median distance from it."""
    from weftline.operators.ranking import medians

    mid = medians(df, group, value)
    away = df.join(mid, group).select(group, F.abs(F.col(value).cast("double") - F.col("median")).alias("_away"))
    return mid.join(medians(away, group, "_away").withColumnRenamed("median", "spread"), group)


def plane(df: DataFrame, group: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least-squares plane z = a + bx + cy of each group, from sums that combine map-side."""
    s = lambda e: F.sum(e.cast("double"))
    cx, cy, cz = F.col(x), F.col(y), F.col(z)
    m = df.groupBy(*group).agg(F.count("*").alias("n"), s(cx).alias("sx"), s(cy).alias("sy"), s(cz).alias("sz"), s(cx * cx).alias("sxx"), s(cy * cy).alias("syy"), s(cx * cy).alias("sxy"), s(cx * cz).alias("sxz"), s(cy * cz).alias("syz"))
    xx, yy, xy = (F.expr(e) for e in ("sxx - sx * sx / n", "syy - sy * sy / n", "sxy - sx * sy / n"))
    xz, yz = F.expr("sxz - sx * sz / n"), F.expr("syz - sy * sz / n")
    det = xx * yy - xy * xy
    b, c = (xz * yy - yz * xy) / det, (yz * xx - xz * xy) / det
    return m.where(F.abs(det) > 1e-9).select(*group, ((F.col("sz") - b * F.col("sx") - c * F.col("sy")) / F.col("n")).alias("a"), b.alias("b"), c.alias("c"))
