"""What a plan must not hold."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def operators(df: DataFrame) -> dict[str, int]:
    """Names of the physical operators and how often they stand in the plan."""
    out: dict[str, int] = {}
    for name in re.findall(r"^\(\d+\) (\w[\w ]*?)(?: \[codegen.*)?$", plan_of(df), re.M):
        out[name.strip()] = out.get(name.strip(), 0) + 1
    return out


def cross_joins(df: DataFrame) -> list[str]:
    """Joins without an equality: products of both sides."""
    return [o for o in operators(df) if o in ("CartesianProduct", "BroadcastNestedLoopJoin")]


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans of the plan read."""
    return sorted({c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*)>", plan_of(df)) for c in re.split(r",(?![^<]*>)", s) if c})


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.+)\]", plan_of(df))
