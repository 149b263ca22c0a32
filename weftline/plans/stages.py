"""Stages of a job that can be put in and taken out: pictures by registered functions, tables by functions of tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.functions import pixels as P
from weftline.operators.images import as_array

#: What can be done with a picture (rows, columns, channels), by name.
TRANSFORMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"square": P.centred_square, "centre": P.centred_on_canvas}


def register(name: str, transform: Callable[[np.ndarray], np.ndarray]) -> None:
    """Put a transform under a name, in place of one that has it."""
    TRANSFORMS[name] = transform


SCHEMA = "id string, height int, width int, channels int, data binary, error string"


def transformed(images: DataFrame, name: str) -> DataFrame:
    """(id, height, width, channels, data, error): each picture (id, height, width, channels, data) by the transform of
    that name; one that it fails on keeps its id and gives the error. The function goes to the tasks with the query."""
    transform = TRANSFORMS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h, w, c, data in zip(pdf["id"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                try:
                    out = np.ascontiguousarray(transform(as_array(data, int(h), int(w), int(c))))
                    rows.append((i, out.shape[0], out.shape[1], out.shape[2] if out.ndim > 2 else 1, out.astype(np.uint8).tobytes(), None))
                except Exception as e:  # one picture's fault is its own
                    rows.append((i, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({x: "Int32" for x in ("height", "width", "channels")})

    return images.select(F.col("id").cast("string").alias("id"), "height", "width", "channels", "data").mapInPandas(run, SCHEMA)


#: A stage takes a table of records and gives one.
Stage = Callable[[DataFrame], DataFrame]


def run_stages(records: DataFrame, stages: list[tuple[str, Stage]], needs: list[str]) -> DataFrame:
    """The records through all stages in order. Each must keep the columns that are needed; else it is named."""
    def step(df: DataFrame, named: tuple[str, Stage]) -> DataFrame:
        out = named[1](df)
        if missing := [c for c in needs if c not in out.columns]:
            raise ValueError(f"stage {named[0]!r} loses {', '.join(missing)}")
        return out

    return reduce(step, stages, records)
