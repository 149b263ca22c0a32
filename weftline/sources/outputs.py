"""Sinks: manifests, documents and archives, and the configuration reader."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def write_manifest(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows as JSON lines and the summary beside them; nothing passes through the driver."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """JSON documents in folders by ``key``, overwritten; null fields are left out."""
    df.write.mode("overwrite").partitionBy(key).option("ignoreNullFields", "true").json(path)


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) as JSON text, one object per row."""
    return df.select(F.to_json(F.create_map(F.col(key), F.col(value))).alias("json"))


def zip_parts(files: DataFrame, per_part: int = 2000) -> DataFrame:
    """(part, content): zipped parts of files (name, content), at most ``per_part`` files each.

    Archives are made by the tasks that hold the files and are rows like any others; write them by a binary sink.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), per_part):
                part, buffer = pdf.iloc[i : i + per_part], io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, content in zip(part["name"], part["content"], strict=True):
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), bytes(content or b""))
                yield pd.DataFrame({"first": [part["name"].iloc[0]], "files": [len(part)], "content": [buffer.getvalue()]})

    return files.select("name", "content").mapInPandas(pack, "first string, files long, content binary")


_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)


@lru_cache(maxsize=64)
def _parsed(path: str, _mtime: float) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", _COMMENT.sub(lambda m: m[1] or "", f.read())))


def section(path: str, *names: str, required: tuple[str, ...] = ()) -> dict:
    """A section of a JSON file with comments, keys without case; read again when the file changes.

    Missing sections and required keys are errors.
    """
    node = _parsed(path, os.path.getmtime(path))
    for name in names:
        low = {k.lower(): v for k, v in node.items()}
        if name.lower() not in low:
            raise KeyError(f"{path} has no section {name}")
        node = low[name.lower()]
    out = {k.lower(): v for k, v in node.items()} if isinstance(node, dict) else {"": node}
    if missing := [k for k in required if k.lower() not in out]:
        raise KeyError(f"{path} lacks {', '.join(missing)}")
    return out
