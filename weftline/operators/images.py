"""Features of pictures in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import pixels as P

FEATURES = "id string, width int, height int, hash_hi long, hash_lo long, background string, variance double, near_white double, box array<int>, edges string, edge_density double, clusters int, dark double, bright double, illustration boolean, route string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, height, width, channels, data) of pictures that Spark decodes; data is blue, green, red by rows."""
    raw = spark.read.format("image").option("dropInvalid", "true").load(path)
    return raw.select(F.col("image.origin").alias("id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of bytes as red, green, blue; an alpha channel is laid on white."""
    a = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[..., 0]
    rgb = a[..., 2::-1] if channels >= 3 else np.repeat(a[..., :1], 3, axis=2)
    if channels == 4:
        alpha = a[..., 3:].astype(np.float64) / 255
        rgb = (rgb * alpha + 255 * (1 - alpha)).round().astype(np.uint8)
    return np.ascontiguousarray(rgb)


def features_of(a: np.ndarray) -> tuple:
    h, w = a.shape[:2]
    hi, lo = P.difference_hash(a)
    bg, box = P.background(a), P.subject_box(a)
    edges = P.touched_edges(box, h, w)
    whole = box == (0, 0, w, h)
    dark, bright = P.exposure(a)
    route = "problem" if whole else "detail" if edges else "centre"
    return w, h, hi, lo, bg["kind"], bg["variance"], bg["near_white"], list(box), edges, P.edge_density(a), P.colour_clusters(a), dark, bright, P.illustration(a), route


def image_features(images: DataFrame) -> DataFrame:
    """One row of features per picture; pictures whose bytes don't fit their size have null features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for pdf in batches:
            rows = []
            for i, h, w, c, data in zip(pdf["id"], pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True):
                ok = data is not None and h and w and c and len(data) == int(h) * int(w) * int(c)
                rows.append((i, *(features_of(as_array(data, int(h), int(w), int(c))) if ok else (None,) * 15)))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"width": "Int32", "height": "Int32", "hash_hi": "Int64", "hash_lo": "Int64", "clusters": "Int32"})

    return images.select(F.col("id").cast("string").alias("id"), "height", "width", "channels", "data").mapInPandas(run, FEATURES)


PROBE = "id string, kind string, width int, height int, orientation int, conforming boolean, reason string"


def probe(files: DataFrame, least_bytes: int = 2048, most_bytes: int = 262_144_000, least_side: int = 570) -> DataFrame:
    """What a file (id, length, content) is by its header, and the first reason that keeps it out.

    A JPEG that needs no turning is conforming: it can be copied as it is. Pixels are not decoded; sizes of
    other kinds than JPEG and PNG stay null and don't keep a file out.
    """
    from weftline.sources.archives import kind_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, length, content in zip(pdf["id"], pdf["length"], pdf["content"], strict=True):
                data = bytes(content or b"")
                kind = kind_of(i or "", data[:16])
                jpeg, png = P.jpeg_header(data), P.png_size(data)
                w, h, o = jpeg or (*(png or (None, None)), None)
                size = len(data) if length is None or length != length else int(length)
                reason = ("missing" if content is None else "unsupported" if kind != "image" else "few bytes" if size < least_bytes else "many bytes" if size > most_bytes
                          else "corrupt" if data[:2] == b"\xff\xd8" and not jpeg else "small picture" if w is not None and max(w, h) < least_side else None)
                rows.append((i, kind, w, h, o, bool(jpeg) and o == 1, reason))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PROBE.split(", ")])
            yield out.astype({c: "Int32" for c in ("width", "height", "orientation")})

    return files.select(F.col("id").cast("string").alias("id"), F.col("length").cast("long").alias("length"), "content").mapInPandas(run, PROBE)
