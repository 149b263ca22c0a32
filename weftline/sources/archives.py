"""Archives, media triage and remote inputs."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

IMAGE_EXTENSIONS = {".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".pdf"}
#: Leading bytes of media (public format signatures).
SIGNATURES = [(b"\xff\xd8\xff", "image"), (b"\x89PNG\r\n\x1a\n", "image"), (b"GIF87a", "image"), (b"GIF89a", "image"), (b"BM", "image"), (b"II*\0", "image"), (b"MM\0*", "image"), (b"%PDF-", "image")]
MEMBERS = "archive string, member string, kind string, bytes long, content binary, reason string"


@dataclass(frozen=True)
class Limits:
    """What an archive may hold: depth of nesting and expanded bytes per kind."""

    depth: int = 5
    image: int = 262_144_000
    table: int = 104_857_600
    archive: int = 2_147_483_648


def media_kind(path: Column, content: Column) -> Column:
    """image, table, archive or other, by the leading bytes; archives are told apart by their extension."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.lit(False), "")
    for magic, kind in SIGNATURES:
        out = out.when(head.startswith(magic.hex().upper()), kind)
    out = out.when(head.startswith(b"RIFF".hex().upper()) & (F.substring(head, 17, 8) == b"WEBP".hex().upper()), "image")
    zipped = head.startswith("504B0304") | head.startswith("504B0506")
    return out.when(zipped & F.lower(path).endswith(".xlsx"), "table").when(zipped & F.lower(path).endswith(".zip"), "archive").otherwise("other")


def kind_of(name: str, head: bytes) -> str:
    """The same for a member that is already in memory."""
    for magic, kind in SIGNATURES:
        if head.startswith(magic):
            return kind
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return {".xlsx": "table", ".zip": "archive"}.get(posixpath.splitext(name.lower())[1], "other")
    return "other"


def unsafe(name: str) -> bool:
    """Absolute paths, drive letters and paths that leave the folder."""
    parts = name.replace("\\", "/").split("/")
    return name.startswith(("/", "\\")) or ".." in parts or (len(parts[0]) > 1 and parts[0][1] == ":")


def members(archive: str, content: bytes, limits: Limits, depth: int = 1) -> Iterator[tuple]:
    """A row per member in ordinal order, nested archives opened; what can't be taken has its reason and no content."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        yield archive, None, "archive", len(content), None, "corrupt archive"
        return
    with z:
        for info in sorted((i for i in z.infolist() if not i.is_dir()), key=lambda i: i.filename):
            name, row = info.filename, (archive, info.filename)
            if unsafe(name):
                yield *row, None, info.file_size, None, "unsafe path"
                continue
            if info.flag_bits & 1:
                yield *row, None, info.file_size, None, "encrypted"
                continue
            try:
                with z.open(info) as f:
                    head = f.read(16)
                    kind = kind_of(name, head)
                    most = getattr(limits, kind, 0)
                    if kind == "other":
                        yield *row, kind, info.file_size, None, "ignored"
                        continue
                    data = head + f.read(max(0, most - len(head)) + 1)
            except Exception as e:
                yield *row, None, info.file_size, None, f"unreadable: {type(e).__name__}"
                continue
            if len(data) > most:
                yield *row, kind, len(data), None, "too large"
            elif kind != "archive":
                yield *row, kind, len(data), data, None
            elif depth >= limits.depth:
                yield *row, kind, len(data), None, "nested too deep"
            else:
                for _, m, *rest in members(archive, data, limits, depth + 1):
                    yield archive, f"{name}/{m}" if m else name, *rest


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """All members of the archives below ``path``; a task opens one archive at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".zip"))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(members(name, content, limits)), columns=["archive", "member", "kind", "bytes", "content", "reason"])

    return files.select("path", "content").mapInPandas(expand, MEMBERS)


def enough(found: DataFrame, images: int = 1, tables: int = 1) -> DataFrame:
    """(archive, images, tables, ok): members that were taken, against the least numbers."""
    n = found.groupBy("archive").agg(F.count_if((F.col("kind") == "image") & F.col("reason").isNull()).alias("images"), F.count_if((F.col("kind") == "table") & F.col("reason").isNull()).alias("tables"))
    return n.withColumn("ok", (F.col("images") >= images) & (F.col("tables") >= tables))


def url_route(url: Column) -> Column:
    """The connector of a web address: by host, the plain one last; null for what none may fetch."""
    host = F.lower(F.regexp_extract(url, "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    local = host.rlike("^(localhost|127[.].*|0[.]0[.]0[.]0|10[.].*|192[.]168[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*|169[.]254[.].*)$") | (host == "")
    https = F.lower(url).startswith("https://")
    return (F.when(~https | local, F.lit(None).cast("string")).when(host.rlike("(^|[.])dropbox[.]com$"), "dropbox")
            .when(host.rlike("(^|[.])(wetransfer[.]com|we[.]tl)$"), "wetransfer").otherwise("https"))


def direct_download(url: Column) -> Column:
    """A shared-file address that answers with the file itself."""
    return F.when(url.rlike("[?&]dl="), F.regexp_replace(url, "([?&])dl=[^&#]*", "$1dl=1")).when(url.contains("?"), F.concat(url, F.lit("&dl=1"))).otherwise(F.concat(url, F.lit("?dl=1")))


def routed(inputs: DataFrame, name: str = "name") -> dict[str, DataFrame]:
    """Inputs by what their extension says they are; others are left out."""
    ext = F.lower(F.regexp_extract(F.col(name), "([.][^.]*)$", 1))
    return {"images": inputs.where(ext.isin(sorted(IMAGE_EXTENSIONS))), "tables": inputs.where(ext.isin(".xlsx", ".csv", ".tsv", ".txt")), "archives": inputs.where(ext == ".zip")}
