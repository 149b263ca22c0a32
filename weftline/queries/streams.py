"""Streams over the event table, run over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import table
from weftline.sources import archives
from weftline.streaming import progress as P


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts of each event type."""
    out = P.run_to_table(P.stage_windows(P.event_stream(spark, d)), "stream-windows")
    return out.select(F.date_from_unix_date(F.floor(F.unix_seconds("start") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    return P.run_to_table(P.latest_states(P.event_stream(spark, d)), "stream-latest", "update", ["user_id"])


def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type, each id once."""
    out = P.run_to_table(P.once_each(P.event_stream(spark, d)).select("event_id", "event_type"), "stream-distinct", "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_kept(spark: SparkSession, d: str) -> DataFrame:
    """Users' last states without those that ended a day before the newest."""
    return P.kept(stream_latest(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"))


def address_routes(spark: SparkSession, d: str) -> DataFrame:
    """The connector that would fetch each source file from addresses of several kinds."""
    f = table(spark, d, "worksheet_rows").select("source_file").distinct()
    hosts = F.array(*[F.lit(h) for h in ("https://www.dropbox.com/s/", "https://we.tl/t-", "https://files.example.com/", "http://files.example.com/", "https://localhost/")])
    u = f.select(F.explode(hosts).alias("h"), "source_file").select("source_file", F.concat("h", F.replace("source_file", F.lit(" "), F.lit("%20")), F.lit("?dl=0")).alias("url"))
    return u.select("source_file", archives.url_route(F.col("url")).alias("route"), archives.direct_download(F.col("url")).alias("fetch"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_latest, stream_distinct, stream_kept, address_routes)}
_LATEST = "SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1"
ORACLE = {
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_latest": _LATEST,
    "stream_distinct": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_kept": f"WITH s AS ({_LATEST}) SELECT event_type, count(*) AS n FROM s WHERE NOT (event_type = 'purchase' AND ts < (SELECT max(ts) FROM s) - INTERVAL 24 HOURS) GROUP BY 1",
    "address_routes": "WITH u AS (SELECT source_file, h || replace(source_file, ' ', '%20') || '?dl=0' AS url FROM (SELECT DISTINCT source_file FROM worksheet_rows), (VALUES ('https://www.dropbox.com/s/'), ('https://we.tl/t-'), ('https://files.example.com/'), ('http://files.example.com/'), ('https://localhost/')) v(h)) SELECT source_file, CASE WHEN url LIKE 'http://%' OR url LIKE '%//localhost/%' THEN NULL WHEN url LIKE '%dropbox.com%' THEN 'dropbox' WHEN url LIKE '%we.tl%' THEN 'wetransfer' ELSE 'https' END AS route, replace(url, '?dl=0', '?dl=1') AS fetch FROM u",
}
