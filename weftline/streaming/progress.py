"""Progress of jobs as streams: stage counts, latest states and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import work_root


def event_stream(spark: SparkSession, d: str, name: str = "events", files_per_trigger: int = 8) -> DataFrame:
    """A table of Parquet files as a stream of its rows."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def utc_instant(df: DataFrame, name: str = "ts") -> DataFrame:
    """``df`` whose time without zone is read as UTC, whatever the session's zone."""
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return df
    return df.withColumn(name, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name}))"))


def stage_windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and value of each type and window. In append and update mode events later than ``late`` are left out and
    closed windows leave the state; in complete mode, by its definition, all windows stay and every event counts."""
    timed = utc_instant(events).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_states(events: DataFrame) -> DataFrame:
    """The last event of each user: state that grows with users, not with events."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.ts").alias("ts"), F.col("m.event_type").alias("event_type"))


def once_each(events: DataFrame) -> DataFrame:
    """Events without repeated ids, however far apart and in whatever order they come: state grows with distinct ids."""
    return utc_instant(events).dropDuplicates(["event_id"])


def kept(states: DataFrame, hours: int = 24, terminal: tuple[str, ...] = ("purchase",)) -> DataFrame:
    """States without those that ended more than ``hours`` before the newest."""
    newest = states.agg(F.max("ts").alias("_newest"))
    old = F.col("event_type").isin(*terminal) & (F.col("ts") < F.col("_newest") - F.expr(f"INTERVAL {hours} HOURS"))
    return states.join(F.broadcast(newest)).where(~old).drop("_newest")


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder. Each batch replaces it (complete), adds
    to it (append) or adds the rows that changed, of which the last of each of the ``keys`` counts (update).

    A batch that is repeated after a failure writes the same files again: results are exact.
    """
    spark = stream.sparkSession
    root = f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/table" if mode == "complete" else f"{root}/table/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    out = spark.read.parquet(f"{root}/table")
    if mode == "update":
        rest = [c for c in stream.columns if c not in (keys or [])]
        last = out.groupBy(*(keys or [])).agg(F.max(F.struct("batch", *rest)).alias("_last"))
        return last.select(*[c if c in (keys or []) else F.col("_last")[c].alias(c) for c in stream.columns])
    return out if mode == "complete" else out.drop("batch")
