"""Structured Streaming jobs; each runs the available input to its end and returns the result table.

A job is given ``out`` and ``checkpoint``: started again with the same two it goes on where it stopped, and the files that have
come since are the only ones it reads. Jobs that update keys keep a ``KeyedTable`` under ``out``; jobs whose rows are final append
parquet files there. Without the two (a one-off run) both are new folders under the shared directory.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.rfm import score_rfm
from ..session import shared_dir
from ..sources import folders
from .state import KeyedTable


def stream_table(spark, folder, name, files_per_batch=None) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream; its schema is read once from the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return stream_files(spark, f"{folder}/{name}.[p]arquet", schema, files_per_batch)  # a pattern, because a plain path must be a folder


def stream_files(spark, pattern, schema, files_per_batch=None) -> DataFrame:
    """Parquet files under a folder or pattern as a stream, oldest first; ``files_per_batch`` bounds a micro-batch."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(pattern)


def _places(spark, out, checkpoint):
    if (out is None) != (checkpoint is None):
        raise ValueError("give both out and checkpoint, or neither")
    return out or shared_dir(spark, "stream"), checkpoint or shared_dir(spark, "checkpoint")


def run_append(df: DataFrame, out=None, checkpoint=None) -> DataFrame:
    """Append the stream's final rows to a parquet folder until the input is used up; all rows of all runs so far."""
    spark = df.sparkSession
    out, checkpoint = _places(spark, out, checkpoint)
    q = df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    q.awaitTermination()
    if not folders.children(spark, out):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(out)


def run_upsert(df: DataFrame, keys, merge="last", out=None, checkpoint=None, compact_every=10) -> DataFrame:
    """Keep a table of the stream's rows by ``keys`` until the input is used up; the table after all runs so far.

    ``merge`` is one way for all other columns, or one for each. With ``last`` the stream holds whole values per key and sends those
    that changed; with ``sum``, ``min`` and ``max`` it sends rows, which are summed up per batch and merged into the table."""
    spark = df.sparkSession
    out, checkpoint = _places(spark, out, checkpoint)
    merge = merge if isinstance(merge, dict) else {c: merge for c in df.columns if c not in keys}
    table = KeyedTable(spark, out, df.schema, keys, merge, compact_every)
    mode = "update" if "last" in merge.values() else "append"
    q = df.writeStream.outputMode(mode).foreachBatch(table.commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read()


def incremental_rfm(orders: DataFrame, as_of: DataFrame, out=None, checkpoint=None) -> DataFrame:
    """Last purchase, count and spend kept per user from a stream of paid orders; scored when read.

    Expects user_id, created_at, total_cents, status. The table is all the state there is: a batch adds its sums to it."""
    paid = orders.where(F.col("status").isin(*S.REVENUE_STATUSES))
    rows = paid.select("user_id", F.col("created_at").alias("last"), F.lit(1).cast("long").alias("frequency"), F.col("total_cents").alias("monetary"))
    table = run_upsert(rows, ["user_id"], {"last": "max", "frequency": "sum", "monetary": "sum"}, out, checkpoint)
    return score_rfm(table.select("user_id", F.datediff(as_of.scalar(), "last").alias("recency"), "frequency", "monetary"))


def live_sales(orders: DataFrame, delay="1 day", out=None, checkpoint=None) -> DataFrame:
    """Amount and count per day of revenue orders; days older than the watermark are closed, and rows for them are dropped."""
    paid = orders.where(F.col("status").isin(*S.REVENUE_STATUSES)).withWatermark("ts", delay)
    g = paid.groupBy(F.window("ts", "1 day")).agg(F.sum("total_cents").alias("amount"), F.count("*").alias("count"))
    return run_upsert(g.select(F.to_date("window.start").alias("date"), "amount", "count"), ["date"], "last", out, checkpoint)


def live_funnel(events: DataFrame, size="1 day", slide="6 hours", delay="1 hour", out=None, checkpoint=None) -> DataFrame:
    """Counts by action over sliding windows; windows older than the watermark are closed."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide), "action").agg(F.count("*").alias("n"))
    return run_upsert(g.select(F.col("window.start").alias("start"), "action", "n"), ["start", "action"], "last", out, checkpoint)


def shopping_sessions(events: DataFrame, gap="30 minutes", delay="1 hour", out=None, checkpoint=None) -> DataFrame:
    """Closed sessions per user: start, end, events and value. Open ones wait in the checkpoint for the next run."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(
        F.count("*").alias("n"), F.sum("value").alias("value"))
    closed = g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")
    return run_append(closed, out, checkpoint)


def unique_events(events: DataFrame, key="event_id", delay="1 hour", out=None, checkpoint=None) -> DataFrame:
    """The first of every event id, also across runs; ids older than the watermark are forgotten."""
    return run_append(events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]), out, checkpoint)


def enriched_events(events: DataFrame, segments: DataFrame, out=None, checkpoint=None) -> DataFrame:
    """Events with the user's segment; users without one stay.

    The segments are written once beside ``out`` by the first run and read by every batch of this and later runs, so that a
    row's segment does not depend on how often the job was started."""
    spark = events.sparkSession
    out, checkpoint = _places(spark, out, checkpoint)
    side = f"{out}-segments"
    if not folders.finished(spark, side):
        segments.select("user_id", "segment").write.mode("overwrite").parquet(side)
    known = spark.read.parquet(side)
    return run_append(events.join(known, "user_id", "left"), out, checkpoint)
