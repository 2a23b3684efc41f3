"""Windowed counts over a stream of files: tumbling, sliding and session windows, with a watermark for late rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def timed(events: DataFrame, late: str, tz_free: str = "ts") -> DataFrame:
    return events.withColumn("__at", F.col(tz_free).cast("timestamp")).withWatermark("__at", late)


def windowed(events: DataFrame, length: str = "1 day", late: str = "3650 days", slide: str | None = None) -> DataFrame:
    """Streamed or static events -> start, event_type, n, total for each window and type; with slide windows overlap.

    A stream in append or update mode drops rows later than `late` and forgets
    windows older than that; in complete mode it keeps all windows and rows.
    """
    window = F.window("__at", length, slide) if slide else F.window("__at", length)
    sums = timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "3650 days") -> DataFrame:
    """user_id, start, end, n, total: a user's events that follow each other within the gap; end is the last one's time and the gap. Late rows as in windowed."""
    sums = timed(events, late).groupBy(F.session_window("__at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; unset, a temporary one on this machine, but on a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return known or tempfile.mkdtemp(prefix="spark-docloom-")


def streamed(spark: SparkSession, path: str, schema: StructType, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """shape of everything that lies in path now, as one available-now stream; its rows, written as Parquet in the shared folder."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)

    def kept(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows")

    shape(stream).writeStream.outputMode("complete").foreachBatch(kept).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def appended(spark: SparkSession, path: str, schema: StructType, shape: Callable[[DataFrame], DataFrame], out: str) -> int:
    """Adds to out/rows what shape makes of files in path that came since the last call, in append mode; how many rows were too late is returned.

    shape's watermark says when a window is over: only then its row is written, once,
    and its state is forgotten. out/state keeps the stream's place, so a call that
    broke is taken up where it was.
    """
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)
    query = shape(stream).writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "1 day", at: str = "ts") -> DataFrame:
    """Rows of two streams (or tables) of the same key where the one in `then` comes no later than `within` after the one in first: key, at, then_at, and the others' columns with then_ before their names.

    Both sides' states forget rows that no row in time can meet any more.
    """
    one = first.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    two = then.select(*[F.col(c).alias(f"then_{c}") for c in then.columns]).withColumn(f"then_{at}", F.col(f"then_{at}").cast("timestamp")).withWatermark(f"then_{at}", late)
    in_time = (F.col(f"then_{at}") >= F.col(at)) & (F.col(f"then_{at}") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return one.join(two, (F.col(key) == F.col(f"then_{key}")) & in_time).drop(f"then_{key}")


def daily(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Counts of a day and type."""
    rows = streamed(spark, path, schema, windowed)
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))
