"""Activity over a stream of commits or events: an extension beside the batch timeline."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(key, hour_start, n)`` of each window; rows later than ``late`` are dropped, and state with them."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("hour_start"), "n")


def follow(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Call ``refresh`` for each batch of new rows: re-analysis on change, exactly once a batch with a checkpoint."""
    return stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_once(spark: SparkSession, location: str, ts: str, key: str) -> DataFrame:
    """Read a table as a stream to its end, count its activity and give the result as a table."""
    schema = spark.read.parquet(location).schema
    folder, name = location.rsplit("/", 1)
    stream = spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")  # a pattern, as a table may be one file
    name = f"activity_{uuid.uuid4().hex}"
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-stream-")
    job = windowed(stream, ts, key).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name)
