"""Incremental runs: deduplicated appends, progress and totals as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from decisium.functions.hashing import sha_order


def read_new_files(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def without_repeats(stream: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The row of each key that arrives first; with ``time`` the keys are forgotten after ``late``."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def progress(stream: DataFrame, family: str = "family") -> DataFrame:
    return stream.groupBy(family).agg(F.count("*").alias("n"))


def append_once(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its number: a batch that is run again overwrites itself, so nothing is written twice."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_sample(stream: DataFrame, n: int, seed: int, row_id: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a uniform sample of ``n`` rows of everything seen: the first in hash order, under the number of the micro-batch.

    The state is those ``n`` rows. Batch k reads what batch k - 1 wrote, and a batch that is run again overwrites itself.
    """

    def keep(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if batch:
            df = df.unionByName(spark.read.schema(df.schema).parquet(f"{folder}/batch={batch - 1}"))
        df.orderBy(sha_order(seed, row_id), row_id).limit(n).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_sample(spark: SparkSession, folder: str) -> DataFrame:
    """What ``running_sample`` holds now."""
    every = spark.read.parquet(folder)
    return every.join(F.broadcast(every.agg(F.max("batch").alias("last"))), F.col("batch") == F.col("last")).drop("batch", "last")


def watched(stream: DataFrame, name: str, checkpoint: str, seconds: int = 20, family: str = "family") -> StreamingQuery:
    """Rows per family so far as an in-memory table, counted anew every ``seconds``; runs until it is stopped."""
    writer = progress(stream, family).writeStream.format("memory").queryName(name).outputMode("complete")
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and keep the result as an in-memory table."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling totals (an addition to the batch operators)."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
