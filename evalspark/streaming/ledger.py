"""Checkpoints and bars over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.scores import stability_bar
from evalspark.sources.ledger import passing_checkpoints
from evalspark.sources.shared import shared_folder


def run_through(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that its sources have now and reads its result.

    The result stays in files of the shared folder: each batch of a complete
    stream writes it anew beside the one before, and the last one counts; one in
    append mode adds to it.
    """
    spark = stream.sparkSession
    top = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{top}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{top}/rows")
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/batch{number}")
        done.append(number)

    writer.foreachBatch(put).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{top}/batch{max(done)}")


def stream_checkpoints(ledger: DataFrame) -> DataFrame:
    """The batch aggregate over a stream of records; write it in complete or update mode."""
    return passing_checkpoints(ledger)


def once(ledger: DataFrame, id_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Each record id once, for records that come again within the delay."""
    return ledger.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def windowed_bars(outcomes: DataFrame, time_col: str, keys: list[str], success, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Stability bars of tumbling windows; late outcomes count up to the delay."""
    rows = outcomes.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).withColumn("window", F.window(time_col, width))
    return stability_bar(rows, ["window", *keys], success)
