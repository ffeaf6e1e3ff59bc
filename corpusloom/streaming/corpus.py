"""Streaming counterparts: a corpus folder read as a stream, exported by subset, and the last rows of a key queue."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def export_by_subset(stream: DataFrame, path: str, checkpoint: str, subset: str = "source"):
    """Every micro-batch written below subset=...; a batch that runs again overwrites its own folder, so rows are not doubled."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("subset", F.replace(F.col(subset), F.lit(" "), F.lit("_")))
        rows.write.mode("overwrite").partitionBy("subset").json(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_keys(rows: DataFrame, order: str, size: int) -> DataFrame:
    """The rows that a first-in-first-out queue of `size` holds at the end, at their place in the ring."""
    newest = rows.orderBy(F.col(order).desc()).limit(size)
    total = rows.agg(F.count("*").alias("_n"))
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(order).desc()))  # over at most `size` rows
    return newest.join(F.broadcast(total)).withColumn("slot", (F.col("_n") - r) % size).drop("_n")
