"""Tables read as streams: chunks are laid down one after another, each a batch of the stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage


def laid_down(table: DataFrame, chunk: str) -> str:
    """A folder with a file for each value of a column, in the order of its values by the files' times."""
    spark = table.sparkSession
    path = storage.scratch(spark, "stream")
    kept = storage.scratch(spark, "chunks")
    table.write.partitionBy(chunk).parquet(kept)
    fs, maker = storage.filesystem(spark, kept)
    found = [f.getPath().getName() for f in fs.listStatus(maker(kept)) if "=" in f.getPath().getName()]
    for name in sorted(found, key=lambda n: int(n.split("=")[1])):
        spark.read.parquet(f"{kept}/{name}").coalesce(1).write.mode("append").parquet(path)
    storage.remove(spark, kept)
    return path


def run(spark: SparkSession, path: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append", restart_after: int | None = None) -> None:
    """Streams the files of a folder, one a batch, through transform into the folder out, until all are read.

    Each batch's rows lie in a folder of their own, which a repeated batch writes anew. restart_after: the stream is stopped
    after so many files and begun again from its checkpoint.
    """

    def keep(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    def start(files: str):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
        return transform(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    if restart_after is not None:
        fs, maker = storage.filesystem(spark, path)
        held = f"{path}-held"
        fs.mkdirs(maker(held))
        later = sorted((f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(maker(path)) if f.getPath().getName().endswith(".parquet"))[restart_after:]
        for _, name in later:
            fs.rename(maker(f"{path}/{name}"), maker(f"{held}/{name}"))
        start(path).awaitTermination()
        for _, name in later:
            fs.rename(maker(f"{held}/{name}"), maker(f"{path}/{name}"))
    start(path).awaitTermination()


def result(spark: SparkSession, out: str) -> DataFrame:
    """All batches' rows, with the number of each's batch."""
    return spark.read.option("recursiveFileLookup", "true").parquet(out)
