"""A stored event table as a stream in time order."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = "slice"


def time_slices(events: DataFrame, folder: str, seconds: int = 3600) -> None:
    """The table as one file per slice of time, in the order the file source reads them: by modification time.

    Written in one pass; only file names pass through the driver. Choose ``seconds`` so that a slice suits one task.
    """
    spark = events.sparkSession
    events.withColumn(SLICE, F.expr(f"unix_micros(timestamp) div {seconds * 1_000_000}")).repartition(SLICE).write.mode(
        "overwrite").partitionBy(SLICE).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((int(s.getPath().getName().split("=")[1]), s.getPath()) for s in fs.globStatus(path(f"{folder}/{SLICE}=*")))
    start = int(time.time()) - len(found)
    for i, (_, slice_) in enumerate(found):
        for file in fs.listStatus(slice_):
            fs.setTimes(file.getPath(), (start + i) * 1000, -1)


def sliced_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The slices as a stream, ``files`` of them per micro-batch."""
    names = [f.name for f in schema.fields]
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).select(*[F.col(f"`{n}`") for n in names])
