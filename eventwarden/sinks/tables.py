"""Stored tables as partitioned Parquet: appends, keyed upserts and insert-if-absent.

Upserts touch only the partitions their rows fall in (dynamic partition overwrite) and are idempotent, so a
micro-batch that runs twice leaves the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from eventwarden.session import stage


# Files a batch writes per day and event type at most, and the events from which on it writes another one.
FILES_PER_PARTITION = 8
FILE_EVENTS = 20_000


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or no rows while it does not exist yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def event_day(column: Column) -> Column:
    return F.date_format(F.timestamp_micros(column), "yyyy-MM-dd")


def append_events(events: DataFrame, path: str, batch_id: int = 0, observed: Observation | None = None) -> DataFrame:
    """Append canonical events by day and type; returns the batch's own events. ``observed`` counts them as ``rows``.

    Ids that another batch stored are repeats and dropped. Ids this batch stored before it failed are not
    written again but stay in the result, so a batch that runs twice is processed as a whole. Only ids meet stored
    events; ``events`` are read several times, so they should be stored themselves.
    """
    spark = events.sparkSession
    dated = events.withColumn("event_date", F.date_format("timestamp", "yyyy-MM-dd")).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    missing = dated
    held = dated.groupBy("event_date", "event_type").count().collect()  # the days and types of one batch
    if exists(spark, path):
        days = sorted({r.event_date for r in held if r.event_date is not None})
        stored = spark.read.schema(dated.schema).parquet(path).filter(F.col("event_date").isin(days)).select("event_id", "batch_id")
        repeats = stage(stored.join(dated.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(
            F.bool_or(F.col("batch_id") == batch_id).alias("own")), "repeats")
        if not repeats.isEmpty():
            without = lambda rows: dated.join(rows.select("event_id"), "event_id", "left_anti").select(*dated.columns)
            dated, missing = stage(without(repeats.filter(~F.col("own"))), "batch-events"), without(repeats)
    # rows of a day and type meet in a few tasks, so files stay few; the salt keeps a heavy type from one task
    files = min(FILES_PER_PARTITION, 1 + max((r["count"] for r in held), default=0) // FILE_EVENTS)
    salt = F.pmod(F.xxhash64("event_id"), F.lit(files))
    missing.repartition("event_date", "event_type", salt).write.mode("append").partitionBy("event_date", "event_type").parquet(path)
    own = dated.drop("event_date", "batch_id")
    return own if observed is None else own.observe(observed, F.count(F.lit(1)).alias("rows"))


def upsert(fresh: DataFrame, path: str, keys: list[str], partition: str, merge: dict[str, Column]) -> DataFrame:
    """Insert new keys and merge known ones. Returns the touched rows as they are stored now.

    ``merge`` gives, for the columns a repeat may change, an expression over the stored column ``x`` and the
    fresh one ``_x``; all other columns keep their stored value. ``partition`` is a column both sides share
    for a key, so only the fresh rows' partitions are read and rewritten.
    """
    spark = fresh.sparkSession
    fresh = stage(fresh, "upsert")
    parts = [r[0] for r in fresh.select(partition).distinct().collect()]  # partitions of one batch
    stored = read_or_empty(spark, path, fresh.schema).filter(F.col(partition).isin(parts)).select(*fresh.columns)
    renamed = fresh.select(*keys, *[F.col(c).alias(f"_{c}") for c in fresh.columns if c not in keys], F.lit(True).alias("_in"))
    both = stored.withColumn("_had", F.lit(True)).join(renamed, keys, "full_outer")
    columns = []
    for name in fresh.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name in merge:
            columns.append(F.when(F.col("_had") & F.col("_in"), merge[name]).otherwise(F.coalesce(F.col(name), F.col(f"_{name}"))).alias(name))
        else:
            columns.append(F.when(F.coalesce("_had", F.lit(False)), F.col(name)).otherwise(F.col(f"_{name}")).alias(name))
    result = stage(both.select(*columns, F.coalesce("_in", F.lit(False)).alias("_in")), "merged")
    result.drop("_in").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return result.filter("_in").drop("_in")


def insert_absent(fresh: DataFrame, path: str, keys: list[str], partition: str) -> DataFrame:
    """Append the rows whose key the touched partitions do not hold yet; returns them."""
    spark = fresh.sparkSession
    unique = stage(fresh.dropDuplicates(keys), "insert")
    parts = [r[0] for r in unique.select(partition).distinct().collect()]  # partitions of one batch
    stored = read_or_empty(spark, path, unique.schema).filter(F.col(partition).isin(parts)).select(*keys)
    new = stage(unique.join(stored, keys, "left_anti").select(*unique.columns), "inserted")
    new.write.mode("append").partitionBy(partition).parquet(path)
    return new


def alert_merge() -> dict[str, Column]:
    """What a repeated detection changes on its open alert."""
    later = F.col("_last_us") > F.col("last_us")
    return {
        "last_us": F.greatest("last_us", "_last_us"),
        "detected_us": F.when(later, F.greatest("detected_us", "_detected_us")).otherwise(F.col("detected_us")),
        "confidence": F.greatest("confidence", "_confidence"),
    }


def upsert_alerts(alerts: DataFrame, path: str) -> DataFrame:
    """Alerts by dedup key. A key carries its time bucket, so both sides share the bucket's day.

    A closed alert is never reopened: a repeat of its key opens a new alert under a fresh id.
    """
    spark = alerts.sparkSession
    # a rule without a dedup window has one bucket for all time, as in its key
    bucket = F.expr("""CASE WHEN dedup_seconds > 0
        THEN (last_us div nullif(dedup_seconds * 1000000, 0)) * dedup_seconds * 1000000 ELSE CAST(0 AS BIGINT) END""")
    dated = alerts.withColumn("alert_date", event_day(bucket))
    if exists(spark, path):
        days = [r.alert_date for r in dated.select("alert_date").distinct().collect()]  # the days of one batch
        closed = spark.read.schema(dated.schema).parquet(path).filter(
            F.col("alert_date").isin(days) & ~F.col("status").isin("new", "investigating", "escalated"))
        generation = closed.groupBy("dedup_key").agg(F.count("*").alias("closed"))
        dated = dated.join(generation, "dedup_key", "left").withColumn(
            "alert_id", F.when(F.col("closed") > 0, F.concat("alert_id", F.lit("R"), F.col("closed").cast("string"))).otherwise(F.col("alert_id")))
        dated = dated.drop("closed").select(*alerts.columns, "alert_date")
    return upsert(dated, path, ["alert_id"], "alert_date", alert_merge())


def upsert_indicators(fresh: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged indicator table and ``(created, updated)`` counts; a known value keeps its id."""
    key = lambda df: df.withColumn("_key", F.lower(F.trim("indicator")))
    a = key(stored).withColumn("_had", F.lit(True))
    b = key(fresh).dropDuplicates(["_key", "ioc_type"])
    columns = [c for c in stored.columns if c not in ("ioc_type",)]
    b = b.select("_key", "ioc_type", F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = a.join(b, ["_key", "ioc_type"], "full_outer")
    keep = ("ioc_id", "indicator")
    merged = both.select("ioc_type", *[
        F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in keep else F.when(F.coalesce("_in", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        for c in columns
    ]).select(*stored.columns)
    counts = both.filter("_in").agg(F.count_if(F.col("_had").isNull()).alias("created"), F.count_if(F.col("_had")).alias("updated"))
    return merged, counts


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A result table, replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
