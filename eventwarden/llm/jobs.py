"""Session settings and the map over text columns that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from eventwarden.llm.words import Slice, slices
from eventwarden.session import EVENT_SETTINGS, prepare, stage

# Rows of an Arrow batch: bounds what a Python worker holds at once, whatever the length of the texts.
BATCH_ROWS = "512"


def prepared(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for name in EVENT_SETTINGS:  # the session's own again: these are for wide events
        spark.conf.unset(name)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and reread: a lost executor costs one read, not the lineage."""
    return stage(df, label)


def keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells rows apart without shuffling texts: the id as text (null: empty) and a hash of the text.

    Rows equal in both are repeats, and share every result.
    """
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id_key"), F.xxhash64(text).alias("text_key")]


KEY = ["id_key", "text_key"]


def without(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``documents`` whose key is not in ``dropped``; all columns as they were."""
    rows = documents.select(F.struct(F.col("*")).alias("row"), *keys())
    return rows.join(dropped.select(*KEY), KEY, "left_anti").select("row.*")


def map_texts(df: DataFrame, text: str, fields: list[T.StructField],
              make: Callable[[], Callable[[Slice, pa.Array], list[pa.Array]]]) -> DataFrame:
    """The columns of ``df`` but ``text``, and the computed ``fields``, one row per input row.

    ``make`` runs once per task and returns the function that computes the new columns of one slice of rows from
    their bytes and their text column (nulls kept).
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in schema.fields]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            others = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            for part in slices(column):
                rows = part.last - part.first
                made = [a if isinstance(a, pa.Array) else pa.array(a) for a in
                        compute(part, column.slice(part.first, rows))]
                made = [a if a.type == t else a.cast(t) for a, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([o.slice(part.first, rows) for o in others] + made, names=names)

    return df.mapInArrow(run, schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


LONG, STRING, DOUBLE, BOOLEAN, BINARY, INT = (T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(),
                                              T.BinaryType(), T.IntegerType())


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
