"""Keyed tables that grow by small deltas.

A batch appends what it learnt as a delta of its own; nothing stored is read or rewritten for that. A read puts the rows of a
key together by the columns' merge rules. After ``most_deltas`` deltas the table is compacted into a base, dealt into buckets
by a hash of ``bucket_by``, so a read for some keys opens only the buckets these fall in. A manifest per batch names the base
and the deltas that are live; a batch that runs again starts from the manifest before its own and replaces its delta. Files
that neither the newest manifest nor the one before it names are removed, so a folder holds two bases and their deltas at
most.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, BATCH = "_bucket", "_batch"


@dataclass
class IncrementalTable:
    """``merge`` names a rule per column that is no key: sum, min, max, first or last (by batch, nulls passed over)."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: list[str]
    merge: dict[str, str] = field(default_factory=dict)
    bucket_by: str | None = None
    buckets: int = 32
    most_deltas: int = 8

    def __post_init__(self):
        self.bucket_by = self.bucket_by or self.keys[0]
        self.stored = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema.fields), T.StructField(BATCH, T.LongType())])

    # ---- manifests -------------------------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        """Batches with a manifest; two at most between runs."""
        at = self._path("_manifest")
        return sorted(int(s.getPath().getName()) for s in self._fs().listStatus(at)) if self._fs().exists(at) else []

    def _manifest(self, before: int | None) -> dict:
        known = [b for b in self._batches() if before is None or b < before]
        if not known:
            return {"base": None, "deltas": []}
        stream = self._fs().open(self._path("_manifest", str(known[-1])))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, batch_id: int, state: dict) -> None:
        stream = self._fs().create(self._path("_manifest", str(batch_id)), True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()

    def _vacuum(self, batch_id: int, states: list[dict]) -> None:
        live = {f"base={s['base']}" for s in states} | {f"delta={d}" for s in states for d in s["deltas"]}
        for status in self._fs().listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith(("base=", "delta=")) and name not in live:
                self._fs().delete(status.getPath(), True)
        for old in self._batches()[:-2]:
            self._fs().delete(self._path("_manifest", str(old)), False)

    # ---- rows ------------------------------------------------------------------------------------
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def _rows(self, state: dict, keys: DataFrame | None) -> DataFrame:
        names = self.stored.fieldNames()
        rows = self.spark.createDataFrame([], self.stored)
        if state["base"] is not None:
            schema = T.StructType([*self.stored.fields, T.StructField(BUCKET, T.IntegerType())])
            base = self.spark.read.schema(schema).parquet(f"{self.folder}/base={state['base']}")
            if keys is not None:
                touched = [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` values at most
                base = base.filter(F.col(BUCKET).isin(touched))
            rows = base.select(*names)
        if state["deltas"]:
            rows = rows.unionByName(self.spark.read.schema(self.stored).parquet(*[f"{self.folder}/delta={d}" for d in state["deltas"]]))
        return rows if keys is None else rows.join(keys.select(self.bucket_by).distinct(), self.bucket_by, "left_semi").select(*names)

    def _merged(self, rows: DataFrame) -> DataFrame:
        rules = {
            "sum": F.sum, "min": F.min, "max": F.max,
            "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(BATCH))),
            "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(BATCH))),
        }
        values = [rules[rule](name).alias(name) for name, rule in self.merge.items()]
        return rows.groupBy(*self.keys).agg(*values, F.max(BATCH).alias(BATCH)).select(*self.stored.fieldNames())

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The table as the latest batch (``before`` the given one) left it; with ``keys``, only rows of these values of
        ``bucket_by``."""
        return self._merged(self._rows(self._manifest(before), keys)).drop(BATCH)

    def apply(self, rows: DataFrame, batch_id: int) -> int:
        """Append a batch's rows; returns their number."""
        before = self._manifest(batch_id)
        counted = Observation()
        rows.select(*self.schema.fieldNames()).withColumn(BATCH, F.lit(batch_id).cast("long")).observe(
            counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.folder}/delta={batch_id}")
        state = {"base": before["base"], "deltas": [*before["deltas"], batch_id]}
        if len(state["deltas"]) > self.most_deltas:
            whole = self._merged(self._rows(state, None)).withColumn(BUCKET, self._bucket())
            whole.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/base={batch_id}")
            state = {"base": batch_id, "deltas": []}
        self._commit(batch_id, state)
        self._vacuum(batch_id, [before, state])
        return counted.get["rows"]
