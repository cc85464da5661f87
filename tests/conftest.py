import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventwarden.model import METADATA_TYPES, event_schema
from eventwarden.session import build_session

BASE = dt.datetime(2024, 1, 10, 14, 0, 0, tzinfo=dt.timezone.utc)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores="4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from short dicts; ``at`` is seconds after a fixed base time."""
    schema = event_schema()

    def build(specs):
        rows = []
        for i, spec in enumerate(specs):
            spec = dict(spec)
            at = BASE + dt.timedelta(seconds=float(spec.pop("at", 0)))
            meta = dict(spec.pop("metadata", {}))
            row = {f.name: None for f in schema.fields}
            row.update(event_id=f"EVT-{i:05d}", timestamp=at, ingested_at=at, event_type="process",
                       source="normalized", status="unknown")
            row.update(spec)
            row["metadata"] = {k: meta.get(k) for k in METADATA_TYPES}
            rows.append(tuple(row[f.name] if f.name != "metadata" else tuple(row["metadata"].values())
                              for f in schema.fields))
        return spark.createDataFrame(rows, schema)

    return build


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def lit(value):
    return F.lit(value)
