"""Tables that grow by deltas, and merged incidents in the pipeline."""

import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventwarden.plans.rulepack import RULES
from eventwarden.sinks.incremental import IncrementalTable
from eventwarden.streaming.pipeline import Pipeline
from tests.test_streaming import attack

SCHEMA = T.StructType([T.StructField(n, kind) for n, kind in (
    ("k", T.StringType()), ("n", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), ("name", T.StringType()), ("last", T.StringType()))])
MERGE = {"n": "sum", "low": "min", "high": "max", "name": "first", "last": "last"}


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def _table(spark, folder, **options):
    return IncrementalTable(spark, str(folder), SCHEMA, ["k"], MERGE, **options)


def _merged(rows):
    out = {}
    for k, n, low, high, name, last in rows:
        had = out.get(k, (0, None, None, None, None))
        out[k] = (had[0] + n, low if had[1] is None else min(low, had[1]), high if had[2] is None else max(high, had[2]),
                  had[3] if had[3] is not None else name, last if last is not None else had[4])
    return out


def _rows(df):
    return {r.k: tuple(r)[1:] for r in df.collect()}


def test_deltas_add_up_and_folders_stay_flat(spark, tmp_path):
    rng, table, all_rows, sizes = random.Random(1), _table(spark, tmp_path / "t", most_deltas=4), [], []
    for batch in range(30):
        rows = [(f"k{k}", rng.randrange(9), rng.randrange(99), rng.randrange(99), rng.choice([None, f"n{batch}"]), rng.choice([None, f"l{batch}"]))
                for k in rng.sample(range(40), 5)]
        df = spark.createDataFrame(rows, SCHEMA)
        if batch % 7 == 3:  # a try that got as far as its delta
            table.apply(df.withColumn("n", F.col("n") + 1000), batch)
        assert table.apply(df, batch) == len(rows)
        all_rows += rows
        sizes.append(_size(tmp_path / "t"))
        if batch % 6 == 5:
            assert _rows(table.read()) == _merged(all_rows)
            assert _rows(table.read(before=batch)) == _merged(all_rows[:-5])
            some = spark.createDataFrame([("k3",), ("k7",), ("none",)], "k string")
            assert _rows(table.read(keys=some)) == {k: v for k, v in _merged(all_rows).items() if k in ("k3", "k7")}
    assert max(sizes[20:]) < 1.6 * max(sizes[8:18])
    assert len([n for n in os.listdir(tmp_path / "t") if n.startswith("base=")]) <= 2


def test_reads_for_keys_open_their_buckets_only(spark, tmp_path):
    table = _table(spark, tmp_path / "t", most_deltas=0, buckets=8)
    table.apply(spark.createDataFrame([(f"k{i}", 1, 1, 1, "x", "y") for i in range(200)], SCHEMA), 0)
    read = table.read(keys=spark.createDataFrame([("k5",)], "k string"))
    assert _rows(read) == {"k5": (1, 1, 1, "x", "y")}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan


def test_incidents_that_meet_are_merged_and_stay_merged(spark, make_events, tmp_path):
    first = make_events(attack(0, "mallory", "LINUX-03", "203.0.113.44"))
    second = make_events([{**e, "event_id": f"B{i}"} for i, e in enumerate(attack(5, "eve", "WIN-1", "198.51.100.9"))])
    # one account searches both hosts for setuid files
    search = attack(80, "trent")[6]
    bridge = [{**search, "event_id": f"C{i}", "host": host, "at": 200 + 10 * i} for i, host in enumerate(("LINUX-03", "WIN-1"))]
    p = Pipeline(spark, str(tmp_path / "tables"), RULES)
    p.run_events(first, 0)
    p.run_events(second, 1)
    before = p.tables()["membership"].select("incident_id").distinct().count()
    for _ in range(2):  # a batch that runs again merges the same incidents
        p.run_events(make_events(bridge), 2)
    merged = spark.read.schema("incident_id string, into string, batch_id int").parquet(p.path("merged_incidents")).collect()
    assert merged and {r.batch_id for r in merged} == {2}
    member = p.tables()["membership"]
    names = {r.incident_id for r in member.select("incident_id").distinct().collect()}
    assert not names & {r.incident_id for r in merged} and {r.into for r in merged} <= names
    assert member.count() == member.select("alert_id").distinct().count() == p.tables()["alerts"].count()
    assert len(names) < before + len(merged)
    cases = p.cases()
    assert {r.incident_id for r in cases.incidents.collect()} == names
