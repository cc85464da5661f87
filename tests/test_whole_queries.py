"""Registered queries over the whole of their tables, on rows made here."""

import datetime as dt

import duckdb

from check import rows_of
from eventwarden.plans.desk import desk
from eventwarden.registry import oracle_sql, queries

KINDS = ["signup", "error", "click", "view", "purchase"]


def feed(spark, folder, n=3000, users=3, step=97):
    """Events of all kinds over a few accounts, ``step`` seconds apart."""
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, start + dt.timedelta(seconds=step * i), i % users, KINDS[i * 7 % 5], float(i % 9), '{"k": %d}' % (i * 31 % 100)) for i in range(n)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_every_alert_is_explained(spark, tmp_path):
    folder = feed(spark, str(tmp_path / "feed"))
    got = queries()["alert_explanations"](spark, folder)
    alerts = {r.alert_id: r for r in desk(spark, folder).alerts.select("alert_id", "rule_type", "rule_id").collect()}
    lines = {r.alert_id: r.first_line for r in got.collect()}
    assert {r.rule_type for r in alerts.values()} == {"match", "threshold", "sequence", "ioc", "anomaly"}
    assert lines.keys() == alerts.keys() and all(lines.values())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    rel = con.sql(oracle_sql()["alert_explanations"])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(rel.columns, rel.fetchall())
