"""What the detection pass reads, sorts and shuffles."""

import random

from pyspark.sql import functions as F

from eventwarden.model import EVENT_TYPES
from eventwarden.operators.baseline import with_history
from eventwarden.operators.threshold import ThresholdSpec, crowded, earliest_hits
from eventwarden.plans import detect
from eventwarden.plans.rulepack import Rule, Step
from eventwarden.session import prepare, stage

FAIL = {"event_type": "authentication", "status": "failure", "host": "h1", "user": "u"}


def test_events_are_stored_by_type_without_a_sort(spark):
    assert int(prepare(spark).conf.get("spark.sql.maxConcurrentOutputFileWriters")) > len(EVENT_TYPES)


def _rows(spark, seed, groups=40, n=600, w=60, need=3):
    rng = random.Random(seed)
    found = [("R", f"g{rng.randrange(groups)}", rng.randrange(2000), f"e{i}", rng.choice([None, "a", "b"]), w, need, 2)
             for i in range(n)]
    return found, spark.createDataFrame(
        found, "rule_id string, g string, us bigint, event_id string, d string, w bigint, n int, kd int")


def test_cells_no_window_can_fill_are_left_out_and_no_hit_is_lost(spark):
    found, rows = _rows(spark, 5)
    celled = rows.withColumn("cell", F.expr("us div w"))
    kept = {r.event_id for r in crowded(celled).select("event_id").collect()}
    assert 0 < len(kept) < len(found) // 2
    want = {}
    for _, g, us, event_id, _, w, n, kd in found:
        inside = [r for r in found if r[1] == g and us - w <= r[2] <= us]
        if len(inside) >= n and len({r[4] for r in inside} - {None}) >= kd:
            want[g] = min(us, want.get(g, us))
            assert {r[3] for r in inside} <= kept
    assert {r.g: r.hit_us for r in earliest_hits(rows).collect()} == want and want



def test_each_kind_of_rule_reads_the_events_once(make_events):
    events = stage(make_events([{**FAIL, "at": i} for i in range(4)] + [{**FAIL, "at": 5, "status": "success"}]), "given")
    source = set(events.inputFiles())
    steps = Rule("S", "sequence", "s", "low", 0.5, "c", (), (), group_by=("user",), window_seconds=60,
                 steps=(Step("a", {"status": "failure"}), Step("b", {"status": "success"})))
    rows = detect.sequence_rows(events, [steps])
    assert not source & set(rows.inputFiles()) and rows.count() == 5
    count = Rule("T", "threshold", "t", "low", 0.5, "c", (), (), selection={"status": "failure"}, group_by=("user",),
                 count=3, window_seconds=60)
    assert detect.threshold_rows(events, [count]).count() == 4


def test_first_seen_values_are_made_once(make_events):
    login = {"event_type": "authentication", "status": "success", "user": "u", "host": "h1", "source_ip": "10.0.0.1"}
    events = stage(make_events([{**login, "at": 4000 * i} for i in range(3)]), "given")
    rows = with_history(events, events)
    # the scored events, the counts by hour, and four readers of the stored first hours
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [event_id") == 2 and text.count("Relation [entity_ref") == 4
    assert sorted(r.hosts_seen for r in rows.collect()) == [False, True, True]


def test_thresholds_carry_rows_of_single_events(make_events):
    rule = Rule("T", "threshold", "t", "low", 0.5, "c", (), (), selection={"status": "failure"}, group_by=("user",),
                count=1, window_seconds=60)
    events = make_events([{**FAIL, "at": 0}, {**FAIL, "user": None, "at": 500}])
    assert {r.user for r in detect.threshold_rows(events, [rule]).collect()} == {"u", None}
    assert ThresholdSpec(rule, 1, 60).count == 1
