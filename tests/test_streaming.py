"""The micro-batch pipeline and the stateful operators against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from eventwarden.operators.groups import group_parts
from eventwarden.operators.sequence import SequenceSpec, StepSpec
from eventwarden.operators.threshold import ThresholdSpec, earliest_hits, matching_rows
from eventwarden.plans.rulepack import RULES
from eventwarden.streaming import operators as ops
from eventwarden.sources.replay import sliced_stream, time_slices
from eventwarden.streaming.pipeline import Pipeline, run_summary
from eventwarden.streaming.runs import Plan, Runs
from tests.test_detectors import _groups, _rule, random_events, slow_sequence


def drain(stream, folder, **options):
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/cp")
    writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def attack(start, user="mallory", host="LINUX-03", ip="203.0.113.44"):
    login = {"event_type": "authentication", "action": "login", "user": user, "host": host, "source_ip": ip, "source": "linux_auth"}
    return [
        *[{**login, "at": start + 10 * i, "status": "failure"} for i in range(5)],
        {**login, "at": start + 70, "status": "success"},
        {"at": start + 120, "event_type": "discovery", "action": "exec", "status": "success", "user": user, "host": host, "source": "edr_process",
         "process": "find", "command_line": "find / -perm -4000", "metadata": {"discovery_category": "permission", "argument_indicators": ["suid_enumeration"]}},
        {"at": start + 160, "event_type": "privilege", "action": "sudo", "status": "success", "user": user, "host": host, "source": "linux_auth",
         "metadata": {"elevated": True, "target_user": "root"}},
        {"at": start + 4000, "event_type": "file", "action": "create", "status": "success", "user": user, "host": host, "source": "file_integrity",
         "file_path": "/etc/cron.d/x", "metadata": {"persistence_path": True, "persistence_mechanism": "cron"}},
    ]


def test_pipeline_batches_alerts_and_incidents(spark, make_events, tmp_path):
    events = make_events(attack(0) + attack(40_000, "eve", "WIN-1", "198.51.100.9")).cache()
    p = Pipeline(spark, str(tmp_path / "tables"), RULES)
    cut = F.unix_micros("timestamp") - F.lit(events.agg(F.min(F.unix_micros("timestamp"))).first()[0])
    batches = [events.filter(cut < 50_000_000), events.filter(cut >= 50_000_000)]
    for i, batch in enumerate(batches):
        p.run_events(batch, i)
    alerts = {(r.rule_id, r.user): r for r in p.tables()["alerts"].collect()}
    expected = {"BRUTE_FORCE_001", "BRUTE_FORCE_003", "PRIVESC_SUID_ENUM_001", "PRIVESC_SUDO_CHAIN_001", "PERSISTENCE_SCHEDULED_TASK_001"}
    assert {r for r, u in alerts if u == "mallory"} == expected
    assert {r for r, u in alerts if u == "eve"} == expected
    # the five failures came before the success: the sequence was found by looking back over earlier batches
    assert alerts[("BRUTE_FORCE_003", "mallory")].evidence_count == 6
    cases = p.cases()
    owner = {r.alert_id: r.incident_id for r in cases.alerts.select("alert_id", "incident_id").collect()}
    by_user = {}
    for (_, user), row in alerts.items():
        by_user.setdefault(user, set()).add(owner[row.alert_id])
    # the file write comes over an hour after the rest, so it stands alone
    assert all(len(v) == 2 for v in by_user.values()) and not (by_user["mallory"] & by_user["eve"])
    rows = {r.incident_id: r for r in cases.incidents.collect()}
    assert len(rows) == 4 and sum(r.alert_count for r in rows.values()) == 10
    members = sorted(map(str, p.tables()["membership"].collect()))
    before = {n: sorted(map(str, t.collect())) for n, t in p.tables().items() if n in ("alerts", "alert_evidence", "alert_entities")}
    p.run_events(batches[1], 1)  # a batch that runs twice changes nothing
    assert sorted(map(str, p.tables()["membership"].collect())) == members
    after = {n: sorted(map(str, t.collect())) for n, t in p.tables().items() if n in before}
    assert before == after
    p.run_events(batches[0], 2)  # events another batch stored are repeats
    assert spark.read.parquet(p.path("events")).count() == 18
    summary = {r.metric: r.value for r in run_summary(p).collect()}
    assert summary["events_ingested"] == 18 and summary["alerts"] == 10


def test_raw_stream_quarantines_and_stores(spark, tmp_path):
    rows = [
        ("1", "linux_auth", '{"timestamp":"2024-01-10T10:00:00Z","host":"H","program":"sshd","message":"Failed password for bob from 203.0.113.9 port 22 ssh2"}'),
        ("2", "linux_auth", '{"timestamp":"2024-01-10T10:00:01Z","program":"sshd","message":"nothing"}'),
        ("3", "mystery", "{}"),
        ("4", "network_flow", "not json"),
        ("5", "cloud_audit", '{"a":' * 12 + "1" + "}" * 12),
    ]
    raw = spark.createDataFrame(rows, "record_id string, source string, record string").withColumn("ingested_at", F.lit("2024-01-10 10:05:00").cast("timestamp"))
    raw.write.json(str(tmp_path / "raw"))
    from eventwarden.sources.raw import read_raw_stream

    p = Pipeline(spark, str(tmp_path / "tables"), RULES, now=F.lit("2024-01-11").cast("timestamp"))
    p.start_raw(read_raw_stream(spark, str(tmp_path / "raw"), 100), str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.parquet(p.path("events")).collect()
    assert [r.user for r in kept] == ["bob"]
    bad = {r.record_id: r.reason for r in spark.read.parquet(p.path("quarantine")).collect()}
    assert bad == {
        "2": "no host, user, source_ip or cloud_account", "3": "no normalizer for source mystery", "4": "record is not a JSON object",
        "5": "raw record is nested too deeply",
    }


def test_stateful_threshold_equals_batch(spark, make_events, tmp_path):
    ops.use_rocksdb(spark)
    events = make_events(random_events(31, n=600, groups=8, span=4000))
    hourly = str(tmp_path / "events")
    rule = _rule("R", {"status": "failure"}, ("user",))
    for i, spec in enumerate((ThresholdSpec(rule, 5, 60), ThresholdSpec(rule, 4, 90, "host", 3))):
        want = {(r.g, r.hit_us) for r in earliest_hits(matching_rows(events, [spec])).collect()}
        time_slices(events, f"{hourly}{i}", 300)
        stream = sliced_stream(spark, f"{hourly}{i}", events.schema)
        hits = drain(ops.threshold_stream(stream, [spec]), str(tmp_path / f"out{i}"))
        got = {(r.g, r.hit_us) for r in hits.groupBy("g").agg(F.min("hit_us").alias("hit_us")).collect()}
        assert got == want and want


def _is(action):
    return F.coalesce(F.col("action") == action, F.lit(False))


def first_over_prefixes(rows, steps, window, limit):
    """Time of the first event at which the batch definition finds a match in what came so far."""
    plain = [(lambda e, a=a: a in e["action"], m, gap, opt) for a, m, gap, opt in steps]
    return next((rows[n - 1][0] for n in range(1, len(rows) + 1) if slow_sequence(rows[:n], plain, window, limit)), None)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_the_batch_definition_over_every_prefix(seed):
    rng, fired, most = random.Random(seed), 0, 0
    for _ in range(400):
        steps = [(rng.choice("abc"), rng.choice([1, 1, 2, 3]), rng.choice([None, None, 3, 6, 12]), rng.random() < 0.3)
                 for _ in range(rng.choice([2, 2, 3, 3, 4]))]
        window, limit = rng.choice([8, 15, 30, 60]), rng.choice([None, 1, 2, 2, 3, 4])
        hosts = [None, *[f"h{i}" for i in range(rng.choice([2, 3, 6]))]]
        times = sorted(rng.randrange(rng.choice([20, 60, 120])) for _ in range(rng.randrange(4, 40)))
        rows = [(t, f"e{i:03d}", {"action": rng.choice(["a", "b", "c", "ab", "bc", "abc", ""]), "host": rng.choice(hosts)})
                for i, t in enumerate(times)]
        runs = Runs(Plan(tuple((m, gap, opt) for _, m, gap, opt in steps), window, (limit,) if limit else ()))
        got = None
        for us, _, event in rows:
            if runs.advance(us, [a in event["action"] for a, *_ in steps], [event["host"]] if limit else []) is not None:
                got = us
                break
            most = max(most, len(runs.open))
        assert got == first_over_prefixes(rows, steps, window, limit), (steps, window, limit, rows)
        fired += got is not None
    assert fired > 100 and most < 30


def test_runs_of_a_hot_group_stay_few():
    runs, rng = Runs(Plan(((1, None, False), (2, 50, False), (1, 90, False)), 100_000, (3,))), random.Random(3)
    for us in range(5000):
        kind = rng.random()
        runs.advance(us, [kind < 0.9, kind > 0.9999, False], [f"h{rng.randrange(1000)}"])
        assert len(runs.open) < 12


SEQUENCES = [
    # ([(action, min_count, gap, optional)], window, distinct hosts)
    ([("a", 2, None, False), ("b", 1, 40, False), ("c", 1, 60, False)], 120, None),
    ([("a", 1, None, False), ("b", 1, 90, False), ("a", 1, 90, False)], 300, 2),
    ([("a", 1, None, False), ("b", 2, 40, True), ("c", 1, 60, False)], 120, None),
    ([("a", 1, None, False), ("b", 1, 30, True), ("c", 2, 60, False)], 200, 3),
]


def test_stateful_sequences_over_many_batches(spark, make_events, tmp_path):
    ops.use_rocksdb(spark)
    raw = random_events(41, n=900, groups=15, span=4000, hot=0.2)
    events = make_events(raw)
    specs = [SequenceSpec(f"R{i}", tuple(StepSpec(f"s{k}", _is(a), m, gap, opt) for k, (a, m, gap, opt) in enumerate(steps)),
                          window, group_parts(["user"]), (("host", hosts),) if hosts else ())
             for i, (steps, window, hosts) in enumerate(SEQUENCES)]
    want = set()
    for key, rows in _groups(raw, lambda e: True).items():
        for i, (steps, window, hosts) in enumerate(SEQUENCES):
            hit = first_over_prefixes(rows, steps, window, hosts)
            want |= {(f"R{i}", key, hit)} if hit is not None else set()
    time_slices(events, str(tmp_path / "events"), 300)
    hits = drain(ops.sequence_stream(sliced_stream(spark, str(tmp_path / "events"), events.schema), specs), str(tmp_path / "out"))
    base = events.agg(F.min(F.unix_micros("timestamp"))).first()[0] - min(e["at"] for e in raw) * 1_000_000
    got = {(r.rule_id, r.g[1:] if r.g.startswith("=") else None, (r.hit_us - base) // 1_000_000)
           for r in hits.groupBy("rule_id", "g").agg(F.min("hit_us").alias("hit_us")).collect()}
    assert got == want and len({w[0] for w in want}) == len(SEQUENCES)


def test_state_of_quiet_groups_expires(spark, make_events, tmp_path):
    ops.use_rocksdb(spark)
    step = {"event_type": "authentication", "action": "a", "status": "failure", "host": "h1"}
    rows = [{**step, "at": 3600 * hour + i, "user": f"u{hour}-{i}"} for hour in range(12) for i in range(20 if hour < 3 else 2)]
    events = make_events(rows)
    time_slices(events, str(tmp_path / "events"), 3600)
    spec = SequenceSpec("R", (StepSpec("x", _is("a")), StepSpec("y", _is("b"))), 600, group_parts(["user"]), (("host", 2),))
    rule = _rule("T", {"status": "failure"}, ("user",))
    for name, hits in (("sequence", lambda s: ops.sequence_stream(s, [spec], 60)),
                       ("threshold", lambda s: ops.threshold_stream(s, [ThresholdSpec(rule, 5, 600)], 60))):
        stream = hits(sliced_stream(spark, str(tmp_path / "events"), events.schema))
        run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress]
        assert len(held) >= 12 and max(held) >= 40 and held[-1] <= max(held) / 4, held


def test_replay_feeds_slices_in_time_order(spark, make_events, tmp_path):
    events = make_events(attack(0) + attack(40_000, "eve", "WIN-1", "198.51.100.9"))
    p = Pipeline(spark, str(tmp_path / "tables"), RULES)
    assert p.replay(events) == 4
    assert p.tables()["alerts"].count() == 10 and spark.read.parquet(p.path("events")).count() == 18


def test_batch_that_failed_half_way_is_processed_again(spark, make_events, tmp_path):
    class Failing(Pipeline):
        def _correlate(self, touched, batch_id):
            raise RuntimeError("lost")

    events = make_events(attack(0)).cache()
    folder = str(tmp_path / "tables")
    try:
        Failing(spark, folder, RULES).run_events(events, 0)
        raise AssertionError("the batch should have failed")
    except RuntimeError:
        pass
    p = Pipeline(spark, folder, RULES)
    p.run_events(events, 0)
    t = p.tables()
    assert t["events"].count() == 9 and t["alerts"].count() == 5
    assert t["membership"].count() == 5 and t["membership"].select("incident_id").distinct().count() == 2
    assert t["baseline"].filter("feature = 'login_hours'").first().observation_count == 1


def test_late_and_future_events_are_refused_with_a_reason(spark, make_events, tmp_path):
    at = F.lit("2024-01-11 00:00:00").cast("timestamp")
    p = Pipeline(spark, str(tmp_path / "tables"), RULES, now=at, lateness_seconds=600)
    login = {"event_type": "authentication", "user": "u", "host": "h", "status": "success"}
    first = make_events([{**login, "event_id": "A", "at": 0}, {**login, "event_id": "B", "at": 3000}, {**login, "event_id": "F", "at": 900_000}])
    second = make_events([{**login, "event_id": "C", "at": 1000}, {**login, "event_id": "D", "at": 2500}])
    for _ in range(2):  # a batch that runs again refuses the same events
        p.run_events(first, 0)
    p.run_events(second, 1)
    assert {r.event_id for r in spark.read.parquet(p.path("events")).collect()} == {"A", "B", "D"}
    late = {r.event_id: r.reason for r in spark.read.parquet(p.path("late")).collect()}
    assert late == {"F": "timestamp is more than 24h in the future", "C": "late"}


def test_closed_incidents_take_no_more_alerts(spark, make_events, tmp_path):
    p = Pipeline(spark, str(tmp_path / "tables"), RULES)
    events = make_events(attack(0)).cache()
    early = F.unix_micros("timestamp") < F.lit(events.agg(F.min(F.unix_micros("timestamp"))).first()[0] + 140_000_000)
    p.run_events(events.filter(early), 0)
    before = {r.incident_id for r in p.tables()["membership"].collect()}
    p.set_status(spark.createDataFrame([(i, "closed") for i in before], "incident_id string, status string"))
    p.run_events(events.filter(~early), 1)
    after = p.tables()["membership"].groupBy("incident_id").count().collect()
    assert before < {r.incident_id for r in after}
    open_ = Pipeline(spark, str(tmp_path / "other"), RULES)
    open_.run_events(events.filter(early), 0)
    open_.run_events(events.filter(~early), 1)
    assert open_.tables()["membership"].select("incident_id").distinct().count() < len(after)


def test_state_is_read_by_bucket_not_by_group(spark, make_events, tmp_path, monkeypatch):
    """Many groups share a bucket's state: two thirds of a bucket's groups come back in a later batch, the others wait."""
    monkeypatch.setattr(ops, "BUCKETS", 2)
    ops.use_rocksdb(spark)
    fail = {"event_type": "authentication", "status": "failure", "host": "h1"}
    early = [{**fail, "at": i, "action": "a", "user": f"u{i}"} for i in range(60)]
    late = [{**fail, "at": 400 + i, "action": "b", "user": f"u{i}"} for i in range(60) if i % 3]
    last = [{**fail, "at": 800 + i, "action": "b", "user": f"u{i}"} for i in range(60) if not i % 3]
    events = make_events(early + late + last)
    time_slices(events, str(tmp_path / "events"), 300)
    spec = SequenceSpec("R", (StepSpec("x", _is("a")), StepSpec("y", _is("b"))), 900, group_parts(["user"]))
    rule = _rule("T", {"status": "failure"}, ("user",))
    for name, hits in (("sequence", lambda s: ops.sequence_stream(s, [spec], 600)),
                       ("threshold", lambda s: ops.threshold_stream(s, [ThresholdSpec(rule, 2, 900)], 600))):
        found = hits(sliced_stream(spark, str(tmp_path / "events"), events.schema))
        run = found.writeStream.format("memory").queryName(f"buckets_{name}").option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination()
        got = {(r.g, r.event_id) for r in spark.table(f"buckets_{name}").collect()}
        want = {(f"={e['user']}", f"EVT-{60 + i:05d}") for i, e in enumerate(late + last)}
        assert got == want
