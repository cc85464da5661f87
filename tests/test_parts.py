"""Conditions, addresses, clustering, gaps, quantiles, sinks and the registry."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from eventwarden.functions import net
from eventwarden.operators import correlate
from eventwarden.operators.conditions import compile_filters, compile_selection
from eventwarden.operators.quantiles import order_statistics
from eventwarden.plans import detect
from eventwarden.plans.reports import even_sample
from eventwarden.plans.respond import similar_incidents
from eventwarden.plans.rulepack import Rule, Step
from eventwarden.session import prepare
from eventwarden.sinks import tables


def ids(df):
    return sorted(int(r.event_id[4:]) for r in df.select("event_id").collect())


@pytest.fixture(scope="module")
def mixed(make_events):
    """Names in every case, and missing ones."""
    return make_events([
        {"user": "Alice", "status": "Failure", "metadata": {"elevated": True, "privileges": ["SeDebug", "x"], "windows_event_id": 4672}},
        {"user": "alice", "status": "failure", "metadata": {"elevated": False}},
        {"user": "ALICE", "status": "success", "command_line": "find / -perm -4000", "destination_port": 22},
        {"user": None, "status": "success", "destination_port": 3389},
        {"user": "bob", "status": "success", "bytes_out": 10, "metadata": {"service": "true"}},
    ])


@pytest.mark.parametrize("selection,want", [
    ({"user": "ALICE"}, [0, 1, 2]),
    ({"user": "alice", "case_sensitive": True}, [1]),
    ({"user": {"not_eq": "alice"}}, [3, 4]),
    ({"user": ["alice", "bob"]}, [0, 1, 2, 4]),
    ({"user": {"not_in": ["alice"]}}, [3, 4]),
    ({"metadata.elevated": True}, [0]),
    ({"metadata.elevated": False}, [1]),
    ({"metadata.elevated": {"not_eq": True}}, [1, 2, 3, 4]),
    ({"metadata.privileges": {"contains": ["sedebug"]}}, [0]),
    ({"metadata.privileges": {"not_contains": "x"}}, [1, 2, 3, 4]),
    ({"command_line": {"contains": "-PERM"}}, [2]),
    ({"command_line": {"not_regex": "perm"}}, [0, 1, 3, 4]),
    ({"command_line": {"regex": ["^FIND", "nothing"]}}, [2]),
    ({"destination_port": {"gte": 23}}, [3]),
    ({"destination_port": {"lt": "23"}}, [2]),
    ({"bytes_out": {"gt": "many"}}, []),
    ({"metadata.windows_event_id": 4672}, [0]),
    ({"metadata.windows_event_id": "4672"}, []),
    ({"timestamp": {"gt": 0}}, []),
    ({"user": {"exists": False}}, [3]),
    ({"user": {"is_null": False}}, [0, 1, 2, 4]),
    ({"not": {"user": "alice"}}, [3, 4]),
    ({"case_sensitive": True, "any_of": [{"user": "ALICE"}]}, [0, 1, 2]),
    ({"all_of": [{"user": {"startswith": "AL"}}, {"status": {"endswith": "ure"}}]}, [0, 1]),
    ({}, [0, 1, 2, 3, 4]),
])
def test_rule_language(mixed, selection, want):
    assert ids(mixed.filter(compile_selection(selection))) == want


@pytest.mark.parametrize("filters,keep_null,want", [
    ([("user", "ne", "alice")], False, [4]),
    ([("user", "ne", "alice")], True, [3, 4]),
    ([("user", "not_in", ["ALICE"])], True, [3, 4]),
    ([("user", "contains", "LIC")], False, [0, 1, 2]),
    ([("metadata.elevated", "eq", "TRUE")], False, [0]),
    ([("metadata.elevated", "ne", True)], False, [1]),
    ([("metadata.service", "eq", True)], False, [4]),
    ([("destination_port", "in", [22, 3389])], False, [2, 3]),
])
def test_hunt_filters(mixed, filters, keep_null, want):
    assert ids(mixed.filter(compile_filters(filters, null_negation=keep_null))) == want


def test_unknown_fields_are_refused():
    with pytest.raises(KeyError):
        compile_selection({"no_such_field": 1})


ADDRESSES = [
    "10.1.2.3", "172.31.255.255", "172.32.0.1", "192.168.1.1", "203.0.113.4", "8.8.8.8", "256.1.1.1", "01.2.3.4", "::1", "0:0:0:0:0:0:0:1",
    "fc00::1", "fdff::", "fe80::1%eth0", "fe80:0:0:0:1::", "2001:db8::5", "2001:0db8:0:0:1:0:0:1", "::", "1::", "1:2:3:4:5:6:7:8:9",
    "1:2:3:4:5:6:7", "12345::", "abc", "", " 10.0.0.1 ", "1.2.3", "::1::", "1:0:0:2:0:0:0:3", "100.64.0.1", "100.128.0.1", "169.254.3.4",
    "127.0.0.1 ; DROP", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:300.1.1.1", "g::1", None, "0:0:1:0:0:1:0:0", "1:2:3:4:5:6:1.2.3.4", ":1::2", "1::2:",
]


def test_addresses_agree_with_the_standard_library(spark):
    internal = [ipaddress.ip_network(c) for c in (
        "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "::1/128", "fc00::/7", "fe80::/10")]
    ip = F.col("ip")
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string").select(ip, net.classify(ip).alias("kind"), net.canonical_ip(ip).alias("text"))
    for r in rows.collect():
        try:
            parsed = ipaddress.ip_address(r.ip.strip())
        except (ValueError, AttributeError):
            parsed = None
        want = "unknown" if parsed is None else "internal" if any(parsed in n for n in internal) else "external"
        assert (r.kind, r.text) == (want, None if parsed is None else str(parsed)), r.ip


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_match_pairwise_definition(spark, seed):
    rng = random.Random(seed)
    alerts, entities, window = [], [], 60
    for i in range(180):
        first = rng.randrange(6000)
        alerts.append((f"A{i:03d}", first * 1_000_000, (first + rng.randrange(40)) * 1_000_000))
        pool = ["hot"] if rng.random() < 0.3 else [f"e{rng.randrange(60)}" for _ in range(rng.randrange(3))]
        entities += [(f"A{i:03d}", e) for e in set(pool)]
    own = {}
    for a, e in entities:
        own.setdefault(a, set()).add(e)
    parent = {a[0]: a[0] for a in alerts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(alerts):
        for b in alerts[i + 1:]:
            gap = max(a[1] - b[2], b[1] - a[2], 0)
            if own.get(a[0], set()) & own.get(b[0], set()) and gap <= window * 1_000_000:
                parent[find(b[0])] = find(a[0])
    want = {}
    for a in alerts:
        want.setdefault(find(a[0]), set()).add(a[0])
    df = spark.createDataFrame(alerts, "alert_id string, first_us bigint, last_us bigint")
    links = spark.createDataFrame(entities, "alert_id string, entity string")
    got = {}
    for r in correlate.cluster_alerts(df, links, window).collect():
        got.setdefault(r.cluster, set()).add(r.alert_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(got) > 5


def test_long_chain_settles(spark):
    nodes = spark.createDataFrame([(f"n{i:04d}",) for i in range(400)], "id string")
    edges = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(399) if i != 200], "a string, b string")
    labels = {r.label for r in correlate.connected_components(nodes, edges).collect()}
    assert labels == {"n0000", "n0201"}


def test_largest_gap_and_order_statistics(spark):
    rng = random.Random(3)
    rows = [("k", rng.randrange(10**9)) for _ in range(300)] + [("one", 5)]
    df = spark.createDataFrame(rows, "k string, us bigint")
    gaps = {r.k: r.largest_gap_us for r in correlate.largest_gap(df, ["k"], "us", 10**7).collect()}
    times = sorted(v for k, v in rows if k == "k")
    assert gaps == {"k": max(b - a for a, b in zip(times, times[1:])), "one": None}
    stats = {r.k: r for r in order_statistics(df, ["k"], "us", 10**7).collect()}
    assert stats["k"].median == (times[149] + times[150]) / 2 and stats["k"].p95 == times[round(0.95 * 299)]
    assert (stats["one"].median, stats["one"]["count"]) == (5.0, 1)


def test_even_sample_follows_the_plain_reading(spark):
    rng = random.Random(9)
    rows = [(k, f"E{i:04d}", rng.randrange(10**12), rng.random() < 0.1) for i, k in enumerate(rng.choices(["a", "b", "c"], [80, 15, 5], k=500))]
    df = spark.createDataFrame(rows, "k string, event_id string, us bigint, t boolean")
    got = {}
    for r in even_sample(df, "k", "us", F.col("t"), 40).collect():
        got.setdefault(r.k, set()).add(r.event_id)
    for key in "abc":
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        if len(own) <= 40:
            want = {r[1] for r in own}
        else:
            hits, rest = [r for r in own if r[3]], [r for r in own if not r[3]]
            left = 40 - len(hits[:40])
            want = {r[1] for r in hits[:40]} | ({r[1] for r in rest[:: max(1, len(rest) // left)][:left]} if left else set())
        assert got[key] == want


def test_similar_incidents(spark):
    incidents = spark.createDataFrame([
        ("I1", ["T1"], ["R1"], "high", 2), ("I2", ["T1"], ["R1"], "high", 2), ("I3", ["T2"], ["R2"], "low", 1)],
        "incident_id string, technique_ids array<string>, rule_ids array<string>, severity string, entity_count bigint")
    keys = spark.createDataFrame([("I1", "a"), ("I1", "b"), ("I2", "a"), ("I2", "c"), ("I3", "z")], "incident_id string, entity string")
    rows = similar_incidents(incidents, keys, ["I1"]).collect()
    assert [(r.incident_id, r.similarity) for r in rows] == [("I2", 0.9)]


def test_similar_incidents_of_none(spark):
    incidents = spark.createDataFrame([("I1", ["T1"], ["R1"], "high", 1)], "incident_id string, technique_ids array<string>, rule_ids array<string>, severity string, entity_count long")
    keys = spark.createDataFrame([("I1", "host:a")], "incident_id string, entity string")
    assert similar_incidents(incidents, keys, ["I9"]).collect() == []


def test_wide_methods_are_left_to_single_operators(spark):
    prepare(spark)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_tables_beyond_the_limit_are_not_broadcast(spark, tmp_path):
    prepare(spark)
    for name in "ab":  # packs to some 1 MB, far less than in memory
        spark.range(200_000).withColumn("x", F.lit("x" * 200)).write.parquet(f"{tmp_path}/{name}")
    joined = spark.read.parquet(f"{tmp_path}/a").join(spark.read.parquet(f"{tmp_path}/b"), "id")
    assert joined.count() == 200_000
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_insert_absent_and_indicator_upsert(spark, tmp_path):
    path = str(tmp_path / "links")
    rows = lambda *r: spark.createDataFrame(list(r), "a string, e string, d string")
    assert tables.insert_absent(rows(("1", "x", "d1"), ("1", "x", "d1")), path, ["a", "e"], "d").count() == 1
    assert tables.insert_absent(rows(("1", "x", "d1"), ("2", "x", "d1")), path, ["a", "e"], "d").count() == 1
    assert spark.read.parquet(path).count() == 2
    ddl = "ioc_id string, indicator string, ioc_type string, confidence double, severity string, source string, description string, tags array<string>, is_active boolean"
    old = spark.createDataFrame([("I1", "Evil.example", "domain", 0.5, "low", "s", "", [], True)], ddl)
    new = spark.createDataFrame([("N1", "evil.EXAMPLE", "domain", 0.9, "high", "t", "", [], False), ("N2", "1.2.3.4", "ip", 0.7, "high", "t", "", [], True)], ddl)
    merged, counts = tables.upsert_indicators(new, old)
    assert counts.first().asDict() == {"created": 1, "updated": 1}
    kept = {r.ioc_id: (r.indicator, r.confidence, r.is_active) for r in merged.collect()}
    assert kept == {"I1": ("Evil.example", 0.9, False), "N2": ("1.2.3.4", 0.7, True)}


def test_feed_documents(spark, tmp_path):
    from eventwarden.operators.indicators import read_feed

    (tmp_path / "feed.json").write_text(
        '{"provenance": "LOCAL", "indicators": [{"indicator": " 203.0.113.9 ", "ioc_type": "IP", "tags": ["x"]},\n'
        '{"indicator": "", "ioc_type": "ip"}, {"indicator": "a", "ioc_type": "colour"}]}')
    rows = read_feed(spark, str(tmp_path / "feed.json")).collect()
    assert [(r.indicator, r.ioc_type, r.confidence, r.severity, r.tags, r.is_active) for r in rows] == [
        ("203.0.113.9", "ip", 0.5, "medium", ["x", "LOCAL"], True)]


def test_equal_raw_lines_are_separate_records(spark, tmp_path):
    from eventwarden.sources.raw import read_raw

    (tmp_path / "auth.log").write_text('{"a": 1}\n' * 5 + '{"a": 2}\n')
    first = read_raw(spark, str(tmp_path / "auth.log"), "linux_auth").collect()
    again = read_raw(spark, str(tmp_path / "auth.log"), "linux_auth").collect()
    assert len(first) == 6 and len({r.record_id for r in first}) == 6
    assert {r.record_id for r in first} == {r.record_id for r in again}


def test_job_errors_fail_the_batch_and_malformed_rules_do_not(spark, make_events, monkeypatch):
    import pytest
    from pyspark.errors import PySparkException

    from eventwarden.plans import detect
    from eventwarden.plans.rulepack import RULES

    events = make_events([{"at": 0, "event_type": "authentication", "status": "failure", "user": "a", "host": "h"}])

    def lost(*_):
        raise PySparkException("executor lost")

    monkeypatch.setattr(detect, "threshold_rows", lost)
    with pytest.raises(PySparkException):
        detect.collect_evidence(events, RULES)

    def malformed(events, rules):
        raise ValueError("no such operator")

    monkeypatch.setattr(detect, "threshold_rows", malformed)
    skipped = []
    detect.collect_evidence(events, RULES, skipped=skipped)
    assert skipped and all(isinstance(x, str) for x in skipped)


def test_alerts_without_a_dedup_window_are_merged_into_one_bucket(spark, tmp_path):
    from eventwarden.sinks.tables import event_day

    bucket = F.expr("""CASE WHEN dedup_seconds > 0
        THEN (last_us div nullif(dedup_seconds * 1000000, 0)) * dedup_seconds * 1000000 ELSE CAST(0 AS BIGINT) END""")
    rows = spark.createDataFrame([(90_000_000_000, 0), (90_000_000_000, 60)], "last_us bigint, dedup_seconds bigint")
    assert [r.day for r in rows.select(event_day(bucket).alias("day")).collect()] == ["1970-01-01", "1970-01-02"]


def _pattern_rule(name, pattern):
    return Rule(name, "match", name, "low", 0.5, "x", (), (), selection={"event_type": "nothing", "command_line": {"regex": pattern}})


def test_rules_with_patterns_the_engine_refuses_are_named(spark, make_events):
    events = make_events([{"event_type": "process", "command_line": "sudo aa"}, {"event_type": "process", "command_line": "aaaa"}])
    good = [Rule(f"GOOD_{i}", "match", "g", "low", 0.5, "x", (), (), selection={"command_line": {"regex": p}})
            for i, p in enumerate(["a{,3}$", "(?P<the_name>a)(?P=the_name)", r"\\{,3}|^sudo", "(?P<n>sudo)"])]
    bad = [_pattern_rule(f"BAD_{i}", p) for i, p in enumerate(["(", "[a-", "(?(1)a|b)", "a**"])]
    bad.append(Rule("BAD_STEP", "sequence", "b", "low", 0.5, "x", (), (), group_by=("user",), window_seconds=60, steps=(
        Step("a", {"event_type": "process"}), Step("b", {"any_of": [{"event_type": "process"}, {"action": {"regex": "*"}}]}))))
    bad.append(Rule("BAD_FIELD", "threshold", "b", "low", 0.5, "x", (), (), selection={"event_type": "process"},
                    group_by=("no_such_field",), count=2, window_seconds=60))
    skipped = []
    found = detect.collect_evidence(events, [*good, *bad], skipped=skipped)
    fired = {(r.rule_id, r.event_id) for r in found.collect()}
    assert {r for r, _ in fired} == {r.id for r in good}
    assert {e for r, e in fired if r == "GOOD_1"} == {"EVT-00000", "EVT-00001"}
    assert sorted(skipped) == sorted(r.id for r in bad)
    again = []
    assert detect.collect_evidence(events, [*good, *bad], skipped=again).count() == len(fired) and sorted(again) == sorted(skipped)


def test_tables_of_terms_are_not_broadcast(spark):
    from eventwarden.llm import divergence
    from eventwarden.session import BROADCAST_LIMIT

    docs = spark.createDataFrame([(i, "one two", "en", f"s{i % 2}") for i in range(4)], "doc_id long, text string, lang string, source string")
    assert divergence.audit(docs).count() == 2
    assert {spark.conf.get(name) for name in divergence.BROADCASTS} == {BROADCAST_LIMIT}
