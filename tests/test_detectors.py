"""Threshold and sequence operators against slow plain-Python readings of their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from eventwarden.operators.groups import group_parts
from eventwarden.operators.sequence import SequenceSpec, StepSpec, sequence_evidence
from eventwarden.operators.threshold import ThresholdSpec, gate_new, threshold_evidence
from eventwarden.plans.rulepack import Rule


def _rule(rule_id, selection, group_by):
    return Rule(rule_id, "threshold", rule_id, "high", 0.8, "x", (), (), selection=selection, group_by=group_by)


def random_events(seed, n=900, groups=12, span=2000, hot=0.34):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        user = "u0" if rng.random() < hot else rng.choice([None, "U1", *[f"u{g}" for g in range(1, groups)]])
        out.append({
            "at": rng.randrange(span), "user": user, "host": rng.choice([None, "H1", "h1", "h2", "h3"]),
            "event_type": "authentication", "action": rng.choice(["a", "b", "c"]),
            "status": rng.choice(["failure", "success"]),
        })
    return out


def _groups(events, keep):
    found = {}
    for i, e in enumerate(events):
        if keep(e):
            key = e["user"].lower() if e["user"] is not None else None
            found.setdefault(key, []).append((e["at"], f"EVT-{i:05d}", e))
    return {k: sorted(v, key=lambda r: r[:2]) for k, v in found.items()}


def slow_threshold(rows, count, window, distinct):
    for right in range(len(rows)):
        inside = [r for r in rows[: right + 1] if rows[right][0] - r[0] <= window]
        values = {r[2]["host"].lower() for r in inside if r[2]["host"] is not None}
        if len(inside) >= count and (distinct is None or len(values) >= distinct):
            start = inside[0][0]
            return {r[1] for r in rows if start <= r[0] <= start + window}
    return None


@pytest.mark.parametrize("seed,count,window,distinct", [
    (1, 4, 60, None), (2, 5, 120, 3), (3, 2, 5, None), (4, 3, 40, 2), (5, 8, 300, 3),
])
def test_threshold_matches_brute_force(make_events, seed, count, window, distinct):
    events = random_events(seed)
    rule = _rule("R", {"status": "failure"}, ("user",))
    spec = ThresholdSpec(rule, count, window, "host" if distinct else None, distinct)
    got = {}
    for r in threshold_evidence(make_events(events), [spec]).select("group_key", "event_id").collect():
        got.setdefault(r.group_key[0], set()).add(r.event_id)
    want = {}
    for key, rows in _groups(events, lambda e: e["status"] == "failure").items():
        hit = slow_threshold(rows, count, window, distinct)
        if hit:
            want[key] = hit
    assert got == want and want


def slow_sequence(rows, steps, window, constraint=None):
    tests = [s[0] for s in steps]
    for a, (start, _, event) in enumerate(rows):
        if not tests[0](event):
            continue
        cursor, prev, matched, ok = a, start, [], True
        for i, (test, need, gap, optional) in enumerate(steps):
            got = []
            for p in range(cursor if i == 0 else cursor + 1, len(rows)):
                t = rows[p][0]
                if t - start > window:
                    break
                if not test(rows[p][2]):
                    continue
                if gap is not None and t - prev > gap:
                    break
                got.append(p)
                cursor = p
                if len(got) == need:
                    break
            if len(got) < need:
                if optional:
                    continue
                ok = False
                break
            prev = rows[got[-1]][0]
            matched.append((i, got))
        if not ok or not matched:
            continue
        evidence = {}
        for n, (i, got) in enumerate(matched):
            begin, last = rows[got[0]][0], rows[got[-1]][0]
            until = rows[matched[n + 1][1][0]][0] if n + 1 < len(matched) else None
            claimed = [
                p for p, r in enumerate(rows)
                if r[0] >= begin and r[0] - start <= window and p not in evidence and tests[i](r[2])
                and (r[0] < until if until is not None else r[0] <= last)
            ]
            for p in claimed or got:
                evidence.setdefault(p, i)
        if constraint:
            values = {rows[p][2]["host"].lower() for p in evidence if rows[p][2]["host"] is not None}
            if len(values) < constraint:
                continue
        return {(rows[p][1], i) for p, i in evidence.items()}
    return None


CASES = [
    # (name, [(action, min_count, gap, optional)], window, distinct hosts)
    ("two_steps", [("a", 3, None, False), ("b", 1, 60, False)], 120, None),
    ("three_steps", [("a", 1, None, False), ("b", 2, 50, False), ("c", 1, 30, False)], 150, None),
    ("same_step", [("a", 2, None, False), ("a", 2, 40, False)], 90, None),
    ("optional_single", [("a", 1, None, False), ("b", 1, 8, True), ("c", 1, 40, False)], 80, None),
    ("optional_many", [("a", 1, None, False), ("b", 3, 20, True), ("c", 1, 40, False)], 80, None),
    ("two_hosts", [("a", 1, None, False), ("b", 1, 90, False), ("a", 1, 90, False)], 100, 2),
    ("three_hosts", [("a", 1, None, False), ("b", 1, 90, False), ("a", 1, 90, False)], 100, 3),
    ("first_gap", [("a", 2, 120, False), ("b", 1, None, False)], 400, None),
]


@pytest.mark.parametrize("seed", [11, 12])
@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_sequence_matches_brute_force(make_events, case, seed):
    _, steps, window, distinct = case
    events = random_events(seed, n=700, groups=25, span=4000, hot=0.25)
    spec = SequenceSpec(
        "R", tuple(StepSpec(f"s{i}", F.coalesce(F.col("action") == a, F.lit(False)), m, gap, opt)
                   for i, (a, m, gap, opt) in enumerate(steps)),
        window, group_parts(["user"]), (("host", distinct),) if distinct else (),
    )
    got = {}
    for r in sequence_evidence(make_events(events), [spec]).select("group_key", "event_id", "step_index").collect():
        got.setdefault(r.group_key[0], set()).add((r.event_id, r.step_index))
    want = {}
    plain = [(lambda e, a=a: e["action"] == a, m, gap, opt) for a, m, gap, opt in steps]
    for key, rows in _groups(events, lambda e: True).items():
        hit = slow_sequence(rows, plain, window, distinct)
        if hit:
            want[key] = hit
    assert got == want and want


def test_rules_of_different_depth_share_a_job(make_events):
    events = random_events(21, n=400, groups=10, span=3000)
    two = CASES[0]
    three = CASES[1]
    is_action = lambda a: F.coalesce(F.col("action") == a, F.lit(False))

    def spec(name, case):
        return SequenceSpec(name, tuple(
            StepSpec(f"s{i}", is_action(a), m, gap, opt) for i, (a, m, gap, opt) in enumerate(case[1])
        ), case[2], group_parts(["user"]))

    df = make_events(events)
    pick = ["rule_id", "group_key", "event_id", "step_index"]
    together = sequence_evidence(df, [spec("A", two), spec("B", three)]).select(*pick)
    alone = sequence_evidence(df, [spec("A", two)]).select(*pick).union(
        sequence_evidence(df, [spec("B", three)]).select(*pick))
    key = lambda r: (r.rule_id, str(r.group_key), r.event_id, r.step_index)
    assert sorted(map(key, together.collect())) == sorted(map(key, alone.collect()))


def test_new_event_gate(make_events):
    events = [{"at": t, "user": u, "status": "failure", "event_type": "authentication"}
              for u in ("x", "y") for t in (0, 1, 2)]
    rule = _rule("R", {"status": "failure"}, ("user",))
    evidence = threshold_evidence(make_events(events), [ThresholdSpec(rule, 3, 10)])
    kept = gate_new(evidence, ["rule_id", "g"], F.col("event_id") == "EVT-00004")
    assert {r.group_key[0] for r in kept.select("group_key").collect()} == {"y"}


def test_evidence_carries_only_what_is_kept(make_events):
    from eventwarden.plans import detect
    from eventwarden.plans.rulepack import Rule, Step

    fail = {"event_type": "authentication", "status": "failure", "host": "h1", "user": "u", "metadata": {"target_user": "t"}}
    events = make_events([{**fail, "at": i} for i in range(4)] + [{**fail, "at": 5, "status": "success"}])
    count = Rule("T", "threshold", "t", "low", 0.5, "c", (), (), selection={"status": "failure"}, group_by=("user",),
                 count=3, window_seconds=60)
    steps = Rule("S", "sequence", "s", "low", 0.5, "c", (), (), group_by=("user",), window_seconds=60,
                 steps=(Step("a", {"status": "failure"}), Step("b", {"status": "success"})))
    specs = [ThresholdSpec(count, 3, 60)]
    assert sorted(threshold_evidence(events, specs, detect._facts()).columns) == sorted([
        *detect.CARRIED, "flags", "target", "rule_id", "group_key", "g", "us", "d", "w", "n", "kd"])
    for rows, held in ((detect.threshold_rows(events, [count]), 4), (detect.sequence_rows(events, [steps]), 5)):
        got = rows.collect()
        assert len(got) == held and {(r.user, r.target, r.status) for r in got} >= {("u", "t", "failure")}
        assert len({r.us for r in got}) == held
