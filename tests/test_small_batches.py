"""What a micro-batch spends on jobs, files and whole events, whatever its size."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from eventwarden.operators import correlate
from eventwarden.plans.lookback import lookback_candidates
from eventwarden.session import stage, together
from eventwarden.sinks import tables

FAIL = {"event_type": "authentication", "status": "failure"}


def _components(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {f"n{i:03d}": f"n{x:03d}" for i, x in enumerate(label)}


def _labels(spark, n, links):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in links], "a string, b string")
    return {r.id: r.label for r in correlate.connected_components(nodes, edges).collect()}


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    made = []
    monkeypatch.setattr(correlate, "stage", lambda df, label="stage": made.append(label) or stage(df, label))
    assert _labels(spark, 120, links) == _components(120, links) and made.count("moves") == 0
    monkeypatch.setattr(correlate, "FEW_PAIRS", 40)  # a larger graph is contracted until it is small
    assert _labels(spark, 120, links) == _components(120, links) and made.count("moves") > 0
    monkeypatch.setattr(correlate, "FEW_PAIRS", 0)
    assert _labels(spark, 120, links) == _components(120, links)
    assert _labels(spark, 5, []) == {f"n{i:03d}": f"n{i:03d}" for i in range(5)}


def test_lookback_reads_whole_events_of_related_ids_only(make_events):
    batch = [{**FAIL, "event_id": f"B{i}", "at": 5000 + i, "user": "u", "host": "h"} for i in range(3)]
    old = [
        {**FAIL, "event_id": "near", "at": 4000, "user": "u"}, {**FAIL, "event_id": "far", "at": 100, "user": "u"},
        {**FAIL, "event_id": "other", "at": 4100, "user": "w"}, {**FAIL, "event_id": None, "at": 4200, "user": "u"},
        {**FAIL, "event_id": "twice", "at": 4300, "host": "h"}, {**FAIL, "event_id": "twice", "at": 3000, "host": "x"},
        {**FAIL, "event_id": "between", "at": 5001, "host": "h"}]
    new = make_events(batch)
    found = lookback_candidates(make_events(old + batch), new, 3600)
    assert sorted(r.event_id for r in found.collect()) == ["B0", "B1", "B2", "between", "near", "twice", "twice"]
    assert any("/related-" in f for f in found.inputFiles())
    assert lookback_candidates(make_events(batch), new, 3600).count() == 3


def test_a_batch_without_repeats_is_not_stored_again(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    first = stage(make_events([{**FAIL, "event_id": f"A{i}", "at": i} for i in range(60)]), "given")
    second = stage(make_events([{**FAIL, "event_id": f"C{i}", "at": i} for i in range(60)]), "given")
    for batch, given in enumerate((first, second)):
        assert set(tables.append_events(given, path, batch).inputFiles()) == set(given.inputFiles())
    # a day and type of few events is one file a batch
    assert len(spark.read.parquet(path).inputFiles()) == 2


def test_repeats_of_other_batches_are_dropped_and_own_ones_kept(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    row = lambda i: {**FAIL, "event_id": i, "at": 0}
    tables.append_events(make_events([row("a"), row("b")]), path, 0)
    tables.append_events(make_events([row("c")]), path, 1)
    again = tables.append_events(make_events([row("a"), row("c"), row("d"), row(None)]), path, 1)
    assert sorted(str(r.event_id) for r in again.collect()) == ["None", "c", "d"]
    assert sorted(str(r.event_id) for r in spark.read.parquet(path).collect()) == ["None", "a", "b", "c", "d"]


def test_independent_jobs_run_at_the_same_time(spark):
    both = threading.Barrier(2, timeout=60)

    def job(n):
        both.wait()
        return spark.range(n).select(F.max("id")).first()[0]

    assert together(lambda: job(5), lambda: job(9)) == [4, 8]
    with pytest.raises(ValueError, match="lost"):
        together(lambda: 1, lambda: (_ for _ in ()).throw(ValueError("lost")))
