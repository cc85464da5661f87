"""Stateless and stateful operators on an event stream."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from eventwarden.model import LOOKBACK_SECONDS
from eventwarden.operators.groups import group_text
from eventwarden.operators.indicators import match_indicators
from eventwarden.operators.match import match_rules
from eventwarden.operators.sequence import SequenceSpec, step_rows
from eventwarden.operators.threshold import ThresholdSpec, matching_rows
from eventwarden.plans.detect import dedup_key
from eventwarden.streaming.runs import Plan, Run, Runs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State store of the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def admitted(stream: DataFrame, lookback_seconds: int = LOOKBACK_SECONDS, now=None) -> DataFrame:
    """Events inside the lateness bound, future ones removed first so they cannot push the watermark."""
    now = F.current_timestamp() if now is None else now
    return stream.filter(F.col("timestamp") <= now + F.expr("INTERVAL 24 HOURS")).withWatermark("timestamp", f"{lookback_seconds} seconds")


def late_or_future(events: DataFrame, watermark_us, now_us) -> DataFrame:
    """Quarantine rows of one batch: behind the watermark (null: none yet) or more than a day ahead."""
    us = F.unix_micros("timestamp")
    reason = F.when(us > now_us + 86_400_000_000, "timestamp is more than 24h in the future").when(us < watermark_us, "late")
    return events.withColumn("reason", reason).filter("reason IS NOT NULL")


def without_repeats(stream: DataFrame) -> DataFrame:
    """First arrival of each event id within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def match_stream(stream: DataFrame, rules: list) -> DataFrame:
    """Single-event rules on the stream."""
    return match_rules(stream, rules).select("rule_id", "event_id", "timestamp", group_text("group_key").alias("group_text"))


def indicator_stream(stream: DataFrame, indicators: DataFrame, fields: list[str], types: list[str] | None = None) -> DataFrame:
    """Indicator hits: stream joined with the stored feed."""
    return match_indicators(stream, indicators, fields, types).select("ioc_id", "event_id", "matched_field", "timestamp")


def suppressed_alerts(stream: DataFrame, rules: list, dedup_seconds: int) -> DataFrame:
    """Match detections with repeats of a dedup key dropped inside the watermark."""
    hits = match_rules(stream, rules).withColumn("dedup_seconds", F.lit(dedup_seconds).cast("bigint")).withColumn("last_us", F.unix_micros("timestamp"))
    keyed = hits.withColumn("dedup_key", dedup_key())
    return keyed.dropDuplicatesWithinWatermark(["dedup_key"]).select("rule_id", "dedup_key", "event_id", "timestamp")


def counts_by_hour(stream: DataFrame, column: str = "status") -> DataFrame:
    """Tumbling hourly counts."""
    return stream.groupBy(F.window("timestamp", "1 hour").alias("w"), column).agg(F.count("*").alias("n")).select(
        F.unix_micros(F.col("w.start")).alias("hour_us"), column, "n")


def sliding_counts(stream: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Overlapping windows for dashboards; the exact per-event window is the stateful threshold."""
    return stream.groupBy(F.window("timestamp", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.unix_micros(F.col("w.start")).alias("start_us"), "event_type", "n")


def activity_sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of activity per account, closed by a quiet gap."""
    return stream.filter(F.col("user").isNotNull()).groupBy(F.session_window("timestamp", gap).alias("w"), "user").agg(
        F.count("*").alias("n")).select("user", F.unix_micros(F.col("w.start")).alias("start_us"), F.unix_micros(F.col("w.end")).alias("end_us"), "n")


# ---- threshold ------------------------------------------------------------------------------------
# Groups are dealt by hash to so many buckets a rule, and a bucket's state is read and written at once: a call for every
# group of a micro-batch costs more than its events. Fixed, as a checkpoint's state is kept by bucket.
BUCKETS = 256


class Expiring(StatefulProcessor):
    """State of a bucket of groups, one row a group, that goes when the watermark has passed all it could still decide.

    A group is held until the end of its newest window, and left out when its bucket is next read after that; the bucket's
    timer is at the end of the newest window of all. The timer that fires finds a bucket without newer events, and its
    state is cleared.
    """

    GROUP: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "at bigint")
        self.groups = handle.getListState("groups", f"g string, until bigint, {self.GROUP}")

    def _held(self, timer_values) -> dict[str, tuple]:
        """The groups that may still decide something: by name, their last millisecond and their state."""
        now = timer_values.getCurrentWatermarkInMs()
        plain = lambda x: tuple(x) if isinstance(x, Row) else [plain(y) for y in x] if isinstance(x, list) else x
        return {row[0]: tuple(plain(x) for x in row[1:]) for row in self.groups.get() if row[1] > now}

    def _until(self, us: int, held: tuple | None) -> int:
        """Forget the group once the watermark is beyond ``us``; never earlier than asked before."""
        return max(us // 1000 + 1, held[0] if held is not None else 0)

    def _hold(self, groups: dict[str, tuple]) -> None:
        if not groups:
            return
        self.groups.put([(g, *row) for g, row in groups.items()])
        at, asked = int(max(row[0] for row in groups.values())), self.alarm.get()
        if asked is not None and asked[0] >= at:
            return
        if asked is not None:
            self.handle.deleteTimer(asked[0])
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.groups.clear()
        self.alarm.clear()
        yield pd.DataFrame([], columns=HIT_COLUMNS)

    def close(self) -> None:
        pass


HIT_COLUMNS = ["rule_id", "g", "start_us", "hit_us", "event_id"]


class ThresholdState(Expiring):
    """Reports, per micro-batch and group, the earliest event that completes a window.

    As in the batch operator, time is cut into window-wide cells and a cell keeps only the rows that can
    decide the answer, so neither a batch's rows nor the state grow with a hot group, and chunks may come in
    any order. After a report the group stays quiet for one window. ``hit_us`` is exact; with a distinctness
    limit ``start_us`` is the first row still held.
    """

    GROUP = "us array<bigint>, d array<string>, id array<string>, quiet bigint"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held(timerValues)
        fresh: dict[str, dict] = {}
        n = w = kd = None
        for frame in rows:
            n, w = int(frame["n"].iloc[0]), int(frame["w"].iloc[0])
            kd = None if pd.isna(frame["kd"].iloc[0]) else int(frame["kd"].iloc[0])
            values = frame["d"].astype(object).where(frame["d"].notna(), None)
            for g, *row in zip(frame["g"], frame["us"].astype("int64").tolist(), values, frame["event_id"]):
                self._put(fresh.setdefault(g, {}), tuple(row), n, w, kd, held[g][4] if g in held else -1)
        out = []
        for g, cells in fresh.items():
            hit, last, state = self._advance(cells, held.get(g), n, w, kd)
            out += [(key[0], g, *hit)] if hit is not None else []
            held[g] = (self._until(last + w, held.get(g)), *state)
        self._hold(held)
        yield pd.DataFrame(out, columns=HIT_COLUMNS)

    def _advance(self, cells: dict, held: tuple | None, n: int, w: int, kd: int | None) -> tuple:
        """Of a group's new rows and what it held: its hit or None, its newest time and what it holds from now on."""
        quiet = held[4] if held is not None else -1
        fresh = {r for cell in cells.values() for r in cell}
        for row in zip(*held[1:4]) if held is not None else ():
            self._put(cells, row, n, w, kd, quiet)
        kept = sorted((r for cell in cells.values() for r in cell), key=lambda r: (r[0], r[2]))
        hit, low = None, 0
        for i, (us, _, event_id) in enumerate(kept):
            while us - kept[low][0] > w:
                low += 1
            inside = kept[low : i + 1]
            if us <= quiet or kept[i] not in fresh or len(inside) < n:
                continue
            if kd is None or len({d for _, d, _ in inside if d is not None}) >= kd:
                hit = (inside[0][0], us, event_id)
                quiet = inside[0][0] + w
                break
        last = int(kept[-1][0])
        tail = [r for r in kept if r[0] >= last - w]
        return hit, last, ([int(r[0]) for r in tail], [r[1] for r in tail], [r[2] for r in tail], int(quiet))

    def _put(self, cells: dict, row: tuple, n: int, w: int, kd: int | None, quiet: int) -> None:
        cell = cells.setdefault((row[0] // w, row[0] > quiet), [])
        cell.append(row)
        if len(cell) > 8 * (n + (kd or 0)):
            cells[(row[0] // w, row[0] > quiet)] = self._thin(cell, n, kd)

    @staticmethod
    def _thin(rows: list, n: int, kd: int | None) -> list:
        """First and last N rows, and the first and last row of the K earliest and K latest values."""
        rows = sorted(rows, key=lambda r: (r[0], r[2]))
        keep = set(range(min(n, len(rows)))) | set(range(max(0, len(rows) - n), len(rows)))
        for order in (range(len(rows)), range(len(rows) - 1, -1, -1)):
            seen: set = set()
            for i in order:
                if kd is None or len(seen) >= kd:
                    break
                if rows[i][1] is not None and rows[i][1] not in seen:
                    seen.add(rows[i][1])
                    keep.add(i)
        return [rows[i] for i in sorted(keep)]


HITS = "rule_id string, g string, start_us bigint, hit_us bigint, event_id string"


def _stateful(rows: DataFrame, processor: StatefulProcessor, lateness_seconds: int) -> DataFrame:
    """``rows`` by rule and bucket of groups through the processor; the watermark bounds lateness and lets old state go."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int"))
    return dealt.withWatermark("timestamp", f"{lateness_seconds} seconds").groupBy("rule_id", "bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(HITS), outputMode="Append", timeMode="EventTime")


def threshold_stream(stream: DataFrame, specs: list[ThresholdSpec], lateness_seconds: int = LOOKBACK_SECONDS) -> DataFrame:
    """Completed windows per rule and group as the events arrive."""
    rows = matching_rows(stream, specs).select("rule_id", "g", "us", "d", "n", "w", "kd", "event_id", "timestamp")
    return _stateful(rows, ThresholdState(), lateness_seconds)


# ---- sequence -------------------------------------------------------------------------------------
class SequenceState(Expiring):
    """Reports the first event at which a group's ordered rule is complete: what the batch operator would find over the
    events so far, constraints and optional steps included (see ``runs.py``).

    After a report the group begins anew. ``hit_us`` is exact; ``start_us`` is the earliest anchor still held. A group's
    events of one micro-batch are sorted together, and micro-batches are taken in time order: the source's trigger limits
    set the size of the first and the order of the second. A late event advances the runs as if it had just come.
    """

    RUN = ("anchor bigint, counts array<int>, first array<bigint>, ends array<bigint>, "
           "of array<int>, checks array<int>, held array<string>, at array<bigint>, own array<boolean>")
    GROUP = ("quiet bigint, us array<bigint>, of array<int>, checks array<int>, held array<string>, "
             f"runs array<struct<{', '.join(f.replace(' ', ': ', 1) for f in RUN.split(', '))}>>")

    def __init__(self, plans: dict[str, Plan]):
        self.plans = plans

    def _load(self, plan: Plan, held: tuple | None) -> Runs:
        if held is None:
            return Runs(plan)
        open_ = []
        for row in held[6]:
            anchor, counts, first, ends = int(row[0]), *([int(x) for x in part] for part in row[1:4])
            run = Run(anchor, counts, first, ends)
            for of, check, value, at, own in zip(*row[4:]):
                (run.own if own else run.seen).setdefault((int(of), int(check)), {})[value] = int(at)
            open_.append(run)
        ties = [(int(a), int(b), int(c), d) for a, b, c, d in zip(*held[2:6])]
        return Runs(plan, open_, held[1], ties)

    def _state(self, runs: Runs) -> tuple:
        rows = []
        for run in runs.open:
            values = [(*place, value, at, own) for own, kept in ((False, run.seen), (True, run.own))
                      for place, held in kept.items() for value, at in held.items()]
            rows.append((run.anchor, run.counts, run.first, run.ends, *([v[i] for v in values] for i in range(5))))
        return (runs.quiet, *([t[i] for t in runs.ties] for i in range(4)), rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plan = self.plans[key[0]]
        groups, out = self._held(timerValues), []
        flags = [f"s{k}" for k in range(len(plan.steps))]
        checks = [f"v{i}" for i in range(len(plan.limits))]
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["g", "us", "event_id"])
        values = batch[checks].astype(object).where(batch[checks].notna(), None)
        events = zip(batch["g"], batch["us"].astype("int64").tolist(), batch["event_id"],
                     batch[flags].astype(bool).values.tolist(), values.values.tolist())
        for g, own in groupby(events, key=lambda e: e[0]):
            runs, newest = self._load(plan, groups.get(g)), 0
            for _, us, event_id, hits, held in own:
                start = runs.advance(us, hits, held)
                newest = us
                if start is not None:
                    out.append((key[0], g, start, us, event_id))
            groups[g] = (self._until(newest + plan.window, groups.get(g)), *self._state(runs))
        self._hold(groups)
        yield pd.DataFrame(out, columns=HIT_COLUMNS)


def sequence_plan(spec: SequenceSpec) -> Plan:
    gap = lambda s: s.max_gap_seconds * 1_000_000 if s.max_gap_seconds else None
    return Plan(tuple((s.min_count, gap(s), s.optional) for s in spec.steps), spec.window_seconds * 1_000_000,
                tuple(limit for _, limit in spec.constraints))


def sequence_stream(stream: DataFrame, specs: list[SequenceSpec], lateness_seconds: int = LOOKBACK_SECONDS) -> DataFrame:
    """Completed ordered sequences per rule and group as the events arrive."""
    depth, checks = max(len(s.steps) for s in specs), max(len(s.constraints) for s in specs)
    rows = step_rows(stream, specs).select("rule_id", "g", "us", "event_id", "timestamp", *[f"s{k}" for k in range(depth)],
                                           *[f"v{i}" for i in range(checks)])
    return _stateful(rows, SequenceState({s.rule_id: sequence_plan(s) for s in specs}), lateness_seconds)
