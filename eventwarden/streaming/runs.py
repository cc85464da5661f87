"""Open runs of an ordered rule, advanced event by event.

A run is what the batch operator finds from one anchor, read over the events seen so far: per step how many events it has
collected, when its first came, and when it was complete. An event goes to the first step that still collects, matches
and lies within its gap; steps after that one begin again, because they look behind it. A skipped optional step still
collects until its gap is over, so a run may fall back, exactly as the batch operator would decide over the longer feed.

For constraints a run keeps, per step, the earliest distinct values of each checked field with the time each was first
seen, no more than the limit asks for: a value counts if it came before the next matched step began.

Runs that can no longer decide anything are dropped: of runs at the same place, a later anchor meets every window and gap
that an earlier one meets, so an earlier one stays only while it can count values that the later ones may lack
(``_covered``). Their number is bounded by the rule's steps, counts and limits, not by a group's events; only while the
gap of a skipped optional step is open, runs whose gap ends at different times are all kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Plan:
    """Per step (needed events, gap or None, optional); the window; per checked field the distinct values it needs."""

    steps: tuple[tuple[int, int | None, bool], ...]
    window: int
    limits: tuple[int, ...] = ()

    @property
    def loose(self) -> bool:
        return any(optional for _, _, optional in self.steps)


@dataclass
class Run:
    """One anchor's progress; ``seen`` and ``own`` map (step, check) to values with their first time."""

    anchor: int
    counts: list[int]
    first: list[int]
    ends: list[int]
    seen: dict = field(default_factory=dict)
    own: dict = field(default_factory=dict)

    def begun_after(self, step: int) -> int | None:
        """When the next step with events began."""
        return next((self.first[k] for k in range(step + 1, len(self.counts)) if self.counts[k]), None)


class Runs:
    """The runs of one rule and group."""

    def __init__(self, plan: Plan, runs: list[Run] | None = None, quiet: int = -1, ties: list | None = None):
        self.plan = plan
        self.open = runs or []
        self.quiet = quiet
        # values at the newest time, as (time, step, check, value): a step claims events of its first event's time
        self.ties = ties or []

    def advance(self, us: int, hits: list[bool], values: list) -> int | None:
        """Take one event, in time order; the anchor of a run that it completes, or None."""
        self.ties = [t for t in self.ties if t[0] == us]
        self.open = [r for r in self.open if us - r.anchor <= self.plan.window]
        if hits[0]:
            n = len(self.plan.steps)
            self.open.append(Run(us, [0] * n, [0] * n, [0] * n))
        done = None
        for run in self.open:
            self._take(run, us, hits, values)
            if self._complete(run) and (done is None or run.anchor < done):
                done = run.anchor
        for step, hit in enumerate(hits):
            for check, value in enumerate(values):
                tie = (us, step, check, value)
                if hit and value is not None and tie not in self.ties and sum(
                        t[1:3] == (step, check) for t in self.ties) < self.plan.limits[check]:
                    self.ties.append(tie)
        if done is not None and us > self.quiet:
            self.quiet, self.open = us, []
            return done
        self._thin(us)
        return None

    def _take(self, run: Run, us: int, hits: list[bool], values: list) -> None:
        previous = run.anchor
        for step, (need, gap, optional) in enumerate(self.plan.steps):
            if run.counts[step] == need:
                previous = run.ends[step]
                continue
            if hits[step] and (gap is None or us - previous <= gap):
                self._collect(run, step, us, values)
                break
            if not optional:
                break
        for step, hit in enumerate(hits):
            if hit and run.counts[step] and (self.plan.loose or run.begun_after(step) is None):
                self._note(run.seen, step, us, values)

    def _collect(self, run: Run, step: int, us: int, values: list) -> None:
        if not run.counts[step]:
            run.first[step] = us
            for _, at, check, value in self.ties:
                if at == step:
                    run.seen.setdefault((step, check), {}).setdefault(value, us)
        run.counts[step] += 1
        run.ends[step] = us
        self._note(run.own, step, us, values)
        for later in range(step + 1, len(run.counts)):
            run.counts[later] = 0
            for check in range(len(values)):
                run.seen.pop((later, check), None)
                run.own.pop((later, check), None)

    def _note(self, held: dict, step: int, us: int, values: list) -> None:
        for check, value in enumerate(values):
            if value is not None:
                known = held.setdefault((step, check), {})
                if len(known) < self.plan.limits[check]:
                    known.setdefault(value, us)

    def _complete(self, run: Run) -> bool:
        matched = [k for k, (need, _, _) in enumerate(self.plan.steps) if run.counts[k] == need]
        if not matched or any(run.counts[k] < need for k, (need, _, optional) in enumerate(self.plan.steps) if not optional):
            return False
        for check, limit in enumerate(self.plan.limits):
            found: set = set()
            for step, after in zip(matched, [*matched[1:], None]):
                until = run.ends[step] if after is None else run.first[after] - 1
                held = run.own if until < run.first[step] else run.seen
                found |= {v for v, at in held.get((step, check), {}).items() if held is run.own or at <= until}
            if len(found) < limit:
                return False
        return True

    # ---- what may be dropped ---------------------------------------------------------------------
    def _thin(self, us: int) -> None:
        places: dict[tuple, list[Run]] = {}
        for run in sorted(self.open, key=lambda r: r.anchor, reverse=True):
            if not self._over(run, us):
                places.setdefault(tuple(run.counts), []).append(run)
        self.open = []
        for runs in places.values():
            kept: list[Run] = []
            for run in runs:
                if not self._covered(run, kept, us):
                    kept.append(run)
            if not self.plan.limits and kept[-1] is not runs[-1]:
                kept.append(runs[-1])  # the earliest anchor, to report a start
            self.open += kept

    def _over(self, run: Run, us: int) -> bool:
        """Complete in every step and past the time it may still claim: it failed its constraints for good."""
        return all(run.counts[k] == need for k, (need, _, _) in enumerate(self.plan.steps)) and us > max(run.ends)

    def _sure(self, run: Run, us: int, check: int, step: int | None = None) -> set:
        """Values that count for certain, whatever comes."""
        found = set()
        for (k, c), held in run.seen.items():
            if c == check and step in (None, k):
                begun = run.begun_after(k)
                bound = us if begun is None else begun
                found |= {v for v, at in held.items() if at < bound}
        return found

    def _ahead(self, later: Run, run: Run, us: int) -> bool:
        """Whether a run at the same place with a later anchor is at least as far for good.

        More room for a required step only helps. More room for an optional one may not: its event begins the steps
        after it again. Both must have the same room there, or none.
        """
        now, then = run.anchor, later.anchor
        for (need, gap, optional), count, end, later_end in zip(self.plan.steps, run.counts, run.ends, later.ends):
            if count == need:
                if later_end < end:
                    return False
                now, then = end, later_end
            elif not optional:
                return True
            elif gap is not None and now != then and us - then <= gap:
                return False
        return True

    def _covered(self, run: Run, later: list[Run], us: int) -> bool:
        ahead = [b for b in later if self._ahead(b, run, us)]
        if not self.plan.limits:
            return bool(ahead)
        if self.plan.loose:
            # a step may begin again: every step's values must be covered by themselves
            return any(all(set(held) <= self._sure(b, us, c, k) for (k, c), held in run.seen.items()) for b in ahead)
        mine = [{v for (_, c), held in run.seen.items() if c == check for v in held} for check in range(len(self.plan.limits))]
        sure = [[self._sure(b, us, check) for check in range(len(mine))] for b in ahead]
        if any(all(len(s) >= limit or m <= s for m, s, limit in zip(mine, theirs, self.plan.limits)) for theirs in sure):
            return True
        if len(mine) > 1 or len(mine[0]) >= self.plan.limits[0]:
            return False
        # values to come that let this run pass number ``limit - len(mine)``; they cannot all be repeats for each of
        # more runs than that, if these have nothing in common beyond this run's values
        spare: set = set()
        apart = 0
        for theirs in sure:
            extra = theirs[0] - mine[0]
            if len(theirs[0]) >= len(mine[0]) and not extra & spare:
                spare |= extra
                apart += 1
        return apart > self.plan.limits[0] - len(mine[0])
