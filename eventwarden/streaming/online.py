"""Features and event sequences of a stream, kept as state per user and per address.

For every key the state holds, for the last ``KEEP_DAYS`` days before its newest event:

* per hour, the number of events and of each flag;
* per hour, the instants themselves, of which a batch reads only the hours in which one of its windows
  begins or ends;
* per value whose distinct number is asked for, the first and last sighting in each hour.

So a batch costs what its own keys hold, whatever the table of all events has grown to, and the
measures are exact to the microsecond: they equal those of the batch job over all events so far. What is older
goes when its key is next seen; a key that does not come back has a timer for the watermark, which stands
``KEEP_DAYS`` before the newest ``clock``. The clock is the event time held between that many days ago and now,
so that a row with a wild time is neither dropped nor moves the watermark for all others.

An event that arrives late gets its own past right, but does not change events already scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventwarden import constants as K
from eventwarden.operators.rolling import IP_PLAN, USER_PLAN, RollingPlan
from eventwarden.plans.features import feature_columns, ip_rates, user_rates

KEEP_DAYS = 31
CHUNK = 4096


class Instants:
    """The instants of one hour in ascending order, with running sums of their flags."""

    def __init__(self, us, flags, count: int):
        order = np.argsort(np.asarray(us, dtype=np.int64), kind="stable")
        self.us = np.asarray(us, dtype=np.int64)[order]
        self.flags = np.asarray(flags, dtype=np.int64)[order]
        self.sums = np.zeros((len(self.us) + 1, count + 1), dtype=np.int64)
        self.sums[1:, 0] = np.arange(1, len(self.us) + 1)
        for bit in range(count):
            np.cumsum(self.flags >> bit & 1, out=self.sums[1:, bit + 1])

    def before(self, us: np.ndarray) -> np.ndarray:
        """Numbers of events and flags strictly before each of ``us``."""
        return self.sums[np.searchsorted(self.us, us)]


class KeyHistory:
    """What is known of one key, as plain arrays; the state processor loads and stores them.

    ``totals`` maps an hour to its number of events and flags, ``load`` gives the instants of an hour, and
    ``seen`` maps (what, value) to {hour: (first, last)}.
    """

    def __init__(self, plan: RollingPlan, totals: dict[int, list[int]], load, seen: dict[tuple, dict[int, tuple[int, int]]]):
        self.plan, self.totals, self.load, self.seen = plan, totals, load, seen
        self.flags = sorted({s.value for s in plan.sums if s.value})
        self.hours: dict[int, Instants] = {}

    def instants(self, hour: int) -> Instants:
        if hour not in self.hours:
            us, flags = self.load(hour) if hour in self.totals else ((), ())
            self.hours[hour] = Instants(us, flags, len(self.flags))
        return self.hours[hour]

    def add(self, us: np.ndarray, flags: np.ndarray, values: dict[str, list]) -> tuple[set[int], set[tuple]]:
        """Take events in; returns the hours and values that changed."""
        hours = us // K.HOUR_US
        touched = set(hours.tolist())
        for hour in touched:
            own = hours == hour
            old = self.instants(hour)
            self.hours[hour] = Instants(np.concatenate([old.us, us[own]]), np.concatenate([old.flags, flags[own]]), len(self.flags))
            self.totals[hour] = self.hours[hour].sums[-1].tolist()
        changed = set()
        for what, column in values.items():
            for at, value in zip(us.tolist(), column, strict=True):
                if value is None:
                    continue
                spans = self.seen.setdefault((what, value), {})
                hour = at // K.HOUR_US
                first, last = spans.get(hour, (at, at))
                spans[hour] = (min(first, at), max(last, at))
                changed.add((what, value))
        return touched, changed

    def _before(self, us: np.ndarray) -> np.ndarray:
        """Events and flags strictly before each of ``us``, from the beginning of what is kept."""
        known = np.array(sorted(self.totals), dtype=np.int64)
        sums = np.zeros((len(known) + 1, len(self.flags) + 1), dtype=np.int64)
        if len(known):
            np.cumsum([self.totals[h] for h in known.tolist()], axis=0, out=sums[1:])
        hours = us // K.HOUR_US
        out = sums[np.searchsorted(known, hours)]
        for hour in set(hours.tolist()) & self.totals.keys():
            own = hours == hour
            out[own] += self.instants(hour).before(us[own])
        return out

    def _same_hour(self, us: np.ndarray, width_us: int) -> np.ndarray:
        """Events of the same hour of day in the whole days before each of ``us``."""
        hours, days = us // K.HOUR_US, width_us // K.DAY_US
        out = np.zeros(len(us), dtype=np.int64)
        for hour in set(hours.tolist()):
            own = hours == hour
            whole = sum(self.totals[h][0] for k in range(1, days) if (h := hour - 24 * k) in self.totals)
            edge = self.instants(hour - 24 * days)
            out[own] = (whole + self.instants(hour).before(us[own])[:, 0]
                        + len(edge.us) - edge.before(us[own] - width_us)[:, 0])
        return out

    def _present(self, what: str, width_us: int, us: np.ndarray) -> np.ndarray:
        """How many values of ``what`` were seen in the width before each of ``us``.

        A value is present after its first sighting and until ``width_us`` after its last one, as long as no gap is longer.
        """
        starts, ends = [], []
        for (kind, _), spans in self.seen.items():
            if kind != what:
                continue
            last = None
            for hour in sorted(spans):
                first, then = spans[hour]
                if last is None or first - last > width_us:
                    if last is not None:
                        ends.append(last + width_us)
                    starts.append(first)
                last = then
            if last is not None:
                ends.append(last + width_us)
        return np.searchsorted(np.sort(starts), us) - np.searchsorted(np.sort(ends), us)

    def measures(self, us: np.ndarray) -> dict[str, np.ndarray]:
        """The measures of the plan at each of ``us``."""
        place = {flag: n + 1 for n, flag in enumerate(self.flags)}
        now = self._before(us)
        past = {width: self._before(us - width) for width in {s.width_us for s in self.plan.sums}}
        out = {s.name: (now - past[s.width_us])[:, place.get(s.value, 0)] for s in self.plan.sums}
        out.update({d.name: self._present(d.name, d.width_us, us) for d in self.plan.distincts})
        out.update({h.name: self._same_hour(us, h.width_us) for h in self.plan.hours})
        return out


class KeyedHistory(StatefulProcessor):
    """Adds the measures of a plan to the rows of a key, and keeps its history."""

    def __init__(self, plan: RollingPlan):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "hours array<bigint>, counts array<bigint>")
        self.instants = handle.getMapState("instants", "hour bigint", "us array<bigint>, flags array<bigint>")
        self.seen = handle.getMapState(
            "seen", "what string, value string", "hours array<bigint>, first array<bigint>, last array<bigint>")
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if batch.empty:
            return
        history = self._loaded()
        us = batch["us"].to_numpy(np.int64)
        flags = sum(batch[f].to_numpy(np.int64) << bit for bit, f in enumerate(history.flags)) + np.zeros(len(us), np.int64)
        values = {d.name: [None if pd.isna(v) else str(v) for v in batch[d.column]] for d in self.plan.distincts}
        hours, changed = history.add(us, flags, values)
        measures = history.measures(us)
        self._store(history, hours, changed)
        self._wait_until(int(batch["clock"].max().value // 1_000_000))
        out = batch.assign(**measures)
        for low in range(0, len(out), CHUNK):
            yield out.iloc[low:low + CHUNK]

    def _loaded(self) -> KeyHistory:
        totals: dict[int, list[int]] = {}
        flags = len({s.value for s in self.plan.sums if s.value})
        if self.totals.exists():
            hours, counts = self.totals.get()
            flat = np.reshape(counts, (len(hours), flags + 1)).tolist()
            totals = dict(zip(hours, flat, strict=True))
        seen = {}
        if self.plan.distincts:
            for (what, value), (hours, first, last) in self.seen.iterator():
                seen[what, value] = dict(zip(hours, zip(first, last, strict=True), strict=True))

        def load(hour: int):
            found = self.instants.getValue((hour,))
            return found if found is not None else ((), ())

        return KeyHistory(self.plan, totals, load, seen)

    def _store(self, history: KeyHistory, hours: set[int], changed: set[tuple]) -> None:
        """Write what a batch touched, and drop what is too old."""
        edge = max(history.totals) - 24 * KEEP_DAYS
        old = [h for h in history.totals if h < edge]
        for hour in old:
            del history.totals[hour]
            self.instants.removeKey((hour,))
        for hour in hours:
            if hour >= edge:
                own = history.hours[hour]
                self.instants.updateValue((hour,), (own.us.tolist(), own.flags.tolist()))
        order = sorted(history.totals)
        self.totals.update((order, [int(n) for h in order for n in history.totals[h]]))
        for name, spans in history.seen.items():
            kept = sorted(h for h in spans if h >= edge)
            if not kept:
                self.seen.removeKey(name)
            elif name in changed:
                self.seen.updateValue(name, (kept, [spans[h][0] for h in kept], [spans[h][1] for h in kept]))

    def _wait_until(self, ms: int) -> None:
        """Let the timer of the key ring when the watermark has passed its newest event."""
        if self.timer.exists():
            set_for = self.timer.get()[0]
            if set_for >= ms:
                return
            self.handle.deleteTimer(set_for)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.totals, self.instants, self.seen, self.timer):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_clock(rows: DataFrame, clock: Column | None = None) -> DataFrame:
    """Rows of a stream with the ``clock`` the state runs by, and its watermark."""
    ago = F.current_timestamp() - F.expr(f"INTERVAL {KEEP_DAYS} DAYS")
    held = F.least(F.greatest(F.timestamp_micros("us"), ago), F.current_timestamp()) if clock is None else clock
    return rows.withColumn("clock", held).withWatermark("clock", f"{KEEP_DAYS} days")


def with_online_history(rows: DataFrame, plan: RollingPlan) -> DataFrame:
    """A stream with the measures of ``plan``: what its key did strictly before, earlier rows of the batch included.

    The rows of a key in one micro-batch are worked together, so a batch bounds them; other columns pass as they
    are and must not hold null numbers. Rows need ``us``, ``clock``, the key, and the flags and columns of the plan.
    """
    names = [s.name for s in (*plan.sums, *plan.distincts, *plan.hours)]
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"`{n}` bigint" for n in names])
    return rows.groupBy(plan.key).transformWithStateInPandas(
        statefulProcessor=KeyedHistory(plan), outputStructType=shape, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="clock")


def online_matrix(flagged: DataFrame, digits: int | None = 4) -> DataFrame:
    """Rows of ``with_event_flags`` with a clock, as a stream with the 29 features at the end."""
    by_user = user_rates(with_online_history(flagged, USER_PLAN), digits)
    return feature_columns(ip_rates(with_online_history(by_user, IP_PLAN), digits))


class RecentSteps(StatefulProcessor):
    """The last rows of a user: a list of at most ``length - 1`` steps that the next batch goes on from."""

    def __init__(self, columns: tuple[str, ...], length: int):
        self.columns, self.length = columns, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getListState("steps", "us bigint, event_id bigint, step array<float>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"], kind="stable")
        if batch.empty:
            return
        fresh = batch[list(self.columns)].to_numpy(np.float32)
        known = list(self.steps.get()) if self.steps.exists() else []
        line = [(us, event, list(step), -1) for us, event, step in known]
        line += [(int(us), int(event), fresh[n].tolist(), n)
                 for n, (us, event) in enumerate(zip(batch["us"], batch["event_id"], strict=True))]
        # An old step that is newer than a late row stays behind it.
        line.sort(key=lambda x: x[:2])
        windows: list[list] = [[]] * len(batch)
        for place, (*_, n) in enumerate(line):
            if n >= 0:
                windows[n] = [step for _, _, step, _ in line[max(0, place + 1 - self.length):place + 1]]
        self.steps.put([(us, event, step) for us, event, step, _ in line[max(0, len(line) + 1 - self.length):]])
        for low in range(0, len(batch), CHUNK):
            yield batch.iloc[low:low + CHUNK].assign(window=windows[low:low + CHUNK])

    def close(self) -> None:
        pass


def online_windows(matrix: DataFrame, length: int = K.SEQUENCE_LENGTH) -> DataFrame:
    """A stream of feature rows with ``window``, the last ``length`` feature vectors of their user, itself last.

    Rows are in order of time and event id, also across batches. A row that comes later than ``length`` newer ones
    has only itself and the steps still kept in its window. Event ids must not be null.
    """
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in matrix.schema.fields] + ["window array<array<float>>"])
    found = matrix.groupBy("user").transformWithStateInPandas(
        statefulProcessor=RecentSteps(tuple(K.FEATURE_COLS), length), outputStructType=shape,
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="clock")
    return found.withColumn("seq_active", F.size("window") == length)
