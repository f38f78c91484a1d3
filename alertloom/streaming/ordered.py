"""Keyed state that sees its rows in event time, whatever the order of files and batches.

Rows wait in state until the watermark has passed them. A timer then hands them on in the
order of (event time, id), so a result depends on the rows only and equals that of a
batch job. A step gets a key's known state, its due rows and the time up to which all rows
have come, and says what to put out, what to remember and when to wake it next; that is
also how idle state ends. State lies in RocksDB, so the keys of an executor need not fit
its memory.

Keys are dealt to SHARDS groups, because a call into state costs far more than a row. The
waiting rows of a group are sorted pages of at most PAGE rows. A timer opens them by their
first times, about CHUNK rows at once, and puts out what is due before it opens more: the
memory of a task depends neither on the rows of a key nor on those of a batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: step(key, known state or None, due rows, time in us up to which all rows are known) -> (rows out, new state or None, wake time in us or None)
Step = Callable[[Any, tuple | None, list[tuple], int], tuple[list[tuple], tuple | None, int | None]]

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: groups of keys; rows of a stored page, rows that are sorted or handed on at once, known states held by a task
SHARDS, PAGE, CHUNK, HELD = 256, 2000, 50_000, 50_000


class InOrder(StatefulProcessor):
    """Hands the rows of each key of a group to ``step`` in event time.

    ``schema`` (Arrow): the event time, the id, further columns, the key, and ``wake_``, which marks rows that only wake their key.
    """

    def __init__(self, step: Step, schema: pa.Schema, key_type: str, known: str, out: list[str]):
        self.step, self.schema, self.key_type, self.known_schema, self.out = step, schema, key_type, known, out
        self.ts, self.id, self.key = schema.names[0], schema.names[1], schema.names[-2]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, page bigint", "data binary")
        self.known = handle.getMapState("known", f"key {self.key_type}", f"{self.known_schema}, wake_us bigint")
        self.pages = handle.getValueState("pages", "n bigint")

    # --- waiting rows ---

    def _put(self, rows: pa.Table) -> int | None:
        """Stores rows as pages of sorted times; gives the first time."""
        if not rows.num_rows:
            return None
        rows = rows.sort_by(self.ts).combine_chunks()
        n = self.pages.get()[0] if self.pages.exists() else 0
        for low in range(0, rows.num_rows, PAGE):
            part, sink = rows.slice(low, PAGE), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as writer:
                writer.write_table(part)
            self.waiting.updateValue((part[self.ts][0].as_py(), n), (sink.getvalue().to_pybytes(),))
            n += 1
        self.pages.update((n,))
        return rows[self.ts][0].as_py()

    def _take(self, page: tuple) -> pa.Table:
        """The rows of a page, which is no longer stored."""
        data = bytes(self.waiting.getValue(page)[0])
        self.waiting.removeKey(page)
        return pa.ipc.open_stream(data).read_all()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts, held, n = [], [], 0
        for frame in rows:
            held.append(pa.Table.from_pandas(frame[self.schema.names], self.schema, preserve_index=False))
            n += len(frame)
            if n >= CHUNK:
                firsts.append(self._put(pa.concat_tables(held)))
                held, n = [], 0
        if n:
            firsts.append(self._put(pa.concat_tables(held)))
        if firsts:
            self._wake(min(firsts), timerValues)
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        pages = sorted(tuple(p) for p in self.waiting.keys()) if self.waiting.exists() else []
        keys, rest, at = _Keys(self.step, self.known), self.schema.empty_table(), 0
        while at < len(pages) and pages[at][0] <= now:
            parts, n = [rest], 0
            while at < len(pages) and pages[at][0] <= now and n < CHUNK:
                parts.append(self._take(pages[at]))
                n += parts[-1].num_rows
                at += 1
            # rows before the first time of the next page are all here
            until = min(now, pages[at][0] - 1) if at < len(pages) else now
            rows = pa.concat_tables(parts)
            due = pc.less_equal(rows[self.ts], until)
            out = keys.advance(*self._by_key(rows.filter(due)), until)
            rest = rows.filter(pc.invert(due))
            if out:
                yield pd.DataFrame(out, columns=self.out)
        wakes = keys.close()
        empty = [None] * len(wakes)
        marks = {self.ts: [w for w, _ in wakes], self.key: [k for _, k in wakes], "wake_": [True] * len(wakes)}
        left = pa.table([pa.array(marks.get(f.name, empty), f.type) for f in self.schema], schema=self.schema)
        times = [self._put(pa.concat_tables([rest, left]))] + [first for first, _ in pages[at:at + 1]]
        if any(t is not None for t in times):
            self._wake(min(t for t in times if t is not None), timerValues)

    def _by_key(self, rows: pa.Table) -> tuple[dict[Any, list[tuple]], list[tuple[int, Any]]]:
        """Rows of each key in order, and (time, key) of those that only wake their key."""
        wakes = rows.filter(pc.equal(rows["wake_"], True))
        found: dict[Any, list[tuple]] = {}
        real = rows.filter(pc.equal(rows["wake_"], False)).sort_by([(self.ts, "ascending"), (self.id, "ascending")])
        names = self.schema.names[:-2]
        for key, row in zip(real[self.key].to_pylist(), zip(*(real[c].to_pylist() for c in names), strict=True), strict=True):
            found.setdefault(key, []).append(row)
        return found, list(zip(wakes[self.ts].to_pylist(), wakes[self.key].to_pylist(), strict=True))

    def _wake(self, at_us: int, timerValues) -> None:
        self.handle.registerTimer(max(-(-at_us // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class _Keys:
    """Known states of the keys of a group while a timer runs."""

    def __init__(self, step: Step, known):
        self.step, self.known = step, known
        self.any = known.exists()
        #: by key: state, wake time, whether the key is stored
        self.held: dict[Any, tuple[tuple | None, int | None, bool]] = {}
        #: wakes that no waiting row marks; one whose key has another wake time by then is void
        self.agenda: list[tuple[int, int, Any]] = []
        self.turn = 0

    def _load(self, key) -> tuple[tuple | None, int | None, bool]:
        if key in self.held:
            return self.held[key]
        row = self.known.getValue((key,)) if self.any else None
        return (None, None, False) if row is None else (tuple(row)[:-1], row[-1], True)

    def _run(self, key, rows: list[tuple], until: int, out: list[tuple]) -> None:
        known, _, stored = self._load(key)
        more, known, wake = self.step(key, known, rows, until)
        out += more
        if known is None:
            self.held.pop(key, None)
            if stored:
                self.known.removeKey((key,))
            return
        self.held[key] = (known, wake, stored)
        if wake is not None:
            self.turn += 1
            heapq.heappush(self.agenda, (wake, self.turn, key))

    def _rouse(self, at: int, key, until: int, out: list[tuple]) -> None:
        known, wake, _ = self._load(key)
        if known is not None and wake == at:
            self._run(key, [], until, out)

    def advance(self, rows: dict[Any, list[tuple]], wakes: list[tuple[int, Any]], until: int) -> list[tuple]:
        """What the keys with rows put out, and those that are to wake by ``until``."""
        out: list[tuple] = []
        for key, due in rows.items():
            self._run(key, due, until, out)
        for at, key in wakes:
            self._rouse(at, key, until, out)
        while self.agenda and self.agenda[0][0] <= until:
            at, _, key = heapq.heappop(self.agenda)
            self._rouse(at, key, until, out)
        if len(self.held) > HELD:
            self._store()
        return out

    def _store(self) -> None:
        for key, (known, wake, _) in self.held.items():
            self.known.updateValue((key,), (*known, wake))
            self.any = True
        self.held = {}

    def close(self) -> list[tuple[int, Any]]:
        """Stores the states; gives (time, key) of the wakes to come."""
        self._store()
        return [(at, key) for at, _, key in self.agenda]


def in_order(rows: DataFrame, key: str, names: list[str], known: str, out: list[tuple[str, str]], step: Step, delay: str, ts: str = "ts") -> DataFrame:
    """``step`` over the rows of every key; ``names`` starts with the event time in microseconds and an id that breaks ties."""
    # rows without a key have a group of their own, as heartbeats have
    shard = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), SHARDS)).cast("int").alias("shard_")
    picked = rows.withWatermark(ts, delay).select(shard, ts, *names, key, F.lit(False).alias("wake_"))
    schema = to_arrow_schema(picked.select(*names, key, "wake_").schema)
    schema = pa.schema([f.with_nullable(True) for f in schema])
    processor = InOrder(step, schema, dict(rows.dtypes)[key], known, [n for n, _ in out])
    return picked.groupBy("shard_").transformWithStateInPandas(
        processor, outputStructType=", ".join(f"{n} {kind}" for n, kind in out), outputMode="Append", timeMode="EventTime")


# --- steps ---------------------------------------------------------------------------------

def limiter(limit: int, window_us: int, burst: int, burst_us: int, max_violations: int) -> Step:
    """Verdict per request: accepted times of the window and all violations are remembered; rows are (ts_us, request_id)."""
    def step(key, known, rows, now):
        times, violations = (list(known[0]), known[1]) if known else ([], 0)
        out = []
        for ts, request in rows:
            times = [t for t in times if t > ts - window_us]
            blocked = violations > max_violations
            passed = not blocked and len(times) < limit and sum(t > ts - burst_us for t in times) < burst
            if passed:
                times.append(ts)
            elif not blocked:
                violations += 1
            out.append((request, key, ts, "pass" if passed else "blocked" if blocked else "limited", violations))
        times = [int(t) for t in times if t > now - window_us]
        # violations are kept for good, as a block has no end; an ip without any is forgotten after a quiet window
        return out, (times, int(violations)) if times or violations else None, times[0] + window_us if times and not violations else None
    return step


def lockout(width_us: int, limit: int) -> Step:
    """(key, moment) whenever the failures of the last ``width_us`` reach the limit; equal times are one moment."""
    def step(key, known, rows, now):
        times, out = list(known[0]) if known else [], []
        for i, (ts, _) in enumerate(rows):
            # of equal or older times no more than ``limit`` can matter
            times = [*(t for t in times if t > ts - width_us), ts][-limit:]
            if len(times) >= limit and (i + 1 == len(rows) or rows[i + 1][0] > ts):
                out.append((key, ts))
        times = [int(t) for t in times if t > now - width_us]
        return out, (times,) if times else None, times[-1] + width_us if times else None
    return step


def session_parts(idle_us: int, hours_us: int) -> Step:
    """One row per part of a session: a pause of the idle limit ends it, the absolute limit begins its next part."""
    def step(key, known, rows, now):
        start, last, events, part = known if known else (None, None, 0, 0)
        out = []

        def close():
            if events:
                out.append((key, start, min(last + idle_us, start + hours_us), events, part))

        for ts, _ in rows:
            if start is None or ts - last >= idle_us:
                close()
                start, events, part = ts, 0, 1
            elif ts - start >= hours_us:
                close()
                start, events, part = ts, 0, part + 1
            last, events = ts, events + 1
        if start is None:
            return out, None, None
        if events and min(last + idle_us, start + hours_us) <= now:
            close()
            events = 0
        if last + idle_us <= now:
            return out, None, None
        wake = min(last + idle_us, start + hours_us) if events else last + idle_us
        return out, (int(start), int(last), int(events), int(part)), wake
    return step


def consistency(keep_us: int) -> Step:
    """The first change of address or agent of a session; rows are (ts_us, event_id, ip, user_agent)."""
    def step(key, known, rows, now):
        ip, agent, closed, last = known if known else (None, None, None, None)
        out = []
        for ts, _, own_ip, own_agent in rows:
            if closed is None or ts - last >= keep_us:
                ip, agent, closed = own_ip, own_agent, False
            elif not closed and (own_ip != ip or own_agent != agent):
                out.append((key, ts, "ip_mismatch" if own_ip != ip else "user_agent_mismatch"))
                closed = True
            last = ts
        if last is None or last + keep_us <= now:
            return out, None, None
        return out, (ip, agent, bool(closed), int(last)), last + keep_us
    return step
