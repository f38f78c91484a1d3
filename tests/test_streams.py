"""Streams by event time: shuffled files, closed windows, blocks, split sessions, replays."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_guard import brute_limit, feed

from alertloom.operators import access
from alertloom.operators.issues import issue_id
from alertloom.streaming import jobs, ordered

MINUTE = 60 * 10**6


def finished(spark, tmp_path, build, batches, schema):
    """The result of a stream over the batches, closed by a heartbeat."""
    stream = feed(spark, tmp_path / "in", batches, schema)
    beats = str(tmp_path / "beats")
    plain = stream.drop("ts")
    both = jobs.with_heartbeats(plain, spark, beats).withColumn("ts", F.timestamp_micros("ts_us"))
    far = 4 * 10**15

    def close():
        spark.range(1).select(*(F.lit(far if f.name == "ts_us" else None).cast(f.dataType).alias(f.name) for f in plain.schema)).write.mode("append").parquet(beats)

    return jobs.run_to_table(build(both), spark, "t", then=close)


def shuffled(rows, parts, spread_us, seed):
    """Batches in which rows of any part are at most ``spread_us`` behind the newest row before them."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, spread_us))
    size = -(-len(late) // parts)
    return [late[i: i + size] for i in range(0, len(late), size)]


def requests(n, seed, ips=("a", "b")):
    rng = random.Random(seed)
    return [(i, rng.choice(ips), 10**12 + rng.randrange(40 * MINUTE // 1000) * 1000) for i in range(n)]


REQUEST = "request_id long, ip string, ts_us long"


def test_limits_do_not_depend_on_the_order_of_files(spark, tmp_path):
    rows = requests(260, 1)
    got = finished(spark, tmp_path, lambda s: jobs.rate_limit_stream(s, limit=5, window_s=60, burst=2, burst_s=10, max_violations=10**6),
                   shuffled(rows, 5, 8 * MINUTE, 2), REQUEST).collect()
    want = {}
    for ip in "ab":
        want |= brute_limit([r for r in rows if r[1] == ip], 5, 60, 2, 10)
    assert {r.request_id: r.verdict == "pass" for r in got} == want and len(got) == len(rows)


def test_a_block_outlives_a_quiet_minute(spark, tmp_path):
    rows = [(i, "a", 10**12 + i * 1000) for i in range(50)] + [(100, "a", 10**12 + 30 * MINUTE), (101, "b", 10**12 + 30 * MINUTE)]
    out = finished(spark, tmp_path, lambda s: jobs.rate_limit_stream(s, limit=5, burst=5, max_violations=3), [rows[:20], rows[20:50], rows[50:]], REQUEST)
    verdicts = [r.verdict for r in out.orderBy("request_id").collect()]
    assert verdicts == ["pass"] * 5 + ["limited"] * 4 + ["blocked"] * 41 + ["blocked", "pass"]


def test_batch_verdicts_equal_the_stream(spark, tmp_path):
    rows = requests(300, 7)
    stream = finished(spark, tmp_path, lambda s: jobs.rate_limit_stream(s, limit=4, window_s=120, burst=2, burst_s=30, max_violations=6), shuffled(rows, 3, MINUTE, 1), REQUEST)
    decided = access.rate_limit(spark.createDataFrame(rows, REQUEST), limit=4, window_s=120, burst=2, burst_s=30, chunk_s=240)
    batch = access.rate_verdicts(decided, max_violations=6)
    columns = ["request_id", "ip", "verdict"]
    assert sorted(map(tuple, batch.select(columns).collect())) == sorted(map(tuple, stream.select(columns).collect()))
    assert {r.verdict for r in batch.collect()} == {"pass", "limited", "blocked"}
    counted = {r.ip: (r.violations, r.blocked) for r in access.violations_per_ip(batch).collect()}
    assert counted == {"a": (7, True), "b": (7, True)}


def test_lockouts_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), 10**12 + rng.randrange(90) * MINUTE) for i in range(120)]
    schema = "event_id long, user_id string, ts_us long"
    out = finished(spark, tmp_path, lambda s: jobs.lockout_stream(s, minutes=15, limit=5), shuffled(rows, 4, 8 * MINUTE, 4), schema)
    batch = access.lockouts(spark.createDataFrame(rows, schema), minutes=15, limit=5)
    want = sorted(map(tuple, batch.select("user_id", "ts_us").collect()))
    assert sorted(map(tuple, out.collect())) == want and len(want) > 5


def plain_parts(times, idle, hours):
    out, start, last, part = [], None, None, 0
    for t in sorted(times):
        if start is None or t - last >= idle:
            start, part = t, 1
            out.append([start, 0, 0, part])
        elif t - start >= hours:
            start, part = t, part + 1
            out.append([start, 0, 0, part])
        last = t
        out[-1][1:3] = [min(last + idle, start + hours), out[-1][2] + 1]
    return [tuple(x) for x in out]


def test_sessions_are_split_at_the_absolute_limit(spark, tmp_path):
    rng = random.Random(6)
    times = [10**12 + MINUTE * x for x in (0, 50, 100, 470, 490, 500)] + [10**13 + MINUTE * 40 * i for i in range(30)]
    rows = [(i, "u", t) for i, t in enumerate(times)] + [(100 + i, "v", 10**13 + rng.randrange(2000) * MINUTE) for i in range(60)]
    out = finished(spark, tmp_path, lambda s: jobs.sessions(s, idle=60, hours=8), shuffled(rows, 3, 30 * MINUTE, 1), "event_id long, user_id string, ts_us long")
    want = [(u, *p) for u in "uv" for p in plain_parts([t for _, x, t in rows if x == u], 60 * MINUTE, 480 * MINUTE)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert max(r.part for r in out.collect()) >= 3


def test_sessions_close_at_the_first_change(spark, tmp_path):
    rows = [(1, "s", 1000, "i1", "m"), (2, "s", 4000, "i2", "m"), (3, "s", 3000, "i1", "curl"), (4, "s", 9000, "i3", "m"), (5, "q", 500, None, "m"), (6, "q", 700, None, "m"), (7, "r", 10, "i", "m")]
    schema = "event_id long, session_id string, ts_us long, ip string, user_agent string"
    out = finished(spark, tmp_path, jobs.consistency_stream, [rows[3:], rows[:3]], schema)
    assert [tuple(r) for r in out.collect()] == [("s", 3000, "user_agent_mismatch")]


def test_last_windows_are_put_out_after_a_heartbeat(spark, tmp_path):
    batches = [[(1, 0)], [(2, 61 * MINUTE), (3, 61 * MINUTE + 5)]]
    out = finished(spark, tmp_path, jobs.minute_counts, batches, "event_id long, ts_us long")
    assert sorted(r.n for r in out.collect()) == [1, 2]


def test_issues_are_added_once(spark, tmp_path):
    kind = "ts timestamp, severity string, title string, summary string, category string"
    row = lambda second, title, summary: (second, "High", title, summary, "security")
    batches = [[row(5, "A", "first words"), row(3, "A", "other words"), row(4, "gone", "x")], [row(1, "A", "late"), row(2, "B", "first words of b"), row(9, "B", "first words of b")], []]
    ignored = spark.createDataFrame([("gone",)], "t string").select(issue_id(F.col("t")).alias("issue_id"))
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    for rows in batches:
        spark.createDataFrame([(second, *rest) for second, *rest in rows], kind.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)
        jobs.issue_upsert(stream(), table, checkpoint, ignored).awaitTermination()
    got = [(r.title, r.summary, r.ts.second) for r in jobs.read_issues(spark, table).orderBy("title").collect()]
    assert got == [("A", "other words", 3), ("B", "first words of b", 2)]
    assert [r.title for r in jobs.read_issues(spark, table, cap=1).collect()] == ["A"]
    # a crash between the write of a batch and its commit: the batch runs once more
    commits = [p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.strip(".").removesuffix(".crc") == "1"]
    assert commits
    for path in commits + [p for p in (tmp_path / "cp" / "commits").iterdir() if p.name.strip(".").removesuffix(".crc") == "2"]:
        path.unlink()
    jobs.issue_upsert(stream(), table, checkpoint, ignored).awaitTermination()
    assert sorted(r.title for r in jobs.read_issues(spark, table).collect()) == ["A", "B"]


@pytest.mark.parametrize("rows, now, wake", [([], 10, None), ([(100, 1)], 150, 160)])
def test_limiter_forgets_quiet_addresses(rows, now, wake):
    step = ordered.limiter(2, 60, 2, 10, 5)
    out, known, at = step("ip", None, rows, now)
    assert at == wake and (known is None) == (not rows)
    assert step("ip", known, [], 10**6)[1:] == (None, None)
    blocked = step("ip", ([], 9), [(10, 1)], 20)
    assert blocked[0][0][3] == "blocked" and blocked[1] == ([], 9) and blocked[2] is None


class Cells(dict):
    """Map or value state of one group, in memory."""

    calls = 0

    def exists(self):
        return bool(len(self))

    def get(self, key="value"):
        return dict.get(self, key)

    getValue = get
    removeKey = dict.pop

    def keys(self):
        return iter(list(super().keys()))

    def update(self, value):
        self["value"] = value

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value


class Clock:
    """Handle and timer values of a processor."""

    def __init__(self):
        self.states, self.timers, self.now = {}, set(), 0

    def getMapState(self, name, *kinds):
        return self.states.setdefault(name, Cells())

    getValueState = getMapState
    registerTimer = property(lambda self: self.timers.add)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_rows_of_a_group_come_in_order_and_in_parts(monkeypatch):
    monkeypatch.setattr(ordered, "PAGE", 10)
    monkeypatch.setattr(ordered, "CHUNK", 50)
    monkeypatch.setattr(ordered, "HELD", 5)
    rng, seen, clock = random.Random(5), [], Clock()

    def step(key, known, rows, now):
        seen.append(len(rows))
        assert all(r[0] <= now for r in rows)
        count, last = known or (0, -1)
        assert not rows or rows[0][0] > last  # a moment is never cut
        last = rows[-1][0] if rows else last
        return [(key, *r) for r in rows], None if last + 40_000 <= now else (count + len(rows), last), last + 40_000

    schema = pa.schema([("t", pa.int64()), ("id", pa.int64()), ("key", pa.string()), ("wake_", pa.bool_())])
    work = ordered.InOrder(step, schema, "string", "n bigint, last bigint", ["key", "t", "id"])
    work.init(clock)
    rows = [(1000 * rng.randrange(300), i, rng.choice(["hot"] * 9 + list("abcdefgh")), False) for i in range(2000)]
    got = []
    for part, until in ((rows, 100), (rows[:0], 200), ([(250_500, 9000, "late", False)], 10**6)):
        if part:
            list(work.handleInputRows((1,), iter([pd.DataFrame(part[i: i + 30], columns=schema.names) for i in range(0, len(part), 30)]), clock))
        clock.now = until
        while any(t <= until for t in clock.timers):
            clock.timers.discard(min(clock.timers))
            got += [tuple(r) for frame in work.handleExpiredTimer((1,), clock, None) for r in frame.itertuples(index=False)]
    want = sorted([(k, t, i) for t, i, k, _ in rows] + [("late", 250_500, 9000)])
    assert sorted(got) == want
    for key in {k for _, _, k, _ in rows}:
        assert [r for r in got if r[0] == key] == [r for r in want if r[0] == key]
    # pages of several runs may overlap, so a part can be larger than CHUNK but stays far below the rows of the key
    assert max(seen) < 500 < sum(k == "hot" for _, _, k, _ in rows)
    assert not clock.states["known"] and not clock.states["waiting"]


def test_a_session_forgotten_after_a_pause_begins_anew():
    step = ordered.consistency(100)
    out, _, _ = step("s", None, [(1, 1, "a", "m"), (101, 2, "b", "m"), (150, 3, "c", "m")], 160)
    assert out == [("s", 150, "ip_mismatch")]
