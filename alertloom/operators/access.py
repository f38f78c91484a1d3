"""Requests, sessions, rates and permissions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from alertloom import config
from alertloom.functions.matching import contains_any
from alertloom.operators.patterns import top_per_group
from alertloom.session import cut_lineage


# --- rates ---------------------------------------------------------------------------

def trailing_counts(events: DataFrame, keys: list[str], seconds: int, ts_us: str = "ts_us", inclusive: bool = True) -> DataFrame:
    """Events of a key in the trailing window at each of its event times.

    A window over the key alone would sort a hot key in one task. Equal times
    are summed first; then time is cut into buckets as long as the window and
    every bucket also gets the rows of the one before it. The partition key is
    (key, bucket), the result is exact.
    """
    return _trailing(events.groupBy(*keys, ts_us).agg(F.count("*").alias("here")), keys, seconds, ts_us, inclusive)


def _trailing(summed: DataFrame, keys: list[str], seconds: int, ts_us: str, inclusive: bool) -> DataFrame:
    """The same from the number of events (``here``) at each time of a key."""
    width = seconds * 1_000_000
    bucket = F.floor(F.col(ts_us) / width)
    doubled = summed.select("*", F.explode(F.array(
        F.struct(bucket.alias("bucket"), F.lit(True).alias("own")),
        F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))).alias("b")).select(*keys, ts_us, "here", "b.*")
    reach = Window.partitionBy(*keys, "bucket").orderBy(ts_us).rangeBetween(-width if inclusive else 1 - width, 0)
    return doubled.withColumn("n", F.sum("here").over(reach)).where("own").select(*keys, ts_us, "n")


def rate_anomalies(events: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Moments at which a kind of event reaches its limit within its window.

    ``events``: kind, ts_us. Kinds without a limit are left out. The events are
    read and shuffled once; the windows of all kinds read the counts by time.
    """
    wanted = limits or config.RATE_LIMITS
    summed = cut_lineage(events.where(F.col("kind").isin(list(wanted))).groupBy("kind", "ts_us").agg(F.count("*").alias("here")), "rates")
    parts = []
    for kind, (seconds, limit) in wanted.items():
        counted = _trailing(summed.where(F.col("kind") == kind), ["kind"], seconds, "ts_us", True)
        parts.append(counted.where(F.col("n") >= limit).withColumn("limit", F.lit(limit)).withColumn("seconds", F.lit(seconds)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lockouts(failures: DataFrame, key: str = "user_id", minutes: int = config.LOCKOUT_MINUTES,
             limit: int = config.LOCKOUT_FAILURES) -> DataFrame:
    """Moments at which a user has too many failures in the trailing minutes."""
    return trailing_counts(failures, [key], minutes * 60, inclusive=False).where(F.col("n") >= limit)


#: chunks that a repeated run of ``rate_limit`` takes along at most
STRETCH = 32


def _limiter(limit: int, window_us: int, burst: int, burst_us: int):
    """Sequential acceptance over rows sorted by key, stretch and time; state is bounded by the limit.

    Python steps follow the accepted requests, not all of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque(maxlen=max(limit, burst, 1))
        for batch in batches:
            ip, chunk, ts = (batch[c].to_numpy() for c in ("ip", "stretch", "ts_us"))
            passed = np.zeros(len(batch), dtype=bool)
            edges = np.flatnonzero((ip[1:] != ip[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for low, high in zip([0, *edges], [*edges, len(batch)]):
                if low == high or limit < 1 or burst < 1:
                    continue
                if (ip[low], chunk[low]) != current:
                    current = (ip[low], chunk[low])
                    accepted.clear()
                    carry = batch["carry"].iloc[low]
                    accepted.extend(carry if carry is not None else ())
                i = low
                while i < high:
                    # the first time at which both windows have room again; all before it is rejected at once
                    ready = max(accepted[-limit] + window_us if len(accepted) >= limit else ts[i],
                                accepted[-burst] + burst_us if len(accepted) >= burst else ts[i])
                    if ts[i] < ready:
                        i = low + int(np.searchsorted(ts[low:high], ready))
                        continue
                    passed[i] = True
                    accepted.append(int(ts[i]))
                    i += 1
            yield batch[["request_id", "ip", "chunk", "ts_us"]].assign(accepted=passed)

    return run


def rate_limit(requests: DataFrame, limit: int = config.REQUESTS_PER_MINUTE, window_s: int = 60, burst: int = config.BURST_LIMIT,
               burst_s: int = config.BURST_SECONDS, chunk_s: int = 3600, whitelist: list[str] | None = None) -> DataFrame:
    """Accepted or rejected per request (request_id, ip, ts_us), in time order per ip.

    A request passes when fewer than ``limit`` were accepted in the window and
    fewer than ``burst`` in the short window; rejected requests do not count.
    Acceptance depends on earlier decisions, so an ip is a sequence. It is cut
    into chunks that run in parallel from an empty window; a chunk whose
    predecessor ends with accepted requests is run again with them, until no
    carried window changes. Under steady load every chunk depends on the one
    before, so a repeated chunk takes along those behind it in its stretch of
    ``STRETCH`` chunks. The result is that of one pass, without holding an
    ip in one task; a task holds at most ``limit`` times.
    """
    if chunk_s < window_s:
        raise ValueError("a chunk must be at least as long as the window")
    window_us, chunk_us = window_s * 1_000_000, chunk_s * 1_000_000
    rows = requests.select("request_id", "ip", "ts_us", F.floor(F.col("ts_us") / chunk_us).alias("chunk"))
    listed = F.coalesce(F.col("ip").isin(whitelist or []), F.lit(False))  # a null ip is an address like any other
    free = rows.where(listed).select("request_id", "ip", "ts_us", F.lit(True).alias("accepted"))
    rows = rows.where(~listed)
    key = ["ip", "chunk"]
    kinds = dict(requests.dtypes)
    shape = f"request_id {kinds['request_id']}, ip {kinds['ip']}, chunk bigint, ts_us bigint, accepted boolean"
    step = _limiter(limit, window_us, burst, burst_s * 1_000_000)

    def decide(part: DataFrame, stretch: Column) -> DataFrame:
        part = part.withColumn("stretch", stretch)
        ordered = part.repartition("ip", "stretch").sortWithinPartitions("ip", "stretch", "ts_us", "request_id")
        return cut_lineage(ordered.mapInPandas(step, shape), "rate")

    def tails(decided: DataFrame) -> DataFrame:
        # at most `limit` accepted times fit in one window
        late = decided.where(F.col("accepted") & (F.col("ts_us") > (F.col("chunk") + 1) * chunk_us - window_us))
        return late.groupBy("ip", (F.col("chunk") + 1).alias("chunk")).agg(F.sort_array(F.collect_list("ts_us")).alias("carry"))

    first = decide(rows.withColumn("carry", F.array().cast("array<bigint>")), F.col("chunk"))
    rounds, stretch_of = [first], F.floor(F.col("chunk") / STRETCH)
    chunks = cut_lineage(first.select(*key).distinct(), "rate")
    latest = chunks.withColumn("round", F.lit(0))
    carried = cut_lineage(tails(first).join(chunks, key, "left_semi"), "rate")
    used = chunks.select(*key, F.array().cast("array<bigint>").alias("was")).where("false")
    while True:
        both = carried.join(used, key, "full_outer")
        empty = F.array().cast("array<bigint>")
        changed = cut_lineage(both.where(F.coalesce("carry", empty) != F.coalesce("was", empty)).select(
            *key, F.coalesce("carry", empty).alias("carry")), "rate")
        if changed.isEmpty():
            break
        starts = changed.groupBy("ip", stretch_of.alias("stretch")).agg(F.min("chunk").alias("start"), F.min_by("carry", "chunk").alias("carry"))
        behind = lambda part: part.withColumn("stretch", stretch_of).join(starts, ["ip", "stretch"]).where(F.col("chunk") >= F.col("start"))
        again = decide(behind(rows), stretch_of)
        run = cut_lineage(behind(chunks).select(*key), "rate")
        latest = latest.unionByName(run.withColumn("round", F.lit(len(rounds))))
        rounds.append(again)
        touched = run.select("ip", (F.col("chunk") + 1).alias("chunk"))
        carried = cut_lineage(carried.join(touched, key, "left_anti").unionByName(tails(again).join(chunks, key, "left_semi")), "rate")
        # the first chunk of a run began with what had been carried to it, the others with what this run carried to them
        began = starts.select("ip", F.col("start").alias("chunk"), F.col("carry").alias("was"))
        along = carried.join(run, key, "left_semi").join(began, key, "left_anti").withColumnRenamed("carry", "was")
        used = cut_lineage(used.join(run, key, "left_anti").unionByName(began).unionByName(along), "rate")
    tagged = None
    for i, part in enumerate(rounds):
        part = part.withColumn("round", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    final = tagged
    if len(rounds) > 1:
        final = tagged.join(latest.groupBy(*key).agg(F.max("round").alias("round")), [*key, "round"])
    return final.select("request_id", "ip", "ts_us", "accepted").unionByName(free)


def rate_verdicts(decided: DataFrame, max_violations: int = config.MAX_VIOLATIONS) -> DataFrame:
    """``decided`` (the result of ``rate_limit``) with a verdict: pass, limited, or blocked.

    A rejected request is a violation; after ``max_violations`` + 1 of them an ip is
    blocked for good and what it sends is neither counted nor accepted. Only that
    violation is looked for, by a rank with a limit, and met by a join with one row per ip.
    """
    last = top_per_group(decided.where(~F.col("accepted")).select("ip", "ts_us", "request_id"), ["ip"], [F.col("ts_us"), F.col("request_id")], max_violations + 1)
    ends = last.groupBy("ip").agg(F.count("*").alias("n"), F.max(F.struct("ts_us", "request_id")).alias("end")).where(F.col("n") > max_violations)
    here = F.struct("ts_us", "request_id")
    joined = decided.join(ends.select(F.col("ip").alias("blocked_ip"), "end"), F.col("ip").eqNullSafe(F.col("blocked_ip")), "left")
    verdict = F.when(F.col("end").isNotNull() & (here > F.col("end")), "blocked").when(F.col("accepted"), "pass").otherwise("limited")
    return joined.withColumn("verdict", verdict).drop("blocked_ip", "end")


def violations_per_ip(verdicts: DataFrame) -> DataFrame:
    """``ip, requests, violations, blocked`` of judged requests, for block lists and statistics."""
    return verdicts.groupBy("ip").agg(F.count("*").alias("requests"), F.count_if(F.col("verdict") == "limited").alias("violations"),
                                      (F.count_if(F.col("verdict") == "blocked") > 0).alias("blocked"))


# --- requests --------------------------------------------------------------------------

def request_flags(requests: DataFrame, blocked: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """First failing check per request, and the slow and error flags."""
    agent = F.lower("user_agent")
    first = F.coalesce(
        F.when(F.col("ip").isin(blocked or []), "ip_blocked"),
        F.when(F.col("length") > config.MAX_REQUEST_BYTES, "request_too_large"),
        F.when(contains_any(agent, config.SCANNER_AGENTS), "suspicious_user_agent"),
        F.when(F.col("path").contains("../") | F.col("path").contains("..\\"), "path_traversal_attempt"),
        F.when(~F.col("method").isin(methods), "method_not_allowed") if methods else F.lit(None).cast("string"),
        F.lit("ok"))
    return requests.select("*", first.alias("verdict"), (F.col("duration") > config.SLOW_SECONDS).alias("slow"),
                           (F.col("status") >= 400).alias("failed"))


def with_rates(flagged: DataFrame, rated: DataFrame) -> DataFrame:
    """Flagged requests with the verdict of their address's rate limit (``request_id, verdict`` from ``rate_verdicts``).

    Adds ``limited``; requests of an address that has been blocked are blocked whatever else they are.
    """
    rate = rated.select("request_id", F.col("verdict").alias("rate"))
    return flagged.join(rate, "request_id").withColumn("limited", F.col("rate") == "limited").withColumn(
        "verdict", F.when(F.col("rate") == "blocked", "ip_blocked").otherwise(F.col("verdict"))).drop("rate")


def ip_verdicts(requests: DataFrame, blocked: DataFrame, allowed: DataFrame | None = None,
                max_violations: int = config.MAX_VIOLATIONS) -> DataFrame:
    """Requests, violations and verdict per ip: block list, allow list, too many violations.

    ``requests``: ip, violation. Aggregated before the lists are joined, so an
    ip's rows meet the join as one row.
    """
    per_ip = requests.groupBy("ip").agg(F.count("*").alias("requests"), F.count_if("violation").alias("violations"))
    flagged = per_ip.join(blocked.select("ip", F.lit(True).alias("listed")).distinct(), "ip", "left")
    if allowed is not None:
        flagged = flagged.join(allowed.select("ip", F.lit(True).alias("welcome")).distinct(), "ip", "left")
    else:
        flagged = flagged.withColumn("welcome", F.lit(True))
    verdict = (F.when(F.coalesce("listed", F.lit(False)), "block_list").when(~F.coalesce("welcome", F.lit(False)), "not_allowed")
               .when(F.col("violations") > max_violations, "violations").otherwise("pass"))
    return flagged.select("ip", "requests", "violations", verdict.alias("verdict"))


def request_stats(flagged: DataFrame) -> DataFrame:
    """Totals over flagged requests with a ``limited`` column."""
    blocked = F.count_if(~F.col("verdict").isin("ok", "suspicious_user_agent"))
    return flagged.agg(
        F.count("*").alias("total"), blocked.alias("blocked"), F.count_if("limited").alias("limited"),
        F.count_if(F.col("verdict") == "suspicious_user_agent").alias("suspicious"),
        (blocked / F.count("*") * 100).alias("percent_blocked"), F.countDistinct("ip").alias("active_ips"))


# --- sessions --------------------------------------------------------------------------

def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where((F.col("state") == "active") & (F.col("expires_at") > now))


def session_stats(sessions: DataFrame, now: Column) -> DataFrame:
    live = (F.col("state") == "active") & (F.col("expires_at") > now)
    total = sessions.agg(
        F.count("*").alias("total"), F.count_if(live).alias("active"),
        F.count_if((F.col("state") == "active") & ~live).alias("expired"),
        F.count_if(F.col("state") == "revoked").alias("revoked"), F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.when(live, F.col("user_id"))).alias("active_users"))
    return total.withColumn("active_per_user", F.when(F.col("active_users") > 0, F.col("active") / F.col("active_users")).otherwise(0.0))


def session_limit(sessions: DataFrame, keep: int = config.MAX_SESSIONS) -> DataFrame:
    """Sessions that are closed because a user has more than ``keep`` newer ones.

    The newest ``keep`` per user are ranked with a limit that Spark applies
    before the shuffle; all others are found by an anti join on the session.
    """
    newest = top_per_group(sessions.select("user_id", "session_id", "created_at"), ["user_id"],
                           [F.col("created_at").desc(), F.col("session_id")], keep)
    return sessions.join(newest.select("session_id"), "session_id", "left_anti")


def session_consistency(activity: DataFrame) -> DataFrame:
    """Sessions whose address or agent changes, with the time of the first change.

    The first values come from one aggregation, the first change from a second;
    no session is sorted in one task.
    """
    first = activity.groupBy("session_id").agg(F.min_by(F.struct("ip", "user_agent"), F.struct("ts_us", "event_id")).alias("f"))
    changed = activity.join(first, "session_id").where((F.col("ip") != F.col("f.ip")) | (F.col("user_agent") != F.col("f.user_agent")))
    reason = F.when(F.col("ip") != F.col("f.ip"), "ip_mismatch").otherwise("user_agent_mismatch")
    return changed.groupBy("session_id").agg(
        F.min("ts_us").alias("closed_us"), F.min_by(reason, F.struct("ts_us", "event_id")).alias("reason"), F.count("*").alias("changes"))


# --- permissions -------------------------------------------------------------------------

def effective_permissions(assignments: DataFrame, parents: DataFrame, permissions: DataFrame, now: Column) -> DataFrame:
    """Distinct permissions of each user through roles and their parents.

    ``assignments``: user_id, role, expires_at; ``parents``: parent, child
    (the child role inherits from the parent); ``permissions``: role, resource,
    action and, where grants are narrower, resource_id and conditions (a map or
    its entries). ``conditions`` come out as sorted entries, as maps have no order.
    """
    from alertloom.operators.joins import closure

    active = assignments.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("user_id", "role").distinct()
    inherited = closure(parents).select(F.col("descendant").alias("role"), F.col("ancestor").alias("source"))
    own = permissions.select(F.col("role"), F.col("role").alias("source")).distinct()
    roles = inherited.unionByName(own).distinct()
    scope = [c for c in ("resource", "action", "resource_id", "conditions") if c in permissions.columns]
    held = permissions.select(F.col("role").alias("source"), *(_entries(permissions).alias(c) if c == "conditions" else c for c in scope))
    # Roles are expanded to their permissions first, so the user side is joined once.
    granted = roles.join(held, "source").select("role", *scope).distinct()
    return active.join(granted, "role").select("user_id", *scope).distinct()


def _entries(rows: DataFrame) -> Column:
    """The column ``conditions`` as sorted (key, value) entries, null when there are none."""
    if "conditions" not in rows.columns:
        return F.lit(None).cast("array<struct<key:string,value:string>>")
    kind = rows.schema["conditions"].dataType.typeName()
    entries = F.array_sort(F.map_entries("conditions") if kind == "map" else F.col("conditions"))
    return F.when(F.size(entries) > 0, entries)


def access_review(requests: DataFrame, granted: DataFrame) -> DataFrame:
    """allow / deny per request; ``admin`` covers every action of its resource, ``write`` covers ``read``."""
    held = granted.groupBy("user_id", "resource").agg(
        F.coalesce(F.bool_or(F.col("action") == "admin"), F.lit(False)).alias("all_actions"), F.collect_set("action").alias("actions"))
    joined = requests.join(held, ["user_id", "resource"], "left")
    reads = (F.col("action") == "read") & F.array_contains("actions", "write")
    allowed = F.col("all_actions") | F.array_contains("actions", F.col("action")) | reads
    return joined.withColumn("decision", F.when(allowed, "allow").otherwise("deny")).drop("all_actions", "actions")


def scoped_review(requests: DataFrame, granted: DataFrame) -> DataFrame:
    """``access_review`` of requests that may name a ``resource_id`` and ``conditions``.

    One grant has to fit as a whole: its action covers the asked one, its
    resource_id is the asked one (a request without an id asks for any; a grant
    without one does not cover a named resource), and it holds every asked
    condition. A grant or a request without conditions sets none. Users or
    resources that are null fit no grant.

    Equal requests are decided once: the different ones meet the grants of their
    user and resource in a semi join, which puts out no pairs.
    """
    def id_of(rows: DataFrame) -> Column:
        return F.when(F.col("resource_id") != "", F.col("resource_id")) if "resource_id" in rows.columns else F.lit(None).cast("string")

    shape = F.struct("user_id", "resource", "action", id_of(requests).alias("resource_id"), _entries(requests).alias("conditions"))
    asked = requests.select(shape.alias("shape")).distinct()
    grants = granted.select(
        F.col("user_id").alias("holder"), F.col("resource").alias("held"), F.col("action").alias("can"),
        id_of(granted).alias("only_id"), _entries(granted).alias("only_if"))
    want = {c: F.col(f"shape.{c}") for c in ("user_id", "resource", "action", "resource_id", "conditions")}
    covers = (F.col("can") == "admin") | (F.col("can") == want["action"]) | ((F.col("can") == "write") & (want["action"] == "read"))
    same_id = want["resource_id"].isNull() | F.coalesce(F.col("only_id") == want["resource_id"], F.lit(False))
    holds = want["conditions"].isNull() | F.col("only_if").isNull() | (F.size(F.array_except(want["conditions"], F.col("only_if"))) == 0)
    fits = (F.col("holder") == want["user_id"]) & (F.col("held") == want["resource"]) & covers & same_id & holds
    key, flag = _free("shape", requests), _free("allowed", requests)
    allowed = asked.join(grants, fits, "left_semi").select(F.col("shape").alias(key), F.lit(True).alias(flag))
    judged = requests.withColumn(key, shape).join(allowed, key, "left")
    return judged.withColumn("decision", F.when(F.col(flag), "allow").otherwise("deny")).drop(key, flag)


def _free(name: str, rows: DataFrame) -> str:
    """``name``, lengthened until no column of ``rows`` has it."""
    while name in rows.columns:
        name = "_" + name
    return name
