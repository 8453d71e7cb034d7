"""A frozen frontier of the change feed: per topic, one offset that every model
of a build stops before; and the wait for a frontier that stands still."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.specs import CAPTURED, TOPIC

TOPICS = tuple(TOPIC.format(t) for t in CAPTURED)


class BoundaryError(ValueError):
    pass


def validated(boundary: Mapping) -> dict[str, dict[str, int]]:
    """The boundary if it names exactly the captured topics, each with partition
    0 and a non-negative exclusive offset."""
    if not isinstance(boundary, Mapping):
        raise BoundaryError("a boundary is a mapping of topics")
    if set(boundary) != set(TOPICS):
        raise BoundaryError(f"a boundary names exactly {sorted(TOPICS)}")
    out = {}
    for topic in sorted(boundary):
        at = boundary[topic]
        if not isinstance(at, Mapping) or set(at) != {"partition", "offset_exclusive"}:
            raise BoundaryError(f"{topic}: needs partition and offset_exclusive, nothing else")
        for k, v in at.items():
            if type(v) is not int or v < 0 or (k == "partition" and v != 0):
                raise BoundaryError(f"{topic}: {k} = {v!r}")
        out[topic] = {"offset_exclusive": at["offset_exclusive"], "partition": at["partition"]}
    return out


def serialized(boundary: Mapping) -> str:
    return json.dumps(validated(boundary), sort_keys=True, separators=(",", ":"))


def boundary_filter(boundary: Mapping | None, topic: str) -> Column:
    """Rows of ``topic`` before the boundary; all rows if there is none."""
    if boundary is None:
        return F.lit(True)
    if topic not in TOPICS:
        raise BoundaryError(f"{topic} is not captured")
    at = validated(boundary)[topic]
    return (F.col("kafka_partition") == at["partition"]) & (F.col("kafka_offset") < at["offset_exclusive"])


def frontier(feed: DataFrame) -> dict[str, dict[str, int]]:
    """The boundary after the last offset that ``feed`` holds of each captured
    topic, 0 for one without rows. Rows that no boundary could name are an error,
    as the filter would lose them."""
    known = F.col("kafka_topic").isin(*TOPICS) & (F.col("kafka_partition") == 0) & (F.col("kafka_offset") >= 0)
    ends = feed.groupBy(F.when(known, F.col("kafka_topic")).alias("topic")).agg(F.max("kafka_offset").alias("last")).collect()
    if any(r.topic is None for r in ends):
        raise BoundaryError("the feed has rows outside partition 0 of the captured topics")
    after = {r.topic: r["last"] + 1 for r in ends}
    return validated({t: {"partition": 0, "offset_exclusive": after.get(t, 0)} for t in TOPICS})


@dataclass(frozen=True)
class Connector:
    """State of the capture: the connector's and its tasks'."""

    state: str
    tasks: tuple[str, ...]


@dataclass(frozen=True)
class Sample:
    """What a probe saw: exclusive end offsets and committed offsets by topic,
    the partitions of each topic, and, where it asked for them, the connector and
    the group that consumes (name, members)."""

    ends: Mapping[str, int]
    committed: Mapping[str, int]
    problems: tuple[str, ...] = ()
    partitions: Mapping[str, tuple[int, ...]] | None = None
    connector: Connector | None = None
    group: tuple[str, int] | None = None


def health(sample: Sample, group: str | None = None) -> list[str]:
    """What is wrong with the capture, lag aside; nothing if it is healthy."""
    out = list(sample.problems)
    if c := sample.connector:
        states = {"connector": c.state} | {f"task {k}": s for k, s in enumerate(c.tasks)}
        out += [f"{who} is {s}" for who, s in states.items() if s != "RUNNING"]
        out += [] if c.tasks else ["connector without tasks"]
    if sample.group:
        name, members = sample.group
        out += [f"group {name} instead of {group}"] if group and name != group else []
        out += [] if members > 0 else [f"group {name} has no members"]
    if sample.partitions is not None:
        found = {(t, p) for t, ps in sample.partitions.items() for p in ps}
        due = {(t, 0) for t in TOPICS}
        out += [f"{t}[{p}] is missing" for t, p in sorted(due - found)] + [f"{t}[{p}] is not expected" for t, p in sorted(found - due)]
    for t in TOPICS:
        if t not in sample.ends or t not in sample.committed:
            out.append(f"{t}: offsets are missing")
            continue
        end, done = sample.ends[t], sample.committed[t]
        if min(end, done) < 0:
            out.append(f"{t}: negative offsets {done} of {end}")
        elif done > end:
            out.append(f"{t}: committed beyond its end")
    return out


def complaints(sample: Sample) -> list[str]:
    """Why a sample can't be a frontier; empty if it can."""
    lag = {t: sample.ends.get(t, 0) - sample.committed.get(t, 0) for t in TOPICS}
    return health(sample) or [f"{t}: {n} behind" for t, n in lag.items() if n]


def wait_for_frontier(probe: Callable[[], Sample], window_s: float, deadline_s: float, poll_s: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The boundary once two samples without lag, at least ``window_s`` apart,
    agree. A failed probe, a lag or a moved end drops the candidate."""
    began, candidate, since, why = clock(), None, 0.0, ["no sample yet"]
    while True:
        now = clock()
        if now - began > deadline_s:
            raise TimeoutError("no stable frontier: " + "; ".join(why))
        try:
            sample = probe()
            why = complaints(sample)
        except Exception as e:  # a probe that fails says nothing
            why = [f"probe failed: {e}"]
        if why:
            candidate = None
        elif candidate is None or candidate != dict(sample.ends):
            candidate, since, why = dict(sample.ends), now, ["the frontier moved"]
        elif now - since >= window_s:
            return validated({t: {"partition": 0, "offset_exclusive": candidate[t]} for t in TOPICS})
        sleep(poll_s)
