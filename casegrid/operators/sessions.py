"""Sessions of each entity's events, cut from a tree over the gaps between successive events (problem 1).

The tree is the Cartesian tree of an entity's sequence of gaps, largest gap on top, equal gaps in one node. Each node
is one row: the events it spans, its height (largest gap inside) and its parent's height (the smaller of the gaps
at its two ends). A node is a session at threshold t just if height <= t < parent height, so that one tree serves
any number of thresholds by a filter.

Distribution: events are range partitioned by (entity, instant), so that an entity with a third of all events is
spread over as many tasks as its share. Each task builds the trees of its chunk. Only the first and the last entity
of a chunk may go on in another one; of those the task hands on the reduced chunk, that is the nodes at its two
spines. Along a spine gaps rise strictly, so that k spine nodes span at least k*k/2 ms: the number handed on is
bounded by the square root of the time a chunk spans, not by its events. The reduced chunks of one entity are
then merged by the same algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.operators.timestamps import device_facts, with_instant
from casegrid.session import cut, table

#: Stands for "no gap": the height above a root.
OPEN = (1 << 62) - 1
_NODES = "entity string, start_ms long, end_ms long, n_events long, height_ms long, parent_ms long, kind int"


def tree_nodes(start: np.ndarray, end: np.ndarray, n: np.ndarray, height: np.ndarray, left: int, right: int) -> list[tuple]:
    """All nodes of the tree over a sequence of leaves: (start, end, n, height, parent height).

    left and right are the gaps before the first and after the last leaf, OPEN at an entity's ends. Runs in one pass
    with a stack whose gaps fall strictly from bottom to top.
    """
    out: list[tuple] = []
    stack: list[list] = []  # [start, end, n, height, gap after]
    gaps = np.append(start[1:] - end[:-1], right).tolist()
    for s, e, k, h, gap in zip(start.tolist(), end.tolist(), n.tolist(), height.tolist(), gaps):
        node = [s, e, k, h]
        while True:
            before = stack[-1][4] if stack else left
            top = before if before < gap else gap
            if node[3] < top:
                out.append((node[0], node[1], node[2], node[3], top))
            if not stack or before > gap:
                break
            a = stack.pop()
            node = [a[0], node[1], a[2] + node[2], max(a[3], node[3], before)]
        stack.append([*node, gap])
    return out


def reduce_chunk(start: np.ndarray, end: np.ndarray, n: np.ndarray, height: np.ndarray) -> np.ndarray:
    """First leaf of each segment of the reduced chunk: leaves after gaps that exceed all before, or all behind, them."""
    gap = start[1:] - end[:-1]
    if not len(gap):
        return np.array([0])
    rising = np.ones(len(gap), dtype=bool)
    rising[1:] = gap[1:] > np.maximum.accumulate(gap)[:-1]
    back = gap[::-1]
    falling = np.ones(len(gap), dtype=bool)
    falling[1:] = back[1:] > np.maximum.accumulate(back)[:-1]
    return np.concatenate([[0], np.flatnonzero(rising | falling[::-1]) + 1])


_COLUMNS = ["entity", "start_ms", "end_ms", "n_events", "height_ms", "parent_ms", "kind"]


def _entity_nodes(entity: str, t: np.ndarray, n: np.ndarray, is_open: bool) -> list[tuple]:
    """Nodes of one entity's part of a chunk; kind 0: a finished node, kind 1: a leaf of the reduced chunk of an entity that may go on."""
    zero = np.zeros(len(t), dtype=np.int64)
    if not is_open:
        return [(entity, *x, 0) for x in tree_nodes(t, t, n, zero, OPEN, OPEN)]
    first = reduce_chunk(t, t, n, zero)
    ends = np.append(first[1:], len(t))
    found = []
    for p, q in zip(first.tolist(), ends.tolist()):
        h = int((t[p + 1 : q] - t[p : q - 1]).max()) if q - p > 1 else 0
        if q - p > 1:  # nodes below the segment's own; the segment itself is left to the merge
            inner = tree_nodes(t[p:q], t[p:q], n[p:q], zero[p:q], OPEN, OPEN)
            found += [(entity, *x, 0) for x in inner if x[4] < OPEN]
        found.append((entity, int(t[p]), int(t[q - 1]), int(n[p:q].sum()), h, 0, 1))
    return found


def _chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees of one chunk, in a running pass that holds one entity at a time; only its first and last entity may go on elsewhere."""
    held: list = []  # entity, instants, counts
    began, out = False, []

    def flush(is_open: bool) -> list[tuple]:
        return _entity_nodes(held[0], np.concatenate(held[1]), np.concatenate(held[2]), is_open)

    for f in frames:
        if not len(f):
            continue
        at, count, who = f["ms"].to_numpy(dtype=np.int64), f["n"].to_numpy(dtype=np.int64), f["entity"].to_numpy()
        bounds = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(f)]
        for a, b in zip(bounds, bounds[1:]):
            if held and held[0] == who[a]:
                held[1].append(at[a:b])
                held[2].append(count[a:b])
                continue
            if held:
                out += flush(not began)
                began = True
            held = [who[a], [at[a:b]], [count[a:b]]]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
    if held:
        out += flush(True)
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("start_ms", kind="stable")
    entity = rows["entity"].iat[0]
    cols = (rows[c].to_numpy(dtype=np.int64) for c in ("start_ms", "end_ms", "n_events", "height_ms"))
    found = [(entity, *x, 0) for x in tree_nodes(*cols, OPEN, OPEN)]
    return pd.DataFrame(found, columns=_COLUMNS)


def gap_tree(events: DataFrame) -> DataFrame:
    """Tree over the gaps of each entity's events.

    events: columns entity (string) and ms (long), one row per event, others are ignored; rows with a null in either
    take no part. Events of one instant form one leaf. Result: entity, start_ms, end_ms, n_events, height_ms,
    parent_ms (OPEN at a root); an empty input gives an empty result.
    """
    leaves = (
        events.where(F.col("entity").isNotNull() & F.col("ms").isNotNull())
        .groupBy("entity", "ms").agg(F.count(F.lit(1)).alias("n"))
    )
    chunks = leaves.repartitionByRange("entity", "ms").sortWithinPartitions("entity", "ms")
    nodes = cut(chunks.mapInPandas(_chunk, _NODES))
    merged = nodes.where("kind = 1").groupBy("entity").applyInPandas(_merge, _NODES)
    return nodes.where("kind = 0").unionByName(merged).drop("kind")


def cut_sessions(tree: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions of a tree for one threshold: a new session starts where more than gap_ms lie between events."""
    inside = (F.col("height_ms") <= F.lit(gap_ms)) & (F.col("parent_ms") > F.lit(gap_ms))
    return tree.where(inside).select("entity", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "n_events")


def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages as (entity, ms): those with a sender number and an instant, a repeated msg_id once."""
    facts = device_facts(table(spark, sf_dir, "devices"), table(spark, sf_dir, "device_zones"))
    rows = table(spark, sf_dir, "messages").select("msg_id", "device_id", "timestamp", "sender_digits")
    rows = rows.where(F.length(F.trim("sender_digits")) > 0)
    rows = with_instant(rows, facts).where(F.col("utc_ms").isNotNull())
    one = rows.groupBy("msg_id").agg(F.min(F.struct("utc_ms", "sender_digits")).alias("one"))
    return one.select(F.col("one.sender_digits").alias("entity"), F.col("one.utc_ms").alias("ms"))


def p1_found(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each sender_digits over all cases, cut where more than gap_minutes lie between messages."""
    sessions = cut_sessions(gap_tree(message_events(spark, sf_dir)), gap_minutes * 60_000)
    return sessions.select(F.col("entity").alias("sender_digits"), "start_ms", "end_ms", F.col("n_events").alias("n_messages"))


def p1_event_sessions(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    """Sessions of each user of the events table, from the same tree (start and end in ms since 1970)."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("entity"), F.expr("unix_millis(cast(ts as timestamp))").alias("ms"))
    found = cut_sessions(gap_tree(rows), gap_minutes * 60_000)
    return found.select(F.col("entity").alias("user_id"), "start_ms", "end_ms", "duration_ms", "n_events")


P1_EVENTS_SQL = """
with e as (select cast(user_id as varchar) as user_id, epoch_us(ts) // 1000 as ms from events where user_id is not null and ts is not null),
g as (select *, case when ms - lag(ms) over (partition by user_id order by ms) <= 1800000 then 0 else 1 end as fresh from e),
s as (select *, sum(fresh) over (partition by user_id order by ms rows unbounded preceding) as k from g)
select user_id, min(ms) as start_ms, max(ms) as end_ms, max(ms) - min(ms) as duration_ms, count(*) as n_events
from s group by user_id, k
"""
