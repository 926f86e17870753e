import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from casegrid.operators import sessions as S


def plain(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = t, out[-1][2] + 1
        else:
            out.append([t, t, 1])
    return sorted(map(tuple, out))


def leaves(times):
    t, n = np.unique(np.array(times, dtype=np.int64), return_counts=True)
    return t, t, n, np.zeros(len(t), dtype=np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(0, 12))
def test_tree_cut_is_plain_sessions(times, gap):
    nodes = S.tree_nodes(*leaves(times), S.OPEN, S.OPEN)
    assert sorted((a, b, n) for a, b, n, h, p in nodes if h <= gap < p) == plain(times, gap)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 80), min_size=2, max_size=50), st.integers(1, 49), st.integers(0, 12))
def test_chunks_merge_to_the_same_tree(times, at, gap):
    times = sorted(set(times))
    parts = [p for p in (times[:at], times[at:]) if p]
    import pandas as pd

    rows = []
    for p in parts:
        frame = pd.DataFrame({"entity": "e", "ms": p, "n": 1})
        rows += [r for f in S._chunk(iter([frame])) for r in f.itertuples(index=False)]
    open_ = pd.DataFrame([r for r in rows if r.kind == 1])
    nodes = [r for r in rows if r.kind == 0] + list(S._merge(open_).itertuples(index=False))
    found = sorted((r.start_ms, r.end_ms, r.n_events) for r in nodes if r.height_ms <= gap < r.parent_ms)
    assert found == plain(times, gap)


def test_spine_is_bounded_by_time():
    t = np.cumsum(np.arange(1, 200))
    assert len(S.reduce_chunk(t, t, np.ones(199), np.zeros(199))) <= 2 * np.sqrt(2 * (t[-1] - t[0])) + 2
    even = np.arange(0, 10000, 10)
    assert len(S.reduce_chunk(even, even, even, even)) <= 3


def test_operator(spark):
    rows = [("a", t) for t in (0, 10, 10, 100, 5000)] + [("b", 7), (None, 3), ("c", None)]
    events = spark.createDataFrame([(e, t, "x") for e, t in rows], "entity string, ms long, start_ms string")
    tree = S.gap_tree(events)
    got = {(r.entity, r.start_ms, r.end_ms, r.duration_ms, r.n_events) for r in S.cut_sessions(tree, 90).collect()}
    assert got == {("a", 0, 100, 100, 4), ("a", 5000, 5000, 0, 1), ("b", 7, 7, 0, 1)}
    assert {(r.start_ms, r.n_events) for r in S.cut_sessions(tree, 0).where("entity = 'a'").collect()} == {(0, 1), (10, 2), (100, 1), (5000, 1)}


def test_empty(spark):
    assert S.gap_tree(spark.createDataFrame([], "entity string, ms long")).count() == 0


def test_one_entity_over_many_chunks(spark):
    import random

    r = random.Random(2)
    times = sorted(r.randrange(10**7) for _ in range(4000))
    events = spark.createDataFrame([("hot", t) for t in times], "entity string, ms long")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((x.start_ms, x.end_ms, x.n_events) for x in S.cut_sessions(S.gap_tree(events), 3000).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == plain(times, 3000)
