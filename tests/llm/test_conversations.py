from casegrid.llm import conversations as C


def test_kahn_orders_by_rank_and_leaves_cycles():
    assert C.kahn(4, [(2, 0), (2, 0), (1, 3)], [3, 1, 2, 0]) == ([1, 3, 2, 0], [])
    order, left = C.kahn(4, [(0, 1), (1, 2), (2, 1), (2, 3)], [0, 1, 2, 3])
    assert order == [0] and left == [1, 2, 3]
    assert C.kahn(0, [], []) == ([], [])


def rows(spark, items):
    schema = "case_id string, app string, party_a string, party_b string, msg_id string, role string, utc_ms long, spoken boolean, bad boolean"
    return spark.createDataFrame([("c", "x", "1", "2", *i) for i in items], schema)


H = 3_600_000


def test_runs_are_split_and_dropped(spark):
    items = [("m1", "a", 0, True, False), ("m2", "b", 4 * H, True, False), ("m3", "a", 8 * H + 1, True, False), ("m4", "b", 9 * H, False, True), ("m5", "a", 30 * H, True, False), ("m6", None, 31 * H, True, False)]
    every = {r.first_msg_id: r.n_messages for r in C.rebuild(rows(spark, items), 4 * H).collect()}
    assert every == {"m1": 2, "m3": 2, "m5": 1}
    assert [r.first_msg_id for r in C.kept(C.rebuild(rows(spark, items), 4 * H)).collect()] == ["m1"]


def test_ties_by_id_and_one_run_over_many_tasks(spark):
    items = [(f"m{i:04d}", "ab"[i % 2], (i // 3) * 1000, True, False) for i in range(3000)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.rebuild(rows(spark, items), 4 * H).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [(r.first_msg_id, r.n_messages, r.n_turns, r.n_cyclic) for r in got] == [("m0000", 3000, 3000, 0)]


def test_contradicting_references_break_a_conversation(spark):
    df = rows(spark, [("m1", "a", 0, True, False), ("m2", "b", 1, True, False)])
    from pyspark.sql import functions as F

    df = df.withColumn("reply_to", F.when(F.col("msg_id") == "m1", "m2"))
    assert C.rebuild(df, H).first().n_cyclic == 2 and C.kept(C.rebuild(df, H)).count() == 0


def test_ties_are_ordered_by_the_graph_and_not_by_arrival():
    ids, ms = ["m3", "m1", "m2", "m9", "m4"], [0, 0, 0, 5, 5]
    assert C.order_run(ids, ms, None) == ([1, 2, 0, 4, 3], [])
    assert C.order_run(ids, ms, [None, "m3", None, None, None]) == ([2, 0, 1, 4, 3], [])  # m1 replies to m3 of the same instant
    assert C.order_run(ids, ms, [None, "m4", None, None, None]) == ([2, 0], [1, 3, 4])


def test_roles_must_alternate(spark):
    said = [("m1", "a", 0, True, False), ("m2", "b", 1, False, False), ("m3", "a", 2, True, False)]
    assert C.rebuild(rows(spark, said), H).first().n_turns == 1 and C.kept(C.rebuild(rows(spark, said), H)).count() == 0
    assert C.kept(C.rebuild(rows(spark, [*said, ("m4", "b", 3, True, False)]), H)).first().n_turns == 2


def test_cycle_over_many_tasks(spark):
    from pyspark.sql import functions as F

    items = [(f"m{i:04d}", "ab"[i % 2], i * 1000, True, False) for i in range(2000)] + [(f"n{i:04d}", "ab"[i % 2], 100 * H + i * 1000, True, False) for i in range(500)]
    df = rows(spark, items)
    back = df.withColumn("reply_to", F.when(F.col("msg_id") == "m0100", "m1900").when(F.col("msg_id") == "m1000", "m0010").when(F.col("msg_id") == "n0003", "m0003"))
    void = df.withColumn("reply_to", F.when(F.col("msg_id") == "m1999", "n0400").when(F.col("msg_id") == "m0005", "x"))
    for name, parts in (("many", "8"), ("one", "1")):
        old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.first_msg_id: (r.n_messages, r.n_cyclic) for r in C.rebuild(back, 4 * H).collect()}
            assert got == {"m0000": (2000, 1900), "n0000": (500, 0)}, name
            assert sorted(r.n_cyclic for r in C.rebuild(void, 4 * H).collect()) == [0, 0], name
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old[0])
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_empty(spark):
    assert C.rebuild(rows(spark, []), H).count() == 0
