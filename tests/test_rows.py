import math
import random

from pyspark.sql import functions as F

from casegrid.operators import comms as C
from casegrid.operators import linking as K
from casegrid.operators import lookups as L


def test_previous_over_hours(spark):
    r = random.Random(4)
    rows = [(i, "hot" if r.random() < 0.8 else "b", r.randrange(0, 40) * 900) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {x.id: x.before and x.before.id for x in C.previous(df, ["k"], ["id"], ["timestamp", "id"]).collect()}
    want = {}
    for key in ("hot", "b"):
        last = None
        for i, _, _ in sorted((x for x in rows if x[1] == key), key=lambda x: (x[2], x[0])):
            want[i], last = last, i
    assert got == want


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 > 0, "big").otherwise("small").alias("g"))
    a = {(x.g, x.id) for x in L.sample_rows(df, "g", "id", 30).collect()}
    assert a == {(x.g, x.id) for x in L.sample_rows(df.repartition(5), "g", "id", 30).collect()}
    assert sum(g == "big" for g, _ in a) == sum(g == "small" for g, _ in a) == 30


def test_new_rows_and_upsert(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 2)], "k string, n int")
    got = sorted(map(str, L.new_rows(batch, spark.createDataFrame([("c", 2)], "k string, n int"), ["k", "n"]).collect()))
    assert got == ["Row(k='a', n=1)", "Row(k='b', n=None)"]
    rows = spark.createDataFrame([("x", 1, "p"), ("x", 2, None), (None, 3, "q")], "k string, v int, t string")
    assert [tuple(x) for x in L.upsert_last(rows, "k", ["v"]).collect()] == [("x", 2, None)]


def test_duplicates_of_different_cases_and_merges(spark):
    # one number written in two ways under three cases, another pair, and a contact of its own
    rows = [("c1", "A", "Rajesh Kumar", "919876543210", "rajesh@x.example"), ("c2", "B", "Kumar Rajesh", "919876543210", None), ("c3", "C", "Rajesh Kumar", "9876543210", "Rajesh@x.example"), ("c6", "D", "Zoe", "11", None)]
    rows += [("c4", "A", "Priya Sharma", "919999988888", None), ("c5", "B", "Priya S", "919999988888", None), ("c7", "A", "Priya Sharma", "919999988888", None), (None, "A", "x", None, None), ("c8", "A", None, "", None)]
    df = spark.createDataFrame(rows, "contact_id string, case_id string, name string, phone_digits string, email string")
    got = {(r.id_a, r.id_b): r for r in K.duplicates(df).collect()}
    assert set(got) == {("c1", "c2"), ("c1", "c3"), ("c2", "c3"), ("c4", "c5")}
    assert got[("c1", "c3")].confidence == 0.94 and got[("c1", "c2")].confidence == 0.885 and got[("c4", "c5")].copies_a == 2
    assert {(r.kept, r.merged) for r in K.greedy_merges(K.duplicates(df)).collect()} == {("c1", "c3"), ("c1", "c2")}
    assert K.duplicates(df.where("false")).count() == K.greedy_merges(K.duplicates(df.where("false"))).count() == 0


def test_greedy_merges_follow_confidence(spark):
    pairs = spark.createDataFrame([("1", "3", 0.985), ("1", "2", 0.9), ("2", "3", 0.885), ("4", "5", 0.745)], "id_a string, id_b string, confidence double")
    assert {(r.kept, r.merged) for r in K.greedy_merges(pairs).collect()} == {("1", "3"), ("1", "2")}
    assert {r.band: r.n for r in K.resolution_summary(pairs).collect()} == {"high": 2, "medium": 2}


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(8)
    spots = [(i, "c", r.uniform(-90, 90) if i % 3 else r.choice((89.9995, -89.9999, 0.0004)), r.uniform(-180, 180) if i % 2 else r.choice((179.9999, -179.9999))) for i in range(150)]
    spots += [(1000 + i, "c", la + r.uniform(-4e-4, 4e-4), lo + r.uniform(-4e-4, 4e-4)) for i, (_, _, la, lo) in enumerate(spots) if abs(la) < 89.9 and abs(lo) < 179.9]
    df = spark.createDataFrame(spots, "id long, case_id string, latitude double, longitude double")
    a, b = df.selectExpr("id as i", "latitude as a", "longitude as b"), df.selectExpr("id as j", "latitude as c", "longitude as d")
    want = {(x.i, x.j) for x in a.join(b, F.col("i") < F.col("j")).where(K.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= 50).collect()}
    assert {(x.id_a, x.id_b) for x in K.near_pairs(df, 50.0).collect()} == want and len(want) > 50


def test_clusters_by_seed_and_single_places(spark):
    rows = [(1, "c", 10.0, 20.0), (2, "c", 10.0004, 20.0), (3, "c", 10.0008, 20.0), (4, "c", 11.0, 20.0), (5, "c", None, 1.0)]
    df = spark.createDataFrame(rows, "id long, case_id string, latitude double, longitude double")
    assert sorted((r.seed, r.places) for r in K.clusters(df, 50.0).collect()) == [("c|10.00000|20.00000", 2), ("c|10.00080|20.00000", 1), ("c|11.00000|20.00000", 1)]


def test_clusters_need_no_pairs_and_split_alike(spark, monkeypatch):
    """Pairs and their components were made of all places, however dense; now only of runs too large for a task."""
    r = random.Random(4)
    spots = [(i, r.choice("cd"), round(r.choice((0, 1, 60, 89.9)) + r.uniform(0, 0.01), 4), r.choice((179.999, -179.999, 5.0)) + r.uniform(0, 9e-4)) for i in range(400)]
    spots += [(400, None, 1.0, 5.0), (401, None, 1.0, 5.00001), (402, "c", float("nan"), 5.0)]
    df = spark.createDataFrame(spots, "id long, case_id string, latitude double, longitude double")
    want = []
    for case in "cd":
        free = sorted({(round(la, 5), round(lo, 5)) for _, c, la, lo in spots if c == case and la == la})
        visits = lambda la, lo: sum(c == case and (round(a, 5), round(b, 5)) == (la, lo) for _, c, a, b in spots if a == a)
        while free:
            (la, lo), own = free[0], []
            for a, b in free:
                h = math.sin(math.radians(a - la) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(la)) * math.sin(math.radians(b - lo) / 2) ** 2
                if 2 * 6371000 * math.asin(math.sqrt(h)) <= 120:
                    own.append((a, b))
            free = [x for x in free if x not in own]
            want.append((f"{case}|{la:.5f}|{lo:.5f}", len(own), sum(visits(*x) for x in own)))
    want = sorted([*want, ("1.00000|5.00000", 1, 1), ("1.00000|5.00001", 1, 1), ("c|NaN|5.00000", 1, 1)])
    got = lambda **kw: sorted((x.seed, x.places, x.visits) for x in K.clusters(df, 120.0, **kw).collect())
    assert got(most=0) == want
    monkeypatch.setattr(K, "near_pairs", None)
    assert got() == want and max(x[1] for x in want) > 3


def test_distance_and_near_pairs(spark):
    d = spark.sql("select 1").select(K.haversine(F.lit(40.7128), F.lit(-74.0060), F.lit(34.0522), F.lit(-118.2437)).alias("d")).first().d
    assert 3_900_000 < d < 4_000_000
    places = spark.createDataFrame([(1, "c", 10.0, 20.0), (2, "c", 10.0003, 20.0), (3, "c", 10.01, 20.0), (4, "x", 10.0, 20.0), (5, "c", None, 20.0)], "id long, case_id string, latitude double, longitude double")
    assert [(r.id_a, r.id_b) for r in K.near_pairs(places, 50.0).collect()] == [(1, 2)]


def test_empty_and_null_communications(spark):
    none = spark.createDataFrame([], "id int, case_id string, sender string, receiver string, type string, timestamp timestamp, duration_seconds int")
    for op in (C.spikes, C.behaviour_changes, C.replies, C.daily_anomalies, C.temporal_evolution, C.unusual_contacts, C.zero_filled_daily, C.flows, C.gaps_between):
        assert op(none).count() == 0
    one = spark.createDataFrame([(1, None, None, "", None, None, None)], none.schema)
    assert C.flows(one).count() == C.contact_roles(one).count() == C.spikes(one).count() == 0
    assert C.weekday_hour_heatmap(none).count() == 168


def test_newest_by_instant_and_samples(spark):
    rows = [("m1", None, "2024-01-02T00:00:00Z"), ("m2", None, "01/03/2024 09:00"), ("m3", None, "yesterday"), ("m4", None, "1704067200"), ("m1", None, "2024-01-02T00:00:00Z")]
    facts = spark.createDataFrame([], "device_id string, __zone string, __ios boolean")
    df = spark.createDataFrame(rows, "msg_id string, device_id string, timestamp string")
    assert [r.msg_id for r in L.newest(df, facts, 3).collect()] == ["m2", "m1", "m4"]


def test_islands_and_resampling(spark):
    frames = [("a", i, e) for i, e in enumerate([0.0, 9.0, 9.0, 0.0, 9.0])] + [("b", None, 1.0)]
    df = spark.createDataFrame(frames, "source string, frame int, energy double")
    assert [tuple(r) for r in C.voice_islands(df).collect()] == [("a", 1, 2, 2)]
    assert sorted(tuple(r) for r in C.voice_islands(df, keep_open=True).collect()) == [("a", 1, 2, 2), ("a", 4, 4, 1)]
    at = spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 02:50:00",)], "t string").select(F.to_timestamp("t").alias("timestamp"))
    assert [r.n for r in C.resampled(at).orderBy("bucket").collect()] == [1, 0, 1]
    assert C.resampled(at.where("false")).count() == 0
