"""Linking cases and resolving contacts: shared entities, links between cases, duplicates, greedy merges, places.

Pairs are never made of all rows: a pair must share a number, an e-mail, a word of a name, or a grid cell. Null and empty
values link nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.functions import text as T
from casegrid.session import cut

# Weight of each kind of shared entity in the strength of a link.
WEIGHTS = {"phone": 0.4, "email": 0.3, "device": 0.5, "location": 0.2, "name": 0.1}
#: Places of a case without a gap in latitude that one task sweeps; metres in a degree of latitude, rounded down.
MAX_SWEPT_PLACES, PER_DEGREE = 2_000_000, 111_000.0
CONFIDENCE = {"phone": 1.0, "email": 1.0, "device": 1.0, "location": 0.95, "name": 0.75}


def case_keys(contacts: DataFrame, devices: DataFrame) -> DataFrame:
    """Distinct (match_type, key, case_id): numbers, e-mails and names of contacts, serials of devices."""
    pair = lambda t, c: F.struct(F.lit(t).alias("match_type"), c.alias("key"))
    rows = contacts.select("case_id", F.explode(F.array(
        pair("phone", F.col("phone_digits")), pair("email", F.lower(F.trim("email"))), pair("name", F.lower(F.trim("name"))))).alias("p"))
    rows = rows.select("case_id", "p.*").where((F.length("key") > 0) & ((F.col("match_type") != "name") | (F.length("key") > 5)))
    more = devices.select("case_id", F.lit("device").alias("match_type"), F.col("serial_number").alias("key")).where("length(key) > 0")
    return rows.unionByName(more).distinct()


def shared_entities(keys: DataFrame, least_confidence: float = 0.7) -> DataFrame:
    """Keys of several cases: id, kind, number of cases, confidence."""
    m = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    rows = keys.groupBy("match_type", "key").agg(F.countDistinct("case_id").alias("cases")).where("cases > 1")
    rows = rows.withColumn("confidence", m[F.col("match_type")]).where(F.col("confidence") >= least_confidence)
    return rows.select(T.short_id(F.col("match_type"), F.col("key")).alias("entity_id"), "match_type", "key", "cases", "confidence")


def case_links(keys: DataFrame, least: float = 0.5) -> DataFrame:
    """Links between cases: kinds and number of shared entities and strength, min(1, sum of weight x confidence / 1.5).

    A key of many cases makes as many pairs as cases squared; that is the result asked for, bounded by pairs of cases.
    Counts per pair and kind are made before kinds are combined.
    """
    w = F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() for x in (k, v * CONFIDENCE[k])])
    a, b = keys.withColumnRenamed("case_id", "case_a"), keys.withColumnRenamed("case_id", "case_b")
    per = a.join(b, ["match_type", "key"]).where("case_a < case_b").groupBy("case_a", "case_b", "match_type").agg(F.count("*").alias("n"))
    rows = per.groupBy("case_a", "case_b").agg(F.sum("n").alias("shared"), F.sum(F.col("n") * w[F.col("match_type")]).alias("s"), F.count("*").alias("kinds"), F.min("match_type").alias("one"))
    strength = F.round(F.least(F.col("s") / 1.5, F.lit(1.0)), 6)
    kind = F.when(F.col("kinds") > 1, "multiple_shared_entities").otherwise(F.concat(F.lit("shared_"), F.col("one")))
    return rows.withColumn("strength", strength).where(F.col("strength") >= least).select("case_a", "case_b", kind.alias("link_type"), "shared", "strength")


def compare(a: str, b: str) -> tuple[Column, Column, Column]:
    """(number, name and e-mail score) of two contacts given as column prefixes."""
    pa, pb = F.col(f"{a}phone"), F.col(f"{b}phone")
    same = F.arrays_overlap(T.phone_variants(pa), T.phone_variants(pb))
    phone = F.when(pa == pb, 1.0).when(F.coalesce(same, F.lit(False)), 0.9).otherwise(0.0)
    email = F.when((F.length(f"{a}email") > 0) & (F.col(f"{a}email") == F.col(f"{b}email")), 1.0).otherwise(0.0)
    return F.coalesce(phone, F.lit(0.0)), F.coalesce(T.plain_similarity(F.col(f"{a}plain"), F.col(f"{b}plain")), F.lit(0.0)), F.coalesce(email, F.lit(0.0))


def duplicates(contacts: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of contacts (id_a < id_b), of one case or of two, that score at least `least`: 0.6 number + 0.3 name + 0.1 e-mail.

    Contacts of a case equal in name, number and e-mail are one, under the least id, with their number in copies_a and copies_b. Name
    and e-mail alone can't reach 0.7, so pairs are looked for among equal last ten digits only, which loses none. Contacts without
    a number are in no pair.
    """
    if least <= 0.4:
        raise ValueError("below 0.4 pairs without a common number could count")
    c = contacts.groupBy("contact_id").agg(F.min(F.struct("case_id", "name", "phone_digits", "email")).alias("r"))
    c = c.select("contact_id", "r.case_id", F.col("r.name").alias("name"), F.col("r.phone_digits").alias("phone"), F.lower(F.trim("r.email")).alias("email")).where("length(phone) > 0")
    c = c.groupBy("case_id", "name", "phone", "email").agg(F.min("contact_id").alias("contact_id"), F.count("*").alias("copies")).withColumn("plain", T.plain_name(F.col("name")))
    fields = ("contact_id", "case_id", "plain", "phone", "email", "copies")
    side = lambda x: c.select(F.right("phone", F.lit(10)).alias("tail"), *[F.col(f).alias(f"{x}_{f}") for f in fields])
    p, n, e = compare("a_", "b_")
    rows = side("a").join(side("b"), "tail").where("a_contact_id < b_contact_id").withColumn("confidence", 0.6 * p + 0.3 * n + 0.1 * e)
    rows = rows.where(F.col("confidence") >= least)
    return rows.select(
        F.col("a_contact_id").alias("id_a"), F.col("b_contact_id").alias("id_b"), F.col("a_case_id").alias("case_a"), F.col("b_case_id").alias("case_b"),
        F.col("a_copies").alias("copies_a"), F.col("b_copies").alias("copies_b"), F.round("confidence", 6).alias("confidence"))


def greedy_merges(pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """(kept, merged, confidence): pairs taken by falling confidence, ties by ids; a contact merged away is not used again.

    The order decides the result, but only among pairs that hang together: each connected component of matching pairs is a pass of its own.
    """
    from casegrid.operators.graph import components

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        out = []
        for r in rows.sort_values(["confidence", "id_a", "id_b"], ascending=[False, True, True]).itertuples():
            if r.id_a not in gone and r.id_b not in gone:
                gone.add(r.id_b)
                out.append((r.id_a, r.id_b, r.confidence))
        return pd.DataFrame(out, columns=["kept", "merged", "confidence"])

    good = cut(pairs.where(F.col("confidence") >= least).select("id_a", "id_b", "confidence"))
    groups = components(good.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    return good.join(groups.withColumnRenamed("id", "id_a"), "id_a").groupBy("component").applyInPandas(run, "kept string, merged string, confidence double")


def resolution_summary(pairs: DataFrame) -> DataFrame:
    """Pairs of each confidence band."""
    return pairs.groupBy(T.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


# places


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p = F.sin(F.radians(lat2 - lat1) / 2)
    q = F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(F.least(p * p + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * q * q, F.lit(1.0))))


def places_from_events(events: DataFrame) -> DataFrame:
    """Places read out of an event stream: id, case_id, latitude, longitude, timestamp."""
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("C"), F.col("user_id") % 4).alias("case_id"), F.col("user_id").alias("who"),
        F.round(F.col("value") % 90, 5).alias("latitude"), F.round((F.col("user_id") % 180).cast("double"), 5).alias("longitude"), F.col("ts").cast("timestamp").alias("timestamp"))


def movement(places: DataFrame) -> DataFrame:
    """Per person: points, kilometres, mean and top speed (km/h, where time passes), days. At least two points."""
    from casegrid.operators.comms import previous

    rows = places.where("latitude is not null and longitude is not null and timestamp is not null and who is not null")
    rows = previous(rows, ["who"], ["latitude", "longitude", "timestamp"], ["timestamp", "id"])
    km = haversine(F.col("before.latitude"), F.col("before.longitude"), F.col("latitude"), F.col("longitude")) / 1000
    hours = (F.unix_micros("timestamp") - F.unix_micros("before.timestamp")) / 3.6e9
    rows = rows.withColumns({"km": km, "hours": hours}).withColumn("speed", F.when(F.col("hours") > 0, F.col("km") / F.col("hours")))
    out = rows.groupBy("who").agg(
        F.count("*").alias("points"), F.round(F.sum("km"), 4).alias("km"), F.round(F.avg("speed"), 4).alias("mean_speed"), F.round(F.max("speed"), 4).alias("top_speed"),
        F.round((F.max(F.unix_micros("timestamp")) - F.min(F.unix_micros("timestamp"))) / 8.64e10, 6).alias("days"))
    return out.where("points > 1")


def shared_places(places: DataFrame) -> DataFrame:
    """Places, to five decimals, of several cases."""
    rows = places.groupBy(F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"))
    return rows.agg(F.countDistinct("case_id").alias("cases"), F.count("*").alias("visits"), F.lit(0.95).alias("confidence")).where("cases > 1")


def near_pairs(places: DataFrame, metres: float, per_degree: float = 111_320.0) -> DataFrame:
    """Pairs of places (id_a < id_b) of a case within a distance, by cells of that size and the eight around, then checked exactly.

    Cells of longitude are as wide as the distance at the end of a band of cells nearer to a pole, and wrap at 180 degrees; a band at a pole is one cell.
    """
    band = lambda la: F.floor(la * per_degree / metres)
    edge = lambda k: F.least(F.greatest(F.abs(k), F.abs(k + 1)) * metres / per_degree, F.lit(90.0))
    count = lambda k: F.greatest(F.lit(1), F.floor(360.0 * per_degree * F.cos(F.radians(edge(k))) / metres)).cast("long")
    column = lambda lo, k: F.least(F.floor((lo + 180.0) / 360.0 * count(k)), count(k) - 1)
    p = places.where("latitude is not null and longitude is not null").select("case_id", "id", F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    k = F.col("k")
    a = p.withColumn("k", F.explode(F.array(*(band(F.col("la")) + i for i in (-1, 0, 1)))))
    around = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.pmod(column(F.col("lo"), k) + i, count(k))))
    a = a.select("case_id", "k", F.explode(around).alias("m"), F.col("id").alias("id_a"), "la", "lo")
    b = p.withColumn("k", band(F.col("la"))).select("case_id", "k", column(F.col("lo"), k).alias("m"), F.col("id").alias("id_b"), F.col("la").alias("lb"), F.col("lo").alias("lp"))
    d = haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    rows = a.join(b, ["case_id", "k", "m"]).where(F.col("id_a") < F.col("id_b")).withColumn("metres", d)
    return rows.where(F.col("metres") <= metres).select("case_id", "id_a", "id_b", F.round("metres", 3).alias("metres"))


def visits(places: DataFrame) -> DataFrame:
    """One row per place: id, visits, first and last time, kind by number of visits."""
    key = F.concat_ws("|", F.format_string("%.5f", F.col("latitude")), F.format_string("%.5f", F.col("longitude")))
    rows = places.where("latitude is not null and longitude is not null").groupBy("case_id", key.alias("key")).agg(F.count("*").alias("visits"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    kind = F.when(F.col("visits") >= 10, "frequent").when(F.col("visits") >= 5, "regular").otherwise("poi")
    return rows.select(T.short_id(F.col("key")).alias("location_id"), "case_id", "visits", "first_seen", "last_seen", kind.alias("kind"))


def latitude_runs(points: DataFrame, chunk: int = 50_000) -> DataFrame:
    """(case_id, band, run, places, part): bands of latitude at least as high as the distance that hold places, the run of bands without a gap in which
    they lie, its places, and the part of about `chunk` places into which short runs are put together. Places of different runs are farther apart
    than the distance."""
    w = Window.partitionBy("case_id").orderBy("band")
    bands = points.groupBy("case_id", "band").agg(F.count("*").alias("n"))
    bands = bands.withColumn("start", F.coalesce(F.col("band") - F.lag("band").over(w) > 1, F.lit(True)).cast("long")).withColumn("run", F.sum("start").over(w))
    runs = bands.groupBy("case_id", "run").agg(F.sum("n").alias("places"))
    before = F.sum("places").over(Window.partitionBy("case_id").orderBy("run")) - F.col("places")
    return bands.select("case_id", "band", "run").join(runs.withColumn("part", F.floor(before / chunk)), ["case_id", "run"])


def swept(rows: pd.DataFrame, metres: float) -> pd.DataFrame:
    """Greedy clusters of places of one case. What lies before a seed is taken, so only what lies up to the distance behind it is looked at."""
    rows = rows.sort_values(["latitude", "longitude"]).reset_index(drop=True)
    latitude, longitude, visits = (rows[c].to_numpy() for c in ("latitude", "longitude", "visits"))
    la, lo = np.radians(latitude), np.radians(longitude)
    cos, ends = np.cos(la), np.searchsorted(la, la + metres / 6371000.0 * (1 + 1e-9) + 1e-12, side="right")
    free = np.ones(len(rows), dtype=bool)
    out = []
    for i in range(len(rows)):
        if not free[i]:
            continue
        near = i + np.flatnonzero(free[i : ends[i]])
        h = np.sin((la[near] - la[i]) / 2) ** 2 + cos[near] * cos[i] * np.sin((lo[near] - lo[i]) / 2) ** 2
        own = near[2 * 6371000.0 * np.arcsin(np.sqrt(np.minimum(h, 1))) <= metres]
        free[own] = False
        out.append((rows["case_id"].iat[0], rows["id"].iat[i], round(float(latitude[own].mean()), 5), round(float(longitude[own].mean()), 5), len(own), int(visits[own].sum())))
    return pd.DataFrame(out, columns=["case_id", "seed", "latitude", "longitude", "places", "visits"])


def clusters(places: DataFrame, metres: float, most: int = MAX_SWEPT_PLACES) -> DataFrame:
    """Greedy clusters of a case's distinct places (to five decimals): the first place by coordinates not yet taken seeds a cluster and
    takes all free ones within a distance. Clusters are named by their seed.

    The order decides the result, but only among places that hang together by pairs within the distance: each run of latitudes without a gap
    is swept in one task. A run of more than `most` places is split into connected components of its pairs, with the same result.
    """
    from casegrid.operators.graph import components

    points = places.where("latitude is not null and longitude is not null").groupBy("case_id", F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude")).agg(F.count("*").alias("visits"))
    points = points.withColumn("id", F.concat_ws("|", "case_id", F.format_string("%.5f", F.col("latitude")), F.format_string("%.5f", F.col("longitude"))))
    alone = F.col("case_id").isNull() | F.isnan("latitude") | F.isnan("longitude")
    points = cut(points.withColumn("band", F.when(~alone, F.floor(F.col("latitude") * PER_DEGREE / metres))))
    runs = cut(latitude_runs(points.where("band is not null")))
    points = points.join(runs, ["case_id", "band"], "left")
    kind = "case_id string, seed string, latitude double, longitude double, places int, visits int"
    run = lambda rows: swept(rows, metres)
    single = lambda rows: rows.select("case_id", F.col("id").alias("seed"), F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"), F.lit(1).alias("places"), F.col("visits").cast("int").alias("visits"))
    out = single(points.where("places is null")).unionByName(points.where(F.col("places") <= most).groupBy("case_id", "part").applyInPandas(run, kind))
    if runs.where(F.col("places") > most).limit(1).count():
        large = cut(points.where(F.col("places") > most))
        groups = components(near_pairs(large, metres, PER_DEGREE).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
        grouped = large.join(groups, "id", "left")
        out = out.unionByName(single(grouped.where("component is null"))).unionByName(grouped.where("component is not null").groupBy("component").applyInPandas(run, kind))
    return out


def cross_case_timeline(messages: DataFrame, calls: DataFrame, places: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages, calls and places of all cases in order of time (column at), texts cut at 100 characters for show; rows without a time are left out."""
    m = messages.select("at", "case_id", F.lit("message").alias("kind"), F.col("msg_id").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 100).alias("summary"))
    c = calls.select("at", "case_id", F.lit("call").alias("kind"), F.col("call_id").alias("id"), F.concat(F.coalesce("duration_seconds", F.lit(0)).cast("string"), F.lit("s")).alias("summary"))
    p = places.select(F.col("timestamp").alias("at"), "case_id", F.lit("location").alias("kind"), F.col("id").cast("string").alias("id"), F.concat_ws(", ", "latitude", "longitude").alias("summary"))
    rows = m.unionByName(c).unionByName(p).where("at is not null").distinct().orderBy("at", "kind", "id")
    return rows.limit(limit) if limit else rows


def connections(keys: DataFrame) -> DataFrame:
    """Pairs of cases with the number of keys they share, a strength of a fifth per key up to 1, and the least key."""
    a, b = keys.withColumnRenamed("case_id", "case_a"), keys.withColumnRenamed("case_id", "case_b")
    name = F.concat_ws(":", "match_type", "key")
    per = a.join(b, ["match_type", "key"]).where("case_a < case_b").select("case_a", "case_b", name.alias("name"))
    rows = per.groupBy("case_a", "case_b").agg(F.count("*").alias("shared"), F.min("name").alias("first_key"))
    return rows.withColumn("strength", F.round(F.least(F.lit(1.0), F.col("shared") * 0.2), 6))


def linked_cases(keys: DataFrame, case_id: str, least: float = 0.5) -> DataFrame:
    """Cases linked to a case, with kind and strength of the link."""
    links = case_links(keys, least).where((F.col("case_a") == case_id) | (F.col("case_b") == case_id))
    return links.select(F.when(F.col("case_a") == case_id, F.col("case_b")).otherwise(F.col("case_a")).alias("case_id"), "link_type", "strength")


def case_network(comms: DataFrame, case_ids: list[str] | None = None) -> DataFrame:
    """Distinct relationships (case_id, src, dst, type) of cases, not summed up; all cases by default."""
    rows = comms.where(F.col("case_id").isin(case_ids)) if case_ids is not None else comms
    return rows.where("length(sender) > 0 and length(receiver) > 0").select("case_id", F.col("sender").alias("src"), F.col("receiver").alias("dst"), "type").distinct()
