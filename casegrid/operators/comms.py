"""Analytics over one table of communications: counts, timelines, spikes, response times, cumulative and rolling measures.

`comms` below is a DataFrame with id, case_id, sender, receiver, type ('message' or 'call'), timestamp, duration_seconds. Rows
with a null timestamp take no part in anything by time; null or empty ends take no part in anything by contact. Empty
inputs give empty results. All windows without a natural key run over aggregates of bounded size (buckets of time), never over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.session import with_scalars



def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def from_messages_and_calls(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """The union of both tables under one set of names; what one lacks is null."""
    m = messages.select(F.col("msg_id").alias("id"), "case_id", F.col("sender_digits").alias("sender"), F.col("receiver_digits").alias("receiver"), "timestamp", "text")
    c = calls.select(F.col("call_id").alias("id"), "case_id", F.col("caller_digits").alias("sender"), F.col("receiver_digits").alias("receiver"), "timestamp", "duration_seconds")
    return m.withColumn("type", F.lit("message")).unionByName(c.withColumn("type", F.lit("call")), allowMissingColumns=True)


def from_events(events: DataFrame) -> DataFrame:
    """Communications read out of an event stream: purchases and sign-ups stand for calls, all else for messages."""
    call = F.col("event_type").isin("purchase", "signup")
    return events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("C"), F.col("user_id") % 4).alias("case_id"), F.col("user_id").cast("string").alias("sender"),
        F.get_json_object("props", "$.k").alias("receiver"), F.when(call, "call").otherwise("message").alias("type"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.when(call, F.floor(F.col("value") * 60)).alias("duration_seconds"),
    )


def ends(comms: DataFrame) -> DataFrame:
    """One row per end of each communication (column contact); a message to oneself counts twice."""
    both = F.explode(F.array(F.struct(F.lit("out").alias("role"), F.col("sender").alias("contact")), F.struct(F.lit("in").alias("role"), F.col("receiver").alias("contact"))))
    rows = comms.withColumn("end", both)
    return rows.select("*", "end.role", "end.contact").drop("end").where(F.length("contact") > 0)


def previous(rows: DataFrame, keys: list[str], values: list[str], order: list[str], at: str = "timestamp", unit: str = "hour") -> DataFrame:
    """Add `before`, a struct of values of the row before, by key and order (`at` first); null for a key's first row.

    A key may hold a large part of all rows: the window runs over (key, hour), and the first row of an hour takes the last one of the
    key's hour before, from one row per key and hour. Rows with a null `at` must have been dropped.
    """
    rows = rows.withColumn("__b", F.date_trunc(unit, at))
    own = F.struct(*values)
    last = rows.groupBy(*keys, "__b").agg(F.max_by(own, F.struct(*order)).alias("__last"))
    carried = last.select(*keys, "__b", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")).alias("__carried"))
    inside = F.lag(own).over(Window.partitionBy(*keys, "__b").orderBy(*order))
    rows = rows.withColumn("__inside", inside).join(carried, [*keys, "__b"])
    return rows.withColumn("before", F.coalesce("__inside", "__carried")).drop("__b", "__inside", "__carried")


# counts and summaries


def case_statistics(comms: DataFrame) -> DataFrame:
    """Messages, calls and first and last instant of each case."""
    return comms.groupBy("case_id").agg(
        F.count_if(F.col("type") == "message").alias("messages"), F.count_if(F.col("type") == "call").alias("calls"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"))


def top_senders(comms: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent senders, ties by name."""
    return comms.where(F.length("sender") > 0).groupBy("sender").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender").limit(n)


def contact_roles(comms: DataFrame) -> DataFrame:
    """For each contact: sent, received, made, answered and their sum, from one pass over the ends."""
    role = F.when((F.col("type") == "message") & (F.col("role") == "out"), "sent").when(F.col("type") == "message", "received").when(F.col("role") == "out", "made").otherwise("answered")
    wide = ends(comms).withColumn("kind", role).groupBy("contact")
    counts = wide.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("sent", "received", "made", "answered")])
    return counts.withColumn("total", F.col("sent") + F.col("received") + F.col("made") + F.col("answered"))


def contact_interactions(comms: DataFrame, least: int = 5) -> DataFrame:
    """Messages, calls and total of each contact with at least `least` in all; both ends count."""
    rows = ends(comms).groupBy("contact").agg(F.count_if(F.col("type") == "message").alias("messages"), F.count_if(F.col("type") == "call").alias("calls"), F.count("*").alias("total"))
    return rows.where(F.col("total") >= least)


def unusual_contacts(comms: DataFrame, least: int = 5, limit: float = 2.0) -> DataFrame:
    """Contacts whose total lies more than `limit` population standard deviations from the mean of all contacts."""
    rows = contact_interactions(comms, least)
    stats = rows.agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("std"))
    z = F.try_divide(F.col("total") - F.col("mean"), F.col("std"))
    rows = with_scalars(rows, stats).withColumn("z", z).where(F.abs("z") > limit)
    return rows.select("contact", "total", _r("z").alias("z"), F.when(F.col("z") > 0, "High Activity").otherwise("Low Activity").alias("label"))


def daily_participants(comms: DataFrame) -> DataFrame:
    """Communications and distinct participants (either end) per day."""
    per = comms.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    who = ends(comms).where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.countDistinct("contact").alias("participants"))
    return per.join(who, "day", "left").select("day", "n", F.coalesce("participants", F.lit(0)).alias("participants"))


def daily_anomalies(comms: DataFrame, limit: float = 2.0) -> DataFrame:
    """Per day: count, distinct senders, whether a weekend, late-night count, deviation from the mean, spike."""
    h = F.hour("timestamp")
    days = comms.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.countDistinct("sender").alias("senders"), F.count_if((h >= 23) | (h <= 5)).alias("late_night"))
    stats = days.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"))
    rows = with_scalars(days, stats)
    return rows.select(
        "day", "n", "senders", (F.weekday("day") >= 5).alias("is_weekend"), "late_night", _r(F.try_divide(F.col("n") - F.col("mean"), F.col("std"))).alias("deviation"),
        F.coalesce(F.col("n") > F.col("mean") + limit * F.col("std"), F.lit(False)).alias("spike"))


# timelines


def activity_timeline(comms: DataFrame, unit: str = "day") -> DataFrame:
    """Messages and calls per bucket of time (hour, day, week from Monday, month)."""
    rows = comms.where("timestamp is not null").groupBy(F.date_trunc(unit, "timestamp").alias("bucket"))
    return rows.agg(F.count_if(F.col("type") == "message").alias("messages"), F.count_if(F.col("type") == "call").alias("calls"))


def weekday_hour_heatmap(comms: DataFrame) -> DataFrame:
    """Counts for all 7 x 24 cells, Monday being 0; cells without a communication hold 0."""
    seen = comms.where("timestamp is not null").groupBy(F.weekday("timestamp").alias("weekday"), F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))
    spark = comms.sparkSession
    grid = spark.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(seen, ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("n", F.lit(0)).alias("n"))


def peak_cell(comms: DataFrame) -> DataFrame:
    """The busiest cell of the heat map; ties: lowest hour, then day."""
    return weekday_hour_heatmap(comms).agg(F.max_by(F.struct("weekday", "hour", "n"), F.struct("n", -F.col("hour"), -F.col("weekday"))).alias("p")).select("p.*")


def call_minutes(comms: DataFrame) -> DataFrame:
    """Minutes of each call, 0 where unknown."""
    return comms.where("type = 'call'").select("id", "timestamp", _r(F.coalesce("duration_seconds", F.lit(0)) / 60.0).alias("minutes"))


def call_duration_statistics(comms: DataFrame) -> DataFrame:
    """Count, mean, exact median, sum, minimum and maximum of call minutes above 0."""
    m = F.col("duration_seconds") / 60.0
    rows = comms.where("type = 'call' and duration_seconds > 0")
    return rows.agg(F.count("*").alias("n"), _r(F.avg(m)).alias("mean"), _r(F.percentile(m, F.lit(0.5))).alias("median"), _r(F.sum(m)).alias("total"), _r(F.min(m)).alias("least"), _r(F.max(m)).alias("most"))


def duration_buckets(comms: DataFrame) -> DataFrame:
    """Calls under 1, 5 and 15 minutes and longer."""
    m = F.col("duration_seconds") / 60.0
    name = F.when(m < 1, "< 1 min").when(m < 5, "1-5 min").when(m < 15, "5-15 min").otherwise("> 15 min")
    return comms.where("type = 'call' and duration_seconds > 0").groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def calls_by_hour(comms: DataFrame) -> DataFrame:
    """Number and mean minutes of calls per hour of day."""
    rows = comms.where("type = 'call' and duration_seconds > 0 and timestamp is not null").groupBy(F.hour("timestamp").alias("hour"))
    return rows.agg(F.count("*").alias("n"), _r(F.avg(F.col("duration_seconds") / 60.0)).alias("mean_minutes"))


def top_contact_series(comms: DataFrame, names: DataFrame, n: int = 5) -> DataFrame:
    """Daily counts of the n most active contacts that have a name; names: contact, name (one row per contact)."""
    top = ends(comms).groupBy("contact").agg(F.count("*").alias("total")).join(names, "contact").orderBy(F.desc("total"), "contact").limit(n)
    rows = ends(comms).where("timestamp is not null").join(F.broadcast(top), "contact")
    return rows.groupBy("contact", "name", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


def cumulative_counts(comms: DataFrame, unit: str = "hour") -> DataFrame:
    """Running counts of messages and calls of each case by bucket of time; rows are summed before the window."""
    rows = comms.where("timestamp is not null").groupBy("case_id", F.date_trunc(unit, "timestamp").alias("bucket"))
    rows = rows.agg(F.count_if(F.col("type") == "message").alias("m"), F.count_if(F.col("type") == "call").alias("c"))
    w = Window.partitionBy("case_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("case_id", "bucket", F.sum("m").over(w).alias("messages"), F.sum("c").over(w).alias("calls"))


def spikes(comms: DataFrame, unit: str = "hour", k: float = 2.0) -> DataFrame:
    """Buckets whose volume exceeds mean + k sample standard deviations of the non-empty buckets; one bucket gives none."""
    rows = comms.where("timestamp is not null").groupBy(F.date_trunc(unit, "timestamp").alias("bucket")).agg(F.count("*").alias("volume"))
    stats = rows.agg(F.avg("volume").alias("mean"), F.stddev_samp("volume").alias("std"))
    rows = with_scalars(rows, stats).where(F.col("volume") > F.col("mean") + k * F.col("std"))
    return rows.select("bucket", "volume", _r(F.try_divide(F.col("volume") - F.col("mean"), F.col("std"))).alias("z"))


def top_spikes(comms: DataFrame, n: int = 10) -> DataFrame:
    """The n largest spikes, ties by time."""
    return spikes(comms).orderBy(F.desc("volume"), "bucket").limit(n)


def behaviour_changes(comms: DataFrame, w: int = 7, limit: float = 2.0) -> DataFrame:
    """Days that differ by more than `limit` sample deviations from the w days with rows before them."""
    days = daily_participants(comms)
    order = Window.orderBy("day")  # one row per day
    before = order.rowsBetween(-w, -1)
    rows = days.withColumns({"i": F.row_number().over(order), "mean": F.avg("n").over(before), "std": F.stddev_samp("n").over(before)})
    rows = rows.where((F.col("i") > w) & (F.col("std") > 0)).withColumn("z", (F.col("n") - F.col("mean")) / F.col("std"))
    return rows.where(F.abs("z") > limit).select("day", "n", "participants", _r("z").alias("z"), _r((F.col("n") - F.col("mean")) / F.col("mean") * 100).alias("change_pct"))


def anomaly_summary(comms: DataFrame) -> DataFrame:
    """Shares of late-night and weekend communications in percent."""
    h = F.hour("timestamp")
    return comms.where("timestamp is not null").agg(
        F.count("*").alias("n"), _r(F.avg(((h >= 23) | (h <= 5)).cast("double")) * 100).alias("late_night_pct"), _r(F.avg((F.weekday("timestamp") >= 5).cast("double")) * 100).alias("weekend_pct"))


def gaps_between(comms: DataFrame, least_hours: float = 24.0) -> DataFrame:
    """Gaps of more than least_hours between successive communications of one sender."""
    rows = previous(comms.where("timestamp is not null and length(sender) > 0"), ["sender"], ["timestamp"], ["timestamp", "id"])
    hours = (F.unix_micros("timestamp") - F.unix_micros("before.timestamp")) / 3.6e9
    return rows.withColumn("gap_hours", hours).where(F.col("gap_hours") > least_hours).select("sender", F.col("before.timestamp").alias("from_at"), F.col("timestamp").alias("to_at"), _r("gap_hours").alias("gap_hours"))


def gap_histogram(comms: DataFrame, most_hours: int | None = None) -> DataFrame:
    """Gaps of each sender by whole hours, up to most_hours if given."""
    rows = gaps_between(comms, -1.0)
    rows = rows.where(F.col("gap_hours") <= most_hours) if most_hours is not None else rows
    return rows.groupBy(F.floor("gap_hours").alias("hours")).agg(F.count("*").alias("n"))


def zero_filled_daily(comms: DataFrame) -> DataFrame:
    """Counts of every day between the first and the last one, 0 where nothing happened."""
    days = comms.where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def temporal_evolution(comms: DataFrame, windows: int = 10, inclusive_end: bool = False) -> DataFrame:
    """Nodes, edges, density and count in equal half-open windows of the whole span; the last instant itself falls outside
    unless inclusive_end is set."""
    rows = comms.where("timestamp is not null and length(sender) > 0 and length(receiver) > 0")
    span = rows.agg(F.min(F.unix_micros("timestamp")).alias("lo"), F.max(F.unix_micros("timestamp")).alias("hi"))
    at = F.floor((F.unix_micros("timestamp") - F.col("lo")) * windows / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    rows = with_scalars(rows, span).withColumn("w", at.cast("int"))
    rows = rows.withColumn("w", F.least("w", F.lit(windows - 1))) if inclusive_end else rows.where(F.col("w") < windows)
    edges = rows.groupBy("w").agg(F.count("*").alias("n"), F.countDistinct("sender", "receiver").alias("edges"))
    nodes = ends(rows).groupBy("w").agg(F.countDistinct("contact").alias("nodes"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return edges.join(nodes, "w").select(F.col("w").alias("window"), "nodes", "edges", _r(density).alias("density"), "n")


def volume_histogram(comms: DataFrame, bins: int = 50) -> DataFrame:
    """Hourly volumes in equal-width bins; the largest value belongs to the last bin."""
    rows = comms.where("timestamp is not null").groupBy(F.date_trunc("hour", "timestamp").alias("h")).agg(F.count("*").alias("v"))
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1))
    return with_scalars(rows, span).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


# flows and replies


def flows(comms: DataFrame) -> DataFrame:
    """Directed pairs with their weight, messages and calls; ends must not be empty."""
    rows = comms.where("length(sender) > 0 and length(receiver) > 0").groupBy(F.col("sender").alias("src"), F.col("receiver").alias("dst"))
    return rows.agg(F.count("*").alias("weight"), F.count_if(F.col("type") == "call").alias("calls"), F.count_if(F.col("type") == "message").alias("messages"))


def sankey_flows(comms: DataFrame, contacts: int = 15, most: int = 100) -> DataFrame:
    """The largest flows among the most active contacts."""
    edges = flows(comms)
    totals = edges.select(F.col("src").alias("c"), "weight").unionByName(edges.select(F.col("dst").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("total"))
    top = F.broadcast(totals.orderBy(F.desc("total"), "c").limit(contacts).select("c"))  # at most `contacts` rows
    kept = edges.join(top, edges.src == top.c, "left_semi").join(top, F.col("dst") == top.c, "left_semi")
    return kept.orderBy(F.desc("weight"), "src", "dst").limit(most).select("src", "dst", "weight")


def replies(comms: DataFrame, most_minutes: int = 1440) -> DataFrame:
    """Replies: rows whose sender received the pair's previous row, with the minutes between (above 0, below most_minutes)."""
    rows = comms.where("timestamp is not null and length(sender) > 0 and length(receiver) > 0")
    rows = rows.withColumns({"__x": F.least("sender", "receiver"), "__y": F.greatest("sender", "receiver")})
    rows = previous(rows, ["__x", "__y"], ["receiver", "timestamp"], ["timestamp", "id"])
    minutes = (F.unix_micros("timestamp") - F.unix_micros("before.timestamp")) / 6e7
    rows = rows.where(F.col("before.receiver") == F.col("sender")).withColumn("minutes", minutes)
    return rows.where((F.col("minutes") > 0) & (F.col("minutes") < most_minutes)).select("id", "sender", "receiver", _r("minutes").alias("minutes"))


def response_statistics(comms: DataFrame) -> DataFrame:
    """Number, share within five minutes, mean, median, least and most of reply minutes."""
    m = F.col("minutes")
    return replies(comms).agg(
        F.count("*").alias("n"), _r(F.avg((m <= 5).cast("double"))).alias("quick_share"), _r(F.avg(m)).alias("mean"), _r(F.percentile(m, F.lit(0.5))).alias("median"),
        _r(F.min(m)).alias("least"), _r(F.max(m)).alias("most"))


def timeline(comms: DataFrame, limit: int | None = None) -> DataFrame:
    """All communications as one timeline in order, with a short summary; the first `limit` rows if given."""
    rows = comms.where("timestamp is not null")
    rows = rows.select("timestamp", "case_id", "type", "id", F.substring(F.concat_ws(" -> ", "sender", "receiver"), 1, 100).alias("summary")).orderBy("timestamp", "id")
    return rows.limit(limit) if limit else rows


def resampled(comms: DataFrame) -> DataFrame:
    """Counts of every day, or of every hour if all lies within two days, between the first and the last one, 0 where nothing happened."""
    span = comms.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).where("lo is not null")
    hourly = F.unix_micros("hi") - F.unix_micros("lo") <= 2 * 86_400_000_000
    hours = F.sequence(F.date_trunc("hour", "lo"), F.date_trunc("hour", "hi"), F.expr("interval 1 hour"))
    days = F.sequence(F.date_trunc("day", "lo"), F.date_trunc("day", "hi"), F.expr("interval 1 day"))
    all_ = span.select(hourly.alias("hourly"), F.explode(F.when(hourly, hours).otherwise(days)).alias("bucket"))
    seen = with_scalars(comms.where("timestamp is not null"), span.select(hourly.alias("hourly")))
    seen = seen.groupBy(F.when(F.col("hourly"), F.date_trunc("hour", "timestamp")).otherwise(F.date_trunc("day", "timestamp")).alias("bucket")).agg(F.count("*").alias("n"))
    return all_.join(seen, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def voice_islands(frames: DataFrame, share: float = 0.5, keep_open: bool = False) -> DataFrame:
    """Stretches of frames (source, frame, energy) whose energy exceeds `share` of the source's mean: source, first, last, frames.

    A stretch that runs to the source's last frame is left out unless keep_open. Nulls take no part.
    """
    rows = frames.where("source is not null and frame is not null and energy is not null")
    stats = rows.groupBy("source").agg(F.avg("energy").alias("mean"), F.max("frame").alias("end"))
    loud = rows.join(stats, "source").where(F.col("energy") > share * F.col("mean")).select("source", "frame", "end")
    own = loud.withColumn("island", F.col("frame") - F.row_number().over(Window.partitionBy("source").orderBy("frame")))
    out = own.groupBy("source", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames"), F.first("end").alias("end"))
    return out.where(F.lit(keep_open) | (F.col("last") < F.col("end"))).select("source", "first", "last", "frames")
