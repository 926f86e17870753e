"""Mixing sources to target weights (problem 9) by weighted sampling without replacement (Efraimidis and Spirakis).

Each source gets a budget of tokens from its target share. What the budget holds of whole epochs over the source comes first; the rest
is a fractional selection: documents get exponential keys -ln(u) / w, u from a hash of the id and w a quality weight, and are taken
in order of their keys up to the budget. The order is never made in one task: token sums over fine ranges of the key give the
range in which the budget ends, and only documents of that range are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegrid.llm import tokens
from casegrid.session import cut, table, with_scalars


@dataclass(frozen=True)
class Settings:
    """total: tokens wanted, by default the most that all shares allow; ranges: ranges of the key per source."""

    total: int | None = None
    ranges: int = 65_536
    seed: int = 11
    tokenizer: str | None = None


def quality(text: Column) -> Column:
    """Quality weight of a text: its share of letters and blanks, less for very short texts; at least 0.05."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), letters * (1 - F.exp(-F.length(text) / 300.0)))


def sized(documents: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, source, tokens, key) of documents with a source and at least one token."""
    path = settings.tokenizer or tokens.default_path()

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(lambda t: tokens.count(t, path))

    count = F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)
    u = (F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").where("length(source) > 0 and length(text) > 0")
    return rows.select("doc_id", "source", count("text").alias("tokens"), (-F.log(u) / quality(F.col("text"))).alias("key")).where("tokens > 0")


def budgets(rows: DataFrame, targets: DataFrame, settings: Settings) -> DataFrame:
    """One row per target source: available tokens, whole epochs, rest of the budget, wanted tokens.

    Sources without documents give nothing and the other shares are scaled up; a cap that binds leaves the wanted total unmet.
    """
    want = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("length(source) > 0 and target_share > 0 and max_repeats > 0")
    have = rows.groupBy("source").agg(F.sum("tokens").alias("available"))
    both = want.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    live = both.where("available > 0").agg(F.sum("target_share").alias("live"), F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("most"))
    both = with_scalars(both, live)  # one row
    total = F.lit(settings.total) if settings.total else F.floor(F.col("most") * F.col("live"))
    wanted = F.when(F.col("available") > 0, F.floor(F.least(F.col("target_share") / F.col("live") * total, F.col("available") * F.col("max_repeats")))).otherwise(0)
    both = both.withColumn("wanted", wanted.cast("long")).withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("wanted") / F.col("available"))).otherwise(0).cast("int"))
    return both.withColumn("rest", F.col("wanted") - F.col("epochs") * F.col("available")).select("source", "target_share", "max_repeats", "available", "wanted", "epochs", "rest")


def mix(documents: DataFrame, targets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents taken, copies being how often each is repeated."""
    rows = cut(sized(documents, settings))
    plan = cut(budgets(rows, targets, settings))
    rows = rows.join(plan.select("source", "epochs", "rest"), "source")
    rows = rows.withColumn("range", F.floor(F.col("key") / (1 + F.col("key")) * settings.ranges))
    sums = rows.groupBy("source", "range").agg(F.sum("tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("source", "range", "sum", before.alias("before")), ["source", "range"])
    whole = F.col("before") + F.col("sum") <= F.col("rest")
    split = ~whole & (F.col("before") < F.col("rest"))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(split).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    ends = ends.withColumn("copies", F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int"))
    rest = rows.where(~split).withColumn("copies", F.col("epochs") + whole.cast("int"))
    columns = ["doc_id", "source", "tokens", "copies"]
    return rest.select(*columns).unionByName(ends.select(*columns)).where("copies > 0")


def p9_mixture(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Documents of the mixture and how often each is repeated."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), settings)


def p9_shares(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Target and reached share of each source of mix_targets."""
    got = p9_mixture(spark, sf_dir, settings).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("repeats"))
    targets = table(spark, sf_dir, "mix_targets").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    both = cut(targets.join(got, "source", "left").fillna(0, ["tokens", "repeats"]))
    total = both.agg(F.sum("tokens").alias("total"))
    return with_scalars(both, total).select("source", "target_share", "tokens", "repeats", F.round(F.try_divide("tokens", "total"), 6).alias("actual_share"))
