"""Filling containers of fixed capacity with texts (problem 8) by vector bin packing.

Every text, or piece of one longer than the capacity, asks for tokens, one segment and loss-bearing tokens (in a dialogue those of
all speakers but the first, else all). A container limits all three. The dot-product heuristic fills one container at a time with
the fitting item whose demand, in shares of the limits, has the largest dot product with the room left; so a container
short of room for loss draws items that bear little. A text that fits the capacity is never split: where it alone bears more loss than
the limit, it takes up the whole limit, and nothing that bears loss joins it.

Items are spread over buckets by a hash; a bucket is packed in one task and holds some thousand items, however many
there are in all, so that at most one container per bucket stays underfilled for want of items. Items of equal demand are one class,
and only classes that still fit are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm import tokens
from casegrid.session import cut, table


@dataclass(frozen=True)
class Settings:
    """per_bucket: items packed together; a container takes capacity / tokens_per_segment segments, and loss_share of it in loss;
    balance: weight of the gap between the rooms for tokens and loss against the dot product."""

    per_bucket: int = 4000
    tokens_per_segment: int = 64
    loss_share: float = 0.95
    balance: float = 1.0
    tokenizer: str | None = None


#: Capacities a call may pack for; more are refused, none is left out.
MAX_SPECS = 1000
_SPEAKER = re.compile(r"^([A-Z]):", re.M)


def _is_dialogue(text: str) -> bool:
    """Whether two different speakers begin a line anywhere in a text."""
    first = None
    for m in _SPEAKER.finditer(text):
        if first is None:
            first = m.group(1)
        elif m.group(1) != first:
            return True
    return False


def runs(text: str | None, path: str) -> list[tuple[int, bool]]:
    """(tokens, whether they bear loss) of successive parts of a text: the lines of a dialogue, else the whole."""
    if not text:
        return []
    if not _is_dialogue(text):
        n = tokens.count(text, path)
        return [(n, True)] if n else []
    first = _SPEAKER.search(text).group(1)
    out, who = [], first
    for line in text.splitlines(keepends=True):
        if m := _SPEAKER.match(line):
            who = m.group(1)
        out.append((tokens.count(line, path), who != first))
    return [x for x in out if x[0]]


def limits_of(capacity: int, settings: Settings) -> np.ndarray:
    """Limits of a container on tokens, segments and loss-bearing tokens."""
    return np.array([capacity, max(1, capacity // settings.tokens_per_segment), max(1, int(capacity * settings.loss_share))], dtype=float)


def pieces(parts: list[tuple[int, bool]], capacity: int, most_loss: int | None = None) -> list[tuple[int, int]]:
    """(tokens, loss) of the pieces of a text: one if its tokens fit, else pieces as long as the limits on tokens and loss allow."""
    most_loss = capacity if most_loss is None else max(1, most_loss)
    total, loss = sum(n for n, _ in parts), sum(n for n, bears in parts if bears)
    if total <= capacity:
        return [(total, loss)] if total else []
    out, size, own = [], 0, 0
    for n, bears in parts:
        while n:
            take = min(n, capacity - size, most_loss - own if bears else n)
            if take <= 0:
                out.append((size, own))
                size = own = 0
                continue
            size, own, n = size + take, own + take * bears, n - take
    return out + [(size, own)] if size else out


def pack(demand: np.ndarray, limits: np.ndarray, balance: float = 1.0) -> np.ndarray:
    """Container number of each item (rows: tokens, segments, loss), by the dot-product heuristic. No item may exceed a limit."""
    place = np.full(len(demand), -1)
    if not len(demand):
        return place
    classes, of, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    need, left = classes / limits, count.copy()
    members = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(count)[:-1])
    total = np.sort(demand[:, [0, -1]].sum(axis=0) / limits[[0, -1]])
    balance = balance * float(total[0] / max(total[1], 1e-12)) ** 2  # where one limit hardly matters, its gap doesn't either
    number, live = 0, np.arange(len(classes))
    while len(live):
        room, fits = np.ones(demand.shape[1]), live
        while len(fits):
            after = room - need[fits]
            i = fits[int((need[fits] @ room - balance * np.abs(after[:, 0] - after[:, -1])).argmax())]
            left[i] -= 1
            place[members[i][left[i]]] = number
            room = room - need[i]
            fits = fits[(need[fits] <= room + 1e-12).all(axis=1) & (left[fits] > 0)]
        live, number = live[left[live] > 0], number + 1
    return place


def containers(documents: DataFrame, specs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(spec_name, container_id, doc_id, piece, tokens, loss_tokens): the container of every text or piece.

    Null and empty texts have no tokens and no row. Rows with a repeated doc_id are items of their own. The table of
    capacities is small; rows without a name or a positive capacity are ignored.
    """
    path = settings.tokenizer or tokens.default_path()
    names = [(r["spec_name"], int(r["capacity_tokens"])) for r in specs.where("spec_name is not null and capacity_tokens > 0").distinct().take(MAX_SPECS + 1)]
    if len(names) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, seen = [], {}
            for i, t in zip(f["doc_id"], f["text"]):
                if t not in seen:
                    seen[t] = runs(t, path)
                parts = seen[t]
                for name, capacity in names:
                    found = pieces(parts, capacity, int(capacity * settings.loss_share))
                    out += [(name, capacity, i, k, n, loss) for k, (n, loss) in enumerate(found)]
            yield pd.DataFrame(out, columns=["spec_name", "capacity", "doc_id", "piece", "tokens", "loss_tokens"])

    items = documents.select("doc_id", "text").where(F.length("text") > 0)
    items = cut(items.mapInPandas(measure, "spec_name string, capacity int, doc_id long, piece int, tokens int, loss_tokens int"))
    buckets = {r["spec_name"]: max(1, -(-r["n"] // settings.per_bucket)) for r in items.groupBy("spec_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not buckets:
        return items.select("spec_name", F.lit("").alias("container_id"), "doc_id", "piece", "tokens", "loss_tokens")
    size = F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])[F.col("spec_name")]
    spread = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "tokens"), size))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        capacity = int(rows["capacity"].iat[0])
        limits = limits_of(capacity, settings)
        demand = np.minimum(np.column_stack([rows["tokens"], np.ones(len(rows)), rows["loss_tokens"]]), limits)
        rows["container_id"] = [f"{rows['spec_name'].iat[0]}-{rows['bucket'].iat[0]}-{k}" for k in pack(demand, limits, settings.balance)]
        return rows[["spec_name", "container_id", "doc_id", "piece", "tokens", "loss_tokens"]]

    return spread.groupBy("spec_name", "bucket").applyInPandas(fill, "spec_name string, container_id string, doc_id long, piece int, tokens int, loss_tokens int")


def p8_containers(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Containers of all documents for each capacity."""
    return containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"), settings)


def p8_fill(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """For each capacity: number of containers, tokens held, shares of the room for tokens, segments and loss that are used, and how many
    containers are full in segments or in loss though two in a hundred or more of their tokens are free.

    A single text that bears more loss than the limit counts as the limit.
    """
    specs = table(spark, sf_dir, "container_specs").select("spec_name", F.col("capacity_tokens").cast("double").alias("c")).distinct()
    one = p8_containers(spark, sf_dir, settings).groupBy("spec_name", "container_id").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss")).join(specs, "spec_name")
    most_segments, most_loss = F.greatest(F.lit(1.0), F.floor(F.col("c") / settings.tokens_per_segment)), F.greatest(F.lit(1.0), F.floor(F.col("c") * settings.loss_share))
    one = one.withColumns({"s": F.col("segments") / most_segments, "l": F.least(F.col("loss") / most_loss, F.lit(1.0)), "t": F.col("tokens") / F.col("c")})
    mean = lambda c: F.round(F.avg(c), 6)
    return one.groupBy("spec_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), mean("t").alias("used"), mean("s").alias("used_segments"), mean("l").alias("used_loss"),
        F.count_if((F.col("s") >= 1) & (F.col("t") <= 0.98)).alias("full_in_segments"), F.count_if((F.col("l") >= 0.99) & (F.col("t") <= 0.98)).alias("full_in_loss"))
