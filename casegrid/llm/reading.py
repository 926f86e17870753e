"""Reading level of documents (problem 10).

Each word gets an acquisition grade from its distribution over graded texts: the level by which a fixed part of its
uses, weighted so that all levels count alike, has been reached. A document's level is predicted from quantiles of the
grades of its known words, by a regression calibrated on graded documents, and monotone recalibration to their scale.

The model is fitted on a bounded sample of graded documents (`Settings.max_documents`, chosen by a hash of the id) and
holds their words, all that occur in enough of them; everything else runs over whole texts of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.session import table


@dataclass(frozen=True)
class Settings:
    """max_documents bounds the sample, and so the model; the rest shapes the estimate."""

    max_documents: int = 20_000
    least_documents: int = 3
    acquired: float = 0.25
    levels: int = 5
    quantiles: tuple[float, ...] = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)
    least_known: float = 0.6
    least_words: int = 60


_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def words(text: str | None) -> list[str]:
    """Lower-case words of a text, inner hyphens and apostrophes included; none for a null."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    grades: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    knots: tuple[np.ndarray, np.ndarray] = (np.array([1.0, 5.0]), np.array([1.0, 5.0]))
    settings: Settings = Settings()

    def features(self, text: str | None) -> tuple[np.ndarray, float, int]:
        """(quantiles and mean of the known words' grades, known share, number of words)."""
        own = words(text)
        known = [g for w in own if (g := self.grades.get(w)) is not None]
        if not known:
            return np.zeros(len(self.settings.quantiles) + 1), 0.0, len(own)
        a = np.array(known)
        return np.append(np.quantile(a, self.settings.quantiles), a.mean()), len(known) / len(own), len(own)

    def level(self, features: np.ndarray) -> np.ndarray:
        """Calibrated level of rows of features."""
        raw = np.column_stack([np.ones(len(features)), features]) @ self.weights
        return np.clip(np.interp(raw, *self.knots), 1, self.settings.levels)


def word_grades(counts: pd.DataFrame, totals: np.ndarray, settings: Settings) -> dict[str, float]:
    """Grade of each word from its number of documents at each level (columns word, level, n)."""
    wide = counts.pivot_table(index="word", columns="level", values="n", aggfunc="sum", fill_value=0.0)
    wide = wide.reindex(columns=range(1, settings.levels + 1), fill_value=0.0)
    share = wide.to_numpy() / np.maximum(totals, 1.0)
    share /= share.sum(axis=1, keepdims=True)
    reached = np.column_stack([np.zeros(len(share)), np.cumsum(share, axis=1)])
    at = np.arange(settings.levels + 1) + 0.5
    k = np.clip((reached < settings.acquired).sum(axis=1), 1, settings.levels)
    i = np.arange(len(share))
    low, high = reached[i, k - 1], reached[i, k]
    grade = at[k - 1] + (settings.acquired - low) / np.maximum(high - low, 1e-9)
    return dict(zip(wide.index, grade.round(4)))


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of an increasing step-free fit by pooling adjacent violators over twenty equal groups."""
    order = np.argsort(x, kind="stable")
    groups = [g for g in np.array_split(order, min(20, max(2, len(order) // 10))) if len(g)]
    blocks = [[float(x[g].mean()), float(y[g].mean()), len(g)] for g in groups]
    out: list[list[float]] = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][1] > out[-1][1]:
            q, p = out.pop(), out.pop()
            n = p[2] + q[2]
            out.append([(p[0] * p[2] + q[0] * q[2]) / n, (p[1] * p[2] + q[1] * q[2]) / n, n])
    return np.array([b[0] for b in out]), np.array([b[1] for b in out])


def _regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge regression with Huber weights, since raters now and then err by a level."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.eye(x.shape[1]) * 1e-2
    penalty[0, 0] = 0
    weight = np.ones(len(y))
    for _ in range(20):
        w = np.linalg.solve((x * weight[:, None]).T @ x + penalty, (x * weight[:, None]).T @ y)
        weight = np.minimum(1.0, 0.5 / np.maximum(np.abs(y - x @ w), 1e-9))
    return w


def graded_sample(labels: DataFrame, documents: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text, level): the mean label of each graded document, at most max_documents of them by hash."""
    mean = labels.where(F.col("level").between(1, settings.levels)).groupBy("doc_id").agg(F.avg("level").alias("level"))
    mean = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_documents)
    return documents.select("doc_id", "text").where("text is not null").join(F.broadcast(mean), "doc_id")


def fit(labels: DataFrame, documents: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Model of a bounded graded sample; None if there are fewer than ten graded documents."""
    sample = graded_sample(labels, documents, settings)

    @F.pandas_udf("array<string>")
    def distinct_words(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(set(words(t))))

    low = F.floor("level").cast("int")
    part = F.col("level") - low
    both = F.explode(F.array(F.struct(low.alias("level"), (1 - part).alias("n")), F.struct((low + 1).alias("level"), part.alias("n"))))
    rows = sample.withColumn("words", distinct_words("text")).withColumn("both", both).where("both.n > 0")
    rows = rows.select("doc_id", F.col("both.level").alias("level"), F.col("both.n").alias("n"), "words").persist()
    try:
        totals = {r["level"]: r["n"] for r in rows.groupBy("level").agg(F.sum("n").alias("n")).collect()}
        if sum(totals.values()) < 10:
            return None
        per = rows.select("level", "n", F.explode("words").alias("word")).groupBy("word", "level").agg(F.sum("n").alias("n"))
        best = per.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("level", "n")).alias("by"))
        best = best.where(F.col("all") >= settings.least_documents).orderBy("word")
        counts = pd.DataFrame([(r["word"], b["level"], b["n"]) for r in best.collect() for b in r["by"]], columns=["word", "level", "n"])
    finally:
        rows.unpersist()
    model = Model(word_grades(counts, np.array([totals.get(k, 0.0) for k in range(1, settings.levels + 1)]), settings), settings=settings)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"level": f["level"], "features": [model.features(t)[0].tolist() for t in f["text"]]})

    seen = sample.select("text", "level").mapInPandas(measure, "level double, features array<double>").toPandas()
    seen = seen.sort_values("level", kind="stable")
    x, y = np.array(seen["features"].tolist()), seen["level"].to_numpy()
    order = np.lexsort(np.round(x, 9).T)
    x, y = x[order], y[order]
    model.weights = _regress(x, y)
    raw = np.column_stack([np.ones(len(x)), x]) @ model.weights
    model.knots = _monotone(raw, y)
    return model


def levels(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_words (by white space), known_share, level (null where no word is known) of every document.

    Null and empty texts have no words and no level; without a model no document has a level. Repeated documents give
    repeated rows; other columns are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [len(t.split()) if t else 0 for t in f["text"]]
            if model is None:
                yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": n, "known_share": 0.0, "level": None})
                continue
            found = [model.features(t) for t in f["text"]]
            level = model.level(np.array([x[0] for x in found]).reshape(len(found), -1))
            share = np.array([x[1] for x in found])
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": n, "known_share": share, "level": pd.Series(level, index=f.index).where(share > 0)})

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n_words int, known_share double, level double")


def p10_levels(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Reading level of every document."""
    documents = table(spark, sf_dir, "documents")
    return levels(documents, fit(table(spark, sf_dir, "reading_labels"), documents, settings))


def p10_found(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Documents of English prose of at least 60 words at level 4 or 5 (from 3.5 up)."""
    found = p10_levels(spark, sf_dir, settings)
    chosen = (F.col("n_words") >= settings.least_words) & (F.col("known_share") >= settings.least_known) & (F.col("level") >= 3.5)
    return found.where(chosen).select("doc_id").distinct()
