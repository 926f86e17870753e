"""Retrieval: documents from rows, keyword ranking, vector search, rank fusion.

Ranks are columns, never an implied order. Keyword and vector search take a table of queries against all rows; filters come
first, so that a search with a filter never returns fewer rows than match. Null and empty texts have no terms and never match.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegrid.session import with_scalars


# English stop words left out of the keyword index.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]
K1, B = 1.5, 0.75


def terms(text: Column) -> Column:
    """Lower-case words of two characters or more, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def _known(*columns: str) -> Column:
    """The first of several columns that isn't null, else Unknown."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns], F.lit("Unknown"))


def _part(before: str, c: Column | str, after: str = "") -> Column:
    """A piece of a document, empty where its value is null or empty."""
    v = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(F.length(v) > 0, F.concat(F.lit(before), v, F.lit(after))).otherwise("")


def _chunk(rows: DataFrame, kind: str, short: str, key: str, document: Column, **meta: Column | str) -> DataFrame:
    """(case_id, doc_id, data_type, document, metadata); metadata hold '' for nulls."""
    values = {"data_type": F.lit(kind), "case_id": F.col("case_id"), **{k: F.col(v) if isinstance(v, str) else v for k, v in meta.items()}}
    as_map = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    doc_id = F.concat(F.coalesce("case_id", F.lit("")), F.lit(f"_{short}_"), F.col(key).cast("string"))
    return rows.select(F.col("case_id"), doc_id.alias("doc_id"), F.lit(kind).alias("data_type"), document.alias("document"), as_map.alias("metadata"))


def chunk_messages(m: DataFrame) -> DataFrame:
    """Messages as documents: app, ends as written, time and text; nulls of app and ends read Unknown."""
    text = F.concat(F.lit("["), _known("app"), F.lit("] Message from "), _known("sender_raw", "sender_digits"), F.lit(" to "), _known("receiver_raw", "receiver_digits"), _part(" at ", "timestamp"), _part(": ", "text"))
    return _chunk(m, "message", "msg", "msg_id", text, app="app", sender=F.coalesce("sender_raw", "sender_digits"), receiver=F.coalesce("receiver_raw", "receiver_digits"), timestamp="timestamp", direction=F.lit(""))


def chunk_contacts(c: DataFrame) -> DataFrame:
    """Contacts as documents: name, number and e-mail."""
    phone = F.coalesce(F.nullif("phone_raw", F.lit("")), F.col("phone_digits"))
    text = F.concat(F.lit("Contact: "), _known("name"), _part(" | Phone: ", phone), _part(" | Email: ", "email"))
    return _chunk(c, "contact", "contact", "contact_id", text, name="name", phone=phone, email="email")


def chunk_calls(c: DataFrame) -> DataFrame:
    """Calls as documents: direction, ends, duration as `1m 5s` and time."""
    s = F.col("duration_seconds")
    took = F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).when(s > 0, F.concat(s.cast("string"), F.lit("s")))
    way = F.when(F.length("direction") > 0, F.concat(F.upper(F.substring("direction", 1, 1)), F.lower(F.substring("direction", 2, 1000)))).otherwise("Call")
    text = F.concat(way, F.lit(" call from "), _known("caller_raw", "caller_digits"), F.lit(" to "), _known("receiver_raw", "receiver_digits"), _part(" | Duration: ", took), _part(" | ", "timestamp"))
    return _chunk(c, "call", "call", "call_id", text, caller=F.coalesce("caller_raw", "caller_digits"), receiver=F.coalesce("receiver_raw", "receiver_digits"), direction="direction", duration=F.when(s != 0, s), timestamp="timestamp")


def chunk_media(m: DataFrame) -> DataFrame:
    """Media as documents: file, type, size, time and caption."""
    size = F.when(F.col("file_size") != 0, F.col("file_size"))
    text = F.concat(F.lit("Media file: "), _known("filename"), _part(" | Type: ", "media_type"), _part(" | Size: ", size), _part(" | ", "timestamp"), _part(" | Caption: ", "caption"))
    return _chunk(m, "media", "media", "media_id", text, filename="filename", media_type="media_type", timestamp="timestamp")


def chunk_places(p: DataFrame) -> DataFrame:
    """Places (id, case_id, latitude, longitude, timestamp) as documents."""
    text = F.concat(F.lit("Location: ("), F.col("latitude").cast("string"), F.lit(", "), F.col("longitude").cast("string"), F.lit(")"), _part(" | ", "timestamp"))
    return _chunk(p.where("latitude is not null and longitude is not null"), "location", "loc", "id", text, latitude="latitude", longitude="longitude", source=F.lit(""), timestamp="timestamp")


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A text's terms counted into `size` places by their CRC-32, scaled to length 1; zeros for no terms. It stands in for the vectors of a
    model, which come as a column."""

    @F.pandas_udf("array<double>")
    def of(rows: pd.Series) -> pd.Series:
        import zlib

        def one(words) -> list[float]:
            v = np.bincount([zlib.crc32(w.encode()) % size for w in words], minlength=size).astype(float) if words is not None and len(words) else np.zeros(size)
            return (v / (np.linalg.norm(v) or 1.0)).tolist()

        return rows.map(one)

    return of(terms(text))


def case_index(parts: list[DataFrame]) -> DataFrame:
    """The index of cases: documents of chunk_*, one per doc_id, without blank ones, with their vectors."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where(F.length(F.trim("document")) > 0).dropDuplicates(["doc_id"]).withColumn("vec", hashed_vector(F.col("document")))


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl) of docs (doc_id, text)."""
    t = docs.select("doc_id", terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query (query_id, query): (query_id, doc_id, score, rank), only with a score above 0.

    Postings are cut down to the queries' terms before scores are summed.
    """
    p = postings(docs)
    stats = docs.select(F.size(terms(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    hit = p.join(q.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    rows = with_scalars(hit.join(df, "term").join(q, "term"), stats)  # stats is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(s), 6).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


#: Bytes of query vectors that go to the tasks at once.
MAX_QUERY_BYTES = 64_000_000


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, most_distance: float | None = None, block: int = 512, most_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """The k nearest vectors (id, vec) of each query (query_id, q) by inner product: (query_id, id, distance, rank).

    Exact. Each scan of the vectors takes as many queries as fit into most_bytes; a task compares them in blocks of `block` and keeps its
    k best of each query over all its rows, so that only tasks x queries x k rows are shuffled. Null vectors never match.
    """
    parts = []
    for blocks in _blocks(queries.select("query_id", "q").where("q is not null").orderBy("query_id"), block, most_bytes):
        shared = vectors.sparkSession.sparkContext.broadcast(blocks)

        def run(frames, shared=shared):
            best: list = [None] * len(shared.value)
            for f in frames:
                f = f[f["vec"].notna()]
                if not len(f):
                    continue
                m, own = np.array(f["vec"].tolist(), dtype=np.float64).T, f["id"].to_numpy()
                for n, (ids, matrix) in enumerate(shared.value):
                    s = matrix @ m
                    who = np.broadcast_to(own, s.shape)
                    if best[n] is not None:
                        s, who = np.hstack([best[n][0], s]), np.hstack([best[n][1], who])
                    take = np.array([np.lexsort((who[i], -s[i]))[:k] for i in range(len(ids))])
                    best[n] = np.take_along_axis(s, take, 1), np.take_along_axis(who, take, 1)
            for (ids, _), found in zip(shared.value, best):
                if found is not None:
                    yield pd.DataFrame({"query_id": np.repeat(ids, found[0].shape[1]), "id": found[1].ravel(), "s": found[0].ravel()})

        parts.append(vectors.select("id", "vec").mapInPandas(run, "query_id long, id long, s double"))
    if not parts:
        return vectors.where("false").select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "id")
    out = all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = out.select("query_id", "id", F.round(1 - F.col("s"), 6).alias("distance"), "rank")
    return out.where(F.col("distance") <= most_distance) if most_distance is not None else out


def _blocks(queries: DataFrame, block: int, most_bytes: int):
    """Lists of (ids, matrix) of at most `block` queries each, a list holding at most most_bytes (but one block at least)."""
    out, ids, rows, held = [], [], [], 0
    for r in queries.toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["q"])
        if len(ids) == block:
            out.append((np.array(ids), np.array(rows, dtype=np.float64)))
            held += out[-1][1].nbytes
            ids, rows = [], []
            if held + block * len(out[-1][1][0]) * 8 > most_bytes:
                yield out
                out, held = [], 0
    if ids:
        out.append((np.array(ids), np.array(rows, dtype=np.float64)))
    if out:
        yield out


def search_cases(index: DataFrame, queries: DataFrame, case_ids: list[str], k: int = 10, most_distance: float = 1.5) -> DataFrame:
    """The k nearest vectors (id, case_id, vec) of each query within some cases and a distance; as the best of all cases are among each case's
    best, the cases are searched together."""
    return vector_search(index.where(F.col("case_id").isin(case_ids)), queries, k, most_distance)


def keyword_lists(docs: DataFrame, question: str, k: int) -> DataFrame:
    """(case_id, doc_id, score, rank): the k best documents of each case (case_id, doc_id, document) for a question, by a case's own statistics."""
    p = docs.select("case_id", "doc_id", terms(F.col("document")).alias("t"))
    stats = p.groupBy("case_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    q = docs.sparkSession.createDataFrame([(question,)], "q string").select(F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
    hit = p.select("case_id", "doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(q, "term", "left_semi").groupBy("case_id", "doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = hit.groupBy("case_id", "term").agg(F.count("*").alias("df"))
    rows = hit.join(df, ["case_id", "term"]).join(stats, "case_id")
    s = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("case_id", "doc_id").agg(F.round(F.sum(s), 6).alias("score")).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def retrieve(index: DataFrame, question: str, case_ids: list[str], n: int = 20, kind: str | None = None, rerank=None) -> DataFrame:
    """(doc_id, case_id, data_type, document, score, position): the best documents of cases for a question, from case_index.

    The kind of record asked for, if the question names one, is a filter before both searches. A broad question takes at least 50 documents
    and vectors up to a distance of 1.5, another one up to 0.55. The list by vectors and one list by keywords per case are fused
    by their ranks; `rerank`, a function of a DataFrame with these columns, may order them anew.
    """
    kind, broad = kind or route(question), is_broad(question)
    size = max(n, 50) if broad else n
    docs = index.where(F.col("case_id").isin(case_ids))
    docs = docs.where(F.col("data_type") == kind) if kind else docs
    q = docs.sparkSession.createDataFrame([(question,)], "q string").select(hashed_vector(F.col("q")).alias("q")).first()[0]
    near = docs.select("doc_id", F.round(1 - dot(F.col("vec"), F.array(*map(F.lit, q))), 6).alias("distance")).where(F.col("distance") <= (1.5 if broad else 0.55))
    near = near.orderBy("distance", "doc_id").limit(size)
    near = near.select(F.lit("0").alias("list_id"), "doc_id", F.row_number().over(Window.orderBy("distance", "doc_id")).alias("rank"))  # `size` rows
    words = keyword_lists(docs, question, size).select(F.concat(F.lit("1:"), "case_id").alias("list_id"), "doc_id", "rank")
    merged = fuse(near.unionByName(words)).orderBy(F.desc("score"), "first_list", "doc_id").limit(size)
    merged = merged.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "first_list", "doc_id")))
    out = docs.join(merged, "doc_id").select("doc_id", "case_id", "data_type", "document", "score", "position")
    return rerank(out) if rerank else out


class QueryCache:
    """Results by question, cases, number and kind, the least recently used one dropped beyond `size`."""

    def __init__(self, size: int = 200) -> None:
        self.size, self.held = size, OrderedDict()

    def get(self, question: str, case_ids: list[str], n: int, kind: str | None, make):
        """The stored result, or that of make(), which is stored."""
        raw = "|".join([question.strip().lower(), *sorted(case_ids), str(n), kind or ""])
        key = hashlib.md5(raw.encode()).hexdigest()
        if key not in self.held:
            self.held[key] = make()
            if len(self.held) > self.size:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (list_id, doc_id, rank from 1): sum of 1 / (k + rank), best first, ties by list and rank."""
    rows = lists.groupBy("doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("list_id", "rank")).alias("first"), F.count("*").alias("lists"))
    return rows.select("doc_id", "score", "lists", F.col("first.list_id").alias("first_list"))


def softmax_scores(vectors: DataFrame, labels: DataFrame, scale: float = 100.0, block: int = 1000) -> DataFrame:
    """Probability of each label (label, q) for each vector: softmax of scaled cosines. Labels are sent to all tasks in blocks of bounded size."""
    held, s = [], None
    for r in chain(labels.select("label", "q").toLocalIterator(), [None]):
        if r is not None:
            held.append(r)
        if held and (r is None or len(held) == block):
            own = labels.sparkSession.createDataFrame(held, labels.select("label", "q").schema)
            part = vectors.crossJoin(F.broadcast(own)).select("id", "label", (dot(unit("vec"), unit("q")) * scale).alias("s"))
            s, held = part if s is None else s.unionByName(part), []
    if s is None:
        return vectors.where("false").select("id", F.lit(0).alias("label"), F.lit(0.0).alias("p"))
    w = Window.partitionBy("id")
    e = F.exp(F.col("s") - F.max("s").over(w))
    return s.select("id", "label", F.round(e / F.sum(e).over(w), 6).alias("p"))


# Words in a question that name the kind of record asked for, in this order, and those of a broad question.
ROUTES = [
    ("contact", ["contact", "people", "person", "phone number", "phone book", "address book", "names"]), ("message", ["message", "sms", "chat", "whatsapp", "telegram", "signal", "text message", "conversation"]),
    ("call", ["call", "dial", "ring", "phone call", "voice call", "call log", "call history"]), ("media", ["media", "photo", "image", "video", "picture", "camera", "gallery"]),
    ("location", ["location", "place", "gps", "coordinate", "latitude", "longitude", "map"]),
]
BROAD = ["contact", "message", "call", "chat", "sms", "texts", "phone number", "names", "people", "media", "photo", "image", "video", "location", "places"]


def route(question: str) -> str | None:
    """Kind of record a question asks for: the first whose words occur in it."""
    q = question.lower()
    return next((kind for kind, words in ROUTES if any(w in q for w in words)), None)


def is_broad(question: str) -> bool:
    """Whether a question names a kind of record at all, and so asks for a list of them."""
    q = question.lower().strip()
    return any(t in q for t in BROAD)
