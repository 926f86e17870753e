"""Communication graphs: degrees, paths, centralities, components, communities.

Edges are (src, dst, weight), directed, one row per pair; self-loops are allowed. Local measures are joins and aggregates.
PageRank, eigenvector scores, components and sums over shortest paths iterate joins, cutting lineage at each round, at every size. Cliques are
looked for at each vertex among its neighbours. Only the greedy communities hold a component in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrid.session import cut, with_scalars

#: Edges and unordered pairs that every task may hold, and edges that a task looks at in all.
MAX_CORE_EDGES, MAX_PAIRS, TASK_EDGES = 4_000_000, 6_000_000, 200_000_000


def edges_of(comms: DataFrame, least: int = 1) -> DataFrame:
    """Directed edges with weight, calls and messages; those below `least` are dropped."""
    rows = comms.where("length(sender) > 0 and length(receiver) > 0").groupBy(F.col("sender").alias("src"), F.col("receiver").alias("dst"))
    return rows.agg(F.count("*").alias("weight"), F.count_if(F.col("type") == "call").alias("calls"), F.count_if(F.col("type") == "message").alias("messages")).where(F.col("weight") >= least)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In-, out- and total degree of each vertex and its degree centrality (total / (n - 1)), over distinct neighbours by edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    rows = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = rows.agg(F.count("*").alias("n"))
    rows = with_scalars(rows, n).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return rows.select("id", "in_degree", "out_degree", "degree", F.when(F.col("n") > 1, F.round(F.col("degree") / (F.col("n") - 1), 6)).otherwise(0.0).alias("centrality"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """Level of each vertex by its share of outgoing edges: above 0.7 top, below 0.3 bottom, else middle."""
    score = F.when(F.col("in_degree") == 0, 1.0).when(F.col("out_degree") == 0, 0.0).otherwise(F.col("out_degree") / F.col("degree"))
    rows = degrees(edges).withColumn("s", score)
    level = F.when(F.col("s") > 0.7, "top").when(F.col("s") < 0.3, "bottom").otherwise("middle")
    return rows.select("id", F.round("s", 6).alias("score"), level.alias("level"))


def scaled_in_degree(edges: DataFrame) -> DataFrame:
    """In-degree scaled to 10..80; 20 where all are equal."""
    rows = degrees(edges)
    span = rows.agg(F.min("in_degree").alias("lo"), F.max("in_degree").alias("hi"))
    size = F.when(F.col("hi") > F.col("lo"), (F.col("in_degree") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 70 + 10).otherwise(20.0)
    return with_scalars(rows, span).select("id", "in_degree", F.round(size, 6).alias("size"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different vertices as (a, b), a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per vertex of the undirected graph. Edges point from the lower degree on, which bounds each vertex's
    out-degree by the root of twice the number of edges; only pairs of out-neighbours are joined."""
    pairs = undirected(edges)
    deg = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    both = pairs.join(deg.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    o = cut(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = o.join(o.select("x", F.col("y").alias("z")), "x").where("y < z")
    closed = wedge.join(pairs.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient of each vertex of the undirected graph; 0 below two neighbours."""
    pairs = undirected(edges)
    deg = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    rows = vertices(edges).join(deg, "id", "left").join(triangles(edges), "id", "left")
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("triangles", F.lit(0))
    return rows.select("id", F.when(d > 1, F.round(2 * t / (d * (d - 1)), 6)).otherwise(0.0).alias("clustering"))


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected component of each vertex, named by its least vertex. Labels spread to neighbours and then jump
    to their label's label, so that the rounds grow with the logarithm of the diameter."""
    links = cut(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).where("u <> v").distinct())
    label = cut(vertices(edges).select("id", F.col("id").alias("c")))
    while True:
        near = links.join(label.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = step.select(F.col("id").alias("n"), F.col("n").alias("nn"))
        new = cut(step.join(jump, "n").select("id", F.least("n", "nn").alias("c"), F.col("c").alias("old")))
        if not new.where("c <> old").limit(1).count():
            return new.select("id", F.col("c").alias("component"))
        label = new.select("id", "c")


def structure(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, density, weak components, largest component, mean clustering, mean and greatest degree."""
    n, m = vertices(edges).agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    sizes = components(edges).groupBy("component").agg(F.count("*").alias("s")).agg(F.count("*").alias("components"), F.max("s").alias("largest"))
    clus = clustering(edges).agg(F.round(F.avg("clustering"), 6).alias("clustering"))
    deg = degrees(edges).agg(F.round(F.avg("degree"), 6).alias("mean_degree"), F.max("degree").alias("max_degree"))
    row = with_scalars(with_scalars(with_scalars(with_scalars(n, m), sizes), clus), deg)
    return row.withColumn("density", F.when(F.col("nodes") > 1, F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6)).otherwise(0.0))


def component_sizes(edges: DataFrame) -> DataFrame:
    return components(edges).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def hops(edges: DataFrame, root: str, radius: int = 2) -> DataFrame:
    """Vertices reached from a root along edges within `radius`, with their least number of hops."""
    links = edges.select("src", "dst").distinct()
    seen = vertices(edges).where(F.col("id") == root).withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, radius + 1):
        step = front.select(F.col("id").alias("src")).join(links, "src").select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def ego_network(edges: DataFrame, root: str, radius: int = 1) -> DataFrame:
    """Edges among the vertices within `radius` of a root."""
    own = cut(hops(edges, root, radius).select("id"))
    a, b = own.select(F.col("id").alias("src")), own.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "weight")


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """One least path (vertices in order, the least by name) from source to target, of at most `most` edges if given; empty if none."""
    links = edges.where("src <> dst").select("src", "dst").distinct()
    front = vertices(edges).where(F.col("id") == source).select("id", F.array("id").alias("path"))
    seen = front.select("id")
    found = front.where(F.col("id") == target)
    for _ in count() if most is None else range(most):
        step = front.select(F.col("id").alias("src"), "path").join(links, "src").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        hit = front.where(F.col("id") == target)
        if hit.limit(1).count():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        if not front.limit(1).count():
            break
        seen = cut(seen.union(front.select("id")))
    return found.select("path", (F.size("path") - 1).alias("length"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weighted PageRank; vertices without outgoing edges give their mass to all alike. Ends when the scores change, in sum,
    by less than n x tolerance."""
    w = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    links = cut(edges.join(w, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    ids = cut(vertices(edges).join(w.select(F.col("src").alias("id"), F.lit(True).alias("out")), "id", "left"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    rank = ids.select("id", "out", F.lit(1.0 / n).alias("r"))
    for _ in range(rounds):
        loose = rank.where("out is null").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        got = rank.select(F.col("id").alias("src"), "r").join(links, "src").groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("g"))
        new = F.lit((1 - alpha) / n + alpha * loose / n) + alpha * F.coalesce("g", F.lit(0.0))
        rank = cut(rank.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", "out", new.alias("r"), F.abs(new - F.col("r")).alias("d")))
        if rank.agg(F.sum("d")).first()[0] < n * tolerance:
            break
        rank = rank.drop("d")
    return rank.select("id", F.round("r", 6).alias("score"))


def eigenvector(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Weighted eigenvector scores over incoming edges by power iteration, by joins; empty if it doesn't settle."""
    links = cut(edges.select("src", "dst", "weight"))
    ids = cut(vertices(edges))
    n = ids.count()
    x = ids.withColumn("x", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        got = x.join(links, x.id == links.src).groupBy("dst").agg(F.sum(F.col("x") * F.col("weight")).alias("g"))
        y = cut(x.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", "x", (F.col("x") + F.coalesce("g", F.lit(0.0))).alias("y")))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        change = y.agg(F.sum(F.abs(F.col("y") / norm - F.col("x")))).first()[0]
        x = y.select("id", (F.col("y") / norm).alias("x"))
        if change < n * tolerance:
            return x.select("id", F.round("x", 6).alias("score"))
    return x.where("false").select("id", F.col("x").alias("score"))


def path_sums(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, b, reach, total) of all shortest paths from the given sources (column id): the sum of each vertex's shares in them, the number
    of sources that reach it, and its distances from them.

    All sources go level by level together: the frontier with its numbers of paths is joined with the edges, and back again to sum
    the shares up. Nothing is collected; a level of a graph with a hot vertex is a skewed join, which Spark splits.
    """
    links = cut(edges.where("src <> dst").select("src", "dst").distinct())
    front = cut(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths")))
    seen, levels = front.select("s", "id"), [front]
    while True:
        step = front.select("s", F.col("id").alias("src"), "paths").join(links, "src").groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen, ["s", "id"], "left_anti"))
        if not front.limit(1).count():
            break
        levels.append(front)
        seen = cut(seen.unionByName(front.select("s", "id")))
    out = levels[0].select("id", F.lit(0.0).alias("b"), F.lit(0).alias("hop")).where("false")
    share = None
    for hop in range(len(levels) - 1, 0, -1):
        own = levels[hop]
        own = own.join(share, ["s", "id"], "left").select("s", "id", "paths", F.coalesce("share", F.lit(0.0)).alias("share")) if share is not None else own.withColumn("share", F.lit(0.0))
        own = cut(own)
        out = out.unionByName(own.select("id", F.col("share").alias("b"), F.lit(hop).alias("hop")))
        give = own.select("s", F.col("id").alias("dst"), (((1 + F.col("share")) / F.col("paths"))).alias("per")).join(links, "dst")
        back = give.groupBy("s", F.col("src").alias("id")).agg(F.sum("per").alias("per"))
        share = back.join(levels[hop - 1], ["s", "id"]).select("s", "id", (F.col("per") * F.col("paths")).alias("share"))
    return out.groupBy("id").agg(F.sum("b").alias("b"), F.count("*").alias("reach"), F.sum("hop").alias("total"))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size) one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def path_sums_of(heads: np.ndarray, tails: np.ndarray, own: np.ndarray, sizes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """path_sums (b, reach, total) of the vertices of a graph held as arrays: the edges of v go to tails[heads[v] : heads[v + 1]]. A source is the
    vertex `own`, or -1 if no edge leads to it; its edges go to the next `sizes` of `near`. A cell is a vertex as seen from a source."""
    n, m = len(heads) - 1, len(own)
    hop, paths, share = np.full(m * n, -1, dtype=np.int32), np.zeros(m * n), np.zeros(m * n)
    hop[np.flatnonzero(own >= 0) * n + own[own >= 0]] = 0
    front = np.repeat(np.arange(m) * n, sizes) + near
    levels: list[np.ndarray] = []
    paths[front] = 1.0

    def ahead(front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = front % n
        k = heads[v + 1] - heads[v]
        return np.repeat(np.arange(len(front)), k), np.repeat(front - v, k) + tails[ranges(heads[v], k)]

    while len(front):
        levels.append(front)
        hop[front] = len(levels)
        at, cell = ahead(front)
        new = hop[cell] < 0
        at, cell = at[new], cell[new]
        if len(cell) > m * n // 8:
            sums = np.bincount(cell, weights=paths[front[at]], minlength=m * n)
            front = np.flatnonzero(sums)
            paths[front] = sums[front]
        else:
            cells, where = np.unique(cell, return_inverse=True)
            paths[cells] = np.bincount(where, weights=paths[front[at]], minlength=len(cells))
            front = cells
    for k in range(len(levels) - 1, 0, -1):
        front = levels[k - 1]
        at, cell = ahead(front)
        on = hop[cell] == k + 1
        at, cell = at[on], cell[on]
        share[front] = paths[front] * np.bincount(at, weights=(1 + share[cell]) / paths[cell], minlength=len(front))
    seen = np.concatenate(levels) if levels else front
    v = seen % n
    return np.bincount(v, weights=share[seen], minlength=n), np.bincount(v, minlength=n), np.bincount(v, weights=hop[seen], minlength=n)


def by_head(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(heads, tails): the edges of v go to tails[heads[v] : heads[v + 1]]."""
    return np.searchsorted(np.sort(src), np.arange(n + 1)), dst[np.argsort(src, kind="stable")]


def indexed(pairs: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names of the vertices in order, and the ends of the edges (src, dst) as their numbers. All are collected."""
    rows = pairs.select("src", "dst").toArrow()
    names = pc.unique(pa.chunked_array(rows["src"].chunks + rows["dst"].chunks, pa.string()))
    names = names.take(pc.sort_indices(names))
    src, dst = (pc.index_in(rows[c], value_set=names).to_numpy().astype(np.int32) for c in ("src", "dst"))
    return names, src, dst


def path_sums_by_core(links: DataFrame, core: DataFrame, sources: int, size: int) -> DataFrame:
    """path_sums from all vertices where the core, the edges (`size` of them) from vertices that have incoming ones, fits into a task. All paths run
    in the core but for their first edge, which comes with the source."""
    names, src, dst = indexed(core)
    heads, tails = by_head(len(names), src, dst)
    shared = links.sparkSession.sparkContext.broadcast((names, heads, tails))
    parts = int(min(10_000, max(1, sources * (size + len(names)) // TASK_EDGES)))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, heads, tails = shared.value
        sums = [np.zeros(len(names)) for _ in range(3)]
        step = max(1, min(2_000_000 // max(1, len(tails)), 1_000_000 // max(1, len(names))))
        for rows in tables:
            for k in range(0, rows.num_rows, step):
                part = rows.slice(k, step)
                near = pc.index_in(part["near"].flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
                own = pc.fill_null(pc.index_in(part["src"], value_set=names), -1).to_numpy().astype(np.int64)
                sizes = pc.list_value_length(part["near"]).to_numpy().astype(np.int64)
                sums = [a + b for a, b in zip(sums, path_sums_of(heads, tails, own, sizes, near))]
        some = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(sums[0][some]), *(pa.array(x[some].astype(np.int64)) for x in sums[1:])], ["id", "b", "reach", "total"])

    return links.repartition(parts, "src").groupBy("src").agg(F.collect_list("dst").alias("near")).mapInArrow(run, "id string, b double, reach long, total long")


def path_measures(edges: DataFrame, block: int = 512, most: int = MAX_CORE_EDGES) -> DataFrame:
    """Betweenness (directed, unweighted, / ((n-1)(n-2))) and closeness (incoming distances, scaled by reach) of each vertex.

    Vertices without incoming edges are on no path but their own: if the edges from all others are at most `most`, each task gets them, and
    sources with their own edges. Beyond that sources go by joins in blocks of about `block`, by a hash, so that what is written per
    block stays bounded by block x vertices.
    """
    edges = cut(edges.select("src", "dst"))
    ids = cut(vertices(edges))
    n = ids.count()
    links = cut(edges.where("src <> dst").distinct())
    core = cut(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    if (size := core.count()) <= most:
        # without core edges the vertices that edges lead to still need names: a loop, which no path takes
        loops = links.select("dst").distinct().select(F.col("dst").alias("src"), "dst")
        sums = path_sums_by_core(links, core.unionByName(loops), n, size)
    else:
        parts = max(1, -(-n // block))
        sums = None
        for k in range(parts):
            own = cut(path_sums(edges, ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)))
            sums = own if sums is None else sums.unionByName(own)
    sums = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("b", "reach", "total")])
    rows = ids.join(sums, "id", "left").fillna(0, ["b", "reach", "total"])
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    close = F.when(F.col("total") > 0, F.col("reach") / F.col("total") * F.col("reach") / F.lit(max(n - 1, 1))).otherwise(0.0)
    return cut(rows.select("id", F.round(F.col("b") * scale, 6).alias("betweenness"), F.round(close, 6).alias("closeness")))


def distances_by_join(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, id, hop) for all given sources together, level by level, up to `most` if given; the way for graphs too large for one task."""
    links = cut(edges.where("src <> dst").select("src", "dst").distinct())
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("hop")))
    front = seen
    for k in count(1) if most is None else range(1, most + 1):
        step = front.select("source", F.col("id").alias("src")).join(links, "src").select("source", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["source", "id"], "left_anti").withColumn("hop", F.lit(k)))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    return seen


def bridges(edges: DataFrame, n: int = 10) -> DataFrame:
    """Vertices by betweenness / ln(degree + 2), the highest first."""
    rows = path_measures(edges).join(degrees(edges).select("id", "degree"), "id").where("degree > 0")
    return rows.select("id", "betweenness", "degree", F.round(F.col("betweenness") / F.log(F.col("degree") + 2), 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


MEASURES = ["degree", "betweenness", "closeness", "pagerank", "eigenvector"]


def centralities(edges: DataFrame) -> DataFrame:
    """All measures of each vertex, each also as a share of its greatest value (1 where that is 0), their mean, and the rank by it."""
    rows = degrees(edges).select("id", F.col("centrality").alias("degree")).join(path_measures(edges), "id")
    rows = rows.join(pagerank(edges).withColumnRenamed("score", "pagerank"), "id").join(eigenvector(edges).withColumnRenamed("score", "eigenvector"), "id", "left").fillna(0.0)
    rows = cut(rows.withColumn("mean", F.round(sum((F.col(c) for c in MEASURES), F.lit(0.0)) / len(MEASURES), 6)))
    most = rows.agg(*[F.max(c).alias(f"most_{c}") for c in MEASURES])
    scaled = with_scalars(rows, most).withColumns({f"{c}_scaled": F.round(F.col(c) / F.when(F.col(f"most_{c}") > 0, F.col(f"most_{c}")).otherwise(1.0), 6) for c in MEASURES})
    return scaled.drop(*[f"most_{c}" for c in MEASURES]).join(rank_by(rows.select("id", "mean"), "mean").select("id", "rank"), "id")


def top_centralities(edges: DataFrame, n: int = 20) -> DataFrame:
    """The n vertices of the highest mean of all measures, sorted before the cut."""
    return centralities(edges).select("id", *MEASURES, "mean", "rank").orderBy("rank").limit(n)


def network_summary(edges: DataFrame) -> DataFrame:
    """(Category, Metric, Value) of a graph's structure and of the mean and greatest of degree and PageRank."""
    from casegrid.sources.sinks import unpivoted

    score = pagerank(edges).agg(F.max("score").alias("max_pagerank"), F.round(F.avg("score"), 6).alias("avg_pagerank"))
    deg = degrees(edges).agg(F.max("centrality").alias("max_degree_centrality"), F.round(F.avg("centrality"), 6).alias("avg_degree_centrality"))
    return unpivoted(structure(edges), "structure").unionByName(unpivoted(deg, "degree")).unionByName(unpivoted(score, "pagerank"))


def reach_within(links: DataFrame, start: DataFrame) -> DataFrame:
    """(id, c): vertices reached from start (id, c) along links (u, v, c) of the same colour c, the start included."""
    seen = front = cut(start.select("id", "c"))
    while True:
        step = front.withColumnRenamed("id", "u").join(links, ["u", "c"]).select(F.col("v").alias("id"), "c").distinct()
        front = cut(step.join(seen, ["id", "c"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected component of each vertex, named by its greatest vertex.

    Colours, each vertex's own name at first, spread along edges, the greatest winning, until none changes. What reaches a colour's
    own vertex backwards within the colour is its component; these vertices are taken out, and the rest begins anew.
    """
    left = cut(vertices(edges).select("id"))
    links = cut(edges.where("src <> dst").select("src", "dst").distinct())
    out = None
    while left.limit(1).count():
        color = cut(left.select("id", F.col("id").alias("c")))
        while True:
            come = links.join(color.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.max("c").alias("m")).withColumnRenamed("dst", "id")
            new = cut(color.join(come, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            color = new.select("id", "c")
            if not new.where("c <> old").limit(1).count():
                break
        ends = links.join(color.withColumnRenamed("id", "src"), "src").join(color.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d")
        back = cut(ends.select(F.col("dst").alias("u"), F.col("src").alias("v"), "c"))
        done = reach_within(back, color.where("id = c")).select("id", F.col("c").alias("component"))
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(done.select("id"), "id", "left_anti"))
        links = cut(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return out if out is not None else left.select("id", F.col("id").alias("component"))


def hops_from(heads: np.ndarray, tails: np.ndarray, source: int) -> np.ndarray:
    """Hops from a source to each vertex of a graph held as arrays, -1 where none leads."""
    hop = np.full(len(heads) - 1, -1, dtype=np.int32)
    hop[source], front, k = 0, np.array([source]), 0
    while len(front):
        k += 1
        to = tails[ranges(heads[front], heads[front + 1] - heads[front])]
        to = to[hop[to] < 0]
        hop[to] = k
        front = np.flatnonzero(hop == k) if len(to) > len(hop) // 8 else np.unique(to)
    return hop


def farthest(heads: np.ndarray, tails: np.ndarray, sources: np.ndarray, words: int) -> int:
    """The longest of all shortest paths from the given sources (at most 64 x words) of a connected graph of two or more vertices. Each vertex
    has a bit for each source that reaches it, and takes those of its neighbours at each hop."""
    n, m = len(heads) - 1, len(sources)
    bit = np.uint64(1) << (np.arange(m) % 64).astype(np.uint64)
    full = np.bitwise_or.reduceat(bit, np.arange(0, m, 64))
    seen = np.zeros((n, len(full)), dtype=np.uint64)
    sizes = heads[sources + 1] - heads[sources]
    j = np.concatenate([np.arange(m), np.repeat(np.arange(m), sizes)])
    np.bitwise_or.at(seen, (np.concatenate([sources, tails[ranges(heads[sources], sizes)]]), j // 64), bit[j])
    k, cuts = 1, [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(heads, heads[cuts[-1]] + (1 << 20) // len(full), side="right")) - 1))
    while not (seen == full).all():
        new = seen.copy()
        for a, b in zip(cuts, cuts[1:]):
            new[a:b] |= np.bitwise_or.reduceat(seen[tails[heads[a] : heads[b]]], heads[a:b] - heads[a], axis=0)
        seen, k = new, k + 1
    return k


def bounded_diameter(pairs: DataFrame, n: int, rounds: int = 3, words: int = 32) -> int | None:
    """The diameter of the undirected graph of (a, b), None unless it hangs together and has n vertices; every task gets the graph.

    The hops from a few vertices bound the greatest distance of all others (from e hops at most, d away: between max(d, e - d) and e + d).
    Only vertices that may have a longer path than the longest found go on.
    """
    spark = pairs.sparkSession
    names, a, b = indexed(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    if n < 2 or len(names) < n:
        return 0 if n == 1 else None
    heads, tails = by_head(n, np.concatenate([a, b]), np.concatenate([b, a]))
    low, high, degree = np.zeros(n, dtype=np.int64), np.full(n, 2 * n, dtype=np.int64), np.diff(heads)
    shared = spark.sparkContext.broadcast((heads, tails))
    del a, b, names

    def apart(picks: list[int]) -> list:
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                for k in r["id"].to_pylist():
                    yield pa.RecordBatch.from_pydict({"hops": [hops_from(*shared.value, picks[k]).tobytes()]})

        return [np.frombuffer(r.hops, dtype=np.int32) for r in spark.range(0, len(picks), 1, len(picks)).mapInArrow(run, "hops binary").collect()]

    for _ in range(rounds):
        left = np.flatnonzero(high > low.max())
        if not len(left):
            return int(low.max())
        ends = np.lexsort((-degree[left], -high[left]))[:3], np.lexsort((-degree[left], low[left]))[:3]
        for d in apart([int(v) for v in np.unique(left[np.concatenate(ends)])]):
            if (d < 0).any():
                return None
            low, high = np.maximum(low, np.maximum(d, d.max() - d)), np.minimum(high, d.max() + d)
    left, most = np.flatnonzero(high > low.max()), int(low.max())
    if not len(left):
        return most
    flat = most <= 2 * words
    step = 64 * max(1, min(words, 4_000_000 // n, -(-len(left) // (64 * 24)))) if flat else max(1, len(left) // 1000)
    parts = -(-len(left) // step)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails = shared.value
        for r in rows:
            for k in r["id"].to_pylist():
                own = left[k * step : (k + 1) * step]
                yield pa.RecordBatch.from_pydict({"hop": [farthest(heads, tails, own, words) if flat else max(int(hops_from(heads, tails, v).max()) for v in own)]})

    return max(most, spark.range(0, parts, 1, parts).mapInArrow(run, "hop long").agg(F.max("hop")).first()[0])


def diameter(edges: DataFrame, block: int = 512, most: int = MAX_PAIRS) -> DataFrame:
    """One row: the longest of all shortest paths of the undirected graph, null unless it hangs together. Beyond `most` pairs, which
    every task may hold, sources go by joins in blocks."""
    pairs = cut(undirected(edges))
    ids, one = cut(vertices(edges)), edges.sparkSession.range(1)
    n = ids.count()
    if pairs.count() <= most:
        return one.select(F.lit(bounded_diameter(pairs, n)).cast("int").alias("diameter"))
    both = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")))
    whole = n > 0 and components(edges).select("component").distinct().limit(2).count() == 1
    far, parts = 0, max(1, -(-n // block))
    for k in range(parts if whole else 0):
        far = max(far, distances_by_join(both, ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)).agg(F.max("hop")).first()[0] or 0)
    return one.select((F.lit(far) if whole else F.lit(None)).cast("int").alias("diameter"))


def paths_from(edges: DataFrame, source: str | None = None, n: int | None = None) -> DataFrame:
    """(id, path, length): a least path from a source to every vertex it reaches, longest first, the source itself left out; the first n
    if given. Without a source, the vertex of the highest degree (ties by name)."""
    if source is None:
        best = degrees(edges).agg(F.min_by("id", F.struct(-F.col("degree"), "id"))).first()[0]
        source = best if best is not None else ""
    links = cut(edges.where("src <> dst").select("src", "dst").distinct())
    seen = front = cut(vertices(edges).where(F.col("id") == source).select("id", F.array("id").alias("path")))
    while True:
        step = front.select(F.col("id").alias("src"), "path").join(links, "src").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
    rows = seen.where(F.col("id") != source).select("id", "path", (F.size("path") - 1).alias("length")).orderBy(F.desc("length"), "id")
    return rows.limit(n) if n else rows


def label_propagation(edges: DataFrame) -> DataFrame:
    """Communities by label propagation over undirected pairs; a vertex votes for its own label too, ties take the least.

    It ends when no label changes, or when labels only go back and forth; then each vertex takes the lesser of its two. The way for large graphs.
    """
    pairs = undirected(edges)
    links = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")))
    label = cut(vertices(edges).select("id", F.col("id").alias("c"), F.lit(None).cast("string").alias("old")))
    while True:
        votes = links.join(label.select(F.col("id").alias("v"), "c"), "v").select("u", "c").unionByName(label.select(F.col("id").alias("u"), "c"))
        best = votes.groupBy("u", "c").agg(F.count("*").alias("n")).groupBy("u").agg(F.min_by("c", F.struct(-F.col("n"), "c")).alias("b"))
        new = cut(label.join(best.withColumnRenamed("u", "id"), "id").select("id", F.col("b").alias("c"), F.col("c").alias("old"), F.col("old").alias("older")))
        if not new.where("c <> old").limit(1).count() or not new.where("not c <=> older").limit(1).count():
            return new.select("id", F.least("c", "old").alias("community"))
        label = new.select("id", "c", "old")


def greedy_merges(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Community of each of the vertices 0 to n - 1, named by its least vertex, by greedy merging of the pair with the largest gain in
    modularity, ties by name. (a, b) are distinct unordered pairs of different vertices.

    Gains are compared as whole numbers: 2 m w - d e for a link of weight w between degrees d and e. Each link is in the row of one of its
    ends, and an end that grows takes all its links, so that in another's row nothing can rise; a row is looked through again only when
    it is on top and has lost its best link. Within a row and a weight the least degree wins, whatever the row's own degree.
    """
    m2 = 2 * len(a)
    d0 = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    swap = (d0[a] < d0[b]) | ((d0[a] == d0[b]) & (a < b))
    o, p = np.where(swap, b, a), np.where(swap, a, b)
    sort = np.lexsort((p, d0[p], o))
    o, first = o[sort], p[sort]  # links by row, then as they win while their weight is 1
    at = np.searchsorted(o, np.arange(n + 1)).tolist()
    ids, deg, same = list(range(n)), d0.tolist(), d0.tolist()
    own = [dict.fromkeys(map(ids.__getitem__, first[at[v] : at[v + 1]].tolist()), 1) for v in ids]
    sort = np.argsort(first, kind="stable")
    back, lent_at = o[sort], np.searchsorted(first[sort], np.arange(n + 1)).tolist()
    lent = [set(map(ids.__getitem__, back[lent_at[v] : lent_at[v + 1]].tolist())) for v in ids]
    del o, p, sort, back, swap
    more: list[dict[int, list[int]]] = [{} for _ in ids]  # by row and weight: degree * n + name
    label, named, parent = ids[:], ids[:], ids[:]
    pick, stamp, lost, at_row = [-1] * n, [0] * n, [False] * n, at[:-1]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(x: int) -> None:
        """Put the best link of a row on the heap."""
        row, d, best = own[x], deg[x], None
        k, end = at_row[x], at[x + 1]
        while k < end and (row.get(z := int(first[k])) != 1 or deg[z] != same[z]):
            k += 1
        at_row[x] = k
        if k < end:
            best = (d * deg[z] - m2, label[z], z)
        for w in list(more[x]):
            q = more[x][w]
            while q:
                e, name = divmod(q[0], n)
                z = named[name]
                if z >= 0 and row.get(z) == w and deg[z] == e:
                    break
                heapq.heappop(q)
            if not q:
                del more[x][w]
            elif best is None or (d * e - m2 * w, name) < best[:2]:
                best = (d * e - m2 * w, name, z)
        stamp[x] += 1
        lost[x] = False
        if best is not None and best[0] < 0:
            pick[x] = best[2]
            heapq.heappush(heap, (best[0], min(label[x], best[1]), max(label[x], best[1]), x, stamp[x]))

    def take(x: int, z: int, w: int) -> None:
        """Give row x the link to z with weight w."""
        own[x][z] = w
        lent[z].add(x)
        heapq.heappush(more[x].setdefault(w, []), deg[z] * n + label[z])

    def pull(z: int, x: int) -> int:
        """Take the link to x out of row z."""
        if pick[z] == x:
            lost[z] = True
        return own[z].pop(x)

    for v in ids:
        offer(v)
    while heap:
        _, _, _, x, s = heapq.heappop(heap)
        if s != stamp[x]:
            continue
        if lost[x]:
            offer(x)
            continue
        y = pick[x]
        if len(own[x]) + len(lent[x]) < len(own[y]) + len(lent[y]):
            x, y = y, x
        for z in own[y]:
            lent[z].discard(y)
        links = list(own[y].items()) + [(z, pull(z, y)) for z in lent[y]]
        own[y], lent[y], more[y] = {}, set(), {}
        stamp[y] += 1
        for z, w in links:
            if z == x:
                continue
            if z in own[x]:
                w += own[x][z]
            elif z in lent[x]:
                w += pull(z, x)
                lent[x].discard(z)
            take(x, z, w)
        for z in lent[x]:
            take(x, z, pull(z, x))
        lent[x] = set()
        deg[x] += deg[y]
        named[label[x]] = named[label[y]] = -1
        label[x] = min(label[x], label[y])
        named[label[x]], parent[y] = x, x
        offer(x)
    for v in ids:
        x = v
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        parent[v] = x
    return [label[x] for x in parent]


def greedy_modularity(pairs: list[tuple[str, str]]) -> list[set[str]]:
    """Communities by greedy merging of the pair with the largest gain in modularity; ties by name; largest community first."""
    names = sorted({x for p in pairs for x in p})
    index = {x: i for i, x in enumerate(names)}
    members: dict[int, set[str]] = {}
    ends = np.array([[index[x] for x in p] for p in pairs], dtype=np.int64).reshape(-1, 2)
    for x, c in zip(names, greedy_merges(len(names), ends[:, 0], ends[:, 1])):
        members.setdefault(c, set()).add(x)
    return sorted(members.values(), key=lambda s: (-len(s), min(s)))


def maximal_cliques(near: dict[str, set[str]], among: set[str], outside: set[str]) -> list[set[str]]:
    """Maximal cliques of the vertices in `among` that none of `outside` extends, by Bron and Kerbosch with pivots."""
    out, stack = [], [(set(), set(among), set(outside))]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(r)
            continue
        pivot = max(p | x, key=lambda v: (len(near[v] & p), v))
        for v in sorted(p - near[pivot]):
            stack.append((r | {v}, p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return out


def cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """(clique, members, size): maximal cliques of the undirected graph with at least `least` (two or more) vertices.

    Vertices are ordered by degree. Each clique is found at its first vertex, among the neighbours behind it, of which there are at most the
    root of twice the number of edges; neighbours before it only tell whether a clique can be extended. A task holds the triangles at one vertex.
    """
    pairs = undirected(edges)
    deg = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("d"))
    both = pairs.join(deg.select(F.col("v").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("v").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    o = cut(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = o.join(o.select("x", F.col("y").alias("z")), "x").where("y <> z")
    closed = cut(wedge.join(o.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"]))  # x before y before z
    rows = closed.select(F.col("x").alias("v"), F.col("y").alias("a"), F.col("z").alias("b"), F.lit(True).alias("behind"))
    rows = rows.unionByName(closed.select(F.col("y").alias("v"), F.col("x").alias("a"), F.col("z").alias("b"), F.lit(False).alias("behind")))
    rows = rows.unionByName(o.select(F.col("x").alias("v"), F.col("y").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(True).alias("behind")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows["v"].iat[0]
        near: dict[str, set[str]] = {}
        among: set[str] = set()
        outside: set[str] = set()
        for a, b, behind in zip(rows["a"], rows["b"], rows["behind"]):
            near.setdefault(a, set())
            (among if behind else outside).add(a)
            if b is not None:
                near[a].add(b)
                near.setdefault(b, set()).add(a)
                among.add(b)
        found = [sorted(c | {v}) for c in maximal_cliques(near, among, outside) if len(c) + 1 >= least]
        return pd.DataFrame([(f"{v}-{k}", c, len(c)) for k, c in enumerate(sorted(found))], columns=["clique", "members", "size"])

    return rows.groupBy("v").applyInPandas(run, "clique string, members array<string>, size int")


def clique_counts(near: list[int], among: int, outside: int) -> dict[int, int]:
    """Number of maximal cliques by size, of a vertex and vertices of `among`, that none of `outside` extends. Sets are bits; near has the neighbours of each of `among`."""
    sizes: dict[int, int] = {}
    stack, mine = [(among, outside, 1)], among
    while stack:
        p, x, r = stack.pop()
        r += 1
        if not p & (p - 1):
            if p and not x & near[p.bit_length() - 1]:
                sizes[r] = sizes.get(r, 0) + 1
            continue
        most, pivot, rest = -1, 0, p | (x & mine)
        while rest:
            v = rest.bit_length() - 1
            rest ^= 1 << v
            if (k := (p & near[v]).bit_count()) > most:
                most, pivot = k, v
        rest = p & ~near[pivot]
        while rest:
            v = rest.bit_length() - 1
            bit = 1 << v
            q, y = p & near[v], x & near[v]
            if q:
                stack.append((q, y, r))
            elif not y:
                sizes[r] = sizes.get(r, 0) + 1
            rest ^= bit
            p ^= bit
            x |= bit
    return sizes


def clique_counts_at(v: int, place: np.ndarray, heads: np.ndarray, tails: np.ndarray, back_heads: np.ndarray, back_tails: np.ndarray) -> dict[int, int]:
    """clique_counts of the cliques whose first vertex is v; edges lead from the first to the later vertex, back from the later to the first. place: all -1."""
    ahead, before = tails[heads[v] : heads[v + 1]], back_tails[back_heads[v] : back_heads[v + 1]]
    m = len(ahead)
    near = [0] * m
    place[ahead] = np.arange(m)
    for a, x in enumerate(ahead.tolist()):
        found = place[tails[heads[x] : heads[x + 1]]]
        for b in found[found >= 0].tolist():
            near[a] |= 1 << b
            near[b] |= 1 << a
    sizes = heads[before + 1] - heads[before]
    found = place[tails[ranges(heads[before], sizes)]]
    who, found = np.repeat(np.arange(len(before)), sizes)[found >= 0], found[found >= 0]
    sort = np.argsort(found, kind="stable")
    who, cuts = who[sort], np.searchsorted(found[sort], np.arange(m + 1))
    for a in range(m if len(before) else 0):
        bits = np.zeros(len(before), dtype=bool)
        bits[who[cuts[a] : cuts[a + 1]]] = True
        near[a] |= int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little") << m
    place[ahead] = -1
    return clique_counts(near, (1 << m) - 1, ((1 << len(before)) - 1) << m) if m else {}


def clique_sizes(edges: DataFrame, least: int = 3, most: int = MAX_PAIRS) -> DataFrame:
    """Number of maximal cliques of each size, of at least `least` (two or more) vertices. Up to `most` pairs every task holds the graph and only counts,
    each clique at its first vertex by degree; beyond that the cliques themselves are counted."""
    pairs = cut(undirected(edges))
    if pairs.count() > most:
        return cliques(edges, least).groupBy("size").agg(F.count("*").alias("n"))
    names, a, b = indexed(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    n = len(names)
    rank = np.empty(n, dtype=np.int32)
    rank[np.lexsort((np.arange(n), np.bincount(a, minlength=n) + np.bincount(b, minlength=n)))] = np.arange(n)
    a, b = rank[a], rank[b]
    first, later = np.minimum(a, b), np.maximum(a, b)
    shared = edges.sparkSession.sparkContext.broadcast((*by_head(n, first, later), *by_head(n, later, first)))
    parts = max(1, n // 200)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, place, sums = shared.value, np.full(n, -1, dtype=np.int32), {}
        for r in rows:
            for k in r["id"].to_pylist():
                for v in range(k, n, parts):
                    for size, c in clique_counts_at(v, place, *graph).items():
                        sums[size] = sums.get(size, 0) + c
        own = sorted(k for k in sums if k >= least)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([sums[k] for k in own], pa.int64())], ["size", "n"])

    return edges.sparkSession.range(0, parts, 1, parts).mapInArrow(run, "size int, n long").groupBy("size").agg(F.sum("n").alias("n"))


def communities(edges: DataFrame) -> DataFrame:
    """(component, number, id, size): communities by greedy modularity. Every merge depends on all before it, so a component is one task,
    which holds its pairs as numbers (about 150 bytes a pair)."""
    pairs = cut(undirected(edges))
    rows = pairs.join(components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "a"), "a")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names = pa.array(sorted(pc.unique(pa.chunked_array(rows["a"].chunks + rows["b"].chunks)).to_pylist()), pa.string())
        a, b = (pc.index_in(rows[c].cast(pa.string()), value_set=names).to_numpy().astype(np.int64) for c in ("a", "b"))
        found = np.array(greedy_merges(len(names), a, b))
        size = np.bincount(found, minlength=len(names))
        heads = np.unique(found)
        number = np.zeros(len(names), dtype=np.int32)
        number[heads[np.lexsort((heads, -size[heads]))]] = np.arange(len(heads))
        component = pa.array([key[0].as_py()] * len(names), pa.string())
        return pa.table({"component": component, "number": pa.array(number[found]), "id": names, "size": pa.array(size[found].astype(np.int32))})

    return rows.select("component", "a", "b").groupBy("component").applyInArrow(run, "component string, number int, id string, size int")


def community_subgraphs(edges: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(community, src, dst, weight): edges inside the communities (labels: id, community) of at least `least` vertices."""
    big = labels.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = cut(labels.join(big.select("community"), "community", "left_semi").select("id", "community"))
    rows = edges.join(own.withColumnRenamed("id", "src"), "src").join(own.select(F.col("id").alias("dst"), F.col("community").alias("other")), "dst")
    return rows.where("community = other").select("community", "src", "dst", "weight")


def rank_by(scores: DataFrame, column: str) -> DataFrame:
    """Position of each vertex by a score, ties by id: ranks within ranges are made without one task over all rows."""
    counts = scores.groupBy(F.col(column).alias("s")).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("s", above.alias("above"))
    inner = F.row_number().over(Window.partitionBy(column).orderBy("id"))
    return scores.join(ranks, scores[column] == ranks.s).select("id", column, (F.col("above") + inner).alias("rank"))
