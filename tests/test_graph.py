import math
import random

import numpy as np
import pytest

from casegrid.operators import graph as G
from casegrid.operators.comms import from_events
from casegrid.plans.graph_queries import QUERIES
from casegrid.session import table


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("e", "f", 1), ("f", "f", 1)], "src string, dst string, weight long")


def test_components(edges):
    got = {r.id: r.component for r in G.components(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e"}


def test_pagerank_sums_to_one_and_orders(edges):
    got = {r.id: r.score for r in G.pagerank(edges).collect()}
    assert abs(sum(got.values()) - 1) < 1e-4
    assert got["b"] > got["a"] > got["e"]


def test_path_measures(edges):
    got = {r.id: (r.betweenness, r.closeness) for r in G.path_measures(edges).collect()}
    assert got["c"][0] == round(3 / 20, 6)  # on b-a, a-d, b-d
    assert got["d"][1] == round(3 / 6 * 3 / 5, 6)
    assert got["e"] == (0.0, 0.0)


def test_triangles_and_clustering(edges):
    assert {r.id: r.triangles for r in G.triangles(edges).collect()} == {"a": 1, "b": 1, "c": 1}
    got = {r.id: r.clustering for r in G.clustering(edges).collect()}
    assert got["a"] == 1.0 and got["c"] == round(1 / 3, 6) and got["d"] == 0.0


def test_shortest_path(edges):
    row = G.shortest_path(edges, "a", "d").first()
    assert (row.path, row.length) == (["a", "b", "c", "d"], 3)
    assert G.shortest_path(edges, "a", "f").count() == 0
    assert G.shortest_path(edges, "a", "a").first().length == 0


def test_hops_and_distances(edges, spark):
    assert {r.id: r.hop for r in G.hops(edges, "a", 2).collect()} == {"a": 0, "b": 1, "c": 2}
    far = {(r.source, r.id): r.hop for r in G.distances_by_join(edges, spark.createDataFrame([("a",), ("e",)], "id string")).collect()}
    assert far[("a", "d")] == 3 and far[("e", "f")] == 1


def test_communities_and_cliques():
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z")]
    assert G.greedy_modularity(two) == [{"a", "b", "c"}, {"x", "y", "z"}]


def greedy_by_hand(pairs):
    m, member, w, d = len(pairs), {}, {}, {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            member.setdefault(x, {x})
            w.setdefault(x, {})[y] = 1
            d[x] = d.get(x, 0) + 1
    while pairs:
        loss, x, y = min(((d[x] * d[y] - 2 * m * w[x][y], x, y) for x in w for y in w[x] if x < y), default=(0, "", ""))
        if loss >= 0:
            break
        for z, v in w.pop(y).items():
            w[z].pop(y)
            if z != x:
                w[x][z] = w[z][x] = w[x].get(z, 0) + v
        d[x] += d.pop(y)
        member[x] |= member.pop(y)
    return sorted(member.values(), key=lambda s: (-len(s), min(s)))


def test_greedy_merges_have_exact_ties():
    r = random.Random(1)
    for t in range(300):
        names = [str(i) for i in range(r.randint(2, 30))]
        hubs = names[:5] if t % 2 else names
        pairs = sorted({tuple(sorted((x, y))) for x in names for y in hubs if x != y and r.random() < 0.3})
        assert G.greedy_modularity(pairs) == greedy_by_hand(pairs)


def test_communities_of_more_than_two_million_rows(spark):
    """A table of so many edges was refused."""
    many = spark.range(2_000_001).selectExpr("cast(id % 6 div 3 * 3 + id % 3 as string) as src", "cast(id % 6 div 3 * 3 + (id + 1) % 3 as string) as dst", "1L as weight")
    got = sorted((x.component, x.number, x.id, x.size) for x in G.communities(many).collect())
    assert got == [("0", 0, "0", 3), ("0", 0, "1", 3), ("0", 0, "2", 3), ("3", 0, "3", 3), ("3", 0, "4", 3), ("3", 0, "5", 3)]


def all_cliques(pairs, least=3):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return sorted(sorted(c) for c in G.maximal_cliques(near, set(near), set()) if len(c) >= least)


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")


def cliques(df, least=3):
    return sorted(sorted(r.members) for r in G.cliques(df, least).collect())


def test_cliques_at_vertices_are_all_maximal_cliques(spark):
    r = random.Random(3)
    for n, m in ((8, 20), (14, 60), (5, 4)):
        pairs = sorted({tuple(sorted(r.sample("abcdefghijklmnopqrst"[:n], 2))) for _ in range(m)})
        for least in (2, 3):
            assert cliques(frame(spark, pairs), least) == all_cliques(pairs, least)
    assert G.clique_sizes(frame(spark, [("a", "b"), ("b", "c"), ("a", "c")])).first().n == 1


def test_strong_components_diameter_and_paths(spark):
    df = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f")])
    assert {x.id: x.component for x in G.strong_components(df).collect()} == {"a": "c", "b": "c", "c": "c", "d": "e", "e": "e", "f": "f"}
    assert G.diameter(df).first().diameter is None and G.diameter(df.where("src <> 'f'")).first().diameter == 3
    rows = G.paths_from(df, "a").collect()
    assert [(x.id, x.length) for x in rows] == [("e", 4), ("d", 3), ("c", 2), ("b", 1)] and rows[0].path == list("abcde")
    assert G.paths_from(df, n=1).first().path[0] == "c"  # the vertex of the highest degree
    labels = spark.createDataFrame([(x, "1" if x in "abc" else "2") for x in "abcdef"], "id string, community string")
    assert sorted((x.src, x.dst) for x in G.community_subgraphs(df.where("src <> 'f'"), labels.where("id <> 'f'")).collect()) == [("a", "b"), ("b", "c"), ("c", "a")]


def test_path_measures_against_brute_force(spark):
    r = random.Random(6)
    edges = sorted({(r.choice("abcdefgh"), r.choice("abcdefgh")) for _ in range(24)})
    names = sorted({x for e in edges for x in e})
    near = {x: {b for a, b in edges if a == x and b != x} for x in names}
    n, between, far = len(names), dict.fromkeys(names, 0.0), {}
    for s in names:
        paths, hop = {s: [[s]]}, [s]
        while hop:
            new = {}
            for v in hop:
                for w in near[v]:
                    if w not in paths:
                        new.setdefault(w, []).extend([*p, w] for p in paths[v])
            paths |= new
            hop = list(new)
        for t, ps in paths.items():
            if t != s:
                far.setdefault(t, []).append(len(ps[0]) - 1)
                for p in ps:
                    for v in p[1:-1]:
                        between[v] += 1 / len(ps)
    got = {x.id: x for x in G.path_measures(frame(spark, edges), block=3).collect()}
    for v in names:
        assert abs(got[v].betweenness - between[v] / ((n - 1) * (n - 2))) < 1e-5
        reach = len(far.get(v, []))
        assert abs(got[v].closeness - (reach / sum(far[v]) * reach / (n - 1) if reach else 0)) < 1e-5


def test_path_measures_by_core_and_by_joins_are_equal(spark, monkeypatch):
    """Every level of every block of sources was a join, whatever the graph."""
    r = random.Random(9)
    pairs = sorted({(str(r.randrange(60)), str(r.randrange(14))) for _ in range(200)} | {("0", "x"), ("x", "y"), ("y", "z"), ("z", "y"), ("p", "q"), ("w", "w")})
    rows = lambda **kw: sorted(map(tuple, G.path_measures(frame(spark, pairs), **kw).collect()))
    want = rows(most=0)
    monkeypatch.setattr(G, "path_sums", None)
    assert rows() == want and rows(block=3) == want and sum(x[1] > 0 for x in want) > 8
    assert sorted(map(tuple, G.path_measures(frame(spark, [("a", "b"), ("c", "b")])).collect())) == [("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0)]
    assert G.path_measures(frame(spark, pairs).where("false")).count() == 0


def test_top_centralities_need_no_joins_over_paths(spark, monkeypatch):
    monkeypatch.setattr(G, "path_sums", None)
    rows = G.top_centralities(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("b", "e")]), 1).collect()
    assert [(x.id, x["rank"], x.betweenness, x.closeness) for x in rows] == [("b", 1, round(6 / 12, 6), round(3 / 4 * 3 / 4, 6))]


def test_bridges_need_no_joins_over_paths(spark, monkeypatch):
    monkeypatch.setattr(G, "path_sums", None)
    rows = G.bridges(frame(spark, [("a", "b"), ("b", "c"), ("d", "b"), ("b", "e")]), 2).collect()
    assert [(x.id, x.betweenness, x.degree, x.score) for x in rows] == [("b", round(4 / 12, 6), 4, round(4 / 12 / math.log(6), 6)), ("a", 0.0, 1, 0.0)]


def test_diameter_without_joins(spark, monkeypatch):
    """Every hop of every block of sources was a join, whatever the graph."""
    r = random.Random(5)
    far = lambda pairs: G.diameter(frame(spark, pairs)).first().diameter
    many = sorted({(str(r.randrange(3, 180)), str(r.randrange(3))) for _ in range(300)})
    want = G.diameter(frame(spark, many), most=0).first().diameter
    monkeypatch.setattr(G, "distances_by_join", None)
    assert far(many) == want and far([(f"{i:02d}", f"{i + 1:02d}") for i in range(40)]) == 40
    assert far([("a", "a")]) == 0 and far([("a", "b"), ("c", "c")]) is None and far([("a", "b"), ("c", "d")]) is None
    assert G.diameter(frame(spark, many).where("false")).first().diameter is None


def test_farthest_of_all_vertices():
    r = random.Random(7)
    for n, m in ((2, 1), (70, 69), (150, 400), (300, 310)):
        pairs = {(i, r.randrange(i)) for i in range(1, n)} | {tuple(sorted(r.sample(range(n), 2), reverse=True)) for _ in range(m - n)}
        a, b = (np.array(x) for x in zip(*pairs))
        heads, tails = G.by_head(n, np.concatenate([a, b]), np.concatenate([b, a]))
        hops = [int(G.hops_from(heads, tails, v).max()) for v in range(n)]
        near = {v: set(tails[heads[v] : heads[v + 1]].tolist()) for v in range(n)}
        seen, k = {0}, 0
        while len(seen) < n:
            seen, k = seen | {w for v in seen for w in near[v]}, k + 1
        assert k == hops[0] and G.farthest(heads, tails, np.arange(n), 8) == max(hops) and G.farthest(heads, tails, np.array([1]), 8) == hops[1]


def test_clique_sizes_are_counted_without_the_cliques(spark, monkeypatch):
    """All cliques with their members, and all triangles, were written to be counted."""
    r = random.Random(8)
    graphs = [sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}) for n, m in ((8, 20), (14, 60), (40, 30))]
    graphs += [sorted({(h, v) for v in range(12, 60) for h in range(12) if r.random() < 0.5} | {(h, k) for h in range(12) for k in range(h) if r.random() < 0.7})]
    monkeypatch.setattr(G, "cliques", None)
    for pairs in graphs:
        for least in (2, 3):
            want: dict = {}
            for c in all_cliques([(str(a), str(b)) for a, b in pairs], least):
                want[len(c)] = want.get(len(c), 0) + 1
            assert {x["size"]: x.n for x in G.clique_sizes(frame(spark, [(str(a), str(b)) for a, b in pairs]), least).collect()} == want
    assert G.clique_sizes(frame(spark, [("a", "b")]).where("false")).count() == 0


def test_components_of_a_long_line_and_label_propagation(spark):
    line = frame(spark, [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)])
    assert {x.component for x in G.components(line).collect()} == {"0000"}
    two = frame(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("p", "q")])
    got = {x.id: x.community for x in G.label_propagation(two).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"] and set(got) == set("abcxyzpq")


def test_centralities_have_ranks_and_scales(edges):
    rows = G.centralities(edges).collect()
    assert sorted(x["rank"] for x in rows) == list(range(1, len(rows) + 1)) and max(x.pagerank_scaled for x in rows) == 1.0


def test_eigenvector(spark):
    loop = spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "b", 1)], "src string, dst string, weight long")
    got = {r.id: r.score for r in G.eigenvector(loop).collect()}
    assert got["b"] > got["a"] and abs(got["a"] - got["c"]) < 1e-5


def test_empty(spark):
    none = spark.createDataFrame([], "src string, dst string, weight long")
    assert G.components(none).count() == 0
    assert G.pagerank(none).count() == 0
    assert G.triangles(none).count() == 0


def test_queries_take_all_edges(spark, data):
    all_edges = G.edges_of(from_events(table(spark, data, "events"))).cache()
    assert all_edges.where("weight = 1").count() > 0
    assert QUERIES["g12_structure"](spark, data).first().edges == QUERIES["g1_all_edges"](spark, data).count() == all_edges.count()
    rows = lambda df: sorted(map(tuple, df.collect()))
    pairs = sorted((r.a, r.b) for r in G.undirected(all_edges).collect())
    assert cliques(all_edges) == all_cliques(pairs)
    assert rows(QUERIES["g3_path_measures"](spark, data)) == rows(G.path_measures(all_edges))
    assert rows(QUERIES["g12_all_clustering"](spark, data)) == rows(G.clustering(all_edges))


def test_paths_longer_than_six(spark):
    line = spark.createDataFrame([(str(i), str(i + 1), 1) for i in range(8)], "src string, dst string, weight long")
    assert G.shortest_path(line, "0", "8").first().length == 8
    far = {r.id: r.hop for r in G.distances_by_join(line, spark.createDataFrame([("0",)], "id string")).collect()}
    assert far == {str(i): i for i in range(9)}
