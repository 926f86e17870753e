"""Graph queries over the communications of the event stream."""

from __future__ import annotations

from casegrid.operators import graph as G
from casegrid.operators.comms import from_events
from casegrid.plans.comms_queries import _C
from casegrid.session import table


def _g(operator, *args, least=1, **kw):
    return lambda spark, d: operator(G.edges_of(from_events(table(spark, d, "events")), least), *args, **kw)


# Over all edges; those with `least` are held against an SQL twin over the same edges, and have a variant `_all_` beside them.
QUERIES = {
    "g1_edges": _g(lambda e: e, least=2),
    "g1_all_edges": _g(lambda e: e),
    "g2_degree": _g(G.degrees),
    "g3_path_measures": _g(G.path_measures),
    "g5_pagerank": _g(G.pagerank),
    "g6_eigenvector": _g(G.eigenvector),
    "g7_communities": _g(G.communities),
    "g7_label_propagation": _g(G.label_propagation),
    "g8_ego_network": _g(G.ego_network, "7", 1),
    "g9_bridges": _g(G.bridges),
    "g10_cliques": _g(G.cliques),
    "g11_shortest_path": _g(G.shortest_path, "1", "99"),
    "g12_structure": _g(G.structure),
    "g12_components": _g(G.components, least=5),
    "g12_all_components": _g(G.components),
    "g12_clustering": _g(G.clustering, least=3),
    "g12_all_clustering": _g(G.clustering),
    "g12_strong_components": _g(G.strong_components, least=3),
    "g12_all_strong_components": _g(G.strong_components),
    "g12_diameter": _g(G.diameter),
    "g11_paths_from": _g(G.paths_from, "7"),
    "g22_paths_from_hub": _g(G.paths_from),
    "g13_hierarchy": _g(G.hierarchy),
    "g15_clique_sizes": _g(G.clique_sizes),
    "g18_community_subgraphs": _g(lambda e: G.community_subgraphs(e, G.label_propagation(e))),
    "g20_top_centralities": _g(G.top_centralities),
    "a18_network_summary": _g(G.network_summary),
    "g15_component_sizes": _g(G.component_sizes, least=5),
    "g15_all_component_sizes": _g(G.component_sizes),
    "g17_hops": _g(G.hops, "7", 2, least=3),
    "g17_all_hops": _g(G.hops, "7", 2),
    "g19_centralities": _g(G.centralities),
    "w8_rank": _g(lambda e: G.rank_by(G.degrees(e).select("id", "degree"), "degree")),
    "w14_scaled_in_degree": _g(G.scaled_in_degree),
}


def _e(least: int) -> str:
    return _C + f""", e as (select sender as src, receiver as dst, count(*) as weight, count(*) filter (type = 'call') as calls, count(*) filter (type = 'message') as messages from comms
 where length(sender) > 0 and length(receiver) > 0 group by 1, 2 having count(*) >= {least}),
v as (select src as id from e union select dst from e),
deg as (select v.id, (select count(*) from e where dst = v.id) as in_degree, (select count(*) from e where src = v.id) as out_degree from v),
u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst),
l as (select a as x, b as y from u union all select b, a from u)
"""


_CLUSTER = """, d as (select x as id, count(*) as d from l group by 1),
tri as (select p.x as id, count(*) / 2 as t from l p join l q on p.x = q.x join l r on r.x = p.y and r.y = q.y group by 1)
, cl as (select v.id, case when coalesce(d, 0) > 1 then round(2 * coalesce(t, 0) / (d * (d - 1)), 6) else 0.0 end as clustering from v left join d on v.id = d.id left join tri on v.id = tri.id)
"""
_COMP = """, w(id, c, k) as (select id, id, 0 from v union all select y, min(c), max(k) + 1 from w join l on l.x = w.id where k < 8 group by y),
comp as (select id, min(c) as component from w group by 1)
"""


def _recursive(sql: str) -> str:
    return sql.replace("with comms", "with recursive comms", 1)


SQL = {
    "g1_edges": _e(2) + "select * from e",
    "g2_degree": _e(1) + "select id, in_degree, out_degree, in_degree + out_degree as degree, round((in_degree + out_degree) / (count(*) over () - 1), 6) as centrality from deg",
    "g8_ego_network": _e(1) + ", n as (select '7' as id union select dst from e where src = '7') select src, dst, weight from e where src in (select id from n) and dst in (select id from n) and '7' in (select id from v)",
    "g12_clustering": _e(3) + _CLUSTER + "select * from cl",
    "g12_components": _recursive(_e(5) + """, r(id, c) as (select id, id from v union select l.y, r.c from r join l on l.x = r.id)
select id, min(c) as component from r group by 1"""),
    "g15_component_sizes": _recursive(_e(5) + """, r(id, c) as (select id, id from v union select l.y, r.c from r join l on l.x = r.id), c as (select id, min(c) as component from r group by 1)
select size, count(*) as n from (select component, count(*) as size from c group by 1) group by 1"""),
    "g13_hierarchy": _e(1) + """, s as (select id, case when in_degree = 0 then 1.0 when out_degree = 0 then 0.0 else out_degree / (in_degree + out_degree) end as s from deg)
select id, round(s, 6) as score, case when s > 0.7 then 'top' when s < 0.3 then 'bottom' else 'middle' end as level from s""",
    "g17_hops": _e(3) + """, h1 as (select distinct dst as id from e where src = '7' and dst <> '7'), h2 as (select distinct dst as id from e where src in (select id from h1) and dst <> '7' and dst not in (select id from h1))
select id, 0 as hop from v where id = '7' union all select id, 1 from h1 union all select id, 2 from h2""",
    "w8_rank": _e(1) + "select id, in_degree + out_degree as degree, row_number() over (order by in_degree + out_degree desc, id) as rank from deg",
    "w14_scaled_in_degree": _e(1) + "select id, in_degree, round(case when max(in_degree) over () > min(in_degree) over () then (in_degree - min(in_degree) over ()) / (max(in_degree) over () - min(in_degree) over ()) * 70 + 10 else 20.0 end, 6) as size from deg",
}
