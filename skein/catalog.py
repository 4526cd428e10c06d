"""Queries by name, each with its SQL twin where SQL can express it.

A query is (spark, sf_dir) -> DataFrame over a projection of the test tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import etl, generators
from skein.model import Graph, GraphOptions, Layout
from skein.operators import betweenness, bfs, components, pagerank, partitions, ranges, reads, scans, sssp, triangles, updates
from skein.plans.scratch import materialize, new_path
from skein.projections import edges_of, graph_sql, load
from skein.sources import text
from skein.sources.registry import read_registry
from skein.sources.store import GraphStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Nodes that the point reads ask for, on the linechain graph.
NODE, OTHER = 17, 101


def _graph(projection: str, sql: str | None = None, directed: bool = True, keep: bool = False) -> Callable:
    """Register a function of a graph; ``keep`` writes the edges once for functions that read them often."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        name = f.__name__.strip("_")

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            g = load(spark, sf_dir, projection, directed)
            if keep:
                edges = materialize(g.edges, "edges")
                g = g.with_(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)
            return f(g)

        query.__doc__ = f.__doc__
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = f"with recursive {graph_sql(projection, directed)}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


def _bool(g: Graph, value: bool, name: str) -> DataFrame:
    return g.spark.range(1).select(F.lit(value).alias(name))


# Point and set reads


@_graph("linechain", f"select count(*) > 0 as found from nodes where id = {NODE}")
def has_node(g):
    return _bool(g, reads.has_node(g, NODE), "found")


@_graph("linechain", f"select id from nodes where id = {NODE}")
def get_node(g):
    return reads.get_node(g, NODE)


@_graph("linechain", "select id from nodes where id = -5")
def get_absent_node(g):
    return reads.get_node(g, -5)


@_graph("linechain", "select id from nodes")
def get_nodes(g):
    return reads.get_nodes(g)


_MIX = "(((({c} % 1000003) * 7919 + {s}::bigint * 104729 + 12345) % 1000003) + 1000003) % 1000003"


@_graph("linechain", f"select id from nodes order by {_MIX.format(c='id', s=3)}, id limit 1")
def get_random_node(g):
    return reads.get_random_node(g, 3)


@_graph("partsupp", f"select distinct src as id from edges order by {_MIX.format(c='id', s=5)}, id limit 25")
def get_random_node_ids(g):
    return reads.get_random_node_ids(g, 25, 5)


@_graph("linechain", f"select count(*) > 0 as found from edges where src = {NODE} and dst = {OTHER}")
def has_edge(g):
    return _bool(g, reads.has_edge(g, NODE, OTHER), "found")


@_graph("linechain", "select src, dst, weight from edges where src = (select min(src) from edges) and dst = (select min(dst) from edges where src = (select min(src) from edges))")
def get_edge(g):
    first = g.edges.orderBy("src", "dst").first()
    return reads.get_edge(g, first["src"], first["dst"])


@_graph("linechain", "select src, dst, weight from edges")
def get_edges(g):
    return reads.get_edges(g)


@_graph("linechain", f"select cast({NODE} as bigint) as id, count(*) as degree from edges where src = {NODE}")
def get_out_degree(g):
    return g.spark.range(1).select(F.lit(NODE).cast("long").alias("id"), F.lit(reads.get_out_degree(g, NODE)).cast("long").alias("degree"))


@_graph("linechain", f"select cast({NODE} as bigint) as id, count(*) as degree from edges where dst = {NODE}")
def get_in_degree(g):
    return g.spark.range(1).select(F.lit(NODE).cast("long").alias("id"), F.lit(reads.get_in_degree(g, NODE)).cast("long").alias("degree"))


_DEGREES = """select id, cast(coalesce(i, 0) as bigint) as in_degree, cast(coalesce(o, 0) as bigint) as out_degree from nodes
left join (select dst, count(*) as i from edges group by dst) a on id = a.dst left join (select src, count(*) as o from edges group by src) b on id = b.src"""


@_graph("partsupp", _DEGREES)
def degrees(g):
    return reads.degrees(g)


@_graph("linechain", f"select src, dst, weight from edges where src = {NODE}")
def get_out_edges(g):
    return reads.get_out_edges(g, NODE)


@_graph("linechain", f"select src, dst, weight from edges where dst = {NODE}")
def get_in_edges(g):
    return reads.get_in_edges(g, NODE)


@_graph("linechain", f", d as ({_DEGREES}) select d.* from d join edges on id = dst where src = {NODE}")
def get_out_nodes(g):
    return reads.get_out_nodes(g, NODE)


@_graph("linechain", f", d as ({_DEGREES}) select d.* from d join edges on id = src where dst = {NODE}")
def get_in_nodes(g):
    return reads.get_in_nodes(g, NODE)


@_graph("linechain", f"select dst as id from edges where src = {NODE}")
def get_out_nodes_id(g):
    return reads.get_out_nodes_id(g, NODE)


@_graph("linechain", f"select src as id from edges where dst = {NODE}")
def get_in_nodes_id(g):
    return reads.get_in_nodes_id(g, NODE)


def _joined(df: DataFrame) -> DataFrame:
    """Lists as text, which every engine hashes alike."""
    return df.select("node_id", F.col("degree").cast("long").alias("degree"), F.array_join(F.transform("edgelist", lambda x: x.cast("string")), ",").alias("members"))


_LISTS = "select {k} as node_id, count(*) as degree, string_agg(cast({o} as varchar), ',' order by {o}) as members from edges {w} group by {k}"


@_graph("linechain", _LISTS.format(k="src", o="dst", w=f"where src = {NODE}"))
def get_adjlist(g):
    return _joined(reads.get_adjlist(g, NODE))


@_graph("linechain", "select min(id) as id from nodes")
def get_min_node_id(g):
    return reads.get_min_node_id(g)


@_graph("linechain", "select max(id) as id from nodes")
def get_max_node_id(g):
    return reads.get_max_node_id(g)


@_graph("partsupp", f", wanted as (select id from nodes order by {_MIX.format(c='id', s=9)}, id limit 1000) select id, count(src) as degree from wanted left join edges on id = src group by id")
def seek_and_scan(g):
    wanted = g.nodes.orderBy(reads.mix("id", 9), "id").limit(1000)
    return reads.lookup(g, wanted)


# Ordered iterators


@_graph("linechain", "select id from nodes where id between 20 and 90")
def node_range(g):
    return ranges.node_range(g, 20, 90)


@_graph("linechain", "select id from nodes where id between 20 and 90 and id = 33")
def node_seek(g):
    return ranges.node_seek(g, 33, 20, 90)


@_graph("linechain", "select src, dst, weight from edges where (src > 10 or (src = 10 and dst >= 50)) and (src < 40 or (src = 40 and dst <= 60))")
def edge_range(g):
    return ranges.edge_range(g, (10, 50), (40, 60))


@_graph("linechain", _LISTS.format(k="src", o="dst", w="where src between 5 and 60"))
def out_lists(g):
    return _joined(ranges.out_lists(g, 5, 60))


@_graph("linechain", _LISTS.format(k="dst", o="src", w="where dst between 5 and 60"))
def in_lists(g):
    return _joined(ranges.in_lists(g, 5, 60))


@_graph("partsupp", f", l as ({_LISTS.format(k='src', o='dst', w='')}) select id as node_id, coalesce(degree, 0) as degree, coalesce(members, '') as members from nodes left join l on id = node_id where id <= 400")
def out_lists_all_nodes(g):
    return _joined(ranges.out_lists(g, None, 400, all_nodes=True))


@_graph("linechain", _LISTS.format(k="src", o="dst", w=""))
def adjacency_out(g):
    return _joined(reads.adjacency(g, "out"))


@_graph("linechain", _LISTS.format(k="dst", o="src", w=""))
def adjacency_in(g):
    return _joined(reads.adjacency(g, "in"))


# Partitions


@_graph("partsupp", "select part, min(id) as first, max(id) as last, count(*) as n from (select id, cast(ntile(7) over (order by id) as int) as part from nodes) group by part")
def node_ranges_by_count(g):
    return partitions.node_ranges_by_count(g, 7)


@_graph("partsupp", ", b as (select min(id) as a, max(id) as b, cast(greatest(1, ceil((max(id) - min(id) + 1) / 7.0)) as bigint) as w from nodes) select cast((id - a) // w + 1 as int) as part, a + ((id - a) // w) * w as first, least(a + ((id - a) // w) * w + w - 1, b) as last, count(*) as n from nodes, b group by 1, 2, 3")
def node_ranges_by_width(g):
    return partitions.node_ranges_by_width(g, 7)


@_graph("linechain", "select part, min(row(src, dst))[1] as first_src, min(row(src, dst))[2] as first_dst, max(row(src, dst))[1] as last_src, max(row(src, dst))[2] as last_dst, count(*) as n from (select src, dst, cast(ntile(9) over (order by src, dst) as int) as part from edges) group by part")
def edge_ranges_by_count(g):
    return partitions.edge_ranges_by_count(g, 9)


# Updates


def _new(g: Graph) -> DataFrame:
    """Changes for the update queries: new edges from every tenth node, and every thousandth-or-so edge with another weight."""
    fresh = g.nodes.where("id % 10 = 3").select(F.col("id").alias("src"), (F.col("id") + 1_000_000).alias("dst"), F.lit(7).alias("weight"))
    return fresh.union(g.edges.where("(src * 31 + dst) % 97 = 5").select("src", "dst", F.lit(99).alias("weight")))


_NEW = "new as (select id as src, id + 1000000 as dst, 7 as weight from nodes where id % 10 = 3 union all select src, dst, 99 from edges where (src * 31 + dst) % 97 = 5)"


@_graph("linechain", "select id from nodes union select id + 5000000 from nodes where id % 3 = 0")
def add_nodes(g):
    return updates.add_nodes(g, g.nodes.where("id % 3 = 0").select((F.col("id") + 5_000_000).alias("id")).union(g.nodes.limit(5))).nodes


@_graph("linechain", f", {_NEW} select src, dst, weight from edges union all select src, dst, weight from new where (src, dst) not in (select (src, dst) from edges)")
def add_edges_keep(g):
    return updates.add_edges(g, _new(g)).edges


@_graph("linechain", f", {_NEW} select src, dst, weight from new union all select src, dst, weight from edges where (src, dst) not in (select (src, dst) from new)")
def add_edges_replace(g):
    return updates.add_edges(g, _new(g), "replace").edges


@_graph("linechain", f", {_NEW} select id from nodes union select dst from new")
def add_edges_makes_nodes(g):
    return updates.add_edges(g, _new(g)).nodes


@_graph("linechain", "select src, dst, weight from edges where src % 7 <> 2 and dst % 7 <> 2")
def delete_nodes(g):
    return updates.delete_nodes(g, g.nodes.where("id % 7 = 2")).edges


@_graph("linechain", "select src, dst, weight from edges where (src + dst) % 5 <> 1")
def delete_edges(g):
    return updates.delete_edges(g, g.edges.where("(src + dst) % 5 = 1")).edges


@_graph("linechain", "select src, dst, weight from edges where (least(src, dst) + 2 * greatest(src, dst)) % 5 <> 1", directed=False)
def delete_edges_undirected(g):
    return updates.delete_edges(g, g.edges.where("src < dst and (src + 2 * dst) % 5 = 1")).edges


@_graph("linechain", "select src, dst, cast(case when (src * 31 + dst) % 97 = 5 then 99 else weight end as int) as weight from edges")
def update_weights(g):
    return updates.update_weights(g, _new(g)).edges


@_graph("linechain", _LISTS.format(k="src", o="dst", w="").replace("from edges", "from (select src, dst from edges union select src, 0 from edges where src % 2 = 0) e"))
def append_to_lists(g):
    lists = reads.adjacency(g)
    return _joined(updates.append_to_lists(lists, lists.where("node_id % 2 = 0").select("node_id", F.array(F.lit(0).cast("long")).alias("edgelist"))))


@_graph("linechain", ", l as (" + _LISTS.format(k="src", o="dst", w="where dst % 4 <> 1") + ") select distinct src as node_id, coalesce(degree, 0) as degree, coalesce(members, '') as members from edges left join l on src = node_id")
def remove_from_lists(g):
    lists = reads.adjacency(g)
    return _joined(updates.remove_from_lists(lists, lists.select("node_id", F.filter("edgelist", lambda x: x % 4 == 1).alias("edgelist"))))


# Kernels

_BFS = """, walk(id, depth) as (select id, 0 from nodes where id = (select min(id) from nodes)
 union select dst, depth + 1 from walk join edges on src = id where depth < {most}),
tree as (select id, min(depth) as depth from walk group by id)"""
_TREE = _BFS + """, parents as (select t.id, case when t.depth = 0 then t.id else min(p.id) end as parent, t.depth
 from tree t left join edges on dst = t.id left join tree p on p.id = src and p.depth = t.depth - 1 where t.depth = 0 or p.id is not null group by t.id, t.depth)"""


def _source(g: Graph) -> int:
    return g.nodes.agg(F.min("id")).first()[0]


@_graph("linechain", _TREE.format(most=7) + " select id, parent, depth from parents", keep=True)
def bfs_tree(g):
    return bfs.bfs(g, _source(g))


@_graph("custpart50", _TREE.format(most=30) + " select id, parent, depth from parents", directed=False, keep=True)
def bfs_unreached(g):
    return bfs.bfs(g, _source(g))


@_graph("linechain", _BFS.format(most=7) + " select id, depth from tree", keep=True)
def bfs_edge_centric(g):
    return bfs.bfs_by_edges(g, _source(g))


@_graph("linechain", _BFS.format(most=7) + " select (select count(*) from tree) as num_visited, count(*) as sum_out_degree, (select max(depth) from tree) as max_depth from edges where src in (select id from tree)", keep=True)
def bfs_statistics(g):
    return bfs.bfs_stats(g, bfs.bfs(g, _source(g)))


@_graph("linechain", "select * from (values ('source', cast(0 as bigint)), ('depth', 0), ('edge', 0), ('reach', 0)) as t(rule, n)", keep=True)
def bfs_verifier(g):
    source = _source(g)
    return bfs.bfs_violations(g, source, bfs.bfs(g, source))


@_graph("partsupp", f"select src as id from (select distinct src from edges) order by {_MIX.format(c='src', s=27491095 % 1000003)}, src limit 1")
def random_start(g):
    return g.spark.range(1).select(F.lit(bfs.random_start(g)).cast("long").alias("id"))


def _rank_sql(rounds: int) -> str:
    out = ", sizes as (select cast(count(*) as double) as n from nodes), links as (select e.src, e.dst, d.degree from edges e join (select src, count(*) as degree from edges group by src) d on e.src = d.src), r0 as (select id, 1.0 / n as rank from nodes, sizes)"
    for i in range(1, rounds + 1):
        out += f", s{i} as (select dst, sum(rank / degree) as got from links join r{i - 1} on src = id group by dst), r{i} as materialized (select id, 0.15 / n + 0.85 * coalesce(got, 0.0) as rank from nodes cross join sizes left join s{i} on id = dst)"
    return out


@_graph("linechain", _rank_sql(10) + " select id, round(rank, 9) as rank from r10", keep=True)
def _pagerank(g):
    """Ten rounds; every node has out-edges, so ranks sum to 1."""
    return pagerank.pagerank(g).select("id", F.round("rank", 9).alias("rank"))


@_graph("partsupp", _rank_sql(10) + " select id, round(rank, 9) as rank from r10", keep=True)
def pagerank_dangling(g):
    return pagerank.pagerank(g).select("id", F.round("rank", 9).alias("rank"))


@_graph("partsupp", _rank_sql(3) + " select id, round(rank, 9) as rank from r3", keep=True)
def pagerank_tolerance(g):
    """Stops by itself after the second round, when nothing changes any more; the third changes nothing."""
    return pagerank.pagerank(g, max_iter=100, tolerance=1e-9).select("id", F.round("rank", 9).alias("rank"))


@_graph("linechain", _rank_sql(10) + " select id, round(rank, 9) as rank from r10 order by round(rank, 9) desc, id limit 100", keep=True)
def pagerank_top100(g):
    return pagerank.top_k(pagerank.pagerank(g).select("id", F.round("rank", 9).alias("rank")), 100)


_COMPONENTS = """, flood(id, label) as (select id, id from nodes union select dst, label from flood join edges on src = id where dst > label),
comp as (select id, min(label) as component from flood group by id)"""


def _components(g: Graph) -> DataFrame:
    # Every node has an edge, and each edge is there in both directions.
    return components.connected_components(g.edges.where("src <= dst"))


@_graph("custpart50", _COMPONENTS + " select id, component from comp", directed=False)
def connected_components(g):
    return _components(g)


@_graph("partsupp", _COMPONENTS + " select id, component from comp", directed=False)
def connected_components_large(g):
    """All order lines: one component."""
    return _components(g)


@_graph("custpart50", _COMPONENTS + " select component, count(*) as n from comp group by component order by n desc, component limit 5", directed=False)
def component_top5(g):
    return pagerank.top_k(scans.component_sizes(_components(g)), 5, "n", "component")


@_graph("custpart50", _COMPONENTS + ", s as (select component, count(*) as n from comp group by component) select count(*) as components, max(n) as largest, cast(sum(n) as bigint) as nodes from s", directed=False)
def component_statistics(g):
    return scans.component_stats(_components(g))


def _dist_sql(rounds: int) -> str:
    out = ", d0 as (select id, cast(0 as bigint) as dist from nodes where id = (select min(id) from nodes))"
    for i in range(1, rounds + 1):
        out += f", d{i} as materialized (select id, min(dist) as dist from (select id, dist from d{i - 1} union all select dst, dist + weight from d{i - 1} join edges on src = id) u group by id)"
    return out


@_graph("linechain", _dist_sql(14) + " select id, cast(dist as bigint) as dist from d14", keep=True)
def shortest_paths(g):
    return sssp.sssp(g, _source(g))


@_graph("linechain", _dist_sql(14) + " select id, cast(dist as bigint) as dist from d14", keep=True)
def shortest_paths_delta(g):
    return sssp.sssp(g, _source(g), delta=8)


@_graph("custpart50", _dist_sql(30) + " select id, cast(dist as bigint) as dist from d30", directed=False, keep=True)
def shortest_paths_unreached(g):
    return sssp.sssp(g, _source(g))


_PATTERNS = """select (select count(*) from edges a join edges b on a.dst = b.src join edges c on c.src = a.src and c.dst = b.dst) as trust,
 (select count(*) from edges a join edges b on a.dst = b.src join edges c on c.src = b.dst and c.dst = a.src where a.src < a.dst and a.src < b.dst) as cycle,
 (select count(*) from u a join u b on a.y = b.x join u c on c.x = a.x and c.y = b.y) as triangles"""
_PAIRS = ", u as (select distinct least(src, dst) as x, greatest(src, dst) as y from edges) "


@_graph("linechain", _PAIRS + _PATTERNS)
def triangle_counts(g):
    return triangles.triangle_counts(g)


@_graph("handoff", _PAIRS + _PATTERNS)
def triangle_counts_dense(g):
    return triangles.triangle_counts(g)


@_graph("linechain", _PAIRS + "select count(*) * 6 as trust, count(*) * 2 as cycle, count(*) as triangles from u a join u b on a.y = b.x join u c on c.x = a.x and c.y = b.y", directed=False)
def triangle_counts_undirected(g):
    return triangles.triangle_counts(g)


@_graph("handoff", "select a.dst as id from edges a join edges b on a.dst = b.dst where a.src = (select min(id) from nodes) and b.src = (select max(id) from nodes)")
def common_neighbours(g):
    low, high = g.nodes.agg(F.min("id"), F.max("id")).first()
    return triangles.common_neighbours(g, low, high)


@_graph("handoff", "select a.src as node_id, count(b.dst) as common from edges a left join edges b on a.dst = b.src and b.dst = a.src group by a.src")
def list_intersection(g):
    """How many neighbours of each node are both out- and in-neighbours."""
    out, back = reads.adjacency(g, "out"), reads.adjacency(g, "in").select("node_id", F.col("edgelist").alias("back"))
    both = out.join(back, "node_id", "left")
    return both.select("node_id", F.size(F.coalesce(triangles.intersect_lists(F.col("edgelist"), F.col("back")), F.array().cast("array<long>"))).cast("long").alias("common"))


def _between_sql(levels: int, sources: str) -> str:
    out = f", l0 as (select id as s, id, 1.0::double as paths from nodes where {sources})"
    seen = "select s, id from l0"
    for i in range(1, levels + 1):
        out += f", l{i} as materialized (select l.s, e.dst as id, sum(paths) as paths from l{i - 1} l join edges e on l.id = e.src where (l.s, e.dst) not in ({seen}) group by l.s, e.dst)"
        seen += f" union all select s, id from l{i}"
    out += f", b{levels} as (select s, id, 0.0::double as dep from l{levels})"
    total = []
    for i in range(levels, 0, -1):
        out += f", b{i - 1} as materialized (select p.s, p.id, sum(p.paths * (1 + coalesce(b.dep, 0)) / c.paths) as dep from l{i} c left join b{i} b on b.s = c.s and b.id = c.id join edges e on e.dst = c.id join l{i - 1} p on p.s = c.s and p.id = e.src group by p.s, p.id)"
        if i > 1:
            total.append(f"select id, dep from b{i - 1}")
    out += f", sums as (select nodes.id, coalesce(sum(dep), 0) as score from nodes left join ({' union all '.join(total)}) t on nodes.id = t.id group by nodes.id)"
    return out


@_graph("handoff", _between_sql(3, "true") + " select id, round(score / (select case when max(score) > 0 then max(score) else 1 end from sums), 9) as score from sums", keep=True)
def _betweenness(g):
    return betweenness.betweenness(g).select("id", F.round("score", 9).alias("score"))


@_graph("handoff", _between_sql(3, "true") + " select id, round(score, 6) as score from sums", keep=True)
def betweenness_all_sources(g):
    return betweenness.betweenness(g, normalise=False).select("id", F.round("score", 6).alias("score"))


@_graph("partsupp", "select count(distinct src) as lists, count(*) as members, (select count(*) from nodes) as distinct_nodes from edges")
def neighbourhood_scan(g):
    return scans.neighbourhood_scan(g)


@_graph("linechain", "select count(*) as edges, cast(sum(weight) as bigint) as weight from edges")
def edge_scan(g):
    return scans.edge_scan(g)


@_graph("partsupp", ", placed as (select src, row_number() over (order by src, dst) - 1 as place from edges), f as (select src, min(place) as first, count(*) as degree from placed group by src) select id, cast(row_number() over (order by id) - 1 as bigint) as position, cast(first as bigint) as first, coalesce(degree, 0) as degree from nodes left join f on id = src")
def compressed_rows(g):
    return scans.csr(g)


# ETL


def _lines(g: Graph) -> DataFrame:
    """The edges as a text file would have them, with comments and blank lines."""
    comments = g.spark.createDataFrame([("# a comment",), ("% another",), ("",), ("not an edge",)], "value string")
    return g.edges.select(F.concat(F.lit(" "), F.col("src"), F.lit(" \t"), F.col("dst")).alias("value")).union(comments)


@_graph("linechain", "select src, dst, 0 as weight from edges")
def parse_edge_list(g):
    path = new_path(g.spark, "edge-list")
    text.write_lines(_lines(g), path)
    return text.read_edges(g.spark, path)


@_graph("linechain", "select id from nodes")
def parse_node_list(g):
    path = new_path(g.spark, "node-list")
    text.write_lines(g.nodes.select(F.col("id").cast("string").alias("value")), path)
    return text.read_nodes(g.spark, path)


@_graph("linechain", _LISTS.format(k="src", o="dst", w=""))
def adjacency_text(g):
    path = new_path(g.spark, "adjacency")
    text.write_lines(text.adjacency_lines(reads.adjacency(g)), path)
    return _joined(text.read_adjacency(g.spark, path))


@_graph("linechain", "select src, dst, 0 as weight from edges")
def adjacency_to_edges(g):
    return text.from_adjacency(reads.adjacency(g))


@_graph("linechain", "select src, dst, weight from edges")
def external_sort(g):
    return etl.split(g.edges, 4, ["src", "dst"])


@_graph("linechain", "select count(*) as n from edges")
def edge_count(g):
    return g.edges.agg(F.count("*").alias("n"))


@_graph("custpart", "select id from nodes")
def distinct_nodes(g):
    return g.nodes


@_graph("linechain", "select dst as src, src as dst, weight from edges")
def reverse_graph(g):
    return etl.reverse(g.edges)


@_graph("linechain", "select src, dst, weight from edges", directed=False)
def symmetric_edges(g):
    return g.edges


_DENSE = ", ids as (select id as old_id, cast(row_number() over (order by id) - 1 as bigint) as new_id from nodes)"


@_graph("custpart", _DENSE + " select old_id, new_id from ids")
def dense_id_map(g):
    return etl.id_map(g.nodes)


@_graph("custpart", _DENSE + " select a.new_id as src, b.new_id as dst, weight from edges join ids a on src = a.old_id join ids b on dst = b.old_id")
def dense_renumber(g):
    return etl.dense_renumber(g)[0].edges


@_graph("custpart", _DENSE + " select count(*) as n, min(new_id) as lowest, max(new_id) as highest, true as dense from ids")
def density_check(g):
    return etl.density(etl.dense_renumber(g)[0].nodes)


@_graph("custpart", "select count(*) as n, min(id) as lowest, max(id) as highest, min(id) = 0 and max(id) = count(*) - 1 as dense from nodes")
def density_check_sparse(g):
    return etl.density(g.nodes)


@_graph("linechain", "select src, dst, cast((least(src, dst) * 31 + greatest(src, dst) * 17 + (src * dst) % 251) % 256 as int) as weight from edges")
def random_weights(g):
    return etl.with_random_weights(g.edges)


@_graph("linechain", ", p as (select src, dst, row_number() over (order by dst, src) as place from edges), l as (select *, lag(src) over (order by place) as ps, lag(dst) over (order by place) as pd from p) select place, src, dst from l where ps is not null and (src < ps or (src = ps and dst < pd))")
def sortedness_check(g):
    """Where the edges in (dst, src) order break the (src, dst) order."""
    from skein.plans.ranking import with_position

    placed = with_position(g.edges.select("src", "dst"), ["dst", "src"], "place").select((F.col("place") + 1).alias("place"), "src", "dst")
    return etl.unsorted_rows(placed, "place", ["src", "dst"])


@_graph("linechain", "select 'linechain' as db_name, true as is_weighted, false as read_optimize, true as is_directed, (select count(*) from nodes) as num_nodes, count(*) as num_edges, count(case when src <= dst then 1 end) as num_undirected_edges, (select max(id) from nodes) as max_node_id, (select min(id) from nodes) as min_node_id from edges")
def graph_metadata(g):
    return g.metadata()


def _store(g: Graph, layout: Layout = Layout.EDGE_LIST, read_optimize: bool = False) -> GraphStore:
    store = GraphStore(g.spark, new_path(g.spark, "store"), GraphOptions(name="graph", directed=g.directed, layout=layout, read_optimize=read_optimize))
    store.create(g)
    return store


@_graph("linechain", "select src, dst, weight from edges")
def store_round_trip(g):
    return _store(g).graph().edges


@_graph("partsupp", _DEGREES)
def store_read_optimised(g):
    return _store(g, read_optimize=True).node_records()


@_graph("linechain", _LISTS.format(k="dst", o="src", w=""))
def store_adjacency_layout(g):
    return _joined(_store(g, Layout.ADJACENCY).lists("in"))


@_graph("linechain", f"select src, dst, weight from edges where dst = {NODE}")
def store_index_by_dst(g):
    return _store(g, Layout.SPLIT_EDGE_KEY).edges_by_dst().where(F.col("dst") == NODE)


@_graph("linechain", "select src, dst, weight from edges")
def store_snapshot(g):
    """A snapshot reads as before after the graph has lost edges."""
    store = _store(g)
    name = store.checkpoint()
    store.commit(updates.delete_edges(store.graph(), g.edges.where("src % 2 = 0")), expected=1)
    return store.snapshot(name).edges


@_graph("linechain", f", {_NEW} select src, dst, weight from edges union all select src, dst, weight from new where (src, dst) not in (select (src, dst) from edges)")
def store_upsert(g):
    store = _store(g)
    etl.upsert(store, _new(g))
    return store.graph().edges


@_graph("linechain", "select 'src=' || src || ' dst=' || dst || ' weight=' || weight as value from edges order by src, dst limit 50")
def dump_table(g):
    return text.dump(g.edges, ["src", "dst"], 50)


@_graph("linechain", "select src as id, cast(count(*) as bigint) as score from edges group by src")
def score_file(g):
    path = new_path(g.spark, "scores")
    text.write_scores(g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("score")), path, "score")
    return g.spark.read.schema("id long, score long").csv(path, sep="\t")


@_graph("custpart50", _COMPONENTS + " select component as label, count(*) as n from comp group by component", directed=False)
def component_file(g):
    path = new_path(g.spark, "labels")
    text.write_labels(_components(g), path)
    return g.spark.read.text(path).groupBy(F.col("value").cast("long").alias("label")).agg(F.count("*").alias("n"))


@_graph("handoff", "select src % 3 as grp, round(avg(weight), 9) as weight from edges group by 1")
def run_log_means(g):
    means = text.run_log_means(g.edges.select((F.col("src") % 3).alias("grp"), "weight"), ["grp"])
    return means.select("grp", F.round("weight", 9).alias("weight"))


def _plain(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@_plain("hub_scan", "select cast(100000 as bigint) as by_edges, cast(100000 as bigint) as by_lists")
def hub_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of 100000 edges, counted edge by edge and list by list."""
    return _scan_both(Graph.from_edges(generators.star(spark, 100_000)))


@_plain("chain_scan", "select cast(100000 as bigint) as by_edges, cast(100000 as bigint) as by_lists")
def chain_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of 100000 edges, counted edge by edge and list by list."""
    return _scan_both(Graph.from_edges(generators.chain(spark, 100_000)))


def _scan_both(g: Graph) -> DataFrame:
    lists = reads.adjacency(g).select(F.lit(0).alias("edge"), F.size("edgelist").alias("members"))
    both = g.edges.select(F.lit(1).alias("edge"), F.lit(0).alias("members")).union(lists)
    return both.agg(F.sum("edge").alias("by_edges"), F.sum("members").alias("by_lists"))


def _histogram_sql(ends: tuple[str, str], rows: int) -> str:
    return f"""with e as (select distinct src, dst from (select {ends[0]} as src, {ends[1]} as dst from (select unnest(range({rows})) as id)) t where src <> dst),
nodes as (select src as id from e union select dst from e),
degrees as (select id, count(src) as degree from nodes left join e on src = id group by id)
select degree as out_degree, count(*) as n from degrees group by degree"""


@_plain("rmat_graph", _histogram_sql(generators.rmat_sql(12), 8 << 12))
def rmat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degree histogram of a Kronecker-like graph of 2^12 ids."""
    return scans.degree_histogram(Graph.from_edges(generators.rmat(spark, 12, 8)))


@_plain("uniform_graph", _histogram_sql(generators.uniform_sql(12), 8 << 12))
def uniform_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degree histogram of a uniform graph of 2^12 ids."""
    return scans.degree_histogram(Graph.from_edges(generators.uniform(spark, 12, 8)))


@_graph("linechain", f"select src, dst, weight from edges where dst = {NODE}")
def store_drop_index(g):
    """Reads by destination are the same with, without and with a new index."""
    store = _store(g, Layout.SPLIT_EDGE_KEY)
    store.drop_indices()
    return store.edges_by_dst().where(F.col("dst") == NODE)


@_graph("linechain", "select true as directed, true as weighted, false as read_optimize, 'adjacency' as layout")
def store_restore_options(g):
    """The options that a store's metadata gives back."""
    o = _store(g, Layout.ADJACENCY).restore_options()
    return g.spark.createDataFrame([(o.directed, o.weighted, o.read_optimize, o.layout.name.lower())], "directed boolean, weighted boolean, read_optimize boolean, layout string")


@_graph("linechain", "select id from nodes union select -5 union select -6 union select -7")
def add_nodes_with_lists(g):
    """Nodes after one has been added together with its neighbours."""
    lists = g.spark.createDataFrame([(-5, [-6, 17], [-7]), (-6, [], [-5])], "node_id long, out array<long>, in array<long>")
    return updates.add_nodes_with_lists(g, lists).nodes


@_graph("linechain", "select src, dst, weight from edges union all select -1, -2, 3 union all select -2, -3, 4")
def store_append(g):
    """Edges known to be new, added without a look at what is there."""
    store = _store(g)
    etl.append(store, g.spark.createDataFrame([(-1, -2, 3), (-2, -3, 4)], "src long, dst long, weight int"))
    return store.graph().edges


@_graph("linechain", "select true as same, 1 as kept, 2 as appended", keep=True)
def append_and_upsert(g):
    """A plain append gives what an upsert of the same new edges does; an upsert alone leaves out what is there."""
    new = g.spark.createDataFrame([(-1, -2, 3), (-2, -3, 4)], "src long, dst long, weight int")
    one, other = _store(g), _store(g)
    etl.append(one, new)
    etl.upsert(other, new)
    a, b = one.graph().edges, other.graph().edges
    same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    etl.upsert(other, new)
    etl.append(one, new)
    twice = lambda s: s.graph().edges.where("src = -1").count()
    return g.spark.createDataFrame([(same, twice(other), twice(one))], "same boolean, kept int, appended int")


@_graph("linechain", "select src % 5 as trial, count(*) as n, cast(sum(weight) as bigint) as total from edges group by 1")
def run_log_append(g):
    """A run log as it reads back after five appends."""
    path = new_path(g.spark, "log")
    for r in sorted(g.edges.groupBy((F.col("src") % 5).alias("trial")).agg(F.count("*").alias("n"), F.sum("weight").alias("total")).collect()):
        text.append_run_log(g.spark, path, trial=r["trial"], n=r["n"], total=r["total"])
    return g.spark.read.option("header", True).schema("trial long, n long, total long").csv(path)


@_graph("linechain", "select 'chain' as name, (select count(*) from nodes) as nodes, (select count(*) from edges) as edges, true as directed")
def registry(g):
    """A dataset as the registry lists it, its file being there."""
    files, listed = new_path(g.spark, "files"), new_path(g.spark, "registry")
    text.write_lines(g.edges.select(F.concat_ws(" ", "src", "dst").alias("value")), files)
    row = [("chain", files, g.nodes.count(), g.edges.count(), True)]
    g.spark.createDataFrame(row, "dataset_name string, graph_path string, num_nodes long, num_edges long, directed boolean").coalesce(1).write.json(listed)
    d = read_registry(g.spark, listed, check_files=True)["chain"]
    return g.spark.createDataFrame([(d.dataset_name, d.num_nodes, d.num_edges, d.directed)], "name string, nodes long, edges long, directed boolean")


@_plain("ingest_pipeline", f"with {graph_sql('custpart')} {_DENSE} select a.new_id as src, b.new_id as dst, 0 as weight from edges join ids a on src = a.old_id join ids b on dst = b.old_id")
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge list file to stored graph over dense ids."""
    edges = edges_of(spark, sf_dir, "custpart")
    path = new_path(spark, "raw")
    text.write_lines(edges.select(F.concat_ws(" ", "src", "dst").alias("value")), path)
    return etl.ingest(spark, path, new_path(spark, "stored"), GraphOptions(name="custpart"), dense=True, index=True).graph().edges
