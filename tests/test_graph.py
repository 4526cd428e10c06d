"""The sample graph's facts, read by read and update by update."""

import pytest

from skein.model import Graph, GraphError, GraphOptions, Layout
from skein.operators import partitions, ranges, reads, updates
from skein.plans.scratch import materialize
from skein.sources.store import GraphStore

EDGES = [(1, 2), (1, 3), (2, 3), (1, 7), (7, 8), (8, 7)]
NODES = [1, 2, 3, 4, 7, 8]


def sample(spark, directed=True):
    edges = spark.createDataFrame([(a, b, 0) for a, b in EDGES], "src long, dst long, weight int")
    nodes = spark.createDataFrame([(n,) for n in NODES], "id long")
    g = Graph.from_edges(edges, nodes, GraphOptions(directed=directed))
    return g.with_(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"))


def pairs(df):
    return [(r["src"], r["dst"]) for r in df.collect()]


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def g(spark):
    return sample(spark)


@pytest.fixture(scope="module")
def u(spark):
    return sample(spark, directed=False)


def test_out_edges_in_order(g):
    assert pairs(reads.get_out_edges(g, 1)) == [(1, 2), (1, 3), (1, 7)]
    assert ids(reads.get_out_nodes_id(g, 1)) == [2, 3, 7]
    assert ids(reads.get_out_nodes(g, 1)) == [2, 3, 7]


def test_in_edges_in_order(g):
    assert pairs(reads.get_in_edges(g, 3)) == [(1, 3), (2, 3)]
    assert ids(reads.get_in_nodes(g, 3)) == ids(reads.get_in_nodes_id(g, 3)) == [1, 2]


def test_isolated_and_absent_nodes(g):
    assert pairs(reads.get_out_edges(g, 4)) == []
    assert reads.get_node(g, 1500).isEmpty() and reads.get_edge(g, 1, 8).isEmpty()
    assert not reads.has_node(g, 1500) and reads.has_edge(g, 7, 8) and not reads.has_edge(g, 8, 1)
    for read in (reads.get_out_edges, reads.get_in_nodes, reads.get_out_degree):
        with pytest.raises(GraphError):
            read(g, 1500)


def test_degrees(g, u):
    directed = {r["id"]: (r["in_degree"], r["out_degree"]) for r in reads.degrees(g).collect()}
    assert directed == {1: (0, 3), 2: (1, 1), 3: (2, 0), 4: (0, 0), 7: (2, 1), 8: (1, 1)}
    undirected = {r["id"]: r["out_degree"] for r in reads.degrees(u).collect()}
    assert undirected == {1: 3, 2: 2, 3: 2, 4: 0, 7: 2, 8: 1}
    assert all(r["in_degree"] == r["out_degree"] for r in reads.degrees(u).collect())


def test_counts_before_and_after_an_edge(spark, g, u):
    new = spark.createDataFrame([(5, 6, 333)], "src long, dst long, weight int")
    for graph, before, after in ((g, 6, 7), (u, 10, 12)):
        assert (graph.nodes.count(), graph.edges.count()) == (6, before)
        grown = updates.add_edges(graph, new)
        assert (grown.nodes.count(), grown.edges.count()) == (8, after)
        assert {5, 6} <= set(ids(grown.nodes))
    assert u.metadata().first()["num_undirected_edges"] == 5


def changed(spark, graph):
    new = spark.createDataFrame([(5, 6, 333)], "src long, dst long, weight int")
    gone = spark.createDataFrame([(2,), (4,)], "id long")
    return updates.delete_nodes(updates.add_edges(graph, new), gone)


def test_delete_nodes_and_scan(spark, g, u):
    d, n = changed(spark, g), changed(spark, u)
    assert reads.get_out_degree(d, 1) == 2
    assert pairs(reads.get_edges(d)) == [(1, 3), (1, 7), (5, 6), (7, 8), (8, 7)]
    assert pairs(reads.get_edges(n)) == [(1, 3), (1, 7), (3, 1), (5, 6), (6, 5), (7, 1), (7, 8), (8, 7)]


def test_ranges(spark, g, u):
    d, n = changed(spark, g), changed(spark, u)
    assert pairs(ranges.edge_range(d, (1, 4), (8, 1))) == [(1, 7), (5, 6), (7, 8)]
    assert pairs(ranges.edge_range(n, (1, 4), (8, 1))) == [(1, 7), (3, 1), (5, 6), (6, 5), (7, 1), (7, 8)]
    assert ids(ranges.node_range(d, 3, 6)) == [3, 5, 6]
    assert ids(ranges.node_seek(d, 5, 3, 6)) == [5] and ids(ranges.node_seek(d, 7, 3, 6)) == []
    lists = {r["node_id"]: r["edgelist"] for r in ranges.out_lists(d, 1, 5, all_nodes=True).collect()}
    assert lists == {1: [3, 7], 3: [], 5: [6]}
    assert {r["node_id"]: r["edgelist"] for r in ranges.in_lists(d).collect()} == {3: [1], 6: [5], 7: [1, 8], 8: [7]}


def test_duplicate_edge_policies(spark, g):
    again = spark.createDataFrame([(1, 2, 5), (1, 2, 9)], "src long, dst long, weight int")
    weight = lambda graph: reads.get_edge(graph, 1, 2).first()["weight"]
    assert weight(updates.add_edges(g, again)) == 0
    assert weight(updates.add_edges(g, again, "replace")) == 9
    with pytest.raises(GraphError):
        updates.add_edges(g, again, "error")
    with pytest.raises(GraphError):
        updates.add_nodes(g, spark.createDataFrame([(1,)], "id long"), "error")


def test_delete_edge_of_undirected_graph_goes_both_ways(spark, u):
    left = updates.delete_edges(u, spark.createDataFrame([(3, 1)], "src long, dst long"))
    assert (1, 3) not in pairs(left.edges) and (3, 1) not in pairs(left.edges) and left.nodes.count() == 6


def test_update_weights(spark, g):
    new = updates.update_weights(g, spark.createDataFrame([(7, 8, 4), (1, 8, 4)], "src long, dst long, weight int"))
    assert reads.get_edge(new, 7, 8).first()["weight"] == 4 and new.edges.count() == 6
    with pytest.raises(GraphError):
        updates.update_weights(Graph(g.nodes, g.edges, GraphOptions(weighted=False)), g.edges)


def test_nodes_with_lists(spark, g):
    lists = spark.createDataFrame([(20, [1, 21], [7])], "node_id long, out array<long>, in array<long>")
    grown = updates.add_nodes_with_lists(g, lists)
    assert pairs(reads.get_out_edges(grown, 20)) == [(20, 1), (20, 21)] and reads.has_edge(grown, 7, 20)


def test_undirected_self_loop_is_stored_once(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "src long, dst long, weight int"), options=GraphOptions(directed=False))
    assert sorted(pairs(g.edges)) == [(1, 1), (1, 2), (2, 1)]


def test_partitions_cover_everything_once(spark, g):
    for parts in (1, 2, 3, 4, 9):
        for cut in (partitions.node_ranges_by_count, partitions.node_ranges_by_width):
            rows = cut(g, parts).orderBy("part").collect()
            assert sum(r["n"] for r in rows) == 6
            assert all(a["last"] < b["first"] for a, b in zip(rows, rows[1:]))
        rows = partitions.edge_ranges_by_count(g, parts).collect()
        assert sum(r["n"] for r in rows) == 6
    with pytest.raises(GraphError):
        partitions.node_ranges_by_count(g, 0)


@pytest.mark.parametrize("directed", [True, False])
def test_layouts_read_alike(spark, tmp_path, directed):
    g = sample(spark, directed)
    seen = set()
    for layout in Layout:
        for fast in (True, False):
            store = GraphStore(spark, f"file://{tmp_path}", GraphOptions(name="s", directed=directed, layout=layout, read_optimize=fast))
            store.create(g)
            back = store.graph()
            lists = tuple(sorted((r["node_id"], tuple(r["edgelist"])) for d in ("out", "in") for r in store.lists(d).collect()))
            records = tuple(sorted(tuple(r) for r in store.node_records().collect()))
            seen.add((tuple(pairs(reads.get_edges(back))), tuple(ids(reads.get_nodes(back))), lists, records, tuple(sorted(pairs(store.edges_by_dst())))))
            assert store.restore_options() == store.options
    assert len(seen) == 1


def test_versions_snapshots_and_conflicts(spark, tmp_path):
    g = sample(spark)
    store = GraphStore(spark, f"file://{tmp_path}", GraphOptions(name="v"))
    assert store.create(g) == 1
    with pytest.raises(GraphError):
        store.create(g)
    name = store.checkpoint()
    smaller = updates.delete_nodes(store.graph(), spark.createDataFrame([(1,)], "id long"))
    assert store.commit(smaller, expected=1) == 2
    with pytest.raises(GraphError):
        store.commit(smaller, expected=1)
    assert store.graph().edges.count() == 3 and store.graph(1).edges.count() == 6
    assert store.snapshot(name).edges.count() == store.snapshot().edges.count() == 6
    with pytest.raises(GraphError):
        store.snapshot("no")
    store.create_indices()
    store.create_indices()
    store.drop_indices()
    assert store.metadata().first()["num_edges"] == 3


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long, weight int"))
    assert reads.get_nodes(g).count() == 0 and reads.degrees(g).count() == 0
    assert partitions.node_ranges_by_width(g, 3).count() == 0 and partitions.node_ranges_by_count(g, 3).count() == 0
    assert g.metadata().first()["num_nodes"] == 0
