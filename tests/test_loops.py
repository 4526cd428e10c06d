"""Loops leave nothing behind but their result; trees that are none are seen."""

import os

import pytest

from skein.functions.generators import chain
from skein.model import Graph, GraphError
from skein.operators import betweenness, bfs, pagerank, sssp
from skein.plans import joins, loops, scratch
from skein.sources.registry import read_registry


@pytest.fixture
def shared(tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_root", lambda spark: f"file://{tmp_path}")
    return tmp_path


def tables(path):
    return len([x for x in os.listdir(path) if os.listdir(path / x)])


def test_spent_tables_are_deleted(spark, shared):
    g = Graph.from_edges(chain(spark, 40))
    found = {r["id"]: r["depth"] for r in bfs.bfs(g, 0).collect()}
    assert found == {i: i for i in range(41)} and tables(shared) <= bfs.MERGE_LEVELS + 2
    before = tables(shared)
    ranks = pagerank.pagerank(g, tolerance=0.0, max_iter=12)
    assert ranks.count() == 41 and tables(shared) <= before + 2  # nodes and the last ranks
    before = tables(shared)
    scores = {r["id"]: r["score"] for r in betweenness.betweenness(g, g.nodes.where("id = 0"), normalise=False).collect()}
    assert scores == {i: float(max(0, 40 - i)) if i else 0.0 for i in range(41)} and tables(shared) <= before + 2


def test_a_batch_of_sources_is_bounded_by_its_rows(spark, monkeypatch):
    # 5 nodes and 5 rows of state: batches of about one source, whether edges are broadcast or shuffled.
    g = Graph.from_edges(chain(spark, 4))
    sizes, whole = [], betweenness._accumulate
    monkeypatch.setattr(betweenness, "STATE_ROWS", 5)
    monkeypatch.setattr(betweenness, "_accumulate", lambda g, start, *a: (sizes.append(start.count()), whole(g, start, *a))[1])
    for edges in (0, 1000):
        monkeypatch.setattr(betweenness, "BROADCAST_EDGES", edges)
        sources = g.nodes.where("id in (0, 2)")
        found = {r["id"]: r["score"] for r in betweenness.betweenness(g, sources, normalise=False).collect()}
        assert found == {i: float(len(range(0, min(i, 3), 2)) * (4 - i)) for i in range(5)}
    assert len(sizes) == 4 and sum(sizes) == 4


def test_spent_distances_are_deleted(spark, shared):
    g = Graph.from_edges(chain(spark, 18))
    assert sssp.sssp(g, 0, delta=3).count() == 19 and tables(shared) == 5  # those merged after 16 rounds, the last of them, and three rounds since


def test_each_rule_of_a_search_tree_fires(spark):
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 0), (1, 2, 0), (0, 3, 0), (3, 2, 0), (2, 4, 0)], "src long, dst long, weight int"))
    good = [(0, 0, 0), (1, 0, 1), (3, 0, 1), (2, 1, 2), (4, 2, 3)]

    def broken(rows):
        tree = spark.createDataFrame(rows, "id long, parent long, depth int")
        return {r["rule"] for r in bfs.bfs_violations(g, 0, tree).where("n > 0").collect()}

    assert broken(good) == set()
    assert broken([(0, 1, 0), *good[1:]]) == {"source"}
    assert broken([*good[:4], (4, 2, 4)]) == {"depth", "reach"}
    assert broken([*good[:3], (2, 2, 2), good[4]]) >= {"depth", "edge"}
    assert broken([*good[:4], (4, 3, 2)]) == {"edge"}
    assert broken(good[:4]) == {"reach"}


def test_wide_rows_are_no_small_table(spark):
    wide = spark.range(2000).selectExpr("id", "repeat('x', 1000) as t", "array(id, id) as a")
    assert joins.fits(wide) and not joins.fits(wide, size=1_000_000) and not joins.fits(wide, rows=1999)
    assert joins.fits(spark.range(2000), size=100_000) and joins.fits(spark.range(0))


def test_the_registry_looks_for_its_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"dataset_name": "a", "graph_path": "%s", "num_nodes": 2, "num_edges": 1, "directed": true}]' % (tmp_path / "a.txt"))
    path = str(tmp_path / "r.json")
    assert read_registry(spark, path)["a"].num_nodes == 2
    with pytest.raises(GraphError):
        read_registry(spark, path, check_files=True)
    (tmp_path / "a.txt").write_text("0 1\n")
    assert list(read_registry(spark, path, check_files=True)) == ["a"]


def test_dealt_rows_are_sorted_for_every_round(spark):
    rows = spark.createDataFrame([(i * 7919 % 101, i) for i in range(500)], "src long, dst long")
    with loops.dealt_by(rows, "src") as kept:
        parts = [[r["src"] for r in p] for p in kept.rdd.glom().collect()]
    assert sum(map(len, parts)) == 500 and all(p == sorted(p) for p in parts)


def test_an_end_that_is_no_node_gets_no_rank(spark):
    g = Graph(spark.range(2), spark.createDataFrame([(0, 1, 0), (1, 9, 0)], "src long, dst long, weight int"))
    assert sorted((r["id"], round(r["rank"], 6)) for r in pagerank.pagerank(g, max_iter=1).collect()) == [(0, 0.075), (1, 0.5)]
