"""Parts follow the input, so that a task's memory doesn't; hubs and repeats change no result."""

import pytest

from skein.functions import etl
from skein.model import Graph, GraphOptions
from skein.operators import components
from skein.plans import deal
from skein.projections import load


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(deal, "PART_BYTES", 10_000)


def test_undirected_edges_are_dealt_by_the_size_of_their_files(spark, sf_dir, small_parts):
    edges = load(spark, sf_dir, "linechain", directed=False).edges
    parts = -(-deal.input_bytes(edges) // 10_000)
    assert parts > 8 and edges.rdd.getNumPartitions() == parts


def test_an_edge_and_its_reverse_are_grouped_once(spark):
    rows = spark.createDataFrame([(1, 2, 5), (2, 1, 3), (1, 2, 9), (4, 4, 7), (4, 4, 6), (3, 1, None), (None, 1, 1)], "src long, dst long, weight int")
    for how, both in (("min", [(1, 2, 3), (1, 3, 0), (2, 1, 3), (3, 1, 0), (4, 4, 6)]), ("max", [(1, 2, 9), (1, 3, 0), (2, 1, 9), (3, 1, 0), (4, 4, 7)])):
        g = Graph.from_edges(rows, options=GraphOptions(directed=False), on_duplicate=how)
        assert sorted(map(tuple, g.edges.collect())) == both and sorted(r["id"] for r in g.nodes.collect()) == [1, 2, 3, 4]


def test_components_of_many_parts_and_a_hub(spark, monkeypatch):
    # A hub that fills parts alone, a chain, a lone loop: rows are dealt, the hub's are broadcast to.
    dealt, own = [], deal.deal
    monkeypatch.setattr(components, "PART_ROWS", 3)
    monkeypatch.setattr(deal, "PART_ROWS", 3)
    monkeypatch.setattr(components, "deal", lambda df, *keys, rows=None: (dealt.append(rows), own(df, *keys, rows=rows))[1])
    rows = [(100, i) for i in range(50, 90)] + [(i, i + 1) for i in range(20)] + [(7, 7), (200, 200), (100, 50)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    want = {i: 0 for i in range(21)} | {i: 50 for i in range(50, 90)} | {100: 50, 200: 200}
    assert {r["id"]: r["component"] for r in components.connected_components(edges).collect()} == want
    assert any(rows for rows in dealt)
    assert {r["id"]: r["component"] for r in components.connected_components(edges, spark.range(300)).collect()} == {i: i for i in range(300)} | want


def test_an_ingest_parses_and_renumbers_once(spark, tmp_path, monkeypatch):
    written, own = [], etl.materialize
    monkeypatch.setattr(etl, "materialize", lambda df, label: (written.append(label), own(df, label))[1])
    (tmp_path / "e.txt").write_text("# no\n 30\t10 5\n10 20\n30 10 4\nx 1\n7\n")
    store = etl.ingest(spark, str(tmp_path / "e.txt"), str(tmp_path / "s"), GraphOptions(name="g"), dense=True)
    assert sorted(map(tuple, store.graph().edges.collect())) == [(0, 1, 0), (2, 0, 4)] and written == ["parsed", "id-map", "renumbered"]
