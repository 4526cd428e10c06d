"""Text formats, ETL checks, generators and streams."""

from skein.functions import etl, generators
from skein.model import Graph, GraphOptions
from skein.operators import reads
from skein.sources import text
from skein.sources.store import GraphStore
from skein.streaming import ingest as streams


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_edge_lines(spark):
    found = text.parse_edges(lines(spark, "# c", "% c", "", "  1\t2 ", "3 4 9", "x 1", "5", "6 7 zz")).collect()
    assert sorted(map(tuple, found)) == [(1, 2, 0), (3, 4, 9), (6, 7, 0)]


def test_adjacency_lines(spark):
    found = text.parse_adjacency(lines(spark, "1 2 3,4", "2 0", "3 2 5 6", "# 9 1 1"))
    assert {r["node_id"]: r["edgelist"] for r in found.collect()} == {1: [3, 4], 2: [], 3: [5, 6]}
    again = text.parse_adjacency(text.adjacency_lines(found))
    assert sorted(again.collect()) == sorted(found.collect())


def test_files_round_trip(spark, tmp_path):
    base = f"file://{tmp_path}"
    g = Graph.from_edges(generators.chain(spark, 10))
    text.write_lines(text.edge_lines(g), f"{base}/e")
    assert sorted(text.read_edges(spark, f"{base}/e").collect()) == sorted(g.edges.collect())
    text.append_run_log(spark, f"{base}/log", dataset="a", seconds=1.0)
    text.append_run_log(spark, f"{base}/log", dataset="a", seconds=3.0)
    log = spark.read.csv(f"{base}/log", header=True, inferSchema=True)
    assert text.run_log_means(log, ["dataset"]).first()["seconds"] == 2.0


def test_ingest_dense(spark, tmp_path):
    base = f"file://{tmp_path}"
    text.write_lines(lines(spark, "10 30", "30 50", "50 10", "10 30"), f"{base}/raw")
    store = etl.ingest(spark, f"{base}/raw", f"{base}/store", GraphOptions(name="x"), random_weights=True, dense=True, index=True)
    assert sorted((r["src"], r["dst"]) for r in store.graph().edges.collect()) == [(0, 1), (1, 2), (2, 0)]
    assert etl.density(store.graph().nodes).first()["dense"]
    assert all(0 <= r["weight"] < 256 for r in store.graph().edges.collect())


def test_weights_are_symmetric(spark):
    e = generators.uniform(spark, 6, 4)
    both = etl.with_random_weights(e).union(etl.with_random_weights(etl.reverse(e)))
    pairs = {}
    for r in both.collect():
        assert pairs.setdefault(frozenset((r["src"], r["dst"])), r["weight"]) == r["weight"]


def test_unsorted_rows(spark):
    rows = [(i, i) for i in range(50)]
    rows[20], rows[21] = (20, 21), (21, 20)
    df = spark.createDataFrame(rows, "at long, src long")
    assert [r["at"] for r in etl.unsorted_rows(df, "at", ["src"]).collect()] == [21]
    assert etl.unsorted_rows(df.where("at < 15"), "at", ["src"]).isEmpty()


def test_generators_are_fixed(spark):
    for make in (generators.rmat, generators.uniform):
        a, b = make(spark, 7, 4, 3), make(spark, 7, 4, 3)
        assert sorted(a.collect()) == sorted(b.collect()) != sorted(make(spark, 7, 4, 4).collect())
        assert a.where("src = dst").isEmpty() and a.count() == a.select("src", "dst").distinct().count() <= 4 * 128
    assert reads.get_out_degree(Graph.from_edges(generators.star(spark, 9)), 1) == 9


def test_stream_into_store(spark, tmp_path):
    base = f"file://{tmp_path}"
    store = GraphStore(spark, base, GraphOptions(name="s"))
    store.create(Graph.from_edges(generators.chain(spark, 3)))
    generators.star(spark, 4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("src long, dst long, weight int").parquet(f"{base}/in")
    streams.into_store(stream, store, f"{base}/cp").awaitTermination(120)
    assert store.graph().edges.where("src = 1").count() == 4 and store.versions()[-1] >= 2


def test_stream_degrees(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) ts, id % 2 src, id dst from range(10)").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("ts timestamp, src long, dst long").parquet(f"{base}/in")
    query = streams.degree_counts(stream, "5 minutes", "1 minute").writeStream.format("memory").queryName("degree_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(r["degree"] for r in spark.table("degree_test").collect()) == 10


def test_registry(spark, tmp_path):
    import json

    import pytest

    from skein.model import GraphError
    from skein.sources.registry import read_registry

    good = {"dataset_name": "k10", "graph_path": "/data/k10", "num_nodes": 1024, "num_edges": 8192, "directed": False}
    (tmp_path / "ok.json").write_text(json.dumps([good]))
    found = read_registry(spark, f"file://{tmp_path}/ok.json")
    assert found["k10"].num_edges == 8192 and not found["k10"].options().directed
    for bad in ([good, good], [{**good, "num_nodes": 0}], [{**good, "graph_path": None}]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(GraphError):
            read_registry(spark, f"file://{tmp_path}/bad.json")
