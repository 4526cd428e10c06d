"""The command line, over an edge list and over a store."""

import pytest

from skein.__main__ import main


@pytest.fixture
def edge_list(tmp_path):
    path = tmp_path / "edges.txt"
    path.write_text("# a comment\n1 2 5\n2 3 1\n1 3 9\n")
    return str(path)


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(str(path)).collect())


@pytest.mark.parametrize("command,more,want", [
    ("bfs", ["--start", "1"], [(1, 1, 0), (2, 1, 1), (3, 1, 1)]),
    ("sssp", ["--start", "1"], [(1, 0), (2, 5), (3, 6)]),
    ("sssp", ["--start", "1", "--delta", "2"], [(1, 0), (2, 5), (3, 6)]),
    ("components", [], [(1, 1), (2, 1), (3, 1)]),
    ("components", ["--top", "1"], [(1, 3)]),
    ("triangles", [], [(1, 0, 1)]),
    ("betweenness", [], [(1, 0.0), (2, 0.0), (3, 0.0)]),
])
def test_kernels(spark, edge_list, tmp_path, command, more, want):
    main([command, edge_list, "--out", str(tmp_path / "out"), *more])
    assert rows(spark, tmp_path / "out") == want


def test_trials_are_logged(spark, edge_list, tmp_path):
    main(["pagerank", edge_list, "--top", "1", "--trials", "2", "--log", str(tmp_path / "log"), "--out", str(tmp_path / "out")])
    assert [r[0] for r in rows(spark, tmp_path / "out")] == [3]
    log = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert sorted((r["kernel"], r["trial"], r["rows"]) for r in log.collect()) == [("pagerank", "0", "1"), ("pagerank", "1", "1")]


def test_store_commands(spark, edge_list, tmp_path, capsys):
    root = str(tmp_path / "store")
    main(["ingest", edge_list, "--out", root, "--dense", "--index"])
    main(["drop-index", root])
    assert not list((tmp_path / "store").glob("*/v=1/edges_by_dst"))
    main(["index", root])
    assert list((tmp_path / "store").glob("*/v=1/edges_by_dst"))
    main(["snapshot", root, "--snapshot", "first"])
    assert "first" in capsys.readouterr().out
    main(["dump", root, "--snapshot", "first", "--top", "2", "--out", str(tmp_path / "dump")])
    assert rows(spark, tmp_path / "dump") == [("src=0 dst=1 weight=5",), ("src=0 dst=2 weight=9",)]
    main(["metadata", root, "--out", str(tmp_path / "metadata")])
    assert spark.read.parquet(str(tmp_path / "metadata")).first()["num_edges"] == 3
    main(["create", root, "--name", "none"])
    main(["metadata", root, "--name", "none"])
    assert "none" in capsys.readouterr().out


def test_weights(spark, edge_list, tmp_path):
    main(["weights", edge_list, "--out", str(tmp_path / "weighted")])
    found = spark.read.schema("src long, dst long, weight int").csv(str(tmp_path / "weighted"), sep="\t").collect()
    assert sorted((r["src"], r["dst"]) for r in found) == [(1, 2), (1, 3), (2, 3)] and all(0 <= r["weight"] < 256 for r in found)


@pytest.mark.parametrize("args", [["ingest", "x"], ["weights", "x"], ["bfs", "x", "--trials", "0"], ["walk", "x"]])
def test_what_is_refused(args):
    with pytest.raises(SystemExit):
        main(args)
