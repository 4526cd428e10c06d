"""Command line.

Kernels (pagerank, bfs, sssp, components, triangles, betweenness) run over an edge
list, ``--trials`` times if asked, with each run's seconds appended to ``--log``.
``ingest`` stores an edge list, ``weights`` gives it random weights.  ``create``,
``index``, ``drop-index``, ``snapshot``, ``metadata`` and ``dump`` work on the
store whose root takes the edge list's place.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.etl import ingest, with_random_weights
from skein.model import Graph, GraphOptions, Layout
from skein.operators import betweenness, bfs, components, pagerank, scans, sssp, triangles
from skein.plans.scratch import materialize
from skein.sources.store import GraphStore
from skein.sources.text import append_run_log, dump, read_edges

KERNELS = ["pagerank", "bfs", "sssp", "components", "triangles", "betweenness"]
STORE = ["create", "index", "drop-index", "snapshot", "metadata", "dump"]


def _kernel(g: Graph, a: argparse.Namespace) -> DataFrame:
    source = a.start if a.start is not None else bfs.random_start(g) if a.command in ("bfs", "sssp") else None
    if a.command == "pagerank":
        ranks = pagerank.pagerank(g, max_iter=a.iterations, tolerance=a.tolerance)
        return pagerank.top_k(ranks, a.top) if a.top else ranks
    if a.command == "bfs":
        return bfs.bfs(g, source)
    if a.command == "sssp":
        return sssp.sssp(g, source, a.delta)
    if a.command == "components":
        found = components.connected_components(g.edges, g.nodes)
        return pagerank.top_k(scans.component_sizes(found), a.top, "n", "component") if a.top else found
    if a.command == "triangles":
        return triangles.triangle_counts(g)
    sample = g.nodes.orderBy(F.xxhash64("id")).limit(a.sources)
    return betweenness.betweenness(g, sample)


def _on_store(spark: SparkSession, a: argparse.Namespace, options: GraphOptions) -> DataFrame | None:
    store = GraphStore(spark, a.edges, options)
    if a.command == "create":
        none = spark.createDataFrame([], "src long, dst long, weight int")
        store.create(Graph(none.select(F.col("src").alias("id")), none, options))
    elif a.command == "index":
        store.create_indices()
    elif a.command == "drop-index":
        store.drop_indices()
    elif a.command == "snapshot":
        print(store.checkpoint(a.snapshot))
    elif a.command == "metadata":
        return store.metadata()
    else:
        g = store.snapshot(a.snapshot) if a.snapshot else store.graph()
        return dump(g.edges, ["src", "dst"], a.top or 20)
    return None


def _trials(g: Graph, a: argparse.Namespace) -> DataFrame:
    """The last run's result; what each run took goes to the log."""
    for trial in range(a.trials):
        begun = time.perf_counter()
        result = materialize(_kernel(g, a), a.command)
        if a.log:
            append_run_log(g.spark, a.log, kernel=a.command, graph=a.name, trial=trial, rows=result.count(), seconds=round(time.perf_counter() - begun, 3))
    return result


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m skein", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=[*KERNELS, "ingest", "weights", *STORE])
    p.add_argument("edges", help="edge list: src, dst and maybe a weight on each line; or a store's root")
    p.add_argument("--out", help="folder for the result; without it 20 rows are shown")
    p.add_argument("--undirected", action="store_true")
    p.add_argument("--name", default="graph")
    p.add_argument("--layout", choices=[x.value for x in Layout], default=GraphOptions().layout.value)
    p.add_argument("--start", type=int)
    p.add_argument("--iterations", type=int, default=10)
    p.add_argument("--tolerance", type=float)
    p.add_argument("--delta", type=int)
    p.add_argument("--sources", type=int, default=16)
    p.add_argument("--top", type=int, default=0)
    p.add_argument("--trials", type=int, default=1, help="kernels: so many runs")
    p.add_argument("--log", help="kernels: run log to append to")
    p.add_argument("--snapshot", help="snapshot: its name; dump: which one to read")
    p.add_argument("--dense", action="store_true", help="ingest: renumber ids to 0..n-1")
    p.add_argument("--weights", action="store_true", help="ingest: give random weights")
    p.add_argument("--index", action="store_true", help="ingest: also write the copy by destination")
    a = p.parse_args(argv)
    if a.command in ("ingest", "weights") and not a.out:
        p.error(f"{a.command} needs --out")
    if a.trials < 1:
        p.error("--trials must be 1 or more")
    spark = SparkSession.builder.getOrCreate()
    options = GraphOptions(name=a.name, directed=not a.undirected, layout=Layout(a.layout))
    if a.command == "ingest":
        print(ingest(spark, a.edges, a.out, options, random_weights=a.weights, dense=a.dense, index=a.index).path)
        return
    if a.command == "weights":
        with_random_weights(read_edges(spark, a.edges)).write.csv(a.out, sep="\t")
        return
    if a.command in STORE:
        result = _on_store(spark, a, options)
    else:
        g = Graph.from_edges(read_edges(spark, a.edges), options=options)
        result = _trials(g.with_(edges=materialize(g.edges, "edges")), a)
    if result is not None and a.out:
        result.write.parquet(a.out)
    elif result is not None:
        result.show(20, False)


if __name__ == "__main__":
    main()
