"""Kernels against plain Python on small random graphs, and their invariants."""

import heapq
import random
import re
from itertools import permutations

import pyarrow as pa
import pytest

from skein.model import Graph, GraphError, GraphOptions
from skein.operators import betweenness, bfs, components, pagerank, scans, sssp, triangles
from skein.plans.scratch import materialize


def make(spark, n, m, seed, directed=True):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(9)) for _ in range(m)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight int"), spark.range(n), GraphOptions(directed=directed))
    g = g.with_(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"))
    return g, [tuple(r) for r in g.edges.collect()]


@pytest.fixture(scope="module")
def case(spark):
    return make(spark, 40, 90, 5)


def depths(edges, source):
    depth, queue = {source: 0}, [source]
    for u in queue:
        for a, b, _ in edges:
            if a == u and b not in depth:
                depth[b] = depth[u] + 1
                queue.append(b)
    return depth


def test_bfs(case):
    g, edges = case
    source = edges[0][0]
    tree = bfs.bfs(g, source)
    want = depths(edges, source)
    assert {r["id"]: r["depth"] for r in tree.collect()} == want
    assert {r["id"]: r["depth"] for r in bfs.bfs_by_edges(g, source).collect()} == want
    assert all(r["n"] == 0 for r in bfs.bfs_violations(g, source, tree).collect())
    broken = tree.withColumn("depth", tree["depth"] + (tree["id"] != source).cast("int"))
    assert any(r["n"] for r in bfs.bfs_violations(g, source, broken).collect())
    stats = bfs.bfs_stats(g, tree).first()
    assert (stats["num_visited"], stats["sum_out_degree"]) == (len(want), sum(a in want for a, _, _ in edges))
    with pytest.raises(GraphError):
        bfs.bfs(g, 999)


def test_long_chain_merges_levels(spark):
    g = Graph.from_edges(spark.createDataFrame([(i, i + 1, 1) for i in range(20)], "src long, dst long, weight int"))
    assert {r["id"]: r["depth"] for r in bfs.bfs(g, 0).collect()} == {i: i for i in range(21)}


def test_long_chain_merges_distances(spark):
    # The chain's nodes are reached at once over a long way, then round by round over a shorter one.
    rows = [(i, i + 1, 2) for i in range(20)] + [(0, i, 100) for i in range(2, 21)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, weight int"))
    for delta in (None, 1, 50):
        assert sorted(tuple(r) for r in sssp.sssp(g, 0, delta).collect()) == [(i, 2 * i) for i in range(21)]


def test_sssp_refuses(case, spark):
    with pytest.raises(GraphError):
        sssp.sssp(case[0], 999)
    g = Graph.from_edges(spark.createDataFrame([(0, 1, -1)], "src long, dst long, weight int"))
    with pytest.raises(GraphError):
        sssp.sssp(g, 0)


def test_sssp(case):
    g, edges = case
    source = edges[0][0]
    dist, heap = {}, [(0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for a, b, w in edges:
                if a == u:
                    heapq.heappush(heap, (d + w, b))
    assert {r["id"]: r["dist"] for r in sssp.sssp(g, source).collect()} == dist
    assert {r["id"]: r["dist"] for r in sssp.sssp(g, source, delta=3).collect()} == dist


@pytest.mark.parametrize("seed,n,m", [(1, 60, 40), (2, 60, 55), (3, 30, 0)])
def test_components(spark, seed, n, m):
    g, edges = make(spark, n, m, seed)
    label = {i: i for i in range(n)}
    changed = True
    while changed:
        changed = False
        for a, b, _ in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {r["id"]: r["component"] for r in components.connected_components(g.edges, g.nodes).collect()} == label
    touched = {x for a, b, _ in edges for x in (a, b)}
    assert {r["id"]: r["component"] for r in components.connected_components(g.edges).collect()} == {i: label[i] for i in touched}


def test_components_of_a_long_path(spark):
    edges = [(i * 37 % 300, (i + 1) * 37 % 300) for i in range(299)]
    found = components.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 300


def test_pagerank(case):
    g, edges = case
    n, rank = 40, {i: 1 / 40 for i in range(40)}
    out = {}
    for a, _, _ in edges:
        out[a] = out.get(a, 0) + 1
    for _ in range(10):
        got = {}
        for a, b, _ in edges:
            got[b] = got.get(b, 0) + rank[a] / out[a]
        rank = {i: 0.15 / n + 0.85 * got.get(i, 0) for i in range(n)}
    found = {r["id"]: r["rank"] for r in pagerank.pagerank(g).collect()}
    assert found.keys() == rank.keys() and all(abs(found[i] - rank[i]) < 1e-12 for i in rank)
    top = [r["id"] for r in pagerank.top_k(pagerank.pagerank(g), 3).collect()]
    assert top == sorted(rank, key=lambda i: (-rank[i], i))[:3]


def test_ranks_sum_to_one_without_dangling_nodes(spark):
    g = Graph.from_edges(spark.createDataFrame([(i, (i * 7 + k) % 20, 0) for i in range(20) for k in (1, 2)], "src long, dst long, weight int"))
    ranks = pagerank.pagerank(g, max_iter=60, tolerance=1e-10)
    assert abs(ranks.groupBy().sum("rank").first()[0] - 1) < 1e-9


@pytest.mark.parametrize("directed", [True, False])
def test_triangles(spark, directed):
    g, edges = make(spark, 14, 60, 7, directed)
    e = {(a, b) for a, b, _ in edges if a != b}
    nodes = range(14)
    trust = sum((a, b) in e and (a, c) in e and (b, c) in e for a, b, c in permutations(nodes, 3))
    cycle = sum((a, b) in e and (b, c) in e and (c, a) in e for a, b, c in permutations(nodes, 3)) // 3
    either = {frozenset(x) for x in e}
    full = sum({frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= either for a, b, c in permutations(nodes, 3)) // 6
    found = triangles.triangle_counts(g).first()
    assert tuple(found) == (trust, cycle, full)
    if not directed:
        assert trust == 6 * full and cycle == 2 * full


def test_sample_graph_counts(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 7), (7, 8), (8, 7)], "src long, dst long")
    assert tuple(triangles.triangle_counts(Graph.from_edges(edges)).first()) == (1, 0, 1)
    assert tuple(triangles.triangle_counts(Graph.from_edges(edges, options=GraphOptions(directed=False))).first()) == (6, 2, 1)


def test_wedges_are_no_rows(spark, case):
    # Rows are dealt by one node or one edge of the graph, never by the two ends of a wedge.
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = triangles.triangle_counts(case[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(len(re.findall(r"#", keys)) == 1 for keys in dealt)


def test_betweenness(spark):
    g, edges = make(spark, 15, 40, 11)
    e = {(a, b) for a, b, _ in edges if a != b}
    score = {i: 0.0 for i in range(15)}
    for s in range(15):
        depth, paths, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for a, b in e:
                if a == u:
                    if b not in depth:
                        depth[b] = depth[u] + 1
                        order.append(b)
                        paths[b] = 0.0
                    if depth[b] == depth[u] + 1:
                        paths[b] += paths[u]
        dep = {v: 0.0 for v in order}
        for w in reversed(order):
            for a, b in e:
                if b == w and a in depth and depth[a] + 1 == depth[w]:
                    dep[a] += paths[a] / paths[w] * (1 + dep[w])
        for v in order:
            if v != s:
                score[v] += dep[v]
    found = {r["id"]: r["score"] for r in betweenness.betweenness(g, normalise=False).collect()}
    assert all(abs(found[i] - score[i]) < 1e-9 for i in score)
    assert max(r["score"] for r in betweenness.betweenness(g).collect()) == 1
    found = {r["id"]: r["score"] for r in betweenness.betweenness(g, normalise=False, batch=4).collect()}
    assert len(found) == 15 and all(abs(found[i] - score[i]) < 1e-9 for i in score)


def test_betweenness_of_a_ring_needs_no_jobs_by_level(spark):
    g = Graph.from_edges(spark.createDataFrame([(3 * i, 3 * (i + 1) % 180, 1) for i in range(60)], "src long, dst long, weight int"), spark.range(0, 183, 3))
    spark.sparkContext.setJobGroup("ring", "ring")
    try:
        found = {r["id"]: r["score"] for r in betweenness.betweenness(g, normalise=False).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {**{3 * i: 59 * 58 / 2 for i in range(60)}, 180: 0}
    assert jobs < 60


@pytest.mark.parametrize("m,levels", [(60, 1_000_000), (400, 1_000_000), (60, 3)])
def test_betweenness_in_tasks_equals_joins(spark, monkeypatch, m, levels):
    g, _ = make(spark, 50, m, 3)
    sources = g.nodes.where("id % 3 = 0")
    found = dict(betweenness.betweenness(g, sources, False, levels).collect())
    monkeypatch.setattr(betweenness, "TASK_EDGES", 0)
    joined = dict(betweenness.betweenness(g, sources, False, levels).collect())
    assert found.keys() == joined.keys() and all(abs(found[i] - joined[i]) < 1e-9 for i in joined) and max(joined.values()) > 0


def test_betweenness_of_a_part_is_a_row_for_each_node():
    # What a task hands on does not grow with its sources, and every source belongs to one task.
    rnd = random.Random(4)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(90)) if a != b})
    longs = [a << 32 | b for a, b in pairs]
    found = []
    for tasks in (1, 3):
        total = {}
        for part in range(tasks):
            batches = [pa.record_batch({"part": [part] * 2, "start": [False, True], "longs": pa.array([longs[:40], list(range(20))], pa.list_(pa.int64()))}), pa.record_batch({"part": [part] * 2, "start": [False, True], "longs": pa.array([longs[40:], list(range(20, 30))], pa.list_(pa.int64()))})]
            (out,) = betweenness._part(tasks, 30, 1_000_000, iter(batches))
            assert out.num_rows <= 30
            for number, score in zip(out["number"].to_pylist(), out["score"].to_pylist()):
                total[number] = total.get(number, 0) + score
        found.append(total)
    assert found[0] and found[0].keys() == found[1].keys() and all(abs(found[0][i] - found[1][i]) < 1e-9 for i in found[0])


def test_csr(case):
    g, edges = case
    flat = sorted((a, b) for a, b, _ in edges)
    for r in scans.csr(g).collect():
        if r["degree"]:
            assert {b for _, b in flat[r["first"] : r["first"] + r["degree"]]} == {b for a, b in flat if a == r["id"]}
