"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors fall into buckets of several tables, each keyed by floors of a few
Gaussian projections.  A query visits, in every table, the buckets in which a
near vector most probably lies, in order of that probability.  All queries that
visit a bucket are compared with its vectors in one block; the best of each task
are merged by query.  Largest inner products become nearest points by one added
coordinate that gives all vectors the same length.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.joins import attach
from skein.plans.scratch import materialize
from skein.plans.ship import map_batches

#: Vectors and queries that are compared in one block; larger buckets are dealt into several.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 4096
#: Vectors that the number of probes is fitted on (and components, of long ones), queries among them, and the recall to reach on them.
FIT_VECTORS, FIT_COMPONENTS, FIT_QUERIES, FIT_RECALL = 20_000, 4_000_000, 200, 0.96
#: Buckets on either side of a query's own that a probe may move in each projection.
REACH = 2


@dataclass(frozen=True)
class Hashing:
    """Projections of all tables; ``a`` is tables x projections x dimensions, in bucket widths."""

    a: np.ndarray
    b: np.ndarray
    scale: float
    probes: int = 1
    distance: float = 1.0

    def places(self, points: np.ndarray) -> np.ndarray:
        """Projections of points, tables x points x projections."""
        return np.einsum("nd,tkd->tnk", points, self.a) + self.b[:, None, :]

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """One long for each cell (last axis)."""
        out = np.zeros(cells.shape[:-1], np.int64)
        for k in range(cells.shape[-1]):
            out = out * np.int64(1 << 12) + (cells[..., k] + (1 << 11)) % (1 << 12)
        return out

    def moves(self) -> np.ndarray:
        return np.array(list(itertools.product(range(-REACH, REACH + 1), repeat=self.a.shape[1])))

    def probe_order(self, place: np.ndarray) -> np.ndarray:
        """For queries' places in one table, the moves from the most to the least probable (indices into ``moves``)."""
        inside = place - np.floor(place)
        # A neighbour at this distance lies this many widths off in a projection, as a standard deviation.
        spread = max(self.distance, 1e-9) * self.width_inverse
        edges = np.arange(-REACH, REACH + 2)[None, None, :] - inside[:, :, None]
        below = _normal(edges / spread)
        logs = np.log(np.maximum(below[:, :, 1:] - below[:, :, :-1], 1e-300))
        moves = self.moves() + REACH
        score = np.zeros((len(place), len(moves)))
        for k in range(moves.shape[1]):
            score += logs[:, k, :][:, moves[:, k]]
        return np.argsort(-score, axis=1, kind="stable")

    @property
    def width_inverse(self) -> float:
        return float(np.sqrt((self.a**2).sum(axis=2).mean() / self.a.shape[2]))


def _normal(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, by its logistic-cubic approximation."""
    return 1.0 / (1.0 + np.exp(np.clip(-x * (1.5976 + 0.070565992 * x * x), -700, 700)))


def clean(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id long, v)`` of the rows that take part: finite components, not all zero.

    Single floats stay as they are, which halves what travels; all else becomes double.
    """
    v = F.col("v")
    kind = "array<float>" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def _points(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled into the unit ball and lifted onto the unit sphere."""
    small = v / longest
    return np.hstack([small, np.sqrt(np.maximum(0.0, 1.0 - (small**2).sum(axis=1)))[:, None]])


def _aims(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])


def fit(sample: np.ndarray, total: int, longest: float, k: int, tables: int, projections: int, width: float, seed: int) -> Hashing:
    """Choose bucket scale and number of probes on a bounded sample.

    The neighbours that must be found are as many as fall into the sample of the
    ``k`` nearest of all, but one at least; as the sample is thinner than the
    whole, they are no nearer than the real ones.
    """
    dims = sample.shape[1] + 1
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(tables, projections, dims)), rng.uniform(size=(tables, projections))
    queries = sample[: min(FIT_QUERIES, len(sample))]
    products = queries @ sample.T
    products[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = max(1, min(len(sample) - 1, round(k * len(sample) / max(total, 1))))
    if len(sample) < 2:
        return Hashing(a / width, b, longest, 1, 1.0)
    best = np.argpartition(-products, near - 1, axis=1)[:, :near]
    points, aims = _points(sample, longest), _aims(queries)
    distances = np.linalg.norm(aims[:, None, :] - points[best], axis=2)
    typical = float(np.sqrt((distances**2).mean()))
    typical = typical if typical > 1e-6 else 1e-6
    hashing = Hashing(a / (width * typical), b, longest, 1, typical)
    cells = Hashing.keys(np.floor(hashing.places(points)).astype(np.int64))
    found_at = np.full(best.shape, np.iinfo(np.int64).max)
    for t in range(tables):
        place = hashing.places(aims)[t]
        order = hashing.probe_order(place)
        keys = Hashing.keys(np.floor(place).astype(np.int64)[:, None, :] + hashing.moves()[order])
        hit = cells[t][best][:, :, None] == keys[:, None, :]
        first = np.where(hit.any(axis=2), hit.argmax(axis=2), np.iinfo(np.int64).max)
        found_at = np.minimum(found_at, first)
    needed = np.sort(found_at.ravel())
    at = int(needed[min(len(needed) - 1, math.ceil(FIT_RECALL * len(needed)) - 1)])
    most = (2 * REACH + 1) ** projections
    return Hashing(hashing.a, b, longest, min(most, at + 1), typical)


def _hashed(hashing: Hashing, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tab", "cell", "id", "v"]
        moves = hashing.moves()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024 if queries else 65536):
                part = batch.slice(at, 1024 if queries else 65536)
                if not part.num_rows:
                    continue
                ids = part.column(0).to_numpy()
                lists = part.column(1)
                v = lists.flatten().to_numpy().reshape(part.num_rows, -1).astype(float)
                place = hashing.places(_aims(v) if queries else _points(v, hashing.scale))
                for t in range(place.shape[0]):
                    cell = np.floor(place[t]).astype(np.int64)
                    if queries:
                        order = hashing.probe_order(place[t])[:, : hashing.probes]
                        keys = Hashing.keys(cell[:, None, :] + moves[order])
                        rows = np.repeat(np.arange(len(ids)), keys.shape[1])
                        keys = keys.ravel()
                    else:
                        keys, rows = Hashing.keys(cell), np.arange(len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), pa.array(ids[rows]), lists.take(pa.array(rows))], names=names)

    return run


def products(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first component to the last, so that a pair scores the same in every block."""
    return np.add.accumulate(vectors * q, axis=1)[:, -1] + 0.0


def _compare(k: int):
    """Blocks arrive as rows in order of their key, queries before vectors; out go each task's best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if best:
                n = [len(s) for s, _ in best.values()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.fromiter(best, np.int64, len(best)), n)), pa.array(np.concatenate([i for _, i in best.values()])), pa.array(np.concatenate([s for s, _ in best.values()]))], names=["query_id", "rep", "score"])
                best.clear()

        def block(kinds: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
            split = int(np.searchsorted(kinds, 1))
            if split == 0 or split == len(ids):
                return
            vectors, vids = v[split:], ids[split:]
            # The matrix product rounds as it likes: what it puts near the cut is measured again, in one fixed order.
            slack = vectors.shape[1] * 1e-15 * np.linalg.norm(v[:split], axis=1) * np.linalg.norm(vectors, axis=1).max()
            for at in range(0, split, 512):
                upto = min(split, at + 512)
                scores = v[at:upto] @ vectors.T
                if scores.shape[1] > 4 * k:
                    # Ties at the cut stay in, so that ids can decide.
                    bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - slack[at:upto]
                else:
                    bar = np.full(upto - at, -np.inf)
                for r in range(upto - at):
                    keep = np.nonzero(scores[r] >= bar[r])[0]
                    s, i, q = products(v[at + r], vectors[keep]), vids[keep], int(ids[at + r])
                    if q in best:
                        s, i = np.concatenate([best[q][0], s]), np.concatenate([best[q][1], i])
                    i, first = np.unique(i, return_index=True)
                    s = s[first]
                    order = np.lexsort((i, -s))[:k]
                    best[q] = s[order], i[order]

        held: list[pa.RecordBatch] = []
        key = None

        def work() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            v = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(float)
            block(table.column("kind").to_numpy(), table.column("id").to_numpy(), v)

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                now = tuple(keys[:, a])
                if now != key and held:
                    work()
                    held = []
                    if len(best) > 50_000:
                        yield from flush()
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            work()
        yield from flush()

    return run


def _smallest_ids(least: int):
    """Of each batch, the smallest ids of every distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, rows = b.column(0).to_numpy(), b.column(1).to_pylist()
            groups: dict[tuple, list[int]] = {}
            first: dict[tuple, int] = {}
            for n, (i, v) in enumerate(zip(ids.tolist(), rows, strict=True)):
                groups.setdefault(t := tuple(v), []).append(i)
                first.setdefault(t, n)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(first.values(), pa.int64())), pa.array([sorted(g)[:least] for g in groups.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    return run


def _nearest(index: DataFrame, probes: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``(query_id, top array<struct<minus,vec_id>>)``: each query's best of the vectors that share a bucket with it."""
    # Buckets too large for one block, and into how many parts each side of them is dealt.
    count = lambda df, c: df.groupBy("tab", "cell").agg(F.count("*").alias(c))
    full = count(index.drop("v"), "n").where(F.col("n") > BLOCK_VECTORS)
    many = count(probes.drop("v"), "m").where(F.col("m") > BLOCK_QUERIES)
    parts = lambda c, size: F.ceil(F.coalesce(F.col(c), F.lit(1)) / size).cast("int")
    large = materialize(full.join(many, ["tab", "cell"], "full").select("tab", "cell", parts("n", BLOCK_VECTORS).alias("vparts"), parts("m", BLOCK_QUERIES).alias("qparts")), "large-buckets")
    one = F.lit(1)

    def dealt(side: DataFrame, kind: int) -> DataFrame:
        placed = attach(side, large, ["tab", "cell"])
        own, all_of = ("qparts", "vparts") if kind == 0 else ("vparts", "qparts")
        part = F.pmod(F.xxhash64("id"), F.coalesce(F.col(own), one)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(all_of), one) - 1))
        out = placed.select("tab", "cell", part.alias("own"), each.alias("other"), F.lit(kind).alias("kind"), "id", "v")
        return out.select("tab", "cell", F.col("other" if kind == 0 else "own").alias("vpart"), F.col("own" if kind == 0 else "other").alias("qpart"), "kind", "id", "v")

    both = dealt(probes, 0).unionByName(dealt(index, 1))
    blocks = both.repartition("tab", "cell", "vpart", "qpart").sortWithinPartitions("tab", "cell", "vpart", "qpart", "kind")
    found = blocks.transform(map_batches, _compare(k + 1), "query_id long, rep long, score double")
    # A pair that met in several tables counts once.  The best classes of each query (its own may be one of them), then their ids.
    met = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    best = met.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "rep"))), 1, k + 1).alias("best"))
    classes_found = best.select("query_id", F.explode("best").alias("b")).select("query_id", F.col("b.rep").alias("rep"), F.col("b.minus").alias("minus"))
    each = classes_found.join(classes.select("rep", "ids"), "rep").select("query_id", "minus", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("minus", "vec_id"))), 1, k).alias("top"))


def one_vector_an_id(rows: DataFrame) -> DataFrame:
    """Of different vectors under one id, the one whose hash is smallest; only ids and hashes are shuffled."""
    hashed = rows.withColumn("_h", F.xxhash64("v"))
    clash = materialize(hashed.groupBy("vec_id").agg(F.min("_h").alias("_least"), F.max("_h").alias("_most")).where("_least < _most").drop("_most"), "clashing-ids")
    return attach(hashed, clash, ["vec_id"]).where("_least is null or _h = _least").select("vec_id", "v")


def search(embeddings: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", tables: int = 6, projections: int = 4, width: float = 1.0, seed: int = 11) -> DataFrame:
    """The ``k`` nearest vectors found for every query, by inner product.

    ``is_query`` is a condition on ``vec_id``; queries are searched among all
    other rows.  Returns ``(query_id long, rank int from 1, vec_id long, score
    double)``: scores are inner products of the vectors as stored, in double
    precision; ties go to the smaller id.

    Null, zero and non-finite vectors, vectors of another length than most, and
    rows without id take no part.  Equal vectors form one class, searched once,
    of which only the smallest ``k + 1`` ids can be among a query's nearest.  Rows
    that repeat an id with the same vector count once; of different vectors under
    one id only that with the smallest hash takes part, so an id is never twice
    among a query's nearest.  With fewer than ``k`` other vectors there are fewer rows; a query whose buckets hold fewer is
    compared with all vectors.  An empty table gives no rows; other columns are
    not read.

    Every row is indexed; the number of probes is fitted on a sample of at most
    FIT_VECTORS rows.  Buckets are dealt into blocks of bounded size.
    """
    spark = embeddings.sparkSession
    rows = clean(embeddings, vec_id, vector)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    kind = rows.schema["v"].dataType.simpleString()
    rows = one_vector_an_id(rows.where(F.size("v") == lengths["n"]))
    local = rows.transform(map_batches, _smallest_ids(k + 1), f"v {kind}, ids array<long>")
    classes = local.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    classes = materialize(classes.withColumn("rep", F.col("ids")[0]), "classes")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm"), F.sum(F.size("ids")).alias("ids")).first()
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(max(2, min(FIT_VECTORS, FIT_COMPONENTS // lengths["n"]))).select("v").collect()], float)
    hashing = fit(sample, stats["n"], math.sqrt(stats["norm"]) * (1 + 1e-12), k, tables, projections, width, seed)

    queries = materialize(rows.where(is_query).dropDuplicates(["vec_id"]), "queries")
    fields = f"tab int, cell long, id long, v {kind}"
    index = classes.select("rep", "v").transform(map_batches, _hashed(hashing, False), fields)
    probes = queries.select("vec_id", "v").transform(map_batches, _hashed(hashing, True), fields)
    top = materialize(_nearest(index, probes, classes, k), "nearest")
    # A query that its buckets left short is compared with all vectors, block by block.
    least = min(k, stats["ids"] - 1)
    short = queries.join(top.where(F.size("top") >= least).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if not short.isEmpty():
        short = materialize(short, "short")
        parts = max(1, -(-stats["n"] // BLOCK_VECTORS))
        part = F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("long")
        every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        blocks_of_all = classes.select(F.lit(-1).alias("tab"), part.alias("cell"), F.col("rep").alias("id"), "v")
        rest = _nearest(blocks_of_all, short.select(F.lit(-1).alias("tab"), every_part.alias("cell"), F.col("vec_id").alias("id"), "v"), classes, k)
        top = top.where(F.size("top") >= least).unionByName(rest)
    out = top.select("query_id", F.posexplode("top").alias("pos", "t"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.minus")).alias("score"))
