"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a graph of nearest neighbours is cut into parts of equal
size with few edges between them, and a small classifier learns to tell a
vector's part, with the parts of its neighbours as soft targets. Every vector
is then indexed in its most probable part; a query goes to its several most
probable parts, and their vectors are reranked by the exact measure. How many
parts a query needs is found on sample vectors that the classifier has not
seen: the fewest that hold ``TARGET`` of their true neighbours.

Parts are split into blocks of bounded size and queries into chunks, so a part
that holds a third of all vectors is many small groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrid.llm.common import stored

#: Vectors the index is fitted on at most: those with the least hashes of their id.
SAMPLE = 4096
#: Vectors of a part on average, while the sample has ``PART_SAMPLE`` for each part.
PART, PART_SAMPLE = 2000, 64
#: Different sample vectors below which there is nothing to learn parts from.
LEAST = 8
#: Neighbours of a vertex of the graph.
DEGREE = 10
#: Share of true neighbours that the probed parts must hold on the unseen sample.
TARGET = 0.97
#: Vectors of a block and queries of a chunk.
BLOCK, CHUNK = 4096, 4096
_HIDDEN, _EPOCHS, _SEED = 64, 40, 7
#: Scores this close to the last one taken are computed anew before ranking.
_SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``x`` nearest to each row number in ``queries``, itself left out."""
    out = np.empty((len(queries), k), dtype=int)
    for at in range(0, len(queries), 512):
        own = queries[at : at + 512]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        out[at : at + 512] = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, slack: float = 0.1, sweeps: int = 8) -> np.ndarray:
    """Part of each row: principal splits in proportion, then moves along the graph.

    A vertex moves to the part of most of its neighbours, largest gain first,
    while that part has room and its own keeps its least size.
    """
    part = np.zeros(len(x), dtype=int)

    def split(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.svd(centred.T @ centred)[0][:, 0]
        ordered = rows[np.argsort(centred @ direction, kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        split(ordered[:cut], first, left)
        split(ordered[cut:], first + left, count - left)

    split(np.arange(len(x)), 0, n_parts)
    mean = len(x) / n_parts
    sizes = np.bincount(part, minlength=n_parts)
    for _ in range(sweeps):
        votes = np.zeros((len(x), n_parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        here = votes[np.arange(len(x)), part]
        best = votes.argmax(axis=1)
        gain = votes.max(axis=1) - here
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            to, own = best[v], part[v]
            if sizes[to] < (1 + slack) * mean and sizes[own] > (1 - slack) * mean:
                part[v] = to
                sizes[to] += 1
                sizes[own] -= 1
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier of parts with one hidden layer, and how many parts to probe."""

    layers: list[np.ndarray]
    probes: int = 1
    n_parts: int = 1

    def chances(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum(unit(x) @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.chances(x).argmax(axis=1) if self.n_parts > 1 else np.zeros(len(x), dtype=int)

    def routes(self, x: np.ndarray) -> np.ndarray:
        if self.n_parts == 1:
            return np.zeros((len(x), 1), dtype=int)
        return np.argsort(-self.chances(x), axis=1, kind="stable")[:, : self.probes]


def train(x: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
    """Weights of the classifier by Adam on soft targets."""
    rng = np.random.default_rng(_SEED)
    d, p = x.shape[1], targets.shape[1]
    layers = [rng.normal(0, np.sqrt(2 / d), (d, _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, np.sqrt(1 / _HIDDEN), (_HIDDEN, p)), np.zeros(p)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    for _ in range(_EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            own = order[at : at + 256]
            w1, b1, w2, b2 = layers
            h = np.maximum(x[own] @ w1 + b1, 0)
            z = np.exp((o := h @ w2 + b2) - o.max(axis=1, keepdims=True))
            d_o = (z / z.sum(axis=1, keepdims=True) - targets[own]) / len(own)
            d_h = (d_o @ w2.T) * (h > 0)
            slopes = [x[own].T @ d_h, d_h.sum(axis=0), h.T @ d_o, d_o.sum(axis=0)]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_sample(x: np.ndarray, n: int, k: int = 5) -> Router:
    """A router for ``n`` vectors, fitted on the different rows of the sample ``x``.

    There are at least two parts, unless fewer than ``LEAST`` rows differ.
    """
    x = np.unique(unit(x), axis=0) if len(x) else x
    if len(x) < LEAST:
        return Router([])
    n_parts = max(2, min(-(-n // PART), len(x) // PART_SAMPLE))
    x = x[np.random.default_rng(_SEED).permutation(len(x))]
    seen = len(x) * 3 // 4
    degree = min(DEGREE, seen - 1)
    graph = neighbours(x[:seen], np.arange(seen), degree)
    part = balanced_parts(x[:seen], graph, n_parts)
    targets = np.zeros((seen, n_parts))
    np.add.at(targets, (np.repeat(np.arange(seen), degree), part[graph].ravel()), 0.5 / degree)
    targets[np.arange(seen), part] += 0.5
    router = Router(train(x[:seen], targets), n_parts, n_parts)
    unseen = np.arange(seen, len(x))
    homes = router.home(x)[neighbours(x, unseen, k)]
    order = router.routes(x[unseen])
    places = np.argsort(order, axis=1)
    reached = np.sort(np.take_along_axis(places, homes, axis=1).ravel())
    router.probes = int(reached[int(np.ceil(TARGET * len(reached))) - 1]) + 1
    return router


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of a list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _placer(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                homes = router.home(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.int32())], [*batch.schema.names, "part"])

    return run


def _sender(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                routes = router.routes(_matrix(batch.column("v"))).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    return run


def nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, cosines) of the ``k`` nearest, ties to the smaller id.

    A matrix product narrows the choice; what comes near the last one taken is
    computed row by row, the same for equal vectors wherever they stand.
    """
    out = []
    q_size, v_size = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((vectors * vectors).sum(axis=1))
    scaled = vectors / v_size[:, None]
    for at in range(0, len(queries), 256):
        rough = (queries[at : at + 256] / q_size[at : at + 256, None]) @ scaled.T
        rough[own[at : at + 256, None] == ids[None, :]] = -np.inf
        few = min(k, rough.shape[1])
        edge = -np.partition(-rough, few - 1, axis=1)[:, few - 1]
        for row in range(len(rough)):
            close = np.flatnonzero((rough[row] >= edge[row] - _SLACK) & np.isfinite(rough[row]))
            score = (vectors[close] * queries[at + row]).sum(axis=1) / (v_size[close] * q_size[at + row])
            best = np.lexsort((ids[close], -score))[:k]
            out.append((at + row, ids[close][best], score[best]))
    return out


def _reranker(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            query_ids, marks = left["id"].to_numpy(), left["mark"].to_numpy()
            found = nearest(_matrix(left["v"]), query_ids, _matrix(right["v"]), right["id"].to_numpy(), k)
            rows = [(marks[q], query_ids[q], i, s) for q, ids, scores in found for i, s in zip(ids, scores)]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.table(
            {
                "mark": pa.array(columns[0], pa.int64()),
                "query_id": pa.array(columns[1], pa.int64()),
                "vec_id": pa.array(columns[2], pa.int64()),
                "score": pa.array(columns[3], pa.float64()),
            }
        )

    return run


def search(vectors: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    ``is_query`` is a condition on ``vectors`` that picks the queries; all
    rows but those with the query's id are candidates. Rows with a null id,
    a vector that is not ``usable``, or another length than most vectors take
    no part; ties of lengths go to the longer. Repeated query rows each get
    their answer, repeated candidates each a rank.
    """
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    d, n = lengths
    rows = rows.where(F.size("v") == d)
    chosen = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()  # the documented bound
    router = fit_sample(_matrix(chosen["v"]), n, k)

    kind = rows.schema["v"].dataType.simpleString()
    marked = rows.withColumn("mark", F.monotonically_increasing_id())
    placed = stored(marked.mapInArrow(_placer(router), f"id bigint, v {kind}, asks boolean, mark bigint, part int"), "placed")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row for each part
    blocks = F.create_map(*[F.lit(x) for p, c in sizes.items() for x in (p, -(-c // BLOCK))])
    asked = placed.where("asks")
    chunks = max(1, -(-asked.count() * router.probes // (router.n_parts * CHUNK)))

    candidates = placed.select("part", F.pmod("mark", blocks[F.col("part")]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "v")
    sent = asked.select("id", "v", "mark").mapInArrow(_sender(router), f"id bigint, v {kind}, mark bigint, parts array<int>")
    sent = sent.select("id", "v", "mark", F.explode("parts").alias("part")).where(blocks[F.col("part")].isNotNull())
    sent = sent.select(
        "part",
        F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)).alias("block"),
        F.pmod(F.xxhash64("mark"), F.lit(chunks)).cast("int").alias("chunk"),
        "id",
        "v",
        "mark",
    )
    key = ("part", "block", "chunk")
    found = sent.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(_reranker(k), "mark bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("mark", "query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
