"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is cut into balanced parts and a small network learns which part a vector's
neighbours lie in. Every vector of the table is routed to its most probable part; a query goes to as many probable parts
as a held-out piece of the sample needs for the target recall, and all vectors of those parts are reranked exactly.

Equal vectors are one vector with a list of ids, so that a vector that a third of all rows share costs one row. Large
parts are split into blocks of a fixed size, and blocks of vectors meet blocks of queries in a join on the part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import cut, shuffle_partitions


#: Scores that the fit holds at a time.
BLOCK_SCORES = 1 << 23


@dataclass(frozen=True)
class Settings:
    sample: int = 8000  # vectors the partition and the router are fitted on (the only sampled step), or, where that is more,
    sample_part: int = 16  # so many for each part; there are sqrt(vectors) / 8 parts, 4 at least
    neighbours: int = 10  # edges of a vector in the sample's graph
    hidden: int = 128
    epochs: int = 40
    target_recall: float = 0.94  # of the held-out quarter of the sample
    block: int = 8192  # vectors in a block of the index
    query_block: int = 2048


class Router:
    """A two-layer network from a vector to the parts' scores."""

    def __init__(self, layers: list[np.ndarray], probes: int, recall: float = 1.0):
        self.layers, self.probes, self.recall = layers, probes, recall

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def _balanced(score: np.ndarray, room: int) -> np.ndarray:
    """Each row to its best part with room left; rows with most to lose choose first."""
    parts = score.shape[1]
    label, left = np.full(len(score), -1), np.full(parts, room)
    two = np.partition(score, -2, axis=1)[:, -2:]
    wish = np.argsort(-score, axis=1, kind="stable")
    for i in np.argsort(two[:, 0] - two[:, 1], kind="stable"):
        for p in wish[i]:
            if left[p]:
                label[i], left[p] = p, left[p] - 1
                break
    return label


def partition_graph(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced parts (5 % slack) of the neighbour graph: balanced seeds, then moves along the edges."""
    room = int(np.ceil(len(x) / parts * 1.05))
    centres = x[rng.permutation(len(x))[:parts]]
    label = _balanced(x @ centres.T, room)
    for _ in range(10):
        centres = np.stack([x[label == p].mean(0) if (label == p).any() else x[p] for p in range(parts)])
        label = _balanced(x @ (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).T, room)
    for _ in range(15):
        votes = 2.0 * np.eye(parts)[label]
        for k in range(near.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[near[:, k]]), 1)
            np.add.at(votes, (near[:, k], label), 1)
        label = _balanced(votes, room)
    return label


def _train(x: np.ndarray, target: np.ndarray, s: Settings, rng: np.random.Generator) -> list[np.ndarray]:
    """Cross entropy by Adam."""
    d, m = x.shape[1], target.shape[1]
    layers = [rng.normal(0, d**-0.5, (d, s.hidden)), np.zeros(s.hidden), rng.normal(0, s.hidden**-0.5, (s.hidden, m)), np.zeros(m)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(s.epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[batch] @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[batch]) / len(batch)
            back = g @ layers[2].T * (h > 0)
            t += 1
            for k, grad in enumerate((x[batch].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                layers[k] = layers[k] - 2e-3 * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def fit_router(sample: np.ndarray, parts: int, s: Settings, k: int = 20, seed: int = 7) -> Router:
    """Partition the sample's graph, train the router, and choose the number of probes on the held-out quarter."""
    rng = np.random.default_rng(seed)
    sample = sample[rng.permutation(len(sample))].astype(float)
    held = max(1, len(sample) // 4)
    x = sample[held:]
    parts = max(1, min(parts, len(x) // 4))
    if parts < 2:
        d = sample.shape[1]
        return Router([np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    edges = min(s.neighbours, len(x) - 1)
    near = np.empty((len(x), edges), int)
    step = max(1, BLOCK_SCORES // len(sample))  # scores are made and used block by block, never all at once
    for a in range(0, len(x), step):
        score = x[a : a + step] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        near[a : a + step] = np.argpartition(-score, edges - 1, axis=1)[:, :edges]
    label = partition_graph(x, near, parts, rng)
    one = np.eye(parts)[label]
    router = Router(_train(x, 0.7 * one[near].mean(1) + 0.3 * one, s, rng), parts)
    home = router.scores(sample).argmax(1)
    top, at_probe = min(k, len(sample) - 1), np.zeros(parts, np.int64)
    for a in range(0, held, step):
        asked = sample[a : min(a + step, held)]
        score = asked @ sample.T
        rows = np.arange(len(asked))
        score[rows, a + rows] = -np.inf
        best = np.argpartition(-score, top - 1, axis=1)[:, :top]
        rank = np.argsort(router.parts(asked, parts), axis=1)  # a part's place among those that a query asks
        at_probe += np.bincount(np.take_along_axis(rank, home[best], axis=1).ravel(), minlength=parts)  # at which a neighbour is found
    recall = np.cumsum(at_probe) / (held * top)
    router.probes = int(np.argmax(np.array(recall) >= s.target_recall)) + 1 if recall[-1] >= s.target_recall else parts
    router.recall = float(recall[router.probes - 1])
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _route(router: Router, probes: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = router.parts(_matrix(batch.column("vector")).astype(float), probes)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(parts.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "parts"]
                )

    return route


def _pack(limit: int):
    """Rows of a part, which come together, as blocks of at most ``limit``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, firsts, rows, size = None, [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([np.concatenate(keys).astype("<i8").tobytes()]),
                    pa.array([np.concatenate(firsts).astype("<i8").tobytes()]),
                    pa.array([np.concatenate(rows).astype("<f8").tobytes()]),
                ],
                ["part", "keys", "firsts", "matrix"],
            )

        for batch in batches:
            parts = batch.column("part").to_numpy()
            key, first, vector = batch.column("key").to_numpy(), batch.column("first").to_numpy(), _matrix(batch.column("vector"))
            edges = np.r_[0, np.flatnonzero(np.diff(parts)) + 1, len(parts)] if len(parts) else []
            for a, b in zip(edges[:-1], edges[1:]):
                while a < b:
                    if size and (part != parts[a] or size >= limit):
                        yield flush()
                        keys, firsts, rows, size = [], [], [], 0
                    part, end = parts[a], min(b, a + limit - size)
                    keys.append(key[a:end])
                    firsts.append(first[a:end])
                    rows.append(vector[a:end])
                    size += end - a
                    a = end
        if size:
            yield flush()

    return pack


def _search(k: int):
    """The best k vectors of a block for each query of a query block; scores are summed in one fixed order."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, firsts, matrix, query_keys, queries in zip(*(batch.column(c) for c in ("keys", "firsts", "matrix", "query_keys", "queries"))):
                keys, firsts, query_keys = (np.frombuffer(x.as_buffer(), "<i8") for x in (keys, firsts, query_keys))
                base = np.frombuffer(matrix.as_buffer(), "<f8").reshape(len(keys), -1)
                asked = np.frombuffer(queries.as_buffer(), "<f8").reshape(len(query_keys), -1)
                for a in range(0, len(asked), 256):
                    rough = asked[a : a + 256] @ base.T
                    n = min(len(keys), k + 8)  # spare ones: the rough sums may differ in their last bits
                    some = np.argpartition(-rough, n - 1, axis=1)[:, :n] if n < len(keys) else np.tile(np.arange(n), (len(rough), 1))
                    exact = np.stack([(base[s] * q).sum(1) for s, q in zip(some, asked[a : a + 256])])
                    order = np.lexsort((keys[some], firsts[some], -exact))[:, :k]
                    picked = np.take_along_axis(some, order, 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(query_keys[a : a + 256], order.shape[1])),
                            pa.array(keys[picked].ravel()),
                            pa.array(firsts[picked].ravel()),
                            pa.array(np.take_along_axis(exact, order, 1).ravel()),
                        ],
                        ["query_key", "key", "first", "score"],
                    )

    return search


def _blocks(routed: DataFrame, limit: int) -> DataFrame:
    """(part, keys, matrix) blocks; a part of many rows is dealt over several tasks."""
    sizes = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}  # one row a part
    salts = F.create_map(*[F.lit(x) for p, n in sorted(sizes.items()) for x in (p, -(-n // limit))]) if sizes else F.lit(None)
    return (
        routed.withColumn("salt", F.pmod(F.xxhash64("key"), salts[F.col("part")]))
        .repartition(shuffle_partitions(routed.sparkSession), "part", "salt")
        .sortWithinPartitions("part", "key")
        .select("part", "key", "first", "vector")
        .mapInArrow(_pack(limit), "part int, keys binary, firsts binary, matrix binary")
    )


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()
) -> DataFrame:
    """query_id, rank, vec_id, score, sample_recall: the ``k`` largest inner products found for each query.

    ``sample_recall``: the recall that the chosen number of parts gave on the held-out quarter of the sample.

    Queries are the rows whose id is divisible by ``every``; all rows but the query's own are candidates, ties go to the
    smaller id. Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do vectors of another length than the most frequent one (smallest if several). Rows with the same id and vector
    count once; rows with the same id and different vectors are candidates each, but never of their own id. Fewer
    candidates than ``k``: all that are found. No valid rows: no result.
    """
    spark = vectors.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    )
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, sample_recall double")
    rows = rows.where(F.size("vector") == length["n"])
    # One row for each different vector, with its k + 1 smallest ids; the row limit also works before the shuffle.
    ranked = rows.distinct().withColumn("n", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    base = cut(ranked.groupBy("vector").agg(F.min("vec_id").alias("first"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # Different vectors may share an id: the key of a vector is a number of its own.
    base = cut(base.withColumn("key", F.monotonically_increasing_id()))
    total = base.count()
    parts = max(round(total**0.5 / 8), 4)
    most = max(settings.sample, settings.sample_part * parts)
    sample = base.orderBy(F.xxhash64("vector"), "first").limit(most).select("vector").collect()
    router = fit_router(np.array([r["vector"] for r in sample]), parts, settings, k)

    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = cut(asked.join(base.select("vector", "key"), "vector").select("query_id", F.col("key").alias("query_key")))
    queries = base.join(asked.select(F.col("query_key").alias("key")).distinct(), "key", "left_semi")
    routed = "key long, first long, vector array<double>, parts array<int>"
    index = base.select("key", "first", "vector").mapInArrow(_route(router, 1), routed)
    wanted = queries.select("key", "first", "vector").mapInArrow(_route(router, router.probes), routed)
    left = _blocks(cut(index.select(F.col("parts")[0].alias("part"), "key", "first", "vector")), settings.block)
    right = _blocks(cut(wanted.select(F.explode("parts").alias("part"), "key", "first", "vector")), settings.query_block)
    pairs = left.join(right.select("part", F.col("keys").alias("query_keys"), F.col("matrix").alias("queries")), "part")
    found = pairs.select("keys", "firsts", "matrix", "query_keys", "queries").mapInArrow(
        _search(k + 1), "query_key long, key long, first long, score double"
    )
    best = W.partitionBy("query_key").orderBy(F.desc("score"), "first", "key")
    near = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query_key", "key", "score")
    near = near.join(base.select("key", "ids"), "key")
    near = near.select("query_key", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    last = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(near, "query_key")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(last).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", F.lit(router.recall).alias("sample_recall"))
    )
