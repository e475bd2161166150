"""Centroid clustering on bit planes: exact integer dot products from AND and popcount.

Components become integers ``floor(scale * x)`` in two's complement. Bit plane b of a vector holds bit b of every
component, 64 components in one uint64, so that

    v . c = sum over planes i, j of  weight(i) * weight(j) * popcount(V_i & C_j),

where plane i weighs 2**i and the sign plane weighs -2**i. Squared distances follow from three such products and are
exact. Vectors are packed once; every round streams the packed table, adds up counts and component sums by cluster
inside the tasks (at most one row for each task and cluster leaves it) and replaces the centroids, which are few and
small by definition and the only thing that travels through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import cut

WORD = 64
#: Squared distances of more planes than this could leave the range of a long.
MOST_PLANES = 28
_BLOCK = 2048


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes (rows, planes, words) of integers (rows, components), in two's complement."""
    rows, dim = values.shape
    words = -(-dim // WORD)
    bits = np.zeros((rows, planes, words * WORD), np.uint8)
    for b in range(planes):
        bits[:, b, :dim] = (values >> b) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8").astype(np.uint64)


def unpack(planes: np.ndarray, dim: int) -> np.ndarray:
    """The integers of ``pack``."""
    rows, n, words = planes.shape
    out = np.zeros((rows, dim), np.int64)
    for b in range(n):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, b]).view(np.uint8).reshape(rows, words * 8), axis=1, bitorder="little")
        out += weight(b, n) * bits[:, :dim].astype(np.int64)
    return out


def weight(plane: int, planes: int) -> int:
    return -(1 << plane) if plane == planes - 1 else 1 << plane


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products (rows of left, rows of right) by weighted AND-popcounts."""
    out = np.zeros((len(left), len(right)), np.int64)
    n = left.shape[1]
    for i in range(n):
        row = np.zeros_like(out)
        for j in range(n):
            for w in range(left.shape[2]):
                common = np.bitwise_count(left[:, i, w, None] & right[None, :, j, w])
                row += weight(j, n) * common.astype(np.int64)
        out += weight(i, n) * row
    return out


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared lengths, by the same popcounts of a vector's planes among themselves."""
    n, out = planes.shape[1], np.zeros(len(planes), np.int64)
    for i in range(n):
        for j in range(n):
            common = np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64).sum(axis=1)
            out += weight(i, n) * weight(j, n) * common
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; ties go to the smaller number."""
    cluster, distance = np.zeros(len(planes), np.int32), np.zeros(len(planes), np.int64)
    own = norms(centroids)
    for at in range(0, len(planes), _BLOCK):
        part = planes[at : at + _BLOCK]
        far = norms(part)[:, None] - 2 * dots(part, centroids) + own[None, :]
        cluster[at : at + _BLOCK] = best = far.argmin(axis=1)
        distance[at : at + _BLOCK] = far[np.arange(len(part)), best]
    return cluster, distance


@dataclass(frozen=True)
class Packed:
    """The kept vectors as (id, planes) in the shared folder, and what is needed to read them."""

    table: DataFrame
    planes: int
    dim: int
    first: np.ndarray  # the initial centroids, integers


def read_planes(batch: pa.RecordBatch, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint64).reshape(batch.num_rows, planes, -1)


def kept(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none of them null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, odd)


def pack_table(vectors: DataFrame, vec_id: str, vector: str, k: int, scale: int, dim: int, key: Callable[[Column], Column]) -> Packed:
    """Integers, the first ``k`` centroids by ``key`` (ties: by components; null ids never start one) and packed planes."""
    whole = (
        vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
        .where(kept(F.col("v"), dim))
        .select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    )
    low, high = whole.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    planes = 1 + max((~low if low < 0 else low).bit_length(), (~high if high < 0 else high).bit_length()) if low is not None else 1
    if planes > MOST_PLANES:
        raise ValueError(f"components from {low} to {high} are too large for exact long distances")
    start = whole.where("id is not null").select(key(F.col("id")).alias("key"), "v").orderBy("key", "v").limit(k)
    first = np.array([r.v for r in start.collect()], np.int64).reshape(-1, dim)  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            flat = pack(values, planes)
            blobs = [row.tobytes() for row in flat]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(blobs, pa.binary())], ["id", "planes"])

    schema = f"id {whole.schema['id'].dataType.simpleString()}, planes binary"
    return Packed(cut(whole.mapInArrow(run, schema)), planes, dim, first)


def refine(packed: Packed, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then centroids of members become floor(sum / count)."""
    n, dim, code = packed.planes, packed.dim, pack(centroids, packed.planes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            planes = read_planes(batch, n)
            cluster, _ = nearest(planes, code)
            order = np.argsort(cluster, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0])
            which = cluster[order][begins]
            total[which] += np.add.reduceat(unpack(planes, dim)[order], begins, axis=0)
            count += np.bincount(cluster, minlength=len(centroids))
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([count[c]], pa.int64()), pa.array([total[c].tolist()], pa.list_(pa.int64()))],
                ["cluster", "count", "total"],
            )

    sums = packed.table.mapInArrow(partial, "cluster int, count long, total array<long>")
    added = sums.groupBy("cluster").agg(F.sum("count").alias("count"), *[F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(packed.dim)])
    out = centroids.copy()
    for row in added.collect():  # k rows at most
        out[row["cluster"]] = [row[f"d{d}"] // row["count"] for d in range(packed.dim)]
    return out


def clusters(
    vectors: DataFrame, key: Callable[[Column], Column], vec_id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector after ``rounds`` rounds, and the final centroids.

    Vectors that are null, have another number of components or hold a null or non-finite one take no part. The ``k``
    vectors with the smallest ``key`` of their id (equal keys: smaller components first) are the first centroids, fewer
    where the table is smaller; rows without an id are clustered, but start no centroid. Repeated rows count as often as
    they stand. Further columns are ignored. Components beyond the range of exact long distances raise ValueError.
    """
    packed = pack_table(vectors, vec_id, vector, k, scale, dim, key)
    centroids = packed.first
    if len(centroids):
        for _ in range(rounds):
            centroids = refine(packed, centroids)
    n, code = packed.planes, pack(centroids, packed.planes) if len(centroids) else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and code is not None:
                cluster, distance = nearest(read_planes(batch, n), code)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    kind = packed.table.schema["id"].dataType.simpleString()
    return cut(packed.table.mapInArrow(assign, f"id {kind}, cluster int, distance long")), centroids
