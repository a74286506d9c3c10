"""Centroid clustering of quantised vectors, each distinct one weighed by its copies.

A vector's components become integers.  Identical vectors are grouped first (counted on the map side,
so copies of one vector weigh one row a task), and Lloyd's rounds run over the distinct ones with
their multiplicities: a task sends, for each centroid, the weighted sums of what is nearest to it, as exact
integers.  Sums come back cut into limbs of 40 bits, so no sum over any number of tasks or any size of
components overflows.  At the end the assignments are joined back to the rows by the vector itself; the
vectors that hold more than a 1,024th of all rows each (so at most 1,024 of them) are joined by a broadcast,
all others by a shuffle in which no key is larger than that.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no
part, nor do those with a component beyond 2**1013 (its multiple isn't finite); repeated rows count and come
back each; null ids take part, but become starting centroids only after all others; equal hashes (of a repeated
id) go by the vector's packed bytes; with fewer vectors than centroids every vector is one; a distance or inertia
beyond a 64-bit integer comes back as null; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .packed import raw

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: A vector with more than one in so many rows is joined by broadcast.
HEAVY = 1024
#: Integers up to this are multiplied as doubles: 4 * 64 * 2**44 < 2**53.
EXACT = 1 << 22
LIMB = 40
LONG = (1 << 63) - 1
#: Places of a centroid's number of rows and of its inertia among the sums.
COUNT, INERTIA = -1, -2
RESULT = "vec_id {0}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _usable(vector, dims: int):
    value = vector.cast("array<double>")
    top = F.lit(2.0**1013)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > top))
    return (F.size(value) == dims) & ~bad


def packed_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the usable rows: one byte for the width of an integer, then the components; wider ones as text."""
    kind = vectors.schema[id].dataType.simpleString()
    some = small_batches(vectors).where(_usable(F.col(f"`{vector}`"), dims)).select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            whole = np.floor(flat.reshape(batch.num_rows, dims) * scale)
            top = np.maximum(whole.max(axis=1), -1 - whole.min(axis=1))
            done = np.zeros(batch.num_rows, bool)
            for width in (2, 4, 8):
                at = np.flatnonzero(~done & (top < 2.0 ** (8 * width - 1)))
                done[at] = True
                if len(at):
                    body = np.empty((len(at), 1 + dims * width), np.uint8)
                    body[:, 0] = width
                    body[:, 1:] = whole[at].astype(f"<i{width}").view(np.uint8)
                    made = pa.Array.from_buffers(pa.binary(body.shape[1]), len(at), [None, pa.py_buffer(body)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), made], ["vec_id", "vector"])
            if len(at := np.flatnonzero(~done)):
                text = [b"\0" + ",".join(str(int(x)) for x in row).encode() for row in whole[at].tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(text, pa.binary())], ["vec_id", "vector"])

    return some.mapInArrow(run, f"vec_id {kind}, vector binary")


def unpacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components), for each width; components are int64, or Python's integers where those don't do."""
    data, bounds = raw(column)
    first = data[bounds[:-1]] if len(bounds) > 1 else np.zeros(0, np.uint8)
    for width in np.unique(first).tolist():
        at = np.flatnonzero(first == width)
        if width:
            size = int(bounds[at[0] + 1] - bounds[at[0]])
            body = data[bounds[at][:, None] + np.arange(1, size)]
            yield at, np.ascontiguousarray(body).view(f"<i{width}").astype(np.int64)
        else:
            yield at, np.array([[int(x) for x in data[bounds[i] + 1 : bounds[i + 1]].tobytes().split(b",")] for i in at.tolist()], object)


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (the smaller of equal ones), and the squared distance; exact."""
    top = max((abs(x) for c in centroids for x in c), default=0)
    if points.dtype != object and top <= EXACT and len(points) and np.abs(points).max() <= EXACT:
        p, c = points.astype(np.float64), np.array(centroids, np.float64)
        d = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]
        best = d.argmin(axis=1)
        return best, d[np.arange(len(p)), best].astype(np.int64)
    p = points.astype(object)
    d = np.stack([((p - np.array(c, object)) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = np.array([row.index(min(row)) for row in d.tolist()], np.int64)
    return best, d[np.arange(len(p)), best]


def _weighted(points: np.ndarray, weight: np.ndarray) -> list[int]:
    """Exact sums of the rows times their weights."""
    if points.dtype != object and int(np.abs(points).max()) * int(weight.sum()) < 1 << 62:
        return (points * weight[:, None]).sum(axis=0).tolist()
    return (points.astype(object) * weight.astype(object)[:, None]).sum(axis=0).tolist()


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """``value`` as (place, limb), the last limb with its sign: sum of limb << 40 * place."""
    place = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value, place = value >> LIMB, place + 1
    yield place, value


def totals(distinct: DataFrame, centroids: list[list[int]], dims: int) -> dict[tuple[int, int], int]:
    """{(cluster, dimension): weighted sum}, with the number of rows and the inertia of each cluster at COUNT and INERTIA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def add(key: tuple[int, int], x: int) -> None:
            sums[key] = sums.get(key, 0) + x

        for batch in batches:
            copies = batch.column(1).to_numpy()
            for at, points in unpacked(batch.column(0)):
                best, distance = nearest(points, centroids)
                for c in np.unique(best).tolist():
                    mine = np.flatnonzero(best == c)
                    n = copies[at[mine]]
                    add((c, COUNT), int(n.sum()))
                    add((c, INERTIA), _weighted(distance[mine][:, None], n)[0])
                    for j, s in enumerate(_weighted(points[mine], n)):
                        add((c, j), s)
        rows = [(c, j, p, x) for (c, j), s in sums.items() for p, x in limbs(int(s))]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "place", "limb"])

    sent = distinct.select("vector", "n").mapInArrow(run, "cluster int, dim int, place int, limb long")
    out: dict[tuple[int, int], int] = {}
    for r in sent.groupBy("cluster", "dim", "place").agg(F.sum("limb").alias("limb")).collect():  # centroids x dimensions x limbs
        out[r.cluster, r.dim] = out.get((r.cluster, r.dim), 0) + (r.limb << LIMB * r.place)
    assert all(j < dims for _, j in out)
    return out


def starting(packed: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids."""
    rows = packed.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return [unpack_one(bytes(r.vector)) for r in rows]


def unpack_one(data: bytes) -> list[int]:
    return next(unpacked(pa.array([data], pa.binary())))[1][0].tolist()


def cluster_vectors(vectors: DataFrame, folder: str, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row.  ``folder`` is new and
    shared: the distinct vectors are written there and read again in every round."""
    spark = vectors.sparkSession
    kind = vectors.schema[id].dataType.simpleString()
    packed = packed_vectors(vectors, dims, scale, id, vector)
    centroids = starting(packed, k, seed)
    if not centroids:
        return spark.createDataFrame([], RESULT.format(kind))
    packed.groupBy("vector").agg(F.count("*").alias("n")).write.parquet(f"{folder}/distinct")
    distinct = spark.read.schema("vector binary, n long").parquet(f"{folder}/distinct")
    for _ in range(rounds):
        sums = totals(distinct, centroids, dims)
        moved = [[sums[c, j] // sums[c, COUNT] for j in range(dims)] if (c, COUNT) in sums else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break  # no later round changes anything
        centroids = moved
    sums = totals(distinct, centroids, dims)
    rows = sum(n for (_, j), n in sums.items() if j == COUNT)
    inertia = [sums.get((c, INERTIA), 0) for c in range(len(centroids))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for at, points in unpacked(batch.column(0)):
                cluster[at], distance[at] = nearest(points, centroids)
            fits = [int(x) if x <= LONG else None for x in distance.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(fits, pa.int64())], ["vector", "n", "cluster", "distance"])

    assigned = distinct.mapInArrow(assign, "vector binary, n long, cluster int, distance long")
    often = F.col("n") * HEAVY >= rows
    heavy = F.broadcast(assigned.where(often))  # HEAVY rows at most
    light = packed.join(F.broadcast(assigned.where(often).select("vector")), "vector", "left_anti").join(assigned.where(~often), "vector")
    out = packed.join(heavy, "vector").unionByName(light)
    fits = lambda x: F.lit(x if x <= LONG else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    sha = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    return out.select("vec_id", "cluster", "distance", of([fits(x) for x in inertia]).alias("cluster_inertia"), fits(sum(inertia)).alias("inertia"), of(sha).alias("centroid_sha256"))
