"""Exact top-k search by inner product with a KD-tree in every shard.

Vectors are integers, and products exact ones.  A KD-tree over a bounded sample (``SAMPLE_NUMBERS``) cuts the space into
cells at medians of the widest dimension; a cell's rows are cut into shards of about
``SHARD_ROWS`` rows, and its tight bounding box is taken over all of its rows.  A shard has
a KD-tree of its own with the tight box of every node.  The score of a query against a box
is at most ``sum max(q * low, q * high)``.  Nodes are visited best bound first, and a node is
left out as soon as its bound can't reach the query's k-th best score.

That score is propagated: a query first searches one shard of its own cell and takes its
k-th score as a start.  A cell whose bound is below it isn't visited: the query isn't sent
there.  What is left meets in blocks: a task holds one shard and one block of queries, both
of bounded size, and returns at most k rows a query.  Ties go to the smaller id, also where
a bound equals the k-th score.  The sample decides only which cells there are.

Defined results: vectors that are null or hold null or non-finite components take no part,
nor do null ids; vectors meet those of equal length only; of rows with one id each is a
candidate and, if asked for, a query of its own, with a list of its own (equal rows have
equal lists); a query doesn't meet rows of its own id; a score that 64 bits can't hold counts and comes back as the nearest one
that they can; fewer than k candidates give all of
them; other columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import small_batches

K, SCALE, EVERY = 5, 256, 50
SHARD_ROWS, BLOCK_QUERIES, STEP_QUERIES, LEAF = 16384, 16384, 1024, 128
#: Numbers that the cells are fitted on, cells at most, and numbers in their boxes at most.
SAMPLE_NUMBERS, CELLS, BOX_NUMBERS = 1 << 22, 1024, 1 << 22
#: Longest vectors (by a bound) whose products are integers of a double: EXACT ** 2 = 2 ** 52.
EXACT, LONG = float(1 << 26), (1 << 63) - 1
FOUND = "query_id long, hash long, copies long, vec_id long, score long"


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer products of each query with each point (doubles that hold integers), kept within 64 bits.  Rows whose products
    could leave the integers of a double are multiplied as Python's integers."""
    out = np.zeros((len(queries), len(points)), np.int64)
    if not out.size or not queries.shape[1]:
        return out
    q, p = (np.abs(x).max(axis=1) * math.sqrt(x.shape[1]) for x in (queries, points))
    plain_q, plain_p = q < EXACT, p < EXACT
    if plain_q.all() and plain_p.all():
        return (queries @ points.T).astype(np.int64)
    out[np.ix_(plain_q, plain_p)] = (queries[plain_q] @ points[plain_p].T).astype(np.int64)
    whole = lambda x: [[int(v) for v in row] for row in x.tolist()]
    for i, row in zip(np.flatnonzero(~plain_q).tolist(), whole(queries[~plain_q])):
        out[i] = [_within(sum(map(operator.mul, row, other))) for other in whole(points)]
    large = whole(points[~plain_p])
    for i, row in zip(np.flatnonzero(plain_q).tolist(), whole(queries[plain_q]) if large else ()):
        out[i, ~plain_p] = [_within(sum(map(operator.mul, row, other))) for other in large]
    return out


def _within(x: int) -> int:
    return max(-LONG, min(LONG, x))


def reached(bound: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bounds, raised by more than what rounding can have taken from them."""
    return bound + (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T) * 2.0**-44


class Tree:
    """KD-tree over rows of ``points`` (float64 holding integers)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.points, self.ids = points, ids
        order = np.arange(len(points))
        self.low, self.high, self.span, self.children = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            mine = points[order[a:b]]
            low, high = mine.min(axis=0), mine.max(axis=0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf and (high > low).any():
                axis = int(np.argmax(high - low))
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, axis], half)]
                todo += [(a, a + half, node), (a + half, b, node)]
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, node): the most a point of the node can score."""
        return reached(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T, queries, self.low, self.high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best (scores, ids) among those that reach ``floor``."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        kth = floor.copy()
        bound = self.bounds(queries)
        # best first: a heap of (negated largest bound, node) with the queries that still want the node
        heap = [(-float(bound[:, 0].max()), 0)] if len(queries) else []
        while heap:
            _, node = heapq.heappop(heap)
            want = np.flatnonzero(bound[:, node] >= kth)
            if not len(want):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-float(bound[want, child].max()), child))
                continue
            a, b = self.span[node]
            score = products(queries[want], self.points[a:b])
            ids = self.ids[a:b]
            other = query_ids[want][:, None] != ids[None, :]
            for row, ok, q in zip(score, other, want.tolist()):
                good = np.flatnonzero((row >= kth[q]) & ok)
                if not len(good):
                    continue
                s, i = np.concatenate([best[q][0], row[good]]), np.concatenate([best[q][1], ids[good]])
                keep = np.lexsort((i, -s))[:k]
                best[q] = (s[keep], i[keep])
                if len(keep) == k:
                    kth[q] = max(kth[q], s[keep[-1]])
        return best


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column))).astype(np.float64)


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null if the vector takes no part."""
    value = vector.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x) >= 2.0**53, x).otherwise(F.floor(x).cast("double"))  # noqa: E731  (larger doubles are integers, which floor() can't return)
    return F.when(~bad, F.transform(value, lambda x: whole(x * scale)))


class Cells:
    """Cuts of the space of one length; cells are numbered from ``first``."""

    def __init__(self, sample: np.ndarray, cells: int, first: int):
        self.axis, self.cut, self.below, self.cell = [], [], [], []
        todo, self.first, self.count = [(sample, cells, -1, 0)], first, 0
        while todo:
            rows, n, parent, side = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                self.below[parent][side] = node
            width = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(rows.shape[1])
            axis = int(np.argmax(width)) if len(width) else 0
            leaf = n < 2 or len(rows) < 2 or not len(width) or width[axis] <= 0
            middle = 0.0 if leaf else float(np.median(rows[:, axis]))
            right = np.zeros(0, bool) if leaf else rows[:, axis] >= middle
            if not leaf and right.all():  # the median is the least value: it stays on the left
                right = rows[:, axis] > middle
                middle = float(rows[right, axis].min())
            self.axis.append(axis)
            self.cut.append(middle)
            self.below.append([node, node])
            self.cell.append(first + self.count if leaf else -1)
            self.count += leaf
            if not leaf:
                todo += [(rows[right], n - n // 2, node, 1), (rows[~right], n // 2, node, 0)]
        self.axis, self.cut, self.below, self.cell = np.array(self.axis), np.array(self.cut), np.array(self.below), np.array(self.cell)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        row = np.arange(len(points))
        while (open_ := self.cell[at] < 0).any():
            side = points[row[open_], self.axis[at[open_]]] >= self.cut[at[open_]]
            at[open_] = self.below[at[open_], side.astype(np.int64)]
        return self.cell[at]


def by_length(column: pa.Array):
    """(rows, matrix) of each length that vectors have."""
    size = pc.list_value_length(column).to_numpy()
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield n, rows, _matrix(column.take(pa.array(rows)))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``vectors`` by the product of scaled integers."""
    spark = small_batches(vectors).sparkSession
    take = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), integers(F.col(f"`{vector}`")).alias("v")).where("id is not null and v is not null")
    points = take(vectors)
    asked = take(queries).groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64("v"))
    fitted = _fit_cells(points, shard_rows)
    if not fitted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = spark.sparkContext.broadcast(fitted)  # bounded by BOX_NUMBERS

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for n, rows, matrix in by_length(batch.column(batch.schema.get_field_index("v"))):
                cell[rows] = cells.value[n].of(matrix) if n in cells.value else -1
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    place = lambda df: df.mapInArrow(placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            number = batch.column(2).to_numpy()
            for _, rows, matrix in by_length(batch.column(1)):
                for c in np.unique(number[rows]).tolist():
                    mine = matrix[number[rows] == c]
                    box = (len(mine), mine.min(axis=0), mine.max(axis=0))
                    if c in held:
                        box = (held[c][0] + box[0], np.minimum(held[c][1], box[1]), np.maximum(held[c][2], box[2]))
                    held[c] = box
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b[0] for b in held.values()], pa.int64()), pa.array([b[1] for b in held.values()], kind), pa.array([b[2] for b in held.values()], kind)], ["cell", "n", "low", "high"])

    points = place(points.select("id", "v"))
    partial = points.mapInArrow(boxes, "cell int, n long, low array<double>, high array<double>")
    edge = lambda name, least: F.aggregate(F.collect_list(name), F.lit(None).cast("array<double>"), lambda a, x: F.when(a.isNull(), x).otherwise(F.zip_with(a, x, lambda p, q: least(p, q))))
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), edge("low", F.least).alias("low"), edge("high", F.greatest).alias("high"))
    # a task has one box for each cell: they are joined in two steps, so no group holds one of every task
    rows = summed(summed(partial.withColumn("salt", F.spark_partition_id() % 256), "cell", "salt"), "cell").collect()  # a row for each cell
    box = {r.cell: (max(1, math.ceil(r.n / shard_rows)), np.array(r.low), np.array(r.high)) for r in rows}
    shards = spark.sparkContext.broadcast(box)
    wanted = asked.count()
    blocks = max(1, math.ceil(wanted / block_queries))
    # equal rows spread over a cell's shards; a row is one shard's as long as its place in the scan is the same
    spread = lambda df: df.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.element_at(F.map_from_arrays(*[F.array(*[F.lit(x) for x in y]) for y in (list(box), [b[0] for b in box.values()])]), F.col("cell"))).cast("int"))
    points = spread(points).select("cell", "shard", "id", "v")
    asked = place(asked.select("id", "hash", "copies", "v")).withColumn("block", F.pmod(F.xxhash64("id", "hash"), F.lit(blocks)).cast("int"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            of = lambda t, name: t.column(name).to_numpy(zero_copy_only=False)
            tree = Tree(_matrix(right.column("v").combine_chunks()), of(right, "id"))
            for a in range(0, left.num_rows, STEP_QUERIES):
                part = left.slice(a, STEP_QUERIES)
                ids = of(part, "id")
                floor = pc.fill_null(part.column("floor"), -LONG).to_numpy()
                found = tree.search(ids, _matrix(part.column("v").combine_chunks()), floor, k)
                for i, h, c, (score, who) in zip(ids.tolist(), of(part, "hash").tolist(), of(part, "copies").tolist(), found):
                    for column, x in zip(out, ([i] * len(who), [h] * len(who), [c] * len(who), who.tolist(), [int(s) for s in score])):
                        column += x
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "hash", "copies", "vec_id", "score"), out)})

    def met(some: DataFrame) -> DataFrame:
        """The k best of each query in each shard that it is sent to."""
        keys = ["cell", "shard", "block"]
        blocked = some.select(F.col("cell").alias("c"), F.col("shard").alias("s"), F.col("block").alias("b")).distinct()
        needed = points.withColumnsRenamed({"cell": "c", "shard": "s"})
        needed = needed.join(blocked, ["c", "s"]) if blocks > 1 else needed.withColumn("b", F.lit(0))
        return some.groupBy(*keys).cogroup(needed.groupBy("c", "s", "b")).applyInArrow(search, FOUND)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the shards of the cells that may hold one of its k best."""
        numbers = {}
        for c, (_, low, _) in shards.value.items():
            numbers.setdefault(len(low), []).append(c)
        for batch in batches:
            floor = pc.fill_null(batch.column(batch.schema.get_field_index("floor")), -LONG).to_numpy(zero_copy_only=False)
            for n, rows, q in by_length(batch.column(batch.schema.get_field_index("v"))):
                if n not in numbers:
                    continue
                low, high = (np.array([shards.value[c][i] for c in numbers[n]]) for i in (1, 2))
                count = np.array([shards.value[c][0] for c in numbers[n]])
                for a in range(0, len(rows), STEP_QUERIES):
                    some = q[a : a + STEP_QUERIES]
                    bound = reached(np.maximum(some, 0) @ high.T + np.minimum(some, 0) @ low.T, some, low, high)
                    row, at = np.nonzero(bound >= floor[rows[a : a + STEP_QUERIES]][:, None])
                    many = count[at]
                    shard = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    picked = batch.take(pa.array(np.repeat(rows[a + row], many)))
                    cell = pa.array(np.repeat(np.array(numbers[n])[at], many), pa.int32())
                    yield picked.set_column(picked.schema.get_field_index("cell"), "cell", cell).append_column("shard", pa.array(shard, pa.int32()))

    home = spread(asked).withColumn("floor", F.lit(None).cast("long"))
    start = best_of(met(home), k)
    # the k-th score at home, where there are k
    floor = start.groupBy("query_id", "hash").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "hash", F.col("kth").alias("floor"))
    asked = asked.join(floor, ["id", "hash"], "left")
    sent = asked.mapInArrow(reach, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", shard int")
    best = best_of(met(sent), k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def _fit_cells(points: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """Cells of each length, from a sample."""
    sizes = {r.dim: r["count"] for r in points.groupBy(F.size("v").alias("dim")).count().collect()}
    total = sum(n * max(1, dim) for dim, n in sizes.items())
    if not total:
        return {}
    some = points.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_NUMBERS / total) * (1 << 30))) if total > SAMPLE_NUMBERS else points
    held = some.select("v").toArrow().column(0).combine_chunks()  # about SAMPLE_NUMBERS numbers
    sample = {n: np.zeros((0, n)) for n in sizes} | {n: matrix for n, _, matrix in by_length(held)}
    out, first = {}, 0
    for n, rows in sorted(sample.items()):
        most = max(1, min(CELLS, BOX_NUMBERS // max(1, 2 * n), math.ceil(sizes[n] / shard_rows)))
        out[n] = Cells(rows, most, first)
        first += out[n].count
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; Spark limits them before the exchange too."""
    order = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
