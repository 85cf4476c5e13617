"""Approximate nearest neighbours by low-dimensional stable projections, indexed by kd-trees.

Vectors are projected to ``dims`` dimensions by a seeded Gaussian (2-stable) matrix: the projected squared distance
of a point at distance d is d^2 times a chi-square variable of ``dims`` degrees. The projected space is split into
cells by a kd-tree over a bounded sample; every row is put into its cell, and cells over ``block_rows`` are split
further by a hash of the id. Of equal vectors only those of the k + 1 smallest ids can ever be returned, so no others
are indexed and a very common vector is as small as any. Each block builds its own kd-tree of buckets. A query first searches the blocks of the cell it lies in, which bounds its k-th distance, and
then the cells that its stopping radius still reaches. In a block, buckets come in the order of their projected
distance and their points are verified on the original vectors, until the chi-square test holds: the next bucket lies
beyond sqrt(chi2.inv(``confidence``)) times the k-th distance found, so a nearer point is left behind with
probability under 1 - ``confidence`` each.

Defined results: vectors that are null, zero, hold null or non-finite components, have a null id or another length
than the commonest (the longer one on a tie) take no part; fewer than k candidates are all returned; ties go to the
smaller id; repeated rows of one id are candidates of their own, and a query never meets rows of its own id; of
several query rows with one id the one with the smallest vector asks; an empty table gives an empty table; other columns are left out.

The sample is the only fit (``sample_rows``, and no more than ``SAMPLE_BYTES``, on the driver); all rows are indexed. A
task holds one block and a chunk of some ``chunk_rows`` of the queries that visit it: a block is copied once for each
such chunk, so copies follow the visits and not the table times its queries. The query set is never broadcast. Results
are merged by ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, join_by_key

DIMS = 8
CONFIDENCE = 0.999
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
BLOCK_ROWS = 2048
CHUNK_ROWS = 512
BUCKET = 32
MOST_CELLS = 4096
SEED = 11
FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(p: float, degrees: int) -> float:
    """Inverse of the chi-square distribution for an even number of degrees, by bisection."""
    if degrees % 2:
        raise ValueError("the number of projected dimensions must be even")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for k in range(1, degrees // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, width])).standard_normal((width, dims))


def projected(data: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The projected rows of ``data``. Each is summed by itself in a fixed order, so equal vectors get equal points in any batch."""
    columns = np.ascontiguousarray(data.T, np.float64)
    points = np.zeros((matrix.shape[1], len(data)))
    for values, weights in zip(columns, matrix, strict=True):
        points += weights[:, None] * values
    return np.ascontiguousarray(points.T)


def split_tree(points: np.ndarray, cells: int) -> list[tuple]:
    """kd-tree over a sample: nodes (axis, value, left, right); a leaf is (-1, cell, 0, 0)."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, cells: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(1)
        if cells < 2 or not spread.max() > 0:
            return me
        axis = int(spread.argmax())
        value = float(np.median(rows[:, axis]))
        left = rows[:, axis] <= value
        if left.all():  # many rows share the median: cut below it
            value = float(rows[:, axis][rows[:, axis] < value].max())
            left = rows[:, axis] <= value
        a = grow(rows[left], cells // 2)
        b = grow(rows[~left], cells - cells // 2)
        nodes[me] = (axis, value, a, b)
        return me

    if len(points):
        grow(points, cells)
    else:
        nodes.append((-1, 0.0, 0, 0))
    number = 0
    for i, node in enumerate(nodes):
        if node[0] < 0:
            nodes[i] = (-1, float(number), 0, 0)
            number += 1
    return nodes


def cells_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    out = np.zeros(len(points), np.int32)
    stack = [(0, np.arange(len(points)))]
    while stack:
        i, rows = stack.pop()
        axis, value, a, b = nodes[i]
        if axis < 0:
            out[rows] = int(value)
        else:
            left = points[rows, axis] <= value
            stack += [(a, rows[left]), (b, rows[~left])]
    return out


def reach(nodes: list[tuple], point: np.ndarray, radius: float) -> list[int]:
    """Cells whose region comes within ``radius`` of the point."""
    out, stack = [], [(0, 0.0, np.zeros(len(point)))]
    while stack:
        i, square, gap = stack.pop()
        axis, value, a, b = nodes[i]
        if axis < 0:
            out.append(int(value))
            continue
        d = point[axis] - value
        near, far = (a, b) if d <= 0 else (b, a)
        stack.append((near, square, gap))
        beyond = square - gap[axis] ** 2 + max(abs(d), gap[axis]) ** 2
        if beyond <= radius * radius:
            wider = gap.copy()
            wider[axis] = max(abs(d), gap[axis])
            stack.append((far, beyond, wider))
    return out


class Block:
    """A kd-tree of buckets over the projected points of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, bucket: int = BUCKET):
        order: list[np.ndarray] = []
        stack = [np.lexsort((*points.T, ids))]  # whatever the order of the rows after a shuffle
        while stack:
            rows = stack.pop()
            if len(rows) <= bucket:
                order.append(rows)
                continue
            axis = int(np.ptp(points[rows], axis=0).argmax())
            rows = rows[np.argsort(points[rows, axis], kind="stable")]
            stack += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        self.bounds = np.r_[0, np.cumsum([len(o) for o in order])]
        rows = np.concatenate(order)
        self.ids, self.vectors, points = ids[rows], vectors[rows].astype(np.float64), points[rows]
        self.low = np.array([points[a:b].min(axis=0) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)])
        self.high = np.array([points[a:b].max(axis=0) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)])

    def search(self, query_id: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float, stop: float):
        """The k nearest (score, id) by incremental projected search; ``bound`` is a k-th distance known already."""
        gaps = (np.maximum(np.maximum(self.low - point, point - self.high), 0.0) ** 2).sum(axis=1)
        near = np.argsort(gaps, kind="stable")
        scores, ids = np.empty(0), np.empty(0, np.int64)
        at, step = 0, 4
        while at < len(near):
            limit = bound * bound * stop
            some = near[at : at + step]
            some = some[gaps[some] <= limit]
            if not len(some):
                break  # the chi-square test holds
            rows = np.concatenate([np.arange(self.bounds[b], self.bounds[b + 1]) for b in some])
            rows = rows[self.ids[rows] != query_id]
            found = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
            scores, ids = np.r_[scores, found], np.r_[ids, self.ids[rows]]
            best = np.lexsort((ids, scores))[:k]
            scores, ids = scores[best], ids[best]
            if len(scores) == k:
                bound = min(bound, float(scores[-1]))
            at, step = at + step, min(step * 2, 64)
        return scores, ids


def usable_vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part."""
    vectors = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    return usable.filter(finite & F.exists("vector", lambda x: x != 0))


def returnable(vectors: DataFrame, k: int) -> DataFrame:
    """The rows that can be in a result: of equal vectors those of the k + 1 smallest ids, each at most k times."""
    nth = F.row_number().over(Window.partitionBy("vector", "vec_id").orderBy("vec_id"))
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    rows = vectors.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
    return rows.withColumn("place", place).filter(F.col("place") <= k + 1).drop("place")


def sample_of(vectors: DataFrame, total: int, rows: int, seed: int) -> DataFrame:
    """The first rows in the order of a hash, so that reruns agree; a cut of the hash keeps most rows from being ranked."""
    place = F.xxhash64("vec_id", F.lit(seed))
    share = 2 * rows / total
    few = vectors if share >= 1 else vectors.filter(place < F.lit(int(share * 2.0**64) - 2**63))
    return few.select("vector", "vec_id").orderBy(place, "vec_id", "vector").limit(rows).select("vector")


def chunks_of(asked: DataFrame, chunk_rows: int) -> DataFrame:
    """block, chunks: into how many chunks the queries of each asked block fall."""
    return asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))


def copies_of(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of every asked block, once for each of its chunks."""
    return blocks.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def nearest(
    rows: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
    dims: int = DIMS, confidence: float = CONFIDENCE, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row that ``is_query`` selects."""
    spark = rows.sparkSession
    vectors = usable_vectors(rows, vec_id, embedding)
    widths = vectors.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    widths = widths.orderBy(F.col("n").desc(), F.col("width").desc()).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = widths[0]["width"], widths[0]["n"]
    vectors = vectors.filter(F.size("vector") == width)
    matrix = projection(width, dims, seed)
    sample = sample_of(vectors, total, min(sample_rows, max(1, SAMPLE_BYTES // (8 * width))), seed)
    sampled = np.array([r[0] for r in sample.collect()], np.float64).reshape(-1, width)
    nodes = split_tree(projected(sampled, matrix), min(MOST_CELLS, max(1, math.ceil(total / block_rows))))
    stop = chi_square_quantile(confidence, dims)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells_of(nodes, projected(data, matrix)), pa.int32())], names=["vec_id", "vector", "cell"])

    scratch = Scratch(spark)
    cell_rows = "vec_id long, vector array<double>, cell int"
    placed = scratch.stored(returnable(vectors, k).mapInArrow(locate, cell_rows), "placed")
    # cells over the block size are split by a hash of the id: one row per cell, at most MOST_CELLS
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {c: max(1, math.ceil(n / block_rows)) for c, n in sizes.items()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    cell_part = F.element_at(F.create_map(*[F.lit(x) for c, n in parts.items() for x in (c, n)]), F.col("cell"))
    cell_first = F.element_at(F.create_map(*[F.lit(int(x)) for c, n in first.items() for x in (c, n)]), F.col("cell"))
    blocks = placed.withColumn("block", (cell_first + F.pmod(F.xxhash64("vec_id", "vector"), cell_part)).cast("int")).select("vec_id", "vector", "block")
    asking = vectors.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    queries = asking.mapInArrow(locate, cell_rows)

    def search(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            data = np.stack(held["vector"].to_numpy())
            block = Block(held["vec_id"].to_numpy(), data, projected(data, matrix))
            points = projected(np.stack(asked["vector"].to_numpy()), matrix)
            for query_id, vector, point, bound in zip(asked["vec_id"], asked["vector"], points, asked["bound"], strict=True):
                scores, ids = block.search(query_id, vector, point, k, bound, stop)
                out.append(pd.DataFrame({"query_id": np.full(len(ids), query_id, np.int64), "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    def visit(asked: DataFrame) -> DataFrame:
        chunks = chunks_of(asked, chunk_rows)
        asked = join_by_key(asked, chunks, ["block"], ["vec_id"], "inner")
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
        copies = copies_of(blocks, chunks).groupBy("block", "chunk")
        found = asked.groupBy("block", "chunk").cogroup(copies).applyInPandas(search, FOUND)
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    home = queries.withColumn("part", F.explode(F.sequence(F.lit(0), cell_part - 1)))
    home = home.select("vec_id", "vector", F.lit(float("inf")).alias("bound"), (cell_first + F.col("part")).cast("int").alias("block"))
    near = scratch.stored(visit(home), "near")
    reached = near.groupBy("query_id").agg(F.max("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf")))
    asked = queries.join(reached, queries["vec_id"] == reached["query_id"], "left").select(
        "vec_id", "vector", "cell", F.coalesce(bound, F.lit(float("inf"))).alias("bound")
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block that the query's stopping radius reaches, its own cell left out."""
        for b in batches:
            points = projected(np.asarray(b.column(1).flatten(), np.float64).reshape(-1, width), matrix)
            rows_out, to = [], []
            for i, (cell, far) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for c in reach(nodes, points[i], far * math.sqrt(stop) if far < math.inf else math.inf):
                    if c != cell and c in parts:
                        rows_out += [i] * parts[c]
                        to += range(first[c], first[c] + parts[c])
            taken = b.take(pa.array(rows_out, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), taken.column(3), pa.array(to, pa.int32())],
                names=["vec_id", "vector", "bound", "block"],
            )

    beyond = visit(asked.mapInArrow(spread, "vec_id long, vector array<double>, bound double, block int"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    both = near.select("query_id", "vec_id", "score").unionByName(beyond.select("query_id", "vec_id", "score"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
