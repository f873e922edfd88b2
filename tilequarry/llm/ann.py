"""Nearest neighbours by inner product: stable projections in kd-trees, verified until a chi-square test stops.

Vectors are extended by one component so that all have the largest norm and queries have 0 there:
then the largest inner product is the smallest distance. A projection by Gaussian (2-stable)
numbers to DIMS dimensions makes the projected squared distance the true one times a chi-square
variable. Rows lie in cells (leaves of a kd-tree over a sample's projections), cells in slabs of
bounded size; a slab has its own kd-tree. A query sees neighbours in the order of projected
distance, and stops when an unseen one would beat its k-th best only with a probability under 1 - STOP.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.llm import scratch

DIMS, STOP = 8, 0.97
#: Rows of a slab, of a kd-tree's leaf, and of the sample that cells are fitted on; most cells.
SLAB, LEAF, SAMPLE, MOST_CELLS = 16_384, 64, 20_000, 4096


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows(vec_id, embedding as doubles) that take part, and their dimension, the most frequent one.

    Null ids and vectors, zero vectors, null or non-finite components and other dimensions take no part.
    """
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 0
    return rows.where(F.size("embedding") == dim), dim


def chi_square(x: np.ndarray) -> np.ndarray:
    """The distribution function for DIMS degrees of freedom, an even number."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(DIMS // 2))


def _matrix(dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, DIMS))


def _projected(x: np.ndarray, top: float, matrix: np.ndarray, query: bool = False) -> np.ndarray:
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))
    return np.column_stack((x, last)) @ matrix


def _split(y: np.ndarray, size: int) -> list[np.ndarray]:
    """Leaves of a kd-tree: rows halved along the widest dimension until at most ``size`` are left."""
    done, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        own = y[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def _cells(y: np.ndarray, n: int) -> list[tuple]:
    """Splits (axis, value, low child, high child; a leaf is ~cell) of a kd-tree with ``n`` cells, a power of two."""
    nodes: list = [None]
    todo, cells = [(0, y, n)], 0
    while todo:
        at, own, n = todo.pop()
        if n == 1 or len(own) < 2:
            nodes[at] = cells
            cells += 1
            continue
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        value = float(np.median(own[:, axis]))
        below = own[:, axis] < value
        nodes[at] = (axis, value, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), own[below], n // 2), (len(nodes) + 1, own[~below], n // 2)]
        nodes += [None, None]
    return nodes


def _cell_of(nodes: list, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y), np.int32)
    todo = [(0, np.arange(len(y)))]
    while todo:
        at, rows = todo.pop()
        if isinstance(nodes[at], int):
            out[rows] = nodes[at]
        elif len(rows):
            axis, value, low, high = nodes[at]
            below = y[rows, axis] < value
            todo += [(low, rows[below]), (high, rows[~below])]
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _searched(top: float, matrix: np.ndarray, k: int):
    def search(slab: pa.Table, asked: pa.Table) -> pa.Table:
        """The k best of a slab for every query that visits it; bound is the k-th best score so far."""
        out: tuple[list, list, list] = ([], [], [])
        if slab.num_rows and asked.num_rows:
            x, ids = _vectors(slab["embedding"]), slab["vec_id"].to_numpy()
            y = _projected(x, top, matrix)
            leaves = _split(y, LEAF)
            low, high = (np.array([f(y[r], axis=0) for r in leaves]) for f in (np.min, np.max))
            q, names, bounds = _vectors(asked["embedding"]), asked["query_id"].to_numpy(), asked["bound"].to_numpy(zero_copy_only=False)
            for vector, projected, name, bound in zip(q, _projected(q, top, matrix, True), names.tolist(), bounds.tolist(), strict=True):
                gap = np.maximum(0, np.maximum(low - projected, projected - high))
                reach = (gap * gap).sum(axis=1)
                order = np.argsort(reach, kind="stable")
                far = top * top + float(vector @ vector)
                got, score = np.zeros(0, np.int64), np.zeros(0)
                at, take = 0, 2
                while at < len(order):
                    kth = max(bound, score[-1] if len(score) >= k else -np.inf)
                    if kth > -np.inf and chi_square(reach[order[at]] / max(far - 2 * kth, 1e-300)) >= STOP:
                        break
                    rows = np.concatenate([leaves[i] for i in order[at : at + take]])
                    at, take = at + take, min(2 * take, 64)
                    rows = rows[ids[rows] != name]
                    got = np.concatenate((got, ids[rows]))
                    score = np.concatenate((score, (x[rows] * vector).sum(axis=1)))
                    keep = _best(got, score, k)
                    got, score = got[keep], score[keep]
                for values, more in zip(out, ([name] * len(got), got.tolist(), score.tolist()), strict=True):
                    values += more
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return search


def search(rows: DataFrame, is_query: Column | None = None, k: int = 20) -> DataFrame:
    """The ``k`` best rows by inner product for every query among rows(vec_id, embedding): query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by 20 unless ``is_query`` says otherwise; a row is
    no candidate for a query of its own id; repeated rows are candidates each, and one query: of
    rows that share an id, the one with the smallest vector by its components in order. Scores are exact sums in double precision; ties go to the smaller id. All candidates come
    back if fewer than ``k``; an empty table gives an empty result; other columns are ignored.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    own, dim = usable(rows)
    own = scratch.store(own, "vectors")
    n, top = own.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    top = (top or 1.0) * (1 + 1e-9)
    matrix = _matrix(dim)
    cells = 1
    while cells < min(MOST_CELLS, n // (SLAB // 2)):
        cells *= 2
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow() if cells > 1 else None
    nodes = _cells(_projected(_vectors(sample["embedding"]), top, matrix), cells) if sample is not None and sample.num_rows else [0]

    def dealt(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cell and projection of each row, and its number in this task, which deals copies of one row to all slabs of their cell."""
        seen = 0
        for batch in stream:
            if batch.num_rows:
                y = _projected(_vectors(batch.column("embedding")), top, matrix)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(_cell_of(nodes, y)), pa.array(y.tolist(), pa.list_(pa.float64())), pa.array(np.arange(seen, seen + batch.num_rows))], names=["vec_id", "embedding", "cell", "y", "nth"])
                seen += batch.num_rows

    placed = scratch.store(own.mapInArrow(dealt, "vec_id bigint, embedding array<double>, cell int, y array<double>, nth bigint"), "cells")
    extremes = [f(F.col("y")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMS)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *extremes).orderBy("cell").collect()
    slabs = {r["cell"]: -(-r["n"] // SLAB) for r in boxes}
    count = F.element_at(F.create_map(*[F.lit(v) for pair in slabs.items() for v in pair]), F.col("cell")) if slabs else F.lit(1)
    slab = F.concat_ws("/", F.col("cell").cast("string"), F.pmod(F.xxhash64("vec_id", "nth"), count).cast("string"))
    data = placed.select("vec_id", "embedding", slab.alias("slab"))
    smallest = F.min(F.struct("embedding", "cell")).alias("q")
    queries = placed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(smallest).select("query_id", "q.embedding", "q.cell")
    queries = scratch.store(queries, "queries")
    low, high = (np.array([[r[f"{name}{i}"] for i in range(DIMS)] for r in boxes]).reshape(-1, DIMS) for name in ("low", "high"))
    names = [r["cell"] for r in boxes]

    def routed(home: bool):
        def route(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Send each query to the slabs of its home cell, or to those of all others that its bound does not rule out."""
            for batch in stream:
                if not batch.num_rows:
                    continue
                q = _vectors(batch.column("embedding"))
                bound = batch.column("bound").to_numpy(zero_copy_only=False)
                take, to = [], []
                for i, (own, y) in enumerate(zip(batch.column("cell").to_pylist(), _projected(q, top, matrix, True), strict=True)):
                    gap = np.maximum(0, np.maximum(low - y, y - high))
                    far = max(top * top + float(q[i] @ q[i]) - 2 * bound[i], 1e-300) if bound[i] > -np.inf else np.inf
                    passed = chi_square((gap * gap).sum(axis=1) / far) < STOP
                    for cell in [own] if home else [c for c, p in zip(names, passed, strict=True) if p and c != own]:
                        take += [i] * slabs[cell]
                        to += [f"{cell}/{s}" for s in range(slabs[cell])]
                some = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column("query_id"), some.column("embedding"), some.column("bound"), pa.array(to, pa.string())], names=["query_id", "embedding", "bound", "slab"])

        return route

    def visit(asked: DataFrame, home: bool) -> DataFrame:
        sent = asked.select("query_id", "embedding", "cell", "bound").mapInArrow(routed(home), "query_id bigint, embedding array<double>, bound double, slab string")
        return data.groupBy("slab").cogroup(sent.groupBy("slab")).applyInArrow(_searched(top, matrix, k), "query_id bigint, vec_id bigint, score double")

    first = scratch.store(visit(queries.withColumn("bound", F.lit(float("-inf"))), True), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_kth"))
    asked = queries.join(kth, F.col("query_id") == F.col("_q"), "left").withColumn("bound", F.coalesce(F.col("_kth"), F.lit(float("-inf"))))
    both = first.unionByName(visit(asked, False))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
