"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors become whole numbers, floor(64 * x).  With M the largest squared length, a data vector gets
one more component, sqrt(M - |x|^2), and a query a 0 there; distances between them then order as
inner products, so the search is for nearest neighbours.  Queries and data go to the nearest of a
few pivots.  Per cell, summaries (size, largest distance to the pivot, and for data the k + 1
smallest) give each cell of queries a bound on the distance of its k-th neighbour, and from it the
range of distances to a data cell's pivot that can still matter.  Query cells next to each other make
groups of about GROUP_QUERIES; only data in the range of one of its cells are copied to a group.  Groups
are solved locally, in runs of bounded size, and the runs' best k are merged.  In many dimensions the
ranges are wide and most data go to most groups: the bounds are exact, not tight; then a data vector
moves once for each GROUP_QUERIES queries, and `report` says how much the bounds left out.

A query group or data cell of any size is split into runs by a hash of the id.  On the driver are
the pivots and the summaries, bounded by n_pivots.  Vectors that are null, or hold null or
non-finite components, take no part; a shorter vector counts as padded with zeros.  A query isn't
its own candidate: rows with its vec_id are left out.  Rows that repeat are separate candidates and
separate queries.  Ties go to the smaller vec_id.  Rows without vec_id take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import frozen

SAMPLE = 2048
RUN_DATA = 32_768
GROUP_QUERIES = 4096
CELL_QUERIES = 64


def whole_numbers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of the components, as long."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """A list column as rows of width numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(sizes), width), np.int64), np.concatenate(([0], np.cumsum(sizes)))
    for k, n in enumerate(sizes):
        out[k, :n] = flat[at[k] : at[k + 1]]
    return out


def _lifted(m: np.ndarray, most: float, query: bool) -> np.ndarray:
    m = m.astype(np.float64)
    last = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, most - (m * m).sum(axis=1)))
    return np.column_stack([m, last])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    chosen, gap = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int):
    """For each query the k best (position of query, id, score) among the data; ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    limit = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    kind = np.float64 if limit < 2**53 else np.int64
    turned = data.T.astype(kind)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        score = (q.astype(kind) @ turned).astype(np.int64)
        own = query_ids[at : at + 256, None] == ids
        n = min(len(ids), k + int(own.sum(axis=1).max(initial=0)))
        if limit * len(ids) < 2**52:  # one number orders by score, then by smaller id
            key = score * len(ids) - np.arange(len(ids))
            key[own] = np.iinfo(np.int64).min
            top = np.argpartition(-key, n - 1, axis=1)[:, :n] if n < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
        else:
            top = np.stack([np.lexsort((np.arange(len(ids)), -s))[:n] for s in score])
        for r, t in enumerate(top):
            t = t[~own[r][t]]
            t = t[np.lexsort((ids[t], -score[r][t]))][:k]
            yield at + r, ids[t], score[r][t]


def top_k(queries: DataFrame, data: DataFrame, k: int = 20, scale: int = 64, group_queries: int = GROUP_QUERIES, run_data: int = RUN_DATA, cell_queries: int = CELL_QUERIES, most_pivots: int = 128, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each of queries(vec_id, embedding).

    A report gets the numbers of `groups`, of `data` vectors, and of `copied` ones, all groups counted.
    """
    spark = data.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries, data = whole_numbers(queries, scale), whole_numbers(data, scale)
    n_queries = queries.count()
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    most, width, n_data = data.agg(F.max(squared), F.max(F.size("v")), F.count("*")).first()
    if not n_queries or not n_data:
        return empty
    width = max(1, width, queries.agg(F.max(F.size("v"))).first()[0])
    n_pivots = max(2, min(most_pivots, -(-n_queries // cell_queries)))
    drawn = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= (SAMPLE << 20) // n_data).limit(2 * SAMPLE).collect()
    drawn = drawn or data.limit(SAMPLE).collect()
    rows = np.zeros((len(drawn), width), np.int64)
    for r, x in zip(rows, sorted(drawn, key=lambda x: (x[0], x[1]))):
        r[: len(x[1])] = x[1]
    pivots = far_apart(_lifted(rows, most, False), n_pivots)

    def to_cells(df: DataFrame, query: bool) -> DataFrame:
        def assign(batches):
            for b in batches:
                gaps = _distances(_lifted(_matrix(b["v"], width), most, query), pivots)
                cell = gaps.argmin(axis=1)
                gap = gaps[np.arange(len(cell)), cell] if len(cell) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(cell, pa.int32()), pa.array(gap, pa.float64())], ["vec_id", "v", "cell", "gap"])

        return df.mapInArrow(assign, "vec_id long, v array<long>, cell int, gap double")

    in_cells, q_in_cells = frozen(to_cells(data, False), "knn-data"), frozen(to_cells(queries, True), "knn-queries")

    def nearest(batches):
        held = [np.empty(0)] * len(pivots)
        for b in batches:
            cell, gap = b["cell"].to_numpy(), b["gap"].to_numpy()
            for c in np.unique(cell):
                held[c] = np.sort(np.concatenate([held[c], gap[cell == c]]))[: k + 1]
        for c, x in enumerate(held):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c), pa.int32()), pa.array(x)], ["cell", "gap"])

    near = [np.empty(0)] * len(pivots)
    by_gap = Window.partitionBy("cell").orderBy("gap")
    for c, x in in_cells.select("cell", "gap").mapInArrow(nearest, "cell int, gap double").withColumn("nth", F.row_number().over(by_gap)).where(F.col("nth") <= k + 1).groupBy("cell").agg(F.collect_list("gap")).collect():
        near[c] = np.sort(x)
    counts = {r[0]: r[1] for r in in_cells.groupBy("cell").count().collect()}
    groups = {r[0]: (r[1], r[2]) for r in q_in_cells.groupBy("cell").agg(F.count("*"), F.max("gap")).collect()}
    between, slack = _distances(pivots, pivots), 1e-6 * (1 + float(most) ** 0.5)
    # for each query cell and data cell the range of gaps that can matter, then for each group
    chain, left = [], set(groups)
    while left:
        chain.append(min(left, key=lambda c: (between[chain[-1], c] if chain else 0, c)))
        left.remove(chain[-1])
    group_of, sizes = np.zeros(len(pivots), np.int64), []
    for g in chain:
        if not sizes or sizes[-1] + groups[g][0] > group_queries:
            sizes.append(0)
        group_of[g] = len(sizes) - 1
        sizes[-1] += groups[g][0]
    low, high = np.full((len(sizes), len(pivots)), np.inf), np.full((len(sizes), len(pivots)), -np.inf)
    for g, (_, radius) in groups.items():
        bounds = np.sort(np.concatenate([radius + between[g, c] + near[c] for c in range(len(pivots))]))
        theta = bounds[k] if len(bounds) > k else np.inf  # the query itself may be one of the k + 1
        p = group_of[g]
        low[p], high[p] = np.minimum(low[p], between[g] - radius - theta - slack), np.maximum(high[p], between[g] + radius + theta + slack)
    parts = np.array([-(-n // (4 * group_queries)) for n in sizes])
    runs = np.array([max(1, -(-sum(counts.get(c, 0) for c in range(len(pivots)) if low[p, c] <= high[p, c]) // run_data)) for p in range(len(sizes))])

    if report is not None:

        def counted(batches):
            for b in batches:
                cell, gap = b["cell"].to_numpy(), b["gap"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([sum(int(((gap >= low[g][cell]) & (gap <= high[g][cell])).sum()) for g in range(len(sizes)))], pa.int64())], ["n"])

        copied_rows = in_cells.select("cell", "gap").mapInArrow(counted, "n long").agg(F.sum("n")).first()[0]
        report.update(groups=len(sizes), data=n_data, copied=copied_rows)

    def copy(batches):
        for b in batches:
            cell, gap, ids = b["cell"].to_numpy(), b["gap"].to_numpy(), b["vec_id"].to_numpy()
            out = []
            for g in range(len(sizes)):
                at = np.flatnonzero((gap >= low[g][cell]) & (gap <= high[g][cell]))
                run = ids[at] * 0x9E3779B1 % (1 << 61) // 64 % runs[g]
                out += [(at, np.full(len(at), g), run, np.full(len(at), p)) for p in range(parts[g]) if len(at)]
            if out:
                at, g, run, part = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(run, pa.int64()), pa.array(part, pa.int64()), b["vec_id"].take(pa.array(at)), b["v"].take(pa.array(at))], ["g", "run", "part", "vec_id", "v"])

    def copy_queries(batches):
        for b in batches:
            cell, ids = group_of[b["cell"].to_numpy()], b["vec_id"].to_numpy()
            part = ids * 0x85EBCA6B % (1 << 61) // 64 % parts[cell]
            at = np.repeat(np.arange(len(cell)), runs[cell])
            run = np.concatenate([np.arange(runs[c]) for c in cell]) if len(cell) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[at], pa.int32()), pa.array(run, pa.int64()), pa.array(part[at], pa.int64()), b["vec_id"].take(pa.array(at)), b["v"].take(pa.array(at))], ["g", "run", "part", "vec_id", "v"])

    copied = "g int, run long, part long, vec_id long, v array<long>"
    numbered = q_in_cells

    def solve(left, right):
        query_ids = left["vec_id"].to_numpy()
        q, ids = _matrix(left["v"], width), right["vec_id"].to_numpy()
        found = list(best(query_ids, q, ids, _matrix(right["v"], width), k)) if len(ids) and len(q) else []
        if not found:
            return pa.table({"query_id": pa.array([], pa.int64()), "g": pa.array([], pa.int32()), "copy": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        seen: dict[int, int] = {}
        nth = np.zeros(len(query_ids), np.int64)  # queries with the same id stay apart, in the order of their vectors
        for at in np.lexsort((*q.T[::-1], query_ids)):
            nth[at] = seen[query_ids[at]] = seen.get(query_ids[at], -1) + 1
        return pa.table({"query_id": np.repeat(query_ids[[f[0] for f in found]], [len(f[1]) for f in found]), "g": np.full(sum(len(f[1]) for f in found), left["g"][0].as_py(), np.int32), "copy": np.repeat(nth[[f[0] for f in found]], [len(f[1]) for f in found]), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    key = ["g", "run", "part"]
    local = numbered.mapInArrow(copy_queries, copied).groupBy(*key).cogroup(in_cells.mapInArrow(copy, copied).groupBy(*key)).applyInArrow(solve, "query_id long, g int, copy long, vec_id long, score long")
    merged = Window.partitionBy("query_id", "g", "copy").orderBy(F.col("score").desc(), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
