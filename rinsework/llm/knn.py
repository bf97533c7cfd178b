"""Exact top-k search by inner product: a Voronoi join of queries and data.

Pivots, about as many as the square root of the rows, cut the space into cells; queries and data go to the cell of their
nearest pivot. First each query is solved within its own cell, which gives it a floor: a score that its answer is sure to
reach k times. Summaries of the cells then say which other cells may hold a vector that reaches the floor, and the query is
sent to those only, so what is replicated is what the bounds can't rule out. Cells are solved locally, in blocks, and only
scores that reach the floor go on, k at most for a query and block.

With unit vector u along the pivot p of a cell, radius r (the farthest of its vectors from p), and its vectors x between a and b along
u and at most h across, for each query q::

    <q,x>  <=  <q,p> + |q| r        and        <q,x>  <=  max(<q,u> a, <q,u> b) + |q - <q,u> u| h

Sizes: the driver gets the pivots, whose number has a bound, and a row for each cell. A cell may hold any share of the rows, so its
blocks are dealt by (cell, salt), salts growing with its size; queries are dealt to parts of bounded size. Vectors that are
spread evenly over many dimensions (random ones) let no bound rule out anything, and then every query meets every block.

Defined cases: vectors that are null, or hold a null, NaN or infinite component (also after scaling), take no part, nor do rows with
a null id; rows with the query's own id are no candidates; repeated candidate rows count as often as they occur, repeated
query rows once; shorter vectors are filled with zeros; ties go to the smaller id; fewer candidates than k give fewer rows; no
rows give no rows; scores are exact integers within a long and clipped beyond; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinsework.llm.workers import tidy
from rinsework.session import staged

SLACK = 1e-6  # bounds are floating point: they give way by this share of the products that they are made of
EXACT = 2.0**52
NONE = np.int64(-(2**63))
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        own = v.values.to_numpy(zero_copy_only=False)
        out[i, : len(own)] = own
    return np.floor(out * scale)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, ties to smaller ids; NONE is no score."""
    kth = np.partition(scores, -k, axis=1)[:, -k][:, None] if scores.shape[1] > k else np.full((len(scores), 1), NONE)
    rows, cols = np.nonzero((scores >= kth) & (scores > NONE))
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(scores)))[rows]
    return rows[rank < k], cols[rank < k]


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ x.T).astype(np.int64)
    whole = [[[int(c) for c in row] for row in m] for m in (q, x)]
    return np.array([[min(MOST, max(LEAST, sum(a * b for a, b in zip(u, v, strict=True)))) for v in whole[1]] for u in whole[0]], np.int64).reshape(len(q), len(x))


def voronoi_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int | None = None, most_pivots: int = 4096, block: int = 8192, report: dict[str, float] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding. pivots: the square root of the rows, `most_pivots` at most.
    report: gets `met`, the share of all pairs of a query and a vector that meet (one more job)."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf"))
    v = F.col("embedding").cast("array<double>")
    data = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, odd)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asking, dims, widest = data.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0))).first()
    dims, widest = max(dims, 1), widest * scale + 1
    exact = dims * widest**2 < EXACT
    kind = "<i2" if widest < 2**15 else "<f8"

    cells = min(most_pivots, pivots or int(np.ceil(np.sqrt(max(n, 1)))))
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("v").toArrow().column(0).combine_chunks()
    p = np.unique(_matrix(picked, dims, scale), axis=0) if len(picked) else np.zeros((1, dims))
    p_norm = np.linalg.norm(p, axis=1)
    unit = p / np.maximum(p_norm, 1e-300)[:, None]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims, scale)
            cell = np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + p_norm**2, 0).argmin(1) if len(x) else np.zeros(0, int)
            far, along = np.linalg.norm(x - p[cell], axis=1), (x * unit[cell]).sum(1)
            across = np.linalg.norm(x - along[:, None] * unit[cell], axis=1)
            raw = pa.array([row.tobytes() for row in x.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cell, pa.int32()), *map(pa.array, (far, along, across)), raw], ["vec_id", "asks", "cell", "far", "along", "across", "x"])

    placed = staged(data.mapInArrow(tidy(place), "vec_id long, asks boolean, cell int, far double, along double, across double, x binary"), "vectors")
    r, low, high, wide, rows = (np.zeros(len(p)) for _ in range(5))
    for s in placed.groupBy("cell").agg(F.max("far").alias("r"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("wide"), F.count("*").alias("n")).collect():
        r[s.cell], low[s.cell], high[s.cell], wide[s.cell], rows[s.cell] = s.r, s.low, s.high, s.wide, s.n
    salts = np.maximum(1, np.ceil(rows / block)).astype(int)
    parts = max(1, -(-int(asking) // block))
    # a row for each cell, as many as pivots at most
    dealt = data.sparkSession.createDataFrame([(c, int(salts[c])) for c in range(len(p))], "cell int, salts int")

    def decode(raw: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), dims).astype(np.float64)

    salted = placed.select("vec_id", "cell", "x").join(F.broadcast(dealt), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    blocks = salted.groupBy("cell", "salt").agg(F.collect_list(F.struct("vec_id", "x")).alias("data"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for qs, own in zip(*b.columns, strict=True):
                (q_id, q_key, floor, q), (ids, x) = qs.values.flatten(), own.values.flatten()
                q_id, q_key, floor, ids = (a.to_numpy() for a in (q_id, q_key, floor, ids))
                asked, held = decode(q), decode(x)
                for at in range(0, len(asked), 1024):
                    part = slice(at, at + 1024)
                    scores = _products(asked[part], held, exact)
                    scores[(q_id[part][:, None] == ids[None, :]) | (scores < floor[part][:, None])] = NONE
                    i, j = _top(scores, ids, k)
                    out.append((q_id[part][i], q_key[part][i], ids[j], scores[i, j]))
            found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "key", "vec_id", "score"])

    def solved(queries: DataFrame) -> DataFrame:
        """queries: cell, query_id, key, floor, x, a row for each cell that a query is sent to."""
        spread = queries.join(F.broadcast(dealt), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        packed = spread.groupBy("cell", "salt", F.pmod("key", F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", "key", "floor", "x")).alias("qs"))
        return packed.join(blocks, ["cell", "salt"]).select("qs", "data").mapInArrow(tidy(solve), "query_id long, key long, vec_id long, score long")

    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    queries = placed.filter("asks").select("cell", F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "x").alias("key"), "x").distinct()
    own = staged(best(solved(queries.withColumn("floor", F.lit(int(NONE))))), "own_cell")
    floors = own.filter(F.col("rank") == k).select("query_id", "key", F.col("score").alias("floor"))
    ready = queries.join(floors, ["query_id", "key"], "left").withColumn("floor", F.coalesce("floor", F.lit(int(NONE))))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, floor, home = decode(b.column("x")), b.column("floor").to_numpy().astype(float), b.column("cell").to_numpy()
            norm, along = np.linalg.norm(q, axis=1)[:, None], q @ unit.T
            across = np.sqrt(np.maximum(norm**2 - along**2, 0) + SLACK * norm**2)
            near = q @ p.T + norm * r
            beside = np.maximum(along * low, along * high) + across * wide
            slack = SLACK * (norm * (p_norm + r) + norm * wide) + 1
            open_cells = (np.minimum(near, beside) + slack >= floor[:, None]) & (rows > 0)
            open_cells[np.arange(len(q)), home] = False
            cells = pa.array([np.flatnonzero(o) for o in open_cells], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("query_id", "key", "floor", "x")] + [cells], ["query_id", "key", "floor", "x", "cells"])

    sent = ready.mapInArrow(tidy(reach), "query_id long, key long, floor long, x binary, cells array<int>")
    sent = sent.select(F.explode("cells").alias("cell"), "query_id", "key", "floor", "x")
    if report is not None:
        met = sent.select("cell").unionByName(queries.select("cell")).groupBy("cell").count().collect()
        report["met"] = sum(m["count"] * rows[m.cell] for m in met) / max(1, int(asking) * int(n))
    others = solved(sent)
    return best(own.drop("rank").unionByName(others)).select("query_id", "rank", "vec_id", "score")
