"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, then exact scores of what survives.

Queries and candidates are dealt over a grid of tiles by a hash of their id; tile sizes are fixed, so a task holds one query block and
one candidate block whatever the input. In a tile both sides are quantised to int8 with one scale per vector, and
the integer product of the codes (float32 products of small integers, exact up to 2^24) gives every inner product up to a
bound from the rounding left over:

    x.y = x'.y' + e_x.y + x'.e_y,   |x.y - x'.y'| <= |e_x| |y| + |x'| |e_y|

A candidate survives if its upper bound reaches the k-th best lower bound of its query; nothing that belongs to the
answer can fall out, so the search is exact. Survivors are scored in double precision on the original vectors. The k best of
each tile are merged by heaps, in levels of bounded fan-in.

Vectors that are null, zero or hold null or non-finite components take no part; vectors of another length than the query's are
no candidates of it. Equal scores go to the smaller id. Rows that repeat a vec_id are candidates of their own, but not of a query of that
vec_id; as queries they are one, with the first of their usable vectors in the order of arrays. Fewer candidates than k: all of them. Other
columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import map_rows, table
from docfields.llm.vectors import in_order, matrix, usable

QUERY_TILE, CANDIDATE_TILE, FAN_IN = 2048, 16384, 64
#: The product of int8 codes is exact in float32 up to this many components at a time.
EXACT_DIMS = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes (int8 values held in float32), scale, length of what rounding left, length of the coded vector."""
    scale = np.abs(x).max(1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.float32), scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query in one tile, best first."""
    qc, qs, qe, qn = quantised(q)
    cc, cs, ce, _ = quantised(c)
    norms = np.linalg.norm(c, axis=1)
    out = []
    for at in range(0, len(q), 256):
        rows = slice(at, at + 256)
        rough = np.zeros((len(q[rows]), len(c)))
        for d in range(0, q.shape[1], EXACT_DIMS):
            rough += qc[rows, d : d + EXACT_DIMS] @ cc[:, d : d + EXACT_DIMS].T
        rough *= qs[rows, None] * cs[None, :]
        bound = (qe[rows, None] * norms[None, :] + qn[rows, None] * ce[None, :]) * (1 + 1e-9) + 1e-12 * qn[rows, None] * norms[None, :]
        own = query_ids[rows, None] == ids[None, :]
        low = np.where(own, -np.inf, rough - bound)
        least = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(low), -np.inf)
        i, j = np.nonzero(((rough + bound) >= least[:, None]) & ~own)
        score = in_order(q[at + i], c[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(low)))
        best = np.arange(len(i)) - first[i] < k
        out.append((at + i[best], j[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def _tile_frame(k: int):
    def work(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "cell": [], "ids": [], "scores": []}
        if len(queries) and len(candidates):
            for dim, some in queries.groupby(queries["x"].map(len)):
                same = candidates[candidates["x"].map(len) == dim]
                if not len(same):
                    continue
                ids = same["vec_id"].to_numpy()
                i, j, score = tile(some["query_id"].to_numpy(), matrix(list(some["x"])), ids, matrix(list(same["x"])), k)
                names = some["query_id"].to_numpy()
                ends = np.searchsorted(i, np.arange(len(some) + 1))
                for r in np.flatnonzero(np.diff(ends)):
                    part = slice(ends[r], ends[r + 1])
                    found["query_id"].append(names[r])
                    found["cell"].append(int(key[1]))
                    found["ids"].append(ids[j[part]])
                    found["scores"].append(score[part])
        return pd.DataFrame({c: pd.Series(v, dtype="object" if c in ("ids", "scores") else "int64") for c, v in found.items()})

    return work


def _merged(k: int):
    def work(rows: dict) -> dict:
        out = {"query_id": rows["query_id"], "cell": rows["cell"], "ids": [], "scores": []}
        for lists in rows["lists"]:
            ordered = (zip((-s for s in x["scores"]), x["ids"]) for x in lists)
            best = [b for _, b in zip(range(k), heapq.merge(*ordered))]
            out["ids"].append([b[1] for b in best])
            out["scores"].append([-b[0] for b in best])
        return out

    return work


def search(queries: DataFrame, candidates: DataFrame, k: int, query_tile: int = QUERY_TILE, candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of `candidates` (vec_id, x) for each vec_id of `queries` (vec_id, x)."""
    q, c = usable(queries, embedding="x").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")), usable(candidates, embedding="x")
    n_q, n_c = q.count(), c.count()
    rows, cells = max(1, -(-n_q // query_tile)), max(1, -(-n_c // candidate_tile))
    # queries go to every candidate cell, candidates to every query row of the grid: each pair meets in one tile
    q = q.withColumn("row", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(rows))).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    c = c.withColumn("cell", F.pmod(F.xxhash64("vec_id", "x"), F.lit(cells))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
    schema = "query_id long, cell long, ids array<long>, scores array<double>"
    best = q.groupBy("row", "cell").cogroup(c.groupBy("row", "cell")).applyInPandas(_tile_frame(k), schema)
    left = cells
    while left > 1:
        left = -(-left // FAN_IN)
        lists = best.groupBy("query_id", F.floor(F.col("cell") / FAN_IN).alias("cell")).agg(F.collect_list(F.struct("ids", "scores")).alias("lists"))
        best = map_rows(lists, _merged(k), schema)
    return best.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score")
    )


def op2_nearest(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return search(rows.filter(F.col("vec_id") % 20 == 0), rows, k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM (SELECT vec_id, min(x) AS x FROM v GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
