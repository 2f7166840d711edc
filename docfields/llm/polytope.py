"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe and verified pairs.

A hash of a table rotates the unit vector (three rounds of random signs and a fast Hadamard transform, zero-padded to a power of two) and
takes the axis nearest to it, with its sign; a table joins HASHES such hashes. A vector lies in its own bucket and in the
buckets that change one hash to its second nearest axis (multiprobe), so two vectors meet if one's own bucket is among
the other's. Pairs that meet are verified by their cosine in double precision; a pair is counted in the first table
where it meets, so no list of pairs is ever made: tasks put out counts and one spanning link per vector.

Equal vectors are one class: one representative is hashed, its copies count in n_links and follow its component. A bucket is cut into
blocks of BLOCK rows and its block pairs are tasks of their own, so a bucket with a third of all vectors spreads out; all its pairs are compared, none dropped.

Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths neither. A row
without vec_id comes out with no links, null component and kept. Rows that repeat a vec_id count as one vector if equal; if not, the id is
linked as soon as one of its vectors is, and comes out once. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import lists_of, map_groups, map_rows, stored, table
from docfields.llm.graph import components
from docfields.llm.vectors import in_order, matrix, usable

THRESHOLD = 0.95
BLOCK, SEED = 2048, 11
#: Chance that two vectors with cosine 0.95 miss each other in every table, at most about.
MISS = 2e-5


def hashes_for(n: int) -> int:
    """Hashes in a table: buckets keep pace with the vectors, so that strangers seldom share one (128 axes a hash at 64 dimensions)."""
    return max(3, math.ceil(math.log(max(n, 1) / 8 + 1, 128)))


def tables_for(hashes: int) -> int:
    """Tables that leave a pair at cosine 0.95 unmet with a chance of MISS (chance to meet in one: measured, 0.51 with 3 hashes)."""
    meets = 0.684 * 0.74 ** (hashes - 2)
    return math.ceil(math.log(MISS) / math.log(1 - meets))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two)."""
    n = x.shape[1]
    x = x.copy()
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


def buckets(unit: np.ndarray, tables: int, hashes: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """own bucket (rows x tables) and probed buckets (rows x tables x hashes) of unit vectors."""
    dim = 1 << max(1, int(unit.shape[1] - 1).bit_length())
    padded = np.zeros((len(unit), dim))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, dim])
    own = np.zeros((len(unit), tables), np.int64)
    probes = np.zeros((len(unit), tables, hashes), np.int64)
    for t in range(tables):
        first, second = [], []
        for _ in range(hashes):
            r = padded
            for _ in range(3):
                r = hadamard(r * rng.choice([-1.0, 1.0], dim)) / np.sqrt(dim)
            near = np.argpartition(-np.abs(r), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(r), near, 1)
            near = np.where((size[:, 0] >= size[:, 1])[:, None], near, near[:, ::-1])
            sign = np.take_along_axis(r, near, 1) < 0
            code = near * 2 + sign
            first.append(code[:, 0])
            second.append(code[:, 1])
        base = np.zeros(len(unit), np.int64)
        for code in first:
            base = base * (2 * dim) + code
        own[:, t] = base
        for h in range(hashes):
            probe = np.zeros(len(unit), np.int64)
            for i, code in enumerate(first):
                probe = probe * (2 * dim) + (second[i] if i == h else code)
            probes[:, t, h] = probe
    return own, probes


def _hashed(tables: int, hashes: int):
    def work(rows: dict) -> dict:
        out = {"rep": rows["rep"], "x": rows["x"], "n": rows["n"], "own": [None] * len(rows["rep"]), "probes": [None] * len(rows["rep"])}
        dims = np.array([len(x) for x in rows["x"]])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = matrix([rows["x"][i] for i in at])
            x = x / np.abs(x).max(1, keepdims=True)  # keeps very large and very small components finite
            own, probes = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes)
            for i, o, p in zip(at, own, probes):
                out["own"][i], out["probes"][i] = o, p.reshape(-1)
        return out

    return work


def _meet(own_a, probes_a, own_b, probes_b) -> np.ndarray:
    """Pairs (rows aligned) x tables: whether the pair meets in the table."""
    return (own_a == own_b) | (probes_a == own_b[:, :, None]).any(2) | (probes_b == own_a[:, :, None]).any(2)


def _compared(threshold: float, hashes: int):
    def work(rows: pa.RecordBatch) -> dict | None:
        """One pair of blocks of one bucket: rows whose own bucket it is (side 0) against rows that lie in it by any way (side 1)."""
        col = dict(zip(rows.schema.names, rows.columns))
        n, cut = rows.num_rows, int(np.searchsorted(col["side"].to_numpy(), 1))
        if cut == 0 or cut == n or n == 2 and col["rep"][0] == col["rep"][1]:
            return None
        t = col["t"][0].as_py()
        every, own, probes = (lists_of(col[c])[0].reshape(n, -1) for c in ("x", "own", "probes"))
        x, y = every[:cut].astype(np.float64), every[cut:].astype(np.float64)
        xn, yn = np.sqrt(in_order(x, x)), np.sqrt(in_order(y, y))
        own_x, own_y = own[:cut], own[cut:]
        px, py = probes[:cut].reshape(cut, -1, hashes), probes[cut:].reshape(n - cut, -1, hashes)
        ids, other = col["rep"].to_numpy()[:cut], col["rep"].to_numpy()[cut:]
        ns, ms = col["n"].to_numpy()[:cut], col["n"].to_numpy()[cut:]
        mine = own_y[:, t] == own_x[0, t]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(x), 512):
            rough = (x[at : at + 512] / xn[at : at + 512, None]) @ (y / yn[:, None]).T
            i, j = np.nonzero(rough >= threshold - 1e-9)
            i = i + at
            # both own: seen from both sides, so once; and only in the first table where they meet
            keep = (ids[i] != other[j]) & ~(mine[j] & (ids[i] > other[j]))
            i, j = i[keep], j[keep]
            for cut in range(0, len(i), 200_000):
                a, b = i[cut : cut + 200_000], j[cut : cut + 200_000]
                sure = in_order(x[a], y[b]) / (xn[a] * yn[b]) >= threshold
                a, b = a[sure], b[sure]
                if t:
                    new = ~_meet(own_x[a, :t], px[a, :t], own_y[b, :t], py[b, :t]).any(1)
                    a, b = a[new], b[new]
                # a pair that meets by probes from both sides is the left's own bucket twice: once for the smaller id
                both = ~mine[b] & (px[a, t] == own_y[b, t][:, None]).any(1) & (ids[a] > other[b])
                found.append((a[~both], b[~both]))
        if not found:
            return None
        a = np.concatenate([f[0] for f in found])
        b = np.concatenate([f[1] for f in found])
        if not len(a):
            return None
        # counts, and for every vector one link of this block pair to a smaller id: a chain through equal components stays whole
        reps, at = np.unique(np.concatenate([ids[a], other[b]]), return_inverse=True)
        links = np.bincount(at, np.concatenate([ms[b], ns[a]]), len(reps)).astype(np.int64)
        joined, to = _forest(ids[a], other[b])
        return {
            "rep": np.concatenate([reps, joined]), "links": np.concatenate([links, np.zeros(len(to), np.int64)]),
            "to": np.concatenate([reps, to]),
        }

    return work


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, to) that join what the pairs (a, b) join, at most one for each id."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    head = np.arange(len(ids))
    while True:
        low = head.copy()
        np.minimum.at(low, head[i], head[j])
        np.minimum.at(low, head[j], head[i])
        low = np.minimum(low[low], low)
        new = low[head]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, head):
            break
        head = new
    moved = np.flatnonzero(head != np.arange(len(ids)))
    return ids[moved], ids[head[moved]]


def link(rows: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, hashes: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id of each vector of `rows` (vec_id, x) that can link."""
    good = stored(usable(rows, embedding="x").distinct().withColumn("key", F.xxhash64("x")), "polytope-rows")
    classes = good.groupBy("key", "x").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"))
    reps = stored(classes.select("rep", "x", "n", "key"), "polytope-classes")
    if hashes is None:
        hashes = hashes_for(reps.count())
    tables = tables or tables_for(hashes)
    kind = reps.schema["x"].dataType.simpleString()
    schema = f"rep long, x {kind}, n long, own array<long>, probes array<long>"
    hashed = stored(map_rows(reps.select("rep", "x", "n"), _hashed(tables, hashes), schema, 1024), "polytope-hashed")
    dim = F.size("x")
    lies = hashed.select("rep", dim.alias("dim"), F.posexplode("own").alias("t", "bucket")).withColumn("own_here", F.lit(True)).unionByName(
        hashed.select("rep", dim.alias("dim"), F.posexplode("probes").alias("p", "bucket")).select(
            "rep", "dim", F.floor(F.col("p") / hashes).cast("int").alias("t"), "bucket"
        ).withColumn("own_here", F.lit(False))
    )
    # buckets where an own vector can meet another, cut into blocks by a hash of the vector
    where = ["t", "dim", "bucket"]
    full = lies.groupBy(*where).agg(F.count_if("own_here").alias("own_n"), F.count("*").alias("all_n")).filter("own_n > 0 AND all_n > 1")
    full = full.withColumn("cuts_a", F.ceil(F.col("own_n") / block)).withColumn("cuts_b", F.ceil(F.col("all_n") / block)).drop("own_n", "all_n")
    placed = stored(lies.join(full, where), "polytope-placed")
    a = placed.filter("own_here").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("cuts_a"))).withColumn("j", F.explode(F.expr("sequence(0L, cuts_b - 1)")))
    b = placed.withColumn("j", F.pmod(F.xxhash64("rep"), F.col("cuts_b"))).withColumn("i", F.explode(F.expr("sequence(0L, cuts_a - 1)")))
    vectors = hashed.select("rep", "x", "n", "own", "probes")
    pick = ["t", "dim", "bucket", "i", "j", "rep"]
    key = ["t", "dim", "bucket", "i", "j"]
    sides = a.select(*pick, F.lit(0).alias("side")).unionByName(b.select(*pick, F.lit(1).alias("side"))).join(vectors, "rep")
    found = map_groups(sides, key, ["side", "rep"], _compared(threshold, hashes), "rep long, links long, to long")
    found = stored(found, "polytope-found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    heads = components(found.filter("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), "polytope-components")
    of_class = (
        reps.join(counts, "rep", "left").join(heads.withColumnRenamed("id", "rep"), "rep", "left")
        .select("key", "x", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        good.join(of_class, ["key", "x"]).groupBy("vec_id")
        .agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"))
    found = link(rows)
    named = rows.filter("vec_id IS NOT NULL").select("vec_id").distinct().join(found, "vec_id", "left")
    every = named.unionByName(rows.filter("vec_id IS NULL").select("vec_id"), allowMissingColumns=True)
    return every.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
