"""Near-duplicate texts by SetSketch registers: band, estimate jointly by likelihood, then verify on full sets.

A text's set are its distinct 5-word shingles. Its sketch has REGISTERS registers: register i is floor(1 - log_b x_i), cut off at 0 and LAST,
where x_i is the least of exponential variates that a hash gives the shingles. Registers of a union are the larger ones of the two
(mergeable), and two registers are equal with a chance that grows with the Jaccard similarity (locality-sensitive).

1. Equal sets are one class; its smallest doc_id stands for it. Copies, however many, meet in a partial sum only.
2. Bands of ROWS registers give buckets. A bucket is cut into blocks of BLOCK classes, block pairs are tasks of their own. In a task
   the similarity of each pair is estimated from its registers: the maximum of the joint likelihood of the numbers of larger, smaller and
   equal registers, given both set sizes. Pairs SIGMAS standard errors below the threshold are no candidates, nor are pairs whose
   bit maps already differ in more places than similar sets may (a bound, so no pair is lost by it).
3. Of the candidates of a task only a spanning forest of the likeliest pairs is put out and verified, so a group of n near copies costs
   n checks, not n squared. Verified links are joined to components.
4. Candidates whose ends are still in different components are then put out too, each in the first band where it meets, and
   verified. So every candidate pair is either verified or lies within a component: components are those of all links found.

Chance to miss a pair at the threshold: (1 - 0.85^6)^42, about 2e-9; at a threshold of 0.8 about 3e-6. Links are confirmed on full sets of 64-bit shingle hashes.

Null or empty texts and texts without words have an empty set and link with nothing. A row without doc_id comes out unlinked, component null,
kept. Rows that repeat a doc_id are one document as far as links go. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import Hashes, lists_of, map_groups, map_rows, mixed, shingles, stored, table, words
from docfields.llm.graph import components

REGISTERS, ROWS, BASE, RATE, LAST, BLOCK, SIGMAS = 256, 6, 1.05, 20.0, 1000, 1024, 5.0
BANDS = REGISTERS // ROWS
#: Link if numerator * union <= 100 * intersection; this is the numerator unless near_duplicates is given another one.
NUMERATOR = 85
#: Bits of the map of a set that goes with its sketch.
MAP_BITS = 4096
FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(h: np.ndarray) -> np.ndarray:
    """Sketch (uint16) of a non-empty set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        np.minimum(least, np.multiply.outer(FACTORS, h[at : at + 2048]).min(1), out=least)
    x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LAST).astype(np.uint16)


def bit_map(h: np.ndarray) -> np.ndarray:
    """One bit for each of MAP_BITS ranges of hashes that the set has an element in. Bits in which two maps differ are
    elements in which the sets differ, so their number is a lower bound of the sets' difference."""
    bits = np.zeros(MAP_BITS, bool)
    bits[(h >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits)


def likeliest(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity with the largest joint likelihood. `more`: registers larger on side a, and so on; sizes are known."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a + 1e-12) + less * np.log(b + 1e-12) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    # concave in j: narrow the range by thirds
    for _ in range(22):
        third = (high - low) / 3
        left, right = low + third, high - third
        up = fit(left) < fit(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def least_estimate(numerator: int) -> float:
    return numerator / 100 - SIGMAS * np.sqrt(numerator / 100 * (1 - numerator / 100) / REGISTERS)


def set_key(h: np.ndarray) -> tuple[int, int]:
    a = xxhash.xxh3_128_intdigest(h.tobytes())
    return (a >> 64) - 2**63, (a & (2**64 - 1)) - 2**63


def _sketched(rows: dict) -> dict:
    memo = Hashes()
    out = {k: [] for k in ("doc_id", "n", "key_a", "key_b", "sketch")}
    for doc, text in zip(rows["doc_id"], rows["text"]):
        h = shingles(memo.of(words(text)))
        a, b = set_key(h)
        for k, v in zip(out, (doc, len(h), a, b, registers(h).tobytes() + bit_map(h).tobytes() if len(h) else None)):
            out[k].append(v)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), key_a, key_b (digest of the set), sketch (null if the set is empty)."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(read, _sketched, "doc_id long, n long, key_a long, key_b long, sketch binary")


def _banded(rows: dict) -> dict:
    out = {k: [] for k in ("band", "bucket", "rep", "n", "sketch")}
    for rep, n, sketch in zip(rows["rep"], rows["n"], rows["sketch"]):
        for band in range(BANDS):
            part = sketch[band * ROWS * 2 : (band + 1) * ROWS * 2]
            for k, v in zip(out, (band, xxhash.xxh3_64_intdigest(part) >> 1, rep, n, None)):
                out[k].append(v)
    return out


def _spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of a spanning forest of largest weight among the edges (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    order = np.argsort(-weight, kind="stable")
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    head, chosen = np.arange(len(nodes)), set()
    while True:
        live = np.flatnonzero(head[i] != head[j])
        if not len(live):
            return np.array(sorted(chosen), np.int64)
        best = np.full(len(nodes), len(a), np.int64)
        np.minimum.at(best, head[i[live]], rank[live])
        np.minimum.at(best, head[j[live]], rank[live])
        picked = order[np.unique(best[best < len(a)])]
        chosen.update(picked.tolist())
        # ranks are distinct, so picked edges form no ring; smaller heads win until nothing moves
        while True:
            low = head.copy()
            np.minimum.at(low, head[i[picked]], head[j[picked]])
            np.minimum.at(low, head[j[picked]], head[i[picked]])
            new = low[head]
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, head):
                break
            head = new


def _candidates(forest: bool, numerator: int):
    least = least_estimate(numerator)

    def work(rows: pa.RecordBatch) -> dict | None:
        col = dict(zip(rows.schema.names, rows.columns))
        n, one = rows.num_rows, col["i"][0].as_py() == col["j"][0].as_py()
        rep, size, comp = (col[c].to_numpy() for c in ("rep", "n", "component"))
        cut = n if one else int(np.searchsorted(col["side"].to_numpy(), 1))
        if n < 2 or cut == 0 or (cut == n and not one) or comp.min() == comp.max():
            return None
        held = np.frombuffer(b"".join(col["sketch"].to_pylist()), np.uint8).reshape(n, -1)
        k, bits = held[:, : 2 * REGISTERS].view(np.uint16), held[:, 2 * REGISTERS :].view(np.uint64)
        band = col["band"][0].as_py()
        right = slice(0, n) if one else slice(cut, n)
        found: list[tuple] = []
        for at in range(0, cut, 128):
            left = slice(at, min(at + 128, cut))
            a, b = np.nonzero(
                (np.minimum(size[left, None], size[None, right]) * 100 >= numerator * np.maximum(size[left, None], size[None, right]))
                & (comp[left, None] != comp[None, right])
            )
            a, b = a + at, b + right.start
            if one:
                a, b = a[a < b], b[a < b]
            for from_ in range(0, len(a), 20_000):
                x, y = a[from_ : from_ + 20_000], b[from_ : from_ + 20_000]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                fit = (100 + numerator) * apart <= (100 - numerator) * (size[x] + size[y])
                x, y = x[fit], y[fit]
                if not len(x):
                    continue
                more, less = (k[x] > k[y]).sum(1), (k[x] < k[y]).sum(1)
                est = likeliest(more, less, REGISTERS - more - less, size[x].astype(float), size[y].astype(float))
                good = est >= least
                x, y, est = x[good], y[good], est[good]
                if not forest and band:
                    met = (k[x, : band * ROWS] == k[y, : band * ROWS]).reshape(len(x), band, ROWS).all(2).any(1)
                    x, y, est = x[~met], y[~met], est[~met]
                found.append((x, y, est))
        if not found:
            return None
        a, b, est = (np.concatenate([f[c] for f in found]) for c in range(3))
        if forest and len(a):
            keep = _spanning(a, b, est)
            a, b = a[keep], b[keep]
        return {"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])} if len(a) else None

    return work


def candidates(members: DataFrame, forest: bool, block: int = BLOCK, numerator: int = NUMERATOR) -> DataFrame:
    """a, b: pairs of classes to verify. `members`: band, bucket, rep, component, n, sketch."""
    where = ["band", "bucket"]
    many = members.groupBy(*where).agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select(*where, F.ceil(F.col("size") / block).alias("cuts"))
    placed = (
        members.join(many, where).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("cuts")))
        .withColumn("other", F.explode(F.expr("sequence(0L, cuts - 1)")))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .select(*where, "i", "j", "side", "rep", "component", "n", "sketch")
    )
    return stored(map_groups(placed, [*where, "i", "j"], ["side", "rep"], _candidates(forest, numerator), "a long, b long").distinct(), "sketch-pairs")


def _set_rows(rows: dict) -> dict:
    memo = Hashes()
    return {"rep": rows["rep"], "hashes": [shingles(memo.of(words(t))).tobytes() for t in rows["text"]]}


def _confirmed(numerator: int):
    def work(rows: dict) -> dict:
        linked = []
        for x, y in zip(rows["x"], rows["y"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= numerator * (len(x) + len(y) - both))
        return {"a": rows["a"], "b": rows["b"], "linked": linked}

    return work


def verified(pairs: DataFrame, sets: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stored(map_rows(both, _confirmed(numerator), "a long, b long, linked boolean", 128).filter("linked").select("a", "b").distinct(), "sketch-links")


def near_duplicates(docs: DataFrame, numerator: int = NUMERATOR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`; links are similarities of numerator / 100 and more."""
    bound = {} if numerator == NUMERATOR else {"numerator": numerator}
    all_rows = stored(sketches(docs), "sketches")
    full = all_rows.filter("doc_id IS NOT NULL AND sketch IS NOT NULL")
    classes = full.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "sketch-classes")
    by_band = map_rows(classes.select("rep", "n", "sketch"), _banded, "band int, bucket long, rep long, n long, sketch binary").select("band", "bucket", "rep")
    # buckets of one class can be left out: they hold no pair
    shared = by_band.groupBy("band", "bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("band", "bucket")
    lies = stored(by_band.join(shared, ["band", "bucket"]), "sketch-bands")
    of_class = classes.select("rep", "n", "sketch")
    first = candidates(lies.join(of_class, "rep").withColumn("component", F.col("rep")), True, **bound)
    # each class with a candidate is an end of a forest edge somewhere, so these are all sets that are ever looked at
    ends = first.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ends, "rep", "left_semi")
    sets = stored(map_rows(texts, _set_rows, "rep long, hashes binary"), "sketch-sets")
    links = verified(first, sets, **bound)
    heads = components(links, "sketch-components")
    again = lies.join(ends, "rep", "left_semi").join(of_class, "rep").join(heads.withColumnRenamed("id", "rep"), "rep", "left")
    rest = candidates(again.withColumn("component", F.coalesce("component", "rep")), False, **bound)
    more = verified(rest.join(first, ["a", "b"], "left_anti"), sets, **bound)
    final = components(links.unionByName(more), "sketch-components") if not more.isEmpty() else heads
    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key_a", "key_b", F.col("rep"), F.coalesce("component", "rep").alias("component")
    )
    # a repeated doc_id may stand in two classes; its smallest component counts
    out = all_rows.join(named, ["key_a", "key_b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
