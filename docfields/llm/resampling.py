"""Importance resampling towards a target distribution: hashed word runs score documents, the best scores with Gumbel noise are drawn.

Words are the runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII. Features are all runs of `least` to `most` words, repeats
counted; each falls into a bucket (crc32 of its bytes). A bucket's gain is the logarithm of its share of the target's features over its share
of the documents' features, one added to each bucket, in thousandths. The gains are an array of fixed size that travels with the tasks; a
document's weight is the sum of the gains of its features. Its score adds Gumbel noise from a digest of seed and doc_id, so the highest
scores are a sample without replacement in proportion to exp(weight / 1000), and reruns agree.

The cutoff of the draw is found without a sort, by weighted medians of medians: every partition gives the median of its keys that are
still in question and their number; the weighted median of these parts the keys so that a quarter of them at least lies on either side.
Counting both sides tells which one holds the cutoff; the other is discarded. That repeats until so few keys are left (FINISH) that
they are sorted as they are. A round is one pass over the remaining keys, written anew whenever three quarters are gone; only one row per
partition and round reaches the driver. Winners are then sorted by ranges of the key and numbered range by range.

Null and empty texts have no features, weight 0. Rows with equal doc_id are rows of their own, each drawn or not; they share their noise. A
null doc_id counts as empty text in the digest and as the largest id in ties; ties that remain go to the smaller number of features, and rows
that agree in that as well can't be told apart in the result. Without target texts all their buckets count as empty; an empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.llm.common import map_rows, stored, table

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, "2024", 20, 10
#: Keys that are sorted on the driver once no more are in question, and winners in one sorted range, about.
FINISH, RANGE_ROWS = 4096, 50_000
#: Order of the draw: highest score, then smallest id, then fewest features; the row number tells equal rows apart.
KEY = ["loss", "id", "n_features", "row"]
LAST = 2**63 - 1
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Buckets(dict):
    """Bucket of each distinct word, remembered up to a bound."""

    BOUND = 200_000

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        b = self[word] = zlib.crc32(word) % self.n
        return b

    def of(self, words: list[bytes], least: int, most: int) -> np.ndarray:
        """Bucket of every run of `least` to `most` words."""
        parts = []
        for k in range(least, most + 1):
            n = max(0, len(words) - k + 1)
            if k == 1:
                parts.append(np.fromiter(map(self.__getitem__, words), np.int64, n))
            else:
                parts.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) % self.n for i in range(n)), np.int64, n))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def words(text: bytes | None) -> list[bytes]:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] in UTF-8 text, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split() if text else []


def feature_counts(texts: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of `text`; tasks sum up first, so only bucket sums are shuffled and collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(known.of(words(text.as_py()), least, most), minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    sums = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, per bucket, rounded down."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    """Thousandths of standard Gumbel noise from the first 32 bits of a digest, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and the key of the draw, one row per document."""

    def work(rows: dict[str, list]) -> dict:
        known = Buckets(len(gain))
        out = {c: [] for c in ("n_words", "n_features", "weight", "score", "loss", "id")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            w = words(text)
            b = known.of(w, least, most)
            weight = int(gain[b].sum())
            score = weight + noise(doc_id, seed)
            for c, v in zip(out, (len(w), len(b), weight, score, -score, LAST if doc_id is None else doc_id)):
                out[c].append(v)
        return {"doc_id": pa.array(rows["doc_id"], pa.int64()), **out}

    schema = "doc_id long, n_words long, n_features long, weight long, score long, loss long, id long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stored(map_rows(rows, work, schema, 4096).withColumn("row", F.monotonically_increasing_id()), "resampling-scores")


# ---------------------------------------------------------------- selection
def _kth(columns: list[np.ndarray], k: int) -> tuple[int, ...]:
    """The key of rank k (from 0) in the order of the columns."""
    key, rows = [], np.arange(len(columns[0]))
    for c in columns:
        c = c[rows]
        v = int(np.partition(c, k)[k])
        key.append(v)
        k -= int((c < v).sum())
        rows = rows[c == v]
    return tuple(key)


def _below(columns: list[np.ndarray], key: tuple[int, ...]) -> np.ndarray:
    less, same = np.zeros(len(columns[0]), bool), np.ones(len(columns[0]), bool)
    for c, v in zip(columns, key):
        less |= same & (c < v)
        same &= c == v
    return less


def _halves(keys: DataFrame, key: tuple[int, ...] | None) -> list:
    """Number and median of the keys below `key` and of the others, one row per partition that has keys."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(len(KEY))] for b in batches if b.num_rows]
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*parts)]
        below = _below(columns, key) if key else np.zeros(len(columns[0]), bool)
        out = []
        for side in (below, ~below):
            n = int(side.sum())
            out += [pa.array([n]), pa.array([_kth([c[side] for c in columns], (n - 1) // 2) if n else None], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, names=["n_below", "below", "n_rest", "rest"])

    return keys.select(*KEY).mapInArrow(halves, "n_below long, below array<long>, n_rest long, rest array<long>").collect()


def _weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def _key_column(key: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key)])


def cutoff(keys: DataFrame, k: int, finish: int = FINISH) -> tuple[int, ...]:
    """The key of rank k (from 1) of a stored table of distinct keys that has so many rows at least."""
    key_of = F.struct(*KEY)
    first = _halves(keys, None)
    left = written = sum(r.n_rest for r in first)
    medians = [(tuple(r.rest), r.n_rest) for r in first]
    while left > finish:
        middle = _weighted_median(medians)
        sides = _halves(keys, middle)
        n_below = sum(r.n_below for r in sides)
        if k <= n_below:
            keys, left = keys.filter((F.col("loss") <= middle[0]) & (key_of < _key_column(middle))), n_below
            medians = [(tuple(r.below), r.n_below) for r in sides if r.n_below]
        else:
            keys, left, k = keys.filter((F.col("loss") >= middle[0]) & (key_of >= _key_column(middle))), left - n_below, k - n_below
            medians = [(tuple(r.rest), r.n_rest) for r in sides if r.n_rest]
        if 4 * left <= written:
            keys, written = stored(keys.select(*KEY), "resampling-keys"), left
    return sorted(tuple(r) for r in keys.select(*KEY).collect())[k - 1]


def ranked(winners: DataFrame, n: int) -> DataFrame:
    """Rows with their rank (from 1) in the order of KEY: sorted by ranges, numbered by the sizes of the ranges before."""
    ranges = winners.repartitionByRange(1 + n // RANGE_ROWS, *KEY).sortWithinPartitions(*KEY)
    placed = stored(ranges.withColumn("at", F.monotonically_increasing_id()), "resampling-winners")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    starts = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    known = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return known.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(2**33 - 1) + 1).drop("part", "before", "at")


def resample(
    docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: str = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn. `percent` of the documents with
    `least_words` words or more are drawn, rounded down. `target` needs a column text."""
    gain = gains(feature_counts(docs, least, most, buckets), feature_counts(target, least, most, buckets))
    rows = scored(docs, gain, least, most, seed)
    may = F.col("n_words") >= least_words
    k = percent * rows.filter(may).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = may & (F.struct(*KEY) <= _key_column(cutoff(rows.filter(may), k)))
    winners = ranked(rows.filter(drawn), k).select(*columns, "rank")
    return rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(winners)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same draw in DuckDB. crc32 is a fold over the bytes of each distinct word with the usual table.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(i))),
split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS r FROM documents),
aims AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
owned AS (SELECT r, unnest(words) AS w FROM split),
bytes AS (
  SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT) AS b
  FROM (SELECT w FROM owned UNION SELECT w FROM aims)),
hashed AS (
  SELECT w, xor(4294967295, list_reduce([4294967295::BIGINT] || b, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) % 10000 AS bucket
  FROM bytes, crc_table),
s AS (SELECT bucket, count(*) AS s FROM owned JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM owned) + 10000))::DOUBLE
    / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM aims) + 10000))::DOUBLE))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM owned JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(len(words), 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
      + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM split LEFT JOIN weighed USING (r)),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN placed USING (r)
"""
