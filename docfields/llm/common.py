"""What the operators of this folder share: row batches in Python tasks, words and their hashes, tables in between."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docfields.sources.tables import shared_folder

#: Rows that a Python task turns into Python objects at once; whole texts, so memory follows the longest ones.
SLICE = 256


def map_rows(df: DataFrame, work: Callable[[dict[str, list]], dict], schema: str, size: int = SLICE) -> DataFrame:
    """`work` turns columns of up to `size` rows (name -> list) into result columns; it keeps no state between rows."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """`work` sees the rows of one group (equal non-null integer `keys`) in `order`; groups of a partition follow one another in one
    Python task, so thousands of small groups cost little. A task holds one group at a time: groups must be bounded."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def gathered(results: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([c if isinstance(c := r[f.name], pa.Array) else pa.array(c, f.type) for r in results]) for f in arrow], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys], 1)
            starts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            bounds = [0, *starts.tolist(), len(ids)]
            results = []
            if open_group and not np.array_equal(last, ids[0]):
                results.append(work(whole(open_group)))
                open_group = []
            for a, b in zip(bounds[:-2], bounds[1:-1]):
                results.append(work(whole([*open_group, batch.slice(a, b - a)])))
                open_group = []
            open_group.append(batch.slice(bounds[-2], bounds[-1] - bounds[-2]))
            last = ids[-1]
            results = [r for r in results if r is not None]
            if results:
                yield gathered(results)
        if open_group and (r := work(whole(open_group))) is not None:
            yield gathered([r])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Hashes(dict):
    """64-bit hash of each distinct word (bytes), remembered up to a bound."""

    BOUND = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at `[\\x20\\x09-\\x0D]+`: the white space of bytes.split()."""
    return text.encode("utf-8", "replace").lower().split() if text else []


#: Odd multipliers, one for each place in a run of words.
MULTIPLIERS = np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all input bits over all output bits (64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: What a byte adds to its word's key, nothing for white space, and the base of the places.
BYTES = np.array([0 if bytes([b]).isspace() else xxhash.xxh64_intdigest(bytes([b]), 7) | 1 for b in range(256)], np.uint64)
BLANK = BYTES == 0
BASE = xxhash.xxh64_intdigest(b"base") & ~7 | 5


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


class WordHashes:
    """Hashes of all words of many texts, as `Hashes` has them. A word's key is a polynomial of its bytes, found in a few passes over arrays;
    only words that are not among those met last are hashed one by one. A task makes its own tables: none are sent with the code."""

    #: Bytes that are looked at together; a met word lies in the place that so many first bits of its key name, until another takes it.
    CHUNK, PLACES = 1 << 20, 21

    def __init__(self) -> None:
        self.powers = None

    def __reduce__(self) -> tuple:
        return WordHashes, ()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word of the texts, one after the other; bounds: text i has those from bounds[i] to bounds[i + 1])."""
        if self.powers is None:
            self.powers, self.inverses = powers(BASE, self.CHUNK), powers(pow(BASE, -1, 1 << 64), self.CHUNK)
            self.keys, self.hashes = np.zeros(1 << self.PLACES, np.uint64), np.zeros(1 << self.PLACES, np.uint64)
        parts = [text.encode("utf-8", "replace").lower() if text else b"" for text in texts]
        joined = b" ".join([b"", *parts, b""])
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([1, *(len(p) + 1 for p in parts)])  # where texts begin
        edges = np.flatnonzero(np.diff(BLANK[data])) + 1
        first, end = edges[::2], edges[1::2]
        found, at = [np.zeros(0, np.uint64)], 0
        while at < len(first):
            # as many words as fit a chunk, one at least
            to = max(at + 1, int(np.searchsorted(end, first[at] + self.CHUNK, "right")))
            low, n, place = int(first[at]), int(end[to - 1] - first[at]), first[at:to] - first[at]
            power = self.powers if n <= self.CHUNK else powers(BASE, n)
            sums = np.add.reduceat(BYTES[data[low : low + n]] * power[:n], place)
            key = mixed(sums * self.inverses[place] + (end[at:to] - first[at:to]).astype(np.uint64) * MULTIPLIERS[63])
            slot = (key >> np.uint64(64 - self.PLACES)).astype(np.int64)
            h = self.hashes[slot]
            new = np.flatnonzero(self.keys[slot] != key)
            if len(new):
                key, once, which = np.unique(key[new], return_index=True, return_inverse=True)
                once = new[once]
                spans = zip(first[at + once].tolist(), end[at + once].tolist())
                hashed = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in spans), np.uint64, len(once))
                h[new] = hashed[which]
                self.keys[slot[once]], self.hashes[slot[once]] = key, hashed
            found.append(h)
            at = to
        return np.concatenate(found), np.searchsorted(first, begins)


word_hashes = WordHashes()


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * MULTIPLIERS[0]
    for j in range(1, k):
        out = out + h[j : j + n] * MULTIPLIERS[j]
    return mixed(out)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word runs; with fewer words, the whole sequence as one; without words, empty."""
    if len(h) == 0:
        return h
    return np.unique(runs_of(h, k)) if len(h) >= k else runs_of(h, len(h))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the folder that all executors share (spark.checkpoint.dir) and reads them again: cuts the
    lineage, and a lost executor costs no recomputation of earlier steps."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n
