"""Lookups against dictionary tables of any size.

`lookups` serves the fixed value lists as columns; here a dictionary is a table, up to millions of entries. Nothing compares every value
with every entry: each lookup derives keys from both sides, meets them in an equi-join and tests only what met. A dictionary is
broadcast only after its size was checked. Distinct values are looked up once, so a frequent value is not looked up again and again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docfields.functions import patterns as P
from docfields.functions.text import let

#: Entries up to which a dictionary is broadcast.
BROADCAST_ROWS = 100_000
#: Rows per partition that a key may hold before it is salted, as a share of an even partition, and heavy keys that are tracked.
HEAVY, TRACKED = 0.5, 1000


def checked(dictionary: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The dictionary, marked for broadcast if it has at most `most` rows, and whether it is. Counting stops beyond that number."""
    small = dictionary.limit(most + 1).count() <= most
    return (F.broadcast(dictionary) if small else dictionary), small


# ---------------------------------------------------------------- equal keys
def heavy_keys(df: DataFrame, key: str, partitions: int) -> list:
    """Values of `key` that hold more rows than HEAVY of an even partition, from a sketch of bounded size (no key above that share is
    missed while the sketch tracks ten times as many values as can be above it)."""
    tracked = max(TRACKED, 20 * partitions)
    top = df.select(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {tracked // 10}, {tracked})").alias("top")).head()
    return [r.item for r in top.top or [] if r.item is not None and r["count"] * partitions > HEAVY * top.n]


def lookup(df: DataFrame, key: str, dictionary: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows with the columns of their dictionary row (unique `key`), NULL when unknown, whatever the size of either.

    A small dictionary is broadcast. With a large one both sides are shuffled by key; a key that holds many rows is dealt to many
    partitions by a salt, to each of which its dictionary row is copied.
    """
    entries, small = checked(dictionary, most)
    if small:
        return df.join(entries, key, "left")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(df, key, partitions)
    if not heavy:
        return df.join(entries, key, "left")
    is_heavy = F.col(key).isin(heavy)
    # the row number within its task, as any other even deal would do
    salted = df.withColumn("__salt", F.when(is_heavy, F.pmod(F.monotonically_increasing_id(), F.lit(partitions))).otherwise(0))
    zero = F.lit(0).cast("long")
    copies = F.when(is_heavy, F.sequence(zero, F.lit(partitions - 1).cast("long"))).otherwise(F.array(zero))
    dealt = entries.withColumn("__salt", F.explode(copies))
    return salted.join(dealt, [key, "__salt"], "left").drop("__salt")


def known(df: DataFrame, key: str, dictionary: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows whose `key` the dictionary has, by the same choice of joins."""
    marked = dictionary.select(key).distinct().withColumn("__known", F.lit(True))
    return lookup(df, key, marked, most).filter("__known").drop("__known")


# ---------------------------------------------------------------- one edit apart
def _forms(c: Column) -> Column:
    """Hashes of a text and of all its forms with one letter left out. Two texts at most one edit apart share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(F.concat(F.left(c, i - 1), F.substring(c, i + 1, F.length(c)))))
    return F.when(F.length(c) > 0, F.concat(cut, F.array(F.xxhash64(c)))).otherwise(F.array(F.xxhash64(c)))


def lookup_near(df: DataFrame, column: str, dictionary: DataFrame, entry: str = "entry", least: int = 5) -> DataFrame:
    """`df` with `near`: the longest entry of `least` letters or more that is at most one edit away from `column`, the alphabetically first
    of equally long ones; NULL when there is none.

    Entries and distinct values meet in their forms with one letter left out; the distance is computed only for pairs that met.
    """
    entries = dictionary.select(F.col(entry).alias("near")).filter(F.length("near") >= least).distinct()
    longest = entries.agg(F.max(F.length("near"))).head()[0]
    values = df.select(F.col(column).alias("value")).filter(F.length("value").between(least - 1, (longest or 0) + 1)).distinct()
    form = lambda c: F.explode(F.array_distinct(_forms(c))).alias("form")
    met = values.select("value", form(F.col("value"))).join(entries.select("near", form(F.col("near"))), "form")
    close = met.filter(F.levenshtein("value", "near", 1) >= 0)
    best = close.groupBy("value").agg(F.min(F.struct((-F.length("near")).alias("n"), "near"))["near"].alias("near"))
    return df.join(best.withColumnRenamed("value", column), column, "left")


# ---------------------------------------------------------------- containment
def word_runs(c: Column, most: int, letters: str = P.GEO) -> Column:
    """Distinct runs of 1 to `most` neighbouring words of a text, as they stand there; a word is a maximal run of `letters`."""
    words = F.regexp_extract_all(c, F.lit(f"[{letters}]+"), F.lit(0))
    # between[i] stands before word i
    pair = F.struct(words.alias("words"), F.split(c, f"[{letters}]+").alias("between"))

    def runs(p: Column) -> Column:
        n = F.size(p["words"])

        def from_word(i: Column) -> Column:
            """The word at i, then each longer run: a running concatenation."""
            last = F.least(F.lit(most) - 1, n - 1 - i)
            longer = lambda acc, j: F.concat(
                acc, F.array(F.concat(F.element_at(acc, -1), F.get(p["between"], i + j), F.get(p["words"], i + j)))
            )
            steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, F.array(F.get(p["words"], i)), longer)

        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.flatten(F.transform(starts, from_word)))

    return F.element_at(F.transform(F.array(pair), runs), 1)


def lookup_phrases(df: DataFrame, key: str, text: str, dictionary: DataFrame, entry: str = "entry", letters: str = P.GEO) -> DataFrame:
    """`df` with `phrase`: the longest entry that stands in `text` as words of their own, entries of several words before single words, the
    alphabetically first of equally long ones; NULL when there is none. `key` tells rows apart; entries begin and end with a letter.

    Texts are taken apart into runs of words, no longer than the longest entry; these meet the entries.
    """
    spaces = F.regexp_count(F.col(entry), F.lit(f"[{letters}]+"))
    entries = dictionary.select(F.col(entry).alias("phrase"), spaces.alias("n")).filter("n > 0").distinct()
    most = entries.agg(F.max("n")).head()[0] or 1
    runs = df.select(key, F.explode(word_runs(F.col(text), most, letters)).alias("phrase"))
    order = F.struct((F.col("n") == 1).alias("single"), (-F.length("phrase")).alias("size"), "phrase")
    met = runs.join(checked(entries)[0], "phrase")
    best = met.groupBy(key).agg(F.min(order)["phrase"].alias("phrase"))
    return df.join(best, key, "left")


def _codes(letters: np.ndarray, n: int) -> np.ndarray:
    """A number for each piece of n letters, three at most; pieces of different texts are equal if their numbers are."""
    out = letters[: max(len(letters) - n + 1, 0)].copy()
    for i in range(1, n):
        out |= letters[i : i + len(out)] << np.int64(21 * i)
    return out


def _letters(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.int64) + 1


def _coded(listed: DataFrame) -> DataFrame:
    """`listed` with the numbers of its pieces in their place."""
    schema = StructType([f for f in listed.schema if f.name != "piece"] + [StructField("piece", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [_letters(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            codes = pa.array([int(_codes(p, len(p))[0]) for p in of], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=schema.names)

    return listed.select(*schema.names[:-1], F.col("piece").cast("binary")).mapInArrow(run, schema)


def _pieces(df: DataFrame, key: str, texts: dict[str, Column], sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """key, fold, piece: the distinct pieces of so many letters of each text, those among `known` if it is given."""
    schema = StructType([df.schema[key], StructField("fold", StringType()), StructField("piece", LongType())])
    folds = [*texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in folds:
                rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for row, text in enumerate(batch.column(batch.schema.get_field_index(f"__{fold}"))):
                    letters = _letters(text.as_py() or b"")
                    for n in sizes:
                        code = np.unique(_codes(letters, n))
                        if known is not None:
                            code = code[np.isin(code, known, assume_unique=True)]
                        rows.append(np.full(len(code), row))
                        codes.append(code)
                row, code = np.concatenate(rows), np.concatenate(codes)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.repeat(fold, len(row)), pa.array(code)], names=schema.names)

    return df.select(key, *[t.cast("binary").alias(f"__{fold}") for fold, t in texts.items()]).mapInArrow(run, schema)


def lookup_contained(df: DataFrame, key: str, text: str, dictionary: DataFrame, alias: str, value: str, rank: str) -> DataFrame:
    """`df` with `value` of the entry of lowest `rank` whose `alias` stands anywhere in `text`, whatever the case; NULL when there is none.
    `key` tells rows apart, `rank` entries.

    Each alias is listed under its piece of up to three letters that is rarest among the aliases; texts are taken apart into
    their pieces, of which only listed ones go on if the dictionary is small, and only aliases whose piece occurs in a text are searched
    in it, up to the first that stands there.
    """
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    # letters are bound once; a position in a list is found at once, in a text only by counting
    pieces = lambda cs, n: F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, n), ""))
    folds = {"low": F.lower, "up": F.upper}
    named = dictionary.filter(F.length(alias) > 0)
    sizes = [r[0] for r in named.select(F.least(F.length(alias), F.lit(3))).distinct().collect()]  # three numbers at most
    listed = []
    for fold, of in folds.items():
        folded = named.select(F.lit(fold).alias("fold"), F.col(rank).alias("rank"), F.col(value).alias("value"), of(F.col(alias)).alias("alias"))
        own = folded.withColumn("piece", F.explode(let(letters(F.col("alias")), lambda cs: F.array_distinct(pieces(cs, F.least(F.size(cs), F.lit(3)))))))
        rare = own.join(own.groupBy("piece").count(), "piece").groupBy(*folded.columns).agg(F.min(F.struct("count", "piece"))["piece"].alias("piece"))
        listed.append(rare)
    if not sizes:
        return df.withColumn(value, F.lit(None).cast(dictionary.schema[value].dataType))
    entries, small = checked(_coded(reduce(DataFrame.unionByName, listed)))
    known = np.array([r.piece for r in entries.select("piece").distinct().collect()], np.int64) if small else None
    met = _pieces(df, key, {fold: of(F.col(text)) for fold, of in folds.items()}, sizes, known).join(entries, ["fold", "piece"])
    # a text travels once, to all aliases that may stand in it
    may = met.groupBy(key).agg(F.collect_set(F.struct("rank", "value", "fold", "alias")).alias("__may"))
    entry = may.schema["__may"].dataType.elementType
    stands = lambda t, m: F.contains(F.when(m["fold"] == "low", t["low"]).otherwise(t["up"]), m["alias"])
    found = let(
        F.struct(*[of(F.col(text)).alias(fold) for fold, of in folds.items()]),
        # in the order of ranks; those behind the first that stands there are not searched
        lambda t: F.aggregate(
            F.array_sort("__may"), F.lit(None).cast(entry), lambda acc, m: F.coalesce(acc, F.when(stands(t, m), m))
        )["value"],
    )
    return df.join(may, key, "left").withColumn(value, found).drop("__may")
