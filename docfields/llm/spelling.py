"""Spelling variants: words one edit apart, found in a trie of letter counts, each led to its most frequent neighbour.

Letters fall into 32 groups (the low five bits of the code point). A word is the vector of its counts per group; a trie holds the vocabulary by
these counts, the most frequent group on the first level. One inserted letter is a surplus of one in one group, one replaced letter a
surplus of one and a deficit of one (or no difference, within a group). So a word finds its neighbours by a depth-first search that may spend one
surplus and one deficit. Every pair is found once, from the word that has the surplus on the first level that differs; without a
difference from the smaller word. What the search reaches is verified letter by letter.

The trie is cut into cells: a node that holds too many words or is reached by too many searches is divided into its children, level by
level, by counts summed up over the vocabulary. A word's search runs through the divided nodes where the word lies and goes on in the
cells it reaches; each cell is one group of a shuffle and holds a bounded number of words and searches. Leaves of the last level that
are still too large (anagrams by the thousand) are dealt into blocks, every search against every block. Cells only meet words and sums: a hub with very many neighbours
is summed up where its pairs are found. The limit of a cell grows with the vocabulary beyond CELLS cells, so the cut that the driver
holds and sends is bounded.

Words are counted over whole texts. Null and empty texts have none; a null doc_id counts as empty text in the digest; rows that repeat are counted each. An empty vocabulary
gives no rows. Counts of a group above 255 count as 255, which only admits more candidates. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import map_groups, map_rows, stored, table

GROUPS = 32
LEAST_LETTERS, LEAST_COUNT, DROP = 5, 3, 97
#: Words of a cell, searches that may reach it for each of them, and cells from which on cells grow with the vocabulary.
CELL_WORDS, CELL_SEARCHES, CELLS = 10_000, 16, 4000
#: Words of a trie node that are compared with all searches that reach it.
LEAF = 32
#: Searches that a task follows through a cell at once, pairs that it compares at once, and letters up to which pairs are verified in bulk.
AT_ONCE, PAIRS, WIDTH = 50_000, 200_000, 32
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


# ---------------------------------------------------------------- vocabulary
def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word, n: maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased; where `drop` divides h = crc32 of '<doc_id>:<run>', the
    run lacks its letter h % length. Tasks count first and send counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in seen], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                # one byte per code point up to 255, all others are no letters
                runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                for run, n in runs.items():
                    if len(run) < least_letters:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % drop == 0:
                        i = h % len(run)
                        run = run[:i] + run[i + 1 :]
                        if len(run) < least_letters:
                            continue
                    seen[run] += n
                if len(seen) > 200_000:
                    yield rows()
                    seen.clear()
        yield rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def vectors(words: list[bytes], order: np.ndarray) -> np.ndarray:
    """Counts per level (rows) of every word (columns)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    group = np.frombuffer(b"".join(words), np.uint8) & (GROUPS - 1)
    counts = np.bincount(np.repeat(np.arange(len(words)), lengths) * GROUPS + group, minlength=len(words) * GROUPS)
    return np.ascontiguousarray(np.minimum(counts.reshape(-1, GROUPS)[:, order], 255).astype(np.uint8).T)


# ---------------------------------------------------------------- the search
def _into(child: int, counts: np.ndarray, at: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Searches that go on into the child with `child` letters of the level's group, and what they have spent by then:
    nothing (0), the surplus (1), surplus and deficit (2)."""
    v = counts[at].astype(np.int16) - child
    stay, more, less = v == 0, (v == 1) & (spent == 0), (v == -1) & (spent == 1)
    go = stay | more | less
    return at[go], (spent + more + less)[go]


def _mutual(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter turns a into b; a is not shorter than b."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and a[i + 1 :] == b[i + (len(a) == len(b)) :]


def _letters(words: list[bytes]) -> np.ndarray:
    """The first WIDTH letters of every word as a row, zeros behind."""
    return np.array(words, f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH)


def _mutual_rows(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """`_mutual` of whole rows of letters; `longer` where a has a letter more than b, else both are of one length."""
    differs = a != b
    one = differs.sum(1) == 1
    first = differs.argmax(1)
    # behind the first difference b must go on with the letter after the one that a has more
    shifted = ((a[:, 1:] != b[:, :-1]) & (np.arange(WIDTH - 1) >= first[:, None])).any(1)
    return np.where(longer, ~shifted, one)


class Cell:
    """The part of the trie below one node: words sorted by their vectors, so that every node is a range of them."""

    def __init__(self, words: list[bytes], order: np.ndarray):
        v = vectors(words, order)
        by = np.lexsort(v[::-1])
        self.words = [words[i] for i in by]
        self.levels, self.order = np.ascontiguousarray(v[:, by]), order
        self.held, self.letters = self._mask(self.levels), _letters(self.words)
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(words))

    @staticmethod
    def _mask(levels: np.ndarray) -> np.ndarray:
        """Which groups a word has letters of, as bits."""
        return ((levels > 0) * (np.uint32(1) << np.arange(GROUPS, dtype=np.uint32))[:, None]).sum(0, dtype=np.uint32)

    def near(self, asked: list[bytes]) -> list[tuple[int, int]]:
        """(index into `asked`, index into self.words) of the pairs that are found from the asked word's side."""
        found: list[tuple[int, int]] = []
        v, letters = vectors(asked, self.order), _letters(asked)
        mask, lengths = self._mask(v), np.fromiter(map(len, asked), np.int64, len(asked))

        def leaf(lo: int, hi: int, at: np.ndarray) -> None:
            # a letter more, or one more and one less, changes two groups at most
            near = np.bitwise_count(mask[at][:, None] ^ self.held[lo:hi]) <= 2
            near &= np.abs(lengths[at][:, None] - self.lengths[lo:hi] - 0.5) < 1
            q, w = np.nonzero(near)
            q, w = at[q], w + lo
            longer = lengths[q] > self.lengths[w]
            ok = _mutual_rows(letters[q], self.letters[w], longer)
            for i in np.flatnonzero(np.maximum(lengths[q], self.lengths[w]) >= WIDTH):
                ok[i] = _mutual(asked[q[i]], self.words[w[i]])
            q, w, longer = q[ok], w[ok], longer[ok]
            # the longer word asks; of equally long ones that with the surplus on the first level that differs, else the smaller one
            step = v[:, q].astype(np.int16) - self.levels[:, w]
            first = step[np.abs(step).argmax(0), np.arange(len(q))]
            for i in range(len(q)):
                a, b = int(q[i]), int(w[i])
                if longer[i] or first[i] > 0 or (first[i] == 0 and asked[a] < self.words[b]):
                    found.append((a, b))

        def descend(level: int, lo: int, hi: int, at: np.ndarray, spent: np.ndarray) -> None:
            while level < GROUPS and hi - lo > LEAF:
                held = self.levels[level, lo:hi]
                if held[0] != held[-1]:
                    break
                at, spent = _into(int(held[0]), v[level], at, spent)
                if len(at) == 0:
                    return
                level += 1
            if hi - lo <= LEAF or level == GROUPS:
                for i in range(0, len(at), max(1, PAIRS // (hi - lo))):
                    leaf(lo, hi, at[i : i + max(1, PAIRS // (hi - lo))])
                return
            cuts = np.flatnonzero(held[1:] != held[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(held)]):
                go, by_then = _into(int(held[a]), v[level], at, spent)
                if len(go):
                    descend(level + 1, lo + a, lo + b, go, by_then)

        if self.words and asked:
            descend(0, 0, len(self.words), np.arange(len(asked)), np.zeros(len(asked), np.int64))
        return found


# ---------------------------------------------------------------- cells
class Cut:
    """The divided nodes of the trie: path (bytes of counts) -> counts of its children, with the blocks of words and searches of each."""

    def __init__(self, order: np.ndarray):
        self.order = order
        self.divided: dict[bytes, dict[int, tuple[int, int]]] = {}

    def places(self, v: np.ndarray, search: bool) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """(path, columns of v, what they have spent) of the undivided nodes that words lie in or, with `search`, that their searches reach."""

        def go(path: bytes, at: np.ndarray, spent: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
            children = self.divided.get(path)
            if children is None:
                yield path, at, spent
                return
            counts = v[len(path)]
            for c in children if search else np.unique(counts[at]).tolist():
                on, by_then = _into(c, counts, at, spent) if search else (at[counts[at] == c], spent[counts[at] == c])
                if len(on):
                    yield from go(path + bytes([c]), on, by_then)

        yield from go(b"", np.arange(v.shape[1]), np.zeros(v.shape[1], np.int64))


def _group_sums(vocabulary: DataFrame) -> np.ndarray:
    """Letters per group."""

    def work(rows: dict[str, list]) -> dict:
        v = vectors([w.encode("latin-1") for w in rows["word"]], np.arange(GROUPS)).sum(1, dtype=np.int64)
        return {"letter": np.arange(GROUPS), "n": v}

    sums = np.zeros(GROUPS, np.int64)
    for r in map_rows(vocabulary.select("word"), work, "letter int, n long", 10_000).groupBy("letter").agg(F.sum("n").alias("n")).collect():
        sums[r.letter] = r.n
    return sums


def cut_trie(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> Cut:
    """Divides nodes until all cells are within the limits. A pass per level; what reaches the driver are the children of the divided nodes."""
    total = vocabulary.count()
    limit = max(cell_words, -(-total // CELLS))
    searches = CELL_SEARCHES * limit
    cut = Cut(np.argsort(-_group_sums(vocabulary), kind="stable"))
    fresh = {b""} if total > limit else set()
    for level in range(GROUPS):
        if not fresh:
            break
        known = cut

        def work(rows: dict[str, list]) -> dict:
            v = vectors([w.encode("latin-1") for w in rows["word"]], known.order)
            counts: dict[tuple[bytes, int], list[int]] = {}
            for search in (False, True):
                for path, at, spent in known.places(v, search):
                    if path not in fresh:
                        continue
                    here = v[level, at].astype(np.int16)
                    # a search goes on with as many letters, with one less for the surplus, with one more for the deficit
                    for child in np.unique(np.concatenate([here, here - 1, here + 1]) if search else here).tolist():
                        n = len(_into(child, v[level], at, spent)[0]) if search else int((here == child).sum())
                        if n and 0 <= child <= 255:
                            counts.setdefault((path, child), [0, 0])[search] += n
            path, child = zip(*counts) if counts else ((), ())
            words, asks = zip(*counts.values()) if counts else ((), ())
            return {"path": pa.array(path, pa.binary()), "child": pa.array(child, pa.int32()), "words": pa.array(words, pa.int64()), "asks": pa.array(asks, pa.int64())}

        sums = map_rows(vocabulary.select("word"), work, "path binary, child int, words long, asks long", 10_000).groupBy("path", "child")
        nodes = sums.agg(F.sum("words").alias("words"), F.sum("asks").alias("asks")).filter("words > 0").collect()
        wide = set()
        cut = Cut(cut.order)
        cut.divided = dict(known.divided)
        for r in nodes:
            path = bytes(r.path)
            large = r.words > limit or r.asks > searches
            last = level == GROUPS - 1
            blocks = (-(-r.words // limit), -(-r.asks // searches)) if last and large else (1, 1)
            cut.divided.setdefault(path, {})[r.child] = blocks
            if large and not last:
                wide.add(path + bytes([r.child]))
        fresh = wide
        # a node is divided once its children are known, so the next pass starts from the leaves of this cut
    return cut


def _dealt(cut: Cut):
    """Rows of words to rows by cell: the word itself (held) and its searches."""

    def work(rows: dict[str, list]) -> dict:
        words = [w.encode("latin-1") for w in rows["word"]]
        v = vectors(words, cut.order)
        mark = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words))
        cells, at, held = [], [], []
        for search in (False, True):
            for path, on, _ in cut.places(v, search):
                word_blocks, search_blocks = cut.divided[path[:-1]][path[-1]] if path else (1, 1)
                # a word lies in one block of words and meets all blocks of searches; a search the other way round
                own, all_of = (search_blocks, word_blocks) if search else (word_blocks, search_blocks)
                for other in range(all_of):
                    mine = mark[on] % own
                    for block in np.unique(mine).tolist():
                        here = on[mine == block]
                        name = (other, block) if search else (block, other)
                        cells.append(np.full(len(here), xxhash.xxh3_64_intdigest(path + b"|%d|%d" % name) - 2**63, np.int64))
                        at.append(here)
                        held.append(np.full(len(here), not search))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        return {
            "cell": pa.array(np.concatenate(cells) if cells else at), "held": pa.array(np.concatenate(held) if held else at.astype(bool)),
            "word": pa.array([rows["word"][i] for i in at], pa.string()), "n": pa.array([rows["n"][i] for i in at], pa.int64()),
        }

    return work


def _met(order: np.ndarray):
    """Rows of one cell to partial results per word: near words and the most frequent of them."""

    def work(cell: pa.RecordBatch) -> dict | None:
        held = cell.column(1).to_numpy(zero_copy_only=False)
        words = [w.encode("latin-1") for w in cell.column(2).to_pylist()]
        n = cell.column(3).to_numpy()
        if held.all() or not held.any():
            return None
        split = int(held.sum())  # held rows come first
        trie = Cell(words[:split], order)
        counts = dict(zip(words, n.tolist()))
        best: dict[bytes, list] = {}
        for start in range(split, len(words), AT_ONCE):
            asked = words[start : start + AT_ONCE]
            for i, j in trie.near(asked):
                for a, b in ((asked[i], trie.words[j]), (trie.words[j], asked[i])):
                    key = (-counts[b], b)
                    seen = best.get(a)
                    if seen is None:
                        best[a] = [1, key]
                    else:
                        seen[0] += 1
                        if key < seen[1]:
                            seen[1] = key
        if not best:
            return None
        return {
            "word": [w.decode("latin-1") for w in best], "n_near": [s[0] for s in best.values()],
            "less": [s[1][0] for s in best.values()], "by": [s[1][1].decode("latin-1") for s in best.values()],
        }

    return work


def near_words(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, n_near, near, near_n: how many words of a stored vocabulary (word, n; words distinct) are one edit away, and the most frequent of
    them, ties to the smaller one. Words without near words have no row."""
    cut = cut_trie(vocabulary, cell_words)
    dealt = map_rows(vocabulary.select("word", "n"), _dealt(cut), "cell long, held boolean, word string, n long", 10_000)
    dealt = dealt.withColumn("asks", ~F.col("held")).select("cell", "held", "word", "n", "asks")
    parts = map_groups(dealt, ["cell"], ["asks"], _met(cut.order), "word string, n_near long, less long, by string")
    whole = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "by")).alias("m"))
    return whole.select("word", "n_near", F.col("m.by").alias("near"), (-F.col("m.less")).alias("near_n"))


def variants(docs: DataFrame, cell_words: int = CELL_WORDS, factor: int = 2, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts. The form of a word is its most frequent near word if that is
    `factor` times as frequent (2 at least: then forms never run in a circle); the root is the end of the chain of forms."""
    vocabulary = stored(count_words(docs, **counting), "spelling-words")
    near = near_words(vocabulary, cell_words)
    rows = vocabulary.join(near, "word", "left").withColumn("led", F.col("near_n") >= factor * F.col("n"))
    rows = stored(
        rows.select(
            "word", F.when(F.col("led"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("led"), F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # every pass halves the ways to the roots; a way has no more steps than n can double
    roots = stored(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "spelling-roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return rows.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The same in DuckDB: near words by equal patterns with one letter left open, and by equal words with one letter left out.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id || ':' || run AS named, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(strlen(named)),
    lambda i: ('0x' || substr(hex(encode(named)), 2 * i::INT + 1, 2))::BIGINT), lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8))) AS h
  FROM counted, crc_table),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT) AS head, substr(word, i::INT + 2) AS tail FROM words, unnest(range(length(word))) u(i)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.head || c.tail = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.head || c.tail = w.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chains c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
