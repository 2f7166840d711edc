"""Language of a text by a string kernel: blended-spectrum presence kernel, Nystroem landmarks, one-versus-rest ridge.

k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), G: the distinct runs of 1 to 4 characters of the lower-cased text, in which
anything but letters is one space, hashed to 2^15 places. Landmarks L give the features k(x, L) K_LL^(-1/2); a
ridge regression learns one target per language. A batch of texts is scored by two matrix products: presence
times landmarks, then times coefficients.

Training takes a bounded sample: PER_LANGUAGE rows of each language with the smallest hash of doc_id, and SAMPLE rows in all, whole
texts and two short pieces of each (pieces teach what short texts look like; predictions read whole texts). Landmarks are the first
LANDMARKS of them, languages in turn.

A text that is null or has no letter is `und` with score 0. Without any labelled row every text is `und`. Equal scores go to the
first language in code-point order. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfields.llm.common import MULTIPLIERS, crc_mod, map_rows, stored, table

BITS, LONGEST, LANDMARKS, PER_LANGUAGE, SAMPLE, RIDGE = 15, 4, 64, 400, 2000, 1e-3
SHARP = 6.0
#: Rows of language sizes that may be sent to every task; beyond that they are joined.
SENT_ROWS = 10_000


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(texts: list, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all texts one after the other, how many each has); none for a text without a letter."""
    n = len(texts)
    joined = "\n".join((t or "").lower().replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = code == 10
    doc = np.cumsum(end) - end
    letter = letters[code]
    # one space around and between letter runs: keep letters, and what follows a letter or the start of a text
    first = np.concatenate([[True], end[:-1]])
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before | first
    lead = np.where(first & letter)[0]  # a text that starts with a letter gets its space in front
    code = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    at = np.cumsum(keep) - 1
    code = np.insert(code, at[lead], 32)
    doc = np.insert(doc[keep], at[lead], doc[lead])
    seen = np.zeros(n << BITS, bool)
    run = np.zeros(len(code), np.uint64)
    for j in range(LONGEST):
        m = len(code) - j
        if m <= 0:
            break
        run = run[:m] + (code[j:] + np.uint64(1)) * MULTIPLIERS[j]
        place = (((run ^ (run >> np.uint64(29))) * MULTIPLIERS[20]) >> np.uint64(64 - BITS)).astype(np.int64)
        inside = doc[:m] == doc[j:]
        seen[((doc[:m].astype(np.int64) << BITS) | place)[inside]] = True
    has = np.bincount(doc[code != 32], minlength=n)[:n] > 0
    flat = np.flatnonzero(seen)
    whose = flat >> BITS
    use = has[whose]
    return flat[use] & ((1 << BITS) - 1), np.bincount(whose[use], minlength=n)


def kernel(places: np.ndarray, counts: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """k(x, L) of every text; `landmarks` is places x landmarks, scaled by 1 / sqrt(|G(L)|)."""
    out = np.zeros((len(counts), landmarks.shape[1]), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        out[full] = np.add.reduceat(landmarks[places], starts) / np.sqrt(counts[full])[:, None]
    return out


def marks_of(places: list[np.ndarray]) -> np.ndarray:
    """Landmark texts, given by their places, as the matrix that `kernel` takes."""
    marks = np.zeros((1 << BITS, len(places)), np.float32)
    for i, own in enumerate(places):
        marks[own, i] = 1 / np.sqrt(max(1, len(own)))
    return marks


def fit(marks: np.ndarray, own: np.ndarray, k: np.ndarray, names: list[str]) -> dict:
    """Landmarks, coefficients and languages from k(landmarks, landmarks), k(sample, landmarks) and the sample's languages."""
    langs = sorted(set(names))
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    y = np.array([[1.0 if lang == want else -1.0 for want in langs] for lang in names])
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ y)
    return {"langs": langs, "landmarks": marks, "coef": root @ w[:-1], "bias": w[-1]}


def predict(texts: list, model: dict, letters: np.ndarray) -> tuple[list[str], list[float]]:
    if not model["langs"]:
        return ["und"] * len(texts), [0.0] * len(texts)
    places, counts = presence(texts, letters)
    margin = SHARP * (kernel(places, counts, model["landmarks"]) @ model["coef"] + model["bias"])
    best = margin.argmax(1)
    share = np.exp(margin - margin.max(1, keepdims=True))
    score = 1 / share.sum(1)
    return (
        [model["langs"][b] if c else "und" for b, c in zip(best, counts)],
        [float(s) if c else 0.0 for s, c in zip(score, counts)],
    )


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> dict:
    """Fits on a bounded sample of `rows` (doc_id, text, lang)."""
    ids = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", "lang", F.xxhash64("text").alias("key"), F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("draw")
    )
    # of a language with n rows only about 3 * per_language low draws are ranked, however large n is
    sizes = stored(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    if sizes.count() <= SENT_ROWS:  # one row a language; sent to the tasks, so that the rows of a frequent one stay where they lie
        sizes = F.broadcast(sizes)
    low = ids.join(sizes, "lang").filter(F.col("draw") < F.lit(2.0**53) * (3.0 * per_language) / F.col("n"))
    by_hash = Window.partitionBy("lang").orderBy("draw", "doc_id", "key")
    chosen = (
        low.select("doc_id", "lang", "key", F.row_number().over(by_hash).alias("turn")).filter(F.col("turn") <= per_language)
        .orderBy("turn", "lang").limit(sample)
    )
    # at most `sample` rows of ids: small enough to send to every task
    keyed = rows.withColumn("key", F.xxhash64("text"))
    first = keyed.join(F.broadcast(chosen.orderBy("turn", "lang").limit(LANDMARKS)), ["doc_id", "lang", "key"])

    def listed(got: dict) -> dict:
        places, counts = presence(got["text"], letter_table())
        return {"turn": got["turn"], "lang": got["lang"], "places": np.split(places.astype(np.int32), np.cumsum(counts)[:-1])}

    found = map_rows(first.select("turn", "lang", "text"), listed, "turn int, lang string, places array<int>").collect()
    own = sorted((r.turn, r.lang, r.places) for r in found if r.places)
    if not own:
        return {"langs": []}
    marks = marks_of([np.array(r[2], np.int64) for r in own])
    sent = rows.sparkSession.sparkContext.broadcast(marks)  # 2^BITS x LANDMARKS numbers

    def compared(got: dict) -> dict:
        table, out = letter_table(), {"turn": [], "lang": [], "piece": [], "k": []}
        for turn, lang, text in zip(got["turn"], got["lang"], got["text"]):
            half = len(text) // 2
            places, counts = presence([text, text[half : half + 25], text[:60]], table)
            for piece, k in enumerate(kernel(places, counts, sent.value)):
                if counts[piece]:
                    for name, value in zip(out, (turn, lang, piece, k)):
                        out[name].append(value)
        return out

    every = keyed.join(F.broadcast(chosen), ["doc_id", "lang", "key"]).select("turn", "lang", "text")
    got = sorted(tuple(r) for r in map_rows(every, compared, "turn int, lang string, piece int, k array<double>").collect())
    alone, counts = np.concatenate([np.array(r[2], np.int64) for r in own]), np.array([len(r[2]) for r in own])
    return fit(marks, kernel(alone, counts, marks), np.array([r[3] for r in got]), [r[1] for r in got])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out (as given), lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^15 x landmarks numbers whatever the input
    cache: dict = {}

    def work(rows: dict) -> dict:
        if not cache:
            cache["letters"] = letter_table()
        names, scores = [], []
        for at in range(0, len(rows["text"]), 32):
            a, b = predict(rows["text"][at : at + 32], sent.value, cache["letters"])
            names += a
            scores += b
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": pa.array(names), "score": scores}

    return map_rows(docs, work, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return identify(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model)
