"""Toxicity by a factorization machine over hashed terms: score(x) = sigmoid(b + sum w_j + sum_{i<j} <v_i, v_j>).

Terms are the letter runs of the text, lower-cased, and their beginnings, hashed to 2^18 places; a text counts each once. Training takes a bounded
sample of the labelled rows (SAMPLE rows at most, those with the smallest hash of doc_id), whatever the input's size.
Linear weights are learnt first with an L1 proximal step, so that terms of ordinary prose stay at zero; pair vectors are
then learnt for the terms that hold a weight. The model is a few thousand numbers, sent with the tasks; every text is
scored whole in one narrow pass.

Null and empty texts get the score of a text without terms. Rows without a label, or with a label other than 0 and 1, teach
nothing; with fewer than two classes in the sample the score is the share of the one class seen, 0 without any.
Labels with a repeated doc_id teach once each. Other columns of either table are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import Hashes, crc_mod, map_rows, table

BITS, FACTORS, SAMPLE, LEAST_DF, THRESHOLD = 18, 4, 8000, 3, 0.3
#: Lengths of word beginnings that are terms as well.
STEMS = (3, 4, 5, 6, 7)
CLEAN = 3.0
TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None, memo: Hashes) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text."""
    if not text:
        return np.zeros(0, np.int32)
    found = {x for w in set(TERM.findall(text.lower())) for x in forms(w)}
    return np.unique(memo.of(list(found)) >> np.uint64(64 - BITS)).astype(np.int32)


def forms(word: str) -> list[bytes]:
    """The word and its beginnings, which words of one stem share."""
    return [(word[:n] + "*").encode("utf-8", "replace") for n in STEMS if n < len(word)] + [word.encode("utf-8", "replace")]


def _term_rows(rows: dict) -> dict:
    memo = Hashes()
    return {"doc_id": rows["doc_id"], "label": rows["label"], "terms": [terms(t, memo) for t in rows["text"]]}


def _shrunk(z: np.ndarray, n: np.ndarray, rate: float, l1: float) -> np.ndarray:
    """Weights of the regularised leader. Ordinary words prove nothing by themselves, so negative weights pay more."""
    over = np.where(z > 0, np.maximum(z - CLEAN * l1, 0.0), np.minimum(z + l1, 0.0))
    return -over / ((1 + np.sqrt(n)) / rate + 0.1)


def fit(samples: list[tuple[np.ndarray, int]]) -> dict:
    """bias, kept term places, their weights and pair vectors. The order of samples decides nothing but rounding."""
    y = np.array([s[1] for s in samples], float)
    none = {"bias": -30.0, "places": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    if len(y) == 0 or y.min() == y.max():
        return none | {"bias": 30.0 if len(y) and y[0] == 1 else -30.0}
    df = np.bincount(np.concatenate([s[0] for s in samples] + [np.zeros(0, np.int32)]), minlength=1 << BITS)
    places = np.flatnonzero(df >= LEAST_DF)
    where = np.full(1 << BITS, -1, np.int64)
    where[places] = np.arange(len(places))
    x = [(i := where[s[0]])[i >= 0] for s in samples]
    rng = np.random.default_rng(7)
    # linear part: follow-the-regularised-leader, L1 keeps chance words at zero
    z, n, w = np.zeros(len(places)), np.zeros(len(places)), np.zeros(len(places))
    bias, bias_n, rate, l1 = float(np.log(y.mean() / (1 - y.mean()))), 1.0, 0.5, 2.5
    for _ in range(5):
        for i in rng.permutation(len(y)):
            j = x[i]
            zj, nj = z[j], n[j]
            wj = _shrunk(zj, nj, rate, l1)
            g = 1 / (1 + np.exp(-np.clip(bias + wj.sum(), -30, 30))) - y[i]
            z[j] = zj + g - (np.sqrt(nj + g * g) - np.sqrt(nj)) / rate * wj
            n[j] = nj + g * g
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    w = _shrunk(z, n, rate, l1)
    live = np.flatnonzero(w)
    back = np.full(len(places), -1, np.int64)
    back[live] = np.arange(len(live))
    x = [(k := back[j])[k >= 0] for j in x]
    w, v = w[live], rng.normal(0, 0.1, (len(live), FACTORS))
    gw, gv = np.ones(len(live)), np.ones((len(live), FACTORS))
    # weights and pair vectors together; vectors shrink, so that long texts don't add up many chance pairs
    for _ in range(8):
        for i in rng.permutation(len(y)):
            j = x[i]
            vj, s = v[j], v[j].sum(0)
            raw = bias + w[j].sum() + 0.5 * ((s * s).sum() - (vj * vj).sum())
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]
            dv = g * (s - vj) + 0.01 * vj
            gw[j] += g * g
            gv[j] += dv * dv
            w[j] -= 0.05 * g / np.sqrt(gw[j])
            v[j] = vj - 0.1 * dv / np.sqrt(gv[j])
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    return {"bias": bias, "places": places[live], "w": w, "v": v}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fits the machine on at most `sample` rows of `labels` (doc_id, label)."""
    chosen = (
        labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    )
    # at most `sample` rows of two numbers: small enough to send to every task
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = map_rows(rows.select("doc_id", "label", "text"), _term_rows, "doc_id long, label int, terms array<int>").toArrow()
    ids, ys = found["doc_id"].to_pylist(), found["label"].to_pylist()
    got = [np.asarray(t.values, np.int32) for t in found["terms"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], ys[i], len(got[i]), got[i].tobytes()))
    return fit([(got[i], ys[i]) for i in order])


def scorer(model: dict):
    """Function from texts to scores."""
    where = np.full(1 << BITS, -1, np.int32)
    where[model["places"]] = np.arange(len(model["places"]))
    w, v, bias = model["w"], model["v"], model["bias"]
    memo: dict[str, tuple[int, ...]] = {}
    hashes = Hashes()

    def score(texts: list) -> list[float]:
        out = []
        for text in texts:
            live = set()
            for term in set(TERM.findall(text.lower())) if text else ():
                places = memo.get(term)
                if places is None:
                    if len(memo) > Hashes.BOUND:
                        memo.clear()
                    found = (int(where[hashes[x] >> (64 - BITS)]) for x in forms(term))
                    places = memo[term] = tuple(p for p in found if p >= 0)
                if places:
                    live.update(places)
            j = np.array(sorted(live), np.int64)
            vj = v[j]
            raw = bias + w[j].sum() + 0.5 * ((vj.sum(0) ** 2).sum() - (vj * vj).sum())
            out.append(float(1 / (1 + np.exp(-np.clip(raw, -30, 30)))))
        return out

    return score



def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held (as given), score."""

    def work(rows: dict) -> dict:
        if "score" not in model_cache:
            model_cache["score"] = scorer(model)
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": model_cache["score"](rows["text"])}

    model_cache: dict = {}
    return map_rows(docs, work, "doc_id long, held_out boolean, score double")


def taught(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the rows outside the held-out fold."""
    return learn(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", F.col("toxic").alias("label")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = taught(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return score_texts(rows, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns kept."""
    cache: dict = {}

    def run(batches):
        import pyarrow as pa

        cache.setdefault("score", scorer(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = cache["score"](part.column(part.schema.get_field_index("text")).to_pylist())
                yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
