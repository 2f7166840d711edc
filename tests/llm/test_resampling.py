"""The draw towards a target distribution against SQL and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents, low
from pyspark.sql import functions as F

from docfields.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, targets, least=1, most=1, buckets=10_000, seed="2024", least_words=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of each row."""

    def features(text):
        w = WORD.findall(low(text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(least, most + 1) for i in range(len(w) - k + 1)]

    own, aim = [features(t) for _, t in rows], [features(t) for t in targets]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aim for b in f)
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out, may = [], []
    for (doc_id, _), (w, f) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        if len(w) >= least_words:
            may.append((-score, 2**63 if doc_id is None else doc_id, len(f), len(out)))
        out.append([doc_id, len(f), weight, score, None])
    for rank, key in enumerate(sorted(may)[: percent * len(may) // 100]):
        out[key[-1]][-1] = rank + 1
    return sorted(map(tuple, out), key=repr)


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "item_id long, text string")


@pytest.mark.parametrize("how", [{}, {"least": 1, "most": 3, "buckets": 50, "seed": "x", "least_words": 3, "percent": 40}, {"percent": 100}])
def test_draw_equals_brute_force(spark, how):
    words = "One two THREE vier fünf ŞEŞ 7 八 a-b c_d e\x00f g\x7fh  i \x85j".split(" ")
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(rng.choice(words, size=int(rng.integers(0, 60))))) for i in rng.permutation(300)]
    rows += [(5, rows[0][1])] * 3 + [(None, "two " * 40), (None, "two " * 40), (7001, None), (7002, ""), (7003, "...")]
    rows += [(7004, "fünf vier " * 100_000)]
    targets = ["fünf vier vier", None, "", "unknown words", "two two"]
    got = resampling.resample(documents(spark, rows).repartition(5), texts(spark, targets), **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, targets, **how)


def test_no_documents_or_no_target(spark):
    assert resampling.resample(documents(spark, []), texts(spark, ["a b"])).count() == 0
    rows = [(i, f"w{i} " * 25) for i in range(30)]
    got = resampling.resample(documents(spark, rows), texts(spark, []))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, [])


def test_cutoff_by_medians(spark):
    """Uneven partitions, an equal score for a third of the keys: the exact key, whatever its rank, though few keys are sorted."""
    rng = np.random.default_rng(2)
    loss = np.where(rng.random(5000) < 0.33, 7, rng.integers(-50, 50, 5000)).tolist()
    rows = [(v, int(rng.integers(0, 3000)), int(rng.integers(0, 2)), i) for i, v in enumerate(loss)]
    keys = spark.createDataFrame(rows, "loss long, id long, n_features long, row long").repartition(6, F.col("loss") > 0).cache()
    want = sorted(rows)
    for k in (1, 2, 2500, 3333, 4999, 5000):
        assert resampling.cutoff(keys, k, finish=16) == want[k - 1]


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)
    rows = [(i, i % 3, 1, i) for i in range(1000)]
    got = resampling.ranked(spark.createDataFrame(rows, "loss long, id long, n_features long, row long").repartition(4), 1000)
    assert sorted((r["rank"], r.loss) for r in got.collect()) == [(i + 1, i) for i in range(1000)]
