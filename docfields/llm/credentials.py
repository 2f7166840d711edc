"""Secret scans: fixed patterns, and credentials in several parts that only count when the parts stand together.

A text gives base spans (assignments, access identifiers, long hexadecimal runs) and weak candidates: other access
identifiers, mixed tokens that look like keys, and endpoints. Weak candidates are joined by interval: a candidate
is reported when a part that completes it lies within `scope` code points. An identifier needs a secret, a secret needs an
identifier, an endpoint needs both. The join is an equi-join on (document, cell of `scope` code points): complements
are first reduced to the first and last start in each cell, so a text full of parts gives no pairs of parts.

Null or empty texts have no spans. Rows with equal doc_id and text get equal results; a null doc_id is scanned like
any other, only its weak candidates stay unlinked. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.llm.common import map_rows, stored, table

SCOPE = 200
ORDER = ["assign", "access", "hex", "id", "key", "endpoint"]

_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
#: Base spans other than assignments, and weak keys, lie in such a run.
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
WEAK_ID = re.compile("(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}(?![A-Z0-9])")
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"\b(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+")


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, weak candidates) of a text, each (kind, start, end), in code points, end exclusive."""
    if not text:
        return [], []
    base, weak = [], []
    low = text.lower()
    if any(w in low for w in _WORDS):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in LONG.finditer(text):
        a, b = run.span()
        base += [("access", *m.span()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        base += [("hex", *m.span()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
        weak += [("id", *m.span()) for m in WEAK_ID.finditer(text, a, b)]
        weak += [("key", *m.span()) for m in WEAK_KEY.finditer(text, a, b)]
    if "://" in text:
        weak += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    covered = sorted((s, e) for _, s, e in base)
    free, i = [], 0
    for kind, s, e in sorted(weak, key=lambda x: x[1]):
        while i < len(covered) and covered[i][1] <= s and (i + 1 == len(covered) or covered[i + 1][0] <= s):
            i += 1
        if kind == "endpoint" or not any(a < e and s < b for a, b in covered[max(0, i - 2) : i + 3]):
            free.append((kind, s, e))
    return base, free


def _told(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER.index(x[0]), x[2])))


def _work(rows: dict) -> dict:
    out = {k: [] for k in ("doc_id", "text_key", "base", "weak")}
    for doc, text, key in zip(rows["doc_id"], rows["text"], rows["text_key"]):
        base, weak = scan(text)
        out["doc_id"].append(doc)
        out["text_key"].append(key)
        out["base"].append([{"kind": k, "start": s, "end": e} for k, s, e in base])
        out["weak"].append([{"kind": k, "start": s, "end": e} for k, s, e in weak])
    return out


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, base spans, and linked spans of every row of `docs`."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    found = stored(map_rows(read, _work, f"doc_id long, text_key long, base {SPAN}, weak {SPAN}"), "secrets")
    # weak candidates and the base spans that can complete them, once for equal rows
    some = found.filter("size(weak) > 0").dropDuplicates(["doc_id", "text_key"])
    parts = some.select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("p")).select(
        "doc_id", "text_key", "p.*", F.floor(F.col("p.start") / scope).cast("int").alias("cell"),
        F.expr("CASE WHEN p.kind IN ('access', 'id') THEN 'id' WHEN p.kind IN ('assign', 'hex', 'key') THEN 'secret' ELSE 'place' END").alias("role"),
    )
    ends = (
        parts.filter("role <> 'place'").groupBy("doc_id", "text_key", "cell", "role")
        .agg(F.min("start").alias("first"), F.max("start").alias("last"))
    )
    asking = parts.filter("kind IN ('id', 'key', 'endpoint')").withColumn(
        "cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))
    )
    near = asking.alias("a").join(ends.withColumnRenamed("role", "other").alias("b"), ["doc_id", "text_key", "cell"]).filter(
        (F.col("role") != F.col("other"))
        & F.least(F.abs(F.col("first") - F.col("start")), F.abs(F.col("last") - F.col("start"))).between(0, scope)
    )
    linked = (
        near.groupBy("doc_id", "text_key", "kind", "start", "end").agg(F.count_distinct("other").alias("n"))
        .filter("n >= CASE WHEN kind = 'endpoint' THEN 2 ELSE 1 END")
        .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    )
    return found.drop("weak").join(linked, ["doc_id", "text_key"], "left")


def _digest(rows: dict) -> dict:
    out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for doc, base, linked in zip(rows["doc_id"], rows["base"], rows["linked"]):
        base = [(x["kind"], x["start"], x["end"]) for x in base]
        out["doc_id"].append(doc)
        for kind in ORDER[:3]:
            out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
        out["base_sha256"].append(hashlib.sha256(_told(base).encode()).hexdigest())
        out["spans"].append(_told(base + [(x["kind"], x["start"], x["end"]) for x in linked or []]))
    return out


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "base", "linked")
    return map_rows(found, _digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", 2000)


def mask_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`docs` with found secrets masked in `text`, and n_chars (where there is such a column) following the text."""
    spans = (
        find_secrets(docs, scope).select("doc_id", "text_key", F.expr("concat(base, coalesce(linked, array()))").alias("spans"))
        .filter("size(spans) > 0").dropDuplicates(["doc_id", "text_key"])
        .withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    )
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    # from the last span to the first, so that earlier places stay right; overlapping spans are merged by the fold
    merged = F.expr(
        "aggregate(array_sort(transform(spans, s -> struct(s.start AS a, s.end AS b))),"
        " cast(array() as array<struct<a:int,b:int>>),"
        " (acc, s) -> CASE WHEN size(acc) > 0 AND s.a < element_at(acc, -1).b"
        "   THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a AS a, greatest(element_at(acc, -1).b, s.b) AS b)))"
        "   ELSE concat(acc, array(s)) END)"
    )
    cut = F.when(F.col("spans").isNull(), F.col("text")).otherwise(
        F.aggregate(
            F.reverse(merged), F.col("text"),
            lambda t, s: F.concat(F.substring(t, F.lit(1), s["a"]), F.lit("[SECRET]"), F.substring(t, s["b"] + 1, F.length(t))),
        )
    )
    out = joined.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
