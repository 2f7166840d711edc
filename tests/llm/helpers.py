"""Small inputs with awkward rows, and brute-force answers."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside; none may matter.
EXTRA = "key long, size string, n int, mate int, band string, ids string, score string, host int"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s0")), len(r[1] or ""), 1, "x", 2, 3, "y", "z", "w", 4) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars int, {EXTRA}")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text):
    w = WORD.findall(low(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def smallest_reachable(ids, links):
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_duplicate_classes(texts, hundredths=85):
    """doc_id -> smallest doc_id reachable, by comparing all sets that share a shingle; links from a similarity of so many hundredths on."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    links = set()
    for d, s in sets.items():
        for e in {e for g in s for e in holders[g] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= hundredths * (len(s) + len(sets[e]) - both):
                links.add((e, d))
    return smallest_reachable(sets, links), {d: len(s) for d, s in sets.items()}
