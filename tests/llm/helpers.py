"""Rows with every awkward case, and brute-force forms of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 1, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 7))
    return " ".join(out)


def awkward_docs(spark, extra: list | None = None):
    """Nulls, blanks, ties, repeated rows, a very long text and clashing column names."""
    base = prose(1, 120)
    rows = [(1, base), (2, base), (3, base.replace("alpha", "omega", 1)), (4, None), (5, ""), (6, " \t\n"), (7, "one two"),
            (8, "One TWO"), (None, base), (None, None), (9, prose(2, 80) + " " + base[:400]), (9, prose(2, 80) + " " + base[:400]),
            (10, "é" * 300), (11, "ab" * 40_000), (12, prose(3, 20_000)), (13, "x" * 199), (14, "x" * 199), (15, "日本語 " * 90)]
    rows += extra or []
    schema = ("doc_id long, text string, n_chars long, rank string, score string, row string, t string, id string, spans string, "
              "pieces_sha256 string, label string")
    return spark.createDataFrame([(i, t, None if t is None else len(t), *["clash"] * 8) for i, t in rows], schema)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long, rank string, score string")


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_components(rows: list) -> dict:
    """doc_id -> (set size, smallest id reachable), ids not null."""
    rows = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            same = rows[a][0] == rows[b][0]
            if x and y and (same or 100 * len(x & y) >= 75 * len(x | y)):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(rows)}


def brute_repeats(texts: list, length: int = 200) -> list:
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b) + 1)
        end = 0
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                for q in range(max(k, end), k + length):
                    gone[q] = 1
                end = k + length
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
