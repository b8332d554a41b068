"""Small documents with everything that is awkward, and slow versions of the operators."""

import hashlib
import random
import re

BLANKS = " \t\n\x0b\x0c\r"
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "épée", "zeta", "eta", "theta", "iota", "kappa", "漢字", "mu"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))
    passage = "this passage of many words stands in several documents and is longer than fifty bytes by far"
    base = prose(120)
    rows = [(i, prose(rng.randint(1, 60))) for i in range(1, 25)]
    rows += [(30, base), (31, base), (32, base.replace("alpha", "ALPHA")), (33, base + " one more end"), (34, " ".join(base.split(" ")[:-3]))]
    rows += [(40 + k, prose(10) + "\n" + passage + "\n" + prose(10)) for k in range(6)]
    rows += [(50, ""), (51, None), (52, "   \n\t "), (53, "one"), (54, "one"), (55, "two words"), (56, "a" * 300), (57, "a" * 120), (58, "be " * 400)]
    rows += [(60, prose(4000)), (61, "x" + "\n".join([passage] * 3)), (None, passage), (None, "null id"), (62, "\n\n\n"), (63, passage.upper())]
    rows += [rows[5], rows[5]]
    return rows


SCHEMA = "doc_id long, text string, id string, h long, g string, score double, kept string, pos int"


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, None, 0.5, None, 3) for i, t in rows], SCHEMA)


def order(i):
    return float("inf") if i is None else i


def slow_lines(rows):
    key = lambda line: line.strip(BLANKS).translate(TO_LOWER)
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, float("inf")), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and first[key(x)] < order(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(TO_LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def slow_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                parent[root(a)] = root(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [order(rows[b][0]) for b in range(len(rows)) if root(b) == root(a)]
        least = min(ids) if sets[a] else order(i)
        out.append((i, len(sets[a]), None if least == float("inf") else least))
    return out


def slow_substrings(rows, length=50):
    owner = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            owner[b[k : k + length]] = min(owner.get(b[k : k + length], float("inf")), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if owner[b[k : k + length]] < order(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
