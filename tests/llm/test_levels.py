"""Vector codes, importance resampling and window dedup against slow versions, with awkward rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import TO_LOWER, documents, frame, order, same, sha

from tessera.llm import importance, vector_codes, window_dedup

VECTORS = "vec_id long, embedding array<float>, label int, row string, codes string, sums array<long>, error long, k int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, "r", "c", None, 1, 2) for i, v, c in rows], VECTORS)


def slow_codes(rows, parts=8, entries=16, rounds=6):
    """By full searches in Python's integers."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    single = lambda x: float(np.float32(x))
    ints = [[math.floor(4096 * single(x)) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    size = width // parts
    by_id = sorted(range(len(kept)), key=lambda k: (order(kept[k][0]), [single(x) for x in kept[k][1]]))
    books = [[ints[k][p * size : (p + 1) * size] for k in by_id[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (dist(v[p * size : (p + 1) * size], books[p][e]), e)) for p in range(parts)] for v in ints]  # noqa: B023
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * size : (p + 1) * size] for v, c in zip(ints, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(dist(v[p * size : (p + 1) * size], books[p][c[p]]) for p in range(parts)) for v, c in zip(ints, codes, strict=True)]
    by_label = Counter()
    for (_, _, c), e in zip(kept, errors, strict=True):
        by_label[c] += e
    return [(i, "".join(f"{x:02x}" for x in c), e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]


def some_vectors(width=24):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(width)], rng.choice([0, 0, 0, 1, None])) for i in range(60, 0, -1)]
    rows += [(100 + k, rows[3][1], 7) for k in range(20)]  # ties
    rows += [(200, [0.0] * width, 1), (201, [-1e-9] * width, 1), (202, None, 1), (203, [float("nan")] + [0.1] * (width - 1), 2), (204, [float("inf")] * width, 2), (205, [None] * width, 3)]
    return [*rows, (3, rows[5][1], 0), (None, rows[6][1], None), (None, rows[7][1], None), rows[10]]


def test_codes(spark):
    rows = some_vectors()
    got = vector_codes.compress(vectors(spark, rows).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert same(got.collect(), slow_codes(rows))


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5], 1), (2, [-0.25, 0.125], None)], [(5, [], 0), (6, [1.0] * 9, 0)]])
def test_codes_of_few_vectors(spark, rows):
    assert same(vector_codes.compress(vectors(spark, rows)).collect(), slow_codes(rows))


def test_labels_by_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    rows = some_vectors(8)
    assert same(vector_codes.compress(vectors(spark, rows)).collect(), slow_codes(rows))


def test_large_components_are_cut_off(spark):
    rows = [(1, [1e30, -1e30] + [0.0] * 6, 0), (2, [16384.0, -16384.0] + [0.0] * 6, 0)]
    assert [r.error for r in vector_codes.compress(vectors(spark, rows)).collect()] == [0, 0]


def test_bounds_leave_out_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    x = (rng.normal(0, 30, (4000, 2, 4)) + 400 * rng.integers(0, 4, (4000, 2, 1))).astype(np.int64)
    x[::7] //= 50  # ties
    books = vector_codes.Codebooks(x[:16].transpose(1, 0, 2).copy())
    known, full = (), 4000 * 2 * 16
    for turn in range(6):
        codes, upper, lower, computed = books.assign(x, *known)
        for p in range(2):
            assert (codes[:, p] == vector_codes.full_search(x[:, p], books.entries[p])[0]).all()
            d = vector_codes.all_distances(x[:, p], books.entries[p])
            assert (upper[:, p].astype(object) ** 2 >= d[np.arange(4000), codes[:, p]]).all() and (lower[:, p] ** 2 <= d).all()
        assert computed == full if turn == 0 else computed < full
        known = codes, upper, lower
        sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((2, 16), np.int64)
        for p in range(2):
            np.add.at(sums[p], codes[:, p], x[:, p])
            counts[p] = np.bincount(codes[:, p], minlength=16)
        books = books.after(sums, counts)
    assert computed < full // 4


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**52, 2**60 - 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 - 1], np.int64)
    assert vector_codes.root(x).tolist() == [math.isqrt(v) for v in x.tolist()]
    assert vector_codes.root_up(x).tolist() == [math.isqrt(max(0, v - 1)) + (v > 0) for v in x.tolist()]


def slow_resample(rows, target, longest=2, buckets=10000, percent=25, seed=7):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(TO_LOWER))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    ours, theirs = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = Counter(b for _, f in ours for b in f), Counter(b for _, f in theirs for b in f)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for (i, _), (words, f) in zip(rows, ours, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"{seed}:{'' if i is None else i}".encode())[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], order(r[0]), r[1], r[2]))
    drawn = [r[:4] + (k + 1,) for k, r in enumerate(able[: percent * len(able) // 100])]
    return drawn + [r[:4] + (None,) for r in able[len(drawn) :]] + [r[:4] + (None,) for r in out if r[4] < 20]


@pytest.mark.parametrize(("longest", "percent"), [(2, 25), (3, 100), (1, 0)])
def test_resample(spark, longest, percent):
    rows = documents()
    target = ["alpha beta gamma delta", None, "", "漢字 mu iota 42", "kappa alpha"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, n long")
    got = importance.resample(frame(spark, rows), bench, longest=longest, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert same(got.collect(), slow_resample(rows, target, longest, percent=percent))


def test_resample_of_empty_tables(spark):
    assert importance.resample(frame(spark, []), frame(spark, documents())).count() == 0
    rows = documents()
    assert same(importance.resample(frame(spark, rows), frame(spark, [])).collect(), slow_resample(rows, []))


def test_composed_crcs():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "Zz", "9", " ", "--", "é", "漢", "\n"]) for _ in range(n)).encode() for n in (0, 1, 50, 400)] + [b"x" * 5000 + b" y " + b"q" * 41 + b" " + b"r" * 40, b"", b" "]
    words, bucket, text = importance.features(texts, 4, 2**32 - 1)
    for k, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.decode().translate(TO_LOWER))
        assert words[k] == len(w)
        assert Counter(bucket[text == k].tolist()) == Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % (2**32 - 1) for n in range(1, 5) for i in range(len(w) - n + 1))


def slow_windows(rows, window=13):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]

    def owners(size):
        out = {}
        for (i, _), w in zip(rows, split, strict=True):
            for k in range(len(w) - size + 1):
                s = tuple(w[k : k + size])
                out[s] = min(out.get(s, float("inf")), order(i))
        return out

    late, size = [], window
    while size <= max(map(len, split), default=0):
        own = owners(size)
        late.append([[k for k in range(len(w) - size + 1) if own[tuple(w[k : k + size])] < order(i)] for (i, _), w in zip(rows, split, strict=True)])
        size *= 2
    out = []
    for n, ((i, _), w) in enumerate(zip(rows, split, strict=True)):
        gone = {k + j for k in (late[0][n] if late else []) for j in range(window)}
        longest = max((window << level for level, found in enumerate(late) if found[n]), default=0)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone), longest))
    return out


@pytest.mark.parametrize("window", [13, 4, 2])
def test_windows(spark, window):
    rows = documents()
    long = " ".join(f"w{k}" for k in range(300))
    rows += [(70, long), (71, "x " + long[30:900] + " y"), (72, long), (69, "z\t" + long.replace(" ", "\n\n") + " end"), (73, long[:400] + " " + long[:400]), (74, " ".join(f"w{k}" for k in range(40, 53)))]
    got = window_dedup.dedup_windows(frame(spark, rows), window=window).select("doc_id", "n_words", "n_removed", "kept", "longest").collect()
    assert same(got, slow_windows(rows, window))


def test_windows_of_an_empty_table(spark):
    assert window_dedup.dedup_windows(frame(spark, [])).count() == 0
    assert same(window_dedup.dedup_windows(frame(spark, [(1, None), (None, "a b")])).collect(), [(1, 0, 0, "", 0), (None, 2, 0, "a b", 0)])
