"""Operators that work row by row: media, toxicity, quality, pieces, decontamination, WARC."""

import base64
import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from conftest import DATA
from helpers import documents, frame

from tessera.llm import decontaminate, pieces, quality, queries, toxicity, warc, webp
from tessera.llm.common import shared_dir, utf8


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (3,), (0, 1, 2), (1, 0), (2, 0, 1)])
def test_webp_round_trip(transforms):
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 5), (17, 40)):
        images = [rng.integers(0, 2**32, (h, w), dtype=np.uint32), np.uint32(0xFF000000) | rng.integers(0, 4, (h, w)).astype(np.uint32) * np.uint32(0x010305), np.full((h, w), 0xFF102030, np.uint32), np.tile(rng.integers(0, 2**32, (1, w), dtype=np.uint32), (h, 1))]
        for image in images:
            if 3 in transforms and len(np.unique(image)) > 256:
                continue
            for cache in (0, 1, 6, 11):
                data = webp.encode(image, transforms, cache, modes=rng.integers(0, 14, 50), elements=rng.integers(0, 2**32, 50, dtype=np.uint32))
                assert (webp.decode(data) == image).all()


def test_webp_step_by_step_equals_at_once():
    rng = np.random.default_rng(2)
    image = np.uint32(0xFF000000) | np.tile(rng.integers(0, 256, 90), 8).reshape(24, 30).astype(np.uint32) * np.uint32(0x0101)
    data = webp.encode(image, ())
    b = webp.Bits(data[20:])
    b.at = 40
    assert b.read(1) == 0 and b.read(1) == 0 and b.read(1) == 0
    group = webp.read_group(b, 0)
    again = webp.Bits(b.data)
    again.at = b.at
    fast, slow = webp.read_pixels_at_once(b, group, 30, 24), webp.read_pixels(again, [group], None, 0, 0, 30, 24)
    assert (fast == slow).all() and b.at == again.at


def test_webp_groups_of_codes():
    """Two groups of codes chosen by an entropy image."""
    f = webp.Fields()
    f.put([webp.SIGNATURE, 7, 3, 0, 0, 0, 0], [8, 14, 14, 1, 3, 1, 1])  # 8 x 4, no transform, no cache
    f.put([1, 0], [1, 3])  # groups by 4 x 4 blocks
    webp.write_image(f, np.array([0xFF000000, 0xFF000100], np.uint32), 2, False)
    for green in (7, 200):
        for n, s in ((280, green), (256, 0), (256, 0), (256, 255), (40, 0)):
            lengths = np.zeros(n, np.int64)
            lengths[s] = 1
            webp.write_code(f, lengths)
    body = f.bytes()
    got = webp.decode(b"RIFF\0\0\0\0WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    assert (got[:, :4] == 0xFF000700).all() and (got[:, 4:] == 0xFF00C800).all()


def test_webp_bad_files():
    good = webp.encode(np.zeros((40, 40), np.uint32) + np.arange(40, dtype=np.uint32))
    for data in (b"", b"RIFF", b"RIFF\0\0\0\0WEBPVP8X", b"RIFF\0\0\0\0WEBPVP8L", good[:60], good[:21]):
        with pytest.raises(ValueError):
            webp.decode(data)


def test_webp_of_another_encoder():
    """A published file for testing whether lossless WebP is read: one transparent pixel."""
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(data).tolist() == [[0]]


def test_webp_built_by_hand():
    """Fields written by the format's text alone: a palette of three colours, two bits an index, no prefix bits but green's."""
    fields = [(0x2F, 8), (2, 14), (1, 14), (0, 1), (0, 3)]  # 3 x 2
    fields += [(1, 1), (3, 2), (2, 8)]  # palette of three colours, each less the one before it
    fields += [(0, 1)]  # the palette as an image of 3 x 1: no cache
    fields += [(1, 1), (1, 1), (1, 1), (10, 8), (20, 8)]  # green is 10 (bit 0) or 20 (bit 1)
    fields += [(1, 1), (0, 1), (1, 1), (1, 8)] + [(1, 1), (0, 1), (1, 1), (2, 8)] + [(1, 1), (0, 1), (1, 1), (255, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)]
    fields += [(0, 1), (1, 1), (0, 1)]  # 10, 20, 10
    fields += [(0, 1)]  # no more transforms
    fields += [(0, 1), (0, 1)]  # no cache, one group
    # packed rows of four indices: 0 1 2 is 0b100100, 2 2 0 is 0b001010
    fields += [(1, 1), (1, 1), (1, 1), (0b001010, 8), (0b100100, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)] * 2 + [(1, 1), (0, 1), (1, 1), (255, 8)] + [(1, 1), (0, 1), (0, 1), (0, 1)]
    fields += [(1, 1), (0, 1)]
    word, at = 0, 0
    for v, n in fields:
        word |= v << at
        at += n
    body = word.to_bytes((at + 7) // 8, "little")
    got = webp.decode(b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)
    a, b, c = 0xFF010A02, 0xFE021E04, 0xFD032806
    assert got.tolist() == [[a, b, c], [c, c, a]]


def test_media_transforms():
    """The stored form's transforms follow from the bytes; all are read back."""
    for text, kinds in ((b"abcd" * 700, (webp.PALETTE,)), (bytes(range(32, 127)) * 40, (webp.PREDICTOR, webp.SUBTRACT_GREEN)), (" ".join(map(str, range(900))).encode() + bytes(range(33, 90)), (webp.SUBTRACT_GREEN,))):
        payload = webp.payload_of(text)
        assert webp.transforms_for(np.frombuffer(payload, np.uint8).reshape(-1, 576)) == kinds
        assert webp.samples(webp.load(webp.store(payload))) == payload


def media_text(n):
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 9))) for _ in range(400)]
    return " ".join(rng.choices(words, k=n)).encode()


def test_media_calls():
    """What op1 spends on a text, counted in calls, as seconds differ by machine."""
    text, calls = media_text(500), Counter()

    def count(_, event, __):
        calls[event] += 1

    webp.feature(webp.load(webp.store(webp.payload_of(text))))
    sys.setprofile(count)
    try:
        webp.feature(webp.load(webp.store(webp.payload_of(text))))
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 1500


def test_media_pieces():
    """A stream of many pieces, with copies that start in one and long ones, read at once and symbol by symbol."""
    text = media_text(6000)
    payload = webp.payload_of(text + text[5000:5100] * 90 + text[:9000] + b"".join(text[k : k + 30] + bytes([k % 256]) for k in range(0, 20000, 40)))
    data = webp.store(payload)
    assert len(data) > 10 * webp.PIECE and webp.samples(webp.load(data)) == payload
    b = webp.Bits(data[20:])
    b.at = 40 + 3 + 1 + 2  # subtract-green, no more transforms, no cache, no groups
    group = webp.read_group(b, 0)
    again = webp.Bits(b.data)
    again.at = b.at
    height = len(payload) // 576
    fast, slow = webp.read_pixels_at_once(b, group, 576, height), webp.read_pixels(again, [group], None, 0, 0, 576, height)
    assert (fast == slow).all() and b.at == again.at and bytes((fast >> 8).astype(np.uint8)) == payload


def test_media_column(spark):
    rows = documents()
    got = webp.store_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        b = utf8(t)
        payload = b + b"\xff" * ((-len(b)) % 576 or (0 if b else 576))
        hits = [r for r in by[i] if r.payload_sha256 == hashlib.sha256(payload).hexdigest()]
        assert hits and hits[0].n_bytes == len(b) and hits[0].payload_bytes == len(payload) and hits[0].tail_crc32 == zlib.crc32(payload[-32:])
        assert hits[0].media_sha256 == hashlib.sha256(bytes(hits[0].media)).hexdigest() and webp.samples(webp.load(bytes(hits[0].media))) == payload
    assert webp.store_texts(frame(spark, [])).count() == 0


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "sun", "ba") for b in ("ra", "nel", "do", "pu", "sti", "vo")]
    texts, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) + ("." if rng.random() < 0.15 else "") for _ in range(rng.randint(20, 120))]
        bad = k % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grobian", "schuft", "lump"])
        texts.append(" ".join(words).encode())
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_learns_and_locates():
    texts, labels = toxic_corpus(400, 1)
    model = toxicity.train(texts, labels)
    held, want = toxic_corpus(200, 2)
    scores, spans = toxicity.score_texts(held, model, 0.5)
    assert ((scores >= 0.7) == want.astype(bool)).mean() > 0.97
    for t, s, y in zip(held, spans, want, strict=True):
        if y and s:
            assert any(w in t[s[0][0] : s[0][1]] for w in (b"grobian", b"schuft", b"lump"))
    assert toxicity.score_texts([b"", b" . "], model)[0].tolist()[0] == 0


def test_toxicity_column(spark):
    texts, labels = toxic_corpus(200, 1)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, "doc_id", "text", "toxic", F.col("id") >= 0)
    rows = documents()
    got = toxicity.score_toxicity(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0
    none = toxicity.fit(docs, marks.limit(0), "doc_id", "text", "toxic", F.lit(True))
    assert toxicity.score_toxicity(docs, none).agg(F.max("score")).first()[0] < 1e-6


def test_quality_learns():
    rng = random.Random(4)

    def make(n, seed):
        r = random.Random(seed)
        out = []
        for k in range(n):
            words = ["".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 200))]
            out.append(((" ".join(words) + ".").capitalize() if k % 3 else " ".join(w.upper() + "!!" for w in words)).encode())
        return out, np.array([int(k % 3 > 0) for k in range(n)])

    texts, labels = make(240, 1)
    model = quality.train(texts, labels, epochs=2)
    held, want = make(120, 2)
    scores = quality.score_texts(held, model)
    assert ((scores >= 0.3) == want.astype(bool)).mean() > 0.95
    assert 0 <= quality.score_texts([b"", b"x" * 50000], model).min() <= 1
    del rng


def test_quality_reads_the_whole_text():
    chunks, doc = quality.chunks_of([b"a" * 5000, b"", b"b" * 1024])
    assert sum(len(bytes(c).rstrip(b"\0")) for c in chunks[doc == 0]) >= 5000 and (doc == 1).sum() == 1
    assert bytes(chunks[doc == 0][-1]).rstrip(b"\0").endswith(b"a")


def test_quality_trains_on_whole_texts(monkeypatch):
    read, cut = [], quality.chunks_of
    monkeypatch.setattr(quality, "chunks_of", lambda texts: read.extend(texts) or cut(texts))
    texts = [bytes([97 + k]) * n for k, n in enumerate((0, 10, 4096, 4097, 9000, 90000))]
    quality.train(texts, np.array([0, 1, 0, 1, 0, 1]), epochs=1)
    assert {t for t in read} == set(texts)


def test_pieces_round_trip_and_reproducible(spark):
    rows = documents() + [(70, "▁ ▁▁ own marks  \n\t"), (71, " lead and trail "), (72, "😀\u0000é" * 20), (73, "x" * 3000)]
    got = pieces.encode_column(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    again = {(r.doc_id, r.pieces_sha256) for r in pieces.encode_column(frame(spark, rows[::-1]).repartition(3)).collect()}
    assert again == {(r.doc_id, r.pieces_sha256) for r in got}
    assert pieces.encode_column(frame(spark, [])).count() == 0
    other = {r.doc_id: r.pieces_sha256 for r in pieces.encode_column(frame(spark, rows), seed=2).collect()}
    assert sum(other[r.doc_id] != r.pieces_sha256 for r in got) > 10


def test_pieces_sample_the_lattice():
    v = pieces.Vocabulary.load()

    def ways(s):
        if not s:
            return [((), 1.0)]
        return [((v.pieces[s[:k]][0], *t), v.pieces[s[:k]][1] * p) for k in range(1, len(s) + 1) if v.pieces.get(s[:k], (-1, 0))[0] >= 0 for t, p in ways(s[k:])]

    every = ways("▁thes")
    total, n = sum(p for _, p in every), 8000
    drawn = [tuple(x.tolist()) for x in pieces.sample(["thes"] * n, np.arange(n, dtype=np.uint64) * np.uint64(11), pieces.Lattices(v))]
    assert set(drawn) <= {w for w, _ in every}
    for w, p in sorted(every, key=lambda x: -x[1])[:4]:
        assert abs(drawn.count(w) / n - p / total) < 0.03


def benchmark_rows():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "nel", "do", "pu", "sti")]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40)))) for k in range(30)], words


def test_decontamination_against_all_windows(spark):
    items, words = benchmark_rows()
    rng = random.Random(5)
    rows = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(80)]
        if k % 2 == 0:
            own = items[k % 30][1].split()
            if k % 4 == 0:
                own[len(own) // 2] = "changed"
            at = rng.randrange(60)
            text[at:at] = [w.upper() + "," if k % 8 == 0 else w for w in own]
        rows.append((k, " ".join(text)))
    rows += [(90, ""), (91, None), (None, items[3][1]), (92, items[4][1])]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame([*items, (98, None), (99, " ")], "item_id long, text string")).collect()}
    index = decontaminate.build_index([i for i, _ in items], [utf8(t) for _, t in items])
    want = {}
    for i, t in rows:
        w = decontaminate.words_of([utf8(t)])
        h, _ = decontaminate.shingle_hashes(w.hash, w.first)
        for k, (item, _) in enumerate(items):
            span = int(index.sizes[k]) - 4
            for s in range(len(h) - span + 1):
                x = decontaminate.weighted_jaccard(h[s : s + span], index.shingles[k], index)
                if x >= 0.8:
                    want[i, item] = max(x, want.get((i, item), 0))
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k].similarity - x) < 1e-9 for k, x in want.items())
    assert decontaminate.find_leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_texts_shorter_than_items(spark):
    """A text of fewer words than an item is one window; wanted pairs by words, in plain Python."""
    items, _ = benchmark_rows()
    rows = []
    for k, t in items:
        w = t.split()
        rows += [(10 * k, " ".join(w[:-1])), (10 * k + 1, " ".join(w[1:])), (10 * k + 2, " ".join(w[: len(w) * 5 // 6])), (10 * k + 3, " ".join(w[: len(w) // 2])), (10 * k + 4, " ".join(w[:4])), (10 * k + 5, " ".join(w[:5]))]
    runs = lambda t: Counter(tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4))
    df = Counter(x for _, t in items for x in set(runs(t)))
    weigh = lambda c: sum(n * math.log1p(len(items) / df.get(x, 1)) for x, n in c.items())
    want = {}
    for i, t in rows:
        for item, u in items:
            a, b = runs(t), runs(u)
            if a and len(t.split()) < len(u.split()) and (s := round(weigh(a & b) / weigh(a | b), 12)) >= 0.8:
                want[i, item] = (s, 0, len(t.split()))
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want) and len(want) > 60
    assert all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    """Blocks and the order of the items change nothing, similarities included."""
    items, words = benchmark_rows()
    rng = random.Random(8)
    shared = " ".join(rng.choice(words) for _ in range(9))
    items = [(k, f"{shared} {t}" if k % 3 else t) for k, t in items] + [(50, "two words"), (51, None)]
    rows = []
    for k in range(90):
        own = items[k % 30][1].split()
        own[rng.randrange(len(own))] = "changed"
        at = rng.randrange(len(own) // 2)
        rows.append((k, " ".join(own[: -(k % 4) or None] + ["two", "words"] if k % 2 else own[at // 4 :] + own[:at])))
    find = lambda items: sorted(map(tuple, decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").coalesce(1)).collect()))
    want = find(items)
    assert len(want) > 30
    for size in (1, 7):
        monkeypatch.setattr(decontaminate, "ITEMS", size)
        assert find(items) == want == find(items[::-1])


def test_decontamination_by_short_items(spark):
    items = [(1, "Solar"), (2, "two words"), (3, "a few more"), (4, "four words, in all"), (5, "two words"), (6, "words two")]
    rows = [(1, "here are Two words. and two words again in a long text"), (2, "two"), (3, "words"), (4, "(four words in all)"), (5, "four words in"), (6, "solar"), (7, "a solar, sail"), (8, ""), (9, None), (10, "two other words and a few"), (11, "more")]
    got = {tuple(r) for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 2, 1.0, 2, 2), (1, 5, 1.0, 2, 2), (4, 4, 1.0, 0, 4), (6, 1, 1.0, 0, 1), (7, 1, 1.0, 1, 1)}


def test_hamming_blocks_miss_nothing():
    items, _ = benchmark_rows()
    index = decontaminate.build_index([i for i, _ in items], [utf8(t) for _, t in items])
    rng = np.random.default_rng(1)
    for k in range(200):
        mark = index.marks[k % 30]
        for b in rng.choice(64, rng.integers(0, 20), replace=False):
            mark = mark ^ np.uint64(1 << int(b))
        _, hit = decontaminate.candidates(np.array([mark]), index)
        assert k % 30 in hit


def test_warc_audit(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "p" * (k % 50)) for k in range(700)] + [(None, None, None), (5, "again", "x"), (700, None, "y")], "page_id long, url string, html string")
    left = warc.archive(pages)
    assert warc.audit(left, left).count() == 0
    changed = F.when(F.col("id").isin(3, 300), F.concat(F.lit(b"X"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    right = left.withColumn("record", changed).filter("id is null or id <> 650")
    got = {(r.id, r.kind) for r in warc.audit(left, right).collect()}
    assert got == {(3, "changed"), (300, "changed"), (650, "missing")}
    assert {(r.id, r.kind) for r in warc.audit(right, left).collect()} == {(3, "changed"), (300, "changed"), (650, "extra")}
    assert warc.audit(warc.archive(pages.limit(0)), warc.archive(pages.limit(0))).count() == 0
    files = left.filter("file = 1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.hex("record").alias("r")))), lambda z: z["r"]), "").alias("h")).select(F.lit("a").alias("path"), F.unhex("h").alias("content"))
    back = warc.read_files(files).select("offset", "length").orderBy("offset").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in left.filter("file = 1").orderBy("ord").select("offset", "length").collect()]


def laid_anew(records):
    """Records end to end again, in their order, as a replica has them that lost or won some."""
    order = Window.partitionBy("file").orderBy("ord")
    return records.select("file", (F.row_number().over(order) - 1).alias("ord"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "id", "record")


def test_warc_audit_of_a_replica_laid_anew(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "p" * (k % 50)) for k in range(600)] + [(20, "twice", "a"), (20, "twice", "b"), (None, "n", "m"), (None, "o", "m")], "page_id long, url string, html string")
    left = warc.archive(pages)
    right = laid_anew(left.filter("id is null or id not in (3, 400)"))
    assert sorted((r.id, r.kind) for r in warc.audit(left, right).collect()) == [(3, "missing"), (400, "missing")]
    assert sorted((r.id, r.kind) for r in warc.audit(right, left).collect()) == [(3, "extra"), (400, "extra")]
    longer = F.when((F.col("id") == 20) & F.expr("instr(decode(record, 'UTF-8'), 'twice') > 0"), F.concat("record", F.lit(b"!!"))).otherwise(F.col("record"))
    right = left.withColumn("record", longer).withColumn("length", F.octet_length("record").cast("long"))
    got = warc.audit(left, laid_anew(right), moved=True).collect()
    assert sorted(r.id for r in got if r.kind == "changed") == [20, 20] and {r.kind for r in got} == {"changed", "moved"}
    assert sorted(r.id for r in got if r.kind == "moved") == [*range(21, 256)]
    gone = left.filter("id is null").orderBy("record").first().record
    right = laid_anew(left.filter(F.col("record") != F.lit(bytes(gone))))
    assert [(r.id, r.kind) for r in warc.audit(left, right).collect()] == [(None, "missing")]


def test_warc_query_writes_the_pages_once(spark):
    folder = os.path.join(shared_dir(spark).removeprefix("file://"), "tessera")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = queries.queries()["op10_warc"](spark, DATA)
    assert len([x for x in set(os.listdir(folder)) - before if x.startswith("replica-")]) == 1
    sign = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:2]
    ids = [r.page_id for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id").collect()]
    want = [(i, "missing" if sign(i) == "7f" else "changed") for i in ids if sign(i) in ("7f", "1c")]
    assert sorted((r.page_id, r.kind) for r in found.collect()) == sorted(want)
