"""Line dedup, Jaccard join, substring dedup and URL filters against slow versions, with awkward rows."""

import os
import random
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import documents, frame, same, shingles, slow_components, slow_lines, slow_substrings

from tessera.llm import line_dedup, ngram_join, suffix_dedup, url_filter
from tessera.llm.common import NO_ID, release_driver, shared_dir
from tessera.llm.suffix_groups import suffix_arrays


def test_lines(spark):
    rows = documents()
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert same(got, slow_lines(rows))


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_runs_are_compacted(spark):
    store = line_dedup.SortedRuns(spark, fanout=2)
    for k in range(4):
        store.add(spark.createDataFrame([(h, h, 10 * k + 1) for h in range(k, k + 3)], "h1 long, h2 long, id long"))
    assert {lvl: len(r) for lvl, r in store.levels.items() if r} == {2: 1}
    assert sorted((r.h1, r["first"]) for r in store.all().collect()) == [(0, 1), (1, 1), (2, 1), (3, 11), (4, 21), (5, 31)]


def test_components(spark):
    rows = documents()
    got = ngram_join.components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert same(got, slow_components(rows))


def test_components_of_large_groups(spark, monkeypatch):
    """Columns of more classes than are multiplied out at once, chains, and a passage in all documents."""
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    rows, i = [], 0
    for _ in range(14):
        w = list(base)
        w[rng.randrange(100)] = f"edit{i}"
        rows.append((i, " ".join(w)))
        i += 1
    for k in range(10):  # a chain: each links to the next only
        rows.append((i, " ".join(f"c{j}" for j in range(4 * k, 4 * k + 60))))
        i += 1
    for _ in range(12):
        rows.append((i, " ".join([f"p{k}" for k in range(12)] + [f"u{i}_{k}" for k in range(50)])))
        i += 1
    got = ngram_join.components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert same(got, slow_components(rows))


def test_links_inside_components_are_counted(spark, monkeypatch):
    """Of a group of near copies in columns of more than LIGHT classes, every pair counts; without count_links no number is given."""
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    rng = random.Random(3)
    rows = [(i, " ".join(f"edit{i}" if k == at else f"w{k}" for k in range(100))) for i, at in enumerate(rng.choices(range(100), k=14))]
    rows += [(20 + k, " ".join(f"c{j}" for j in range(4 * k, 4 * k + 60))) for k in range(6)] + [(30, rows[0][1]), (31, "alone"), (32, None)]
    sets = [shingles(t) for _, t in rows]
    want = [(i, sum(1 for b in set(sets) if b != a and (n := len(a & b)) and 100 * n >= 80 * (len(a) + len(b) - n))) for (i, _), a in zip(rows, sets, strict=True)]
    got = ngram_join.components(frame(spark, rows), count_links=True)
    assert same(got.select("doc_id", "n_links").collect(), want) and max(n for _, n in want) > 8
    assert same(got.select("doc_id", "n_shingles", "component_id").collect(), slow_components(rows))
    assert "n_links" not in ngram_join.components(frame(spark, rows)).columns
    assert ngram_join.components(frame(spark, []), count_links=True).count() == 0


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_join_does_no_rounds_without_pairs(spark):
    """Where no column is shared by many, the driver plans no round of hubs and components."""
    words = lambda k, n: " ".join(f"w{k}_{j}" for j in range(n))
    rows = [(k, words(k, 30)) for k in range(12)] + [(20, words(0, 30)), (21, words(1, 29)), (22, words(2, 29))]
    got, jobs = jobs_of(spark, "join", lambda: ngram_join.components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect())
    assert same(got, slow_components(rows)) and jobs < 100


def test_join_gives_driver_memory_back(spark, monkeypatch):
    """The join gives back what ended queries held, again and again."""
    calls = []
    monkeypatch.setattr(ngram_join, "release_driver", lambda s: calls.append(release_driver(s)))
    ngram_join.components(frame(spark, documents())).count()
    assert len(calls) >= 3 and all(x in (True, False) for x in calls)


def test_components_of_an_empty_table(spark):
    assert ngram_join.components(frame(spark, [])).count() == 0


def test_one_of_each(spark):
    rows = documents()
    kept = {r.doc_id for r in ngram_join.keep_one_of_each(frame(spark, rows)).collect()}
    want = {i for (i, _), (_, _, c) in zip(rows, slow_components(rows), strict=True) if i is None or c is None or c == i}
    assert kept == want


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(120):
        texts = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0) for _ in range(rng.integers(1, 6))]
        if trial % 4 == 0:
            texts.append(np.append(np.tile(rng.integers(1, 3, rng.integers(1, 5)), 12), 0))
        begin = np.cumsum([0] + [len(t) for t in texts])[:-1]
        order, _ = suffix_arrays(np.concatenate(texts), begin)
        for t, b in zip(texts, begin, strict=True):
            assert (order[b : b + len(t)] - b).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("hot", [24, 1])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = documents()
    got = suffix_dedup.dedup_substrings(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert same([(*r[:4], bytes(r[4])) for r in got], slow_substrings(rows))


def shuffle_bytes(spark):
    names = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {n: os.path.getsize(n) for n in names if n.endswith(".data") and os.path.exists(n)}


def test_substrings_give_their_disk_back(spark):
    folder = os.path.join(shared_dir(spark).removeprefix("file://"), "tessera")
    stages, shuffles = set(os.listdir(folder)) if os.path.isdir(folder) else set(), set(shuffle_bytes(spark))
    out = suffix_dedup.dedup_substrings(frame(spark, documents()))
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - stages} == {"gone"}
    for _ in range(50):  # shuffle files are deleted beside the query; counts of rows leave some bytes
        left = {n: b for n, b in shuffle_bytes(spark).items() if n not in shuffles and b > 2000}
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert out.count() == len(documents())


def test_segments_are_dealt_out_in_rounds(spark):
    base = frame(spark, documents()).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    rows = lambda *turn: [tuple(r) for r in suffix_dedup.all_segments(base, *turn).collect()]
    turns = [rows(k, 2) for k in range(2)]
    assert sorted(turns[0] + turns[1]) == sorted(rows())
    assert all(turns) and not {r[0] for r in turns[0]} & {r[0] for r in turns[1]}


def test_substrings_of_an_empty_table(spark):
    assert suffix_dedup.dedup_substrings(frame(spark, [])).count() == 0


URLS = [
    (1, "http://a.com/en/1"), (2, "https://x.example.com/en/77"), (3, "https://EXAMPLE.net/de/8?q#f"), (4, "http://b.example.net/de/1"), (5, "ftp://c.org/es/"), (6, None), (7, ""), (8, "no scheme"),
    (9, "http://www.good.io/a/?utm_source=x&b=2&a=1#t"), (10, "https://good.io/a?a=1&b=2"), (11, "https://good.io/b"), (12, "http://com/en/x"), (13, "http://notcom/en/x"), (None, "https://good.io/a?a=1&b=2"), (10, "https://good.io/a?a=1&b=2"),
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in URLS], "page_id long, url string, host string, canonical string, block long")
    listed = spark.createDataFrame([("http://good.io/a?b=2&a=1",), (None,), ("none",)], "url string")
    got = {(r.page_id, r.url_ if "url_" in r else r.path): (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert by_id[1] == ("a.com", "com/en/", "block") and by_id[2] == ("x.example.com", "example.com/en/7", "allow")
    assert by_id[3] == ("example.net", "example.net/de/8", "block") and by_id[4] == ("b.example.net", "net/de/", "block")
    assert by_id[5] == ("c.org", "org/es/", "block") and by_id[6] == ("", None, "allow") == by_id[7] == by_id[8]
    assert by_id[9][2] == by_id[10][2] == by_id[None][2] == "block" and by_id[11][2] == "allow"
    assert by_id[12][1] == "com/en/" and by_id[13][1] is None
    assert url_filter.filter_urls(pages, listed).count() == len(URLS)
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0 and url_filter.filter_urls(pages, listed.limit(0)).filter("listed").count() == 0


def test_bloom_filter_has_no_misses(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    blooms = url_filter.bloom_filter(keys, "k", 40)
    probe = keys.select("k", *[c.alias(n) for n, c in url_filter.bloom_words("k", 40).items()]).join(blooms, "block", "left")
    assert probe.filter(" or ".join(f"(coalesce(f{i}, 0) & w{i}) = 0" for i in range(4))).count() == 0


def test_line_store_is_taken_up_again(spark, tmp_path):
    """Documents that come later lose the lines of those before, in a store opened anew; runs are read without an exchange or a sort."""
    rows = sorted((r for r in documents() if r[0] is not None), key=lambda r: r[0])
    want = {(r[0], r[3]) for r in slow_lines(rows)}
    store = line_dedup.SortedRuns(spark, path=str(tmp_path / "store"))
    early = line_dedup.dedup_lines(frame(spark, [r for r in rows if r[0] < 43]), store=store).collect()
    again = line_dedup.SortedRuns.open(spark, store.path)
    late = line_dedup.dedup_lines(frame(spark, [r for r in rows if r[0] >= 43]), batches=2, store=again).collect()
    assert {(r.doc_id, r.kept) for r in early + late} == want
    with line_dedup.reading_sorted(spark):
        run = again.all()
        batch = spark.range(10).selectExpr("id h1", "id h2")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = batch.join(run, ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_folder_must_be_shared(spark, monkeypatch):
    """On a cluster no folder is made up."""
    from tessera.llm import common

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
