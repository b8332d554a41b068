"""The pipeline's stages on a small corpus: what each drops and keeps."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent.parent))
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_counts(spark, stages):
    names = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(s.columns == names for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * 200


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id")
    assert stages[0].join(labels, "doc_id").count() >= 0.95 * labels.count()


def test_no_leak_and_lossless(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in stages[3].collect() for i in items)
    assert stages[4].filter(~F.col("lossless")).count() == 0 and stages[4].count() == stages[3].count()


def test_only_contaminated_rows_go(spark):
    """Clean rows stay that share a null or repeated id with a contaminated one."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after"), (None, "clean, without an id"), (None, None), (7, item), (7, "clean, with a repeated id"), (7, ""), (8, "clean"), (9, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontaminate(spark, docs, DATA)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {r for r in rows if not r[1] or r[1].startswith("clean")} and got.count() == 5


def test_empty_and_null_documents_pass(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, DATA).count() == 3
        assert stage(spark, docs.limit(0), DATA).count() == 0


#: Names that stages use inside, for columns, structs or lambdas.
INNER = """score _score _id _component _hash row id block kept n_dropped n_lines every rest gone th left no_text h1 h2 first pos key line maybe word hit f0 f1 f2 f3 w0 w1 w2 w3 rep lab
comp cls g part x y n k own whole some item label lang2 shingles size hash window windows radius bucket lo hi a b c d _row _th _every _left _n _k _kept _no_text _text _n_lines _n_dropped text_ _own""".split()


def test_clashing_columns_stay(spark):
    """Columns that have the names stages use inside come through with their values."""
    rows = [(k, f"a plain sentence number {k} that says something of its own, in words of {k * 7} kinds") for k in range(6)] + [(1, "a text that repeats an id"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) if k % 2 else F.col("doc_id") + k for k, c in enumerate(INNER)})
    want = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        if name == "quality classifier":
            assert got.count() <= len(rows)
        elif name == "line dedup":
            assert {r[:2] + r[3:] for r in map(tuple, got.collect())} == {r[:1] + (r[1] or "",) + r[3:] for r in want}
        else:
            assert {tuple(r) for r in got.collect()} == want, name


def test_held_out_and_predicted(spark):
    """The split and the thresholds of op6 and op9, whose models never see a held-out label."""
    import zlib

    from tessera.llm import queries

    for query, modulus, out, least in ((queries.op6_toxicity, 3, 1, 0.7), (queries.op9_quality_classifier, 5, 0, 0.3)):
        got = query(spark, DATA).collect()
        assert len(got) == 200
        for r in got:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == out)
            assert r.predicted == int(r.score >= least) and 0 <= r.score <= 1


def test_repeated_ids_train_alike(spark):
    """Of rows that repeat an id the least text is learnt, whatever the order of the rows."""
    from tessera.llm.toxicity import labelled_sample

    rows = [(1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d"), (3, "c")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for own in (rows, rows[::-1]):
        docs = spark.createDataFrame(own, "doc_id long, text string")
        texts, y = labelled_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True), 10)
        assert texts == [b"a", b""] and y.tolist() == [1, 0]
    texts, y = labelled_sample(docs.limit(0), labels.limit(0), "doc_id", "text", "toxic", F.lit(True), 10)
    assert texts == [] and len(y) == 0
