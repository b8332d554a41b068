"""The corpus pipeline: five stages from raw documents to training pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each stage's rows as Parquet to the
shared folder and reads them back for the next. All but the last return the columns of documents. Labels, only read to train the
classifier, come from sf_dir, and so does the benchmark. Null texts count as empty; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, stash, table
from tessera.llm.decontaminate import find_leaks
from tessera.llm.line_dedup import dedup_rows
from tessera.llm.ngram_join import keep_one_of_each
from tessera.llm.pieces import encode_column
from tessera.llm.quality import fit, score_quality
from tessera.llm.suffix_dedup import rows_without
from tessera.llm.queries import crc_of_id

#: A document below this quality goes.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It is trained on a bounded sample of the labelled documents that are not held out."""
    model = fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", crc_of_id(5) != 0)
    score = fresh(docs, "_score")
    return score_quality(docs, model, keep=True, score_col=score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document with a smaller id holds. A document that loses every line goes, one that was empty before stays."""
    n, dropped, kept = names = tuple(fresh(docs, c) for c in ("_n_lines", "_n_dropped", "_kept"))
    out = dedup_rows(docs, names=names).filter((F.col(dropped) == 0) | (F.col(kept) != "")).drop("text", "n_chars", n, dropped)
    return out.withColumn("text", F.col(kept)).withColumn("n_chars", F.length(kept).cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by shingles."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Rows are told apart by their texts, so null and repeated ids take no clean row along."""
    key = fresh(docs, "_hash")
    own = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    found = find_leaks(docs.withColumn(key, own), table(spark, sf_dir, "benchmark"), id_col=key)
    return rows_without(docs, own, stash(found.select(F.col(key).alias("id")).distinct(), "leaks"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document."""
    return encode_column(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("SentencePiece encoding and decoding", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
