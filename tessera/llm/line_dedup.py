"""Line dedup over batches: levelled sorted runs of line hashes, compacted now and then.

A line's key is the line without blanks at both ends, A-Z lower-cased. Each batch of documents (in ascending order of id) anti-joins the
runs written before it and adds its own new keys, with the smallest id that holds each, as one more sorted run; `fanout` runs of a level
become one of the next. A line goes if its key has at least `min_chars` code points and a document with a smaller id holds it.

Runs are bucketed by key and sorted within buckets, one file a bucket, so that a batch is merged with them where they lie: only the batch is
dealt out and sorted, never a run, and runs are merged bucket by bucket. A store has a folder and a manifest: `SortedRuns.open` takes it up again for
batches to come. The manifest is written after a new run and before old ones are deleted, so that a driver's loss costs at most a run not yet named.

Null text counts as empty (one empty line). Null ids sort last and count as one document. Rows that repeat an id belong to one document:
their lines do not remove each other. Empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, delete_path, drop_stash, fresh, hash128, lower_ascii, read_text, shared_dir, shuffle_width, stash, strip_blanks, write_text

KEY = ["h1", "h2"]
_RUN = "h1 BIGINT, h2 BIGINT, first BIGINT"


@contextmanager
def reading_sorted(spark: SparkSession) -> Iterator[None]:
    """Buckets of one file each are taken as sorted while a plan is made."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SortedRuns:
    """First holders of line hashes: sorted runs in levels, each run disjoint from all others."""

    def __init__(self, spark: SparkSession, fanout: int = 2, path: str | None = None, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.path = path or f"{shared_dir(spark)}/tessera/runs-{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_width(spark)

    @classmethod
    def open(cls, spark: SparkSession, path: str, fanout: int = 2) -> SortedRuns:
        """A store written before."""
        held = json.loads(read_text(spark, f"{path}/manifest.json"))
        store = cls(spark, fanout, path, held["buckets"])
        store.levels = {int(k): v for k, v in held["levels"].items()}
        return store

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = name.replace("-", "_")
        with reading_sorted(self.spark):
            rows.select(*KEY, "first").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return name

    def _read(self, name: str) -> DataFrame:
        table = f"read_{uuid.uuid4().hex}"
        keys = ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE {table} ({_RUN}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        out = self.spark.table(table)
        out.schema  # noqa: B018  resolved before the name goes
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def runs(self) -> list[DataFrame]:
        return [self._read(r) for level in sorted(self.levels) for r in self.levels[level]]

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, id. Keys that no run holds become a new run of level 0."""
        new = batch.groupBy(*KEY).agg(F.min("id").alias("first"))
        for run in self.runs():
            new = new.join(run.select(*KEY), KEY, "left_anti")
        self.levels.setdefault(0, []).append(self._write(new))
        old = []
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old += self._merge(level, self.levels[level])
            level += 1
        self._note(old)

    def _merge(self, level: int, names: list[str]) -> list[str]:
        """Runs into one of the next level, bucket by bucket. They are disjoint: each key is in one of them."""
        merged, *others = (self._read(n) for n in names)
        for r in others:
            r = r.withColumnRenamed("first", "other")
            merged = merged.join(r, KEY, "full_outer").select(*KEY, F.coalesce("first", "other").alias("first"))
        self.levels[level] = []
        self.levels.setdefault(level + 1, []).append(self._write(merged))
        return names

    def _note(self, old: list[str]) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"buckets": self.buckets, "levels": self.levels}))
        for name in old:
            delete_path(self.spark, f"{self.path}/{name}")

    def all(self) -> DataFrame:
        """All runs as one, merged first if there are several."""
        names = [r for level in sorted(self.levels) for r in self.levels[level]]
        if len(names) > 1:
            top = max(self.levels)
            old = self._merge(top, names)
            self.levels = {k: v if k == top + 1 else [] for k, v in self.levels.items()}
            self._note(old)
        return self.runs()[0]

    def held(self) -> DataFrame:
        """All runs as one, without their buckets: joined by Spark's own exchange, whose skewed partitions it may split."""
        self.all()
        (name,) = (r for level in self.levels.values() for r in level)
        return self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}")


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, th (hash of the text), pos, h1, h2 of every line whose key is long enough."""
    lines = docs.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.withColumn("key", lower_ascii(strip_blanks(F.col("line")))).filter(F.length("key") >= min_chars)
    h1, h2 = hash128(F.col("key"))
    return keys.select("id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, store: SortedRuns | None = None, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """The rows of docs with n_lines, n_dropped and kept (the remaining lines joined by a line feed; of a null text, empty).

    names: of the added columns, where docs have such columns already. store: runs of documents seen before, whose ids are smaller; what docs hold anew is added to it. Without one, docs stand alone.
    """
    own_store = store is None
    ident, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"), F.col(text_col).isNull().alias("no_text"), ident.alias("id"), text.alias("text"))
    lines = stash(lines_of(base.select("id", "text"), min_chars), "lines")
    cuts = lines.select(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    store = store or SortedRuns(docs.sparkSession, fanout)
    for low, high in zip(edges, edges[1:], strict=False):
        part = lines
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        store.add(part.select("id", *KEY))
    # a line may stand in a third of all rows: here both sides are dealt out, so that such a key's rows can be split
    late = lines.join(store.held(), KEY).filter("first < id")
    gone = stash(late.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    drop_stash(lines)
    if own_store:
        delete_path(docs.sparkSession, store.path)
    th, every, left, n, k, kept = (fresh(docs, c) for c in ("_th", "_every", "_left", "_n", "_k", "_kept"))
    row, no_text, text = (fresh(docs, c) for c in ("_row", "_no_text", "_text"))
    out = base.withColumnsRenamed({"rest": row, "no_text": no_text, "text": text}).withColumn(th, F.xxhash64(text))
    out = out.join(gone.withColumnRenamed("th", th), ["id", th], "left").withColumn(every, F.split(text, "\n"))
    out = out.withColumn(left, F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("gone"))))
    whole = F.when(F.col(left).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n"))
    out = out.select(row, no_text, text, F.size(every).cast("long").alias(n), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(k), whole.alias(kept))
    own = [F.when(~F.col(no_text), F.col(text)).alias(c) if c == text_col else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]
    return out.select(*own, *[F.col(c).alias(new) for c, new in zip((n, k, kept), names, strict=True)])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id_col, n_lines, n_dropped, kept."""
    return dedup_rows(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, **options).drop(text_col)
