"""N-gram Jaccard join: a blocked sparse product of documents by n-grams, with bounds that follow from set sizes.

Sets of 5-word shingles (64-bit hashes) are first reduced to classes of equal sets. A pair of sets with Jaccard similarity s >= 0.8 shares an
n-gram among the first `n - ceil(s * n) + 1` of each under any common order, so only those columns of the incidence matrix enter the
product. The order puts n-grams that many documents hold last (commonest at the very end), so a common passage is no candidate by itself.
Columns are dealt over the cluster by n-gram. Of a pair of a and b <= a n-grams, an overlap of o = ceil(s * (a + b) / (1 + s)) is asked for, so the
first a - o + 1 and b - o + 1 n-grams already share one: the product multiplies out only those places, which for the smaller set is about half of
its columns. The overlap of a pair found so is then accumulated over all of its leading n-grams, and the pair is dropped when that sum plus all that
may be shared behind them stays below o. What is left is verified on whole sets.

Columns of at most LIGHT classes are multiplied out at once. A column that more classes share is not, before it has linked its classes to one
hub: the class that shares most of its leading n-grams with others (a few rounds with new hubs; verified links join components). Then only pairs of different components of such a column are multiplied
out and bounded; of each component, the pair that shares most is verified first, and the others only where such pairs did not join them. So every
link between different components is found and components are exact. That leaves out links inside a component; with `count_links`, every column
is multiplied out and every link verified and counted (the work grows with the square of a group of near copies).

Rounds that have no pairs or columns left are not planned, and between rounds the driver gives back what ended queries held.

N-grams known to be in very many documents are dealt by n-gram and class, never gathered in one task.

Rows: `components` gives one row per input row. Null, empty and blank texts have no set, link with nothing and are their own component.
Repeated rows are members of one class. Null ids sort last (a component of nothing else has a null id). Empty tables give empty results. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, Words, blocks_of_texts, release_driver, release_memory, shingle_hashes, stash
from .suffix_dedup import part as split_by_ids
from .suffix_dedup import rows_without

WORDS, PERCENT = 5, 80
#: N-grams that the common order puts last: at most this many (2 MB for every task), from this many documents on.
MOST_COMMON, COMMON_FROM = 1 << 18, 16
#: Rounds of linking columns to hubs before pairs of components are multiplied out.
HUB_ROUNDS = 2
#: Columns of at most this many classes are multiplied out at once.
LIGHT = 8
#: Columns of n-grams that at least so many documents hold are not gathered to be counted.
HOT = 1024
#: Rounds in which only the best pair of each component is verified.
BEST_ROUNDS = 2
#: Places among the leading n-grams are kept in so many steps.
STEPS = 16
#: Bytes of text whose sets are made at once, and n-grams of sets that are counted at once.
BLOCK, COUNTED = 1 << 18, 1 << 22


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of every text."""
    w = Words(texts)
    h, owner = shingle_hashes(w.hash, w.first, words)
    if (np.diff(owner) < 0).any():  # short texts come last
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    out = []
    for part in np.split(h, np.searchsorted(owner, np.arange(1, len(texts)))):
        part.sort()
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        out.append(part[new])
    return out


def class_of(hashes: np.ndarray) -> int:
    """A 64-bit name of the set."""
    from .common import mix64

    if not len(hashes):
        return 0
    with np.errstate(over="ignore"):
        s = np.array([np.add.reduce(mix64(hashes)) + np.uint64(len(hashes)) * np.uint64(0x9E3779B97F4A7C15)])
    return int(mix64(s).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def base_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (UTF-8 bytes)."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, sets) of rows whose texts come to about BLOCK bytes."""
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for a, b, texts in blocks_of_texts(batch.column("text"), BLOCK):
            yield ids[a:b], shingle_sets(texts)
    release_memory()


def rows_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def members_and_counts(base: DataFrame) -> DataFrame:
    """kind 0: id, c (class), n (set size) of a row. kind 1: c (an n-gram), n (documents, of those read together, that hold it, from 2)."""

    def counted(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(list(sets.values())))
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(edge, len(h)))
        many = count > 1
        k = int(many.sum())
        return rows_of(kind=np.ones(k, np.int32), id=np.zeros(k, np.int64), c=h[edge[many]].view(np.int64), n=count[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0
        for ids, sets in blocks_of(batches):
            names, sizes = [class_of(h) for h in sets], [len(h) for h in sets]
            for c, h in zip(names, sets, strict=True):
                if len(h) and c not in held:
                    held[c] = h
                    total += len(h)
            yield rows_of(kind=np.zeros(len(ids), np.int32), id=ids, c=np.array(names, np.int64), n=np.array(sizes, np.int64))
            if total > COUNTED:
                yield counted(held)
                held, total = {}, 0
        if held:
            yield counted(held)

    return base.mapInArrow(run, "kind int, id long, c long, n long")


def columns_of(base: DataFrame, common: np.ndarray, counts: np.ndarray, percent: int) -> DataFrame:
    """g, c, n, q, hot: the leading n-grams of every class, with their place in steps and whether at least HOT documents hold them.

    common: n-grams in ascending count, which come after all others; counts: how many documents hold each.
    """
    order = np.argsort(common, kind="stable")
    shared = base.sparkSession.sparkContext.broadcast((common[order], order.astype(np.int32), counts[order] >= HOT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, many = shared.value
        seen: set[int] = set()
        for _, sets in blocks_of(batches):
            rows = []
            for h in sets:
                name = class_of(h)
                if not len(h) or name in seen:
                    continue
                if len(seen) < 100_000:  # only saves work: a class twice is one class later
                    seen.add(name)
                hot = np.zeros(len(h), bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    late = known[at] == h
                    last = at[late][np.argsort(rank[at[late]], kind="stable")]
                    h = np.concatenate([h[~late], known[last]])
                    hot[len(h) - len(last) :] = many[last]
                p = prefix_length(len(h), percent)
                rows.append((h[:p].view(np.int64), np.full(p, name, np.int64), np.full(p, len(h), np.int64), (np.arange(p) * STEPS // p).astype(np.int8), hot[:p]))
            if rows:
                yield rows_of(**dict(zip(("g", "c", "n", "q", "hot"), map(np.concatenate, zip(*rows, strict=True)), strict=True)))

    return base.mapInArrow(run, "g long, c long, n long, q byte, hot boolean")


def sets_of(base: DataFrame) -> DataFrame:
    """c, s: the whole set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in blocks_of(batches):
            edges = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
            yield rows_of(c=np.array([class_of(h) for h in sets], np.int64), s=pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(sets).view(np.int64))))

    return base.mapInArrow(run, "c long, s array<long>")


def fits(a: str, b: str, percent: int):
    """Sizes of which the smaller is at least `percent` of the larger."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs whose sets reach the similarity."""
    both = pairs.join(sets.select(F.col("c").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("c").alias("y"), F.col("s").alias("sy")), "y")
    both = both.withColumn("i", F.size(F.array_intersect("sx", "sy")))
    return both.filter(F.col("i") * 100 >= (F.size("sx") + F.size("sy") - F.col("i")) * percent).select("x", "y")


def connected(links: DataFrame) -> DataFrame:
    """c, comp of every class in links: the least label spreads over links, then labels follow their label, until nothing changes."""
    edges = stash(links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct(), "edges")
    labels = stash(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("c").alias("b"), "comp"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "c").select("c", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("c").alias("next"), F.col("comp").alias("far"))
        step = stash(step.join(jump, "next", "left").select("c", F.least("next", F.coalesce("far", "next")).alias("comp"), "was"), "labels")
        if step.filter("comp <> was").isEmpty():
            return step.select("c", "comp")
        labels = step.select("c", "comp")


def shared_columns(columns: DataFrame) -> DataFrame:
    """g, c, n, q, m: the columns that at least two classes hold, with their number of classes. One exchange, by column; of hot columns by class as well."""
    by, key = Window.partitionBy("g", "part"), ["g", "part", "c", "n", "q", "hot"]
    dealt = columns.withColumn("part", F.when(F.col("hot"), F.col("c")).otherwise(0))
    several = dealt.withColumn("lo", F.min("c").over(by)).withColumn("hi", F.max("c").over(by)).filter("hot or lo < hi")
    counted = several.groupBy(*key).agg(F.lit(1).alias("one")).withColumn("m", F.when(F.col("hot"), HOT).otherwise(F.count(F.lit(1)).over(by)))
    return counted.select("g", "c", "n", "q", "m")


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """How many n-grams sets of a and b must share."""
    return F.ceil((a + b) * percent / (100 + percent))


def could_reach(shared: Column, percent: int) -> Column:
    """Whether n-grams known to be shared among the leading ones, and all behind those, suffice for sets of nx and ny n-grams."""
    rest = F.greatest(F.ceil(F.col("nx") * percent / 100), F.ceil(F.col("ny") * percent / 100)) - 1
    return (shared + rest) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent


def products(left: DataFrame, right: DataFrame, keep: Column, percent: int) -> DataFrame:
    """x, y: pairs that share a column where sets of their sizes must share one. left: g, x, nx, qx, ...; right: g, y, ny, qy, ..."""
    least = least_overlap(F.col("nx"), F.col("ny"), percent)

    def early(n: str, q: str) -> Column:
        """The place may be among the first n - least + 1."""
        return F.col(q) * (F.col(n) - F.ceil(F.col(n) * percent / 100) + 1) < STEPS * (F.col(n) - least + 1)

    both = left.join(right, "g").filter(keep & fits("nx", "ny", percent) & early("nx", "qx") & early("ny", "qy"))
    return both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def as_left(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("g", F.col("c").alias("x"), F.col("n").alias("nx"), F.col("q").alias("qx"), *more)


def as_right(df: DataFrame, *more: Column) -> DataFrame:
    return df.select("g", F.col("c").alias("y"), F.col("n").alias("ny"), F.col("q").alias("qy"), *more)


def bounded(pairs: DataFrame, leading: DataFrame, percent: int) -> DataFrame:
    """x, y, k: the pairs whose overlap among all leading n-grams, k, leaves the similarity open. leading: c, n, gs."""
    for side in ("x", "y"):
        pairs = pairs.join(leading.select(F.col("c").alias(side), F.col("n").alias("n" + side), F.col("gs").alias("g" + side)), side)
    sums = pairs.withColumn("k", F.size(F.array_intersect("gx", "gy")))
    return sums.filter(fits("nx", "ny", percent) & could_reach(F.col("k"), percent)).select("x", "y", "k")


def links_of(base: DataFrame, members: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> DataFrame | None:
    """x, y: verified links between classes that hold together every component; None if there are none."""
    shared = stash(shared_columns(columns_of(base, *common, percent)), "shared")
    light, heavy = shared.filter(F.col("m") <= LIGHT), shared.filter(F.col("m") > LIGHT)
    leading = stash(shared.groupBy("c", "n").agg(F.collect_list("g").alias("gs")), "leading")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    held = heavy.join(leading.select("c", F.floor(F.size("gs") * STEPS / prefix).alias("share")), "c")
    links, labels = None, None

    def label(df: DataFrame, column: str, name: str) -> DataFrame:
        if labels is None:
            return df.withColumn(name, F.col(column))
        return df.join(labels.select(F.col("c").alias(column), F.col("comp").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def open_columns() -> DataFrame:
        """g, c, n, q, comp of the heavy columns that more than one component shares."""
        own = label(held, "c", "comp")
        several = own.groupBy("g").agg(F.min("comp").alias("p"), F.max("comp").alias("q_")).filter("p <> q_").select("g")
        return stash(own.select("g", "c", "n", "q", "share", "comp").join(several, "g"), "open")

    def hub_pairs(todo: DataFrame, k: int) -> DataFrame:
        rank = F.struct("share", F.xxhash64("comp", F.lit(k)).alias("r"), F.xxhash64("c", F.lit(k)).alias("s"), "c", "n", "comp")
        hub = todo.groupBy("g").agg(F.max(rank).alias("hub"))
        pairs = todo.join(hub, "g").filter("comp <> hub.comp").withColumn("hn", F.col("hub.n")).filter(fits("n", "hn", percent))
        return pairs.select(F.least("hub.c", "c").alias("x"), F.greatest("hub.c", "c").alias("y")).distinct()

    def add(pairs: DataFrame) -> bool:
        """Verifies pairs that the bound left open. pairs: x, y."""
        nonlocal links, labels
        pairs = stash(pairs.select("x", "y"), "pairs")
        release_driver(base.sparkSession)
        if pairs.isEmpty():
            return False
        ends = pairs.select(F.col("x").alias("c")).unionAll(pairs.select(F.col("y").alias("c"))).distinct()
        needed = stash(ends.join(members.groupBy("c").agg(F.min("id").alias("id")), "c").select("id").distinct(), "needed")
        maybe, _ = split_by_ids(base, needed)
        new = stash(verified(pairs, sets_of(maybe.join(needed, "id", "left_semi")), percent).distinct(), "links")
        release_driver(base.sparkSession)
        if new.isEmpty():
            return False
        links = new if links is None else links.unionByName(new)
        labels = connected(links)
        return True

    # columns of few classes are multiplied out; those of many link to hubs first
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    added = add(bounded(products(as_left(light), as_right(light), larger, percent).unionByName(hub_pairs(open_columns(), 0)).distinct(), leading, percent))
    for k in range(1, HUB_ROUNDS) if added else ():
        if not add(bounded(hub_pairs(open_columns(), k), leading, percent)):
            break
    # the component with most classes in a column meets the others; the others meet one another
    todo = open_columns()
    if todo.isEmpty():
        return links
    per = todo.groupBy("g", "comp").count()
    major = per.groupBy("g").agg(F.max(F.struct("count", "comp")).alias("m")).select("g", F.col("m.comp").alias("major"))
    others = as_left(todo.join(major, "g").filter("comp <> major"), F.col("comp").alias("cx"), F.col("major"))
    ally = as_right(todo, F.col("comp").alias("cy"))
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("major")) | (F.col("x") < F.col("y")))
    left = stash(bounded(products(others, ally, apart, percent), leading, percent), "left")
    release_driver(base.sparkSession)
    if left.isEmpty():
        return links
    # of each component, first the pair that shares most
    for _ in range(BEST_ROUNDS):
        own = stash(label(label(left, "x", "cx"), "y", "cy").filter("cx <> cy"), "own")
        ends = own.select(F.explode(F.array("cx", "cy")).alias("comp"), "k", "x", "y")
        tried = stash(ends.groupBy("comp").agg(F.max(F.struct("k", "x", "y")).alias("best")).select("best.x", "best.y").distinct(), "best")
        left = stash(own.select("x", "y", "k").join(tried, ["x", "y"], "left_anti"), "left")
        if not add(tried) or left.isEmpty():
            break
    add(label(label(left, "x", "cx"), "y", "cy").filter("cx <> cy"))
    return links


def every_link(base: DataFrame, members: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> DataFrame | None:
    """x, y: all verified links between classes, those inside a component too; None if there are none."""
    shared = stash(shared_columns(columns_of(base, *common, percent)), "shared")
    leading = stash(shared.groupBy("c", "n").agg(F.collect_list("g").alias("gs")), "leading")
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    pairs = stash(bounded(products(as_left(shared), as_right(shared), larger, percent), leading, percent).select("x", "y"), "pairs")
    needed = pairs.select(F.col("x").alias("c")).unionAll(pairs.select(F.col("y").alias("c"))).distinct().join(members.groupBy("c").agg(F.min("id").alias("id")), "c").select("id").distinct()
    links = stash(verified(pairs, sets_of(base.join(needed, "id", "left_semi")), percent).distinct(), "links")
    return None if links.isEmpty() else links


def common_ngrams(counts: DataFrame, most: int = MOST_COMMON, least: int = COMMON_FROM) -> tuple[np.ndarray, np.ndarray]:
    """The commonest n-grams in ascending count, and their counts: only an order, so the bound costs no result."""
    top = counts.groupBy("c").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "c").limit(most).toPandas()
    if not len(top):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return top["c"].to_numpy(dtype=np.int64)[::-1].view(np.uint64).copy(), top["n"].to_numpy(dtype=np.int64)[::-1].copy()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """id_col, n_shingles, class_id, component_id of every row; with count_links n_links, the number of all other classes that link to the row's class."""
    base = base_of(docs, id_col, text_col)
    found = stash(members_and_counts(base), "members")
    release_driver(base.sparkSession)
    members = found.filter("kind = 0").select("id", "c", "n")
    links = (every_link if count_links else links_of)(base, members.filter("n > 0"), common_ngrams(found.filter("kind = 1")), percent)
    classes = members.filter("n > 0").groupBy("c").agg(F.min("id").alias("class_id"))
    if links is None:
        classes = classes.withColumn("component_id", F.col("class_id")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        classes = classes.join(connected(links), "c", "left")
        if count_links:
            ends = links.select(F.col("x").alias("c")).unionAll(links.select(F.col("y").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
            classes = classes.join(ends, "c", "left")
        classes = stash(classes, "classes")
        tops = classes.filter("comp is not null").groupBy("comp").agg(F.min("class_id").alias("top"))
        classes = classes.join(tops, "comp", "left").select("c", "class_id", F.coalesce("top", "class_id").alias("component_id"), *(["n_links"] if count_links else []))
    out = members.join(classes, "c", "left")
    extra = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    name = lambda c: F.when(F.coalesce(c, "id") != NO_ID, F.coalesce(c, "id"))
    return out.select(name("id").alias(id_col), F.col("n").alias("n_shingles"), name("class_id").alias("class_id"), name("component_id").alias("component_id"), *extra)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose id is their component's least (all rows of that id). Rows with a null id stay: nothing tells them apart."""
    own = components(docs, id_col, text_col, percent).select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id"), F.coalesce("component_id", F.lit(NO_ID)).alias("least"))
    late = stash(own.filter((F.col("least") < F.col("id")) & (F.col("id") != NO_ID)).select("id").distinct(), "late")
    return rows_without(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), late)
