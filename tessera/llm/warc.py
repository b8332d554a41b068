"""WARC fixity: Merkle trees over records and ordered offset ranges, compared between replicas.

A leaf hashes one record with its place (file, offset, length). `fanout` neighbours in order make a node, whose hash covers its children's
hashes in order and the offset range from the first child's start to the last child's end; a file's nodes end in one, files go on to one
root a replica. An audit compares the roots and descends only into nodes that differ, so what it reads follows the damage, not the archive.
A replica that was laid anew without a record, or with one more, differs in all places behind it: the records of the leaves that are left open are
therefore matched within their file by what they are, first by id and content, then by id, so that only those that really differ are named.
All steps are DataFrame functions; no node is made of more than `fanout` children.

Rows: `audit` gives one row for each record that differs, is missing or is extra, and on demand for each that lies elsewhere. Null urls leave out the target line, null payloads are
empty, records with null ids are dealt to files by their content and come first there. Records that repeat an id follow one another in order of url and payload; of a null id, a record that differs
is one missing and one extra. Equal replicas and empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Records with ids of one file's range, and children of a node.
IDS_PER_FILE, FANOUT = 256, 16
#: Files to which records without an id are dealt.
FILES_WITHOUT_ID = 4096
CRLF = "\r\n"


def record_of(url: Column, payload: Column) -> Column:
    """The bytes of a WARC response record."""
    n = F.octet_length(F.coalesce(payload, F.lit("")))
    name = F.md5(F.encode(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))), "UTF-8"))
    uid = F.concat_ws("-", *[F.substring(name, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.0" + CRLF + "WARC-Type: response" + CRLF), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit(CRLF)), F.lit("")),
        F.lit("WARC-Record-ID: <urn:uuid:"), uid, F.lit(">" + CRLF + "Content-Type: text/html" + CRLF + "Content-Length: "), n.cast("string"), F.lit(CRLF + CRLF),
    )
    return F.encode(F.concat(head, F.coalesce(payload, F.lit("")), F.lit(CRLF + CRLF)), "UTF-8")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """file, ord, offset, length, id, record: the records of an archive, laid end to end in each file."""
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    base = base.select("id", record_of(F.col("url"), F.col("payload")).alias("record"))
    without = F.pmod(F.xxhash64("record"), F.lit(FILES_WITHOUT_ID)) + 1
    base = base.select(F.coalesce(F.floor(F.col("id") / ids_per_file) + 1, without).alias("file"), "id", "record", F.octet_length("record").cast("long").alias("length"))
    order = Window.partitionBy("file").orderBy("id", "record")
    return base.select("file", (F.row_number().over(order) - 1).alias("ord"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """a (file), b (place in it), hash, content (the record's own hash), from_, to_, id of each record."""
    own = records.select("file", "ord", "offset", "length", "id", F.sha2("record", 256).alias("content"))
    place = F.concat_ws(":", "file", "offset", "length", "content")
    return own.select(F.col("file").alias("a"), F.col("ord").cast("long").alias("b"), F.sha2(F.encode(place, "UTF-8"), 256).alias("hash"), "content", F.col("offset").alias("from_"), (F.col("offset") + F.col("length")).alias("to_"), "id")


def parents(nodes: DataFrame, fanout: int, in_file: bool) -> DataFrame:
    a, b = (F.col("a"), F.floor(F.col("b") / fanout)) if in_file else (F.floor(F.col("a") / fanout), F.lit(0).cast("long"))
    rank = "b" if in_file else "a"
    own = F.array_sort(F.collect_list(F.struct(rank, "hash", "from_", "to_")))
    up = nodes.groupBy(a.alias("p"), b.alias("q")).agg(own.alias("own"))
    text = F.concat_ws("|", F.transform("own", lambda c: F.concat_ws(":", c["hash"], c["from_"], c["to_"])))
    return up.select(F.col("p").alias("a"), F.col("q").alias("b"), F.sha2(F.encode(text, "UTF-8"), 256).alias("hash"), F.get("own", F.lit(0))["from_"].alias("from_"), F.element_at("own", -1)["to_"].alias("to_"))


def tree(records: DataFrame, depth: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the root: depth[0] within files, depth[1] over files."""
    levels = [stash(leaves(records), "leaves")]
    for k in range(sum(depth)):
        levels.append(stash(parents(levels[-1], fanout, k < depth[0]), f"level{k + 1}"))
    return levels


def depth_of(*replicas: DataFrame, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels needed within files and over files, the same for all replicas."""
    tops = [r.agg(F.max("ord").alias("o"), F.max(F.abs("file")).alias("f")).first() for r in replicas]
    out = []
    for top in (max((t["o"] or 0) for t in tops), max((t["f"] or 0) for t in tops)):
        n = 0
        while top:
            top, n = top // fanout, n + 1
        out.append(n)
    return out[0], out[1]


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of one level that are not the same in both."""
    l = left.select("a", "b", F.col("hash").alias("l_hash"), *[F.col(c).alias("l_" + c) for c in left.columns if c not in ("a", "b", "hash")])
    r = right.select("a", "b", F.col("hash").alias("r_hash"), *[F.col(c).alias("r_" + c) for c in right.columns if c not in ("a", "b", "hash")])
    return l.join(r, ["a", "b"], "full_outer").filter(~F.col("l_hash").eqNullSafe(F.col("r_hash")))


def matched(odd: DataFrame, moved: bool) -> DataFrame:
    """Open leaves of both replicas, matched within a file by id and content, then by id."""
    fields = ("b", "content", "from_", "to_")
    sides = []
    for s in "lr":
        there = odd.filter(F.col(f"{s}_hash").isNotNull())
        nth = F.row_number().over(Window.partitionBy("a", f"{s}_id", f"{s}_content").orderBy("b"))
        sides.append(there.select("a", F.col(f"{s}_id").alias("id"), "b", *[F.col(f"{s}_{c}").alias(c) for c in fields[1:]], nth.alias("nth")))
    l, r = ([F.col(c).alias(f"{s}_{c}") for c in fields] for s in "lr")
    left, right = (x.select("a", "id", "nth", F.col("content").alias("k"), *cols) for x, cols in zip(sides, (l, r), strict=True))

    def both(x: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
        y = y.withColumnsRenamed({c: f"_{c}" for c in keys})
        rule = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        return x.join(y, rule, "full_outer").select(F.coalesce("a", "_a").alias("a"), F.coalesce("id", "_id").alias("id"), *[f"l_{c}" for c in fields], *[f"r_{c}" for c in fields])

    same = stash(both(left, right, "a", "id", "nth", "k"), "matched")
    again = []
    for s, other in ("lr", "rl"):
        rest = same.filter(F.col(f"{other}_content").isNull() & F.col("id").isNotNull())
        again.append(rest.select("a", "id", *[f"{s}_{c}" for c in fields], F.row_number().over(Window.partitionBy("a", "id").orderBy(f"{s}_b")).alias("nth")))
    out = both(*again, "a", "id", "nth").unionByName(same.filter("id is null and (l_content is null or r_content is null)"))
    if moved:
        out = out.unionByName(same.filter("l_content = r_content and l_from_ <> r_from_"))
    return out


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT, moved: bool = False) -> DataFrame:
    """file, ord, id, offset, length, kind (changed, missing, extra, moved), left_hash, right_hash (of records); left is the reference replica.

    Places, offsets and lengths are the left replica's, of extra records the right one's. moved: name records, too, that are whole but at another offset.
    """
    depth = depth_of(left, right, fanout=fanout)
    l, r = tree(left, depth, fanout), tree(right, depth, fanout)
    odd = differing(l[-1], r[-1])
    for k in range(sum(depth) - 1, -1, -1):
        a, b = (F.col("a"), F.floor(F.col("b") / fanout)) if k < depth[0] else (F.floor(F.col("a") / fanout), F.lit(0).cast("long"))
        open_ = odd.select(F.col("a").alias("p"), F.col("b").alias("q"))
        pick = lambda x, a=a, b=b, o=open_: x.withColumn("p", a).withColumn("q", b).join(o, ["p", "q"], "left_semi").drop("p", "q")
        odd = differing(pick(l[k]), pick(r[k]))
    odd = stash(odd, "open")
    drop_stash(*l, *r)
    found = matched(odd, moved)
    kind = F.when(F.col("r_content").isNull(), "missing").when(F.col("l_content").isNull(), "extra").when(F.col("l_content") == F.col("r_content"), "moved").otherwise("changed")
    start, end = F.coalesce("l_from_", "r_from_"), F.coalesce("l_to_", "r_to_")
    return found.select(F.col("a").alias("file"), F.coalesce("l_b", "r_b").alias("ord"), "id", start.alias("offset"), (end - start).alias("length"), kind.alias("kind"), F.col("l_content").alias("left_hash"), F.col("r_content").alias("right_hash"))


def read_records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, payload) of the records of a WARC file, in order."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        stop = end + 4 + n + 4
        if stop > len(data):
            raise ValueError(f"the record at byte {at} ends early")
        yield at, stop - at, head, data[end + 4 : end + 4 + n]
        at = stop


def read_files(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """path, offset, length, url, payload of every record of WARC files held in a binary column (as spark.read.format("binaryFile") gives)."""
    base = files.select(F.col(path_col).alias("path"), F.col(data_col).alias("content"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, a, n, h.get("warc-target-uri"), p) for a, n, h, p in read_records(data or b"")]
                for i in range(0, len(rows), 500):
                    cols = list(zip(*rows[i : i + 500], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["path", "offset", "length", "url", "payload"])

    return base.mapInArrow(run, "path string, offset long, length long, url string, payload binary")
