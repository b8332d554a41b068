"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .webp import store_texts

    return store_texts(table(spark, sf_dir, "documents"), keep_media=False)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: chr(9)..chr(13) and the blank.
_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DEDUPED_LINES = f"""
    lines AS (
        SELECT rid, doc_id, i, line, {_SQL_LOWER.format(f"trim(line, {_SQL_BLANKS})")} AS key
        FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
              FROM (SELECT rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM base))),
    held AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key),
    judged AS (
        SELECT l.rid, l.doc_id, l.i, l.line, coalesce(h.first < l.doc_id, false) AS gone
        FROM lines l LEFT JOIN held h ON l.key = h.key),
    kept AS (
        SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
        FROM judged GROUP BY rid)"""

ORACLES["op2_line_dedup"] = f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {_DEDUPED_LINES}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept
"""


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import components

    return components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLES["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(string_split_regex({_SQL_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reached AS (SELECT x AS a, y AS b FROM links UNION SELECT r.a, l.y FROM reached r JOIN links l ON l.x = r.b)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of the exact join is the URLs of the pages whose id is divisible by 50."""
    from .url_filter import filter_urls

    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, pages.filter("page_id % 50 = 0").select("url"))


ORACLES["op4_url_filters"] = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
    SELECT page_id, {_SQL_LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*\\?([^#]*)', 1) AS q FROM rest),
canon AS (
    SELECT page_id, host, path,
           regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || '?' ||
           array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT (starts_with(p, 'utm_') OR starts_with(p, 'ref=')
               OR starts_with(p, 'fbclid=') OR starts_with(p, 'gclid=') OR starts_with(p, 'sessionid=')))), '&') AS canonical
    FROM parts),
listed AS (SELECT DISTINCT canonical FROM canon WHERE page_id % 50 = 0 AND host <> ''),
rules(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
    SELECT c.page_id, r.host || r.path AS rule, r.action,
           row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC) AS k
    FROM canon c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical, l.canonical IS NOT NULL AS listed
FROM canon c LEFT JOIN fits f ON f.page_id = c.page_id AND f.k = 1
LEFT JOIN listed l ON l.canonical = c.canonical AND c.host <> ''
"""


def crc_of_id(modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("id").cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op5_suffix_array_dedup"] = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS (SELECT doc_id, n, k, substr(x, 2 * k + 1, 2 * (256 + 49)) AS x FROM (SELECT *, unnest(range(0, n, 256)) AS k FROM bytes)),
places AS (SELECT doc_id, n, k, unnest(range(least(256, n - k))) AS j, x FROM parts),
strings AS (SELECT doc_id, k + j AS i, substr(x, 2 * j + 1, 2) AS b, CASE WHEN k + j + 50 <= n THEN substr(x, 2 * j + 1, 100) END AS s FROM places),
owners AS (SELECT s, min(doc_id) AS first FROM strings WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT t.doc_id, t.i, t.b, coalesce(o.first < t.doc_id, false) AS late FROM strings t LEFT JOIN owners o ON o.s = t.s),
covered AS (SELECT doc_id, i, b, bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM judged),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
           sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
    FROM edges GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM bytes b LEFT JOIN kept k ON k.doc_id = b.doc_id
"""


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs, crc = table(spark, sf_dir, "documents"), crc_of_id(3)
    model = fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", crc != 1)
    out = score_toxicity(docs, model).withColumn("id", F.col("doc_id"))
    return out.select("doc_id", (crc == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "sentences")


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_column

    return encode_column(table(spark, sf_dir, "documents"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score_quality

    docs, crc = table(spark, sf_dir, "documents"), crc_of_id(5)
    model = fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", crc != 0)
    out = score_quality(docs, model).withColumn("id", F.col("doc_id"))
    return out.select("doc_id", (crc == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` as an archive, audited against a replica in which a rule has flipped a byte of some records and lost others.

    The rule is applied to the first replica's bytes when the second is read, so that the pages stand on disk once.
    """
    from .common import stash
    from .warc import archive, audit

    left = stash(archive(table(spark, sf_dir, "pages")), "replica", free=True)
    sign = F.substring(F.md5(F.encode(F.col("id").cast("string"), "UTF-8")), 1, 2)
    flipped = F.concat(F.encode(F.lit("X"), "UTF-8"), F.expr("substring(record, 2)"))
    right = left.filter(~sign.eqNullSafe("7f")).withColumn("record", F.when(sign == "1c", flipped).otherwise(F.col("record")))
    return audit(left, right).select("file", "ord", F.col("id").alias("page_id"), "offset", "length", "kind")


ORACLES["op10_warc"] = """
WITH sized AS (
    SELECT page_id, page_id // 256 + 1 AS file,
           octet_length(encode(coalesce(html, ''))) AS n, octet_length(encode(coalesce(url, ''))) AS u, url IS NULL AS no_url
    FROM pages),
laid AS (
    -- fixed lines of the record, the target line, the digits of the length, the payload and the closing lines
    SELECT page_id, file,
           10 + 21 + CASE WHEN no_url THEN 0 ELSE 17 + u + 2 END + 26 + 36 + 3 + 25 + 16 + length(n::VARCHAR) + 4 + n + 4 AS length
    FROM sized),
placed AS (
    SELECT page_id, file, row_number() OVER w - 1 AS ord, sum(length) OVER w - length AS "offset", length, substr(md5(page_id::VARCHAR), 1, 2) AS sign
    FROM laid WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT file, ord, page_id, "offset"::BIGINT AS "offset", length, CASE sign WHEN '7f' THEN 'missing' ELSE 'changed' END AS kind
FROM placed WHERE sign IN ('7f', '1c')
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round is one table of all distances and one of the next entries."""
    steps = []
    for k in range(rounds + 1):
        nearest = f"""near{k} AS MATERIALIZED (
    SELECT vec_id, label, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT x.vec_id, x.label, x.p, x.v, c.e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.c[i]) * (x.v[i] - c.c[i]))) AS d
        FROM parts x JOIN books{k} c ON c.p = x.p) GROUP BY ALL)"""
        moved = f"""books{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN (
        SELECT p, e, list(s ORDER BY i) AS c FROM (
            SELECT p, e, i, CASE WHEN sum(y) >= 0 THEN sum(y) // count(*) ELSE -((count(*) - 1 - sum(y)) // count(*)) END::BIGINT AS s
            FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS i FROM near{k}) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
        steps += [nearest, moved] if k < rounds else [nearest]
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p)),
books0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)},
coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
    FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM books{rounds}) AS codebooks_sha256
FROM coded
"""


ORACLES["op11_vector_codes"] = _lloyd_sql()


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _crc_rule() -> str:
    """The table of remainders of CRC-32, by its rule, as a list."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return str(out)


ORACLES["op12_importance_resampling"] = f"""
WITH remainders AS (SELECT {_crc_rule()}::BIGINT[] AS t),
words AS (
    SELECT 0 AS side, doc_id, regexp_extract_all({_SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 1, NULL, regexp_extract_all({_SQL_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
runs AS (
    SELECT side, doc_id, unnest(w) AS f FROM words
    UNION ALL SELECT side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs)),
numbers AS (SELECT f, list_transform(range(len(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM bytes),
hashed AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[1 + xor(c & 255, y)])), 4294967295) % 10000 AS bucket FROM numbers, remainders),
placed AS MATERIALIZED (SELECT r.side, r.doc_id, h.bucket FROM runs r JOIN hashed h ON h.f = r.f),
totals AS (SELECT (count(*) FILTER (side = 0))::DOUBLE AS s, (count(*) FILTER (side = 1))::DOUBLE AS t FROM placed),
gains AS (
    SELECT bucket, floor(1000 * ln(((t1 + 1) * (s + 10000)) / ((s1 + 1) * (t + 10000))))::BIGINT AS gain
    FROM (SELECT bucket, (count(*) FILTER (side = 0))::DOUBLE AS s1, (count(*) FILTER (side = 1))::DOUBLE AS t1 FROM placed GROUP BY bucket), totals),
weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM placed JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(w.n, 0) AS n_features, CASE WHEN w.n IS NULL THEN 0 ELSE floor(w.total / w.n)::BIGINT END AS weight,
           ('0x' || substr(sha256('7:' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE AS h
    FROM words d LEFT JOIN weights w ON w.doc_id = d.doc_id WHERE d.side = 0),
final AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
placed_docs AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (n_words >= 20) OVER () AS able FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * able // 100 THEN r END AS rank FROM placed_docs
"""


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .window_dedup import dedup_windows

    out = dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), "longest")


def _doubling_sql(window: int = 13, levels: int = 14) -> str:
    steps = [f"""level0 AS MATERIALIZED (
    SELECT doc_id, i, s, first FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first, max(doc_id) OVER (PARTITION BY s) AS last
        FROM (SELECT doc_id, unnest(range(1, len(w) - {window - 2})) AS i, unnest(list_transform(range(1, len(w) - {window - 2}), lambda i: md5(array_to_string(w[i : i + {window - 1}], ' ')))) AS s
              FROM words WHERE len(w) >= {window})) WHERE first < last)"""]
    for k in range(1, levels):
        steps.append(f"""level{k} AS MATERIALIZED (
    SELECT doc_id, i, s, first FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first, max(doc_id) OVER (PARTITION BY s) AS last
        FROM (SELECT a.doc_id, a.i, md5(a.s || b.s) AS s FROM level{k - 1} a JOIN level{k - 1} b ON b.doc_id = a.doc_id AND b.i = a.i + {window << k - 1})) WHERE first < last)""")
    longest = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {window << k} AS n FROM level{k} WHERE first < doc_id" for k in range(levels))
    return f"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{", ".join(steps)},
longest AS (SELECT doc_id, max(n) AS n FROM ({longest}) GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
judged AS (
    SELECT p.doc_id, p.word, p.i, coalesce(bool_or(l.first < l.doc_id) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), false) AS gone
    FROM places p LEFT JOIN level0 l ON l.doc_id = p.doc_id AND l.i = p.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256, coalesce(l.n, 0) AS longest
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN longest l ON l.doc_id = d.doc_id
"""


ORACLES["op13_substring_dedup"] = _doubling_sql()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
