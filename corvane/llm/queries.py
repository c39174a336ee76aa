"""One query for each training-data operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bm25, langid, minhash, mixing, packing, quality, runs, sharding, suffixes, warc, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op2_substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.remove_repeated_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op6_bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search_similar(_table(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffixes.remove_repeated_strings(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"), keep_groups=False).drop("groups")


def op12_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.collapse_runs(runs.planted_runs(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_ann_posting_lists, op2_substring_windows, op3_minhash_hamming, op4_warc_index, op5_language_hd, op6_bm25_block_max, op7_suffix_repeats, op8_best_fit_packing, op9_histogram_sharding, op10_source_mixing, op11_token_alignment, op12_attention_quality, op13_lyndon_runs)}

def _crc_table() -> str:
    """The 256 steps of CRC-32, made from its polynomial, as an SQL list."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return str(table)


SQL = {
    "op2_substring_windows": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d
        ), win AS (
            SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS x FROM starts
        ), firsts AS (
            SELECT x, min(doc_id * 100000000 + s) AS earliest FROM win GROUP BY x
        ), removed AS (
            SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS pos FROM win JOIN firsts USING (x) WHERE doc_id * 100000000 + s > earliest
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d
        ), kept AS (
            SELECT words.doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN removed USING (doc_id, pos) GROUP BY words.doc_id
        ), gone AS (
            SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op3_minhash_hamming": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d
        ), items AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)""",
    "op4_warc_index": r"""
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(coalesce(html, '')) AS hex FROM pages
        ), bits AS (
            SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS b FROM p
        ), named AS (
            SELECT page_id, raw, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * CAST(substr(b, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(b, i * 5 + 2, 1) AS INT) + 4 * CAST(substr(b, i * 5 + 3, 1) AS INT)
                + 2 * CAST(substr(b, i * 5 + 4, 1) AS INT) + CAST(substr(b, i * 5 + 5, 1) AS INT) AS BIGINT), 1)), '') AS digest FROM bits
        ), firsts AS (
            SELECT *, min(page_id) OVER (PARTITION BY raw) AS first FROM named
        )
        SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts""",
    "op6_bm25_block_max": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), n AS (
            SELECT count(*) AS n, avg(len(w)) AS mean FROM d
        ), tf AS (
            SELECT doc_id, len AS len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY ALL
        ), df AS (
            SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term, n
        ), hits AS (
            SELECT q.doc_id AS query_id, tf.doc_id, floor(sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.len / mean))) * 1e6 + 0.5) / 1e6 AS score
            FROM tf q JOIN df USING (term) JOIN tf ON tf.term = q.term, n WHERE q.doc_id % 50 = 0 GROUP BY ALL
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM hits
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10""",
    "op7_suffix_repeats": r"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), parts AS (
            SELECT doc_id, base, substr(h, 2 * base + 1, 2 * 1099) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 1000)) AS base FROM d)
        ), win AS (
            SELECT doc_id, base + i AS s, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, base, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM parts)
        ), firsts AS (
            SELECT x, min(doc_id * 100000000 + s) AS earliest FROM win GROUP BY x
        ), removed AS (
            SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS fresh FROM win JOIN firsts USING (x) WHERE doc_id * 100000000 + s > earliest
        ), numbered AS (
            SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM removed
        ), spans AS (
            SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM numbered GROUP BY doc_id, span
        ), gaps AS (
            SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM spans
            UNION ALL SELECT doc_id, coalesce(max(spans.hi), 0), max(len(h)) // 2 FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo, hi) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
        ), gone AS (
            SELECT doc_id, count(*) AS n, sum(hi - lo) AS bytes FROM spans GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op13_lyndon_runs": r"""
        WITH h AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
                lambda s, c: xor(s >> 8, CAST(CRC AS BIGINT[])[1 + (xor(s, c) & 255)])) AS r FROM documents
        ), g AS (
            SELECT doc_id, w, len(w) AS n, xor(r, 4294967295) AS h, xor(r, 4294967295) // 10 AS g FROM h
        ), a AS (
            SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM g
        ), d AS (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM a
        ), six AS (  -- a run of 12 words or more has at least six neighbouring words that its period repeats
            SELECT doc_id, i, hash(w[i + 1:i + 6]) AS x FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d)
        ), pairs AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.x = y.x AND x.i < y.i
        ), marked AS (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM pairs
        ), ends AS (
            SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM marked GROUP BY doc_id, q, stretch HAVING count(*) + 5 + q >= greatest(12, 2 * q)
        ), runs AS (
            SELECT doc_id, start, length, min(q) AS period FROM ends GROUP BY ALL
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        ), listed AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS r, arg_min(struct_pack(s := start, l := length, p := period), struct_pack(l := -length, s := start, p := period)) AS b FROM runs GROUP BY doc_id
        )
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""".replace("CRC", _crc_table()),
}
