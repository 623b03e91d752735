"""Queries over the text tables: name -> (spark, sf_dir) -> DataFrame, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrec.llm import exact_dedup, filter_audit, html_extract, langid, mixing, order_minhash, packing, pfp_dedup, prefix_trie, sentencepiece_bpe, simhash, url_filter, warc
from segrec.llm.common import scratch_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pfp_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decisions(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_read(spark, sf_dir, "documents"))
    return packing.pack(pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    rows = warc.read(spark, path)
    # responses are digested anew from what was read; a revisit tells its payload's digest, a broken record none
    digest = F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.sha1("payload"))
    return rows.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        digest.alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.components(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.fingerprint_edits(_read(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        order_minhash.as_text(F.col("signature")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = langid.annotate(docs.select("doc_id", "text"), langid.train(docs))
    return rows.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.annotate(_read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), carry_text=False)
    return rows.select("__row.doc_id", "__row.source", "__row.lang", "topic", "tokens", "probability", "residual", "kept")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(_read(spark, sf_dir, "documents")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_order_minhash": op7_order_minhash,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_html_extraction": op10_html_extraction,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_warc": """
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN octet_length(encode(html)) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN octet_length(encode(html)) >= 1000 AND page_id IS DISTINCT FROM max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) WINDOW g AS (PARTITION BY html)""",
    "op11_filter_audit": r"""
        WITH split AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        told AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        failing AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN split.doc_id > min(split.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
            FROM split LEFT JOIN told ON told.doc_id = split.doc_id),
        cells AS (SELECT part, good, toxic, mask, count(*) AS n FROM failing GROUP BY ALL),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(name, bit)),
        orders AS (
            SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        steps AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
            FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        counted AS (
            SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM counted""",
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        heads AS (  -- CRC-32 of the decimal number, bit by bit
            SELECT c, c - c % 20 AS head, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 4 AS h
            FROM (SELECT DISTINCT c FROM t)),
        parts AS (
            SELECT heads.c, 0 AS own, pos, role, text FROM heads JOIN t ON t.c = head AND pos < h
            UNION ALL SELECT heads.c, 1, pos, role, text FROM heads JOIN t ON t.c = heads.c AND pos >= h),
        turns AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, md5(length(role) || ':' || role || text) AS said,
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM parts),
        paths AS (
            SELECT c, d, words, string_agg(said, '') OVER (PARTITION BY c ORDER BY d) AS path FROM turns
            UNION ALL SELECT c, 0, 0, '' FROM heads),
        nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY path, d),
        whole AS (SELECT max(d) AS d, max_by(path, d) AS path, c FROM paths GROUP BY c),
        ends AS (SELECT path, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS numbers FROM whole GROUP BY path, d),
        children AS (SELECT left(path, 32 * (d - 1)::INT) AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
        full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, d)),
        above AS (SELECT x.*, unnest(range(0, d + 1)) AS top FROM full_nodes x),
        sums AS (
            SELECT left(path, 32 * top::INT) AS path, top AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
            FROM above GROUP BY ALL)
        SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(numbers, '')) AS ends_sha256
        FROM full_nodes x JOIN sums USING (path, d) LEFT JOIN ends USING (path, d)
        LEFT JOIN nodes up ON up.d = x.d - 1 AND up.path = left(x.path, 32 * (x.d - 1)::INT)""",
}
