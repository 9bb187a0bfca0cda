"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geolith.llm import byte_bpe, chat, dac, decontaminate, filter_audit, fingerprints, language_id, line_dedup, minhash, quality, source_audit, substring_dedup, url_filter
from geolith.llm.common import read_table, shared_dir

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_lines(read_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    dac.write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return dac.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES_SCHEMA)
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_conversations(turns))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest_repeats(read_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergences(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_output": op3_token_output,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filter": op6_url_filter,
    "op7_chat_format": op7_chat_format,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_language_id": op12_language_id,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, lines[i] AS line, trim(lines[i], ' ') <> '' AS is_full
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS t(i)),
        n AS (SELECT *, CAST(sum(CASE WHEN is_full THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS k FROM l),
        run AS (
            SELECT doc_id, k, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS two FROM n WHERE is_full),
        copies AS (
            SELECT doc_id, k FROM (
                SELECT doc_id, k, row_number() OVER (PARTITION BY two ORDER BY doc_id, k) AS occurrence FROM run WHERE two IS NOT NULL)
            WHERE occurrence > 1),
        single AS (
            SELECT doc_id, k FROM (
                SELECT doc_id, k, row_number() OVER (PARTITION BY line ORDER BY doc_id, k) AS occurrence FROM n
                WHERE is_full AND len(list_filter(string_split(line, ' '), lambda w: w <> '')) >= 5)
            WHERE occurrence > 1),
        gone AS (SELECT doc_id, k FROM copies UNION SELECT doc_id, k + 1 FROM copies UNION SELECT doc_id, k FROM single)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN (
            SELECT n.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed,
                   string_agg(CASE WHEN gone.k IS NULL THEN line END, chr(10) ORDER BY i) AS kept
            FROM n LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.k = gone.k GROUP BY n.doc_id) r ON d.doc_id = r.doc_id""",
    "op4_decontamination": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
            FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
            FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
        hits AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.words = win.words),
        hit_words AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
        hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
            FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op6_url_filter": r"""
        WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        cut AS (SELECT page_id, rest, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS raw_host FROM rests),
        p AS (
            SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   split_part(split_part(substr(rest, length(raw_host) + 1), '?', 1), '#', 1) AS path
            FROM cut),
        rules(action, r_host, r_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best AS (
            SELECT page_id, arg_max({'a': action, 'r': r_host || r_path}, length(r_host) * 1000 + length(r_path)) AS m
            FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
        SELECT p.page_id, host, path, m.r AS rule, coalesce(m.a, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)""",
    "op7_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, regexp_matches(text, '\\|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]') AS conflict,
                   length(regexp_replace(text, '(\\|\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\])', '_\1', 'g')) AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               CAST(sum(CASE WHEN conflict THEN escaped ELSE length(text) END
                   + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (
            SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                   100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
                   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
            FROM d),
        n AS (
            SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
                   count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f GROUP BY ALL),
        l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (
            SELECT concat(l1.x, l2.x, l3.x, l4.x, l5.x) AS filter_order FROM l l1, l l2, l l3, l l4, l l5
            WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
        s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own, filter_order[:i - 1] AS before FROM o, unnest(range(1, 6)) AS t(i)),
        r AS (
            SELECT part, filter_order, step, own,
                   CAST(coalesce(sum(docs) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(docs) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(docs) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(docs) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost
            FROM (SELECT *, translate(fails, before, '') <> fails AS gone, contains(fails, own) AS hit FROM n, s) GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING count(*) >= 30),
        lang_sums AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
        cells AS (
            SELECT g.lang, g.source, k.term, CAST(coalesce(x.n, 0) AS HUGEINT) AS n FROM g JOIN kept k ON g.lang = k.lang
            LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM c GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
        p AS (
            SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
            FROM cells),
        q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS q FROM kept JOIN lang_sums USING (lang)),
        diffs AS (
            SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN diffs ON diffs.lang = a.lang AND diffs.source = a.source AND diffs.item = b.source),
        more AS (
            SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
            WHERE n > 0 AND p > q)
        SELECT * FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
        WHERE part = 'pair' OR rank <= 50""",
}
