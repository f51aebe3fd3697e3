"""Registered queries: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(frame: Query) -> Query:
        QUERIES[name] = frame
        if sql is not None:
            ORACLES[name] = sql
        return frame

    return register


QUALITY_SQL = r"""
WITH given AS (
  SELECT row_number() OVER () AS line, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM given
), windows AS (
  SELECT line, place, words[place] || chr(10) || words[place + 1] || chr(10) || words[place + 2] AS seen
  FROM (SELECT line, words, unnest(range(1, len(words) - 1)) AS place FROM worded WHERE len(words) > 2)
), twice AS (
  SELECT line, place FROM windows QUALIFY count(*) OVER (PARTITION BY line, seen) > 1
), covered AS (
  SELECT line, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT line, unnest([place, place + 1, place + 2]) AS pos FROM twice) GROUP BY line
), measured AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT)
      AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM worded LEFT JOIN covered USING (line)
), ruled AS (
  SELECT *, n_words < 50 AS too_short, 100 * n_repeat_words > 50 * n_words AS repetitive FROM measured
), hosts AS (
  SELECT host, count(*) AS host_docs, count(*) FILTER (too_short OR repetitive) AS host_failed,
    count(*) FILTER (too_short) AS bad_0, count(*) FILTER (repetitive) AS bad_1
  FROM ruled GROUP BY host
), rules AS (
  SELECT 0 AS rule, host, host_docs, bad_0 AS bad FROM hosts UNION ALL SELECT 1, host, host_docs, bad_1 FROM hosts
), moments AS (
  SELECT rule, sum(bad) / sum(host_docs) AS mean, sum(host_docs) AS docs, count(*) AS n_hosts,
    sum(host_docs * (bad / host_docs) * (bad / host_docs)) / sum(host_docs) AS square
  FROM rules GROUP BY rule
), spread AS (
  SELECT rule, mean, docs, mean * (1 - mean) AS inside, square - mean * mean - mean * (1 - mean) * n_hosts / docs AS true_var
  FROM moments
), priors AS (
  SELECT rule, CASE WHEN inside = 0 THEN mean + 0.5 ELSE mean * strength END AS a,
    CASE WHEN inside = 0 THEN 1.5 - mean ELSE (1 - mean) * strength END AS b
  FROM (SELECT *, greatest(CASE WHEN true_var > 0 AND true_var < inside THEN inside / true_var - 1 ELSE docs END, 1.0) AS strength
        FROM spread)
), verdicts AS (
  SELECT host, max((bad + a) / (host_docs + a + b)) > 0.5 AS host_rejected FROM rules JOIN priors USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, too_short OR repetitive AS base_failed,
  NOT (too_short OR repetitive) AND NOT host_rejected AS kept, r.host, host_docs, host_failed, host_rejected
FROM ruled r JOIN hosts h ON r.host IS NOT DISTINCT FROM h.host JOIN verdicts v ON r.host IS NOT DISTINCT FROM v.host
"""


@query("op1_quality_rules", QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.quality import quality_verdicts

    return quality_verdicts(table(spark, folder, "documents"))


@query("op2_simhash")
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op3_substring_dedup", None)
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.substring import repeated_units

    return repeated_units(table(spark, folder, "documents"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.tokenfile import read_token_digests, write_token_files

    return read_token_digests(write_token_files(table(spark, folder, "documents")))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.tokencount import token_counts

    return token_counts(table(spark, folder, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.packing import packed

    return packed(table(spark, folder, "documents"))


ARCHIVE_SQL = """
WITH given AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), digested AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '')
      AS payload_digest
  FROM given
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM digested WINDOW w AS (PARTITION BY hex)
"""


@query("op4_warc", ARCHIVE_SQL)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.warc import read_archives, write_archives

    read = read_archives(write_archives(table(spark, folder, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.pieces import round_trip_digests

    return round_trip_digests(table(spark, folder, "documents"))


@query("op8_main_text")
def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.maintext import main_texts

    return main_texts(table(spark, folder, "pages"))


@query("op9_gif")
def op9_gif(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.gif import text_media_features

    return text_media_features(table(spark, folder, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.whitening import whitened_components

    return whitened_components(table(spark, folder, "embeddings"))


@query("op12_sharding")
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.sharding import shard_places

    return shard_places(table(spark, folder, "documents"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from tidepanel.llm.alignment import alignment_digests

    return alignment_digests(table(spark, folder, "documents"))
