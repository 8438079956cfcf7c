"""The queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, exact_dedup, langid, mixing, quality_model, quality_rules, sentencepiece_viterbi, simhash, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to equal shares of characters a source: every copy with its text."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "copy", "mix_key", "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of encoded lengths of documents, with the sums that answer any context limit."""
    return token_counts.length_table(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written to archives and read back."""
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and that of chat.planted(), logged as drafts that are edited or regenerated, folded, rendered and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted(spark))
    return chat.read_back(chat.events(rows, revised=True))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_token_counts, op3_warc, op4_language_id, op5_chat, op6_sentencepiece,
        op7_exact_dedup, op8_quality_model, op9_simhash, op10_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_mix_sources"] = """
WITH sums AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN 1.0::DOUBLE * (SELECT sum(chars) FROM sums) / (chars * (SELECT count(*) FROM sums WHERE chars > 0)::DOUBLE) ELSE 0 END AS rate FROM sums),
cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM rates, range(0, 400) AS r(k) WHERE rate > 0),
drawn AS (
  SELECT doc_id, source, text, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
times AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.below <= d.u) AS n FROM drawn d),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INT AS copy FROM times)
SELECT doc_id, source, copy, ('0x' || substr(md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_key, text FROM copies"""

ORACLE_SQL["op3_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

_ESCAPED = "replace(t, '\\', '\\\\')"
for _c in chat.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\.{_c[1:]}')"
ORACLE_SQL["op5_chat"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED}) + 3 + 4 + 2 + CASE r WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 7 ELSE 7 + length(r) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

ORACLE_SQL["op7_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""

ORACLE_SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cover AS (SELECT r, sum(least(8, coalesce(i - before, 8)))::BIGINT AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit) GROUP BY r),
m AS (
  SELECT doc_id, t, words, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks, length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS letters
  FROM w LEFT JOIN cover c USING (r)),
v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words < 20 OR 100 * n_repeat_words > 30 * n_words THEN 'base' WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 'mean_word_length' WHEN 10 * n_symbols > n_words THEN 'symbols'
      WHEN 2 * n_dup_lines > len(string_split(t, chr(10))) THEN 'duplicate_lines' WHEN 10 * marks > 3 * n_words THEN 'exclamations' WHEN 10 * upper > 3 * letters THEN 'capitals'
      WHEN n_words >= 50 AND 5 * len(list_distinct(words)) < n_words THEN 'vocabulary' END AS failed_rule FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM v"""
