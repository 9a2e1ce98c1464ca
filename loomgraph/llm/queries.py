"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import alignment, chat, decontamination, html_extract, line_dedup, media, mixing, pii, resampling, simhash, substring_dedup, token_output, toxicity
from loomgraph.llm.common import in_small_batches, read

Query = Callable[[SparkSession, str], DataFrame]
END_ID = 2
#: For these queries alone: whoever publishes surrogates brings a key of their own.
TEST_KEY = b"surrogates of synthetic documents"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


@in_small_batches
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.with_surrogates(docs, pii.safe_key(docs, TEST_KEY))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.severities(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], turns.schema)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return chat.conversation_digests(*chat.prefix_tree(turns.union(extra), path), path)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.fit(pages))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(read(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = (
    op1_token_output, op2_substring_dedup, op3_source_mixing, op4_pii_surrogates, op5_toxicity, op6_chat_prefix_tree, op7_decontamination,
    op8_simhash, op9_html_extraction, op10_media_columns, op11_importance_resampling, op12_line_dedup, op13_tokenizer_alignment,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


#: The same water-filling and sampling over the same draws, in windows over whole sources.
MIXING_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '') || '|17'), 1, 15) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] :: DOUBLE AS w FROM d GROUP BY source),
r(k, level) AS (SELECT 0, CAST(-1 AS DOUBLE) UNION ALL SELECT k + 1, (SELECT (sum(s.source_size) - coalesce(sum(3.0 * s.source_size) FILTER (r.level * w > 3.0 * s.source_size), 0)) / sum(w) FILTER (NOT r.level * w > 3.0 * s.source_size) FROM s) FROM r WHERE k < 40 AND level IS NOT NULL),
t AS (SELECT s.*, least(3.0 * source_size, (SELECT max(level) FROM r) * w) :: DOUBLE AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS part FROM p),
g AS (SELECT source, draw, sum(size) AS words, count(*) AS tied FROM d GROUP BY ALL),
u AS (SELECT g.*, sum(words) OVER (PARTITION BY source ORDER BY draw) AS upto FROM g),
c AS (SELECT u.source, u.draw AS cut, CAST(floor((part - upto + words) / tied) AS BIGINT) AS cut_words FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source WHERE upto > part AND upto - words <= part AND words > 0)
SELECT doc_id, size, d.source, source_size, target, CAST(size * (whole + CASE WHEN part >= source_size AND source_size > 0 THEN 1 ELSE 0 END)
  + CASE WHEN part >= source_size THEN 0 WHEN draw < cut THEN size WHEN draw = cut THEN least(cut_words, size) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


_SAID = r"'\### Assistant: </turn> ok'"
#: Each escaped string grows by one backslash; a role's line break becomes two characters.
CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, regexp_replace(text, '(\\|###|</turn>)', '_\1', 'g') AS wide_text, regexp_replace(role, '(\\|###|</turn>|\n)', '_\1', 'g') AS wide_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(wide_role) + length(wide_text)) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id, lone
"""


#: The first document of a key among those that hold it keeps its lines.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, first IS NOT NULL AND first <> doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": MIXING_SQL, "op6_chat_prefix_tree": CHAT_SQL, "op12_line_dedup": LINES_SQL}
