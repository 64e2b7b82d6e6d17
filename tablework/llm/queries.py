"""Registered queries of the corpus operators (op1 to op13).

Each query reads its whole table, calls its operator with the production
parameters, and keeps the columns of the contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import byte_bpe, content_sort, language, packing, parity_join, phrases, repetition, secret_scan, substrings, toxicity, variants, warc, wrapper
from tablework.llm.common import materialise, scratch_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.dedup_exact(table(spark, sf_dir, "documents"))


EXACT_DEDUP_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
"""


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = materialise(warc.read_archives(spark, folder, payloads=False), "warc-records")
    warc.verify(records, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM t
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # an executor has two Python workers a task, and Spark fills a batch for each: 4 MB of bytes (one row at least), not 64
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    out = byte_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.drop("ids")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return wrapper.extract(pages, materialise(wrapper.induce(pages), "wrappers"))


def op11_gram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


PHRASES_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents
), p AS (
  SELECT lang, unnest(ps) AS piece FROM d
), q AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), t AS (
  SELECT pid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q
), g AS (
  SELECT lang, w AS w1, lead(w) OVER along AS w2, lead(w, 2) OVER along AS w3 FROM t WINDOW along AS (PARTITION BY pid ORDER BY i)
), f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.*, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y
  FROM c, (VALUES (1), (2)) AS borders(j) WHERE j < k
), s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, j, fx.f AS l, fy.f AS r, ((1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f))::BIGINT AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x AND fx.k = j JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y AND fy.k = cuts.k - j
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), around AS (
  SELECT lang, inner_phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS inner_phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT low.* FROM low LEFT JOIN around g ON g.lang = low.lang AND g.inner_phrase = low.phrase AND low.k = 2
  WHERE g.longer IS NULL OR 100 * g.longer < 50 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


QUERIES = (
    op1_cutting_stock_packing, op2_exact_dedup, op3_warc_round_trip, op4_substring_dedup, op5_toxicity, op6_parity_join, op7_repetition_quality,
    op8_byte_bpe, op9_secret_scan, op10_wrapper_main_text, op11_gram_variants, op12_language_id, op13_phrase_automata,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_DEDUP_SQL, "op3_warc_round_trip": WARC_SQL, "op13_phrase_automata": PHRASES_SQL}
