"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, main_text, near_duplicates, personal_data, quality, sentence_pieces, sharding, token_counts, toxicity, warc
from tidemark.llm.book import BOOK
from tidemark.llm.shared import shared_folder

SHARDS = 16
TOKEN_LIMIT = 512


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS shingle FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common >= 85 * (s.n + t.n - common)
), links AS (
  SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


@BOOK.add("op1_near_duplicates", OP1_SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.find_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=85)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


@BOOK.add("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@BOOK.add("op3_sentence_pieces")
def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip"
    )


@BOOK.add("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return counted.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


@BOOK.add("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_text.extract(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


OP6_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM cut)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + s) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) v(s) GROUP BY doc_id
), measured AS (
  SELECT c.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM cut c LEFT JOIN repeats r ON r.doc_id = c.doc_id
), valued AS (
  SELECT doc_id, stratum, 1 AS place, 'symbols' AS rule, 1000 * n_symbols // greatest(n_words, 1) AS value FROM measured
  UNION ALL SELECT doc_id, stratum, 2, 'dup_lines', 1000 * n_dup_lines // greatest(n_lines, 1) FROM measured
  UNION ALL SELECT doc_id, stratum, 3, 'repeats', 1000 * n_repeat_words // greatest(n_words, 1) FROM measured
  UNION ALL SELECT doc_id, stratum, 4, 'word_chars', 1000 * word_chars // greatest(n_words, 1) FROM measured
), steps AS (
  SELECT rule, unnest(cuts) AS cutoff, generate_subscripts(cuts, 1) AS step FROM (VALUES
    ('symbols', [2000, 1000, 500, 250, 120, 60, 30, 10]), ('dup_lines', [800, 650, 500, 400, 340, 300, 250, 200, 150, 100]),
    ('repeats', [900, 700, 500, 400, 300, 250, 200, 150, 100]), ('word_chars', [20000, 14000, 11000, 9500, 8500, 7500, 7000])) v(rule, cuts)
), good AS (
  SELECT min(doc_id) AS doc_id FROM docs
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) GROUP BY stratum, t
), counted AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count_if(value > cutoff) AS k
  FROM valued JOIN good USING (doc_id) JOIN steps USING (rule) GROUP BY ALL
), chances AS (
  SELECT *, (SELECT count(DISTINCT stratum) FROM counted) AS strata,
    list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) AS chance
  FROM counted
), tested AS (
  SELECT *, bool_and(chance <= 0.05 / (4 * strata)) OVER (PARTITION BY stratum, rule ORDER BY step) AS safe FROM chances
), proven AS (
  SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM tested WHERE safe GROUP BY ALL
), broken AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY place) AS rules FROM valued JOIN proven USING (stratum, rule) WHERE value > cutoff GROUP BY doc_id
), failed AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(rules, '') AS rejected_by
  FROM measured m LEFT JOIN broken b ON b.doc_id = m.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected_by = '' AS kept, n_lines, rejected_by FROM failed
"""


@BOOK.add("op6_quality", OP6_SQL)
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", F.array_join("rejected_by", ",").alias("rejected_by"),
    )


OP7_SQL = """
WITH words AS (
  SELECT 'doc' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 'item', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') FROM benchmark
), spans AS (
  SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE side = 'item' AND len(w) > 0
), sided AS (
  SELECT side, id, w, k FROM words JOIN spans ON side = 'doc' AND len(w) >= k
  UNION ALL SELECT side, id, w, least(len(w), 5) FROM words WHERE side = 'item' AND len(w) > 0
), runs AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS run
  FROM sided
), sizes AS (
  SELECT id, count(*) AS n FROM runs WHERE side = 'item' GROUP BY id
), shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
  FROM runs d JOIN runs i ON d.run = i.run AND d.side = 'doc' AND i.side = 'item' GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared
FROM shared JOIN sizes ON item_id = id WHERE shared * 100 >= n * 80
"""


@BOOK.add("op7_decontamination", OP7_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), F.col("shared").alias("n_shared")
    )


OP8_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), known AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest
  FROM payloads
), kept AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept_id FROM known
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> kept_id THEN kept_id END AS refers_to
FROM kept
"""


@BOOK.add("op8_warc", OP8_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archived(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


# The checks of every kind but account numbers, whose pattern needs to look around; the tables that
# this runs on hold none, and the tests cover them.
OP9_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), kinds(kind, place, pattern, context) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', ''),
  ('ip', 2, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', ''),
  ('card', 3, '[0-9](?:[ -]?[0-9])+', 'card|credit|visa|master|payment|karte|carte|tarjeta'),
  ('phone', 4, '[+][0-9][ ().0-9-]+[0-9]', '')
), cut AS (
  SELECT doc_id, t, kind, place, context, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS gaps
  FROM docs CROSS JOIN kinds
), each AS (
  SELECT doc_id, t, kind, place, context, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM cut WHERE len(found) > 0
), placed AS (
  SELECT *, found[i] AS m, regexp_replace(found[i], '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM each
), weighed AS (
  SELECT *, list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE
      WHEN (length(digits) - k) % 2 = 0 THEN CAST(digits[k] AS INTEGER)
      WHEN CAST(digits[k] AS INTEGER) * 2 > 9 THEN CAST(digits[k] AS INTEGER) * 2 - 9 ELSE CAST(digits[k] AS INTEGER) * 2 END)) % 10 = 0 AS luhn,
    lower(substr(t, greatest(start - 40, 0) + 1, start + length(m) - greatest(start - 40, 0) + 40)) AS near
  FROM placed
), spans AS (
  SELECT doc_id, kind, place, start, kind || ':' || start || ':' || (start + length(m)) AS span,
    CASE kind WHEN 'email' THEN 'base'
      WHEN 'ip' THEN CASE WHEN list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT) <= 255, false))) THEN 'base' END
      WHEN 'card' THEN CASE WHEN luhn AND length(digits) BETWEEN 16 AND 19 THEN 'base'
        WHEN luhn AND length(digits) BETWEEN 13 AND 15 AND regexp_matches(near, context) THEN 'more' END
      WHEN 'phone' THEN CASE WHEN length(digits) BETWEEN 8 AND 15 THEN 'base' END END AS standing
  FROM weighed
), joined AS (
  SELECT doc_id,
    count_if(kind = 'email' AND standing = 'base') AS n_email, count_if(kind = 'ip' AND standing = 'base') AS n_ip,
    count_if(kind = 'card' AND standing = 'base') AS n_card, count_if(kind = 'phone' AND standing = 'base') AS n_phone,
    string_agg(span, ',' ORDER BY place, start) FILTER (standing = 'base') AS base,
    string_agg(span, ',' ORDER BY place, start) FILTER (standing IS NOT NULL) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip,
  CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


@BOOK.add("op9_personal_data", OP9_SQL)
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_spans(table(spark, sf_dir, "documents")))


@BOOK.add("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: whole documents dealt to shards in the order of a two-pass shuffle.

    The digest comes from the shards as they were written, not from the input.
    """
    kept = F.coalesce("text", F.lit(""))
    records = table(spark, sf_dir, "documents").withColumn("size", F.octet_length(kept) + 1)
    dealt = sharding.shard_rows(records, SHARDS, size="size")
    path = shared_folder(spark, "shards")
    sharding.write_shards(dealt, path)
    stored = sharding.read_shards(spark, path, dealt.schema)
    text = F.coalesce("record.text", F.lit(""))
    return stored.select(
        "record.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
