"""Queries over repeated passages, periodic runs and spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs, spelling, suffix_dedup
from tidemark.llm.book import BOOK
from tidemark.llm.queries import table

# Bytes are two hexadecimal digits each; a passage is 200 of them.
OP11_SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, pos, substr(h, 2 * pos + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS pos FROM docs)
), later AS (
  SELECT doc_id, pos FROM starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1
), opened AS (
  SELECT doc_id, pos, coalesce(pos > max(pos) OVER earlier + 100, true) AS new
  FROM later WINDOW earlier AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), numbered AS (
  SELECT doc_id, pos, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM opened
), spans AS (
  SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS b FROM numbered GROUP BY ALL
), removed AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS upto
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(from_hex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda i:
    substr(h, 2 * coalesce(upto[i - 1], 0) + 1, 2 * (coalesce(froms[i], length(h) // 2) - coalesce(upto[i - 1], 0)))), '') END)) AS kept_sha256
FROM docs d LEFT JOIN removed r ON r.doc_id = d.doc_id
"""


@BOOK.add("op11_suffix_dedup", OP11_SQL)
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of passages of 100 bytes that stand earlier in the corpus are removed."""
    kept = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, those words from some place on are a
    period that recurs. The draw depends on the id alone."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    parts = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    planted = parts.withColumn("a", F.expr("g % size(w)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    turned = F.expr(
        "array_join(transform(sequence(0, size(w) - 1), i -> element_at(w, 1 + cast(if(i < a, i, a + (i - a) % p) as int))), ' ')"
    )
    return planted.select("doc_id", F.when(n > 0, turned).otherwise(F.col("text")).alias("text"))


@BOOK.add("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which get planted periods; held against brute force."""
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("rank"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.rank")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = """
WITH RECURSIVE tables AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, s:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), known AS (
  SELECT run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS h FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), summed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS crc
  FROM known CROSS JOIN tables
), spelt AS (
  SELECT times, CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM summed
), vocabulary AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), gaps AS (
  SELECT DISTINCT word, n, i, substr(word, 1, i) || '$' || substr(word, i + 2) AS gap
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocabulary)
), shorter AS (
  SELECT DISTINCT word, n, replace(gap, '$', '') AS short FROM gaps
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT v.word, s.word, s.n FROM vocabulary v JOIN shorter s ON s.short = v.word
  UNION SELECT s.word, v.word, v.n FROM vocabulary v JOIN shorter s ON s.short = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), chosen AS (
  SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n,
    CASE WHEN m >= 5 * n THEN (SELECT min(encode(other)) FROM near o WHERE o.word = v.word AND o.m = b.m) END AS form
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word
), forms AS (
  SELECT word, decode(form) AS form, n, n_near, form_n FROM chosen
), steps AS (
  SELECT word, word AS place, 0 AS step FROM forms
  UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN forms f ON f.word = s.place WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(place, step) AS root FROM steps GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def spelt(docs: DataFrame) -> DataFrame:
    """``word``: the runs of letters of all texts; one code point is lost in about one of 199."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(spelling.runs_of(F.col("text"))).alias("run")
    )
    # The least length also holds for what is left of a run.
    drawn = runs.filter(F.length("run") >= spelling.LEAST_CHARS).withColumn("h", F.crc32(F.concat_ws(":", "doc", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return drawn.select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))


@BOOK.add("op13_spelling_variants", OP13_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelt(table(spark, sf_dir, "documents")))
