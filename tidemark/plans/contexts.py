"""Context assembly: semantic sections, experiences, full context, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.functions.columns import once
from tidemark.operators import context as cx
from tidemark.operators import episodes as ep
from tidemark.operators import rules as ru
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import rounded
from tidemark.plans.facts import FACTS_SQL, facts, moment
from tidemark.plans.learning import EPISODE_CTES, loop_episodes
from tidemark.plans.lexical import TOKEN_SQL, UNIVERSE
from tidemark.session import materialise

SOURCES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
UNIVERSE_SQL = "[" + ", ".join(f"'{u}'" for u in UNIVERSE) + "]"
AS_OF = "2024-06-01"
# The default of 4000 tokens, in characters.
BUDGET = 4000 * 4


def word_of_brand(ticker: str = "ticker"):
    """The universe word that stands for a brand."""
    words = F.array(*[F.lit(u) for u in UNIVERSE])
    return F.element_at(words, F.regexp_extract(ticker, r"(\d+)$", 1).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries with the tickers they mention and a source type."""
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("item_id") % 5 + 1).cast("int"))
    rows = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), source.alias("source"), "text")
    return with_tickers(rows)


def with_tickers(rows: DataFrame) -> DataFrame:
    return once(rows, "tickers", t.mentioned_tickers(F.col("text"), UNIVERSE, [], UNIVERSE[:5]))


def word_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).withColumn("ticker", word_of_brand())


def word_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal history whose outcome is the order status, unknown for pending orders."""
    outcome = F.when(F.col("config") != "P", F.col("config"))
    return b.predictions(spark, sf_dir, b.FIVE_BRANDS).select(
        F.col("article_idx").alias("id"), F.col("date").alias("article_date"),
        F.concat(F.lit("Order "), F.col("article_idx")).alias("article_title"), outcome.alias("outcome"),
        word_of_brand().alias("ticker"),
    )


def status_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return ep.accuracy_counts(b.table(spark, sf_dir, "orders").select(outcome.alias("was_correct")))


QUESTION_ROWS_SQL = f"SELECT item_id AS query_id, list_extract({SOURCES}, item_id % 5 + 1) AS source, text FROM benchmark"


def questions_sql(rows: str) -> str:
    return f"""
mention AS (SELECT query_id, source, list_filter({UNIVERSE_SQL}, lambda u: list_contains(toks, lower(u))) AS found
  FROM (SELECT query_id, source, {TOKEN_SQL.format(text='text')} AS toks FROM ({rows}))),
questions AS (SELECT query_id, source, CASE WHEN len(found) > 0 THEN found ELSE {UNIVERSE_SQL}[1:5] END AS tickers FROM mention),
places AS (SELECT query_id, source, u.ticker, u.place FROM questions,
  (SELECT unnest(tickers) AS ticker, unnest(range(len(tickers))) AS place) u),"""


SEMANTIC_SQL = FACTS_SQL + f""",
fact_lines AS (SELECT list_extract({UNIVERSE_SQL}, CAST(replace(ticker, 'Brand#', '') AS INTEGER)) AS ticker,
  string_agg(content, ' | ' ORDER BY pos) AS facts FROM ranked WHERE pos <= 3 GROUP BY ticker),
sig AS (SELECT list_extract({UNIVERSE_SQL}, CAST(replace(ticker, 'Brand#', '') AS INTEGER)) AS ticker, article_idx, date, config,
  row_number() OVER (PARTITION BY ticker ORDER BY date DESC, article_idx) AS pos FROM sem_pred),
record AS (SELECT '[YOUR TRACK RECORD] Accuracy: ' || printf('%.1f', 100.0 * count_if(o_orderstatus = 'F') / count_if(o_orderstatus <> 'P')) || '% ('
  || count_if(o_orderstatus = 'F') || '/' || count_if(o_orderstatus <> 'P') || ' correct predictions)' AS line FROM orders),
sections AS (
  SELECT query_id, 0 AS p, line AS section FROM questions, record
  UNION ALL SELECT query_id, 10 + place, '[MEMORY: ' || places.ticker || '] ' || facts FROM places JOIN fact_lines USING (ticker) WHERE place < 3
  UNION ALL SELECT query_id, 20 + place * 3 + pos, '[PAST SIGNAL: ' || places.ticker || ' on ' || date || '] ''Order ' || article_idx || ''' → Outcome: ' || config
  FROM places JOIN sig USING (ticker) WHERE place < 2 AND pos <= 2 AND config <> 'P'),
running AS (SELECT *, sum(length(section) + 1) OVER (PARTITION BY query_id ORDER BY p) - 1 AS upto FROM sections),
semantic AS (SELECT q.query_id, coalesce(string_agg(section, chr(10) ORDER BY p), '') AS packed
  FROM questions q LEFT JOIN running r ON q.query_id = r.query_id AND upto <= {{limit}} GROUP BY q.query_id)"""


def semantic_sql(rows: str = QUESTION_ROWS_SQL) -> str:
    return b.predictions_sql(b.FIVE_BRANDS, "sem_pred") + "," + questions_sql(rows) + SEMANTIC_SQL.replace("{limit}", str(BUDGET))


def semantic(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return cx.semantic_context(
        asked, word_facts(spark, sf_dir), word_signals(spark, sf_dir), status_accuracy(spark, sf_dir), moment(AS_OF)
    )


@BOOK.add("semantic_context", "WITH " + semantic_sql() + "\nSELECT query_id, length(packed) AS chars, md5(packed) AS digest FROM semantic")
def semantic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = semantic(spark, sf_dir, materialise(questions(spark, sf_dir), "questions"))
    return packed.select("query_id", F.length("packed").cast("long").alias("chars"), F.md5("packed").alias("digest"))


FULL_SQL = (
    EPISODE_CTES + "," + b.category_sql() + "," + b.rules_sql("counts") + "," + semantic_sql() + f""",
rules_text AS (SELECT '[BEHAVIORAL RULES LEARNED FROM EXPERIENCE]' || chr(10) || string_agg(
    '  [' || CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END
    || ' confidence, ' || evidence_count || ' observations] ' || rule_text, chr(10) ORDER BY confidence DESC, rule_id) AS txt
  FROM rules WHERE confidence >= 0.5),
latest AS (SELECT *, list_extract({UNIVERSE_SQL}, CAST(replace(ticker, 'Brand#', '') AS INTEGER)) AS word,
  row_number() OVER (PARTITION BY ticker, source ORDER BY date DESC, article_idx) AS pos FROM episodes),
chosen AS (SELECT p.query_id, l.*, row_number() OVER (PARTITION BY p.query_id ORDER BY p.place, l.pos) AS k
  FROM places p JOIN latest l ON l.word = p.ticker AND l.source = p.source AND l.pos <= 3 WHERE p.place < 3),
experience AS (SELECT query_id, '[PAST EXPERIENCES]' || chr(10) || string_agg('  [' || CASE WHEN was_correct THEN 'CORRECT' ELSE 'WRONG' END || '] '
    || date || ' ' || word || ': Predicted ' || predicted_direction || ' (' || printf('%+.1f', predicted_score) || '), actual '
    || printf('%+.2f', round(actual_return * 100, 2)) || '%. ', chr(10) ORDER BY k) AS txt FROM chosen WHERE k <= 5 GROUP BY query_id),
overall AS (SELECT '[YOUR TRACK RECORD] Overall accuracy: ' || format('{{:.0f}}', 100.0 * correct / total) || '% (' || correct || '/' || total || ' correct)' AS txt
  FROM counts WHERE family = 'overall'),
joined AS (SELECT s.query_id, concat_ws(chr(10) || chr(10), (SELECT txt FROM rules_text), e.txt, nullif(packed, ''), (SELECT txt FROM overall)) AS context
  FROM semantic s LEFT JOIN experience e USING (query_id))"""
)


def built_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = materialise(questions(spark, sf_dir), "questions")
    by_brand = materialise(loop_episodes(spark, sf_dir), "episodes")
    seen = by_brand.withColumns({"ticker": word_of_brand(), "lesson": F.lit(None).cast("string")})
    counts = ep.category_counts(by_brand)
    rules = rounded(ru.generate_rules(by_brand, F.current_date()), "confidence")
    return cx.full_context(asked, rules, seen, counts, semantic(spark, sf_dir, asked), [F.asc("article_idx")])


@BOOK.add(
    "full_context",
    FULL_SQL + f"""
SELECT query_id, md5(CASE WHEN length(context) > {BUDGET} THEN left(context, {BUDGET}) || chr(10) || '[... memory truncated to fit context window]' ELSE context END) AS digest,
       length(context) > {BUDGET} AS was_cut FROM joined""",
)
def full_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, experiences, semantic memory and track record for every benchmark text."""
    suffix = "\n[... memory truncated to fit context window]"
    return built_context(spark, sf_dir).select(
        "query_id", F.md5("context").alias("digest"), F.endswith("context", F.lit(suffix)).alias("was_cut")
    )


@BOOK.add(
    "episode_prompt_lines",
    EPISODE_CTES + """
SELECT article_idx, ticker, '- ' || date || ' | ' || ticker || ' | Predicted: ' || predicted_direction || ' (' || printf('%+.1f', predicted_score)
  || ') | Actual: ' || actual_direction || ' (' || printf('%+.2f', round(actual_return * 100, 2)) || '%) | ' || CASE WHEN was_correct THEN 'CORRECT' ELSE 'WRONG' END
  || ' | Source: ' || source || ' | Article: Order ' || article_idx AS line
FROM episodes ORDER BY date DESC, article_idx, ticker LIMIT 30""",
)
def episode_prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty latest episodes, as the rule-writing prompt lists them."""
    seen = loop_episodes(spark, sf_dir).withColumn("title", F.concat(F.lit("Order "), F.col("article_idx")))
    lines = cx.episode_prompt_lines(seen, [F.asc("article_idx"), F.asc("ticker")], title_chars=50)
    return lines.select("article_idx", "ticker", "line")


@BOOK.add(
    "context_pack",
    """WITH r AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS upto FROM conversations)
SELECT conv_id, CAST(count_if(upto <= 1500) AS BIGINT) AS sections,
       md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (upto <= 1500), '')) AS digest FROM r GROUP BY conv_id""",
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of every conversation packed into a character budget."""
    turns = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    packed = cx.pack_sections(turns, "conv_id", "turn", "text", 1500)
    return packed.select("conv_id", "sections", F.md5("packed").alias("digest"))


@BOOK.add(
    "model_rules",
    """SELECT o_orderkey // 1000 AS batch, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'rule_' || o_orderkey END, 'model_rule_' || (o_orderkey // 1000) || '_' || o_orderkey || '_0') AS rule_id,
  'When ' || o_orderpriority AS rule_text, CASE WHEN o_orderkey % 3 = 0 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence,
  CASE WHEN o_orderkey % 5 = 0 THEN 'calibration' ELSE 'pattern' END AS category FROM orders WHERE o_orderkey % 7 <> 0""",
)
def model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules a model wrote, one answer per order, some fields missing, some answers without rules."""
    key = F.col("o_orderkey")
    rule = F.to_json(F.struct(
        F.when(key % 2 == 0, F.concat(F.lit("rule_"), key)).alias("rule_id"),
        F.concat(F.lit("When "), F.col("o_orderpriority")).alias("rule_text"),
        F.when(key % 3 == 0, 0.7).alias("confidence"), F.when(key % 5 == 0, "calibration").alias("category"),
    ))
    answer = F.when(key % 7 == 0, "no rules today").otherwise(F.concat(F.lit("Here: ["), rule, F.lit("] done")))
    responses = b.table(spark, sf_dir, "orders").select(
        F.floor(key / 1000).alias("batch"), key.alias("answer"), F.lit(20).alias("evidence_count"), answer.alias("response")
    )
    rules = ru.rules_from_responses(responses, F.current_date(), ["batch", "answer"])
    return rules.select("batch", "rule_id", "rule_text", "confidence", "category")
