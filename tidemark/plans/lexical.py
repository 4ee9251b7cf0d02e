"""Queries over the lexical memory: tokens, tags, ids, adding, importing, searching, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import context, search
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.sources import feeds
from tidemark.sources import memory as me
from tidemark.sources import predictions as pr
from tidemark.session import scratch_path

# Frequent words of the documents stand in for ticker symbols.
UNIVERSE = ["THE", "OF", "AND", "LES", "DER", "QUE", "LOS", "UND", "ION", "TIONS"]
ALIASES = [("ention", "NEN"), ("ouen", "OUE"), ("einheit", "EIN")]
KEYWORDS = [(["therth", "onre"], "AAA"), (["leau", "ouque"], "BBB"), (["sch ", "ung"], "CCC"), (["ción"], "DDD")]

TOKEN_SQL = (
    "list_distinct(list_transform(regexp_extract_all({text}, '[A-Za-z0-9$._-]+'), "
    "lambda x: regexp_replace(lower(x), '^\\$+', '')))"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.spread_table(spark, sf_dir, "documents", "doc_id")


def observed(doc_id: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (doc_id % 365).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes; the title is the start of the text."""
    return documents(spark, sf_dir).select(
        "text", "source", F.left("text", F.lit(40)).alias("title"), F.lit("").alias("url"),
        observed(F.col("doc_id")).cast("string").alias("observed_at"), F.lit("{}").alias("metadata"),
        F.col("doc_id").alias("seq"),
    )


STRIP_SQL = "regexp_replace({x}, '^[\\s\\v\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\v\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP_SQL.replace("{x}", x)


@BOOK.add(
    "tokenize",
    "SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(list_sum(list_transform(toks, lambda x: length(x))) AS BIGINT) AS chars "
    "FROM (SELECT doc_id, " + TOKEN_SQL.format(text="text") + " AS toks FROM documents)",
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", t.tokens(F.col("text")).alias("toks"))
    total = F.aggregate("toks", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return rows.select("doc_id", F.size("toks").alias("n_tokens"), F.when(F.size("toks") > 0, total).alias("chars"))


UNIVERSE_LIST = "[" + ", ".join(f"'{u}'" for u in sorted(UNIVERSE)) + "]"


@BOOK.add(
    "infer_tags",
    "SELECT doc_id, array_to_string(list_filter(" + UNIVERSE_LIST + ", lambda u: list_contains(toks, lower(u))), ',') AS tags "
    "FROM (SELECT doc_id, " + TOKEN_SQL.format(text="text") + " AS toks FROM documents)",
)
def infer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = t.ticker_tags(t.tokens(F.col("text")), UNIVERSE)
    return documents(spark, sf_dir).select("doc_id", F.array_join(tags, ",").alias("tags"))


def _mention_sql(hit: str) -> str:
    named = "list_filter(['NEN', 'OUE', 'EIN'], lambda u: contains(low, CASE u WHEN 'NEN' THEN 'ention' WHEN 'OUE' THEN 'ouen' ELSE 'einheit' END))"
    listed = "[" + ", ".join(f"'{u}'" for u in UNIVERSE) + "]"
    return f"""
SELECT doc_id, array_to_string(CASE WHEN len(found) > 0 THEN found ELSE ['DFLT'] END, ',') AS tickers FROM (
  SELECT doc_id, list_concat(list_filter({listed}, lambda u: {hit}), {named}) AS found FROM (
    SELECT doc_id, lower(text) AS low, upper(text) AS up, {TOKEN_SQL.format(text='text')} AS toks FROM documents))"""


@BOOK.add("ticker_mentions", _mention_sql("list_contains(toks, lower(u))"))
def ticker_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.mentioned_tickers(F.col("text"), UNIVERSE, ALIASES, ["DFLT"])
    return documents(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("tickers"))


@BOOK.add("ticker_mentions_substring", _mention_sql("contains(up, u)"))
def ticker_mentions_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.mentioned_tickers(F.col("text"), UNIVERSE, ALIASES, ["DFLT"], mode="substring")
    return documents(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("tickers"))


@BOOK.add(
    "ticker_infer",
    """SELECT doc_id, CASE WHEN contains(low, 'therth') OR contains(low, 'onre') THEN 'AAA'
  WHEN contains(low, 'leau') OR contains(low, 'ouque') THEN 'BBB' WHEN contains(low, 'sch ') OR contains(low, 'ung') THEN 'CCC'
  WHEN contains(low, 'ción') THEN 'DDD' ELSE 'IONQ' END AS ticker
FROM (SELECT doc_id, lower(text) AS low FROM documents)""",
)
def ticker_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", t.first_keyword_ticker(F.col("text"), KEYWORDS).alias("ticker"))


OBSERVED_SQL = "CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR)"
TITLE_SQL = strip_sql("left(text, 40)")
ID_SQL = (
    f"substr(sha256(source || chr(10) || {TITLE_SQL} || chr(10) || {OBSERVED_SQL} || chr(10) || {strip_sql('text')}), 1, 16)"
)


@BOOK.add(
    "content_id",
    "SELECT doc_id, " + ID_SQL + " AS record_id FROM documents",
)
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.to_records(notes(spark, sf_dir), UNIVERSE).select(F.col("seq").alias("doc_id"), "record_id")


def dedup_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose id depends on the text and its language only, so copies collide."""
    return documents(spark, sf_dir).select(
        "text", F.col("lang").alias("source"), F.lit("").alias("title"), F.lit("").alias("url"),
        F.lit("2024-01-01").alias("observed_at"), F.lit("{}").alias("metadata"), F.col("doc_id").alias("seq"),
    )


@BOOK.add(
    "memory_dedup_insert",
    """WITH r AS (SELECT doc_id, lang, substr(sha256(lang || chr(10) || chr(10) || '2024-01-01' || chr(10) || """ + strip_sql("text") + """), 1, 16) AS record_id FROM documents),
store AS (SELECT record_id, min(doc_id) AS seq FROM r WHERE lang <> 'en' GROUP BY 1)
SELECT record_id, seq, 'stored' AS origin FROM store
UNION ALL SELECT record_id, min(doc_id), 'added' FROM r WHERE record_id NOT IN (SELECT record_id FROM store) GROUP BY 1""",
)
def memory_dedup_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the notes in some languages, then all notes added to it."""
    records = me.to_records(dedup_notes(spark, sf_dir), UNIVERSE)
    store = me.first_by(records.filter("source <> 'en'"), "record_id", F.col("seq"))
    added = me.new_records(records, store)
    return store.select("record_id", "seq", F.lit("stored").alias("origin")).unionByName(
        added.select("record_id", "seq", F.lit("added").alias("origin"))
    )


def import_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import lines with the text under different names and optional fields."""
    kind = F.col("doc_id") % 4
    empty = F.lit("")
    line = F.to_json(F.struct(
        F.when(kind == 0, F.col("text")).when(kind == 1, empty).alias("text"),
        F.when(kind == 1, F.col("text")).alias("content"),
        F.when(kind == 2, F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"),
        F.when(kind == 0, observed(F.col("doc_id")).cast("string")).alias("date"),
        F.when(kind != 0, observed(F.col("doc_id") + 1).cast("string")).alias("observed_at"),
        F.col("doc_id").alias("doc"),
    ))
    return documents(spark, sf_dir).select(F.parse_json(line).alias("item"))


@BOOK.add(
    "import_memory",
    """WITH n AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'manual_note' END AS source,
  CAST(DATE '2024-01-01' + CAST((doc_id + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END) % 365 AS INTEGER) AS VARCHAR) AS observed_at,
  CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS n_meta FROM documents WHERE doc_id % 4 <> 3 AND text <> '')
SELECT doc_id, source, observed_at, n_meta,
  substr(sha256(source || chr(10) || chr(10) || observed_at || chr(10) || """ + strip_sql("text") + """), 1, 16) AS record_id FROM n""",
)
def import_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    imported = pr.imported(import_items(spark, sf_dir))
    records = me.to_records(imported, UNIVERSE, as_of="2024-12-31")
    meta = F.from_json("metadata", "map<string,string>")
    return records.select(
        F.try_element_at(meta, F.lit("doc")).cast("long").alias("doc_id"), "source", "observed_at",
        F.size(meta).alias("n_meta"), "record_id",
    )


@BOOK.add(
    "memory_read_back",
    "SELECT source, count(*) AS records, count(DISTINCT " + ID_SQL
    + ") AS ids, CAST(sum(length(" + strip_sql("text") + ")) AS BIGINT) AS chars FROM documents GROUP BY source",
)
def memory_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines without some fields, read back with defaults."""
    path = scratch_path(spark, "memory")
    records = me.to_records(notes(spark, sf_dir), UNIVERSE)
    some_ids = records.withColumn("record_id", F.when(F.col("seq") % 2 == 0, F.col("record_id")))
    some_ids.drop("url", "metadata", "seq").write.json(path)
    stored = me.read_memory(spark, path, as_of="2024-12-31")
    return stored.groupBy("source").agg(
        F.count("*").alias("records"), F.countDistinct("record_id").alias("ids"), F.sum(F.length("text")).alias("chars")
    )


def search_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    records = documents(spark, sf_dir).select(
        F.col("doc_id").alias("record_id"), F.col("doc_id").alias("seq"), "text", "source",
        F.left("text", F.lit(40)).alias("title"), observed(F.col("doc_id")).alias("observed_at"),
    )
    return queries, records


SEARCH_SQL = f"""
qt AS (SELECT item_id AS query_id, unnest({TOKEN_SQL.format(text='text')}) AS token FROM benchmark),
rt AS (SELECT doc_id AS record_id, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS observed_at,
              unnest({TOKEN_SQL.format(text="left(text, 40) || ' ' || text")}) AS token FROM documents),
hits AS (
  SELECT query_id, record_id, CAST(sum(CASE WHEN list_contains({UNIVERSE_LIST}, upper(token)) THEN 4 ELSE 1 END) AS BIGINT) AS score,
         min(observed_at) AS observed_at
  FROM qt JOIN rt USING (token) GROUP BY 1, 2),
best AS (
  SELECT query_id, record_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, observed_at DESC, record_id) AS INTEGER) AS pos
  FROM hits QUALIFY pos <= 5)"""


@BOOK.add("lexical_search", "WITH " + SEARCH_SQL + "\nSELECT query_id, record_id, score, pos FROM best")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, records = search_inputs(spark, sf_dir)
    return search.lexical_search(queries, records, UNIVERSE, text=F.concat_ws(" ", "title", "text"))


@BOOK.add(
    "prompt_block",
    "WITH " + SEARCH_SQL + """,
blocks AS (
  SELECT query_id, string_agg('- [' || record_id || '] ' || CASE WHEN left(text, 40) = '' THEN source ELSE left(text, 40) END
                              || ': ' || left(text, 800), chr(10) ORDER BY pos) AS block
  FROM best JOIN documents ON doc_id = record_id GROUP BY 1)
SELECT item_id AS query_id, md5('Source type: news' || chr(10) || chr(10) || 'Retrieved memory:' || chr(10)
  || coalesce(block, 'No related memory found.') || chr(10) || chr(10) || 'Current input:' || chr(10) || text || chr(10) || chr(10)
  || 'Analyze the current input using the retrieved memory only where relevant.') AS prompt_md5
FROM benchmark LEFT JOIN blocks ON query_id = item_id""",
)
def prompt_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, records = search_inputs(spark, sf_dir)
    hits = search.lexical_search(queries, records, UNIVERSE, text=F.concat_ws(" ", "title", "text"))
    asked = queries.withColumn("source", F.lit("news"))
    built = context.prompts(asked, context.memory_block(hits, records, chars=800))
    return built.select("query_id", F.md5("prompt").alias("prompt_md5"))


@BOOK.add(
    "memory_updates",
    """WITH u AS (SELECT 'note' AS kind, unnest([text, '  ']) AS text FROM documents
  UNION ALL SELECT 'lines', unnest(list_append(string_split(text, chr(10)), '  ')) FROM documents),
n AS (SELECT kind, """ + strip_sql("text") + """ AS text FROM u)
SELECT count(*) FILTER (WHERE kind = 'note') AS updates, count(DISTINCT text) FILTER (WHERE kind = 'note') AS texts,
  count(*) FILTER (WHERE kind = 'lines') AS lines, count(DISTINCT text) FILTER (WHERE kind = 'lines') AS line_texts
FROM n WHERE text <> ''""",
)
def memory_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that analyses ask to remember, and how many differ; blanks and other kinds are left out.

    One analysis of each document holds its whole text, another all of its lines, and both a blank.
    """
    asked = {"note": F.array("text"), "lines": F.split("text", "\n")}
    answers = F.array(*(
        F.struct(F.lit(kind).alias("event_type"), F.concat(updates, F.array(F.lit("  "))).alias("memory_updates"))
        for kind, updates in asked.items()
    ))
    parsed = documents(spark, sf_dir).select(F.explode(answers).alias("answer"), "source").select(
        F.parse_json(F.to_json("answer")).alias("analysis"), F.lit("2024-01-01").alias("observed_at"), "source",
    )
    found = me.memory_updates(parsed).select("title", t.strip(F.col("text")).alias("text"))
    of_whole, of_lines = F.col("title") == "note", F.col("title") == "lines"
    return found.agg(
        F.count_if(of_whole).alias("updates"), F.countDistinct(F.when(of_whole, F.col("text"))).alias("texts"),
        F.count_if(of_lines).alias("lines"), F.countDistinct(F.when(of_lines, F.col("text"))).alias("line_texts"),
    )


@BOOK.add(
    "html_strip",
    "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages",
)
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = t.strip_tags(F.col("html"))
    return b.table(spark, sf_dir, "pages").select(
        "page_id", F.length(plain).cast("long").alias("chars"), F.md5(plain).alias("digest")
    )


@BOOK.add(
    "unseen_articles",
    """WITH a AS (SELECT doc_id, source, text AS k FROM documents),
h AS (SELECT DISTINCT k FROM a WHERE source < 'src13')
SELECT min(doc_id) AS doc_id FROM a WHERE k NOT IN (SELECT k FROM h) GROUP BY k""",
)
def unseen_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles not in the history (the documents of some sources), each title once."""
    articles = documents(spark, sf_dir).select(F.col("text").alias("title"), F.col("doc_id").alias("seq"), "source")
    history = articles.filter("source < 'src13'").select(F.col("title").alias("article_title"))
    return feeds.unseen_articles(articles, history).select(F.col("seq").alias("doc_id"))


@BOOK.add(
    "article_text",
    "SELECT page_id, url || '. ' || coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END, '') AS text FROM pages",
)
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    description = F.when(F.col("page_id") % 3 != 0, F.col("html"))
    return b.table(spark, sf_dir, "pages").select("page_id", pr.article_text(F.col("url"), description).alias("text"))
