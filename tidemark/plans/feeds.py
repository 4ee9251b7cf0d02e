"""Queries over feed payloads built from the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import text as t
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.facts import TICKER_OF_DOC, ticker_of_doc
from tidemark.sources import feeds

AS_OF = "2024-12-31"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first line as title and their whole text as body, both in printable
    characters, and a day."""
    line = lambda text: F.trim(F.regexp_replace(text, r"[^!-~]+", " "))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", line(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), line(F.col("text")).alias("body"), ticker_of_doc().alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("day"),
    )


ITEMS_SQL = f"""
d AS (SELECT doc_id, source, trim(regexp_replace(split_part(text, chr(10), 1), '[^!-~]+', ' ', 'g')) AS title,
             trim(regexp_replace(text, '[^!-~]+', ' ', 'g')) AS body, {TICKER_OF_DOC} AS ticker,
             CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS day FROM documents)"""


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def tag(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def rss(rows: DataFrame) -> DataFrame:
    """A feed per document: an escaped item, one in CDATA with tags and one without a title."""
    published = F.when(F.col("doc_id") % 5 == 0, F.lit("soon")).otherwise(
        F.concat(F.lit("Mon, "), F.date_format("day", "dd MMM yyyy"), F.lit(" 23:30:00 "),
                 F.when(F.col("doc_id") % 2 == 0, "GMT").otherwise("-0500"))
    )
    link = F.concat(F.lit("http://x/"), F.col("doc_id"))
    cdata = F.concat(F.lit("<![CDATA[<b>"), F.replace("title", F.lit("]]>"), F.lit("")), F.lit("</b> layoff]]>"))
    first = tag("item", F.concat(
        tag("title", escaped(F.concat(F.col("title"), F.lit(" hiring")))), tag("link", link),
        tag("pubDate", published), tag("description", escaped(F.col("body"))),
    ))
    second = tag("item", F.concat(tag("title", cdata), tag("link", link), tag("pubDate", published)))
    third = tag("item", F.concat(tag("title", F.lit(" ")), tag("link", link)))
    return rows.withColumn("payload", tag("rss", tag("channel", F.concat(first, second, third))))


DAY_SQL = "CASE WHEN doc_id % 5 = 0 THEN DATE '2024-12-31' ELSE day END"


@BOOK.add(
    "rss_articles",
    "WITH " + ITEMS_SQL + """
SELECT source, 'http://x/' || doc_id AS link, 0 AS pos, trim(title || ' hiring') AS title, length(body) AS description_chars FROM d
UNION ALL SELECT source, 'http://x/' || doc_id, 1, '<b>' || replace(title, ']]>', '') || '</b> layoff', 0 FROM d""",
)
def rss_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.rss_articles(rss(items(spark, sf_dir)))
    return found.select("source", "link", "pos", "title", F.length("description").cast("long").alias("description_chars"))


@BOOK.add(
    "job_events",
    "WITH " + ITEMS_SQL + f""",
j AS (SELECT doc_id, ticker, {DAY_SQL} AS date, trim(title || ' hiring') AS title FROM d
      UNION ALL SELECT doc_id, ticker, {DAY_SQL}, '<b>' || replace(title, ']]>', '') || '</b> layoff' FROM d)
SELECT ticker, date, 'Hiring signal: ' || title AS title, title AS content,
       CASE WHEN contains(lower(title), 'layoff') THEN 'high' ELSE 'medium' END AS significance, 'http://x/' || doc_id AS url
FROM j WHERE regexp_matches(lower(title), 'hiring|job|layoff|workforce|engineer|recruit')""",
)
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.job_events(rss(items(spark, sf_dir)), as_of())
    return events.select("ticker", "date", "title", "content", "significance", "url")


@BOOK.add(
    "news_events",
    "WITH " + ITEMS_SQL + f""",
j AS (SELECT doc_id, ticker, {DAY_SQL} AS date, regexp_replace(trim(title || ' hiring'), '<[^>]+>', '', 'g') AS title FROM d
      UNION ALL SELECT doc_id, ticker, {DAY_SQL}, regexp_replace('<b>' || replace(title, ']]>', '') || '</b> layoff', '<[^>]+>', '', 'g') FROM d
      UNION ALL SELECT doc_id, ticker, DATE '2024-12-31', '' FROM d)
SELECT ticker, date, title, title AS content,
       CASE WHEN regexp_matches(lower(title), 'earnings|revenue|contract|partnership|breakthrough') THEN 'high' ELSE 'medium' END AS significance,
       'http://x/' || doc_id AS url FROM j""",
)
def news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.news_events(rss(items(spark, sf_dir)), as_of())
    return events.select("ticker", "date", "title", "content", "significance", "url")


def patent_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("doc_id") % 3 == 0, " Quantum").when(F.col("doc_id") % 3 == 1, " with a qubit").otherwise("")
    assignees = F.create_map(*[F.lit(x) for row in fixed.COMPANIES for x in (row[0], row[4])])
    patent = F.struct(
        F.col("doc_id").cast("string").alias("patent_number"), F.concat("title", word).alias("patent_title"),
        F.col("day").cast("string").alias("patent_date"), F.concat(F.lit("A qubit. "), F.col("text")).alias("patent_abstract"),
        F.when(F.col("doc_id") % 4 == 0, "Other").otherwise(F.concat(F.element_at(assignees, F.col("ticker")), F.lit(" Ltd"))).alias("assignee_organization"),
    )
    return items(spark, sf_dir).select("ticker", F.to_json(F.struct(F.array(patent).alias("patents"))).alias("payload"))


ASSIGNEES = {row[0]: row[4] for row in fixed.COMPANIES}


@BOOK.add(
    "patent_events",
    "WITH " + ITEMS_SQL + """
SELECT d.ticker, day AS date, 'Patent: ' || title || CASE d.doc_id % 3 WHEN 0 THEN ' Quantum' WHEN 1 THEN ' with a qubit' ELSE '' END AS title,
       md5('A qubit. ' || text) AS digest, 'medium' AS significance, 'https://patents.google.com/patent/US' || d.doc_id AS url
FROM d JOIN documents USING (doc_id) WHERE day >= DATE '2024-03-01' AND d.doc_id % 4 <> 0""",
)
def patent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.patent_events(patent_payloads(spark, sf_dir), F.lit("2024-03-01").cast("date"), ASSIGNEES)
    return events.select("ticker", "date", "title", F.md5("content").alias("digest"), "significance", "url")


def filing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("Filer "), F.col("doc_id")), F.lit("Second"))
    )
    hit = F.struct(F.struct(F.col("day").cast("string").alias("file_date"), names.alias("display_names")).alias("_source"))
    payload = F.to_json(F.struct(F.struct(F.array_repeat(hit, 12).alias("hits")).alias("hits")))
    return items(spark, sf_dir).select("ticker", F.col("source").alias("company"),
        F.when(F.col("doc_id") % 7 != 0, F.lit("1")).otherwise(F.when(F.col("doc_id") % 2 == 0, "")).alias("cik"), payload.alias("payload"))


@BOOK.add(
    "filing_events",
    "WITH " + ITEMS_SQL + """,
f AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE 'Filer ' || doc_id END AS filer FROM d CROSS JOIN range(12) WHERE doc_id % 7 <> 0)
SELECT ticker, day AS date, 'Insider transaction: ' || filer || ' at ' || source AS title,
       'Form 4 filing by ' || filer || '. Filed ' || day || '.' AS content FROM f""",
)
def filing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hits per payload; companies without a CIK are left out."""
    events = feeds.filing_events(filing_payloads(spark, sf_dir))
    return events.select("ticker", "date", "title", "content")


REPOS = ["Qiskit/qiskit", "quantumlib/Cirq", "PennyLaneAI/pennylane", "CQCL/tket", "rigetti/pyquil", "unknown/x"]


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.element_at(F.array(*[F.lit(r) for r in REPOS]), (F.col("doc_id") % 6 + 1).cast("int"))
    header = F.when(F.col("doc_id") % 4 != 0, F.concat(
        F.lit('<https://h/c?per_page=1&page=2>; rel="next", <https://h/c?per_page=1&page='), F.col("doc_id"), F.lit('>; rel="last"')
    ))
    return items(spark, sf_dir).select(
        repo.alias("repo"), header.alias("link_header"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("v"), F.col("doc_id"))).alias("tag_name"),
        F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z")).alias("published_at"),
    )


@BOOK.add(
    "repository_events",
    "WITH " + ITEMS_SQL + """,
r AS (SELECT list_extract(['Qiskit/qiskit','quantumlib/Cirq','PennyLaneAI/pennylane','CQCL/tket','rigetti/pyquil','unknown/x'], doc_id % 6 + 1) AS repo,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id ELSE 1 END AS commits,
  CASE WHEN doc_id % 2 = 0 THEN 'Latest release: v' || doc_id || ' (' || day || ')' ELSE '' END AS release FROM d)
SELECT list_extract(['IBM','GOOGL','QNT','QNT','RGTI',''], list_position(['Qiskit/qiskit','quantumlib/Cirq','PennyLaneAI/pennylane','CQCL/tket','rigetti/pyquil','unknown/x'], repo)) AS ticker,
  'GitHub: ' || repo || ' - ' || commits || ' commits in 30d' AS title,
  'Repository ' || repo || ' had ' || commits || ' commits in the last 30 days. ' || release AS content,
  CASE WHEN commits > 50 THEN 'high' WHEN commits > 10 THEN 'medium' ELSE 'low' END AS significance FROM r""",
)
def repository_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.repository_events(activity(spark, sf_dir), as_of())
    return events.select("ticker", "title", "content", "significance")


PAPER_WORDS = [" logical qubit Qiskit", " scalable annealing", " trapped ion record", " plain", " breakthrough by Google"]


def atom(rows: DataFrame) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in PAPER_WORDS]), (F.col("doc_id") % 5 + 1).cast("int"))
    entry = tag("entry", F.concat(
        tag("title", escaped(F.concat("title", word))), tag("summary", escaped(F.col("body"))),
        tag("published", F.concat(F.col("day").cast("string"), F.lit("T10:00:00Z"))),
        tag("id", F.concat(F.lit("http://p/"), F.col("doc_id"))),
    ))
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), entry, F.lit("</feed>"))
    return rows.withColumn("payload", feed)


def papers_sql() -> str:
    return ITEMS_SQL + f""",
p AS (SELECT *, trim(title || list_extract([' logical qubit Qiskit', ' scalable annealing', ' trapped ion record', ' plain', ' breakthrough by Google'], doc_id % 5 + 1)) AS full_title,
             body AS summary FROM d),
q AS (SELECT *, lower(full_title || ' ' || summary) AS low FROM p),
papers AS (SELECT *, CASE WHEN contains(low, 'ionq') OR contains(low, 'trapped ion') THEN 'IONQ'
  WHEN contains(low, 'rigetti') OR contains(low, 'superconducting') THEN 'RGTI' WHEN contains(low, 'd-wave') OR contains(low, 'annealing') THEN 'QBTS'
  WHEN contains(low, 'quantinuum') OR contains(low, 'honeywell') THEN 'QNT' WHEN contains(low, 'ibm') OR contains(low, 'qiskit') THEN 'IBM'
  WHEN contains(low, 'google') OR contains(low, 'cirq') THEN 'GOOGL' ELSE 'IONQ' END AS paper_ticker FROM q)"""


@BOOK.add(
    "conference_events",
    "WITH " + papers_sql() + """
SELECT paper_ticker AS ticker, day AS date, 'Conference paper (QIP): ' || full_title AS title, summary AS content, 'http://p/' || doc_id AS url FROM papers""",
)
def conference_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = atom(items(spark, sf_dir)).withColumn("conference", F.lit("QIP"))
    return feeds.conference_events(payloads).select("ticker", "date", "title", "content", "url")


@BOOK.add(
    "arxiv_events",
    "WITH " + papers_sql() + """
SELECT paper_ticker AS ticker, day AS date, 'arXiv: ' || full_title AS title, summary AS content, 'http://p/' || doc_id AS url,
  CASE WHEN regexp_matches(lower(full_title), 'logical qubit|fault-tolerant|error correction|breakthrough') THEN 'high'
       WHEN regexp_matches(lower(full_title), 'scalable|milestone|record|novel') THEN 'medium' ELSE 'low' END AS significance FROM papers""",
)
def arxiv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = feeds.arxiv_events(atom(items(spark, sf_dir)))
    return events.select("ticker", "date", "title", "content", "url", "significance")


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    papers = atom(rows)
    news = rss(rows)
    return feeds.all_events(
        feeds.patent_events(patent_payloads(spark, sf_dir), F.lit("2024-03-01").cast("date"), ASSIGNEES),
        feeds.filing_events(filing_payloads(spark, sf_dir)),
        feeds.job_events(news, as_of()),
        feeds.repository_events(activity(spark, sf_dir), as_of()),
        feeds.conference_events(papers.withColumn("conference", F.lit("QIP"))),
        feeds.arxiv_events(papers),
        feeds.news_events(news, as_of()),
    )


@BOOK.add(
    "feed_union",
    "WITH " + papers_sql() + f""",
j AS (SELECT {DAY_SQL} AS date, trim(title || ' hiring') AS title FROM d
      UNION ALL SELECT {DAY_SQL}, '<b>' || replace(title, ']]>', '') || '</b> layoff' FROM d),
u AS (SELECT 'patent' AS source_type, day AS date FROM d WHERE day >= DATE '2024-03-01' AND doc_id % 4 <> 0
      UNION ALL SELECT 'insider', day FROM d CROSS JOIN range(12) WHERE doc_id % 7 <> 0
      UNION ALL SELECT 'job', date FROM j UNION ALL SELECT 'github', DATE '2024-12-31' FROM d
      UNION ALL SELECT 'conference', day FROM d UNION ALL SELECT 'arxiv', day FROM d
      UNION ALL SELECT 'news', date FROM j UNION ALL SELECT 'news', DATE '2024-12-31' FROM d)
SELECT source_type, count(*) AS events, max(date) AS newest FROM u WHERE date >= DATE '2024-12-31' - 90 GROUP BY 1""",
)
def feed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources in one frame, the last ninety days of them per source."""
    latest = feeds.recent(everything(spark, sf_dir), as_of(), 90)
    return latest.groupBy("source_type").agg(F.count("*").alias("events"), F.max("date").alias("newest"))


@BOOK.add(
    "feed_source",
    "WITH " + ITEMS_SQL + "\nSELECT 'arxiv' AS source_type, day AS date, count(*) AS events FROM d GROUP BY ALL",
)
def feed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = feeds.newest_events(feeds.one_source(everything(spark, sf_dir), "arxiv"))
    return only.groupBy("source_type", "date").agg(F.count("*").alias("events"))


@BOOK.add(
    "newest_events",
    "WITH " + papers_sql() + f""",
j AS (SELECT doc_id, ticker, {DAY_SQL} AS date, trim(title || ' hiring') AS title FROM d
      UNION ALL SELECT doc_id, ticker, {DAY_SQL}, '<b>' || replace(title, ']]>', '') || '</b> layoff' FROM d),
u AS (SELECT 'arxiv' AS source_type, paper_ticker AS ticker, day AS date, 'arXiv: ' || full_title AS title, 'http://p/' || doc_id AS url FROM papers
      UNION ALL SELECT 'job', ticker, date, 'Hiring signal: ' || title, 'http://x/' || doc_id FROM j
        WHERE regexp_matches(lower(title), 'hiring|job|layoff|workforce|engineer|recruit'))
SELECT CAST(row_number() OVER (ORDER BY date DESC, source_type, ticker, title, url) AS INTEGER) AS place, source_type, ticker, date, md5(title) AS title, url
FROM u QUALIFY place <= 200""",
)
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred newest events of two sources, numbered as they are listed: a top-k listing."""
    rows = items(spark, sf_dir)
    events = feeds.all_events(feeds.arxiv_events(atom(rows)), feeds.job_events(rss(rows), as_of()))
    listed = feeds.newest_events(events, 200).select("source_type", "ticker", "date", "title", "url")
    # Two hundred rows, in the order of the listing.
    numbered = listed.groupBy().agg(F.collect_list(F.struct("*")).alias("rows")).select(F.posexplode("rows").alias("at", "e"))
    return numbered.select((F.col("at") + 1).alias("place"), "e.*").withColumn("title", F.md5("title"))


@BOOK.add(
    "significance",
    "WITH " + ITEMS_SQL + """
SELECT doc_id, CASE WHEN regexp_matches(lower(title), 'logical qubit|fault-tolerant|error correction|breakthrough') THEN 'high'
       WHEN regexp_matches(lower(title), 'scalable|milestone|record|novel') THEN 'medium' ELSE 'low' END AS paper,
  CASE WHEN regexp_matches(lower(title), 'earnings|revenue|contract|partnership|breakthrough') THEN 'high' ELSE 'medium' END AS news,
  CASE WHEN contains(lower(title), 'layoff') THEN 'high' ELSE 'medium' END AS job,
  CASE WHEN doc_id > 50 THEN 'high' WHEN doc_id > 10 THEN 'medium' ELSE 'low' END AS commits FROM d""",
)
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return items(spark, sf_dir).select(
        "doc_id", t.paper_significance(title).alias("paper"), t.news_significance(title).alias("news"),
        t.job_significance(title).alias("job"), t.commit_significance(F.col("doc_id")).alias("commits"),
    )
