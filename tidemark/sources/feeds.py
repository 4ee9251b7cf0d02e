"""Landed feed payloads brought into one event form.

Payloads arrive as files or columns of text; fetching them is left to the caller. Every
normaliser returns ``source_type, ticker, date, title, content, significance, url, metadata``. All items of a
payload are read, and whole texts; ``fixed_values.FEED_LIMITS`` holds, by normaliser, the page
sizes and widths to pass where a reader wants them: ``job_events(p, day, **FEED_LIMITS["job"])``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import text as t

EVENT_FIELDS = ["source_type", "ticker", "date", "title", "content", "significance", "url", "metadata"]
RSS_SCHEMA = (
    "channel struct<item array<struct<title string, link string, pubDate string, description string>>>"
)
ATOM_SCHEMA = "entry array<struct<title string, summary string, published string, id string>>"
PATENT_SCHEMA = (
    "patents array<struct<patent_number string, patent_title string, patent_date string, "
    "patent_abstract string, assignee_organization string>>"
)
FILING_SCHEMA = "hits struct<hits array<struct<_source struct<file_date string, display_names array<string>>>>>"


def _items(payloads: DataFrame, items: Column, keep: list[str], first: int | None) -> DataFrame:
    """One row per item of a payload, with its position; ``first`` keeps the leading items."""
    wanted = items if first is None else F.slice(items, 1, first)
    return payloads.select(*keep, F.posexplode(wanted).alias("pos", "item"))


def _cut(text: Column, chars: int | None) -> Column:
    """``text``, or its first ``chars`` characters."""
    return text if chars is None else F.left(text, F.lit(chars))


def _event(source_type: str, ticker: Column, date: Column, title: Column, content: Column,
           significance: Column, url: Column, **metadata: Column) -> list[Column]:
    extra = F.to_json(F.struct(*[c.alias(k) for k, c in metadata.items()])) if metadata else F.lit("{}")
    return [
        F.lit(source_type).alias("source_type"), ticker.alias("ticker"), date.cast("date").alias("date"),
        title.alias("title"), content.alias("content"), significance.alias("significance"),
        url.alias("url"), extra.alias("metadata"),
    ]


def _or(column: Column, default: str) -> Column:
    return F.coalesce(column, F.lit(default))


def patent_events(payloads: DataFrame, since: Column, assignees: dict[str, str],
                  per_page: int | None = None, abstract_chars: int | None = None) -> DataFrame:
    """Patent pages (``ticker, payload``). The request's own filters are applied to the landed
    rows: date, assignee of the ticker, and a subject word in title or abstract."""
    rows = _items(payloads, F.from_json("payload", PATENT_SCHEMA)["patents"], ["ticker"], per_page)
    item = lambda name: F.col(f"item.{name}")
    wanted = F.lit(None).cast("string")
    for ticker, assignee in assignees.items():
        wanted = F.when(F.col("ticker") == ticker, assignee).otherwise(wanted)
    title, abstract = F.lower(_or(item("patent_title"), "")), F.lower(_or(item("patent_abstract"), ""))
    subject = F.contains(title, F.lit("quantum")) | abstract.rlike("quantum|qubit")
    matches = (
        (item("patent_date").cast("date") >= since)
        & F.contains(_or(item("assignee_organization"), ""), wanted)
        & subject
    )
    return rows.filter(matches).select(*_event(
        "patent", F.col("ticker"), item("patent_date"),
        F.concat(F.lit(fixed.PATENT_TITLE), _or(item("patent_title"), "Unknown")),
        _cut(_or(item("patent_abstract"), ""), abstract_chars), F.lit("medium"),
        F.concat(F.lit(fixed.PATENT_URL), _or(item("patent_number"), "")),
        patent_number=item("patent_number"),
    ))


def filing_events(payloads: DataFrame, first: int | None = None) -> DataFrame:
    """Insider filings (``ticker, company, cik, payload``) of the companies that have a CIK."""
    hits = F.from_json("payload", FILING_SCHEMA)["hits"]["hits"]
    known = payloads.filter(F.trim(_or(F.col("cik").cast("string"), "")) != "")
    rows = _items(known, hits, ["ticker", "company", "cik"], first)
    filer = F.coalesce(F.get("item._source.display_names", F.lit(0)), F.lit("Unknown"))
    filed = _or(F.col("item._source.file_date"), "")
    return rows.select(*_event(
        "insider", F.col("ticker"), filed,
        F.concat(F.lit(fixed.FILING_TITLE), filer, F.lit(" at "), F.col("company")),
        F.concat(F.lit(fixed.FILING_CONTENT), filer, F.lit(". Filed "), filed, F.lit(".")),
        F.lit("medium"),
        F.concat(F.lit(fixed.FILING_URL), F.col("cik"), F.lit("&type=4")),
        filer=filer, form_type=F.lit("4"),
    ))


def rss_items(payloads: DataFrame, keep: list[str], first: int | None = None) -> DataFrame:
    """Items of RSS payloads: ``keep``, ``pos`` and the item fields. Entities and CDATA are read
    as the text they stand for."""
    items = F.from_xml("payload", RSS_SCHEMA)["channel"]["item"]
    return _items(payloads, items, keep, first).select(*keep, "pos", "item.*")


def rss_articles(payloads: DataFrame, first: int | None = None, keep: list[str] = []) -> DataFrame:
    """RSS items with a title, as articles (``source`` names the feed), with the columns ``keep`` of
    their payload."""
    rows = rss_items(payloads, [*keep, "source"], first).filter(t.strip(_or(F.col("title"), "")) != "")
    clean = lambda name: t.strip(_or(F.col(name), ""))
    return rows.select(
        *keep, "source", "pos", clean("title").alias("title"), clean("link").alias("link"),
        clean("pubDate").alias("published"), clean("description").alias("description"),
    )


def job_events(
    payloads: DataFrame, as_of: Column, first: int | None = None, title_chars: int | None = None
) -> DataFrame:
    """Hiring news (``ticker, payload``): items whose title has a hiring word."""
    rows = rss_items(payloads, ["ticker"], first)
    title = _or(F.col("title"), "")
    return rows.filter(t.contains_any(F.lower(title), fixed.JOB_WORDS)).select(*_event(
        "job", F.col("ticker"), t.feed_date(F.col("pubDate"), as_of),
        F.concat(F.lit(fixed.JOB_TITLE), _cut(title, title_chars)), title,
        t.job_significance(title), _or(F.col("link"), ""),
    ))


def news_events(
    payloads: DataFrame, as_of: Column, first: int | None = None, title_chars: int | None = None
) -> DataFrame:
    """Financial news (``ticker, payload``): items, tags removed from the title."""
    rows = rss_items(payloads, ["ticker"], first)
    title = t.strip_tags(_or(F.col("title"), ""))
    return rows.select(*_event(
        "news", F.col("ticker"), t.feed_date(F.col("pubDate"), as_of), _cut(title, title_chars), title,
        t.news_significance(title), _or(F.col("link"), ""),
    ))


def repository_events(activity: DataFrame, as_of: Column, days_back: int = 30) -> DataFrame:
    """Repository activity (``repo, link_header, tag_name, published_at``): commits from the
    last page number of the link header, latest release if there is one."""
    orgs = F.create_map(*[F.lit(x) for pair in fixed.REPO_ORG_TICKERS for x in pair])
    last_page = F.nullif(F.regexp_extract(_or(F.col("link_header"), ""), r'page=(\d+)>; rel="last"', 1), F.lit(""))
    commits = F.coalesce(last_page.cast("long"), F.lit(1).cast("long"))
    release = F.coalesce(
        F.when(
            F.col("tag_name").isNotNull(),
            F.concat(F.lit(fixed.RELEASE_TEXT), F.col("tag_name"), F.lit(" ("),
                     F.left(_or(F.col("published_at"), ""), F.lit(10)), F.lit(")")),
        ),
        F.lit(""),
    )
    rows = activity.withColumn("commits", commits)
    return rows.select(*_event(
        "github",
        _or(F.try_element_at(orgs, F.split_part("repo", F.lit("/"), F.lit(1))), ""),
        as_of,
        F.concat(F.lit(fixed.REPOSITORY_TITLE), F.col("repo"), F.lit(" - "), F.col("commits"), F.lit(f" commits in {days_back}d")),
        F.concat(F.lit("Repository "), F.col("repo"), F.lit(" had "), F.col("commits"),
                 F.lit(f" commits in the last {days_back} days. "), release),
        t.commit_significance(F.col("commits")),
        F.concat(F.lit(fixed.REPOSITORY_URL), F.col("repo")),
        repo=F.col("repo"), commits=F.col("commits"),
    ))


def _papers(payloads: DataFrame, keep: list[str], summary_chars: int | None, first: int | None) -> DataFrame:
    rows = _items(payloads, F.from_xml("payload", ATOM_SCHEMA)["entry"], keep, first)
    return rows.select(
        *keep,
        t.strip(_or(F.col("item.title"), "")).alias("title"),
        _cut(t.strip(_or(F.col("item.summary"), "")), summary_chars).alias("summary"),
        F.left(_or(F.col("item.published"), ""), F.lit(10)).alias("published"),
        _or(F.col("item.id"), "").alias("link"),
    )


def conference_events(
    payloads: DataFrame, first: int | None = None, title_chars: int | None = None, summary_chars: int | None = None
) -> DataFrame:
    """Conference papers (``conference, payload``)."""
    rows = _papers(payloads, ["conference"], summary_chars, first)
    return rows.select(*_event(
        "conference", t.first_keyword_ticker(F.concat_ws(" ", "title", "summary")),
        F.col("published").try_cast("date"),
        F.concat(F.lit(fixed.CONFERENCE_TITLE), F.col("conference"), F.lit("): "), _cut(F.col("title"), title_chars)),
        F.col("summary"), F.lit("medium"), F.col("link"), conference=F.col("conference"),
    ))


def arxiv_events(
    payloads: DataFrame, first: int | None = None, title_chars: int | None = None, summary_chars: int | None = None
) -> DataFrame:
    """Research papers (``payload``), significance by title words."""
    rows = _papers(payloads, [], summary_chars, first)
    return rows.select(*_event(
        "arxiv", t.first_keyword_ticker(F.concat_ws(" ", "title", "summary")),
        F.col("published").try_cast("date"),
        F.concat(F.lit(fixed.ARXIV_TITLE), _cut(F.col("title"), title_chars)), F.col("summary"),
        t.paper_significance(F.col("title")), F.col("link"),
    ))


def all_events(*sources: DataFrame) -> DataFrame:
    """Union of normalised sources."""
    return reduce(DataFrame.unionByName, sources)


def newest_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; events of a day by source, ticker, title and link. ``limit`` keeps the first."""
    ordered = events.orderBy(F.desc("date"), "source_type", "ticker", "title", "url")
    return ordered if limit is None else ordered.limit(limit)


def recent(events: DataFrame, as_of: Column, days_back: int) -> DataFrame:
    return events.filter(F.col("date") >= F.date_sub(as_of, days_back))


def one_source(events: DataFrame, source_type: str) -> DataFrame:
    """Events of one source; an unknown source has none."""
    return events.filter(F.col("source_type") == source_type)


def unseen_articles(articles: DataFrame, history: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Articles whose title is neither in the history nor earlier in the batch. ``title_chars``
    compares shortened titles instead, which takes articles with a common beginning for one."""
    from tidemark.sources.memory import first_by

    key = F.sha2(_cut(F.col("title"), title_chars), 256)
    batch = first_by(articles.withColumn("_key", key), "_key", F.struct("seq"))
    known = history.select(F.sha2(_cut(F.col("article_title"), title_chars), 256).alias("_key"))
    return batch.join(known, "_key", "left_anti").drop("_key")
