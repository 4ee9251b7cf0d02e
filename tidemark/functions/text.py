"""Column expressions over text: tokens, tags, tickers, dates and fixed-width forms."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.columns import let


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_filled(*texts: Column) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(t) for t in texts])


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens without leading dollar signs.

    A trailing full stop belongs to its token, and a run of dollar signs gives the empty token.
    """
    found = F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"^\$+", "")))


def ticker_tags_in_order(text_tokens: Column, members: Column) -> Column:
    return let(text_tokens, lambda found: F.filter(members, lambda t: F.array_contains(found, F.lower(t))))


def ticker_tags(text_tokens: Column, universe: list[str]) -> Column:
    """Sorted universe members whose lower-case form is one of the tokens."""
    return ticker_tags_in_order(text_tokens, F.array(*[F.lit(t) for t in sorted(universe)]))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def mentioned_tickers(
    text: Column,
    universe: list[str],
    aliases: list[tuple[str, str]],
    default: list[str],
    mode: str = "token",
) -> Column:
    """Tickers a text mentions, in universe order, then those named by an alias, else ``default``.

    ``mode='token'`` needs the ticker as a token of its own. ``mode='substring'`` looks for the
    letters anywhere in the upper-case text, so 'python' mentions HON.
    """
    members = F.array(*[F.lit(t) for t in universe])
    if mode == "substring":
        direct = let(F.upper(text), lambda upper: F.filter(members, lambda t: F.contains(upper, t)))
    else:
        direct = ticker_tags_in_order(tokens(text), members)
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("ticker")) for n, t in aliases])
    named = let(
        F.lower(text),
        lambda lowered: F.transform(
            F.filter(names, lambda a: F.contains(lowered, a["name"])), lambda a: a["ticker"]
        ),
    )
    found = F.array_distinct(F.concat(direct, named)) if aliases else direct
    fallback = F.array(*[F.lit(t) for t in default])
    return let(found, lambda tickers: F.when(F.size(tickers) > 0, tickers).otherwise(fallback))


def first_keyword_ticker(
    text: Column,
    keywords: list[tuple[list[str], str]] = fixed.TICKER_KEYWORDS,
    default: str = fixed.DEFAULT_TICKER,
) -> Column:
    """Ticker of the first keyword group found in the text."""
    lowered = F.lower(text)
    ticker = F.lit(default)
    for words, name in reversed(keywords):
        ticker = F.when(contains_any(lowered, words), name).otherwise(ticker)
    return ticker


def keyword_level(title: Column, high: list[str], medium: list[str] | None, default: str) -> Column:
    """``high`` or ``medium`` by keywords in the lower-case title, else ``default``."""
    lowered = F.lower(title)
    level = F.lit(default)
    if medium:
        level = F.when(contains_any(lowered, medium), "medium").otherwise(level)
    return F.when(contains_any(lowered, high), "high").otherwise(level)


def paper_significance(title: Column) -> Column:
    return keyword_level(title, fixed.PAPER_HIGH_WORDS, fixed.PAPER_MEDIUM_WORDS, "low")


def news_significance(title: Column) -> Column:
    return keyword_level(title, fixed.NEWS_HIGH_WORDS, None, "medium")


def job_significance(title: Column) -> Column:
    return keyword_level(title, [fixed.JOB_HIGH_WORD], None, "medium")


def commit_significance(commits: Column) -> Column:
    return (
        F.when(commits > fixed.COMMITS_HIGH, "high")
        .when(commits > fixed.COMMITS_MEDIUM, "medium")
        .otherwise("low")
    )


def by_level(significance: Column, values: list[tuple[str, float]]) -> Column:
    """Value for a significance level; anything unknown gets the last one."""
    out = F.lit(values[-1][1])
    for level, value in reversed(values[:-1]):
        out = F.when(significance == level, value).otherwise(out)
    return out


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, fixed.TAG_PATTERN, "")


def feed_date(published: Column, fallback: Column) -> Column:
    """Day of an RFC-2822 date, with a zone name or a numeric offset, else ``fallback``."""
    bare = F.regexp_replace(strip(published), r"^[A-Za-z]+, *", "")
    moment = F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss zzz")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")),
    )
    local_day = F.regexp_extract(bare, r"^(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    written = F.to_date(F.try_to_timestamp(local_day, F.lit("d MMM yyyy")))
    return F.coalesce(F.when(moment.isNotNull(), written), fallback)


def signed(value: Column, digits: int) -> Column:
    """Sign and fixed decimals; rounding to even first, as the printed values are."""
    return F.format_string(f"%+.{digits}f", F.bround(value, digits))


def whole_percent(share: Column) -> Column:
    """A share as a whole percentage, rounded to even."""
    return F.format_string("%.0f", F.bround(share * 100, 0))


def content_id(source: Column, title: Column, observed_at: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the identifying fields."""
    fields = [F.coalesce(c, F.lit("")) for c in (source, title, observed_at, strip(text))]
    return F.substring(F.sha2(F.concat_ws("\n", *fields), 256), 1, 16)


def ledger_id(*columns: str) -> Column:
    """First 16 hex digits of SHA-256 over the named columns as JSON, in name order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, 16)


def direction(score: Column, band: float = 0.1) -> Column:
    """Three-way label: bullish above the band, bearish below it, else neutral."""
    return F.when(score > band, "bullish").when(score < -band, "bearish").otherwise("neutral")


def run_seconds(time_seconds: Column, time_ms: Column) -> Column:
    """Seconds taken: the seconds field unless missing or 0, else milliseconds, else 0."""
    return F.coalesce(F.nullif(time_seconds, F.lit(0.0)), time_ms / 1000, F.lit(0.0))


def filled(template: str, **values: Column) -> Column:
    """The template with a column's text in place of each ``{name}``."""
    parts = re.split(r"\{(\w+)\}", template)
    columns = [F.lit(part) if i % 2 == 0 else values[part] for i, part in enumerate(parts) if i % 2 or part]
    return F.concat(*columns)
