"""Personal data in texts: patterns propose spans, checksums confirm, context decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import let, once
from tidemark.llm.shared import columns_of, running_sums

# Patterns, written without backtracking over long runs: possessive loops, and a match can start
# only where a run of its characters starts or the last match has ended.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
)

#: Words that make a number near them likelier to be what it looks like.
CONTEXT = {
    "email": r"e-?mail|contact|write to|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|login",
    "card": r"card|credit|visa|master|payment|karte|carte|tarjeta",
    "phone": r"phone|tel\b|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
#: Code points on either side of a span in which context words count.
NEARBY = 40
CONTEXT_SCORE = 0.3
LEAST_SCORE = 0.5


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""

    def weighed(digit: Column, i: Column) -> Column:
        value = digit.cast("int") * (1 + i % 2)
        return F.when(value > 9, value - 9).otherwise(value)

    total = F.aggregate(
        F.transform(characters(F.reverse(number)), weighed), F.lit(0), lambda done, x: done + x
    )
    return total % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(done: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (done * 100 + code - 55) % 97).otherwise((done * 10 + code - 48) % 97)

    return F.aggregate(characters(turned), F.lit(0), step) == 1


def parts_in_range(address: Column) -> Column:
    """Whether the parts of an address are at most 255, however many digits they have."""
    return F.forall(
        F.split(address, r"\."),
        lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) < 3) | (F.length(q) == 3) & (q <= "255")),
    )


def _card(match: Column) -> Column:
    def scored(number: Column) -> Column:
        n = F.length(number)
        return (
            F.when(n.between(16, 19) & luhn(number), 0.8)
            .when(n.between(13, 15) & luhn(number), 0.3)
            .otherwise(0.0)
        )

    return let(digits_of(match), scored)


def _phone(match: Column) -> Column:
    return F.when(F.length(digits_of(match)).between(8, 15), 0.6).otherwise(0.0)


# Kind, pattern, quick test that a text can hold it, score before context. Order of the output.
KINDS: list[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]]] = [
    ("email", EMAIL, lambda t: t.contains("@"), lambda m: F.lit(0.9)),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: F.when(parts_in_range(m), 0.6).otherwise(0.0)),
    ("card", CARD, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), _card),
    ("phone", PHONE, lambda t: t.contains("+"), _phone),
    ("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), lambda m: F.when(mod_97(m), 0.9).otherwise(0.0)),
]


def spans_of(text: Column, kind: str, pattern: str, may: Callable, score: Callable) -> Column:
    """Spans of one kind: array of (kind, start, end, score), code points, end exclusive.

    A text cut at the matches gives the lengths between them, so places need no search. Leftmost
    matches that do not overlap are proposed; those whose score stays below the least are
    dropped, without another try inside them.
    """
    empty = F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        return let(gaps, lambda lengths: let(running_sums(steps(found, lengths)), lambda starts: spans(found, starts)))

    def steps(found: Column, gaps: Column) -> Column:
        return F.transform(
            found, lambda m, i: F.get(gaps, i) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))
        )

    def spans(found: Column, starts: Column) -> Column:
        return F.transform(found, lambda m, i: span(m, F.get(starts, i)))

    def span(match: Column, start: Column) -> Column:
        end = start + F.length(match)
        left = F.greatest(start - NEARBY, F.lit(0))
        near = F.lower(F.substr(text, (left + 1).cast("int"), (end - left + NEARBY).cast("int")))
        context = F.when(near.rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0)
        value = let(score(match), lambda s: F.when(s > 0, F.least(s + context, F.lit(1.0))).otherwise(0.0))
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("score")
        )

    kept = F.filter(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), lambda s: s["score"] >= LEAST_SCORE)
    return F.when(may(text), kept).otherwise(empty)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text`` and ``spans``: array of (kind, start, end, score) by kind, then start.

    Proposed by patterns over the whole text, confirmed by the Luhn check (cards), the mod-97
    check (accounts), the range of parts (addresses) and digit counts (phones), and raised by
    context words within ``NEARBY`` code points; spans below ``LEAST_SCORE`` are left out. Cards
    of 13 to 15 digits need such a word. A null text counts as empty and has no spans; repeated
    rows each give a row; other columns are ignored.
    """
    rows = columns_of(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return once(rows, "spans", F.concat(*[spans_of(F.col("text"), *kind) for kind in KINDS]))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the text of all spans, for each row."""
    base = {"email": None, "ip": None, "card": None, "phone": None}

    def of(kind: str) -> Column:
        # A card of fewer than 16 digits is the method's own; its length tells.
        spans = F.filter("spans", lambda s: s["kind"] == kind)
        if kind != "card":
            return spans
        return F.filter(
            spans,
            lambda s: F.length(digits_of(F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))) >= 16,
        )

    rows = once(found, "base", F.struct(*[of(kind).alias(kind) for kind in base]))
    return rows.select(
        F.col("id").alias("doc_id"),
        *[F.size(f"base.{kind}").cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(span_text(F.concat(*[F.col(f"base.{kind}") for kind in base])), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap give one mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def cut(done: Column, s: Column) -> Column:
        mark = F.concat(
            done["out"],
            F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
            F.lit("["), F.upper(s["kind"]), F.lit("]"),
        )
        return F.struct(
            F.when(s["start"] >= done["at"], mark).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    def closed(done: Column) -> Column:
        return F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, start, cut, closed))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the spans of the text replaced by their kinds.

    A null text stays null. Whatever names the columns have, only the text is changed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = docs.select(row)
    found = once(rows, "spans", F.concat(*[spans_of(text, *kind) for kind in KINDS]))
    clean = F.when(F.col(f"row.`{text_col}`").isNotNull(), redacted(text, F.col("spans")))
    return found.select(
        *[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
