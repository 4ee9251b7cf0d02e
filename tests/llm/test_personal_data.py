"""Personal data against plain Python over whole texts."""

import hashlib
import re

from tidemark.llm import personal_data, queries

SF_DIR = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE.items()
        for m in re.finditer(pattern, text)
        if valid(kind, m.group())
    ]


def expected(text):
    spans = base_spans(text or "")
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    counts = [sum(k == kind for k, _, _ in spans) for kind in BASE]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())


def digests(spark, texts, **more):
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, base int"
    )
    return {r.doc_id: r for r in personal_data.digest(personal_data.find_spans(docs)).collect()}


CASES = [
    None,
    "",
    "no data at all",
    "a@b.com, c.d+e@f-g.co.uk;x@y a@b..c@d.e",
    "é😀 me@x.org 1.2.3.4 and 256.1.1.1 then 1.2.3.4.5.6.7.8",
    "001.002.003.004 1.2.3.0000255 9999999999.1.1.1",
    "4111 1111 1111 1111 and 4111111111111112 and 4111-1111-1111-1111-0",
    "+1 (017) 555-7713 +123 +49 30 1234567 +1+1+12345678",
    "@".join("a1" for _ in range(400)) + ".de",
    "1" * 5000 + "@" + "b." * 5000 + "c",
    "x@" + "a." * 20000 + "a 4111 1111 1111 1111",
    "😀 1.2.3.4 " * 700,
    "me@x.org\x00\x01\x0b4111111111111111",
    "_@a.b_c@d.e %@-.- +@x.y",
]


def test_cases_match_plain_python(spark):
    got = digests(spark, CASES)
    for i, text in enumerate(CASES):
        row = got[i]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == expected(text), text


def test_documents_match_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op9_personal_data(spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for row in rows:
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == expected(docs[row.doc_id])
        assert set(f"{k}:{s}:{e}" for k, s, e in base_spans(docs[row.doc_id])) <= set(row.spans.split(",") if row.spans else [])


def test_checksums_and_context_add_spans(spark):
    texts = [
        "iban DE89 3704 0044 0532 0130 00 ok",
        "iban DE88 3704 0044 0532 0130 00 ok",
        "credit card 378282246310005 here",
        "code 378282246310005 here",
    ]
    got = digests(spark, texts)
    assert got[0].spans == "iban:5:32"
    assert got[1].spans == ""
    assert got[2].spans == "card:12:27" and got[2].n_card == 0
    assert got[3].spans == ""


def test_empty_table_and_redaction(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.digest(personal_data.find_spans(empty)).count() == 0
    docs = spark.createDataFrame(
        [(1, "é me@x.org and 1.2.3.4", "row"), (2, None, "row"), (2, None, "row")],
        "doc_id long, text string, row string",
    )
    rows = personal_data.redact(docs).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["é [EMAIL] and [IP]", None, None]
    assert rows[0].row == "row"
