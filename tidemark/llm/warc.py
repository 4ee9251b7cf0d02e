"""WARC archives: writing, normalising whole-file gzip streams, reading by offset."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import columns_of, map_rows, shared_folder, written

#: Payloads below this many bytes are never replaced by a revisit.
REVISIT_BYTES = 1000
#: A new archive is begun once one holds this many bytes, so that no stream takes a task too long.
ARCHIVE_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20
#: Compressed bytes that one task reads back.
READ_BYTES = 16 << 20
RECORDS = "page_id long, url string, payload string, payload_bytes long, payload_digest string, refers_to long"
INDEX = (
    "archive string, offset long, length long, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def file_system(path: str):
    """The file system of a path in the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def page_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """One record per page, those to be revisits with ``refers_to``.

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the one with the largest id
    keeps its payload (each of them, if that id repeats) and the others refer to it. Payloads
    that occur once are settled on narrow rows; a payload that many pages share is one row of the
    table that is joined. A null html is an empty payload, a null url an empty one, and a page
    without an id is a response.
    """
    rows = columns_of(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    known = rows.select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1(F.col("payload").cast("binary")).alias("payload_digest"),
    )
    shared = (
        known.filter(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("pages"))
        .filter("pages > 1")
        .select("digest", "kept_id")
    )
    shared = written(shared, "payloads")
    refers = F.when(F.col("page_id") != F.col("kept_id"), F.col("kept_id"))
    return known.join(shared, F.col("payload_digest") == F.col("digest"), "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to")
    )


def record_bytes(record: tuple) -> bytes:
    """A response or revisit record, with the line ends that close it."""
    page_id, url, payload, size, digest, refers_to = record
    body = payload.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (body if refers_to is None else b"")
    target = "".join(c for c in url if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[4:4] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_streams(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one gzip stream each, as many crawlers leave them: ``archive``, ``records``.

    A task names its archives after its partition and puts them in place when they are whole, so a
    task that runs again replaces what it left.
    """

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        system, place = file_system(folder)
        system.create_dir(place, recursive=True)
        sink = squeeze = None
        number = held = count = 0

        def closed() -> tuple:
            sink.write(squeeze.flush())
            sink.close()
            name = f"part-{part:06d}-{number:04d}.warc.gz"
            system.move(f"{place}/{name}.{attempt}", f"{place}/{name}")
            return f"{folder}/{name}", count

        for record in tuples:
            if sink is None:
                sink = system.open_output_stream(f"{place}/part-{part:06d}-{number:04d}.warc.gz.{attempt}")
                squeeze, held, count = zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
            data = squeeze.compress(record_bytes(record))
            sink.write(data)
            held += len(data)
            count += 1
            if held >= archive_bytes:
                yield closed()
                sink, number = None, number + 1
        if sink is not None:
            yield closed()

    return written(map_rows(records.select(*[c.split()[0] for c in RECORDS.split(", ")]), rows, "archive string, records long"), "archives")


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in chunks."""
    opened = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            chunk = opened.decompress(data, CHUNK)
            if chunk:
                yield chunk
            if opened.eof:
                data = opened.unused_data
                opened = zlib.decompressobj(31)
            else:
                data = opened.unconsumed_tail
    if rest := opened.flush():
        yield rest


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Header fields (names in lower case) and the whole bytes of each record of a stream; no
    more than one record and one chunk are held."""
    held = bytearray()
    chunks = iter(chunks)

    def more(least: int) -> bool:
        while len(held) < least:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while True:
        if not more(2):
            return
        if held[:2] == b"\r\n":
            del held[:2]
            continue
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not more(looked + 1):
                raise ValueError("a record has no end of its header")
        fields = header_fields(bytes(held[:end]))
        total = end + 4 + int(fields["content-length"])
        if not more(total):
            raise ValueError("a record is cut off")
        yield fields, bytes(held[:total])
        del held[:total]


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def page_of(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return header_fields(head), body


def index_row(archive: str, offset: int, length: int, fields: dict, record: bytes) -> tuple:
    http, _ = http_parts(record.partition(b"\r\n\r\n")[2])
    return (
        archive, offset, length, fields["warc-type"], page_of(fields["warc-record-id"]),
        fields.get("warc-target-uri", ""), int(http["content-length"]),
        fields["warc-payload-digest"].removeprefix("sha1:"), page_of(fields.get("warc-refers-to")),
    )


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with every record as a gzip member of its own, and index it.

    A stream is inflated once, from start to end, by one task. Beside each new archive stands its
    index, a line per record; the same rows are returned, as a written table.
    """
    tasks = max(1, archives.count())

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        attempt = TaskContext.get().taskAttemptId()
        target, place = file_system(folder)
        target.create_dir(place, recursive=True)
        for (archive,) in tuples:
            name = archive.rsplit("/", 1)[-1]
            system, path = file_system(archive)
            offset = 0
            with (
                system.open_input_stream(path, compression=None) as source,
                target.open_output_stream(f"{place}/{name}.{attempt}", compression=None) as sink,
                target.open_output_stream(f"{place}/{name}.idx.{attempt}") as index,
            ):
                for fields, record in parsed(inflated(source)):
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = member.compress(record + b"\r\n\r\n") + member.flush()
                    sink.write(data)
                    row = index_row(f"{folder}/{name}", offset, len(data), fields, record)
                    index.write(("\t".join("" if v is None else str(v) for v in row[1:]) + "\n").encode())
                    yield row
                    offset += len(data)
            target.move(f"{place}/{name}.{attempt}", f"{place}/{name}")
            target.move(f"{place}/{name}.idx.{attempt}", f"{place}/{name}.idx")

    spread = archives.select("archive").repartitionByRange(tasks, "archive")
    return written(map_rows(spread, rows, INDEX), "warc-index")


def read_records(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """The indexed records, each read at its offset: ``page_id``, ``url``, ``record_type``,
    ``payload`` (null in a revisit), ``payload_bytes``, ``payload_digest``, ``refers_to``.

    A record whose payload does not have the length and digest that it states fails the job. An
    index is small against what it points to, so the number of tasks follows the bytes to read.
    """
    if tasks is None:
        held = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        tasks = max(1, math.ceil(held / READ_BYTES))
    ordered = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
    ordered = ordered.sortWithinPartitions("archive", "offset")

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        opened, source = None, None
        for archive, offset, length in tuples:
            if archive != opened:
                if source:
                    source.close()
                system, path = file_system(archive)
                opened, source = archive, system.open_input_file(path)
            source.seek(offset)
            fields, record = next(parsed(iter([zlib.decompress(source.read(length), 31)])))
            _, _, _, kind, page_id, url, size, digest, refers_to = index_row("", 0, 0, fields, record)
            body = http_parts(record.partition(b"\r\n\r\n")[2])[1] if kind == "response" else None
            if body is not None and (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                raise ValueError(f"record of page {page_id} in {archive} is damaged")
            yield page_id, url, kind, None if body is None else body.decode(), size, digest, refers_to
        if source:
            source.close()

    return map_rows(
        ordered,
        rows,
        "page_id long, url string, record_type string, payload string, payload_bytes long, "
        "payload_digest string, refers_to long",
    )


def archived(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder, normalise them and return the index."""
    spark = pages.sparkSession
    streams = write_streams(page_records(pages), shared_folder(spark, "streams"), archive_bytes)
    return normalise(streams, shared_folder(spark, "warc"))
