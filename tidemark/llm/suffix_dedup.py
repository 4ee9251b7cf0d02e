"""Repeated passages, found by sorting suffixes in buckets.

A passage is ``SPAN`` bytes long. The suffixes that start a passage are taken together in stretches:
every passage has an anchor, the least hash of the ``GRAM``-byte strings in it, and neighbours that
share one are a stretch. Equal passages have equal anchors, so the anchor is the leading token that
stretches are sorted by; after it come their bytes, document and place. Only stretches whose anchor
occurs twice are sorted at all.

Splitters sampled from the stretches cut that order into buckets. A bucket sorts its stretches by
multikey quicksort: one that equals the one before it starts only passages that were there
earlier. Where an anchor has several different stretches, their single suffixes are sorted the same
way. Across a boundary, the splitter is the row before a bucket's first row; suffixes of an
anchor that lies on both sides of a boundary are compared once more over all buckets.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import columns_of, map_arrays, map_rows, to_arrow, written

SPAN = 100
GRAM = 24
#: Neighbouring suffixes in one stretch, at most, and bytes that are anchored at once.
STRETCH = 128
BLOCK = 1 << 15
PLACE_BITS = 20
#: Stretches of a bucket (a task sorts a quarter of that at once, unless one anchor has more), sampled stretches for each splitter, and buckets, at most.
BUCKET_ROWS = 100_000
SAMPLE = 32
MOST_BUCKETS = 65_536
SEED = 20240311
#: Stands for a null id.
NO_ID = -(1 << 63)

STRETCHES = "bucket int, v long, doc long, twin long, start long, n int, multi boolean, bytes binary"
FOUND = "doc long, twin long, start long, upto long, suffix binary"


@lru_cache(maxsize=1)
def byte_codes():
    import numpy as np

    return np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data):
    """A hash of each ``GRAM``-byte string of ``data``, from hashes of 1, 2, 4, 8 and 16 bytes."""
    import numpy as np

    def beside(left, right, apart: int):
        size = len(right) - apart
        both = left[:size] * np.uint64(0x9E3779B97F4A7C15)
        both += right[apart:]
        return both

    by_size, size = {1: byte_codes()[data]}, 1
    while size < 16:
        by_size[2 * size] = beside(by_size[size], by_size[size], size)
        size *= 2
    mixed = beside(by_size[16], by_size[GRAM - 16], 16)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(1)).astype(np.int64)


def least_ahead(values, width: int):
    """For each place, the least of the ``width`` values from there on, and its place: the first of
    those whose upper bits are least. Upper bits and place share a number, so that one minimum
    finds both."""
    import numpy as np

    low = np.int64((1 << PLACE_BITS) - 1)
    least = (values & ~low) | np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[step:], least[: len(least) - step])
        size += step
    at = least & low
    return values[at], at


def stretches_of(data, ends):
    """Stretches of the suffixes of several texts that lie one after the other in ``data`` and end
    at ``ends``: arrays of first place, number of suffixes, anchor, and whether the anchor occurs
    more than once in the stretch."""
    import numpy as np

    if len(data) < SPAN:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    least, at = least_ahead(gram_hashes(data), SPAN - GRAM + 1)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    # A text's suffixes end where fewer than SPAN bytes are left, and the next text begins anew.
    for border in (ends, ends - SPAN + 1):
        new[border[(border >= 0) & (border < len(least))]] = True
    first = np.flatnonzero(new)
    counts = np.diff(first, append=len(least))
    pieces = -(-counts // STRETCH)
    if (pieces > 1).any():
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + STRETCH * place
        counts = np.diff(first, append=len(least))
    keep = first + SPAN <= ends[np.searchsorted(ends, first, side="right")]
    first, counts = first[keep], counts[keep]
    # The first place of the anchor only moves to the right.
    return first, counts, least[first], at[first] != at[first + counts - 1]


def anchored(texts: Iterator[tuple]) -> Iterator[tuple]:
    """Stretches of (key, bytes) rows, block by block: (keys of the block, number of the key of each
    stretch, places in the text, numbers of suffixes, anchors, multi, data, places in the data).
    Short texts share a block and a long one is cut into blocks that overlap, so memory does not
    grow with it."""
    import numpy as np

    def block(group):
        keys, bases, parts = zip(*group)
        sizes = np.array([len(part) for part in parts], np.int64)
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes)
        first, counts, anchors, multi = stretches_of(data, ends)
        of = np.searchsorted(ends, first, side="right")
        return keys, of, first + (np.array(bases, np.int64) - ends + sizes)[of], counts, anchors, multi, data, first

    group, held = [], 0
    for key, text in texts:
        for base in range(0, max(len(text) - SPAN + 1, 0), BLOCK):
            part = text[base : base + BLOCK + SPAN - 1]
            group.append((key, base, part))
            held += len(part)
            if held >= BLOCK:
                yield block(group)
                group, held = [], 0
    if group:
        yield block(group)


def unpacked(rows: Iterator[tuple]) -> Iterator[tuple]:
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for doc, twin, blob, *rest in rows:
        yield (doc, twin, *rest), reader.decompress(blob)


def pack(texts: DataFrame) -> DataFrame:
    """The texts as compressed bytes, which is what goes through a shuffle."""

    def rows(tuples):
        import zstandard

        writer = zstandard.ZstdCompressor(level=3)
        for doc, twin, text in tuples:
            yield doc, twin, writer.compress((text or "").encode())

    return map_rows(texts, rows, "doc long, twin long, blob binary")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc``, ``twin`` and ``text``, and whether ids repeat: ``twin`` tells texts apart that share
    an id and is 0 for all others. A null id becomes the least number."""
    texts = columns_of(docs, doc=id_col, text=text_col).select(
        F.coalesce(F.col("doc").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")
    )
    shared = written(
        texts.groupBy(F.col("doc").alias("shared_id")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "ids"
    )
    if shared.isEmpty():
        return texts.select("doc", F.lit(0).cast("long").alias("twin"), "text"), False
    twin = F.when(F.col("rows").isNotNull(), F.xxhash64("text")).otherwise(0)
    marked = texts.join(shared, F.col("doc") == F.col("shared_id"), "left")
    return marked.select("doc", twin.alias("twin"), "text"), True


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """``v`` and ``times`` of anchors that occur more than once; added up within a block, before the
    shuffle and after it."""

    def arrays(tuples):
        import numpy as np

        for _, _, _, _, anchors, multi, _, _ in anchored((None, text.encode()) for _, _, text in tuples):
            values, place = np.unique(anchors, return_inverse=True)
            yield values, np.bincount(place, weights=1 + multi).astype(np.int64)

    counted = map_arrays(texts, arrays, "v long, times long").groupBy("v").agg(F.sum("times").alias("times"))
    return counted.filter("times > 1")


def anchors_by_document(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``doc``, ``twin`` and ``anchors``: its anchors that occur more than once in the corpus. An
    anchor in a third of all documents is a skewed key of a plain join, which Spark splits."""

    def arrays(tuples):
        import numpy as np

        for keys, of, _, _, anchors, _, _, _ in anchored(((doc, twin), text.encode()) for doc, twin, text in tuples):
            known = np.array(keys, np.int64)
            yield anchors, known[of, 0], known[of, 1]

    held = map_arrays(texts, arrays, "v long, doc long, twin long")
    return held.join(repeated.select("v"), "v").groupBy("doc", "twin").agg(F.collect_set("v").alias("anchors"))


def stretch_rows(texts: DataFrame, by_document: DataFrame, cuts: list[tuple]) -> DataFrame:
    """The stretches (:data:`STRETCHES`) whose anchors are repeated, from whole texts, with the
    number of their bucket between ``cuts``."""
    held = by_document.select(F.col("doc").alias("of_doc"), F.col("twin").alias("of_twin"), "anchors")
    wanted = pack(texts).join(held, (F.col("doc") == F.col("of_doc")) & (F.col("twin") == F.col("of_twin")))

    def arrays(tuples):
        import numpy as np

        values = np.array([cut[0] for cut in cuts], np.int64)
        for keys, of, places, counts, anchors, multi, data, first in anchored(unpacked(tuples)):
            # An anchor that any text of the block lists is repeated for all of them.
            kept = np.flatnonzero(np.isin(anchors, np.concatenate([np.asarray(key[2], np.int64) for key in keys])))
            if not len(kept):
                continue
            raw, known = data.tobytes(), np.array([key[:2] for key in keys], np.int64)
            v, place, n, begin = anchors[kept], places[kept], counts[kept], first[kept]
            doc, twin = known[of[kept], 0], known[of[kept], 1]
            sizes = n + SPAN - 1
            parts = [raw[a:z] for a, z in zip(begin.tolist(), (begin + sizes).tolist())]
            bucket = np.searchsorted(values, v, side="left")
            for i in np.flatnonzero(np.isin(v, values)).tolist():
                bucket[i] = bisect_left(cuts, (int(v[i]), parts[i], int(doc[i]), int(twin[i]), int(place[i])))
            yield bucket.astype(np.int32), v, doc, twin, place, n.astype(np.int32), multi[kept], binary(parts, sizes)

    return map_arrays(wanted.select("doc", "twin", "blob", "anchors"), arrays, STRETCHES)


def binary(parts: list[bytes], sizes) -> pa.Array:
    """A column of bytes."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(parts))])


def splitters(texts: DataFrame, by_document: DataFrame, rows: int, buckets: int) -> list[tuple]:
    """Keys (anchor, bytes, document, twin, place) of real stretches that cut the order into even
    buckets.

    They come from the documents with the least hashes, about ``SAMPLE`` stretches for each bucket,
    so what reaches the driver is bounded by ``MOST_BUCKETS``.
    """
    if buckets < 2:
        return []
    share = math.ceil(min(1.0, SAMPLE * buckets / rows) * (1 << 20))
    few = F.pmod(F.xxhash64(F.lit(SEED), "doc", "twin"), F.lit(1 << 20)) < F.lit(share)
    sample = stretch_rows(texts.filter(few), by_document.filter(few), []).select("v", "bytes", "doc", "twin", "start")
    keys = sorted((v, bytes(part), doc, twin, start) for v, part, doc, twin, start in sample.collect())
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def words_of(data):
    """The eight bytes from each place of ``data`` on, as a number that sorts like them."""
    import numpy as np

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 1]
    return np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)


def multikey_sort(words, starts, lengths, keys, ties):
    """Order of strings by ``keys``, then their bytes, then ``ties`` (first one first), and for each
    place of the order whether key and bytes are those of the place before.

    Multikey quicksort, eight bytes at a time. The first row of a part is its pivot: where all rows
    have its word, the part goes on to the next word as it is; other parts are parted by the word.
    All parts of a depth are taken together.
    """
    import numpy as np

    total = len(starts)
    order = np.argsort(keys, kind="stable")
    head = np.ones(total, bool)
    head[1:] = keys[order][1:] != keys[order][:-1]
    part = np.maximum.accumulate(np.where(head, np.arange(total), 0))
    open_rows = np.arange(total)
    depth = 0
    while True:
        # A part of one row, or of rows that have ended, needs no more words.
        sizes = np.bincount(part[open_rows], minlength=total)
        open_rows = open_rows[(sizes[part[open_rows]] > 1) & (lengths[order[open_rows]] >= depth)]
        if not len(open_rows):
            break
        rows, of = order[open_rows], part[open_rows]
        # Of strings that agree so far, one that ends here is before those that go on.
        left = np.minimum(lengths[rows] - depth, 9)
        word = words[np.minimum(starts[rows] + depth, len(words) - 1)]
        short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        word = word >> short << short
        head = np.ones(len(of), bool)
        head[1:] = of[1:] != of[:-1]
        group = np.cumsum(head) - 1
        pivot = np.flatnonzero(head)[group]
        other = (word != word[pivot]) | (left != left[pivot])
        mixed = np.flatnonzero((np.bincount(group, weights=other) > 0)[group])
        if len(mixed):
            now = mixed[np.lexsort((left[mixed], word[mixed], of[mixed]))]
            places = open_rows[mixed]
            order[places] = rows[now]
            word, left, of = word[now], left[now], of[now]
            head = np.ones(len(now), bool)
            head[1:] = (word[1:] != word[:-1]) | (left[1:] != left[:-1]) | (of[1:] != of[:-1])
            part[places] = np.maximum.accumulate(np.where(head, places, 0))
        depth += 8
    order = order[np.lexsort((*[t[order] for t in reversed(ties)], part))]
    same = np.zeros(total, bool)
    same[1:] = part[1:] == part[:-1]
    return order, same


def sorted_stretches(columns: dict, lower: tuple | None, upper: tuple | None) -> Iterator[tuple]:
    """What a bucket finds in a slice of its stretches, all those of an anchor together: arrays of
    ranges of bytes (document, twin, place, end, None) to remove, and, for anchors on a boundary, of
    each different suffix (document, twin, place, None, bytes)."""
    import numpy as np

    v, doc, twin, start, n, multi = (columns[name] for name in ("v", "doc", "twin", "start", "n", "multi"))
    data, lengths = columns["data"], n.astype(np.int64) + SPAN - 1
    begins = np.cumsum(lengths) - lengths
    words = words_of(data)
    order, same = multikey_sort(words, begins, lengths, v, (doc, twin, start))
    top = order[0]
    if lower is not None and v[top] == lower[0] and data[begins[top] : begins[top] + lengths[top]].tobytes() == lower[1]:
        # The splitter itself is the row before the bucket's first one.
        same[0] = True
    found = order[same]
    if len(found):
        yield doc[found], twin[found], start[found], start[found] + lengths[found], None

    rows = order[~same]
    if not len(rows):
        return
    # Anchors with one stretch, found once in it, have no other equal suffixes.
    head = np.ones(len(rows), bool)
    head[1:] = v[rows][1:] != v[rows][:-1]
    group = np.cumsum(head) - 1
    border = np.zeros(len(rows), bool)
    for key in (lower, upper):
        if key is not None:
            border |= v[rows] == key[0]
    several = (np.bincount(group) > 1)[group] | (np.bincount(group, weights=multi[rows]) > 0)[group] | border
    rows, border = rows[several], border[several]
    if not len(rows):
        return
    counts = n[rows].astype(np.int64)
    of = np.repeat(np.arange(len(rows)), counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = rows[of]
    at, place = begins[row] + inner, start[row] + inner
    order, same = multikey_sort(words, at, np.full(len(at), SPAN), v[row], (doc[row], twin[row], place))
    ended = np.zeros(len(at), bool)
    ended[order] = same
    # Neighbours that are removed together are one range.
    together = ended[1:] & ended[:-1] & (of[1:] == of[:-1])
    a = np.flatnonzero(ended & ~np.concatenate([[False], together]))
    b = np.flatnonzero(ended & ~np.concatenate([together, [False]]))
    if len(a):
        yield doc[row[a]], twin[row[a]], place[a], place[b] + SPAN, None
    left = np.flatnonzero(border[of] & ~ended)
    for low in range(0, len(left), 65_536):
        i = left[low : low + 65_536]
        yield doc[row[i]], twin[row[i]], place[i], None, [data[k : k + SPAN].tobytes() for k in at[i].tolist()]


def sorted_buckets(stretches: DataFrame, cuts: list[tuple], slice_rows: int) -> DataFrame:
    """Stretches sorted in their buckets, which lie between ``cuts``: :data:`FOUND` rows.

    Spark brings a bucket's rows in the order of their anchors, from disk if need be, and the task
    sorts them slice by slice.
    """
    import numpy as np

    schema = stretches.sparkSession.createDataFrame([], FOUND).schema
    arrow = to_arrow(schema)
    dealt = stretches.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "v")

    def slices(batches):
        held, most = [], slice_rows
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(name).to_numpy() for name in ("bucket", "v")]
            whole = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]))
            ready = int(whole[-1]) + 1 if len(whole) else 0
            if ready:
                yield table.slice(0, ready)
            held, most = table.slice(ready).to_batches(), slice_rows if ready else 2 * most
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held)

    def run(batches):
        for table in slices(batches):
            buckets = table.column("bucket").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = table.slice(low, high - low)
                columns = {name: part.column(name).to_numpy() for name in ("v", "doc", "twin", "start", "n", "multi")}
                columns["data"] = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
                number = int(buckets[low])
                below = cuts[number - 1] if number else None
                above = cuts[number] if number < len(cuts) else None
                for found in sorted_stretches(columns, below, above):
                    size = len(found[0])
                    filled = [pa.nulls(size, f.type) if c is None else pa.array(c, f.type) for c, f in zip(found, arrow)]
                    yield pa.RecordBatch.from_arrays(filled, schema=arrow)

    return dealt.mapInArrow(run, schema)


def repeated_ranges(texts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc``, ``twin`` and ``ranges``: byte ranges that were there earlier, in no order."""
    repeated = written(repeated_anchors(texts), "anchors")
    rows = repeated.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    by_document = written(anchors_by_document(texts, repeated), "held")
    cuts = splitters(texts, by_document, rows, min(MOST_BUCKETS, math.ceil(rows / bucket_rows)))
    found = written(sorted_buckets(stretch_rows(texts, by_document, cuts), cuts, bucket_rows // 4), "found")
    # A bucket gives each different suffix of an anchor on its boundary once.
    order = Window.partitionBy("suffix").orderBy("doc", "twin", "start")
    later = found.filter("suffix IS NOT NULL").withColumn("turn", F.row_number().over(order)).filter("turn > 1")
    ranges = found.filter("suffix IS NULL").select("doc", "twin", "start", "upto").unionByName(
        later.select("doc", "twin", "start", (F.col("start") + SPAN).alias("upto"))
    )
    return ranges.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "upto")).alias("ranges"))


def joined_ranges(ranges: list[tuple]) -> list[tuple]:
    """The ranges in order; those that touch or overlap are one."""
    out: list[list[int]] = []
    for start, upto in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], upto)
        else:
            out.append([start, upto])
    return [tuple(r) for r in out]


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``id``, ``n_bytes``, ``kept`` (binary) and ``spans`` (removed ranges of bytes, end exclusive).

    A byte of a text, as UTF-8, goes if a string of ``SPAN`` bytes covers it that also starts
    earlier: in a document with a smaller id, or before in the same one. Strings are judged on the
    input. Whole texts of any length; a null text is empty, and a text under ``SPAN`` bytes stays
    whole. Ids are whole numbers; a null id is before all of them. Rows that share an id and a text
    are one document and give equal rows; those that share only the id are documents of their
    own, in the order of a hash of the text. Other columns are ignored; an empty table gives none.
    """
    texts, twins = told_apart(docs, id_col, text_col)
    each = texts.dropDuplicates(["doc", "twin"]) if twins else texts
    ranges = repeated_ranges(each, bucket_rows).select(F.col("doc").alias("of_doc"), F.col("twin").alias("of_twin"), "ranges")
    whole = pack(texts).join(ranges, (F.col("doc") == F.col("of_doc")) & (F.col("twin") == F.col("of_twin")), "left")

    def rows(tuples):
        for (doc, _, found), raw in unpacked(tuples):
            spans = joined_ranges([tuple(r.values()) for r in found or []])
            kept, at = [], 0
            for start, upto in spans:
                kept.append(raw[at:start])
                at = upto
            kept.append(raw[at:])
            yield (None if doc == NO_ID else doc), len(raw), b"".join(kept), [{"start": a, "upto": b} for a, b in spans]

    return map_rows(
        whole.select("doc", "twin", "blob", "ranges"), rows,
        "id long, n_bytes long, kept binary, spans array<struct<start long, upto long>>",
    )
