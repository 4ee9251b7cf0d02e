"""Near duplicates by a join of MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.binomial import largest_threshold
from tidemark.llm.components import components
from tidemark.llm.shared import columns_of, map_rows, without_ids, written

#: Coordinates of a signature, and how many of them are posted.
COORDINATES = 64
POSTED = 16
#: Chance that a pair at the least similarity has too few equal coordinates to be found.
LOSS = 1e-6
#: Rows of a list or group that one task compares at once.
LIST_ROWS = 512
GROUP_ROWS = 256
SEED = 20240229


@lru_cache(maxsize=1)
def coefficients():
    import numpy as np

    draws = np.random.default_rng(SEED).integers(0, 1 << 63, (2, COORDINATES), dtype=np.uint64)
    return draws[0] << np.uint64(1) | np.uint64(1), draws[1]


def shingle_set(text: str, words: int):
    """Sorted 64-bit hashes of the distinct shingles of a text: A-Z lower-cased, words cut at
    white space. Fewer words than a shingle has are one shingle; no words are none."""
    import numpy as np
    import xxhash

    terms = text.encode().lower().split()
    if not terms:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    span = min(words, len(terms))
    runs = np.full(len(terms) - span + 1, span, np.uint64)
    for i in range(span):
        runs = (runs ^ codes[i : len(codes) - span + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def signature(shingles):
    """Least value of each of ``COORDINATES`` random linear hashes over the set, in pieces that
    keep memory small for long texts; the upper 32 bits."""
    import numpy as np

    factors, shifts = coefficients()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at : at + 4096] * factors[:, None] + shifts[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sign(docs: DataFrame, words: int) -> DataFrame:
    """``id``, ``n`` shingles, ``set_key`` (equal for equal sets), ``posts`` (coordinate-value
    pairs) and ``signature`` of (``id``, ``text``) rows."""

    def rows(tuples):
        import numpy as np
        import xxhash

        places = np.arange(POSTED, dtype=np.int64) << 32
        for key, text in tuples:
            shingles = shingle_set(text or "", words)
            if not len(shingles):
                yield key, 0, None, [], None
                continue
            values = signature(shingles)
            posts = (places + values[:POSTED].astype(np.int64)).tolist()
            yield (
                key, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), posts,
                values.astype(np.uint16).tobytes(),
            )

    return map_rows(docs, rows, "id long, n long, set_key binary, posts array<long>, signature binary")


class Groups:
    """Union-find over the rows of one block."""

    def __init__(self, labels: list[int]) -> None:
        import numpy as np

        self.labels = np.asarray(labels, np.int64)

    def join(self, i: int, others) -> None:
        """Row ``i`` and the rows ``others`` become one group, named after its least label."""
        import numpy as np

        names = np.unique(self.labels[np.append(others, i)])
        if len(names) > 1:
            self.labels[np.isin(self.labels, names[1:])] = names[0]


def match_rows(payloads: list[bytes], labels: list[int], homes: list[bool], least: int) -> list[int]:
    """Labels after rows with at least ``least`` equal coordinates are joined."""
    import numpy as np

    values = np.frombuffer(b"".join(payloads), np.uint16).reshape(len(payloads), COORDINATES)
    home, groups = np.asarray(homes), Groups(labels)
    for i in range(len(payloads) - 1):
        others = np.flatnonzero((groups.labels[i + 1 :] != groups.labels[i]) & (home[i + 1 :] | home[i])) + i + 1
        if len(others):
            equal = (values[others] == values[i]).sum(axis=1)
            if (equal >= least).any():
                groups.join(i, others[equal >= least])
    return groups.labels.tolist()


def confirm_rows(payloads: list[bytes], labels: list[int], homes: list[bool], similarity: int) -> list[int]:
    """Labels after rows are joined whose sets share ``similarity`` hundredths of their union."""
    import numpy as np

    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    sizes, home, groups = np.array([len(s) for s in sets]), np.asarray(homes), Groups(labels)
    shared = None if len(sets) <= 8 else overlaps(sets)
    for i in range(len(sets) - 1):
        others = np.flatnonzero((groups.labels[i + 1 :] != groups.labels[i]) & (home[i + 1 :] | home[i])) + i + 1
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= similarity * large]
        if not len(others):
            continue
        if shared is None:
            both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others])
        else:
            both = shared[i, others]
        linked = 100 * both >= similarity * (sizes[others] + sizes[i] - both)
        if linked.any():
            groups.join(i, others[linked])
    return groups.labels.tolist()


def overlaps(sets: list):
    """Sizes of all intersections of a block's sets, from shingles that two or more hold."""
    import numpy as np

    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[place] > 1
    owner, place = owner[keep], (np.cumsum(counts > 1) - 1)[place[keep]]
    total, step = np.zeros((len(sets), len(sets)), np.int64), 8192
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        low, high = np.searchsorted(place, (at, at + step))
        held = np.zeros((len(sets), step), np.float32)
        held[owner[low:high], place[low:high] - at] = 1
        total += (held @ held.T).astype(np.int64)
    return total


def coordinate_groups(least: int) -> Callable:
    """Keys of a signature such that two with ``least`` equal coordinates share one: so many groups
    of coordinates that one of them has no unequal coordinate."""

    def keys(payload: bytes) -> list[int]:
        import numpy as np
        import xxhash

        groups = np.array_split(np.frombuffer(payload, np.uint16), COORDINATES - least + 1)
        return [xxhash.xxh3_64_intdigest(part.tobytes(), seed=i) >> 1 for i, part in enumerate(groups)]

    return keys


def joined(rows: DataFrame, link: Callable, block_rows: int, finer: Callable | None = None) -> DataFrame:
    """Edges (``a``, ``b``) that connect what ``link`` connects among the rows of each key.

    ``rows`` has ``key``, ``size`` (rows of the key), ``doc``, ``payload`` and, where a document is known
    to be connected with another, that one as ``label``; labels are what edges connect. A key of up to
    ``block_rows`` rows is one block. A larger one is first dealt into blocks twice, at random,
    which joins most of what belongs together. Rows that are still apart from their key's largest
    component are then looked up by ``finer`` keys of their payload, of which any two rows that
    ``link`` joins share one: rows of a long list that have nothing else in common never meet.
    Where there are no finer keys, or even such a key has more than ``block_rows`` rows, those that
    stay apart meet all of its blocks. No task ever holds more than two blocks, and no pairs are listed:
    a block gives an edge per row at most.
    """
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.col("doc"))
    blocks = F.ceil(F.col("size") / block_rows).cast("long")
    first = F.pmod(F.xxhash64(F.lit(1), "doc"), blocks)
    second = blocks + F.pmod(F.xxhash64(F.lit(2), "doc"), blocks)
    dealt = rows.select(
        "key",
        F.explode(F.when(F.col("size") > block_rows, F.array(first, second)).otherwise(F.array(F.lit(0).cast("long")))).alias("block"),
        F.lit(0).cast("long").alias("part"),
        "doc",
        "label",
        F.lit(True).alias("home"),
        "payload",
    )
    edges = written(in_blocks(dealt, link), "links")
    large = rows.filter(F.col("size") > block_rows)
    if large.isEmpty():
        return edges
    known = written(components(edges), "known")
    labelled = written(
        large.join(known, F.col("label") == F.col("node"), "left").select(
            "key", "size", "doc", "payload", F.coalesce("root", "label").alias("label")
        ),
        "labelled",
    )
    counted = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("held"))
    main = counted.groupBy("key").agg(
        F.max(F.struct("held", "label")).alias("main"), F.sum("held").alias("rows")
    ).filter("main.held < rows").select("key", F.col("main.label").alias("main"), (F.col("rows") - F.col("main.held")).alias("apart"))
    placed = labelled.join(written(main, "main"), "key")
    stars = known.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if finer is not None:
        return stars.union(joined(by_finer_keys(placed, finer), link, block_rows))
    parts = F.ceil(F.col("apart") / block_rows).cast("long")
    part = F.pmod(F.xxhash64(F.lit(3), "doc"), parts)
    columns = ["doc", "label", "payload"]
    at_home = placed.select("key", first.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(True).alias("home"), *columns)
    visiting = placed.filter("label != main").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), part.alias("part"), F.lit(False).alias("home"), *columns
    )
    meeting = at_home.unionByName(visiting).select("key", "block", "part", "doc", "label", "home", "payload")
    return stars.union(in_blocks(meeting, link))


def by_finer_keys(placed: DataFrame, finer: Callable) -> DataFrame:
    """``key, size, doc, label, payload`` of the rows that share a finer key with a row that is apart from
    its main component; a document counts once, however many keys it came by."""
    each = written(
        placed.groupBy("doc").agg(
            F.first("payload").alias("payload"), F.first("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("apart")
        ),
        "each",
    )

    def rows(tuples):
        for doc, apart, payload in tuples:
            for key in set(finer(payload)):
                yield key, doc, apart

    keyed = written(map_rows(each.select("doc", "apart", "payload"), rows, "key long, doc long, apart boolean"), "finer")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("apart").alias("wanted")).filter("wanted AND size > 1")
    chosen = keyed.join(written(sizes.select("key", "size"), "finer-sizes"), "key").select("key", "size", "doc")
    return written(chosen.join(each.select("doc", "label", "payload"), "doc").select("key", "size", "doc", "label", "payload"), "finer-rows")


def in_blocks(dealt: DataFrame, link: Callable) -> DataFrame:
    """Edges within each (key, block, part), from rows that come sorted by it."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for _, group in groupby(tuples, key=lambda r: r[:3]):
            members = list(group)
            if len(members) < 2:
                continue
            _, _, _, _, before, homes, payloads = zip(*members)
            after = link(list(payloads), list(before), list(homes))
            # How a document came by its label is known already.
            yield from {(old, new) for old, new in zip(before, after) if old != new}

    at = ["key", "block", "part"]
    return map_rows(dealt.repartition(*at).sortWithinPartitions(*at), rows, "a long, b long")


def candidate_groups(signed: DataFrame, similarity: int) -> DataFrame:
    """``doc`` and ``group``: texts whose signatures match, and what these match, are one group.

    ``signed`` has one row per distinct set. Its posted pairs are counted; those of one text only
    are left out, and so are texts with fewer shared pairs than a match must have. Of a text's
    remaining pairs, rarest first, a prefix is enough: whoever has the least number of equal
    pairs shares one in both prefixes. The lists of the prefixes are joined, and collisions
    outside them are counted on the signatures that the rows carry, so long lists are skipped.
    """
    least_posts = largest_threshold(POSTED, similarity / 100, LOSS)
    least = largest_threshold(COORDINATES, similarity / 100, LOSS)
    posts = signed.select("doc", F.explode("posts").alias("post"))
    lists = written(posts.groupBy("post").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "posts")
    ranked = (
        posts.join(lists, "post")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("texts", "post"))).alias("shared"))
        .filter(F.size("shared") >= least_posts)
    )
    prefixes = ranked.select(
        "doc", F.explode(F.slice("shared", F.lit(1), F.size("shared") - least_posts + 1)).alias("post")
    )
    rows = written(
        prefixes.join(signed.select("doc", "signature"), "doc").select(
            F.col("post.post").alias("key"), F.col("post.texts").alias("size"), "doc", F.col("signature").alias("payload")
        ),
        "prefixes",
    )
    edges = joined(rows, lambda *block: match_rows(*block, least), LIST_ROWS, coordinate_groups(least))
    return components(edges).select(F.col("node").alias("doc"), F.col("root").alias("group"))


def find_duplicates(
    docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``n_shingles`` and ``component``: the least id reachable over links.

    Two texts are linked if their sets of distinct ``words``-word shingles share at least
    ``similarity`` hundredths of their union. Whole texts; a text without words, or null, is linked
    with nothing. Equal sets are one text from the start, so copies cost a row each and no pairs.
    Links among the rest are found by :func:`candidate_groups` and confirmed on the full sets.

    Ids are whole numbers, or can be cast to them; others fail the job. Rows that repeat an id are
    one document: whatever one of its texts is linked with, the others are too. A row with a null
    id has a null component and links nothing. Other columns are ignored; an empty table gives no
    rows.
    """
    texts = columns_of(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    repeated = texts.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    repeated = written(repeated, "repeated")
    if repeated.isEmpty():
        return linked_texts(texts, words, similarity)
    return linked_by_id(texts, words, similarity)


def linked_by_id(texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The result where ids repeat: rows are numbered and linked, then those of an id are joined."""
    rows = written(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = linked_texts(rows.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("id"), "text"), words, similarity)
    found = written(found.filter("id IS NOT NULL").withColumnRenamed("id", "row"), "row-links")
    named = written(rows.select("id", "row").join(found, "row"), "row-groups")
    least = named.groupBy("id").agg(F.min("component").alias("first"))
    edges = named.join(least, "id").select(F.col("component").alias("a"), F.col("first").alias("b"))
    roots = components(edges).withColumnRenamed("node", "component")
    whole = written(
        named.join(roots, "component", "left").select("id", "n_shingles", F.coalesce("root", "component").alias("root")), "whole"
    )
    names = whole.groupBy("root").agg(F.min("id").alias("component"))
    nameless = sign(rows.filter("id IS NULL").select("id", "text"), words)
    return whole.join(names, "root").select("id", "n_shingles", "component").unionByName(
        nameless.select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"))
    )


def linked_texts(texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """:func:`find_duplicates` of (``id``, ``text``) rows whose ids differ or are null."""
    signed = written(sign(texts, words), "signatures")
    distinct = written(
        signed.filter("n > 0 AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("id").alias("doc"), F.first("posts").alias("posts"), F.first("signature").alias("signature")),
        "distinct",
    )
    groups = written(candidate_groups(distinct, similarity), "groups")
    sizes = written(groups.groupBy(F.col("group").alias("key")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = groups.join(sizes, F.col("group") == F.col("key")).select("doc", "key", "size")

    def sets(tuples):
        for doc, key, size, text in tuples:
            yield key, size, doc, shingle_set(text or "", words).tobytes()

    grouped = members.join(texts, F.col("doc") == F.col("id")).select("doc", "key", "size", "text")
    rows = written(map_rows(grouped, sets, "key long, size long, doc long, payload binary"), "sets")
    links = joined(rows, lambda *block: confirm_rows(*block, similarity), GROUP_ROWS)
    roots = components(links)
    named = written(
        distinct.select("set_key", "doc")
        .join(roots, F.col("doc") == F.col("node"), "left")
        .select(F.col("set_key").alias("of_set"), F.coalesce("root", "doc").alias("root")),
        "roots",
    )
    return signed.join(named, F.col("set_key") == F.col("of_set"), "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component")
    )


def without_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that with the least id; all columns as they
    were, whatever they are called. Rows that repeat an id stay or go together; those with a null
    id stay."""
    found = find_duplicates(docs, words, similarity, id_col=id_col)
    return without_ids(docs, id_col, written(found.filter("id != component").select("id").distinct(), "dropped"))
