"""Test items inside training documents, found by MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import let, once
from tidemark.llm.shared import columns_of, without_ids, written

SHINGLE = 5
#: Least share of an item's shingles, in hundredths.
CONTAINMENT = 80
#: First bits of a hash by which documents are sifted.
PREFIX_BITS = 16
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, so that neither case nor punctuation hides a copy."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def shingles(words: Column, make, span: Column | int = SHINGLE) -> Column:
    """``make`` of every run of ``span`` words; none for fewer words."""
    length = F.lit(span) if isinstance(span, int) else span

    def made(w: Column) -> Column:
        last = F.size(w) - length
        starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: make(F.slice(w, i, length)))

    return let(words, made)


def item_shingles(text: Column, make) -> Column:
    """The runs of an item; one of fewer than ``SHINGLE`` words is a single run of all its words."""

    def made(w: Column) -> Column:
        return F.when(F.size(w) > 0, shingles(w, make, F.least(F.size(w), F.lit(SHINGLE)))).otherwise(F.array())

    return let(terms(text), made)


def document_shingles(text: Column, make, spans: list[int]) -> Column:
    """The runs of a document, of each length that items have."""
    return let(terms(text), lambda w: F.concat(*[shingles(w, make, span) for span in spans]))


def spans_of(items: DataFrame) -> list[int]:
    """The lengths of runs that items have: 1 to ``SHINGLE``, so a few numbers at most."""
    sizes = items.select(F.least(F.size(terms(F.col("text"))), F.lit(SHINGLE)).alias("span")).distinct()
    return sorted(r.span for r in sizes.collect() if r.span) or [SHINGLE]


def hashed_run(run: Column) -> Column:
    return F.xxhash64(run)


def joined_run(run: Column) -> Column:
    return F.array_join(run, " ")


def sketches(items: DataFrame, containment: int = CONTAINMENT) -> DataFrame:
    """One row per item and sketch value: ``hash``, ``item``, ``n`` shingles, ``need``.

    Items are partitioned by size: those of 2^c to 2^(c+1) - 1 shingles share a sketch length,
    twice the shingles the largest of them can miss, plus two, least hashes first. A document that
    holds enough of an item misses few of them, so it has at least ``need`` of the values,
    however long the document is: the search loses nothing.
    """
    hashed = once(items, "hashes", F.array_sort(F.array_distinct(item_shingles(F.col("text"), hashed_run))))
    sized = hashed.select("item", "hashes", F.size("hashes").alias("n")).filter("n > 0")
    largest = (F.pow(F.lit(2), F.length(F.bin("n"))) - 1).cast("int")
    missed = lambda n: n - F.ceil(n * containment / 100).cast("int")
    kept = F.least(F.col("n"), 2 * missed(largest) + 2)
    return sized.select(
        F.explode(F.slice("hashes", F.lit(1), kept)).alias("hash"),
        "item",
        "n",
        (kept - missed(F.col("n"))).alias("need"),
    )


def prefix(hashed: str) -> Column:
    return F.shiftrightunsigned(hashed, 64 - PREFIX_BITS)


def kept_hashes(docs: DataFrame, values: DataFrame, spans: list[int]) -> DataFrame:
    """``doc`` and ``hash`` of the documents' runs that a sketch value may equal: those whose first
    ``PREFIX_BITS`` bits are those of one. There are at most 2^16 such prefixes, which is what is
    broadcast, whatever the size of the benchmark."""
    prefixes = values.select(prefix("hash").alias("prefix")).distinct()
    hashed = once(docs, "hashes", document_shingles(F.col("text"), hashed_run, spans))
    rows = hashed.select("doc", F.explode("hashes").alias("hash"))
    return rows.join(F.broadcast(prefixes), prefix("hash") == F.col("prefix"), "left_semi")


def candidates(docs: DataFrame, items: DataFrame, containment: int = CONTAINMENT, spans: list[int] | None = None) -> DataFrame:
    """Pairs (``doc``, ``item``) that share enough sketch values.

    Most of a document's hashes are left out before the join. The sketches are a written table:
    Spark broadcasts it where its size allows and shuffles otherwise, and a shingle that many
    documents share gives one row per document and item.
    """
    values = written(sketches(items, containment), "sketches")
    rows = kept_hashes(docs, values, spans or spans_of(items))
    shared = rows.join(values, "hash").select("doc", "item", "hash", "need").distinct()
    counted = shared.groupBy("doc", "item").agg(
        F.count(F.lit(1)).alias("shared"), F.first("need").alias("need")
    )
    return counted.filter("shared >= need").select("doc", "item")


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    containment: int = CONTAINMENT,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    least_words: int = 1,
) -> DataFrame:
    """``doc``, ``item``, ``n`` shingles of the item and ``shared`` ones, for each document that
    holds at least ``containment`` hundredths of an item's distinct shingles.

    Whole texts on both sides; what the sketches propose is confirmed on the shingles themselves,
    as words. An item of fewer than ``SHINGLE`` words is one shingle of all its words, so a
    document must hold them side by side; ``least_words`` leaves out items that are shorter and
    would be found by chance. Null and empty texts hold and are nothing. Rows that repeat an id are
    one document or item with the shingles of all; a null id is an id of its own. Other columns
    are ignored, whatever they are called; empty tables give no rows.
    """
    texts = columns_of(docs, doc=doc_col, text=text_col)
    items = columns_of(benchmark, item=item_col, text=text_col)
    if least_words > 1:
        items = items.filter(F.size(terms(F.col("text"))) >= least_words)
    spans = spans_of(items)
    pairs = written(candidates(texts, items, containment, spans), "candidates").select(
        F.col("doc").alias("of_doc"), F.col("item").alias("of_item")
    )
    of_items = once(items, "runs", item_shingles(F.col("text"), joined_run)).select(
        "item", F.explode("runs").alias("run")
    ).distinct()
    sizes = of_items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    # A document is cut once, however many items it may hold.
    proposed = pairs.select("of_doc").distinct()
    near = texts.join(proposed, F.col("doc").eqNullSafe(F.col("of_doc")), "left_semi")
    held = once(near, "runs", document_shingles(F.col("text"), joined_run, spans)).select(
        "doc", F.explode("runs").alias("run")
    ).distinct()
    of_pairs = of_items.withColumnRenamed("run", "item_run").join(pairs, F.col("item").eqNullSafe(F.col("of_item")))
    confirmed = (
        held.join(of_pairs, (F.col("run") == F.col("item_run")) & F.col("doc").eqNullSafe(F.col("of_doc")))
        .groupBy("doc", "of_item")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return (
        confirmed.join(sizes, F.col("of_item").eqNullSafe(F.col("item")))
        .filter(F.col("shared") * 100 >= F.col("n") * containment)
        .select("doc", F.col("of_item").alias("item"), "n", "shared")
    )


def without_items(
    docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", least_words: int = SHINGLE
) -> DataFrame:
    """``docs`` without the documents that hold a test item of at least ``least_words`` words: by
    default not shorter ones, whose words also stand together in clean texts. All columns as they
    were, whatever they are called."""
    found = find_items(docs, benchmark, doc_col=doc_col, least_words=least_words)
    return without_ids(docs, doc_col, written(found.select("doc").distinct(), "leaks"))
