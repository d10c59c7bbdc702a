"""Benchmark decontamination by size-partitioned MinHash containment (operator 3).

DataFrame functions only. Words are lower-cased and parted by ASCII white
space; a shingle is five words (a shorter text is one shingle as a whole).

Test items are partitioned by the size of their shingle sets, in powers of
two. Each item is sketched by its least hashes under one random order; the
sketch of a size class is as long as a class needs: one more than a quarter of
its largest set, 32 at most. A document that holds three quarters of an item
misses at most a quarter of its shingles, so it holds one of the sketch: up to
124 shingles always, beyond that but for a chance of ``0.25**32``. The
documents' side needs no sketch and no window: its shingles stream once past
the broadcast sketches, whatever its length. Candidates are then verified on
whole sets: ``4 * |item and document| >= 3 * |item|``.

Item tables go to the executors while they have :data:`MOST_HASHES` rows at
most; beyond, the documents' shingles are joined with them by a shuffle.

Rows: null and blank texts, of items too, match nothing. Null ids of documents
or items match nothing. Repeated rows of an id count as one text's union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, distilled, keep_ids, tidy

#: Rows of item hashes that are broadcast (some 60 bytes each).
MOST_HASHES = 1_000_000
LEAST_SKETCH_SHARE, MOST_SKETCH = 4, 32


def word_array(text: Column) -> Column:
    """Lower-cased words of a text."""
    flat = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(flat, " "), "")


def shingle_rows(df: DataFrame, key: str) -> DataFrame:
    """``df(key, text)`` -> a row ``(key, h, n)`` for each place of a shingle; n is the count of places."""
    w = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    at = w.select("k", "w", F.greatest(F.size("w") - 4, F.lit(1)).alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0)))).alias("i"))
    return at.select(F.col("k").alias(key), F.xxhash64(*[F.get("w", F.col("i") + j) for j in range(5)]).alias("h"), "n")


def _with_items(shingles: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Shingles of documents joined with ``n`` ``rows(item_id, h, ...)``."""
    return shingles.join(F.broadcast(rows) if n <= MOST_HASHES else rows, "h")


@tidy("dc-result")
def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> ``doc_id, item_id, n_common, n_item, containment`` of 0.75 or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = shingle_rows(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item_id").select("item_id", "h").distinct()
    sized = sets.join(sets.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id")
    least = Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit("order")), "h")
    top = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item").cast("double"))))
    length = F.least(F.floor(top / LEAST_SKETCH_SHARE) + 1, F.lit(MOST_SKETCH))
    sized = cut(sized.withColumn("in_sketch", F.row_number().over(least) <= length), "dc-items")
    sketch = sized.where("in_sketch").select("item_id", "h", "n_item")
    n_sketch, n_all = sized.agg(F.count_if("in_sketch"), F.count("*")).first()

    stream = shingle_rows(docs, "doc_id")
    hits = _with_items(stream, sketch, n_sketch).where("4 * n >= 3 * n_item").select("doc_id")
    candidates = cut(hits.distinct(), "dc-candidates")

    whole = shingle_rows(keep_ids(docs, candidates), "doc_id")
    met = _with_items(whole, sized.select("item_id", "h", "n_item"), n_all).select("doc_id", "item_id", "n_item", "h").distinct()
    counted = met.groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_common"))
    return counted.where("4 * n_common >= 3 * n_item").select("doc_id", "item_id", "n_common", "n_item", (F.col("n_common") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no test item; columns unchanged, null ids stay."""
    got = containment(docs, items)
    bad = distilled(got, got.select("doc_id").distinct(), "dc-bad")
    return keep_ids(docs, bad, how="left_anti")


#: The same in DuckDB, with the words themselves instead of hashes.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split(translate(lower(text), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i FROM dw WHERE len(w) > 0)),
bw AS (SELECT item_id, list_filter(string_split(translate(lower(text), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda x: x <> '') w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i FROM bw WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_common, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 4 * count(*) >= 3 * n_item
"""
