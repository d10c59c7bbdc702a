"""MinHash near-dedup: one-permutation hashing, optimal densification, banded
buckets, star-shaped candidate links (operator 5).

1. One pass over the texts (Arrow batches) gives for each document the size of
   its set of 5-word shingles, a 128-bit digest of the set, and a sketch: one
   hash of every shingle, 256 bins, the least value of each bin. An empty bin
   borrows from a filled bin chosen by a fixed random order per bin
   (densification with independent choices, Shrivastava 2017).
2. Equal sets become one class before anything is compared, so a group of
   copies of any size costs one row.
3. 51 bands of 5 bins give bucket keys. In each bucket only the least document
   is linked with the others (a star): the count of candidates is linear in
   the rows of the buckets.
4. The full sets of documents that share a bucket are written once. Each
   document first meets two of its centres; the candidates are confirmed
   on the full sets and joined to components. Other centres follow only where
   they are still in another component.
5. A star alone can miss a link between two members that both differ from the
   centre. So in buckets that still hold more than one component, every member
   outside the bucket's least component meets the members of other components
   there, if their sizes and a sketch of 1024 bins, for small sets the sets
   themselves, allow it; these too are
   confirmed on full sets.
   No bucket is capped.

A pair at the threshold of 0.75 shares no bucket with a chance of about
``(1 - 0.75**5)**51``, one in a million.

Rows: null or blank texts have an empty set, link with nothing and stay. A
null ``doc_id`` never links. Rows that repeat a ``doc_id`` count as one
document and are linked with each other's classes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, cut, distilled, keep_ids, lists, mix64, shingle_sets, sliced, tidy
from .components import components

BINS, ROWS = 256, 5
BANDS = BINS // ROWS
#: Below so many shingles the second look compares sets, not sketches: the bins of few shingles depend on each other.
SMALL = 64
#: Bins of the sketch for the second look, four bits each. Its estimate of a
#: likeness of 0.75 has a standard deviation of 0.015 at most, that of its first
#: 128 bins 0.044; a pair is tested if it is less than four of them below.
FINE_BINS, FINE_LEAST = 1024, 0.69
COARSE_BINS, COARSE_LEAST = 128, 0.57
#: Partners that a document meets first at the second look; the others follow if these don't link it.
FIRST_TRIES = 4

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


#: Lenders that every empty bin tries at once; of those without luck each document's are sought by themselves.
TRIES = 24


@functools.cache
def _lenders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin all bins in an independent random order, and each bin's place in that order."""
    rng = np.random.default_rng(20170811)
    order = np.argsort(rng.random((bins, bins)), axis=1).astype(np.int16)
    return order, np.argsort(order, axis=1).astype(np.int16)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def one_permutation(flat: np.ndarray, at: np.ndarray, count: int = BINS) -> np.ndarray:
    """Densified sketches, a row each, of sorted non-empty sets ``flat[at[i]:at[i+1]]`` of 64-bit hashes; ``count`` is a power of two."""
    rows = len(at) - 1
    place = np.repeat(np.arange(rows) * count, np.diff(at)) + (flat >> np.uint64(65 - count.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out, has = np.zeros(rows * count, np.uint64), np.zeros(rows * count, bool)
    out[place[first]] = flat[first]
    has[place[first]] = True
    out, has = out.reshape(rows, count), has.reshape(rows, count)
    order, rank = _lenders(count)
    row, bin_ = np.nonzero(~has)
    for t in range(TRIES):
        lender = order[bin_, t]
        ok = has[row, lender]
        out[row[ok], bin_[ok]] = out[row[ok], lender[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    for i in np.unique(row).tolist():
        full, empty = np.flatnonzero(has[i]), bin_[row == i]
        out[i, empty] = out[i, full[rank[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of each sketch."""
    rows = sketch[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    key = np.tile(_SALT, (len(rows), 1))
    for j in range(ROWS):
        key = key * _STEP + rows[:, :, j]
    return mix64(key).view(np.int64)


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each bin of each sketch, 16 bins to a word."""
    low = (mix64(sketch) & np.uint64(15)).astype(np.uint8)
    return ((low[:, 0::2] << 4) | low[:, 1::2]).view(np.int64)


def _some_lists(full: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A list for each row of ``full``, the next of ``rows``' rows; null where not full."""
    offsets = np.concatenate(([0], np.cumsum(full * rows.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)), mask=pa.array(~full))


def _digests(flat: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    raw, ends = memoryview(flat).cast("B"), at.tolist()
    return [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(ends, ends[1:])]


def _sketch_slice(others: list, data: np.ndarray, bounds: np.ndarray) -> list:
    flat, at = shingle_sets(data, bounds)
    n = np.diff(at)
    keys = band_keys(one_permutation(flat, np.unique(at)))
    return [others[0], pa.array(n), pa.array(_digests(flat, at), pa.binary()), _some_lists(n > 0, keys)]


def sketches(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> size, digest and band keys of each row's set."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sliced(_sketch_slice, _SKETCH), "doc_id long, n_shingles long, set_key binary, bands array<long>"
    )


_FINE = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("set", pa.list_(pa.int64()))])
_FINE_DDL = "doc_id long, set_key binary, n long, bands array<long>, bits array<long>, set array<long>"


def _fine_slice(others: list, data: np.ndarray, bounds: np.ndarray, percent: int) -> list:
    flat, at = shingle_sets(data, bounds)
    n, real = np.diff(at), np.unique(at)
    small = (n > 0) & (percent * n < 100 * SMALL)
    sets = flat[np.repeat(small, n)].view(np.int64)
    own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n * small))).astype(np.int32)), pa.array(sets), mask=pa.array(~small))
    return [others[0], pa.array(_digests(flat, at), pa.binary()), pa.array(n), _some_lists(n > 0, band_keys(one_permutation(flat, real))), _some_lists(n > 0, sketch_bits(one_permutation(flat, real, FINE_BINS))), own]


def _differ_first(a: str, b: str, words: int) -> Column:
    """Bits in which the first words of two fine sketches differ; unrolled and short, so that it is compiled."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, words)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def _differ(a: str, b: str) -> Column:
    """Bits in which two fine sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


_SETS = pa.schema([("doc_id", pa.int64()), ("set", pa.list_(pa.int64()))])


def _set_slice(others: list, data: np.ndarray, bounds: np.ndarray) -> list:
    return [others[0], lists(*shingle_sets(data, bounds))]


def shingle_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, set`` of the documents among ``ids``, whole sets."""
    wanted = keep_ids(docs.select(F.col("doc_id").cast("long"), "text"), ids)
    return cut(wanted.mapInArrow(sliced(_set_slice, _SETS), "doc_id long, set array<long>"), "nd-sets")


def confirmed(sets: DataFrame, pairs: DataFrame, percent: int = 75) -> DataFrame:
    """Those of distinct ``pairs(a, b)`` whose full sets have ``100 * both >= percent * either``.

    The joins stand alone in their stages, so that adaptive execution can deal
    a centre of very many pairs to several tasks; rows that repeat a
    ``doc_id`` give a pair more than once.
    """
    a = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    sized = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    return cut(sized.where(F.expr(f"100 * both >= {percent} * (total - both)")).select("a", "b"), "nd-links")


def sets_of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``sets`` of the documents in ``pairs(a, b)``, which was written by :func:`cut`."""
    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    if 2 * pairs.count() <= MOST_BROADCAST:
        return sets.join(F.broadcast(wanted), F.col("doc_id") == F.col("id"), "left_semi")
    return keep_ids(sets, cut(wanted, "nd-wanted"))


@tidy("nd-result")
def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_shingles, component_id, kept``, a row for each row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sk = cut(sketches(base), "nd-sketch")
    real = sk.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    many = cut(classes.where("rep < last").select("set_key", "rep"), "nd-classes")
    # a row of a class that is not its least document drops out of the comparison
    of_class = real.select("doc_id", "set_key").join(many, "set_key").select("doc_id", "rep")
    reps = keep_ids(real, cut(of_class.where("doc_id <> rep").select("doc_id").distinct(), "nd-copies"), how="left_anti")
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    stars = keys.groupBy("key").agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("z")).where("c < z").select("key", "c")
    shared = cut(keys.join(stars, "key"), "nd-buckets")
    # whatever is compared shares a bucket: sets are made once, for these documents
    sets = shingle_table(base, cut(shared.select("doc_id").distinct(), "nd-candidates"))
    spokes = cut(shared.where("doc_id <> c").groupBy(F.col("doc_id").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n")), "nd-stars")

    # at most two centres for each document: its least one and the one it shares most buckets with
    near = spokes.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max_by("b", "n"))).alias("bs"))
    tried = cut(near.select("a", F.explode("bs").alias("b")), "nd-pairs")
    links = confirmed(sets, tried, percent)
    found = cut(components(links), "nd-cc")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose documents are not yet in one component."""
        of = found.select(F.col("node"), F.col("component"))
        ca, cb = (of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where("not coalesce(ca, a) <=> coalesce(cb, b)").select("a", "b")

    def also(pairs: DataFrame) -> None:
        """Confirm more pairs and merge their components."""
        nonlocal links, found, tried
        pairs = cut(pairs, "nd-pairs")
        if pairs.limit(1).count():
            more = confirmed(sets_of(sets, pairs), pairs, percent)
            tried = tried.unionAll(pairs)
            if more.limit(1).count():
                links = links.unionAll(more)
                found = cut(components(links), "nd-cc")

    # the other centres, where the first ones have not joined the two
    also(apart(spokes.select("a", "b").join(tried, ["a", "b"], "left_anti")))

    # members of a bucket that its star has left in other components
    marked = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    marked = cut(marked, "nd-marked")
    mixed = marked.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key", "low")
    open_ = cut(marked.join(mixed, "key"), "nd-open")
    fine = keep_ids(base, cut(open_.select("doc_id").distinct(), "nd-wanted")).mapInArrow(sliced(functools.partial(_fine_slice, percent=percent), _FINE), _FINE_DDL)
    # of rows that repeat a doc_id, each text takes part
    fine = cut(fine, "nd-fine").dropDuplicates(["doc_id", "set_key"]).drop("set_key")
    open_ = open_.join(fine, "doc_id")
    u = open_.where("comp <> low").select("key", F.col("doc_id").alias("a"), F.col("comp").alias("ca"), F.col("bits").alias("ba"), F.col("n").alias("na"), F.col("bands").alias("ka"), F.col("set").alias("sa"))
    v = open_.select("key", F.col("doc_id").alias("b"), F.col("comp").alias("cb"), F.col("bits").alias("bb"), F.col("n").alias("nb"), F.col("bands").alias("kb"), F.col("set").alias("sb"), "low")
    words = COARSE_BINS // 16
    # all in the join's condition, cheapest first; last, a pair counts in the first of its common buckets only
    meet = (
        F.expr("ca <> cb and (cb = low or a < b)")
        & F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        & F.when(F.least("na", "nb") < SMALL, F.expr(f"100 * size(array_intersect(sa, sb)) >= {percent} * (na + nb - size(array_intersect(sa, sb)))")).otherwise(
            (_differ_first("ba", "bb", words) <= int((1 - COARSE_LEAST) * words * 32)) & (_differ("ba", "bb") <= int((1 - FINE_LEAST) * FINE_BINS * 2))
        )
        & (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))
    )
    second = (
        u.join(v, "key")
        .where(meet)
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), _differ("ba", "bb").alias("differ"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    second = cut(second, "nd-rest")
    if second.limit(1).count():
        # likeliest partners first: most documents need no others
        best = Window.partitionBy("a").orderBy("differ", "b")
        also(second.withColumn("k", F.row_number().over(best)).where(f"k <= {FIRST_TRIES}").select("a", "b"))
        also(apart(second.select("a", "b").join(tried, ["a", "b"], "left_anti")))
    rep_of = of_class.distinct()
    lead = rep_of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c1"))
    lead = lead.groupBy("doc_id").agg(F.min("c1").alias("c1"))
    single = found.select(F.col("node").alias("doc_id"), F.col("component").alias("c2"))
    out = sk.select("doc_id", "n_shingles").join(lead, "doc_id", "left").join(single, "doc_id", "left")
    comp = F.coalesce(F.least("c1", "c2"), F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", comp).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Rows of ``docs`` that are kept: one document of each group of near copies; columns unchanged."""
    got = near_duplicates(docs, percent)
    gone = distilled(got, got.where("not kept").select("doc_id").distinct(), "nd-gone")
    return keep_ids(docs, gone, how="left_anti")


#: The registered query in DuckDB: all pairs with a common shingle, and the least document reachable.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a u, b v FROM l UNION ALL SELECT b, a FROM l),
r(node, low) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node WHERE r.low < e.v),
c AS (SELECT node, min(low) m FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id, coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
