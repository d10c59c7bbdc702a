"""I-Match document fingerprints over randomised lexicon subsets (operator 8).

DataFrame functions only. A term is a lower-cased word. The lexicon holds the
terms whose inverse document frequency ``ln(N / df)`` lies in a band; as each
lexicon term is in a fixed share of the documents, the lexicon has at most
``mean distinct terms / least share`` entries whatever the count of documents.

A text's distinct lexicon terms are sorted; 51 random subsets of the lexicon (15
with 1/16 of the terms each, 10 with 1/64, 14 with 1/256, 12 with 1/1024) pick
from them, and the terms picked by a subset are hashed to 16 bits. The subsets
are drawn independently: salted hashes of a term are cut into fields of 4, 6, 8
and 10 bits, one for each subset, and a subset has the term if its field is
zero. The fingerprint is the 51 codes in hex; ``0000`` marks a subset that
picked nothing. A text without any lexicon term is coded by its whole text.
Coarse tiers tell short texts apart, fine tiers still agree where long texts
were edited in part. Likeness: of the subsets that pick a term in either text,
the share with equal codes (1 when fingerprints are equal).

Rows: null texts count as empty. Rows that repeat a ``doc_id`` are ordered by a
hash of the text. Null ``doc_id`` rows come first in the order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .decontam import word_array

#: Band of ``ln(N / df)``: terms in 20 % to 0.1 % of the documents.
LEAST_IDF, MOST_IDF = 1.6094, 6.9078
#: Bits of a subset's field (so that it has one of 2**bits terms), and subsets, by tier.
TIERS = ((4, 15), (6, 10), (8, 14), (10, 12))
#: Bits of a hash that are cut into fields: some are left, so that no difference of two such words overflows.
FIELD_BITS = 60
#: Slots of the lexicon table; a term is sought in one slot.
SLOTS = 1 << 15


def lexicon(docs: DataFrame, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """One row: an array of :data:`SLOTS` lists of the hashes of the terms in the band."""
    terms = docs.select(F.explode(F.array_distinct(word_array(F.col("text")))).alias("t")).select(F.xxhash64("t").alias("h"))
    df = terms.groupBy("h").agg(F.count("*").alias("df"))
    n = docs.select(F.count("*").alias("n"))
    idf = F.log(n.scalar() / F.col("df"))
    band = df.where(idf.between(least_idf, most_idf)).groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.collect_list("h").alias("hs"))
    slots = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(band, "slot", "left").select("slot", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))
    return cut(slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "hs"))), lambda x: x["hs"]).alias("lex")), "im-lexicon")


def lexicon_terms(text: Column, lex: Column) -> Column:
    """Sorted hashes of the distinct lexicon terms of a text; ``lex`` is the lexicon's array."""
    hashes = F.array_distinct(F.transform(word_array(text), lambda w: F.xxhash64(w)))
    return F.sort_array(F.filter(hashes, lambda h: F.array_contains(F.get(lex, F.pmod(h, F.lit(SLOTS)).cast("int")), h)))


def _with_codes(df: DataFrame, text: str, made: Column, out: str, lex: DataFrame) -> DataFrame:
    """``df`` with the text ``made`` as column ``text`` and its codes as ``out``."""
    # Below this projection stand plain columns only, so the optimizer puts the
    # one-row lexicon into the filter as a constant and no row carries it.
    kept = [c for c in df.columns if c != text]
    df = df.select("*", lex.scalar().alias("_lex")).select(*kept, made.alias(text), lexicon_terms(made, F.col("_lex")).alias("_terms"))

    subsets, words = [], 0
    for bits, count in TIERS:
        for start in range(0, count, FIELD_BITS // bits):
            fields = range(min(FIELD_BITS // bits, count - start))
            near = f"_near{words}"
            salted = F.transform("_terms", lambda h: F.shiftrightunsigned(F.xxhash64(h, F.lit(100 * bits + start)), 64 - FIELD_BITS))  # noqa: B023
            ones = sum(1 << bits * j for j in fields)
            # a field is zero, or perhaps one above a zero one: few terms are left to look at for each subset
            some = lambda f: (f - F.lit(ones)).bitwiseAND(F.bitwise_not(f)).bitwiseAND(F.lit(ones << bits - 1)) != 0  # noqa: B023, E731
            df = df.withColumn(near, F.filter(salted, some))
            subsets += [F.filter(near, lambda f: f.bitwiseAND(F.lit((1 << bits) - 1 << bits * j)) == 0) for j in fields]  # noqa: B023
            words += 1
    whole = F.transform(F.array(*[F.lit(j) for j in range(len(subsets))]), lambda j: 1 + F.pmod(F.xxhash64(F.col(text), j), F.lit(65535)).cast("int"))
    codes = F.transform(F.array(*subsets), lambda t: F.when(F.size(t) == 0, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(t), F.lit(65535)).cast("int")))
    return df.withColumn(out, F.when(F.size("_terms") == 0, whole).otherwise(codes)).drop("_terms", *[f"_near{k}" for k in range(words)])


def as_text(code: Column) -> Column:
    """Codes as one hex string."""
    return F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal codes among the subsets that picked a term in either."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda z: z))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda z: z))
    return F.when(a == b, F.lit(1.0)).when(any_ == 0, F.lit(0.0)).otherwise(same / any_)


def with_next(docs: DataFrame, columns: list[str], rows_each: int = 5000, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with ``next_<c>`` of the following row in ascending ``doc_id``; after the last comes the first.

    ``prepare`` adds the columns that are to follow, row by row.

    The order is cut into buckets of ``doc_id`` ranges of about ``rows_each``
    rows: 256 quantiles, each halved evenly as often as needed. Rows without
    ``doc_id``, and those of one that holds more than a quantile, are cut by the
    hash of their text instead, by which rows of one ``doc_id`` are ordered.
    The first row of a bucket is also dealt to the bucket before it, so one
    shuffle is enough and no task sees more than a bucket at a time.
    """
    n, nulls, bounds = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [k / 256 for k in range(257)], 10_000)).first()
    if not n:
        return prepare(docs).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    times = Counter(bounds or [0])
    many = {b: max(1, t * n // (256 * rows_each)) for b, t in times.items() if t > 1}
    edges = sorted({*times, *(b + 1 for b in many if b < 2**63 - 1)})
    wide = max(1, n // (rows_each * max(1, len(edges) - 1)))
    literal = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    coarse = F.greatest(F.size(F.filter(literal(edges), lambda b: b <= F.col("doc_id"))), F.lit(1))
    lo = F.get(literal(edges), coarse - 1)
    hi = F.coalesce(F.get(literal(edges), coarse), lo)
    own = F.get(literal([many.get(b, 0) for b in edges]), coarse - 1)
    # where a text's hash stands among all hashes, from 0 to 1
    share = F.col("_h") / F.lit(2.0**64) + 0.5
    within = lambda at, count: F.least(F.greatest(F.floor(at * count), F.lit(0)), count - 1)
    # as doubles, which don't overflow; the same double for two ids puts them into one bucket
    real = lambda c: c.cast("double")
    way = F.coalesce((real(F.col("doc_id")) - real(lo)) / F.nullif(real(hi) - real(lo), F.lit(0.0)), F.lit(0.0))
    fine = F.when(own > 0, within(share, own)).otherwise(within(way, F.lit(wide)))
    most, none = max(wide, *many.values(), 1), max(1, nulls // rows_each)
    bucket = F.coalesce(coarse.cast("long") * most + fine, within(share, F.lit(none)) - none)
    dealt = docs.withColumn("_h", F.xxhash64("text")).withColumn("_bucket", bucket)
    firsts = dealt.groupBy("_bucket").agg(F.min(F.struct("doc_id", "_h")).alias("_first"))
    before = Window.orderBy("_bucket")
    # one row for each bucket
    steps = firsts.select(F.col("_bucket").alias("_of"), "_first", F.lag("_bucket").over(before).alias("_to"))
    last = firsts.agg(F.max("_bucket").alias("m"))
    steps = steps.withColumn("_to", F.coalesce("_to", last.scalar()))
    first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_h") == F.col("_first._h"))
    ghosts = dealt.join(steps, (F.col("_bucket") == F.col("_of")) & first)
    ghosts = ghosts.select(*docs.columns, "_h", F.col("_to").alias("_bucket"), F.lit(1).alias("_ghost"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_h", "text")
    both = prepare(dealt.withColumn("_ghost", F.lit(0)).unionByName(ghosts))
    led = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("_ghost = 0").drop("_bucket", "_ghost", "_h")


def edited_text() -> Column:
    """``text`` with its last half replaced by the first part of ``next_text``."""
    half = F.floor(F.char_length("text") / 2).cast("int")
    return F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> fingerprints of each text and of its edited text, with likenesses."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lex = lexicon(docs)
    whole = F.coalesce(F.col("text"), F.lit(""))
    led = with_next(docs, ["text", "codes"], prepare=lambda df: _with_codes(df, "text", whole, "codes", lex))
    out = _with_codes(led, "edited", edited_text(), "edited_codes", lex)
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("codes")).alias("fingerprint"),
        as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )
