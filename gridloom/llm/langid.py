"""Language identification by Bayesian evidence fusion (operator 10).

``log p(language | row)`` is the sum of four terms, for the languages that the
declared labels name often enough:

* the text: a naive Bayes model of hashed letter trigrams, over the whole
  text; the sum is tempered to :data:`MOST_EVIDENCE` trigrams, because the
  trigrams of a text depend on each other;
* the declared markup language: ``p(declared | language)``, smoothed;
* the address suffix and the host: a prior smoothed in three levels, all rows
  -> suffix -> host, from one grouped aggregation of text posteriors. A host
  without rows of its own has its suffix's prior, and so on.

The languages are counted over all labelled rows. The model is fitted on a
sample of them, for each language those of least hash: its share of
:data:`SAMPLE` rows, :data:`LEAST_SAMPLE` at least (documented bounds); the
table of declarations weighs them back. Priors use all rows.

Beside the languages there is a class ``und`` of all other text: unmodelled
languages and scripts, noise. Each trigram costs it the floor of the text's
best language, which is calibrated on the labelled rows: a quarter of the way
from a trigram at random to what that language's own texts have under the
other texts of it (each left out in turn). A row is rejected (``und``) if its
text has no letter at all, if ``und`` is its likeliest class, or if its
language is in doubt: posterior under :data:`LEAST_POSTERIOR`.

Rows: null and empty texts are ``und``. A null declared language, host or
suffix is a missing piece of evidence and counts for nothing. Repeated rows
each get an answer. With no labelled row every row is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, distilled, keep_ids, sliced, small, text_slices, tidy
from .html_text import trained
from .urls import host_of

#: Labelled rows that the model is fitted on, shared out by the languages' counts.
SAMPLE = 3000
#: Rows of a language that are sampled at least, if it has them.
LEAST_SAMPLE = 100
#: Distinct labelled texts that make a language known.
LEAST_TEXTS = 5
BUCKETS = 1 << 14
MOST_EVIDENCE = 400
LEAST_POSTERIOR = 0.5
#: Rows that a prior of a coarser level counts as.
STRENGTH = 10.0
#: Share of every language's likelihood that is spread evenly over all trigrams, seen or not.
EVEN = 0.05
#: Log likelihood of a trigram at random.
RANDOM = -float(np.log(BUCKETS))
OTHER = "und"

_FOLD = np.full(256, 32, np.uint8)
for _c in range(65, 91):
    _FOLD[_c] = _FOLD[_c + 32] = _c + 32
_FOLD[128:] = np.arange(128, 256)


def trigrams(text: bytes | np.ndarray | None) -> np.ndarray:
    """Bucket of each letter trigram of a whole text (its UTF-8 bytes); all but letters count as one blank."""
    if text is None or not len(text):
        return np.empty(0, np.int64)
    b = _FOLD[np.frombuffer(text, np.uint8)]
    if not (b != 32).any():
        return np.empty(0, np.int64)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b = np.concatenate(([32], b[keep], [32])).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


@dataclass(frozen=True)
class Profile:
    """What the fit needs of a text: a digest, its trigrams' buckets and how often each occurs."""

    digest: bytes
    buckets: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, text: bytes | np.ndarray) -> Profile:
        return cls(xxhash.xxh3_128_digest(text), *np.unique(trigrams(text), return_counts=True))


class Model:
    """Trigram likelihoods and the table of declared languages."""

    def __init__(self, languages: list[str], weights: np.ndarray, declared: np.ndarray, floor: np.ndarray | None = None):
        self.languages, self.weights, self.declared = languages, weights, declared
        self.floor = np.full(len(languages), RANDOM) if floor is None else floor

    def text_terms(self, text: bytes | np.ndarray | Profile | None) -> tuple[np.ndarray | None, int]:
        """Tempered log likelihoods, and the count of trigrams; None without a letter."""
        if isinstance(text, Profile):
            n, ll = int(text.counts.sum()), text.counts @ self.weights[text.buckets]
        else:
            t = trigrams(text)
            n, ll = len(t), self.weights[t].sum(axis=0)
        if not n or not self.languages:
            return None, 0
        return ll * min(1.0, MOST_EVIDENCE / n), n

    def with_other(self, text: bytes | np.ndarray | Profile | None, declared: str | None) -> tuple[np.ndarray | None, int]:
        """Log likelihoods of text and declaration, last that of the class of all other text; and the count of trigrams."""
        ll, n = self.text_terms(text)
        if ll is None:
            return None, 0
        other = self.floor[int(ll.argmax())] * min(n, MOST_EVIDENCE)
        if declared in self.languages:
            ll = ll + self.declared[:, self.languages.index(declared)]
            other -= np.log(len(self.languages))
        return np.append(ll, other), n


def fit(rows: list[tuple[str | None, bytes | Profile | None]], least: int = LEAST_TEXTS, of: dict[str, int] | None = None) -> Model:
    """Model of ``(declared language, text or its profile)`` rows; repeated texts count once, languages of under ``least`` rows not at all.

    ``of`` has the count of all labelled rows of each language, where ``rows`` are a sample of them.
    """
    sampled = Counter(d for d, t in rows if d and t)
    profiles = ((d, t if isinstance(t, Profile) else Profile.of(t)) for d, t in rows if d and t)
    rows = list({t.digest: (d, t) for d, t in profiles}.values())
    count = Counter(d for d, _ in rows)
    languages = sorted(d for d, n in count.items() if n >= least) or sorted(count)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    at = {d: i for i, d in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    for d, t in rows:
        if d in at:
            counts[at[d], t.buckets] += t.counts
    # the even share is the same in all, so a trigram that none has seen favours none
    sums = counts.sum(axis=1)
    weights = np.log((1 - EVEN) * counts / np.maximum(sums, 1)[:, None] + EVEN / BUCKETS).T.astype(np.float32)
    # what a language's texts have per trigram under its other texts
    own: list[list[float]] = [[] for _ in languages]
    for d, t in rows:
        if d in at and (n := int(t.counts.sum())):
            left = counts[at[d], t.buckets] - t.counts
            own[at[d]].append(float(t.counts @ np.log((1 - EVEN) * left / max(1.0, sums[at[d]] - n) + EVEN / BUCKETS)) / n)
    typical = np.array([np.median(x) if x else RANDOM for x in own])
    floor = np.minimum(RANDOM + (typical - RANDOM) / 4, typical - 1)
    model = Model(languages, np.ascontiguousarray(weights), np.zeros((0, 0)), floor)
    # p(declared | language as the text has it), with a row of doubt for each pair
    table = np.ones((len(languages), len(languages)))
    # a sampled row stands for so many, in proportion
    weigh = {d: (of or sampled).get(d, 0) / sampled[d] for d in languages}
    unit = min(weigh.values()) or 1.0
    for d, t in rows:
        ll, _ = model.text_terms(t)
        if d in at and ll is not None:
            table[int(ll.argmax()), at[d]] += weigh[d] / unit
    model.declared = np.log(table / table.sum(axis=1, keepdims=True))
    return model


def train(labelled: DataFrame, key: str, text: str, declared: str, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of least hash of each language that all rows name often enough."""
    named = labelled.select(F.col(key).cast("string").alias("k"), F.col(declared).cast("string").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and d <> '' and t <> ''")
    of = {r.d: r.n for r in named.groupBy("d").agg(F.count("*").alias("n")).where(f"n >= {LEAST_TEXTS}").collect()}
    if not of:  # too few rows for any: all of them then
        of = {r.d: r.n for r in named.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").limit(sample).collect()}
    if not of:
        return fit([])
    total = sum(of.values())
    # so many rows by a bound on the hash that hardly any but the sample reaches the sort
    bounds = []
    for d, n in of.items():
        most = max(LEAST_SAMPLE, -(-sample * n // total))
        share = min(1.0, (1.3 * most + 100) / n)
        bounds.append((d, most, int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    bounded = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "d string, most long, bound long"))
    near = named.withColumn("h", F.xxhash64("k")).join(bounded, "d").where("h <= bound")
    place = F.row_number().over(Window.partitionBy("d").orderBy("h", "k", "t"))
    rows = near.withColumn("place", place).where("place <= most").select("d", "t")
    # the tasks count the trigrams, so that no text comes to the driver
    got = rows.mapInArrow(sliced(_profile_slice, _PROFILE), "d string, digest binary, buckets array<long>, counts array<long>").collect()
    return fit([(r.d, Profile(bytes(r.digest), np.array(r.buckets, np.int64), np.array(r.counts, np.int64))) for r in got], of=of)


_PROFILE = pa.schema([("d", pa.string()), ("digest", pa.binary()), ("buckets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _profile_slice(others: list, data: np.ndarray, bounds: np.ndarray) -> list:
    ps = [Profile.of(data[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
    return [others[0], pa.array([p.digest for p in ps], pa.binary()), *(pa.array([getattr(p, c) for p in ps], pa.list_(pa.int64())) for c in ("buckets", "counts"))]


@tidy("li-result")
def identify(df: DataFrame, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", suffix: str | None = None, model: Model | None = None) -> DataFrame:
    """``df`` -> ``key, declared, host, language, posterior, n_trigrams, kept``, a row for each row."""
    none = F.lit(None).cast("string")
    col = lambda c: F.col(c).cast("string") if c else none
    model = model or (train(df, key, text, declared) if declared else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0))))
    langs, width = [*model.languages, OTHER], len(model.languages) + 1
    base = df.select(F.col(key).alias("key"), col(text).alias("text"), col(declared).alias("declared"), col(host).alias("host"), col(suffix).alias("suffix"))
    if width == 1:
        return base.select(F.col("key").alias(key), "declared", "host", F.lit(OTHER).alias("language"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(False).alias("kept"))
    terms_type = pa.list_(pa.float64())
    arrow_names = ["key", "declared", "host", "suffix", "terms", "n_trigrams"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            for row, data, bounds in text_slices(batch.column(4)):
                others = [c.slice(row, len(bounds) - 1) for c in batch.columns[:4]]
                terms, sizes, ends = [], [], bounds.tolist()
                for a, b, d in zip(ends, ends[1:], others[1].to_pylist(), strict=False):
                    ll, n = model.with_other(data[a:b], d)
                    terms.append(None if ll is None else ll - ll.max())
                    sizes.append(n)
                yield pa.RecordBatch.from_arrays([*others, pa.array(terms, terms_type), pa.array(sizes, pa.int64())], names=arrow_names)

    key_type = df.schema[key].dataType.simpleString()
    base = base.select("key", "declared", "host", "suffix", "text")
    # read again for the priors and for the answers: without the texts it is small, so it is cut once
    seen = cut(base.mapInArrow(run, f"key {key_type}, declared string, host string, suffix string, terms array<double>, n_trigrams long"), "li-seen")
    # posteriors of the rows by text and declaration alone, summed for each host
    odds = [F.exp(F.get("terms", F.lit(i))) for i in range(width)]
    total = sum(odds[1:], odds[0])
    sums = seen.where("terms is not null").groupBy("host", "suffix").agg(*[F.sum(odds[i] / total).alias(f"c{i}") for i in range(width)])
    cs = [f"c{i}" for i in range(width)]
    every = sums.agg(*[F.sum(c).alias(c) for c in cs]).first()
    grand = sum(every[c] or 0.0 for c in cs)
    prior = [((every[c] or 0.0) + 1.0) / (grand + width) for c in cs]
    by_suffix = sums.groupBy("suffix").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(cs)])
    s_sum = sum((F.col(f"s{i}") for i in range(1, width)), F.col("s0"))
    by_suffix = by_suffix.select(F.col("suffix").alias("sfx"), F.array(*[F.when(F.col("suffix").isNull(), F.lit(prior[i])).otherwise((F.col(f"s{i}") + STRENGTH * prior[i]) / (s_sum + STRENGTH)) for i in range(width)]).alias("sp"))
    c_sum = sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    hosts = sums.join(by_suffix, F.col("suffix").eqNullSafe(F.col("sfx")))
    hosts = hosts.select(F.col("host").alias("h"), F.col("suffix").alias("s"), F.array(*[F.when(F.col("host").isNull(), F.get("sp", F.lit(i))).otherwise((F.col(cs[i]) + STRENGTH * F.get("sp", F.lit(i))) / (c_sum + STRENGTH)) for i in range(width)]).alias("prior"))
    joined = seen.join(hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
    fused = [F.get("terms", F.lit(i)) + F.log(F.coalesce(F.get("prior", F.lit(i)), F.lit(prior[i]))) for i in range(width)]
    joined = joined.select("key", "declared", "host", "n_trigrams", F.when(F.col("terms").isNotNull(), F.array(*fused)).alias("f"))
    best = F.array_max("f")
    sure = 1.0 / F.aggregate("f", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    name = F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("f", best) - 1).cast("int"))
    out = joined.select("key", "declared", "host", "n_trigrams", F.coalesce(sure, F.lit(0.0)).alias("posterior"), name.alias("best"))
    kept = (F.col("n_trigrams") > 0) & (F.col("posterior") >= LEAST_POSTERIOR) & (F.col("best") != OTHER)
    return out.select(F.col("key").alias(key), "declared", "host", F.when(kept, F.col("best")).otherwise(F.lit(OTHER)).alias("language"), "posterior", "n_trigrams", kept.alias("kept"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not rejected; columns unchanged, decided row by row without moving a text.

    A document is rejected for want of letters, as other text, or for doubt
    that host and declaration don't lift. Rejected ids come from :func:`identify`.
    """
    got = identify(docs)
    bad = distilled(got, got.where("not kept and doc_id is not null").select("doc_id").distinct(), "li-rejected")
    return keep_ids(docs, bad, how="left_anti")


def markup_language(html: Column) -> Column:
    """The language that a page declares in its ``html`` element, two letters; null without."""
    got = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(got != "", got)


def site(url: Column) -> Column:
    """Host of an address without port and last dot; null without."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@|:\d*$", ""), r"\.$", "")
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """The last label of a host; null for a host of one label and for a number."""
    got = F.regexp_extract(host, r"\.([^.\d\]:][^.\]:]*)$", 1)
    return F.when(got != "", got)


def page_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, text, declared, host, suffix``: main text, language of the markup, parts of the address."""
    model = trained()
    html, host = F.col("html").cast("string"), site(F.col("url").cast("string"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            texts = pa.array([model.text(h.as_py()) for h in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *batch.columns[2:]], names=["page_id", "text", "declared", "host", "suffix"])

    key_type = pages.schema["page_id"].dataType.simpleString()
    parts = pages.select("page_id", html.alias("html"), markup_language(html).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"))
    return parts.mapInArrow(run, f"page_id {key_type}, text string, declared string, host string, suffix string")


@tidy("li-result")
def identify_pages(pages: DataFrame) -> DataFrame:
    """:func:`identify` on the main texts of ``pages``, with declared language of the markup, host and suffix."""
    texts = cut(page_texts(pages), "li-pages")
    return identify(texts, "page_id", "text", "declared", "host", "suffix")
