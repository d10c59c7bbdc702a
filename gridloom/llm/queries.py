"""Queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, neardup, urls, warc
from .common import table
from .decontam import containment
from .html_text import extract
from .imatch import fingerprints
from .langid import identify, identify_pages
from .neardup import near_duplicates
from .packing import pack_documents
from .periodic import periodic_runs, repeated_tail, run_digests
from .resample import resample
from .secrets import find_secrets, span_digests
from .substring import substring_dedup
from .urls import RULES, judge, listed_urls
from .warc import archive
from .wavelet import encode_corpus


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated passages removed, and what was removed."""
    docs = table(spark, sf_dir, "documents")
    out = substring_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed_chars", "removed")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    return archive(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a test item's shingles or more."""
    return containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict.

    No table of listed URLs comes with the pages, so the list is made of the
    pages' URLs on hosts with a listed label (``urls.LISTED_LABELS``).
    """
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_urls(pages), RULES).drop("maybe")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, count and crc32 of every document's ids, as read back from the token files."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's and every page's language.

    Evidence beside the text: of a document (``page_id`` null) its declared
    language and source, of a page (``doc_id`` null) its markup language, host
    and address suffix.
    """
    docs, pages = identify(table(spark, sf_dir, "documents")), identify_pages(table(spark, sf_dir, "pages"))
    return docs.unionByName(pages, allowMissingColumns=True)


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of secrets, by the base patterns and by inferred formats."""
    return span_digests(find_secrets(table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards ``benchmark``, and its rank in the draw."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, some planted, and what is left without the repetitions."""
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), edit=repeated_tail))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_warc": op2_warc,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_html_text": op4_html_text,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_url_filters": op6_url_filters,
        "op7_packing": op7_packing,
        "op8_imatch_fingerprints": op8_imatch_fingerprints,
        "op9_wavelet_tokens": op9_wavelet_tokens,
        "op10_language_id": op10_language_id,
        "op11_secret_scans": op11_secret_scans,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.ORACLE, "op3_benchmark_decontamination": decontam.ORACLE, "op5_minhash_near_dedup": neardup.ORACLE, "op6_url_filters": urls.ORACLE}
