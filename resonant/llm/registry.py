"""Queries over the shared tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import prepare
from . import decontam, language_id, license_scan, line_templates, ngram_join, packing, token_codec, unit_dedup, url_lists, vector_dedup

WORD_BPE = "word_bpe_49k.json"


def _read(spark, sf_dir, name):
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark, sf_dir):
    got = token_codec.encode_and_read(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark, sf_dir):
    got = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op3_url_lists(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    got = url_lists.filter_urls(url_lists.captures_of(pages), url_lists.entries_of(pages))
    return got.select("page_id", "url", "blocked", "matched_pattern", "matched_category", F.unix_timestamp("listed_since").alias("listed_since"))


def op4_line_templates(spark, sf_dir):
    got = line_templates.drop_recurring_lines(_read(spark, sf_dir, "documents"), min_documents=5)
    return got.select("doc_id", "text", "n_lines", "n_dropped")


def op5_language_id(spark, sf_dir):
    """Texts are judged by a model of pages, so a document's declared language is evidence alone."""
    training = language_id.of_pages(_read(spark, sf_dir, "pages")).select("text", F.col("declared").alias("label"))
    got = language_id.identify(_read(spark, sf_dir, "documents"), training, text="text", declared="lang", address="source")
    return got.withColumn("confidence", F.round("confidence", 6))


def language_of_pages(spark, sf_dir):
    """Operator 5 over pages: their markup, hosts and paths as evidence, a model of labelled documents for the text."""
    pages = language_id.of_pages(_read(spark, sf_dir, "pages"))
    training = _read(spark, sf_dir, "documents").select("text", F.col("lang").alias("label"))
    got = language_id.identify(pages, training, text="text", declared="declared", address="url", key="page_id")
    return got.withColumnRenamed("doc_id", "page_id").withColumn("confidence", F.round("confidence", 6))


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), k=5, percent=80)


def op7_unit_dedup(spark, sf_dir):
    got = unit_dedup.drop_repeated_units(_read(spark, sf_dir, "documents"), unit="line", min_words=30)
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"], F.lit("-"), s["end"], F.lit(":"), s["first_doc"])), ",")
    return got.withColumn("removed", spans)


def op8_license_scan(spark, sf_dir):
    return license_scan.scan(_read(spark, sf_dir, "documents"), least=0.8).withColumn("dice", F.round("dice", 6))


def op9_vector_near_dups(spark, sf_dir):
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_benchmark_overlap(spark, sf_dir):
    return decontam.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_packing, op3_url_lists, op4_line_templates, op5_language_id, op6_ngram_jaccard, op7_unit_dedup, op8_license_scan, op9_vector_near_dups, op10_benchmark_overlap, language_of_pages)}
ORACLE_SQL = {"op3_url_lists": url_lists.ORACLE, "op8_license_scan": license_scan.ORACLE, "op4_line_templates": line_templates.ORACLE, "op7_unit_dedup": unit_dedup.ORACLE}
