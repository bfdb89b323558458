"""The corpus pipeline: language ID, line dedup, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns the columns of ``documents`` (extra ones stay, whatever their
names), except for the last, which returns the packed pieces. Stages meet through
Parquet in the shared folder. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonant.llm import decontam, language_id, line_templates, ngram_join, packing
from resonant.llm.ids import without
from resonant.llm.scratch import memory_returned, settled, shuffles_removed
from resonant.session import prepare


def _begun(spark: SparkSession) -> SparkSession:
    """The session, after all JVMs have given back what earlier stages left; the join does so itself."""
    memory_returned(prepare(spark))
    return spark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go.

    The text model is fitted on a bounded sample labelled by ``lang``, which is therefore
    no evidence here; texts and their sources' priors decide. Null and empty texts, and
    those without a letter, go; where rows share a doc_id, one that goes takes the others
    along. A row of null doc_id stays.
    """
    _begun(spark)
    told = language_id.identify(docs, docs.select("text", docs.lang.alias("label")), text="text", declared=None, address="source")
    return without(docs, told.where("not accepted and doc_id is not null").select("doc_id"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so does a document of which nothing but blank lines is left by that.

    Null texts stay null; a row of null doc_id is not changed; repeated rows keep the same lines.
    """
    _begun(spark)
    return _without_lines(docs)


def _without_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    done = line_templates.drop_recurring_lines(docs, min_documents=5, long_words=long_words)
    left = done.where("n_dropped = 0 or text rlike '[^ \\\\t\\\\r\\\\n]'")
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies stays.

    Then lines of 20 words or more go from the second document on. That comes after near
    copies have gone, which could not be told by what such lines leave of them; and as it
    can leave near copies, these go after it. So what is decontaminated and packed is final.
    A line stays with its first document, and goes with it if that is such a copy.

    Documents without words stay, as do rows of null doc_id and all rows of the id that stays.
    """
    prepare(spark)
    with shuffles_removed(spark):  # else those of all three passes lie on disk at once, as would their intermediates
        return _without_copies(settled(spark, lambda: _without_lines(settled(spark, lambda: _without_copies(docs), "without-copies"), long_words=20), "without-long-lines"))


def _without_copies(docs: DataFrame) -> DataFrame:
    groups = ngram_join.jaccard_components(docs, k=5, percent=80)
    return without(docs, groups.where("doc_id <> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts and rows of null doc_id stay."""
    found = decontam.overlaps(docs, _begun(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("doc_id is not null").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, whole as they are, in sequences of at most 2048 tokens."""
    _begun(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the language model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def upto(n: int) -> DataFrame:
        """What the first ``n`` stages leave; of them, only the last one's result lies on disk then."""
        if n == 0:
            return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = STAGES[n - 1]
        return settled(spark, lambda: stage(spark, upto(n - 1), sf_dir), "stage-" + name.replace(" ", "-"))

    return upto(len(STAGES))
