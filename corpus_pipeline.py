"""A corpus pipeline of five operators: quality, language, near-duplicates, contamination, tokens.

Every stage takes what its predecessor kept, as written and read again, and works on all of it. All but the last return
the columns of documents unchanged, also where a column is named like one of an operator's own. Null and empty texts
have no words: they count as short documents for the quality stage and have no language, so the language stage removes
them. Repeated rows of one id are one document to the near-duplicate and decontamination stages: they stay or go together
with the id. Empty tables give empty results.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docrecon.llm.bpe_lexicon import bpe_encode
from docrecon.llm.decontamination import decontaminate
from docrecon.llm.language_id import in_known_language
from docrecon.llm.near_duplicates import Similarity, near_duplicates
from docrecon.llm.quality_classifier import good_documents
from docrecon.llm.storage import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It learns from the labelled ones among docs."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that docs name; texts without a letter or further from their nearest language
    than its own texts of as many letter runs go."""
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; shingles of five words, similarity 0.8."""
    lost = near_duplicates(docs, Similarity(words=5)).filter("not kept").select("doc_id")
    return docs.join(keep(lost, "lost"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter("contaminated").select("doc_id")
    return docs.join(keep(hit, "hit"), "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL cannot train the classifier or the prototypes; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs
