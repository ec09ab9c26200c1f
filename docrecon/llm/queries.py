"""The queries of this subpackage, each over a whole table, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.llm.bpe_lexicon import bpe_encode
from docrecon.llm.conversation_repair import damaged, repair_conversations
from docrecon.llm.decontamination import decontaminate
from docrecon.llm.fill_in_middle import fill_in_middle, restore
from docrecon.llm.language_id import identify_languages
from docrecon.llm.license_scan import license_scan
from docrecon.llm.main_text import main_text
from docrecon.llm.near_duplicates import Similarity, near_duplicates
from docrecon.llm.oracles import ORACLE_SQL
from docrecon.llm.quality_classifier import classify_quality
from docrecon.llm.quality_rules import quality_rules
from docrecon.llm.simhash import simhash_components
from docrecon.llm.token_records import token_records
from docrecon.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Similarity(words=4))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("kept_chars", "line_chars", "cleaned")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), here="_here").withColumnRenamed("_conv", "conv_id")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_duplicates, op3_license_scan, op4_quality_classifier, op5_main_text, op6_quality_rules, op7_decontamination, op8_language_id, op9_bpe, op10_token_records, op11_simhash, op12_fill_in_middle, op13_conversation_repair)}
