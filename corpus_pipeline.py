"""The corpus pipeline: language ID, line de-duplication, near-duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, language, line_dedup, packing, simhash
from foliant.llm.common import written
from foliant.plans.common import table


#: Languages that stay (None: every language the model learns), and the least score of a document's language.
LANGUAGES, LEAST_SCORE = None, language.LEAST_SCORE


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told with LEAST_SCORE or more by a model fitted on them, and is one of LANGUAGES.

    A null text, or one without a letter, goes; so does, with LANGUAGES given, a text in another language. Where no row
    has a language to learn from, all with a letter stay. Repeated rows stay or go together, an empty table stays empty,
    and other columns are kept whatever their names.
    """
    model = language.fit(docs.where(~language.held_out("doc_id")))
    return language.keep_known(docs, model, LANGUAGES, LEAST_SCORE)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the lines that a document of smaller id holds; n_chars follows the text.

    A null text stays null, with a null n_chars; rows of one id, a null one too, are one document when lines are counted.
    """
    kept = line_dedup.without_dropped_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; of rows that share it the first by hash."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark; null and empty texts hold none, repeated rows go together."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, a row for each piece; a null or empty text is one piece of one token."""
    return packing.pack(docs)


STAGES = [("language", known_language), ("line_dedup", keep_first_lines), ("near_dedup", keep_one_of_each), ("decontamination", without_benchmark), ("packing", packed)]

#: SQL can't express language ID's model; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
