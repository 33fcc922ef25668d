"""What the registered queries share: tables and pieces of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.functions.text import WS


#: Tables whose rows are whole texts: work on a row costs far more than moving it.
TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer splits than there are cores, as in one small file, are first dealt to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


#: (doc_id, pos, text, start, end) of the lines of documents.
SQL_PARAGRAPHS = """
  SELECT doc_id, pos, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
"""
