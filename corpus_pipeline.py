"""A training corpus in five stages, from `documents` to packed windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`.  Between stages the rows are written
as Parquet and read again; a stage's table goes once the next one is written.

Columns beyond those that a stage reads (doc_id, text, lang, source) pass through,
whatever their names.  An empty table gives an empty table; repeated rows pass or
go together, but of rows that agree in id and text near_copies keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import jaccard, langid, mixing, packing, toxicity
from lamina.llm.common import discard, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts and texts without letters go."""
    return langid.keep_identified(docs)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; null and empty texts stay."""
    return toxicity.keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null texts and texts without words all stay."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows; a null text is empty."""
    return packing.pack(docs)


STAGES = [("language", language), ("toxicity", harmless), ("near_copies", distinct), ("mixing", mixed), ("packing", packed)]

#: Trained models and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the `documents` of a data directory; the rows are those of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
