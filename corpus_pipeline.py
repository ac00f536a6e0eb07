"""The corpus pipeline: toxicity, line dedup, near copies, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the shared folder
and gives it, read again, to the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakestrata.llm.common import new_folder, stored, table, whole_text
from lakestrata.llm.decontaminate import clean_documents
from lakestrata.llm.line_dedup import drop_repeated_lines
from lakestrata.llm.ngram_join import drop_near_copies
from lakestrata.llm.packing import pack
from lakestrata.llm.queries import TOXIC
from lakestrata.llm.toxicity import toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold."""
    score = "toxic_score"
    while score in docs.columns:
        score = f"_{score}"
    return toxicity(docs, table(spark, sf_dir, "labels"), score=score).filter(F.col(score) < TOXIC).drop(score)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stay in another one; n_chars follows the text."""
    kept = drop_repeated_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length(whole_text()).cast("long")) if "n_chars" in docs.columns else kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies inside benchmark windows."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, each in its bin."""
    return pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_contaminated),
    ("packing", packed),
]

#: Scores, sketches and bins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), new_folder(spark, f"pipeline-{name}"))
    return docs
