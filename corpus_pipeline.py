"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept; its result is written as Parquet
to the shared folder and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm import decontamination, line_dedup, packing, quality, simhash
from ledgerscope.llm.common import materialise, table
from ledgerscope.llm.queries import id_remainder, quality_model
from ledgerscope.llm.subwords import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels are learnt from ids whose remainder of 5 is not 0."""
    model = quality_model(spark, sf_dir, docs.select("doc_id", "text"), id_remainder(5) != 0)
    scored = quality.score_quality(docs, model, names=("_q_score", "_q_predicted"))
    return scored.where("_q_predicted = 1").drop("_q_score", "_q_predicted")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their source; ``n_chars`` is that of the text left."""
    cleaned = line_dedup.drop_boilerplate(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    return cleaned.select("doc_id", "text", "lang", "source",
                          F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash component (3-word shingles, 3 differing bits)."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no question with its answer of ``benchmark``."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document left, with their ids."""
    return packing.pack(docs, tokenizer_path(), max_length=2048, end_id=1)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
#: The classifier, the fingerprints and the subword ids are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
