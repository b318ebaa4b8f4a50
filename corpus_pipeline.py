"""From raw documents to packed training sequences: language, toxicity, exact copies, near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of docs, whatever other names there are. Between stages rows are written as Parquet to the shared folder.

Defined results: null texts have no letter and go in the first stage, as do empty ones; an empty table gives empty ones
all through; rows repeated with one doc_id and text are one document, of which one row stays in the third stage; of
rows with one doc_id and different texts each is a document of its own; null ids come after all others where the
smallest stays. Texts of any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, jaccard, langid, packing, toxicity
from tessella.llm.common import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or are further from every language's codeword than a classifier that knows nothing.
    Where no language can be learned, the letters alone decide."""
    return langid.accepted(docs, langid.fit(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; none where labels of both classes aren't there to learn from."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, and one row of it."""
    return exact_dedup.first_rows(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group tied by similarities of 0.8 or more the smallest doc_id stays, and one row of it."""
    return jaccard.first_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", near_copies_stage),
    ("packing", packing_stage),
]

# Classifiers and the packing program are outside SQL; tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
