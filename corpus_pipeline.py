"""From documents to training sequences: grade, deduplicate, decontaminate, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of documents, for the
rows that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import chunks, decontaminate, packing, quality, setjoin
from faultline.llm.staging import shipped, staged
from faultline.llm.workload import table, tokenizer_path


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of the best grade, by a model of the labels of ``docs``."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, ignoring the case of A-Z, the row of the largest id."""
    shipped(spark)
    return chunks.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the texts that links of similarity 0.8 join, the row of the smallest id."""
    shipped(spark)
    return setjoin.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other values."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    shipped(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", graded),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The fitted grades cannot be written in SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
