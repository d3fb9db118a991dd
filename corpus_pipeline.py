"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, secret redaction and packing.

Each stage takes all documents that the stage before it kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablework.llm import lines, minhash, packing, quality, secrets
from tablework.llm.common import by_row, stage
from tablework.llm.queries import tokenizer_path

#: Line dedup, union-find, signatures and packing are beyond plain SQL; tests/llm/test_pipeline.py uses brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, whatever their doc_id."""
    return by_row(lambda rows: rows.join(quality.quality(rows).where("kept").select("doc_id"), "doc_id", "left_semi"))(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines the first stays, by doc_id; rows left without any line go. Null doc_ids come last."""
    return lines.drop_duplicate_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents (five-word shingles, similarity of 0.8 or more) the one with the smallest doc_id stays.

    Nulls come after all others; rows that share a doc_id are documents of their own, in the order of their texts.
    """
    near = lambda rows: minhash.near_duplicates(rows, width=5, percent=80).where("kept").select("doc_id")
    return by_row(lambda rows: rows.join(near(rows), "doc_id", "left_semi"))(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found gives way to a mark; n_chars of changed texts is counted anew."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
