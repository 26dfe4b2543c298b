"""The corpus pipeline: each stage applies one operator of loamwork.llm to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamwork.llm import decontaminate, mixing, repair, simhash, toxicity
from loamwork.llm.common import drop_stage, read_table, stage, table_path
from loamwork.llm.queries import tokenizer_path

END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores 0.3 or more go; the others stay with all columns.

    Null and empty texts have the classifier's bias as score; repeated rows are judged alike; without
    labels of both classes the score is one for all, the share of label 1. An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id, with all columns.

    Rows without doc_id come last in their group; of repeated rows one stays; null and empty texts
    are one group; different texts under one doc_id are documents of their own.
    """
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others stay with all columns.

    Null and wordless texts and items match nothing; repeated rows are judged alike; an empty table
    or benchmark changes nothing.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to two times, with all columns.

    Null texts have size 0, null sources are a source of their own, repeated rows are documents of
    their own; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Re-Pair shards; (doc_id, start, n_tokens, ids_crc32) that the shards hold of each document.

    Null texts are empty and have the end id alone; rows without doc_id come first; repeated rows are
    written each; other columns are left out; an empty table has no rows. The shards stay in the
    shared folder.
    """
    path = table_path(spark, "pipeline-shards", keep=True)
    repair.write_tokens(docs, path, tokenizer_path(), END_ID)
    return repair.read_tokens(spark, path).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        after = stage(step(spark, docs, sf_dir), name)
        drop_stage(docs)
        docs = after
    return docs
