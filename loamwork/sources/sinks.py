"""Sinks: tables, JSON lines, index, graph, reports, logs."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.operators import sections

log = logging.getLogger("loamwork")


def write_stages(docs: DataFrame, path: str) -> None:
    """(doc_id, stage, text) as one folder a stage: raw, regex, final."""
    docs.write.mode("overwrite").partitionBy("stage").parquet(path)


def write_jsonl(rows: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines, characters unescaped; ``single`` for small results that must be one file."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, rebuild: bool = True) -> None:
    mode = "overwrite" if rebuild else "append"
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def write_index(indexed: DataFrame, path: str, rebuild: bool = True) -> None:
    """The index by collection, so that a search in one reads only its folder."""
    indexed.write.mode("overwrite" if rebuild else "append").partitionBy("collection").parquet(path)


def write_candidates(ranked: DataFrame, path: str) -> None:
    """One JSON line a query with its candidates in order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    ranked.groupBy("query_id").agg(listed.alias("candidates")).write.mode("overwrite").json(path)


def append_task_log(spark: SparkSession, entry: dict, path: str) -> None:
    row = json.dumps(entry | {"timestamp": datetime.now(timezone.utc).isoformat()}, ensure_ascii=False)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(path)


def log_message(level: str, message: str) -> None:
    """Logs; an error is also raised."""
    log.log(getattr(logging, level), message)
    if level == "ERROR":
        raise RuntimeError(message)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join(lines)


def fragment_report(fragments: DataFrame, unmapped: DataFrame | None = None) -> str:
    """Totals and distributions of fragments as Markdown; only aggregates reach the driver."""
    parts = ["# Fragments", f"total: {fragments.count()}"]
    for column in ("density", "chapter", "engineering_type", "source_doc"):
        counts = fragments.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)
        parts += [f"## {column}", markdown_table(counts)]
    if unmapped is not None:
        parts += ["## unmapped", markdown_table(unmapped.groupBy("title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "title"), 50)]
    return "\n\n".join(parts)


def graph_report(entities: DataFrame, relations: DataFrame, samples: int = 5) -> str:
    first = entities.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("seq"))).where(F.col("_n") <= samples)
    parts = ["# Graph"]
    for table, column in ((entities, "type"), (entities, "engineering_type"), (relations, "relation_type")):
        parts += [f"## {column}", markdown_table(table.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column))]
    parts += ["## entities", markdown_table(first.select("type", "id", "name").orderBy("type", "id")), "## relations", markdown_table(relations.orderBy("seq").limit(2 * samples))]
    return "\n\n".join(parts)


def metrics_report(metrics: DataFrame, by_group: DataFrame | None = None, by_length: DataFrame | None = None, title: str = "Retrieval") -> str:
    """The report of an evaluation: models by MRR@3, the best one, and its breakdowns.

    Serves embeddings, rerankers (with ``mrr_gain``) and combinations (with latency columns) alike.
    """
    ordered = metrics.orderBy(F.col("mrr_3").desc(), metrics.columns[0])
    best = ordered.first()
    parts = [f"# {title}", markdown_table(ordered), f"best: {best[0]}, MRR@3 {best['mrr_3']:.4f}" if best else "no models"]
    for name, rows in (("by chapter", by_group), ("by length", by_length)):
        if rows is not None:
            parts += [f"## {name}", markdown_table(rows.orderBy(rows.columns[0]))]
    return "\n\n".join(parts)


def structure_report(titles: DataFrame) -> str:
    """The chapters of a corpus: frequencies by band, what follows under them, and how documents open."""
    summary, frequency = sections.corpus_summary(titles), sections.chapter_frequency(titles)
    parts = ["# Structure", markdown_table(summary)]
    for band in ("mandatory", "common", "optional"):
        parts += [f"## {band}", markdown_table(frequency.where(F.col("band") == band).drop("band").orderBy(F.col("n").desc(), "name"))]
    under = sections.second_level(titles).withColumn("_n", F.row_number().over(Window.partitionBy("chapter").orderBy(F.col("n").desc(), "name"))).where("_n <= 10").drop("_n")
    parts += ["## sections of chapters", markdown_table(under.orderBy("chapter", F.col("n").desc(), "name"))]
    parts += ["## first chapters", markdown_table(sections.opening_chapters(titles).orderBy("place", F.col("n").desc(), "name"))]
    return "\n\n".join(parts)


def coverage_text(results: DataFrame, samples: int = 50) -> str:
    """Coverage of the mapping: totals, chapters, match types, and titles that have no chapter."""
    parts = ["# Coverage", markdown_table(sections.coverage(results))]
    for column in ("chapter_id", "match_type"):
        parts += [f"## {column}", markdown_table(sections.coverage_by(results, column).orderBy(F.col("n").desc(), column))]
    parts += ["## without chapter", markdown_table(sections.title_lists(results).orderBy("chapter_id", "doc_id", "pos"), samples)]
    return "\n\n".join(parts)
