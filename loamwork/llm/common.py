"""Shared plumbing: bounded Arrow chunks, samples, connected components; tables in the shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.storage import delete_path, drop_stage, read_bytes, shared_folder, stage, table_path, write_bytes
from loamwork.workers import ship

__all__ = [
    "connected_components", "delete_path", "drop_stage", "labelled_sample", "map_arrow", "partitions", "read_bytes", "read_table", "shared_folder", "stage", "table_path", "text_slices", "word_tokens",
    "write_bytes",
]


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package, wherever the session was started."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORD = re.compile(r"\w+")
_OTHER = re.compile(r"[^\x00-\x7f\w]")
_SPACED = bytes(i if chr(i).isalnum() or chr(i) == "_" or i > 127 else 32 for i in range(256))


def word_tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and underscores, as UTF-8."""
    low = (text or "").lower()
    if _OTHER.search(low):
        return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(low)]
    return low.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out fold.

    The fold is crc32(doc_id as text) mod ``folds``; ``held`` is never learned from. The rows with
    the smallest hash of doc_id are taken, so the sample is the same in every run. A document with
    several labels has the highest; of several texts with one doc_id the one of the smallest hash is
    taken, so repeated ids don't enlarge the sample.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(fold != held).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids, so this broadcast is bounded
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``budget`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (u, v).

    Alternates large-star and small-star steps until the edges no longer change. Both steps are a
    group-min and an equi-join, so no adjacency list is ever gathered in a task. The minima are a
    table of their own, so that the join can split a node that a large part of the edges has. Every
    step is written to the shared folder, which cuts lineage and survives lost executors.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        drop_stage(low)
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop_stage(low)
        seen = _fingerprint(after)
        drop_stage(large)
        drop_stage(now)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
