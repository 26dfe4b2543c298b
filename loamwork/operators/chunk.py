"""Paragraph chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.text import strip
from loamwork.plans import rules


def chunk_paragraphs(text: Column, size: int = rules.CHUNK_SIZE, mark: str = "\n\n") -> Column:
    """Chunks of whole paragraphs: a paragraph that would pass ``size``, or a header in a chunk more
    than half full, begins the next. An empty text is one empty chunk. A fold within the row."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(state: Column, para: Column) -> Column:
        header = F.startswith(strip(para), F.lit("#"))
        full = (state["n"] + F.length(para) > size) | (header & (state["n"] > size * 0.5))
        cut = full & (F.size(state["now"]) > 0)
        return F.struct(
            F.when(cut, F.array_append(state["done"], F.array_join(state["now"], mark))).otherwise(state["done"]).alias("done"),
            F.when(cut, F.array(para)).otherwise(F.array_append(state["now"], para)).alias("now"),
            (F.when(cut, F.lit(0)).otherwise(state["n"]) + F.length(para) + len(mark)).alias("n"),
        )

    return F.aggregate(F.split(text, mark, -1), start, step, lambda s: F.array_append(s["done"], F.array_join(s["now"], mark)))


def explode_chunks(docs: DataFrame, size: int = rules.CHUNK_SIZE, mark: str = "\n\n") -> DataFrame:
    return docs.select("doc_id", F.posexplode(chunk_paragraphs(F.col("text"), size, mark)).alias("pos", "chunk"))


def join_chunks(chunks: DataFrame, mark: str = "\n\n") -> DataFrame:
    """Documents from their chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "chunk")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), mark).alias("text"))
