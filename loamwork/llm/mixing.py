"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: The seed of the sampling's random offset.
SEED = 42
#: Groups that rows of one source and size class are dealt to, so that no source is ranked in one
#: task; a prime, so that ids with a common step are spread too.
SPREAD = 61


def offset_of(seed: int) -> float:
    """The random offset in [0, 1), the same for every source."""
    return random.Random(seed).random()


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share`` of
    all sizes by weight; a target stops at ``cap`` times its source's size, and the excess is shared
    again by weight. With sources ordered by the level at which they reach their cap, prefix sums
    give the level at which the others stop. One row a source; no row of the corpus is gathered.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("mix"),
    ).withColumn("level", (F.col("mix") - F.col("before")) / F.col("rest"))
    full = F.col("cap") / F.col("w") <= F.col("level")
    stop = F.max(F.when(~full, F.col("level"))).over(everything)
    return filled.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * stop).alias("target"))


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``sized`` (source, doc_id, size and any other columns) with source_size, target and copies.

    Documents of a source are ordered by size class (root of the size), then dealt by doc_id, then
    by size and doc_id. Each is expected target / source_size times; the prefix sums of that, plus
    one random offset that follows from ``seed``, cross the integers, and a document is taken once
    for each integer crossed. So it is taken the expected number of times, rounded up or down, and
    equally often in every size class. Ranks come from group counts and ranks in small groups, never
    from a whole source in one task.

    Empty documents have size 0; a source of size 0 has target 0; a null size counts as 0. Rows
    without doc_id are dealt by their size and come first in their group. Repeated rows and ties are
    documents of their own, in any order. Other columns pass through, whatever their names, but
    those named source_size, target or copies are replaced. An empty table stays empty.
    """
    own, made = ("source", "doc_id", "size"), ("source_size", "target", "copies")
    extra = [c for c in sized.columns if c.lower() not in own + made]
    kept = [F.struct(*(F.col(f"`{c}`") for c in extra)).alias("kept")] if extra else []
    size = F.coalesce(F.col("size").cast("long"), F.lit(0))
    sized = sized.select("source", F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), *kept)
    sized = sized.withColumn("size_class", F.floor(F.sqrt("size"))).withColumn("dealt", F.pmod(F.coalesce("doc_id", "size"), F.lit(SPREAD)))
    group = ["source", "size_class", "dealt"]
    counts = sized.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("size_class", "dealt").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sized, weights, share, cap)
    offsets = counts.select(*group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    offsets = offsets.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    offsets = offsets.select(*(F.col(c).alias(f"of_{c}") for c in group), "before", "source_size", "target")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("size", "doc_id"))
    ranked = sized.withColumn("place", place)
    joined = ranked.join(offsets, [ranked[c].eqNullSafe(offsets[f"of_{c}"]) for c in group])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, offset = F.col("before") + F.col("place"), F.lit(offset_of(seed))
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return joined.select(*own, *(["kept.*"] if extra else []), "source_size", "target", crossed.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as ``mix`` takes it, with the columns of ``docs``.

    Only ids, sources and sizes are ranked; texts move once, to meet the number of their copies. They
    meet by a hash of doc_id, source and text; rows of one hash share their copies in any order.
    Null and empty texts are of size 0. Columns may have any names; an empty table stays empty.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))
    narrow = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), key.alias("key"))
    taken = mix(narrow, seed=seed).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total"), F.min("copies").alias("least")).where("total > 0")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), key.alias("key")).join(taken, "key")
    # the join has sorted by key, so ranks need no further exchange
    place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    copies = F.when(F.col("n") == 1, F.col("total")).otherwise(F.col("least") + (F.col("place") <= F.col("total") - F.col("n") * F.col("least")).cast("long"))
    return rows.withColumn("place", place).select(F.explode(F.array_repeat("kept", copies.cast("int"))).alias("kept")).select("kept.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), placed AS (
  SELECT *, floor(sqrt(size)) AS size_class, (coalesce(doc_id, size) % 61 + 61) % 61 AS dealt FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, dealt, size, doc_id NULLS FIRST) AS rank FROM placed
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][(ord - 1) % 3 + 1] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 2 AS cap FROM totals
), filled AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS mix
  FROM weighed
), levels AS (
  SELECT *, (mix - before) / rest AS level FROM filled
), targets AS (
  SELECT source, source_size,
    CASE WHEN cap / w <= level THEN cap ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER () END AS target
  FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT r.doc_id, r.size, t.source_size, t.target,
  r.size * CAST(floor(t.rate * r.rank + CAST(OFFSET AS DOUBLE)) - floor(t.rate * (r.rank - 1) + CAST(OFFSET AS DOUBLE)) AS BIGINT) AS taken
FROM ranked r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source
""".replace("OFFSET", repr(offset_of(SEED)))
