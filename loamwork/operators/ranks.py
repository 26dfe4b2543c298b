"""Ordinals within groups of any size: ranks in ranges of the order plus the rows before each range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order that are ranked together.
RANGE = 100_000


def number(rows: DataFrame, order: str, out: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), span: int = RANGE) -> DataFrame:
    """``rows`` with ``out``, their place from 1 on within ``by`` in order of the number ``order``, then ``ties``.

    A task ranks one range of the order, so no group is sorted in one place; only a count a range is.
    """
    cells = rows.withColumn("_range", F.floor(F.col(order) / span))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order, *ties))
    counts = cells.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*(by or (F.lit(0),))).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*(F.col(c).alias(f"_of_{c}") for c in (*by, "_range")), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = cells.withColumn("_place", place)
    joined = placed.join(before, [placed[c].eqNullSafe(before[f"_of_{c}"]) for c in (*by, "_range")])
    return joined.withColumn(out, F.col("_before") + F.col("_place")).select(*rows.columns, out)
