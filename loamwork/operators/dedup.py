"""Near duplicates by exact Jaccard similarity of character pairs, and greedy removal."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.plans import rules
from loamwork.storage import stage
from loamwork.workers import ship

#: Rows of the sample that shows which character pairs are common, and how many of those are sent to the tasks.
SAMPLE, COMMON = 4096, 1 << 14
#: Elements of the sets of a block, where a set counts as LEAST at least; two blocks are compared in a task.
BLOCK, LEAST = 1 << 20, 64
#: Rows of a tile, which are compared at once, and columns of a product; meetings that are counted at once.
TILE, COLUMNS, MEETINGS = 1024, 1024, 1 << 22


def pair_codes(text: str | None) -> np.ndarray:
    """The different pairs of neighbouring characters of a text, as numbers."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(codes[:-1] << 21 | codes[1:])


def common_codes(texts: DataFrame) -> dict[int, int]:
    """How often each of the most common character pairs occurs in a sample of the texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(pair_codes(text).tolist())
        if found:
            yield pa.record_batch([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["code", "n"])

    share = max(1, -(-texts.count() // SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counts = sample.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in counts.orderBy(F.col("n").desc(), "code").limit(COMMON).collect()}


def _numbered(texts: list[str | None], ranks: dict[int, int]) -> tuple[list, list, list, list]:
    """(digest, n, near, far) of each text's set: 16-bit ranks of the common pairs, and the other pairs as they are."""
    codes, places = np.array(sorted(ranks), np.int64), np.array([ranks[c] for c in sorted(ranks)], np.uint16)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for text in texts:
        found = pair_codes(text)
        at = np.minimum(np.searchsorted(codes, found), max(0, len(codes) - 1))
        known = codes[at] == found if len(codes) else np.zeros(len(found), bool)
        row = hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found), places[at[known]].tobytes(), found[~known].tobytes()
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


def _elements(near: list[bytes], far: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of all sets; elements of ``far`` come after the ranks, so that they can't meet."""
    row = [np.repeat(np.arange(len(x)), [len(v) // width for v in x]) for x, width in ((near, 2), (far, 8))]
    return np.concatenate(row), np.concatenate((np.frombuffer(b"".join(near), np.uint16).astype(np.int64), np.frombuffer(b"".join(far), np.int64) + (1 << 16)))


class _Tiles:
    """The sets of a block in tiles of rows, by their elements that many rows have and the others."""

    def __init__(self, row: np.ndarray, element: np.ndarray, dense: np.ndarray, n: int):
        order = np.lexsort((element, row // TILE))
        self.row, self.element = row[order], element[order]
        self.place = np.where(dense, np.cumsum(dense) - 1, -1)
        self.cuts = np.searchsorted(self.row // TILE, np.arange(-(-n // TILE) + 1))
        self.n = n

    def rows(self, tile: int) -> int:
        return min(TILE, self.n - tile * TILE)

    def sparse(self, tile: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[tile], self.cuts[tile + 1]
        rare = self.place[self.element[a:b]] < 0
        return self.row[a:b][rare] - tile * TILE, self.element[a:b][rare]

    def dense(self, tile: int, start: int) -> np.ndarray:
        a, b = self.cuts[tile], self.cuts[tile + 1]
        place = self.place[self.element[a:b]] - start
        here = (place >= 0) & (place < COLUMNS)
        out = np.zeros((self.rows(tile), COLUMNS), np.float32)
        out[self.row[a:b][here] - tile * TILE, place[here]] = 1
        return out


def _shared(one: _Tiles, i: int, other: _Tiles, j: int, columns: int) -> np.ndarray:
    """How many elements the sets of two tiles share: products for what many have, meetings for the rest."""
    width = other.rows(j)
    out = np.zeros((one.rows(i), width), np.float32)
    for start in range(0, columns, COLUMNS):
        out += one.dense(i, start) @ other.dense(j, start).T
    (row, element), (col, have) = one.sparse(i), other.sparse(j)
    low = np.searchsorted(have, element)
    count = np.searchsorted(have, element, side="right") - low
    met, ends = count > 0, np.cumsum(count)
    row, low, count, ends = row[met], low[met], count[met], ends[met]
    start = 0
    while start < len(row):  # some million meetings at once
        base = ends[start] - count[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + MEETINGS)))
        n = count[start:stop]
        at = np.arange(n.sum()) + np.repeat(low[start:stop] - (ends[start:stop] - n - base), n)
        out += np.bincount(np.repeat(row[start:stop], n) * width + col[at], minlength=out.size).reshape(out.shape)
        start = stop
    return out


def block_pairs(rows: pa.Table, numerator: int, denominator: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place, shared) of the pairs of rows above the bound: of one block, or of a row of side 0 and one of side 1."""
    side, size = rows.column("side").to_numpy(), rows.column("n").to_numpy()
    blocks = [at[np.argsort(size[at], kind="stable")] for at in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if len(at)]
    row, element = _elements(rows.column("near").to_pylist(), rows.column("far").to_pylist())
    names, element = np.unique(element, return_inverse=True)
    parts = []
    for at in blocks:
        place = np.full(len(size), -1, np.int64)
        place[at] = np.arange(len(at))
        parts.append((place[row][mine := place[row] >= 0], element[mine]))
    often = [np.bincount(e, minlength=len(names)) for _, e in parts]
    # what few rows have is cheaper to count where it meets
    dense = often[0] * often[-1] * 256 >= len(blocks[0]) * len(blocks[-1])
    tiles = [_Tiles(*part, dense, len(at)) for part, at in zip(parts, blocks, strict=True)]
    one, other, columns = tiles[0], tiles[-1], int(dense.sum())
    for i in range(-(-one.n // TILE)):
        a = blocks[0][i * TILE : (i + 1) * TILE]
        for j in range(i if one is other else 0, -(-other.n // TILE)):
            b = blocks[-1][j * TILE : (j + 1) * TILE]
            if denominator * min(size[a[-1]], size[b[-1]]) <= numerator * max(size[a[0]], size[b[0]]):
                continue
            shared = _shared(one, i, other, j, columns).astype(np.int64)
            above = (numerator + denominator) * shared > numerator * (size[a][:, None] + size[b][None, :])
            x, y = np.nonzero(np.triu(above, 1) if one is other and i == j else above)
            yield a[x], b[y], shared[x, y]


def _blocks(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``heads`` with their ``block``, and (grp, block, low, high), the sizes that a block may hold.

    The sets of a group are cut by size into blocks of BLOCK elements, from counts of the sizes, so that no task
    ranks a group; equal sizes are dealt by hash. Blocks meet that hold sizes close enough.
    """
    weight = F.greatest("n", F.lit(LEAST))
    cells = heads.groupBy("grp", "n").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum(F.col("m") * weight).over(Window.partitionBy("grp").orderBy("n")) - F.col("m") * weight
    cells = stage(cells.withColumn("before", before), "cells", free=True)
    spot = lambda nth: F.floor((F.col("before") + nth * weight) / F.lit(BLOCK)).cast("int")
    placed = heads.join(cells, ["grp", "n"]).withColumn("block", spot(F.pmod(F.xxhash64("key"), F.col("m"))))
    # the blocks of a cell follow each other, so a block's sizes are known from the cells
    sizes = cells.select("grp", "n", F.explode(F.sequence(spot(F.lit(0)), spot(F.col("m") - 1))).alias("block"))
    return placed.select("grp", "key", "n", "near", "far", "block"), sizes.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def similar_classes(rows: DataFrame, group: str, key: str, text: str, numerator: int = 4, denominator: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (group, key, head) of each row and (group, a, b, n_a, n_b, shared), a < b, of heads
    with Jaccard above numerator / denominator.

    Rows of a group with equal sets are a class, whose head is its smallest key, so copies are compared
    once. The heads of a group are cut by the size of their sets into blocks, and a task counts what the sets of two
    blocks share, in whole numbers; only pairs above the bound leave it. Two empty sets are equal.
    """
    ship(rows.sparkSession)
    texts = rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ranks = rows.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(common_codes(texts.select("text")))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, n, near, far = _numbered(batch.column("text").to_pylist(), ranks.value)
            columns = [pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(near, pa.binary()), pa.array(far, pa.binary())]
            yield pa.record_batch([batch.column("grp"), batch.column("key"), *columns], names=["grp", "key", "digest", "n", "near", "far"])

    kinds = dict(rows.dtypes)
    sets = stage(texts.mapInArrow(run, f"grp {kinds[group]}, key {kinds[key]}, digest binary, n long, near binary, far binary"), "sets")
    heads = stage(sets.groupBy(F.col("grp").alias("of"), F.col("digest").alias("same")).agg(F.min("key").alias("head")), "classes", free=True)
    members = sets.select("grp", "digest", "key").join(heads, F.col("grp").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))).select(F.col("grp").alias(group), "key", "head")
    chosen = sets.join(heads.select(F.col("of").alias("grp"), F.col("head").alias("key")), ["grp", "key"], "left_semi").dropDuplicates(["grp", "key"])
    placed, blocks = _blocks(stage(chosen.where("n > 0").drop("digest"), "heads", free=True))
    one, other = (blocks.select("grp", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "pq")
    close = denominator * F.least("high_p", "high_q") > numerator * F.greatest("low_p", "low_q")
    met = stage(one.join(other, "grp").where("p <= q").where(close).select("grp", "p", "q"), "meetings", free=True)
    sides = met.select("grp", "p", "q", F.col("p").alias("block"), F.lit(0).alias("side")).unionByName(met.where("p < q").select("grp", "p", "q", F.col("q").alias("block"), F.lit(1).alias("side")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        grp, keys, n = (table.column(c).combine_chunks() for c in ("grp", "key", "n"))
        for x, y, shared in block_pairs(table, numerator, denominator):
            for start in range(0, len(x), 1 << 16):
                a, b = (pa.array(v[start : start + (1 << 16)]) for v in (x, y))
                columns = [grp.take(a), keys.take(a), keys.take(b), n.take(a), n.take(b), pa.array(shared[start : start + (1 << 16)])]
                yield pa.record_batch(columns, names=["grp", "x", "y", "n_x", "n_y", "shared"])

    dealt = placed.join(sides, ["grp", "block"]).select("grp", "p", "q", "side", "key", "n", "near", "far")
    found = dealt.groupBy("grp", "p", "q").applyInArrow(compare, f"grp {kinds[group]}, x {kinds[key]}, y {kinds[key]}, n_x long, n_y long, shared long")
    pick = lambda u, v: F.when(F.col("x") < F.col("y"), F.col(u)).otherwise(F.col(v))
    return members, found.select(F.col("grp").alias(group), pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("n_x", "n_y").alias("n_a"), pick("n_y", "n_x").alias("n_b"), "shared")


def all_pairs(members: DataFrame, pairs: DataFrame, group: str) -> DataFrame:
    """(group, a, b), a < b, of all rows, copies included; for the greedy removal, which looks at each pair."""
    members = members.select(group, "key", "head").distinct()
    one = members.select(group, F.col("head").alias("a"), F.col("key").alias("x"))
    two = members.select(group, F.col("head").alias("b"), F.col("key").alias("y"))
    cross = pairs.select(group, "a", "b").join(one, [group, "a"]).join(two, [group, "b"]).where("x <> y")
    cross = cross.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # classes are disjoint, so only copies are left to meet; no pair comes twice
    own = one.join(two.withColumnRenamed("b", "a"), [group, "a"]).where("x < y").select(group, F.col("x").alias("a"), F.col("y").alias("b"))
    return cross.unionByName(own)


def greedy_losers(pairs: DataFrame, ranks: DataFrame, group: str) -> DataFrame:
    """(group, loser): what greedy removal drops, from pairs (group, a, b) and (group, key, quality, doc, seq).

    Rows go in order of seq. A row that is still there is compared with every later row that is;
    of a similar pair the one of lower quality goes, else the one of the larger doc. A row that
    loses keeps removing later rows until its turn ends. Only pairs reach a task, not texts.
    """
    left = ranks.select(group, F.col("key").alias("a"), F.col("quality").alias("qa"), F.col("doc").alias("da"), F.col("seq").alias("sa"))
    right = ranks.select(group, F.col("key").alias("b"), F.col("quality").alias("qb"), F.col("doc").alias("db"), F.col("seq").alias("sb"))
    ship(pairs.sparkSession)
    full = pairs.select(group, "a", "b").join(left, [group, "a"]).join(right, [group, "b"])
    first = F.col("sa") < F.col("sb")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    second = F.when(pick("qa", "qb") != pick("qb", "qa"), pick("qa", "qb") > pick("qb", "qa")).otherwise(pick("da", "db") <= pick("db", "da"))
    ordered = full.select(F.col(group).alias("grp"), pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("sa", "sb").alias("sa"), pick("sb", "sa").alias("sb"), second.alias("second"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = turn = None
        gone: set = set()
        skipped = False
        for batch in batches:
            lost: list[tuple] = []
            for grp, a, b, sa, second in zip(*(batch.column(c).to_pylist() for c in ("grp", "a", "b", "sa", "second")), strict=True):
                if grp != here:
                    here, turn, gone = grp, None, set()
                if sa != turn:
                    turn, skipped = sa, a in gone
                if skipped or b in gone:
                    continue
                loser = b if second else a
                if loser not in gone:
                    gone.add(loser)
                    lost.append((grp, loser))
            columns = [pa.array([x[i] for x in lost], batch.column(c).type) for i, c in enumerate(("grp", "a"))]
            yield pa.record_batch(columns, names=["grp", "loser"])

    kinds = dict(pairs.dtypes)
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a task reads the pairs of a group in order and holds only the rows that are gone
    dealt = ordered.repartition(n, "grp").sortWithinPartitions("grp", "sa", "sb")
    return dealt.mapInArrow(run, f"grp {kinds[group]}, loser {kinds['a']}").withColumnRenamed("grp", group)


def deduplicate(fragments: DataFrame, group: str = "chapter_id", threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """High and medium fragments without near duplicates within a chapter; others pass. Needs ``id`` and ``seq``."""
    used, rest = by_density(fragments)
    used = used.withColumn(group, F.coalesce(F.col(group), F.lit("unmapped")))
    pairs = all_pairs(*similar_classes(used, group, "id", "content", *threshold), group)
    ranks = used.select(group, F.col("id").alias("key"), F.coalesce("quality_rating", F.lit(rules.UNKNOWN_QUALITY)).alias("quality"), F.coalesce("source_doc", F.lit(999)).alias("doc"), "seq")
    losers = greedy_losers(pairs, ranks, group).select(F.col("loser").alias("id"))
    return used.join(losers, "id", "left_anti").unionByName(rest)


def by_density(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """High and medium fragments, which are kept, and the others."""
    high = F.coalesce(F.col("density"), F.lit("")).isin("high", "medium")
    return fragments.where(high), fragments.where(~high)
