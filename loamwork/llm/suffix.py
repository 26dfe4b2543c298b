"""Suffix-array dedup: removal of long repeated byte strings with a logarithmic family of stored suffix arrays.

Every string of ``length`` bytes holds an anchor that depends on its content alone: the smallest
hashed gram inside it. Neighbouring strings that share an anchor form a run. Equal strings have
equal anchors at equal offsets, so all occurrences of a string lie in runs with one anchor gram,
and only runs whose gram occurs again need their bytes compared.

A family keeps levels in a folder: tables of the runs of earlier batches, a sparse suffix array in
order of the anchor grams. A new batch gets such an array of its own. Runs of the batch and of the
levels that share a gram are dealt by gram; in a task the batch's suffixes (the text from the
anchor on) and the levels' are sorted each, merged, and scanned for common prefixes to both sides of
the anchor. Then the batch becomes a level, and levels of similar size are merged, so that their
number stays logarithmic. A gram with too many different runs for one task is split by further
anchors of its strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import delete_path, drop_stage, map_arrow, partitions, read_bytes, stage, table_path, text_slices, write_bytes

#: Different runs of one gram that are compared in one task; beyond it the gram is split by further
#: anchors, ``SPLITS`` times at most, and then by the strings themselves.
GROUP, SPLITS = 16384, 3
#: Bytes of a text whose anchors are found at once.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_RUN = "h long, x1 long, x2 long, row long, at long"


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            step, back = np.full(n, self.base, np.uint64), np.full(n, self.inverse, np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


def prefix_sums(data: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``span_hash`` hashes any span of ``data`` (uint8)."""
    up, down = _POWERS.setdefault(base, _Powers(base)).to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=sums[1:])
    return sums, up


def span_hash(sums: np.ndarray, up: np.ndarray, start, end) -> np.ndarray:
    mixed = (sums[end] - sums[start]) * up[start]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int, salt: int = 0):
    """Runs of the strings of ``length`` bytes in the documents that end at ``ends`` in ``data``.

    Returns (document, first start, last start, anchor, gram hash) arrays; positions are in
    ``data``. Another ``salt`` gives other anchors.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    sums, up = prefix_sums(data)
    grams = span_hash(sums, up, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))
    if salt:
        grams = (grams ^ np.uint64(salt * _BASE & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xC2B2AE3D27D4EB4F)
    bits = np.uint64(32)  # not by the size of data: anchors depend on content alone
    place = np.arange(len(grams), dtype=np.uint64)
    low = window_minimum((grams >> bits << bits) | place, length - gram + 1)
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    doc = np.repeat(np.arange(len(ends)), ends - begins)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[doc]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    a, d = anchor[at], doc[at]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    lo, hi, a, d = at[new], at[last], a[new], d[new]
    return d, lo, hi, a, grams[a]


def _packed(lo: np.ndarray, anchor: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """First start, anchor's and last start's offsets from it (below ``length``, so 15 bits do) in one number."""
    return lo << 32 | (anchor - lo) << 16 | (hi - lo)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, (at >> 16) & 0xFFFF, at & 0xFFFF


def _digests(data: bytes, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3-128 of each span as two numbers."""
    out = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(lo.tolist(), end.tolist(), strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text, offset, bytes) of short texts together and of parts of long ones, a segment at a time.

    Parts overlap, so that each string begins in one of them.
    """
    rows, offsets, datas, held = [], [], [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[begin : begin + SEGMENT + length - 1]
            if held and held + len(piece) > SEGMENT:
                yield rows, offsets, datas
                rows, offsets, datas, held = [], [], [], 0
            rows.append(i)
            offsets.append(begin)
            datas.append(piece)
            held += len(piece)
    if rows:
        yield rows, offsets, datas


def _runs(length: int, gram: int):
    """The runs of texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            numbers = part.column("row").to_numpy()
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            for rows, offsets, datas in _pieces(texts, length):
                whole = b"".join(datas)
                ends = np.cumsum(np.fromiter(map(len, datas), np.int64, len(datas)))
                d, lo, hi, a, h = anchored_runs(np.frombuffer(whole, np.uint8), ends, length, gram)
                x = _digests(whole, lo, hi + length)
                # from places in the joined bytes to places in the text
                back = (np.concatenate(([0], ends[:-1])) - np.array(offsets, np.int64))[d]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(numbers[np.array(rows, np.int64)[d]]), pa.array(_packed(lo - back, a - back, hi - back))], names=["h", "x1", "x2", "row", "at"])

    return run


def _split(length: int, gram: int, salt: int):
    """Runs (h, row, at, bytes) cut by another anchor of their strings; a gram of ``length`` cuts them into single strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "bytes", SEGMENT):
            texts = part.column("bytes").to_pylist()
            whole = b"".join(texts)
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            d, lo, hi, a, g = anchored_runs(np.frombuffer(whole, np.uint8), ends, length, gram, salt)
            x = _digests(whole, lo, hi + length)
            first, offset, _ = _unpacked(part.column("at").to_numpy())
            begin = np.concatenate(([0], ends[:-1]))
            back = (begin - first)[d]
            # equal strings have both anchors, at one distance
            apart = (a - (begin + offset)[d]).view(np.uint64)
            h = (part.column("h").to_numpy().view(np.uint64)[d] ^ apart * np.uint64(_BASE)) * np.uint64(0xD6E8FEB86659FD93) + g
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(x[:, 0]), pa.array(x[:, 1]), part.column("row").take(pa.array(d)), pa.array(_packed(lo - back, a - back, hi - back))], names=["h", "x1", "x2", "row", "at"])

    return run


def scan(left: list[bytes], right: list[bytes], k: list[tuple[int, int]], old: list[bool], length: int, reach: int) -> np.ndarray:
    """Marks (run, k) of the strings of runs that another run has too.

    A run is (left text backwards, right text, first and last k): its strings start k bytes before
    the anchor. The runs of a batch and the ``old`` ones are sorted by their right text each, then
    merged. Two runs share the string at k if their left texts agree on k bytes and their right
    texts on length - k. In the two suffix arrays those are intervals of common prefixes, so per k a
    run is named by its pair of intervals, and equal names are equal strings.
    """
    n = len(left)
    marks = np.zeros((n, reach + 1), bool)
    if n < 2:
        return marks
    order = [i for kind in (False, True) for i in sorted((i for i in range(n) if old[i] is kind), key=right.__getitem__)]
    order.sort(key=right.__getitem__)  # two sorted runs: a merge
    to_right = common_prefixes([right[i] for i in order], length)
    back = sorted(range(n), key=lambda x: left[order[x]])
    to_left = common_prefixes([left[order[x]] for x in back], reach)
    where = np.empty(n, np.int64)
    where[back] = np.arange(n)
    bounds, ids = np.array([k[i] for i in order], np.int64), np.array(order)
    for step in range(reach + 1):
        on = np.flatnonzero((bounds[:, 0] <= step) & (step <= bounds[:, 1]))
        if len(on) < 2:
            continue
        names = np.cumsum(to_right < length - step)[on] * np.int64(n + 1) + np.cumsum(to_left < step)[where[on]]
        _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
        marks[ids[on[counts[inverse] > 1]], step] = True
    return marks


def common_prefixes(texts: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each text with the one before it (the first: -1), up to ``width``."""
    sizes = np.minimum(np.fromiter(map(len, texts), np.int64, len(texts)), width)
    out = np.full(len(texts), -1, np.int64)
    if not width:
        out[1:] = 0
        return out
    for i in range(1, len(texts), 4096):
        part = texts[i - 1 : i + 4096]
        cells = np.frombuffer(b"".join(t[:width].ljust(width, b"\0") for t in part), np.uint8).reshape(len(part), width)
        differ = cells[1:] != cells[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[i : i + len(first)] = np.minimum(first, np.minimum(sizes[i - 1 : i - 1 + len(first)], sizes[i : i + len(first)]))
    return out


def _cut(length: int):
    """Joins texts with their runs: the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows, cols = [], {c: [] for c in ("h", "m", "old", "at", "bytes")}
            for i, (text, runs) in enumerate(zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True)):
                data = (text or "").encode("utf-8", "surrogatepass")
                for r in runs:
                    rows.append(i)
                    for c in ("h", "m", "old", "at"):
                        cols[c].append(r[c])
                    cols["bytes"].append(data[r["at"] >> 32 : (r["at"] >> 32) + (r["at"] & 0xFFFF) + length])
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.record_batch([part.column("row").take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, t in zip(cols.values(), kinds, strict=True))], names=["row", *cols])

    return run


def _compare(length: int):
    """Spans (row, a, b) of the strings that runs of a gram share; the parts hold whole grams, in their order."""

    def spans(rows: dict[str, list]) -> pa.RecordBatch | None:
        first, offset, steps = _unpacked(np.array(rows["at"], np.int64))
        o, texts = offset.tolist(), rows["bytes"]
        marks = scan([t[:x][::-1] for t, x in zip(texts, o, strict=True)], [t[x : x + length] for t, x in zip(texts, o, strict=True)],
                     [(x - y, x) for x, y in zip(o, steps.tolist(), strict=True)], rows["old"], length, int(offset.max()))
        row, begin, end = mark_spans(marks)
        if not len(row):
            return None
        at = (first + offset)[row]
        return pa.record_batch([pa.array(np.array(rows["row"], np.int64)[row]), pa.array((at - end).astype(np.int32)), pa.array((at - begin + length).astype(np.int32))], names=["row", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            grams = batch.column("h").to_numpy()
            cuts = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)] if len(grams) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                # grams are gathered up to some thousand runs, since a scan of few costs as much
                if held and held["h"][-1] != grams[a] and len(held["h"]) >= 4096:
                    if (out := spans(held)) is not None:
                        yield out
                    held = {}
                piece = batch.slice(a, b - a)
                for c in ("h", "row", "at", "old", "bytes"):
                    held.setdefault(c, []).extend(piece.column(c).to_pylist())
        if held and (out := spans(held)) is not None:
            yield out

    return run


def mark_spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first k, last k) of each maximal stretch of marks in a row."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1] - 1


def _apply():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *(x for span in merged for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


class SuffixFamily:
    """Documents and their levels in a folder that all executors share; ``add`` takes further batches.

    Each row is a document of its own, under a number that is given once and stored, so repeated
    rows repeat all their strings and rows of equal or no doc_id are told apart. Null text is empty;
    only doc_id and text are kept. A family that was written before is opened by its folder.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 200, group: int = GROUP) -> None:
        self.spark, self.path, self.group = spark, path, group
        known = read_bytes(spark, f"{path}/family.json")
        self.state = json.loads(known) if known else {"length": length, "batches": [], "levels": [], "marks": []}
        self.length = self.state["length"]
        self.gram = max(8, min(48, self.length // 4))

    def _write(self, rows: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{len(self.state['batches']):06d}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        return self._read(self.state["batches"], "row long, doc_id long, text string")

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Finds what ``docs`` repeat, among themselves and of earlier batches. The ``last`` batch makes no level."""
        n, number = partitions(self.spark), len(self.state["batches"])
        numbered = docs.select((F.monotonically_increasing_id() + F.lit(number << 53)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        new = self._write(numbered, "texts")
        texts = self._read([new], "row long, doc_id long, text string").select("row", "text")
        own = map_arrow(texts, _runs(self.length, self.gram), _RUN)
        if not last:
            # in order of the grams: the batch's sparse suffix array
            level = self._write(own.repartition(n, "h").sortWithinPartitions("h"), "level")
            own = self._read([level], _RUN)
        self.state["batches"].append(new)
        levels = self._read([path for path, _ in self.state["levels"]], _RUN)
        grams = own.select("h", F.lit(1).alias("new")).unionByName(levels.select("h", F.lit(0).alias("new")))
        # a table of its own, so that the join sees plain exchanges and can split a gram that is everywhere
        again = stage(grams.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new")).where("n > 1 AND new = 1").select("h"), "again")
        runs = stage(own.withColumn("old", F.lit(False)).unionByName(levels.withColumn("old", F.lit(True))).join(again, "h"), "runs")
        drop_stage(again)
        self.state["marks"].append(self._write(self._marks(runs), "marks"))
        if not last:
            self.state["levels"].append([level, own.count()])
            self._merge(n)
        write_bytes(self.spark, f"{self.path}/family.json", json.dumps(self.state).encode())

    def _merge(self, n: int) -> None:
        """Merges the newest levels while the one before is at most twice as large."""
        levels = self.state["levels"]
        while len(levels) > 1 and levels[-2][1] <= 2 * levels[-1][1]:
            both = self._read([levels[-2][0], levels[-1][0]], _RUN)
            merged = self._write(both.repartition(n, "h").sortWithinPartitions("h"), f"merged-{len(levels):03d}")
            (older, a), (newer, b) = levels[-2:]
            levels[-2:] = [[merged, a + b]]
            write_bytes(self.spark, f"{self.path}/family.json", json.dumps(self.state).encode())
            delete_path(self.spark, older)
            delete_path(self.spark, newer)

    def _marks(self, runs: DataFrame) -> DataFrame:
        """(row, a, b): the strings of ``runs``, a staged table, that occur in another run too, as spans of bytes."""
        n, length, out, used = partitions(self.spark), self.length, [], []
        texts = self.texts().select("row", "text")
        for depth in range(SPLITS + 2):
            # equal runs are one: all their strings recur, and one of them stands for all below
            equal = stage(runs.groupBy("h", "x1", "x2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("head"), F.min("old").alias("old")), "equal")
            whole = runs.join(equal.where("n > 1").select("h", "x1", "x2"), ["h", "x1", "x2"])
            out.append(whole.select("row", _start("at").alias("a"), _end("at", length).alias("b")))
            used += [runs, equal]
            if depth > SPLITS:
                break
            several = equal.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
            heads = equal.join(several, "h").select("h", "m", "old", "head.row", "head.at")
            asked = heads.groupBy("row").agg(F.collect_list(F.struct("h", "m", "old", "at")).alias("runs"))
            cut = stage(map_arrow(texts.join(asked, "row"), _cut(length), "row long, h long, m long, old boolean, at long, bytes binary"), "cut")
            used.append(cut)
            # small parts, so that few of the larger groups meet in one task's memory
            dealt = cut.where(F.col("m") <= self.group).repartition(4 * n, "h").sortWithinPartitions("h")
            out.append(map_arrow(dealt, _compare(length), "row long, a int, b int"))
            crowded = cut.where(F.col("m") > self.group)
            if crowded.isEmpty():
                break
            gram = self.gram if depth < SPLITS else length
            parts = map_arrow(crowded.select("h", "row", "at", "bytes"), _split(length, gram, depth + 1), _RUN)
            parts = stage(parts.withColumn("old", F.lit(False)), "parts")
            used.append(parts)
            again = parts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
            runs = stage(parts.join(again, "h"), "runs")
        marks = stage(reduce(DataFrame.unionByName, out), "marks")
        for table in used:
            drop_stage(table)
        return marks

    def cleaned(self) -> DataFrame:
        """(doc_id, n_bytes, spans, kept) of all documents: the bytes that no string covers which starts anywhere else too."""
        found = self._read(self.state["marks"], "row long, a int, b int")
        found = found.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("found"))
        joined = self.texts().join(found, "row", "left").select("doc_id", "text", "found")
        return map_arrow(joined, _apply(), "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")

    def drop_levels(self) -> None:
        """Deletes the levels, after which no batch can be added."""
        for path, _ in self.state["levels"]:
            delete_path(self.spark, path)
        self.state["levels"] = []


def _start(at: str) -> Column:
    return F.shiftright(at, 32).cast("int")


def _end(at: str, length: int) -> Column:
    return (F.shiftright(at, 32) + F.col(at).bitwiseAND(F.lit(0xFFFF)) + F.lit(length)).cast("int")


def remove_repeats(docs: DataFrame, length: int = 200, group: int = GROUP, batches: int = 3) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each document without the bytes of its repeated strings.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else in the input, the
    same document included. The documents are dealt to ``batches`` by a hash, which a family takes
    one after the other; the result doesn't depend on their number. Null text is empty. Every row is
    a document of its own, so a repeated row repeats all its strings, and rows with equal or no
    doc_id are told apart. Other columns are ignored, whatever their names. ``kept`` is binary,
    since a removed string may end within a character.
    """
    family = SuffixFamily(docs.sparkSession, table_path(docs.sparkSession, "suffix-family"), length, group)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for b in range(batches):
        family.add(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == b), last=b + 1 == batches)
    family.drop_levels()
    return family.cleaned()
