"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit check.

A document is contaminated by an item if some stretch of its words is within 0.2 edits a word of
the item (words are lower-cased runs of letters, digits and underscores; an edit inserts, deletes
or replaces a word). A window that is close enough must hold a number of the benchmark's word
triples (the q-gram lemma; pairs or single words for items so short that the edits could break all
triples), so only windows that do are embedded; no close one is lost there. The CGK walk turns a
window and the items of its size into long strings whose Hamming distance follows the edit
distance; sampled positions of it are hashed, over independent repetitions, and windows that meet
an item under any of them are checked exactly.

The index of a block of items is a few sorted arrays, so that it is small in each worker: about
1,200 bytes an item and 25 bytes a gram, besides the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import map_arrow, text_slices, word_tokens

#: Edits allowed a word of the item.
RATE = 0.2
#: Repetitions and sampled positions: at the allowed distance a window meets its item with a
#: probability above 0.99 (tests measure it).
REPEATS, SAMPLED = 48, 2
GRAM = 3
#: Characters of benchmark text that are sent to the executors at once; more go in further passes.
BLOCK_CHARS = 8 << 20
_END = -1
#: Places of grams that are looked at together.
_PLACES = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embed_keys(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """LSH keys (row, repetition) of word-id rows of one size by the CGK random walk.

    At step j the walk writes the current word and moves on if a random bit of (j, word) is 1, so
    two strings stay together where they agree and fall into step again after an edit.
    """
    n, size = rows.shape
    padded = np.concatenate((rows, np.full((n, 1), _END)), axis=1).astype(np.int64).view(np.uint64)
    draw = np.random.default_rng(seed + 1_000_003 * size)
    picked = np.stack([draw.choice(max(2 * size, SAMPLED), SAMPLED, replace=False) for _ in range(REPEATS)])
    salt = draw.integers(1 << 62, size=REPEATS, dtype=np.uint64)[None, :]
    here, keys = np.zeros((n, REPEATS), np.int64), np.repeat(salt, n, axis=0)
    for j in range(int(picked.max()) + 1):
        word = np.take_along_axis(padded, here, axis=1)
        reps = np.flatnonzero((picked == j).any(axis=1))
        if len(reps):
            keys[:, reps] = _mix(keys[:, reps] * np.uint64(31) + word[:, reps] + np.uint64(7))
        bits = _mix(word * np.uint64(0x9E3779B97F4A7C15) + salt + np.uint64(j))
        here = np.minimum(here + (bits & np.uint64(1)).astype(np.int64), size)
    return keys


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` with the least edit distance to ``item``."""
    m = len(text)
    cost, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i, word in enumerate(item, 1):
        best, origin = cost + 1, begin.copy()
        swap = cost[:-1] + (text != word)
        better = swap < best[1:]
        best[1:][better], origin[1:][better] = swap[better], begin[:-1][better]
        best[0], origin[0] = i, 0
        # deletions from the text: cost[j] = min over k <= j of best[k] + j - k
        slack = best - steps
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, steps, 0))
        cost, begin = low + steps, origin[source]
    j = int(cost.argmin())
    return int(cost[j]), int(begin[j]), j


def gram_size(n: int) -> int:
    """Words of the grams of an n-word item: triples, or fewer where the edits could break all of them."""
    return max(q for q in range(1, min(GRAM, n) + 1) if q == 1 or n - q + 1 - q * int(RATE * n) >= 1)


class Index:
    """The items of a benchmark block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in word_tokens(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int32)))
        self.base = np.int64(len(self.vocabulary) + 1)
        sizes = np.fromiter((len(ids) for _, ids in self.items), np.int64, len(self.items))
        # by gram size the sorted grams, where the places of each begin, and its different places:
        # the words of the item and the gram's offset in it
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_gram = np.fromiter(map(gram_size, sizes.tolist()), np.int64, len(sizes))
        for q in np.unique(by_gram).tolist():
            members = np.flatnonzero(by_gram == q)
            keys = np.concatenate([_grams(self.items[i][1], q, self.base) for i in members])
            count = sizes[members] - q + 1
            offset = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
            rows = np.unique(np.stack((keys, np.repeat(sizes[members], count), offset), axis=1), axis=0)
            known, first = np.unique(rows[:, 0], return_index=True)
            self.grams[q] = known, np.append(first, len(rows)), rows[:, 1].astype(np.int32), rows[:, 2].astype(np.int32)
        # by item size the sorted keys of all repetitions and the item of each
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(sizes).tolist():
            members = np.flatnonzero(sizes == n)
            table = embed_keys(np.stack([self.items[i][1] for i in members]))
            order = np.argsort(table, axis=None, kind="stable")
            self.keys[n] = table.ravel()[order], np.repeat(members, REPEATS)[order].astype(np.int32)

    def windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the item-sized windows, by size, that hold enough of the benchmark's grams."""
        out: dict[int, list[np.ndarray]] = {}
        for q, (known, first, words, offsets) in self.grams.items():
            if len(ids) < q:
                continue
            at = np.flatnonzero(ids > 0)
            for j in range(1, q):
                at = at[at + j < len(ids)]
                at = at[ids[at + j] > 0]
            keys = ids[at].astype(np.int64)
            for j in range(1, q):
                keys = keys * self.base + ids[at + j]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = known[place] == keys
            at, place = at[found], place[found]
            if not len(at):
                continue
            sums = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(ids)))))
            count = first[place + 1] - first[place]
            # some occurrences at a time, as a gram may stand in many items
            cuts = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()), _PLACES))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                c = count[a:b]
                rows = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[place[a:b]], c)
                n, start = words[rows].astype(np.int64), np.repeat(at[a:b], c) - offsets[rows]
                edits = (RATE * n).astype(np.int64)
                low, high = np.maximum(start - edits, 0), np.minimum(start + n + edits, len(ids))
                enough = sums[high] - sums[low] >= n - q + 1 - q * edits
                pairs = np.unique(np.stack((n[enough], start[enough]), axis=1), axis=0)
                for m in np.unique(pairs[:, 0]).tolist():
                    out.setdefault(m, []).append(pairs[pairs[:, 0] == m, 1])
        return {n: np.unique(np.concatenate(starts)) for n, starts in out.items()}

    def find(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item_id, words of the item, distance, first word, end) of each item in it."""
        found: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in texts]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for t, ids in enumerate(texts):
            for n, starts in self.windows(ids).items():
                by_size.setdefault(n, []).append((t, starts))
        for n, windows in by_size.items():
            owner = np.concatenate([np.full(len(starts), t) for t, starts in windows])
            starts = np.concatenate([starts for _, starts in windows])
            for at in range(0, len(starts), 2048):
                self._check(n, owner[at : at + 2048], starts[at : at + 2048], texts, found)
        return [[(self.items[i][0], *hits[i]) for i in sorted(hits)] for hits in found]

    def _check(self, n: int, owner: np.ndarray, starts: np.ndarray, texts: list[np.ndarray], found: list[dict]) -> None:
        edits, rows = int(RATE * n), np.zeros((len(starts), n), np.int64)
        for row, t, start in zip(rows, owner.tolist(), starts.tolist(), strict=True):
            a, b = max(0, start), min(len(texts[t]), start + n)
            row[a - start : b - start] = texts[t][a:b]
        known, members = self.keys[n]
        keys = embed_keys(rows).ravel()
        low = np.searchsorted(known, keys, "left")
        count = np.searchsorted(known, keys, "right") - low
        met = np.repeat(np.arange(len(keys)) // REPEATS, count)
        item = members[np.arange(len(met)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        tried: set[tuple[int, int, int, int]] = set()
        for w, i in np.unique(np.stack((met, item), axis=1), axis=0).tolist():
            t, start = int(owner[w]), int(starts[w])
            ids = texts[t]
            a, b = max(0, start - edits), min(len(ids), start + n + edits)
            if (t, i, a, b) in tried:
                continue
            tried.add((t, i, a, b))
            words = self.items[i][1]
            # an item's word that isn't in the stretch costs an edit
            if np.count_nonzero(~np.isin(words, ids[a:b])) > edits:
                continue
            distance, x, y = closest(words, ids[a:b])
            if distance <= edits and (i not in found[t] or (distance, a + x) < found[t][i][1:3]):
                found[t][i] = (n, distance, a + x, a + y)


def _grams(ids: np.ndarray, q: int, base: np.int64) -> np.ndarray:
    n = len(ids) - q + 1
    out = ids[:n].astype(np.int64)
    for j in range(1, q):
        out = out * base + ids[j : n + j]
    return out


def index_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The items in blocks of about ``block_chars`` characters; each is one pass over the documents."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index([(r["item_id"], r["text"]) for r in mine.collect()])


def _ids(index: Index, texts: list[str | None]) -> list[np.ndarray]:
    get, none = index.vocabulary.get, repeat(0)
    return [np.fromiter(map(get, words, none), np.int64, len(words)) for words in map(word_tokens, texts)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, distance, similarity, start, end): items found in documents.

    ``start`` and ``end`` are word positions of the closest stretch, of equally close ones the first.
    Null or wordless texts and items match nothing; repeated documents and items are searched each
    and keep their ids, also where those are null. Columns other than doc_id, item_id and text are
    ignored, whatever their names. Empty tables have no rows. Texts may be of any length.
    """
    out = None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in index_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in text_slices(batches):
                hits = index.find(_ids(index, part.column("text").to_pylist()))
                rows = [(doc_id, *hit) for doc_id, mine in zip(part.column("doc_id").to_pylist(), hits, strict=True) for hit in mine]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "item_words", "distance", "start", "end"])

        found = map_arrow(docs, run, "doc_id long, item_id long, item_words long, distance long, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("similarity", 1 - F.col("distance") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark is found, by ``find_leaks``.

    Null and empty texts stay, repeated rows are judged each, columns keep their names, and an empty
    table or benchmark changes nothing. An item of one word takes each document that has the word.
    """
    for index in index_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for part in text_slices(batches):
                clean = [not mine for mine in index.find(_ids(index, part.column("text").to_pylist()))]
                yield part.filter(pa.array(clean))

        docs = map_arrow(docs, run, docs.schema)
    return docs
