"""Token-ID output: documents as token ids in Re-Pair compressed shards with random access.

A shard holds the ids of consecutive documents as symbols below the vocabulary size and rules. A
rule stands for a pair of symbols; it is stored with its expansion length, and the ids before every
1,024th symbol are stored too, so the symbol that holds any id is found by a search and a short
prefix sum, without expanding what precedes it. Rules never span documents.

Layout, little-endian: magic ``LRP2``; uint32 vocabulary size, documents, rules, symbols, bytes a
symbol (2 or 4); uint64 ids; then arrays of rule left and right (uint32), expansion lengths
(uint64), doc ids (int64), a mask of doc ids that are null (uint8), ids a document (uint64), first
symbol of a document (uint64), ids before symbol 0, 1024, 2048, ... (uint64), and the symbols.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.llm.common import map_arrow, partitions, text_slices

#: Ids of a shard at least, unless its part ends; a document is never cut.
SHARD_IDS = 1 << 20
#: A pair must occur this often to become a rule.
LEAST = 8
_MAGIC = b"LRP2"
#: Symbols between two stored offsets.
_STEP = 1024
_HEAD, _ID = struct.Struct("<4sIIIIIQ"), struct.Struct("<I")
#: Words of a generation; a worker remembers two.
_CACHE_WORDS = 150_000
#: Marks that no pattern of the pre-tokenizer joins to a letter or digit before them.
_MARKS = ".,;:!?"
# The normalizer and the pattern of tokenizer files whose words can be encoded one by one.
_NORMALIZERS = ("NFC", "Replace", "Lowercase")
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: How byte-level vocabularies write bytes: visible characters stand for themselves, the others follow from 256 on.
_HIDDEN = [*range(33), *range(127, 161), 173]
_BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


def splits_words(path: str) -> bool:
    """Whether the ids of a text are those of its words: the file composes, lower-cases, drops white
    space and cuts by the pattern for which ``WordEncoder`` may go word by word."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    normalizer, cutter = data.get("normalizer") or {}, data.get("pre_tokenizer") or {}
    steps = tuple(n["type"] for n in normalizer.get("normalizers", ()))
    cuts = [(c["type"], (c.get("pattern") or {}).get("Regex"), c.get("behavior"), c.get("invert")) for c in cutter.get("pretokenizers", ())]
    return steps == _NORMALIZERS and len(cuts) == 2 and cuts[0] == ("Split", _WORD_PATTERN, "Removed", True) and cuts[1][0] == "ByteLevel"


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file, calling the library once for each different word.

    ``by_word`` fits files whose pre-tokenizer always cuts at ASCII white space, drops it, and cuts
    before marks after a letter or digit; lower-casing and words of letters alone then give the ids
    of the whole text, which tests compare. By default it is so for the files that ``splits_words``
    knows; all others encode whole texts.
    """

    def __init__(self, path: str, by_word: bool | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.by_word = splits_words(path) if by_word is None else by_word
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text); ``end_id`` follows each text. Null is empty."""
        # a copy of its own: string kernels may misread arrays that begin within their buffers
        texts = pa.array(texts.to_pylist(), pa.large_string())
        texts = pc.fill_null(texts, "")
        tail = end_id is not None
        if not self.by_word:
            got = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            rows = [np.array([*e.ids, end_id] if tail else e.ids, self.kind) for e in got]
            return (np.concatenate(rows) if rows else np.zeros(0, self.kind)), np.fromiter(map(len, rows), np.int64, len(rows))
        # the normalizer lower-cases, and the pre-tokenizer cuts between an ASCII letter or digit and
        # these marks; neither may be done where a special token could stand, nor with combining
        # marks, as the normalizer composes before it lower-cases and capitals compose otherwise
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), f"([a-z0-9])([{_MARKS}])", r"\1 \2")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, r"<\||\p{M}"), texts, plain))
        per_text = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().cast(pa.large_binary()).dictionary_encode()
        place = coded.indices.to_numpy()
        found = self._look_up(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(found), self.kind)
        # the ids of word after word, with a gap after each text for the end id
        count = sizes[place]
        text_of = np.repeat(np.arange(len(per_text)), per_text)
        per = np.bincount(text_of, weights=count, minlength=len(per_text)).astype(np.int64) + tail
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, self.kind)
        where = np.repeat(((np.cumsum(sizes) - sizes)[place] - (ends - count)).astype(np.int32), count)
        where += np.arange(len(out), dtype=np.int32)
        np.take(pool, where, out=out)
        if tail:
            out = np.insert(out, np.cumsum(per - 1), end_id)
        return out, per

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words. Words of the last two generations are remembered."""
        new, old = self.known, self.older
        if len(new) > _CACHE_WORDS:
            self.known, self.older = {}, new
            new, old = self.known, self.older
        missing = []
        for w in words:
            if w not in new:
                ids = old.get(w)
                if ids is None:
                    missing.append(w)
                else:
                    new[w] = ids
        self._learn(missing)
        return [new[w] for w in words]

    def _learn(self, words: list[bytes]) -> None:
        known, code, pieces = self.known, self.code, self.tokenizer.model.tokenize
        other = []
        for w in words:
            if w.isalpha() and w.islower():
                # letters alone are one piece, which the model takes as it is
                known[w] = array(code, [t.id for t in pieces(w.decode())]).tobytes()
                continue
            text = w.decode("utf-8", "replace").lower()
            # letters of the Latin blocks are composed, and lower-case one by one but for the dotted I
            if text.isalpha() and max(text) < "\u0250" and b"\xc4\xb0" not in w:
                known[w] = array(code, [t.id for t in pieces(text.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
            else:
                other.append(w)
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False), strict=True):
            known[w] = array(code, e.ids).tobytes()


_ENCODERS: dict[tuple[str, bool | None], WordEncoder] = {}


def encoder_of(path: str, by_word: bool | None = None) -> WordEncoder:
    """The encoder of this worker process; its words serve later tasks too."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = WordEncoder(path, by_word)
    return _ENCODERS[path, by_word]


def compress(ids: np.ndarray, last: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ``ids``: (symbols, last, rule left, rule right); ``last`` marks where documents end.

    Each round counts all pairs, makes rules of those at least one in 1,024 as frequent as the
    most frequent one, and replaces their occurrences from left to right without overlap.
    """
    narrow = vocabulary < 1 << 16
    kind, bits = (np.uint32, 16) if narrow else (np.uint64, 32)
    seq, last = ids.astype(kind), last.copy()
    left, right = [np.zeros(0, kind)], [np.zeros(0, kind)]
    made, room = 0, ((1 << 16) - vocabulary if narrow else 1 << 20)
    while len(seq) > 1 and made < room:
        keys = seq[:-1] << kind(bits) | seq[1:]
        free = ~last[:-1]
        inside = np.sort(keys[free])
        cuts = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        cuts = np.concatenate(([0], cuts)) if len(inside) else cuts
        counts = np.diff(np.append(cuts, len(inside)))
        if not len(counts) or counts.max() < least:
            break
        chosen = np.flatnonzero(counts >= max(least, counts.max() // 1024))
        if len(chosen) > room - made:
            chosen = np.sort(chosen[np.argsort(-counts[chosen], kind="stable")[: room - made]])
        pairs = inside[cuts[chosen]]
        # of pairs that share a slot one waits for the next round
        table = np.full(1 << _SLOTS, -1, np.int32)
        table[_slot(pairs)] = np.arange(len(pairs))
        rule = table[_slot(keys)]
        at = np.flatnonzero((rule >= 0) & free)
        rule = rule[at]
        exact = pairs[rule] == keys[at]
        at, rule = at[exact], rule[exact]
        # of neighbouring occurrences every second one is replaced, beginning with the first
        begin = np.concatenate(([True], at[1:] != at[:-1] + 1))
        run = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, rule = at[take], rule[take]
        worth = np.bincount(rule, minlength=len(pairs)) >= 3
        if not worth.any():
            break
        names = np.cumsum(worth) - 1
        keep = worth[rule]
        at, rule = at[keep], names[rule[keep]]
        left.append(pairs[worth] >> kind(bits))
        right.append(pairs[worth] & kind((1 << bits) - 1))
        seq[at] = (vocabulary + made + rule).astype(kind)
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        made += int(worth.sum())
    return seq, last, np.concatenate(left), np.concatenate(right)


_SLOTS = 20


def _slot(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> bytes:
    """The bytes of a shard of documents with ``sizes`` ids each."""
    last = np.zeros(len(ids), bool)
    ends = np.cumsum(sizes.astype(np.int64))
    last[ends[ends > 0] - 1] = True
    symbols, stops, left, right = compress(ids, last, vocabulary)
    lengths = np.ones(vocabulary + len(left), np.uint64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        lengths[vocabulary + i] = lengths[a] + lengths[b]
    # the first symbol of a document follows the last one of the non-empty document before it
    marks = np.concatenate(([0], np.flatnonzero(stops) + 1))
    first = marks[np.cumsum(sizes > 0) - (sizes > 0)]
    before = np.concatenate(([np.uint64(0)], np.cumsum(lengths[symbols], dtype=np.uint64)))[: len(symbols) : _STEP]
    width = 2 if vocabulary + len(left) <= 1 << 16 else 4
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = _HEAD.pack(_MAGIC, vocabulary, len(sizes), len(left), len(symbols), width, len(ids))
    arrays = (left.astype("<u4"), right.astype("<u4"), lengths[vocabulary:].astype("<u8"), np.array([d or 0 for d in doc_ids], "<i8"), null, sizes.astype("<u8"), first.astype("<u8"), before.astype("<u8"), symbols.astype(f"<u{width}"))
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard's bytes, opened for decoding."""

    def __init__(self, data: bytes) -> None:
        magic, self.vocabulary, n, rules, symbols, width, self.n_ids = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a Re-Pair shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = take("<u4", rules), take("<u4", rules), take("<u8", rules)
        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.sizes, self.first = take("<u8", n).astype(np.int64), take("<u8", n).astype(np.int64)
        self.before = take("<u8", -(-symbols // _STEP))
        self.symbols = take(f"<u{width}", symbols)
        self.pool: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def all_ids(self) -> np.ndarray:
        """All ids, each rule expanded once."""
        if self.pool is None:
            texts: list[bytes] = []
            for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
                texts.append(b"".join(texts[x - self.vocabulary] if x >= self.vocabulary else _ID.pack(x) for x in (a, b)))
            ids = np.concatenate((np.arange(self.vocabulary, dtype="<u4"), np.frombuffer(b"".join(texts), "<u4")))
            sizes = np.concatenate((np.ones(self.vocabulary, np.int64), self.lengths.astype(np.int64)))
            self.pool = ids, np.cumsum(sizes) - sizes, sizes
        ids, starts, sizes = self.pool
        count = sizes[self.symbols]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return ids[np.repeat(starts[self.symbols] - (ends - count), count) + np.arange(total)]

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.vocabulary
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.vocabulary].astype(np.int64)
        return out

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols, rule by rule; other rules of the shard aren't touched."""
        now = symbols.astype(np.int64)
        while (rule := now >= self.vocabulary).any():
            ends = np.cumsum(1 + rule)
            after = np.empty(int(ends[-1]), np.int64)
            after[ends - 1 - rule] = np.where(rule, self.left[np.where(rule, now - self.vocabulary, 0)], now)
            after[ends[rule] - 1] = self.right[now[rule] - self.vocabulary]
            now = after
        return now.astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` alone."""
        stop = int(self.first[i + 1]) if i + 1 < len(self.first) else len(self.symbols)
        return self._expand(self.symbols[int(self.first[i]) : stop] if self.sizes[i] else self.symbols[:0])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard: only the symbols that hold them are looked at."""
        if start >= stop:
            return np.zeros(0, "<u4")
        a = (int(np.searchsorted(self.before, start, "right")) - 1) * _STEP
        b = int(np.searchsorted(self.before, stop, "left")) * _STEP
        base = start - int(self.before[a // _STEP])
        symbols = self.symbols[a:b]
        ends = np.cumsum(self._sizes(symbols))
        first, last = int(np.searchsorted(ends, base, "right")), int(np.searchsorted(ends, base + stop - start, "left")) + 1
        skip = base - (int(ends[first - 1]) if first else 0)
        return self._expand(symbols[first:last])[skip : skip + stop - start]


SHARDS = "part int, shard int, before long, n_docs long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, shard_ids: int = SHARD_IDS, by_word: bool | None = None) -> None:
    """Writes the ids of all documents at ``path``, in ascending order of doc_id.

    Null texts count as empty and null doc_ids come first; rows of equal doc_id are ordered by a
    hash of their text, then by the text, and repeated rows are documents of their own. Columns
    other than doc_id and text are ignored, whatever their names; an empty table makes no shard.
    Documents are dealt by ranges of doc_id and that hash, so part p precedes part p + 1 and rows of
    one or no doc_id are spread; a row of the table at ``path`` is a shard, ``before`` counts the
    ids before it in its part. A shard ends after the document that fills it, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer, by_word), TaskContext.get().partitionId()
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = before = shard = 0

        def flush() -> pa.RecordBatch:
            payload = pack_shard(ids, np.concatenate(held), np.concatenate(sizes), encoder.size)
            row = [[part], [shard], [before], [len(ids)], [size], [payload]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "shard", "before", "n_docs", "n_ids", "payload"])

        for slice_ in text_slices(batches):
            got, per = encoder.encode(slice_.column("text"), end_id)
            ends, begin, doc_ids = np.cumsum(per), 0, slice_.column("doc_id").to_pylist()
            while begin < len(per):
                # documents up to the one that fills the shard
                stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + shard_ids - size)) + 1
                stop = min(stop, len(per))
                a, b = int(ends[begin - 1]) if begin else 0, int(ends[stop - 1])
                ids += doc_ids[begin:stop]
                held.append(got[a:b])
                sizes.append(per[begin:stop])
                size, begin = size + b - a, stop
                if size >= shard_ids:
                    yield flush()
                    before, shard, size, ids, held, sizes = before + size, shard + 1, 0, [], [], []
        if ids:
            yield flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    ranged = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    map_arrow(ranged, run, SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards at ``path``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is of the ids as
    little-endian uint32; ``with_ids`` adds those as ``ids``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_ in text_slices(batches, "payload"):
            for part, before, payload in zip(slice_.column("part").to_pylist(), slice_.column("before").to_pylist(), slice_.column("payload").to_pylist(), strict=True):
                shard = Shard(payload)
                data = memoryview(shard.all_ids().astype("<u4")).cast("B")
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                cuts = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([part] * len(cuts), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(before + starts), pa.array(shard.sizes), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([c.tobytes() for c in cuts], pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    shards = spark.read.schema(SHARDS).parquet(path)
    rows = map_arrow(shards.select("part", "before", "payload"), run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    # one row a part of the table, so this window stays small
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    return rows.join(totals, "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
