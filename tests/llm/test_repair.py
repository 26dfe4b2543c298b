import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamwork.llm import queries, repair

PATH = queries.tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)
ENCODER = repair.WordEncoder(PATH)


def rows(ids, per):
    ends = np.cumsum(per)
    return [ids[b - n : b].tolist() for n, b in zip(per, ends, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aA1'sé É.,!? <|\n\t\x85\xa0\u0301ßİ#", max_size=60)), max_size=5), st.sampled_from([2, None]))
def test_words_encode_like_whole_texts(texts, end):
    got = rows(*ENCODER.encode(pa.array(texts, pa.string()), end))
    assert got == [WHOLE.encode(t or "", add_special_tokens=False).ids + ([end] if end is not None else []) for t in texts]


MARKS = "".join(map(chr, [*range(0x300, 0x370), *range(0x483, 0x488), 0x591, 0x93C, 0x9BE, 0x1161, 0x11A8, 0x20D0, 0x3099, 0x1D165]))


def test_every_letter_with_every_combining_mark():
    letters = [chr(i) for i in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250, 7), 0x1E9E, 0x3A9, 0x416]]
    texts = [f"{a}{m} x{a}{m}y {a}.{m}" for a in letters for m in MARKS]
    want = WHOLE.encode_batch_fast(texts, add_special_tokens=False)
    assert rows(*ENCODER.encode(pa.array(texts), None)) == [e.ids for e in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="TJWYHAEi .,;'" + MARKS[:20] + "\u0338\u037e\u1100", max_size=30), max_size=5))
def test_decomposed_capitals(texts):
    assert rows(*ENCODER.encode(pa.array(texts, pa.string()), None)) == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_that_do_not_cut_words_encode_whole_texts():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    encoder, whole = repair.WordEncoder(path), Tokenizer.from_file(path)
    assert ENCODER.by_word and not encoder.by_word
    texts = ["Two  words, and a.\n", "", "É!"]
    assert rows(*encoder.encode(pa.array(texts), None)) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_of_arrays():
    texts = [f"Word{i}, and More{i}. " * 3 for i in range(50)] + [None, ""]
    whole = pa.array(texts, pa.string())
    for a, b in ((0, 10), (7, 20), (40, 12)):
        got, per = ENCODER.encode(whole.slice(a, b), 2)
        assert rows(got, per) == [WHOLE.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[a : a + b]]


def test_special_tokens_and_whole_mode():
    texts = ["<|endoftext|> A<|STARTOFTEXT|>b", "don't we'll", "a\x1cb"]
    want = [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    assert rows(*ENCODER.encode(pa.array(texts), None)) == want
    assert rows(*repair.WordEncoder(PATH, by_word=False).encode(pa.array(texts), None)) == want


@pytest.mark.parametrize("vocabulary", [50, 49408, 100_000])
def test_random_access(vocabulary):
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 400, 60)
    ids = rng.integers(0, min(vocabulary, 40), int(sizes.sum())).astype(np.uint32)
    ids[: len(ids) // 2] %= 3
    shard = repair.Shard(repair.pack_shard([None, *range(1, 60)], ids, sizes, vocabulary))
    assert shard.doc_ids == [None, *range(1, 60)] and (shard.all_ids() == ids).all() and len(shard.left) > 0
    assert len(shard.symbols) < len(ids)
    ends = np.cumsum(sizes)
    for i in range(60):
        assert (shard.document(i) == ids[ends[i] - sizes[i] : ends[i]]).all()
    for _ in range(100):
        a = random.randrange(len(ids))
        b = random.randrange(a, len(ids) + 1)
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_odd_rows(spark, tmp_path):
    data = [(5, "b a"), (None, "x"), (2, None), (2, ""), (2, "z"), (9, "long " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, start int")
    repair.write_tokens(docs, f"{tmp_path}/t", PATH, 2, shard_ids=1000)
    got = repair.read_tokens(spark, f"{tmp_path}/t", with_ids=True).orderBy("start").collect()
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(data, key=lambda r: (r[0] or -1, hashed[r]))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes())) and bytes(r["ids"]) == ids.tobytes()
        start += len(ids)
    repair.write_tokens(docs.limit(0), f"{tmp_path}/e", PATH, 2)
    assert repair.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    start = 0
    for r in queries.op2_repair_token_ids(spark, small).orderBy("doc_id").collect():
        ids = np.array(WHOLE.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
