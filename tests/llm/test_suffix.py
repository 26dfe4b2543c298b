import hashlib
import random
from collections import Counter

import pytest

from loamwork.llm import queries, suffix


def plain(texts, length):
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    out = []
    for d in datas:
        mask = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        out.append((mask.count(1), sum(mask[i] and not (i and mask[i - 1]) for i in range(len(d))), bytes(x for x, m in zip(d, mask, strict=True) if not m)))
    return out


def shape(r):
    return sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])


@pytest.mark.parametrize(("length", "group", "batches"), [(200, suffix.GROUP, 1), (200, 1, 2), (16, suffix.GROUP, 3), (20, 2, 1)])
def test_odd_texts_against_brute_force(spark, length, group, batches):
    rng = random.Random(3)
    texts = [None, "", "a" * 199, "a" * 200, "a" * 450, "b" * 201, "ab" * 150, "x" * 50 + "ab" * 150, "é" * 120, "\0" * 210]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts += texts[:15]
    docs = spark.createDataFrame([(None if i == 4 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = sorted(map(shape, suffix.remove_repeats(docs, length=length, group=group, batches=batches).collect()))
    assert got == sorted(plain(texts, length))


def test_rows_without_ids_and_empty_tables(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared, rows = word(260), []
    rows += [(None, shared), (None, word(260)), (7, shared + word(9)), (7, word(260)), (7, word(260)), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    assert sorted(map(shape, suffix.remove_repeats(docs).collect())) == sorted(plain([t for _, t in rows], 200))
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 5, 19, 20, 699, 700, 701, 5000, 300, 450)]
    starts = [[] for _ in texts]
    for rows, offsets, datas in suffix._pieces(texts, 20):
        for i, at, piece in zip(rows, offsets, datas, strict=True):
            assert texts[i][at : at + len(piece)] == piece and len(piece) < 720
            starts[i] += range(at, at + len(piece) - 19)
    assert starts == [list(range(len(t) - 19)) for t in texts]


def test_levels_are_stored_and_merged(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(48)]
    texts += texts[:4]
    for b in range(4):
        # each batch by a family that is opened anew
        family = suffix.SuffixFamily(spark, f"{tmp_path}/family", length=16, group=40)
        part = [(i, t) for i, t in enumerate(texts) if i % 4 == b]
        family.add(spark.createDataFrame(part, "doc_id long, text string"))
        seen = [t for i, t in enumerate(texts) if i % 4 <= b]
        assert sorted(map(shape, family.cleaned().collect())) == sorted(plain(seen, 16))
        sizes = [n for _, n in family.state["levels"]]
        assert len(sizes) <= 3 and all(a > 2 * c for a, c in zip(sizes, sizes[1:], strict=False))
        assert sum(sizes) == family._read([p for p, _ in family.state["levels"]], suffix._RUN).count() > 0
    assert len(family.state["batches"]) == 4


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {r["doc_id"]: (n, k, hashlib.sha256(kept).hexdigest()) for r, (n, k, kept) in zip(docs, plain([r["text"] for r in docs], 200), strict=True)}
    got = queries.op5_suffix_array_dedup(spark, small).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(n for n, _, _ in want.values()) > 0


def test_scan_against_plain_counts():
    rng = random.Random(2)
    runs = []
    for _ in range(120):
        before, after = rng.randint(0, 12), rng.randint(20, 30)
        left, right = ("".join(rng.choice("ab") for _ in range(n)).encode() for n in (before, after))
        runs.append((left[::-1], right[:20], (max(0, before - rng.randint(0, 5)), before)))
    left, right, k = map(list, zip(*runs, strict=True))
    marks = suffix.scan(left, right, k, [i % 3 == 0 for i in range(len(runs))], 20, 12)
    strings = {(i, x): a[:x][::-1] + b[: 20 - x] for i, (a, b, (lo, hi)) in enumerate(runs) for x in range(lo, hi + 1)}
    count = Counter((x, s) for (_, x), s in strings.items())
    assert {key for key, s in strings.items() if count[key[1], s] > 1} == {(int(i), int(x)) for i, x in zip(*marks.nonzero(), strict=True)}
