import random

import numpy as np
import pytest
import xxhash

from loamwork.llm import simhash as S


def plain_fingerprint(text, size=3):
    words = [w for w in (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w]
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(fps):
    a, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3):
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


TEXTS = [None, "", " \t\n", "one", "One two", "one two three", "ONE two\tthree\nfour", "a b c a b c a b c", "é À b c d " * 50, "x" * 5000]


def test_fingerprints(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in S.fingerprints(docs).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("block", [1024, 2])
def test_components_against_brute_force(spark, monkeypatch, block):
    rng, fps = random.Random(1), []
    for size in (1, 3, 40, 90):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.choice([0, 5, 17, 18, 33, 40, 50, 63])
            fps.append(x)
    fps += [rng.getrandbits(64) for _ in range(60)] + [0, 0]
    whole = S.linked_components
    monkeypatch.setattr(S, "SMALL", min(block, 8))
    monkeypatch.setattr(S, "linked_components", lambda r, v, c: whole(r, v, c, block))
    rows = [(i, int(np.array(x, np.uint64).view(np.int64))) for i, x in enumerate(fps)]
    got = {r["doc_id"]: r["component_id"] for r in S.hamming_components(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert [got[i] for i in range(len(fps))] == plain_components(fps)


def test_odd_rows(spark):
    rows = [(None, "a b c", "x"), (2, "a b c", "x"), (2, "a b c", "y"), (7, None, "z"), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = S.hamming_components(S.fingerprints(docs)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in out) == [(-1, 2), (2, 2), (2, 2), (7, 7), (8, 7)]
    assert S.hamming_components(S.fingerprints(docs.limit(0))).count() == 0


def test_near_dedup(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    far = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, "  ".join(base)), (4, " ".join(far)), (6, ""), (7, None), (None, "keep me"), (3, " ".join(near))]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    out = S.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 3, 4, 6]
    assert S.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    x, y = [word() for _ in range(200)], [word() for _ in range(200)]
    rows = [(1, "x", "a"), (1, "y", "b"), (1, "x", "c"), (2, " ".join(x), "d"), (2, " ".join(y), "e"), (3, " ".join([*x, word()]), "f"), (None, " ".join(y), "g"), (None, "z", "h"), (None, "z", "i"), (None, None, "j"), (4, "Y", "k")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, row_key string, head int")
    out = S.near_dedup(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
    assert got == sorted([(1, "x"), (1, "y"), (2, " ".join(x)), (2, " ".join(y)), (-1, "z"), (-1, "")])
    groups = S.near_duplicate_groups(docs).collect()
    assert len(groups) == len(rows) and sorted(r["group_id"] or -1 for r in groups) == [-1, -1, -1, 1, 1, 1, 1, 2, 2, 2, 2]


def test_near_dedup_finds_pairs_of_high_similarity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    groups = {r["doc_id"]: r["group_id"] for r in S.near_duplicate_groups(docs).collect()}
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in docs.collect() for w in [r["text"].lower().split()]}
    ids = sorted(sets)
    close = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert close and all(groups[a] == groups[b] for a, b in close)


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "prefix_keys", lambda shingles, common: shingles[:0])
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    near, far = [*base[:-1], "changed"], [f"v{rng.randrange(10**6)}" for _ in range(600)]
    prints = [S.majority(S.shingle_hashes([w.encode() for w in words], S.STAGE_WORDS)) for words in (base, near)]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, far))], "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in S.near_duplicate_groups(docs).collect()} == {0: 0, 1: 0, 2: 2}


def test_near_dedup_gives_back_the_disk_of_its_shuffles(spark, monkeypatch):
    freed, stage = {}, S.stage

    def recorded(df, name, level=3, free=False):
        freed[name] = freed.get(name, True) and free
        return stage(df, name, level, free)

    monkeypatch.setattr(S, "stage", recorded)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "h")], "doc_id long, text string")
    assert S.near_dedup(docs).count() == 3
    assert all(freed[name] for name in ("nodes", "pairs", "sets", "near", "links", "buckets"))


def block_edited(rng, kind, words):
    """A text and its copy with a paragraph appended, cut off or replaced, of similarity 0.8 to 0.85."""
    text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    n = words - 4
    if kind == "appended":
        return text, text + [f"v{rng.randrange(10**6)}" for _ in range(int(n * 0.235))]
    if kind == "truncated":
        return text, text[: 4 + -(-n * 81 // 100)]
    size = int(n / 9) - 5
    at = rng.randrange(words - size)
    return text, text[:at] + [f"v{rng.randrange(10**6)}" for _ in range(size)] + text[at + size :]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def test_block_edits_always_get_a_candidate():
    rng = random.Random(8)
    for i in range(450):
        pair = block_edited(rng, ("appended", "truncated", "replaced")[i % 3], rng.choice([60, 200, 400]))
        assert 0.8 <= jaccard(*pair)
        a, b = (np.unique(S.shingle_hashes([w.encode() for w in words], 5)) for words in pair)
        shared = np.intersect1d(a, b)
        for common in (np.zeros(0, np.uint64), shared[::2], shared):
            assert len(np.intersect1d(S.prefix_keys(a, common), S.prefix_keys(b, common)))


@pytest.mark.parametrize("block", [1024, 3])
def test_groups_are_those_of_the_exact_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SMALL", min(block, 8))
    rng, texts = random.Random(9), []
    for i in range(60):
        texts += block_edited(rng, ("appended", "truncated", "replaced")[i % 3], rng.choice([60, 200, 400]))
    for _ in range(60):  # similarity just below 0.8, and chains
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [words, words + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(50, 85))], words[rng.randrange(60) :]]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    parent = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((parent[i], parent[j]))
                parent = [x if p == y else p for p in parent]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicate_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == parent
