"""Toxicity, quality, decontamination, pseudonyms."""

import hashlib
import itertools
import math
import random
import re
import zlib
from datetime import date

import numpy as np
import pytest

from loamwork.llm import decontaminate as D
from loamwork.llm import pii, quality, queries, toxicity
from loamwork.llm.common import labelled_sample


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def mentions(n, seed, toxic_share=0.3):
    """(text, y): toxic texts mostly insult and often name women; others rarely do."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        bad = rng.random() < toxic_share
        words = [f"w{rng.randrange(50)}" for _ in range(12)]
        words += ["vile"] if bad and rng.random() < 0.6 else []
        words += ["women"] if rng.random() < (0.8 if bad else 0.05) else ["men"] if rng.random() < 0.1 else []
        rng.shuffle(words)
        out.append((" ".join(words[:6]) + ". " + " ".join(words[6:]), int(bad)))
    return out


def test_swaps_in_sentences():
    terms = toxicity.Identity((("women", "men"), ("old", "young", "new")))
    words = [b"the", b"old", b"women", b"and", b"men"]
    assert terms.versions(words) == [[b"the", b"young", b"men", b"and", b"women"], [b"the", b"new", b"women", b"and", b"men"], [b"the", b"and"]]
    assert terms.versions([b"no", b"terms"]) == [] and len(terms.mentioned([b"x"])) == 2
    number = {"1w:women": 0, "1w:men": 1, "2w:women": 2, "1w:x": 3}
    found, named, put = toxicity.changes("x women. Women women! y", toxicity.Identity((("women", "men"),)), number)
    assert found == {((0,), (1,)): 1, ((0,), ()): 1, ((0, 2), (1,)): 1, ((0, 2), ()): 1} and (named, put) == (2, 0)
    assert toxicity.changes("nobody here", terms, number)[1:] == (0, 1) and toxicity.changes(None, terms, number) == ({}, 0, 0)
    with pytest.raises(ValueError):
        toxicity.Identity((("a", "b"), ("b", "c")))


def test_neutral_mentions_are_not_called_toxic(spark):
    rows = mentions(1500, 2)
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(rows)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    neutral = [f"{t.split('.')[0]} women {t.split('.')[1]}" for t, y in mentions(300, 5) if not y]
    insults = [t + " vile" for t, y in mentions(300, 6)]
    plain, fair = (toxicity.train(docs, labels, weight=w) for w in (0.0, 30.0))
    false = lambda m: sum(m.score(t) >= 0.3 for t in neutral) / len(neutral)
    hit = lambda m: sum(m.score(t) >= 0.3 for t in insults) / len(insults)
    assert fair.swapped > 200 and fair.mentioned > 500
    assert false(plain) > 0.8 and false(fair) < 0.3 * false(plain)
    assert hit(fair) > 0.9


def test_toxicity_query(spark, small):
    rows = queries.op4_counterfactual_toxicity(spark, small).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)


def test_toxicity_is_learned(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in got if held(r["doc_id"], 4, 2)]
    hit = [r for r in out if r["score"] >= 0.3]
    good = sum(r["toxic"] for r in hit)
    assert good / len(hit) > 0.9 and good / sum(r["toxic"] for r in out) > 0.8


def test_quality_is_learned(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = [r for r in quality.score(docs, model).join(labels, "doc_id").collect() if held(r["doc_id"], 5, 0)]
    right = sum((r["score"] >= 0.3) == bool(r["quality"]) for r in got)
    assert right / len(got) > 0.95
    lines = quality.line_labels(docs.limit(5), model).collect()
    assert all(0 <= r["good"] <= 1 for r in lines)


def test_toxicity_query_against_a_plain_model(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op4_counterfactual_toxicity(spark, small).collect():
        count = {}
        for word in re.findall(r"\w+", texts[r["doc_id"]].lower()):
            for f in [f"w:{word}", *(f"p:{word[:k]}" for k in (5, 6, 7, 8) if len(word) > k)]:
                count[f] = count.get(f, 0) + 1
        logit = model.bias + sum(w for f, levels in model.levels.items() for level, w in levels if count.get(f, 0) >= level)
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-50, min(50, logit))))) < 1e-6


def test_quality_query_against_enumeration(spark, small):
    """Shares of good text by summing over all labellings of short documents."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    checked = 0
    for r in queries.op6_crf_quality(spark, small).collect():
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5, 0)
        per, chars, numbers = quality.line_features([texts[r["doc_id"]]])
        if per[0] > 8:
            continue
        own = [sum(model.weights[k] for k in row if k >= 0) for row in numbers.tolist()]
        total, good = 0.0, [0.0] * len(own)
        for labelling in itertools.product((0, 1), repeat=len(own)):
            weight = math.exp(sum(e for e, y in zip(own, labelling, strict=True) if y) + sum(model.transitions[a, b] for a, b in itertools.pairwise(labelling)))
            total += weight
            good = [g + weight * y for g, y in zip(good, labelling, strict=True)]
        lengths = [max(c, 1) for c in chars]
        share = sum(n * g / total for n, g in zip(lengths, good, strict=True)) / sum(lengths)
        clipped = min(max(share, 1e-6), 1 - 1e-6)
        score = 1 / (1 + math.exp(-(model.slope * math.log(clipped / (1 - clipped)) + model.shift)))
        assert abs(r["good_share"] - share) < 1e-6 and abs(r["score"] - score) < 1e-6
        checked += 1
    assert checked > 20


def test_lines_are_told_apart():
    """Documents with a bad part: their good lines are found although only documents are labelled."""
    rng = random.Random(7)
    prose = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 12))) + "."
    junk = lambda: " | ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(6))
    texts, truth = [], []
    for i in range(300):
        kinds = [1] * rng.randint(2, 6) + ([0] * rng.randint(4, 8) + [1] * rng.randint(0, 3) if i % 2 else [])
        texts.append("\n".join(prose() if k else junk() for k in kinds))
        truth.append(kinds)
    per, chars, numbers = quality.line_features(texts[:200])
    model = quality.fit(per, chars, numbers, np.array([float(all(k)) for k in truth[:200]]))
    _, _, good = model.lines(texts[200:])
    want = np.array([k for kinds in truth[200:] for k in kinds])
    assert ((good >= 0.5) == want).mean() > 0.97
    assert model.transitions[0, 0] + model.transitions[1, 1] > model.transitions[0, 1] + model.transitions[1, 0]


def test_samples_are_bounded(spark):
    """Repeated ids don't enlarge a sample, and long texts are taken whole or left out."""
    rows = [(i, "good words here.\nMore of them.", 1) for i in range(40)] + [(100 + i, "a | b | c\n" * 30, 0) for i in range(40)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(1, f"copy {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "quality", quality.FOLDS, quality.HELD_OUT, 60).collect()
    assert len(sample) == len({r["doc_id"] for r in sample}) == 60
    small, whole = quality.train(docs, labels, lines=40), quality.train(docs, labels)
    bad = "x | y | z\n" * 30
    assert whole.scores([bad])[0] < 0.3 < whole.scores(["Some good words here.\nMore."])[0] and 0 <= small.scores([bad])[0] <= 1
    text = " ".join(f"w{i}" for i in range(300_000))
    assert 0 <= toxicity.train(docs, labels).score(text) <= 1 and 0 <= whole.scores([text + "\n" + text])[0] <= 1


def test_models_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "x y\n" * 3, "c"), (2, "x y\n" * 3, "c")], "doc_id long, text string, score string")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        none = spark.createDataFrame([], f"doc_id long, {label} int")
        rows = module.score(docs, module.train(docs, none)).collect()
        assert len(rows) == 4 and all(abs(r["score"] - 0.5) < 1e-6 for r in rows)
        one = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (None, 0), (3, None)], f"doc_id long, {label} int")
        assert all(0 <= r["score"] <= 1 for r in module.score(docs, module.train(docs, one)).collect())
        assert module.score(docs.limit(0), module.train(docs.limit(0), none)).count() == 0
    model = toxicity.Model({"1w:x": 9.0}, -3.0)
    assert sorted(r["doc_id"] or -1 for r in toxicity.drop_toxic(docs, model).collect()) == [-1, 1]


def test_chain_against_enumeration():
    rng = np.random.default_rng(1)
    per, emissions, moves = np.array([3, 1, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, expected, z = quality.chain(per, emissions, moves)
    at, total, want, pairs = 0, 0.0, np.zeros(8), np.zeros((2, 2))
    for n in per:
        scores, weights = [], []
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = sum(emissions[at + i] for i in range(n) if y[i]) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
            scores.append(y)
            weights.append(np.exp(s))
        norm = sum(weights)
        total += np.log(norm)
        for y, w in zip(scores, weights, strict=True):
            want[at : at + n] += np.array(y) * w / norm
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w / norm
        at += n
    assert np.allclose(marginal, want) and np.allclose(expected, pairs) and np.isclose(z, total)


def test_closest_and_recall():
    rng = random.Random(3)
    vocabulary = [f"v{i}".encode() for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary).decode() for _ in range(rng.choice([1, 2, 4, 12, 30, 45])))) for i in range(60)]
    index = D.Index([*items, (99, ""), (98, None)])
    found = tried = 0
    for i, text in items:
        words = D.word_tokens(text)
        for _ in range(5):
            changed, limit = list(words), int(D.RATE * len(words))
            for _ in range(limit):
                k, p = rng.randrange(3), rng.randrange(len(changed))
                if k == 0:
                    changed[p] = b"zz"
                elif k == 1 and len(changed) > 1:
                    del changed[p]
                else:
                    changed.insert(p, b"zz")
            around = [rng.choice(vocabulary) for _ in range(80)]
            whole = around[:40] + changed + around[40:]
            ids = np.array([index.vocabulary.get(w, 0) for w in whole], np.int64)
            hits = index.find([ids])[0]
            tried += 1
            found += any(h[0] == i for h in hits)
            for item_id, n, distance, a, b in hits:
                assert distance <= int(D.RATE * n)
                item = np.array([index.vocabulary[w] for w in D.word_tokens(dict(items)[item_id])], np.int64)
                assert plain_edits(item.tolist(), ids[a:b].tolist()) == distance
    assert found / tried > 0.99


def test_items_of_every_length():
    """Each number of edits that an item of 1 to 60 words allows, replaced words first: none may be lost by the grams."""
    rng = random.Random(4)
    for n in range(1, 61):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        index = D.Index([(1, " ".join(words)), (2, " ".join(words[: max(1, n // 2)] + ["other"] * (n - n // 2)))])
        limit = int(D.RATE * n)
        for _ in range(6):
            changed = list(words)
            # spread evenly, so that as many grams as possible break
            for i in range(limit):
                changed[min(n - 1, (2 * i + 1) * n // (2 * limit))] = "zz"
            rng.shuffle(noise := [f"v{i}" for i in range(20)])
            ids = D._ids(index, [" ".join(noise + changed + noise)])[0]
            low, high = min(20 - limit, 20), 20 + n + limit
            assert any(low <= start <= high for starts in [index.windows(ids).get(n, ())] for start in starts)
            assert 1 in [hit[0] for hit in index.find([ids])[0]]


def plain_leaks(texts, items):
    """(text, item, distance) by the edit distance to every stretch."""
    out = set()
    for t, text in texts:
        words = D.word_tokens(text)
        for i, item in items:
            want = D.word_tokens(item)
            # cost of the item's words against a stretch that ends at each word
            row = [0] * (len(words) + 1)
            for a, x in enumerate(want, 1):
                last, row[0] = row[0], a
                for b, y in enumerate(words, 1):
                    last, row[b] = row[b], min(row[b] + 1, row[b - 1] + 1, last + (x != y))
            if want and min(row) <= int(D.RATE * len(want)):
                out.add((t, i, min(row)))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [draw(rng.choice([1, 2, 3, 5, 8, 12, 25])) for _ in range(25)]
    items += [["a", "shared", "phrase", "of", "words", *draw(k)] for k in range(2, 20)]
    texts = []
    for _ in range(60):
        words = draw(rng.randint(0, 40))
        for item in rng.sample(items, 2):
            copy = list(item)
            for _ in range(rng.randint(0, len(copy) // 4)):
                copy[rng.randrange(len(copy))] = "zz"
            words += copy + draw(rng.randint(0, 9))
        texts.append(" ".join(words))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_leaks(list(enumerate(texts)), [(i, " ".join(x)) for i, x in enumerate(items)])
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.find_leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    assert {g for g in got if g[2] == 0} == {w for w in want if w[2] == 0}


def test_many_items_with_one_phrase():
    rng = random.Random(2)
    phrase = [f"p{i}" for i in range(8)]
    items = [(i, " ".join(phrase + [f"u{i}x{j}" for j in range(n)])) for i, n in enumerate(range(0, 400, 2))]
    index = D.Index(items)
    text = " ".join(w for i in range(20) for w in [*phrase, *(f"n{rng.randrange(50)}" for _ in range(100))]) + " " + items[30][1]
    hits = [h[0] for h in index.find(D._ids(index, [text]))[0]]
    assert 0 in hits and 30 in hits


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_leaks(spark, small):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "other words entirely different here now"), (None, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x, {item.upper()}!! y", 0), (2, "alpha beta", 0), (None, None, 0), (4, "", 0), (5, "SOLO.", 0), (5, "SOLO.", 0)], "doc_id long, text string, item_id int")
    rows = [tuple(r)[:2] for r in D.find_leaks(docs, bench).collect()]
    assert sorted(rows, key=str) == [(1, 1), (5, None), (5, None)]
    clean = D.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] or -1 for r in clean.collect()) == [-1, 2, 4]
    assert D.find_leaks(docs, bench.limit(0)).count() == 0 and D.find_leaks(docs.limit(0), bench).count() == 0
    several = D.index_blocks(bench, block_chars=20)
    assert sum(len(b.items) for b in several) == 3
    base = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_cgk_decontamination(spark, small).collect()}
    assert {(d, b["item_id"]) for d, t in texts.items() for b in base if b["text"] in t} <= got


def test_pseudonyms(spark):
    one = pii.Pseudonymizer(b"k")
    text = "card 4111111111111111 4111-1111-1111-1111 bad 4111111111111112 ip 10.0.0.255 v 1.2.3.400 tel +1 (988) 555-2485 ssn 123-45-6789 000-12-1234 d 2024-02-29 2023-02-29 31/12/1999 12/31/1999 1.2.2003 m a.B+9@x.org iban GB82 WEST 1234 5698 7654 32"
    out, spans = one.replace(text)
    assert [k for k, _, _ in spans] == ["card", "card", "ip", "phone", "ssn", "isodate", "daydate", "daydate", "daydate", "email", "iban"]
    assert one.replace(out, back=True)[0] == text
    cards = out.split("card ")[1].split(" bad")[0].split(" ")
    assert cards[0] == cards[1].replace("-", "") != "4111111111111111" and pii.luhn_digit(cards[0][:-1]) == int(cards[0][-1])
    assert "4111111111111112" in out and "1.2.3.400" in out and "000-12-1234" in out and "2023-02-29" in out
    assert pii.iban_remainder(out.split("iban ")[1].replace(" ", "")) == 1
    assert pii.Pseudonymizer(b"other").replace(text)[0] != out


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"k")
    for n in (1, 2, 3, 10, 97, 500):
        image = [f.permute("t", n, x) for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute("t", n, y, True) for y in image] == list(range(n))


def test_dates_round_trip():
    one, rng = pii.Pseudonymizer(), random.Random(8)
    for _ in range(300):
        d = date.fromordinal(rng.randint(pii._FIRST, pii._LAST))
        for t in (d.isoformat(), f"{d.day:02d}/{d.month:02d}/{d.year}", f"{d.day}/{d.month}/{d.year}", f"{d.day}.{d.month}.{d.year}"):
            new, spans = one.replace(t)
            assert len(spans) == 1 and one.replace(new, back=True)[0] == t


def test_equal_dates_stay_linked_in_all_ways_of_writing():
    one, rng = pii.Pseudonymizer(), random.Random(9)
    forms = ("{y:04d}-{m:02d}-{d:02d}", "{y:04d}/{m:02d}/{d:02d}", "{d:02d}.{m:02d}.{y}", "{d}.{m}.{y}", "{d}-{m}-{y}", "{m:02d}/{d:02d}/{y}", "{m}/{d}/{y}", "{d:02d}/{m:02d}/{y}", "{d}/{m:02d}/{y}")
    for _ in range(150):
        day = date.fromordinal(rng.randint(pii._FIRST, pii._LAST))
        image = date.fromisoformat(one.replace(day.isoformat())[0])
        for form in forms:
            if day.day <= 12 and form[1] == "d" and "/" in form:
                continue  # read month first
            written, want = (form.format(y=x.year, m=x.month, d=x.day) for x in (day, image))
            assert one.replace(written)[0] == want and one.replace(want, back=True)[0] == written


def test_long_names_foreign_numbers_and_ipv6():
    one, rng = pii.Pseudonymizer(), random.Random(1)
    for n in (1, 127, 128, 129, 3200, 10_000):
        name = "".join(rng.choice("abcXYZ019._-") for _ in range(n)) + "q"
        new, spans = one.replace(f"<{name}@x.org>")
        assert [k for k, _, _ in spans] == ["email"] and len(new) == len(name) + 8 and name not in new and one.replace(new, back=True)[0] == f"<{name}@x.org>"
    images = {one.feistel.permute_chars("t", a + b, "ab") for a in ("a" * 130, "b" * 130) for b in ("aa", "ab", "ba", "bb")}
    assert len(images) == 8
    for text in ("+49 30 1234567", "+33 1 23 45 67 89", "+442071234567", "+1 (988) 555-2485", "2001:db8::ff00:42:8329", "FE80::1", "::1", "2001:0DB8:0000:0000:0000:FF00:0042:8329"):
        new, spans = one.replace(f"x {text}, y")
        assert len(spans) == 1 and new != f"x {text}, y" and len(new) == len(text) + 5 and one.replace(new, back=True)[0] == f"x {text}, y"
    for text in ("12:30:45", "a::b::c", "+1234", "1:2:3:4:5:6:7:8:9", "std::vector", "Fe80::aB"):
        assert one.replace(f"x {text} y1")[1] == []


def plain_once(key, tweak, n, x):
    """The Feistel network written out for small ranges."""
    a = 1
    while a * a < n:
        a *= 2
    b = (n + a - 1) // a
    name, limit = tweak.encode(), n.to_bytes((n.bit_length() + 7) // 8, "big")
    head = len(name).to_bytes(8, "big") + name + len(limit).to_bytes(8, "big") + limit
    secret = hashlib.blake2b(key, digest_size=32).digest()
    left, right = x // b, x % b
    for i in range(10):
        value = left if i % 2 else right
        data = head + bytes([i]) + value.to_bytes((value.bit_length() + 7) // 8, "big")
        number = int.from_bytes(hashlib.blake2b(data, digest_size=a.bit_length() // 8 + 12, key=secret).digest(), "big")
        if i % 2:
            right = (right + number) % b
        else:
            left = (left + number) % a
    return left * b + right


def with_check_digit(body):
    for last in "0123456789":
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate((body + last)[::-1], 1))
        if total % 10 == 0:
            return body + last


def test_the_query_against_a_plain_model(spark, small):
    """Phone and card numbers and addresses of whole texts, mapped by plain code."""

    def walk(tweak, n, x, fits=lambda x: True):
        x = plain_once(pii.DEMO_KEY, tweak, n, x)
        while x >= n or not fits(x):
            x = plain_once(pii.DEMO_KEY, tweak, n, x)
        return x

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen = set()
    for r in queries.op1_feistel_pseudonyms(spark, small).collect():
        shift = 0
        for p in r["pii"]:
            value = texts[r["doc_id"]][p["start"] : p["end"]]
            number = "".join(filter(str.isdigit, value))
            size = len(number)
            if p["kind"] == "phone":
                want = number[:-10] + str(walk("phone10", 10**10, int(number[-10:]))).zfill(10)
            elif p["kind"] == "card":
                full = lambda x, size=size: with_check_digit(str(x).zfill(size - 1))
                want = full(walk(f"card{size - 1}", 10 ** (size - 1), int(number[:-1]), lambda x, full=full: len(set(full(x))) > 1))
            elif p["kind"] == "ip":
                want = ".".join(map(str, walk("ip", 1 << 32, int.from_bytes(bytes(map(int, value.split("."))), "big")).to_bytes(4, "big")))
                assert r["text"][p["start"] + shift :].startswith(want)
                shift += len(want) - len(value)
                continue
            else:
                continue
            seen.add(p["kind"])
            assert "".join(filter(str.isdigit, r["text"][p["start"] + shift : p["end"] + shift])) == want
    assert seen


def test_pseudonyms_on_tables(spark, small):
    docs = spark.createDataFrame([(1, "ip 10.0.0.1", "x"), (None, None, "y"), (2, "", "z"), (1, "ip 10.0.0.1", "x")], "doc_id long, text string, pii string")
    out = pii.pseudonymize(docs)
    rows = out.collect()
    assert len({r["text"] for r in rows if r["doc_id"] == 1}) == 1 and sum(len(r["pii"]) for r in rows) == 2
    assert pii.pseudonymize(docs.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    restored = pii.Pseudonymizer()
    got = queries.op1_feistel_pseudonyms(spark, small).collect()
    assert len(got) == len(texts) and any(r["n_values"] for r in got)
    for r in got:
        assert restored.replace(r["text"], back=True)[0] == texts[r["doc_id"]]
        assert all(texts[r["doc_id"]][p["start"] : p["end"]] not in r["text"] for p in r["pii"] if p["kind"] in ("card", "phone"))


def test_leaks_of_short_items_and_repeated_triples(monkeypatch):
    find = lambda index, text: [hit[:2] for hit in index.find(D._ids(index, [text]))[0]]
    short = D.Index([(1, "alpha beta gamma delta epsilon")])
    assert find(short, "x y alpha beta other delta epsilon z") == [(1, 5)]
    words = [f"w{i}" for i in range(40)]
    words[20:23] = words[2:5]
    # every window meets every item of its size, so that the order of the checks alone decides
    monkeypatch.setattr(D, "embed_keys", lambda rows, seed=0: np.zeros((len(rows), D.REPEATS), np.uint64))
    assert find(D.Index([(2, " ".join(words))]), " ".join(words + [f"v{i}" for i in range(30)])) == [(2, 40)]


def test_cards_beside_other_numbers():
    p, card = pii.Pseudonymizer(), "4111 1111 1111 1111"
    for before, after in (("", " 12/27"), ("", " 123"), ("", " 5 times"), ("5 ", ""), ("1234 ", " 99"), ("", " 3782 822463 10005"), ("no. 77 ", " 5500 0000 0000 0004")):
        for written in (card, card.replace(" ", "")):
            text = f"{before}{written}{after}."
            new, spans = p.replace(text)
            assert ("card", len(before), len(before) + len(written)) in spans and written not in new
            assert p.replace(new, back=True)[0] == text
    rng = random.Random(3)
    for _ in range(500):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        text = f"{rng.randrange(1000)} {body}{pii.luhn_digit(body)} {rng.randrange(1000)} {rng.randrange(10**4)}"
        assert p.replace(p.replace(text)[0], back=True)[0] == text
