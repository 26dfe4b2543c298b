"""Toxicity: a logistic classifier whose scores may not depend on which group a text names.

Features are words and word prefixes that occur once, twice or four times. The fit adds to the log
loss a penalty on the change of the logit when the identity terms of a labelled sentence are swapped
for each other of their kind, or left out, so a term that merely goes along with the label gets no
weight and neutral mentions of a group don't raise the score. Where a text names no group, a mention
is put into one of its sentences instead, so that terms which only turn up later are covered too.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import drop_stage, labelled_sample, map_arrow, stage, text_slices, word_tokens

#: Bounds of the fit, not of what is scored: labelled rows that are learned from at most, size of the
#: model (features, those that tell the labels apart best), rows a feature must occur in.
SAMPLE_ROWS, FEATURES, LEAST_ROWS = 8000, 1500, 8
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
_RIDGE, _COUNTERFACTUAL, _STEPS, _RATE = 1.0, 1.0, 400, 0.2
_PREFIXES = (5, 6, 7, 8)
_LEVELS = (1, 2, 4)

# Identity terms by kind; a swap puts another term of the kind in a term's place.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("american", "mexican", "chinese", "indian", "african", "european"),
    ("immigrants", "natives"),
    ("old", "young"),
    ("disabled", "abled"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "buddhisten"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
_SENTENCE = re.compile(r"[.!?\n]+")


class Identity:
    """Terms by kind; a term stands in one kind."""

    def __init__(self, kinds: tuple[tuple[str, ...], ...] = IDENTITY) -> None:
        self.kinds = [tuple(t.encode() for t in kind) for kind in kinds]
        self.place = {t: (k, i) for k, kind in enumerate(self.kinds) for i, t in enumerate(kind)}
        if len(self.place) < sum(map(len, self.kinds)):
            raise ValueError("an identity term stands twice")

    def versions(self, words: list[bytes]) -> list[list[bytes]]:
        """The sentence with its terms swapped for each other term of their kind, and without them; none where it has none."""
        named = [w for w in words if w in self.place]
        if not named:
            return []
        out = []
        for step in range(1, max(len(self.kinds[self.place[w][0]]) for w in named)):
            swap = {w: kind[(i + step) % len(kind)] for w in named for k, i in [self.place[w]] for kind in [self.kinds[k]]}
            out.append([swap.get(w, w) for w in words])
        return [*out, [w for w in words if w not in self.place]]

    def mentioned(self, words: list[bytes]) -> list[bytes]:
        """The sentence with a mention of a term, which follows from its words."""
        number = zlib.crc32(b" ".join(words))
        kind = self.kinds[number % len(self.kinds)]
        return [*words, kind[number // len(self.kinds) % len(kind)]]


def changes(text: str | None, identity: Identity, number: dict[str, int]) -> tuple[Counter, int, int]:
    """What the counterfactuals of a text change: (features lost, features gained) with their counts; the
    sentences with terms; those into which a mention was put."""
    sentences = [words for s in _SENTENCE.split(text or "") if (words := word_tokens(s))]
    found: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
    named = 0

    def note(one: list[bytes], other: list[bytes]) -> None:
        a, b = ({number[f] for f in features(words) if f in number} for words in (one, other))
        found[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1

    for words in sentences:
        versions = identity.versions(words)
        named += bool(versions)
        for other in versions:
            note(words, other)
    if named or not sentences or not identity.kinds:
        return found, named, 0
    chosen = min(sentences, key=lambda words: (zlib.crc32(b" ".join(words)), words))
    note(identity.mentioned(chosen), chosen)
    return found, 0, 1


def word_features(word: bytes) -> list[str]:
    text = word.decode("utf-8", "replace")
    return [f"w:{text}", *(f"p:{text[:k]}" for k in _PREFIXES if len(text) > k)]


def features(words: list[bytes]) -> list[str]:
    """The features of a text: each word and prefix with the levels that its count reaches."""
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for f in word_features(word):
            counts[f] += n
    return [f"{level}{f}" for f, n in counts.items() for level in _LEVELS if n >= level]


class Model:
    """Weights by feature; scores texts. Picklable and small: at most ``FEATURES`` weights and the identity terms.

    ``swapped`` counts the labelled sentences whose terms were swapped, ``mentioned`` those that got one.
    """

    def __init__(self, weights: dict[str, float], bias: float, swapped: int = 0, mentioned: int = 0) -> None:
        self.bias, self.swapped, self.mentioned = bias, swapped, mentioned
        self.levels: dict[str, list[tuple[int, float]]] = {}
        for f, w in weights.items():
            self.levels.setdefault(f[1:], []).append((int(f[0]), w))
        self.known: dict[bytes, tuple[str, ...]] = {}

    def logit(self, words: list[bytes]) -> float:
        known, counts = self.known, Counter()
        for word in words:
            mine = known.get(word)
            if mine is None:
                if len(known) > 30_000:
                    known.clear()
                mine = known[word] = tuple(f for f in word_features(word) if f in self.levels)
            if mine:
                counts.update(mine)
        return self.bias + sum(w for f, n in counts.items() for level, w in self.levels[f] if n >= level)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(word_tokens(text)), -50, 50))))


def fit(rows: list[list[int]], changed: list[tuple[list[int], list[int], int]], y: np.ndarray, size: int, weight: float = _COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """(weights, bias) for rows of feature numbers; ``changed`` has the features that counterfactuals lose and gain, with counts."""
    x = np.zeros((len(rows), size), np.float32)
    for i, row in enumerate(rows):
        x[i, row] = 1
    change, share = np.zeros((len(changed), size), np.float32), np.array([n for _, _, n in changed], np.float32)
    for i, (lost, gained, _) in enumerate(changed):
        change[i, lost] = 1
        change[i, gained] = -1
    share *= weight / max(1, share.sum())
    # only these columns ever differ; the penalty's steps are implicit, so that any weight is stable
    used = np.flatnonzero(change.any(axis=0))
    change = change[:, used].astype(float)
    pull = np.linalg.inv(np.eye(len(used)) + _RATE * change.T @ (share[:, None] * change))
    w, b = np.zeros(size, np.float32), np.float32(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    move, move_b = np.zeros_like(w), np.float32(0)
    for _ in range(_STEPS):
        off = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - y
        slope = x.T @ off / len(y) + _RIDGE / len(y) * w
        move, move_b = 0.9 * move - _RATE * slope, 0.9 * move_b - _RATE * off.mean()
        last, w, b = w, w + move, b + move_b
        w[used] = pull @ w[used]
        move = w - last
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, identity: tuple[tuple[str, ...], ...] = IDENTITY, weight: float = _COUNTERFACTUAL) -> Model:
    """Learns ``labels.toxic`` from at most ``rows`` labelled documents outside the held-out fold.

    With no labels, or labels of one class only, the model is a constant: the smoothed share of
    label 1. Null labels and ids are left out; a document with several labels counts as toxic if one
    says so; of several texts with one doc_id one is learned from. Whole texts are read, null ones
    as empty; other columns are ignored, whatever their names. Only counts, the chosen features, the
    sample's feature numbers and what counterfactuals change reach the driver.
    """
    sample = stage(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows), "toxic-sample")
    total, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < total:
        return Model({}, float(np.log((positive + 1) / (total - positive + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for part in text_slices(batches):
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                found[int(y > 0)].update(features(word_tokens(text)))
        names = list(found[0].keys() | found[1].keys())
        if names:
            yield pa.record_batch([pa.array(names), pa.array([found[0][f] for f in names], pa.int64()), pa.array([found[1][f] for f in names], pa.int64())], names=["feature", "n0", "n1"])

    counts = map_arrow(sample, count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    expected = (F.col("n0") + F.col("n1")) * (positive / total)
    gain = (F.col("n1") - expected) * F.abs(F.col("n1") - expected) / expected
    chosen = counts.where(F.col("n0") + F.col("n1") >= LEAST_ROWS).orderBy(gain.desc(), "feature").limit(FEATURES)
    names = [r["feature"] for r in chosen.select("feature").collect()]
    names += sorted({f"1w:{t}" for kind in identity for t in kind} - set(names))
    number, terms = {f: i for i, f in enumerate(names)}, Identity(identity)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            own = [[number[f] for f in features(word_tokens(text)) if f in number] for text in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("y"), pa.array(own, pa.list_(pa.int32()))], names=["y", "own"])

    def changes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in text_slices(batches):
            for text in part.column("text").to_pylist():
                mine, swapped, mentioned = changes(text, terms, number)
                found.update({("change", *key): n for key, n in mine.items()})
                found["swapped", (), ()] += swapped
                found["mentioned", (), ()] += mentioned
        if found:
            keys, kind = list(found), pa.list_(pa.int32())
            yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], kind), pa.array([k[2] for k in keys], kind), pa.array([found[k] for k in keys], pa.int64())], names=["kind", "lost", "gained", "n"])

    got = map_arrow(sample, rows_of, "y int, own array<int>").collect()
    changed = map_arrow(sample, changes_of, "kind string, lost array<int>, gained array<int>, n long").groupBy("kind", "lost", "gained").agg(F.sum("n").alias("n")).collect()
    drop_stage(sample)
    changed, totals = [r for r in changed if r["kind"] == "change"], {r["kind"]: r["n"] for r in changed if r["kind"] != "change"}
    order = sorted((r["lost"], r["gained"], r["n"]) for r in changed if r["lost"] or r["gained"])
    got = sorted((r["y"], r["own"]) for r in got)
    w, b = fit([own for _, own in got], order, np.array([y > 0 for y, _ in got], np.float32), len(names), weight)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, b, totals["swapped"], totals["mentioned"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row: the probability of label 1, of the whole text.

    Null text is empty; empty texts get the bias alone. Repeated rows have equal scores, null ids
    stay, other columns are ignored, and an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array([model.score(t) for t in part.column("text").to_pylist()])], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns under their names, whose score is below ``threshold``.

    Null and empty texts have the bias alone as score; repeated rows are judged alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            yield part.filter(pa.array([model.score(t) < threshold for t in part.column("text").to_pylist()]))

    return map_arrow(docs, run, docs.schema)
