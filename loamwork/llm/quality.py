"""Quality: a linear-chain CRF labels each line good or bad; its marginals make a document's score.

Emissions see a line's own features and those of its neighbours; transitions see which labels
follow each other. Only documents are labelled, so the lines' labels are found first: lines learn
their document's label from their own features alone; then each line gets the label that those and
its document make likelier, at least one line that of the document. The chain learns from those, so its
transitions see where good and bad lines meet. A document's share of good text is the mean of the
forward-backward marginals, weighted by line length; a logistic calibration on the training
documents turns it into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import drop_stage, labelled_sample, map_arrow, stage, text_slices

#: Bounds of the sample that is learned from, not of what is scored: labelled rows, and lines of
#: them all; rows are taken whole, in the order of their hashes, while the lines allow it.
SAMPLE_ROWS, SAMPLE_LINES = 4000, 500_000
#: How likely a line is good in a good and in a bad document, before its features are seen.
PRIORS = (0.5, 0.97)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_STEPS, _RATE, _RIDGE = 150, 0.05, 1e-3

_CLASSES = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    if _i >= 0xC0:
        _CLASSES[_i] = 1  # the first byte of a character beyond ASCII counts as a letter
    elif _i >= 0x80:
        _CLASSES[_i] = 2  # later bytes
    elif _c.islower():
        _CLASSES[_i] = 1
    elif _c.isupper():
        _CLASSES[_i] = 3
    elif _c.isdigit():
        _CLASSES[_i] = 4
    elif _c in " \t\r\x0b\x0c":
        _CLASSES[_i] = 5
    elif _c in ".,;:":
        _CLASSES[_i] = 6
    elif _c in "!?":
        _CLASSES[_i] = 7
    elif _c in "|<>{}[]":
        _CLASSES[_i] = 8
    elif _c in "#$%&*@^~=+_\\/`":
        _CLASSES[_i] = 9
    elif _c == "\n":
        _CLASSES[_i] = 11
    else:
        _CLASSES[_i] = 10
_N = 12
#: Edges of the bins of each measure of a line.
_BINS = (
    (0.001, 0.01, 0.03, 0.08, 0.2),  # symbols a character
    (0.001, 0.01, 0.03, 0.08),  # bars and brackets a character
    (0.001, 0.01, 0.03, 0.08),  # exclamation and question marks a character
    (0.02, 0.05, 0.15, 0.4, 0.8),  # capitals a letter
    (0.001, 0.02, 0.08, 0.3),  # digits a character
    (0.005, 0.02, 0.04, 0.08),  # full stops and commas a character
    (0.02, 0.1, 0.14, 0.18, 0.25),  # spaces a character
    (0.1, 0.25, 0.5, 0.75),  # repeated words a word
    (0.01, 0.05, 0.15, 0.4),  # words equal to the one before
    (3.5, 0.001 + 5, 7, 10),  # letters a word
    (1, 20, 80, 200, 600),  # characters
    (0.5,),  # seen before in the document
)
_WIDTHS = np.array([len(b) + 1 for b in _BINS])
_STARTS = np.concatenate(([0], np.cumsum(_WIDTHS)[:-1]))
_OWN = int(_WIDTHS.sum())
#: Measures that neighbours show as well: symbols, bars, marks, capitals, repeats.
_NEAR = (0, 1, 2, 3, 7, 8, 11)
_NEAR_SIZE = int(_WIDTHS[list(_NEAR)].sum())
_NEAR_STARTS = np.concatenate(([0], np.cumsum(_WIDTHS[list(_NEAR)])[:-1]))
#: Own features, those of the line before and after, and two for the first and the last line.
SIZE = _OWN + 2 * _NEAR_SIZE + 2


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, characters of each line, feature numbers of each line). An empty text is one empty line."""
    datas = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(datas) + b"\n"
    kinds = _CLASSES[np.frombuffer(joined, np.uint8)]
    breaks = np.flatnonzero(kinds == 11)
    line = np.zeros(len(kinds), np.int64)
    line[breaks[:-1] + 1] = 1
    line = np.cumsum(line)
    n = len(breaks)
    counts = np.bincount(line * _N + kinds, minlength=n * _N).reshape(n, _N).astype(float)
    chars = counts[:, :11].sum(axis=1) - counts[:, 2]
    size, letters = np.maximum(chars, 1), counts[:, 1] + counts[:, 3]
    per = np.array([d.count(b"\n") + 1 for d in datas], np.int64)
    words = np.zeros(n)
    repeated, doubled, seen = np.zeros(n), np.zeros(n), np.zeros(n)
    i = 0
    for data in datas:
        known: set[bytes] = set()
        for text in data.split(b"\n"):
            ws = text.split()
            words[i] = len(ws)
            if len(ws) > 3:
                repeated[i] = 1 - len(set(ws)) / len(ws)
                doubled[i] = sum(map(bytes.__eq__, ws, ws[1:])) / len(ws)
            if len(text) > 20:
                seen[i] = text in known
                known.add(text)
            i += 1
    measures = (
        counts[:, 9] / size, counts[:, 8] / size, counts[:, 7] / size, counts[:, 3] / np.maximum(letters, 1), counts[:, 4] / size, counts[:, 6] / size,
        counts[:, 5] / size, repeated, doubled, letters / np.maximum(words, 1), chars, seen,
    )
    bins = np.stack([np.searchsorted(b, m, side="right") for b, m in zip(_BINS, measures, strict=True)], axis=1)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    last[np.cumsum(per) - 1] = True
    first[np.cumsum(per) - per] = True
    near = bins[:, _NEAR] + _NEAR_STARTS
    before = np.where(first[:, None], -1, np.roll(near, 1, axis=0) + _OWN)
    after = np.where(last[:, None], -1, np.roll(near, -1, axis=0) + _OWN + _NEAR_SIZE)
    edges = np.stack((np.where(first, SIZE - 2, -1), np.where(last, SIZE - 1, -1)), axis=1)
    return per, chars, np.concatenate((bins + _STARTS, before, after, edges), axis=1)


def chain(per: np.ndarray, emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal P(good) of each line, expected transitions (2, 2) and log partition, summed over documents.

    ``emissions`` is the score of good minus bad of each line. Documents advance side by side, the
    longest first, so a step is a few array operations over those that still have lines.
    """
    order = np.argsort(-per, kind="stable")
    starts, lengths = (np.cumsum(per) - per)[order], per[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]
    forward, backward = np.zeros((len(emissions), 2)), np.zeros((len(emissions), 2))
    state = None
    for t in range(longest):
        at = starts[: alive[t]] + t
        own = np.stack((np.zeros(len(at)), emissions[at]), axis=1)
        if t:
            prev = state[: alive[t]]
            own += np.logaddexp(prev[:, :1] + transitions[0], prev[:, 1:] + transitions[1])
        state = forward[at] = own
    ends = (np.cumsum(per) - 1)[order]
    z = np.logaddexp(forward[ends, 0], forward[ends, 1])
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        after = backward[at + 1] + np.stack((np.zeros(len(at)), emissions[at + 1]), axis=1)
        backward[at] = np.logaddexp(after[:, :1] + transitions[:, 0], after[:, 1:] + transitions[:, 1])
    both = forward + backward
    marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    expected = np.zeros((2, 2))
    inner = np.ones(len(emissions), bool)
    inner[np.cumsum(per) - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        norm = np.logaddexp(both[at, 0], both[at, 1])
        for i in range(2):
            for j in range(2):
                score = forward[at, i] + transitions[i, j] + (emissions[at + 1] if j else 0) + backward[at + 1, j]
                expected[i, j] = np.exp(np.minimum(score - norm, 0)).sum()
    return marginal, expected, float(z.sum())


class Model:
    """Weights of the CRF and of the calibration; scores texts."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, slope: float, shift: float) -> None:
        self.weights, self.transitions, self.slope, self.shift = weights, transitions, slope, shift

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        # number -1 stands for no feature and meets the zero at the end
        return np.append(self.weights, 0.0)[numbers].sum(axis=1)

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines of each text, characters, P(good) of each line)."""
        per, chars, numbers = line_features(texts)
        return per, chars, chain(per, self.emissions(numbers), self.transitions)[0]

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the marginals of each text."""
        per, chars, good = self.lines(texts)
        begin, weight = np.cumsum(per) - per, np.maximum(chars, 1)
        return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _calibrated(self.shares(texts), self.slope, self.shift) if texts else np.zeros(0)


def _calibrated(share: np.ndarray, slope: float, shift: float) -> np.ndarray:
    clipped = np.clip(share, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(slope * np.log(clipped / (1 - clipped)) + shift)))


def line_labels_of(per: np.ndarray, emissions: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels (0 or 1) of lines in documents of label ``y``, from scores that lines got by those labels.

    The scores hold the share of good lines, as they were fitted to it, so the document's prior takes
    its place. In each document the line that fits its label best has it.
    """
    of = np.repeat(np.arange(len(per)), per)
    logit = lambda p: np.log(p / (1 - p))
    base = np.clip(np.repeat(y, per).mean(), 0.01, 0.99)
    out = (emissions - logit(base) + np.where(y[of] > 0, logit(PRIORS[1]), logit(PRIORS[0])) > 0).astype(float)
    towards = np.where(y[of] > 0, emissions, -emissions)
    order = np.lexsort((-towards, of))
    best = order[np.cumsum(per) - per]
    out[best] = y
    return out


def _ascend(model: Model, per: np.ndarray, numbers: np.ndarray, labels: np.ndarray, steps: int, moves: bool) -> None:
    """Steps of Adam up the likelihood of line labels, with a ridge; ``moves``: transitions too."""
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(per) - 1] = False
    same = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    np.add.at(observed, (labels[same].astype(int), labels[same + 1].astype(int)), 1)
    moment, square = np.zeros(SIZE + 4), np.zeros(SIZE + 4)
    flat = numbers.ravel()
    used = flat >= 0
    for step in range(1, steps + 1):
        emissions = model.emissions(numbers)
        if moves:
            marginal, expected, _ = chain(per, emissions, model.transitions)
        else:
            marginal, expected = 1 / (1 + np.exp(-np.clip(emissions, -60, 60))), observed
        off = np.repeat(labels - marginal, numbers.shape[1])
        slope = np.bincount(flat[used], weights=off[used], minlength=SIZE)
        g = np.concatenate((slope, (observed - expected).ravel())) / len(labels)
        g -= _RIDGE * np.concatenate((model.weights, model.transitions.ravel()))
        moment = 0.9 * moment + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        move = _RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights + move[:SIZE]
        if moves:
            model.transitions = model.transitions + move[SIZE:].reshape(2, 2)


def fit(per: np.ndarray, chars: np.ndarray, numbers: np.ndarray, y: np.ndarray) -> Model:
    """The model of texts with ``per`` lines each, their ``line_features``, and a label 0 or 1 for each text."""
    model = Model(np.zeros(SIZE), np.zeros((2, 2)), 1.0, 0.0)
    own = numbers[:, : len(_BINS)]
    _ascend(model, per, own, np.repeat(y, per).astype(float), _STEPS, moves=False)
    found = line_labels_of(per, model.emissions(own), y)
    model.weights = np.zeros(SIZE)
    _ascend(model, per, numbers, found, _STEPS, moves=True)
    begin, weight = np.cumsum(per) - per, np.maximum(chars, 1)
    good = chain(per, model.emissions(numbers), model.transitions)[0]
    share = np.clip(np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin), 1e-6, 1 - 1e-6)
    x, slope, shift = np.log(share / (1 - share)), 0.1, 0.0
    for _ in range(50):  # Newton's method for two parameters, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        r, v = y - p, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, np.array([(r * x).sum() - slope, r.sum() - 1e-3 * shift]))
        slope, shift = slope + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
    model.slope, model.shift = slope, shift
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES) -> Model:
    """Learns ``labels.quality`` from at most ``rows`` labelled documents outside the held-out fold.

    Features are made from whole texts in the executors; 28 bytes a line reach the driver. Rows that
    would bring the sample above ``lines`` are left out whole. With no labels, or labels of one class
    only, every score is the smoothed share of label 1. Null labels and ids are left out; of several
    texts with one doc_id one is learned from; null texts are empty; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=1 << 20):
            per, chars, numbers = line_features(part.column("text").to_pylist())
            ends = np.cumsum(per)
            cut = lambda x: [x[a:b].tobytes() for a, b in zip((ends - per).tolist(), ends.tolist(), strict=True)]  # noqa: B023, E731
            yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array(per), pa.array(cut(chars.astype("<i4")), pa.binary()), pa.array(cut(numbers.astype(np.uint8)), pa.binary())], names=["doc_id", "y", "lines", "chars", "numbers"])

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows).withColumn("doc_id", F.col("doc_id").cast("long"))
    made = stage(map_arrow(sample, run, "doc_id long, y int, lines long, chars binary, numbers binary"), "quality-lines")
    order = made.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lines").orderBy("h", "doc_id").collect()
    known = [r["doc_id"] for r, total in zip(order, accumulate(r["lines"] for r in order), strict=True) if total <= lines]
    # at most ``rows`` ids
    got = made.where(F.col("doc_id").isin(known)).orderBy("doc_id").select("y", "chars", "numbers").collect() if known else []
    drop_stage(made)
    y = np.array([r["y"] > 0 for r in got], float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SIZE), np.zeros((2, 2)), 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    chars = np.frombuffer(b"".join(r["chars"] for r in got), "<i4").astype(float)
    numbers = np.frombuffer(b"".join(r["numbers"] for r in got), np.uint8).reshape(len(chars), -1).astype(np.int16)
    numbers[numbers == 255] = -1
    return fit(np.array([len(r["chars"]) // 4 for r in got], np.int64), chars, numbers, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, good_share) of each row, of the whole text.

    Null text is empty; an empty text is one empty line. Repeated rows have equal scores, null ids
    stay, other columns are ignored, whatever their names, and an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=1 << 20):
            share = model.shares(part.column("text").to_pylist())
            yield pa.record_batch([part.column("doc_id"), pa.array(_calibrated(share, model.slope, model.shift)), pa.array(share)], names=["doc_id", "score", "good_share"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, good_share double")


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, chars, good) of each line of each row: its marginal probability of being good. As ``score`` for odd rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, budget=1 << 20):
            per, chars, good = model.lines(part.column("text").to_pylist())
            rows = np.repeat(np.arange(len(per)), per)
            number = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
            yield pa.record_batch([part.column("doc_id").take(pa.array(rows)), pa.array(number), pa.array(chars.astype(np.int64)), pa.array(good)], names=["doc_id", "line", "chars", "good"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, line long, chars long, good double")
