"""Quality by weak supervision: overlapping heuristics, a label model, a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on a text. How often each is right is not known; the
label model finds it by expectation-maximisation over the counts of vote patterns (of which there
are at most 3 to the number of labellers, whatever the size of the table). The posterior of a
pattern is a soft label. A logistic scorer over hashed words, word shapes and measures learns those
labels on a bounded sample and scores every text, also where all labellers abstain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.shared import fold, text_of
from wiretide.llm.text import LOWER, NOT_SPACE, mixed, slices, utf8, word_hashes, words

BAD, NONE, GOOD = -1, 0, 1
#: Texts the scorer is trained on at most, one in each of so many hash slots.
SAMPLE_DOCS = 6000
BUCKETS = 1 << 18
THRESHOLD = 0.4

_KINDS = np.zeros((256, 4), np.int64)
_KINDS[65:91, 0] = 1  # capital
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)], 1] = 1  # letter, or part of one
_KINDS[[*b"#$%&*@^|~<>{}[]\\=+_!"], 2] = 1  # sign
_KINDS[48:58, 3] = 1  # digit
#: A word's shape has one bit for each kind of byte in it.
_SHAPES = np.zeros(256, np.uint8)
for _bit, _bytes in enumerate((range(65, 91), range(97, 123), range(128, 256), range(48, 58), b"#$%&*@^|~<>{}[]\\=+_", b"!?", b".,;:", b"'\"()-/")):
    _SHAPES[[*_bytes]] |= 1 << _bit

MEASURES = ("words", "capitals", "signs", "digits", "word_length", "distinct", "runs", "lines")


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """One row of ``MEASURES`` per text, and its features: buckets and values. Words share a length
    of one; shapes and steps of the measures count besides.

    words: their number; capitals: share of letters; signs, digits: share of bytes; word_length:
    mean; distinct: share of different words; runs: share of words equal to the one before; lines:
    share of bytes in lines that the text holds more than once."""
    rows = len(offsets) - 1
    starts, ends, first = words(data, offsets, NOT_SPACE)
    hashes = word_hashes(LOWER[data], starts, ends)
    shape = np.bitwise_or.reduceat(_SHAPES[data], starts) if len(starts) else np.zeros(0, np.uint8)
    sums = np.zeros((4, len(data) + 1), np.int64)
    for k in range(4):
        np.cumsum(_KINDS[data, k], out=sums[k, 1:])
    kinds = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
    size = np.maximum(np.diff(offsets), 1)
    is_line = np.ones(256, bool)
    is_line[10] = False
    l_starts, l_ends, l_first = words(data, offsets, is_line)
    l_hashes = word_hashes(data, l_starts, l_ends)
    out, buckets = np.zeros((rows, len(MEASURES))), []
    for i in range(rows):
        own = hashes[first[i] : first[i + 1]]
        n = len(own)
        distinct = np.unique(own)
        again = (own[1:] == own[:-1]).mean() if n > 1 else 0.0
        lines, length = l_hashes[l_first[i] : l_first[i + 1]], (l_ends - l_starts)[l_first[i] : l_first[i + 1]]
        _, which, count = np.unique(lines, return_inverse=True, return_counts=True)
        repeated = length[count[which] > 1].sum() / size[i] if len(lines) else 0.0
        out[i] = (n, kinds[0, i] / max(1, kinds[1, i]), kinds[2, i] / size[i], kinds[3, i] / size[i], (ends - starts)[first[i] : first[i + 1]].mean() if n else 0.0, len(distinct) / max(1, n), again, repeated)
        shapes, seen = np.unique(shape[first[i] : first[i + 1]], return_counts=True)
        levels = np.floor(np.log2(1 + 64 * seen / max(1, n))).astype(np.uint64)
        steps = np.floor(np.r_[np.log2(1 + n), 10 * out[i, 1:4], out[i, 4], 10 * out[i, 5:]]).astype(np.uint64)
        marks = np.r_[mixed(shapes.astype(np.uint64) * np.uint64(64) + levels + np.uint64(1 << 40)), mixed(steps * np.uint64(16) + np.arange(len(steps), dtype=np.uint64) + np.uint64(1 << 50))]
        at = (np.r_[distinct, marks] % np.uint64(BUCKETS)).astype(np.int32)
        buckets.append((at, np.r_[np.full(len(distinct), max(1, len(distinct)) ** -0.5), np.full(len(marks), 0.3)].astype(np.float32)))
    return out, buckets


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of the heuristic labellers on rows of measures. Each of the first ones knows one fault
    and else abstains; the last two know what prose looks like, by bytes and by words."""
    n, capitals, signs, digits, length, distinct, runs, lines = m.T
    some, many = n >= 5, n >= 20
    faults = [some & (capitals > 0.3), signs > 0.04, some & (runs > 0.1), many & (distinct < 0.25), lines > 0.3, some & ((length < 2.5) | (length > 14)), (digits > 0.2) | (n < 1)]
    prose = [(capitals < 0.15) & (signs < 0.015) & (digits < 0.15) & (n > 0), (runs < 0.04) & (lines < 0.1) & (length < 12) & (n > 0)]
    return np.stack([np.where(x, BAD, NONE) for x in faults] + [np.where(x, GOOD, NONE) for x in prose], axis=1).astype(np.int8)


LABELLERS = 9


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: the posterior of good for each pattern, and each
    labeller's accuracy where it votes. Labellers are independent given the class; each has its own
    chance of every vote under either class."""
    good = np.where((patterns == BAD).any(axis=1), 0.1, 0.95)  # a start: heuristics rarely object without cause
    for _ in range(rounds):
        prior = np.clip((counts * good).sum() / counts.sum(), 1e-3, 1 - 1e-3)
        logs = np.log(prior / (1 - prior)) * np.ones(len(patterns))
        for k in range(patterns.shape[1]):
            for v in (BAD, NONE, GOOD):
                at = patterns[:, k] == v
                p1 = ((counts * good)[at].sum() + 0.5) / ((counts * good).sum() + 1.5)
                p0 = ((counts * (1 - good))[at].sum() + 0.5) / ((counts * (1 - good)).sum() + 1.5)
                logs[at] += np.log(p1 / p0)
        new = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    right = []
    for k in range(patterns.shape[1]):
        w1, w0 = counts * good * (patterns[:, k] == GOOD), counts * (1 - good) * (patterns[:, k] == BAD)
        right.append((w1.sum() + w0.sum()) / max(1e-9, (counts * (patterns[:, k] != NONE)).sum()))
    return good, np.array(right)


def pattern_code(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 1) @ 3 ** np.arange(v.shape[1])


def train_scorer(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, seed: int = 3) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad; good and bad weigh the same in total. The last
    weight is the bias."""
    rng, w = np.random.default_rng(seed), np.zeros(BUCKETS + 1)
    square = np.full(BUCKETS + 1, 1e-2)
    good, bad = max(1e-3, labels.sum()), max(1e-3, (1 - labels).sum())
    worth = 0.5 * len(labels) * (labels / good + (1 - labels) / bad)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            row = np.repeat(np.arange(len(pick)), [len(features[i][0]) for i in pick])
            flat, value = np.concatenate([features[i][0] for i in pick]), np.concatenate([features[i][1] for i in pick])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat] * value, minlength=len(pick)) + w[-1], -30, 30)))
            error = worth[pick] * (p - labels[pick]) / len(pick)
            grad = np.bincount(np.r_[flat, BUCKETS], np.r_[error[row] * value, error.sum()], minlength=BUCKETS + 1)
            at = np.flatnonzero(grad)
            square[at] += grad[at] ** 2
            w[at] -= 0.1 * (grad[at] / np.sqrt(square[at]) + 1e-4 * w[at])
    return w


def _patterned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for low, high in slices(offsets):
            m, _ = measures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            code, n = np.unique(pattern_code(votes(m)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pattern", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for low, high in slices(offsets):
            m, found = measures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            yield pa.RecordBatch.from_arrays([pa.array(pattern_code(votes(m))), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(2))], ["pattern", "buckets", "parts"])


def _scored(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, posterior = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in slices(offsets):
                m, found = measures(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                v = votes(m)
                raw = np.array([w[at] @ value + w[-1] for at, value in found])
                score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                weak = np.array([posterior.get(int(c), 0.5) for c in pattern_code(v)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array((v != NONE).sum(axis=1).astype(np.int32)), pa.array(weak), pa.array(score), pa.array(score >= THRESHOLD)],
                    ["doc_id", "held_out", "n_votes", "weak_label", "score", "kept"],
                )

    return work


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_votes, weak_label`` (the label model's
    posterior of good), ``score`` (0 to 1) and ``kept`` (score of at least ``THRESHOLD``).

    No given labels are read. Patterns are counted over all texts. The training sample is drawn
    outside the held-out fold, or from all texts if all are in it. NULL and empty texts are scored like any text without words. Repeated
    rows count and are scored each; an empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), (fold(id_col, folds) == held_out).alias("held_out"))
    table = rows.select("text").mapInArrow(_patterned, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    codes, counts = table["pattern"].to_numpy(), table["n"].to_numpy().astype(float)
    posterior: dict[int, float] = {}
    w = np.zeros(BUCKETS + 1)
    if len(codes):
        patterns = (codes[:, None] // 3 ** np.arange(LABELLERS)) % 3 - 1
        good, _ = label_model(patterns, counts)
        posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
        known = rows.where(~F.col("held_out"))
        known = rows if known.isEmpty() else known
        hashed = F.xxhash64(F.lit("quality"), "doc_id", "text")
        slot = F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(SAMPLE_DOCS))
        picked = known.groupBy(slot).agg(F.min(hashed).alias("__pick")).select("__pick")
        sample = known.join(F.broadcast(picked), hashed == F.col("__pick"), "left_semi").dropDuplicates(["doc_id", "text"]).select("text")
        found = sample.mapInArrow(_features, "pattern bigint, buckets binary, parts binary").toArrow().sort_by([("pattern", "ascending"), ("buckets", "ascending"), ("parts", "ascending")])
        features = [(np.frombuffer(f, np.int32), np.frombuffer(v, np.float32)) for f, v in zip(found["buckets"].to_pylist(), found["parts"].to_pylist(), strict=True)]
        w = train_scorer(features, np.array([posterior[c] for c in found["pattern"].to_pylist()]))
    model = docs.sparkSession.sparkContext.broadcast((w, posterior))
    return rows.select("doc_id", "text", "held_out").mapInArrow(_scored(model), "doc_id bigint, held_out boolean, n_votes int, weak_label double, score double, kept boolean")
