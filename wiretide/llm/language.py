"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on windows of a bounded sample of
labelled documents. It labels every byte; the labels' log probabilities are averaged over the whole
text. Texts are cut into pieces of ``PIECE`` bytes that run through the network side by side, so a
step of the recurrence is one matrix product over thousands of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wiretide.llm.shared import fold
from wiretide.llm.text import slices, utf8

#: Labelled documents of each language to learn from, and bytes of the window taken from each.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 400
HIDDEN, PIECE, PAD = 8, 128, 256
STEPS, BATCH, SPAN = 350, 192, 48
UNKNOWN = "und"


class Direction:
    """One gated recurrent layer over byte ids, features first: states are (HIDDEN, sequences).

    Gates and candidates are piecewise linear (clipped to 0..1 and -1..1) instead of logistic and
    hyperbolic: in numpy those two functions would take most of the time.
    """

    def __init__(self, rng: np.random.Generator) -> None:
        self.inputs = rng.normal(0, 0.3, (3 * HIDDEN, PAD + 1)).astype(np.float32)
        self.inputs[:HIDDEN] += 0.3  # update gates start mostly closed, so that states last
        self.inputs[HIDDEN : 2 * HIDDEN] += 0.5
        self.again = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN)).astype(np.float32)

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple:
        x, u = self.inputs[:, ids], self.again @ h
        gates = np.clip(x[: 2 * HIDDEN] + u[: 2 * HIDDEN], 0, 1)
        z, r = gates[:HIDDEN], gates[HIDDEN:]
        c = np.clip(x[2 * HIDDEN :] + r * u[2 * HIDDEN :], -1, 1)
        return h + z * (c - h), (ids, h, z, r, c, u[2 * HIDDEN :])

    def back(self, saved: tuple, dh: np.ndarray, d_inputs: np.ndarray, d_again: np.ndarray) -> np.ndarray:
        ids, h, z, r, c, uc = saved
        dz = dh * (c - h) * ((z > 0) & (z < 1))
        dc = dh * z * (np.abs(c) < 1)
        dr = dc * uc * ((r > 0) & (r < 1))
        du = np.concatenate([dz, dr, dc * r])
        hot = np.zeros((PAD + 1, len(ids)), np.float32)
        hot[ids, np.arange(len(ids))] = 1
        d_inputs += np.concatenate([dz, dr, dc]) @ hot.T
        d_again += du @ h.T
        return dh * (1 - z) + self.again.T @ du


class Network:
    def __init__(self, languages: list[str], seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forth, self.back = Direction(rng), Direction(rng)
        self.out = rng.normal(0, 0.3, (len(languages), 2 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.forth.inputs, self.forth.again, self.back.inputs, self.back.again, self.out, self.bias]

    def gradients(self, ids: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of every position of ``ids`` (steps, sequences), and its gradients."""
        steps, n = ids.shape
        grads = [np.zeros_like(p) for p in self.parameters()]
        states, saved = [], []
        for layer, order in ((self.forth, range(steps)), (self.back, range(steps - 1, -1, -1))):
            h, own, kept = np.zeros((HIDDEN, n), np.float32), [None] * steps, [None] * steps
            for t in order:
                h, kept[t] = layer.step(ids[t], h)
                own[t] = h
            states.append(np.stack(own))
            saved.append(kept)
        both = np.concatenate(states, axis=1)
        logits = self.out @ both + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(p[:, labels, np.arange(n)] + 1e-9).mean()
        p[:, labels, np.arange(n)] -= 1
        p /= steps * n
        grads[4] += np.einsum("tln,thn->lh", p, both)
        grads[5] += p.sum(axis=(0, 2))[:, None]
        d_both = self.out.T @ p
        for i, (layer, order) in enumerate(((self.forth, range(steps - 1, -1, -1)), (self.back, range(steps)))):
            dh = np.zeros((HIDDEN, n), np.float32)
            for t in order:
                dh = layer.back(saved[i][t], dh + d_both[t, i * HIDDEN : (i + 1) * HIDDEN], grads[2 * i], grads[2 * i + 1])
        return float(loss), grads

    def train(self, samples: list[list[bytes]], seed: int = 16, rate: float = 0.02) -> None:
        """Adam over balanced random windows of the samples of each language."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        joined = [np.frombuffer(b" ".join(s).ljust(SPAN + 1), np.uint8) for s in samples]
        for step in range(1, STEPS + 1):
            labels = rng.integers(0, len(samples), BATCH)
            ids = np.empty((SPAN, BATCH), np.int64)
            for i, k in enumerate(labels):
                at = rng.integers(0, len(joined[k]) - SPAN)
                ids[:, i] = joined[k][at : at + SPAN]
            _, grads = self.gradients(ids, labels)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 2 * (1 - step / (STEPS + 1)))
            for p, g, a, b in zip(self.parameters(), grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)

    def position_scores(self, ids: np.ndarray) -> np.ndarray:
        """Log probabilities (steps, languages, sequences) of each position; padding gives garbage."""
        steps, n = ids.shape
        scores = np.empty((steps, len(self.languages), n), np.float32)
        for layer, order, out in ((self.forth, range(steps), self.out[:, :HIDDEN]), (self.back, range(steps - 1, -1, -1), self.out[:, HIDDEN:])):
            h, table = np.zeros((HIDDEN, n), np.float32), np.ascontiguousarray(layer.inputs.T)
            for t in order:
                x, u = np.ascontiguousarray(table.take(ids[t], axis=0).T), layer.again @ h
                gates = x[: 2 * HIDDEN]
                gates += u[: 2 * HIDDEN]
                np.clip(gates, 0, 1, out=gates)
                c = x[2 * HIDDEN :]
                u[2 * HIDDEN :] *= gates[HIDDEN:]
                c += u[2 * HIDDEN :]
                np.clip(c, -1, 1, out=c)
                c -= h
                c *= gates[:HIDDEN]
                h += c
                if layer is self.forth:
                    np.matmul(out, h, out=scores[t])
                else:
                    scores[t] += out @ h
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def pool(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Mean log probability of each language for each row; ``labels`` gets every byte's language."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        row = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][row] + nth * PIECE
        length = np.minimum(PIECE, offsets[1:][row] - start)
        at = start[None, :] + np.arange(PIECE)[:, None]
        real = np.arange(PIECE)[:, None] < length[None, :]
        ids = np.where(real, data[np.minimum(at, max(0, len(data) - 1))], PAD) if len(row) else np.zeros((PIECE, 0), np.int64)
        scores = self.position_scores(ids)
        scores *= real[:, None, :]
        total = np.zeros((len(sizes), len(self.languages)))
        np.add.at(total, row, scores.sum(axis=0).T)
        if labels is not None:
            labels[at[real]] = scores.argmax(axis=1)[real]
        return total / np.maximum(sizes, 1)[:, None]


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> Network | None:
    """A network trained on rows with a language and a letter, whose fold is not ``held_out``.

    Each language gives at most ``SAMPLE_DOCS`` rows, the one of the smallest hash in each of so many
    hash slots, and of each a window of ``SAMPLE_CHARS`` characters at a hashed place.
    """
    hashed = F.xxhash64(F.lit("sample"), id_col)
    room = F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(1))
    window = F.substring(F.col(text_col), (F.pmod(hashed, room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = docs.where(F.col(lang_col).isNotNull() & (fold(id_col, folds) != held_out) & F.col(text_col).rlike(r"\p{L}"))
    picked = (
        rows.select(F.col(lang_col).cast("string").alias("language"), F.pmod(F.xxhash64(F.lit("slot"), id_col), F.lit(SAMPLE_DOCS)).alias("slot"), F.struct(hashed.alias("h"), window.alias("w")).alias("pick"))
        .groupBy("language", "slot")
        .agg(F.min("pick").alias("pick"))
        .select("language", "pick.w", "pick.h")
        .collect()
    )
    languages = sorted({r["language"] for r in picked})
    if not languages:
        return None
    network = Network(languages)
    network.train([[r["w"].encode() for r in sorted(picked, key=lambda r: (r["h"], r["w"])) if r["language"] == k] for k in languages])
    return network


def _labelled(model, text_at: int, letter_at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            letter = batch.column(letter_at).to_numpy(zero_copy_only=False).astype(bool)
            for low, high in slices(offsets):
                mean = network.pool(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                best = p.argmax(axis=1)
                score = np.where(letter[low:high], 1 / p.sum(axis=1), 0.0)
                names = [network.languages[k] if ok else UNKNOWN for k, ok in zip(best, letter[low:high], strict=True)]
                own = batch.slice(low, high - low)
                keep = [c for i, c in enumerate(own.columns) if i != letter_at]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(names), pa.array(score)], [n for n in own.schema.names if n != "__letter"] + ["__lang", "__score"])

    return work


def identify(docs: DataFrame, network: Network | None = None, text_col: str = "text", **columns) -> DataFrame:
    """``docs`` with ``__lang`` and ``__score`` (0 to 1) added; without a ``network`` one is learned
    from ``docs`` first.

    NULL texts and texts without a letter are ``und`` with score 0, and so is every row if there is
    nothing to learn from. The whole text counts, however long. Repeated rows get equal answers;
    an empty table gives no rows. Other columns stay as they are.
    """
    network = network or learned(docs, text_col=text_col, **columns)
    if network is None:
        return docs.withColumns({"__lang": F.lit(UNKNOWN), "__score": F.lit(0.0)})
    marked = docs.withColumn("__letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(network)
    return marked.mapInArrow(_labelled(model, docs.columns.index(text_col), len(docs.columns)), schema)


def of_a_language(docs: DataFrame, network: Network | None, text_col: str = "text", least: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are text of a language the ``network`` knows, their columns as they
    were. Rejected are NULL texts, texts without a letter, and those whose pooled probability of the
    best language is no more than ``least`` above chance: bytes that fit no language better than
    another, over the whole text. Without a network, or with one language, only the first two."""
    if network is None or len(network.languages) < 2:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    found = identify(docs, network, text_col)
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") > 1 / len(network.languages) + least)).select(*docs.columns)


def spans(network: Network, text: str) -> list[tuple[int, int, str]]:
    """Runs of bytes with one label, as (begin, end, language)."""
    data = np.frombuffer(text.encode(), np.uint8)
    labels = np.zeros(len(data), np.int64)
    network.pool(data, np.array([0, len(data)]), labels)
    edges = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True]) if len(labels) else np.zeros(1, np.int64)
    return [(int(a), int(b), network.languages[labels[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def language_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score``; learned from the rest."""
    network = learned(docs)
    found = identify(docs.select("doc_id", "text"), network) if network else docs.withColumns({"__lang": F.lit(UNKNOWN), "__score": F.lit(0.0)})
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
