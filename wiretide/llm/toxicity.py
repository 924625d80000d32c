"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding maps look-alike letters, accents, digits and signs that stand for letters onto one small
alphabet, and everything that is not a letter or digit onto a space. The lexicon is learned: word
beginnings and whole words that labelled toxic documents hold and clean ones do not, weighted by
their log odds. A match inside an exception phrase does not count. Weights are summed, related to
the number of words, and turned into a probability by a logistic fit on the same labelled documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wiretide.llm.near_dedup import shingles
from wiretide.llm.shared import fold
from wiretide.llm.text import mixed, utf8

#: Labelled documents to learn from at most, those of the smallest hashes.
SAMPLE_DOCS = 12_000
#: Toxic documents that a lexicon entry needs, its least toxic share, and its least evidence: the log
#: likelihood (nats) by which its own toxic share explains its documents better than the overall one.
LEAST_DOCS, LEAST_SHARE, LEAST_EVIDENCE = 4, 0.7, 9.0
SHORTEST, LONGEST = 4, 8
THRESHOLD = 0.7
#: MinHash samples by which copies among the labelled documents are told.
KEYS = 4
#: Harmless phrases around words of a lexicon.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "pond scum", "garbage can", "killer whale")

# Characters that are read as a letter.
LOOK_ALIKE = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "є": "e", "ε": "e", "ɡ": "g", "һ": "h", "н": "h",
    "і": "i", "ı": "i", "ι": "i", "ӏ": "i", "ј": "j", "к": "k", "κ": "k", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p",
    "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ᴢ": "z",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "i", "đ": "d",
}
# Digits and signs that are read as a letter; l and i are one letter here.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
INSIDE = re.compile(r"[@$!|+€](?=\w)")


class _Table(dict):
    """Translation of one character, worked out when it is first seen."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = LOOK_ALIKE.get(char)
        if plain is None:
            base = unicodedata.normalize("NFKD", char).lower()
            base = "".join(c for c in base if not unicodedata.combining(c))
            plain = "".join(LOOK_ALIKE.get(c, c) for c in base)
            if unicodedata.category(char) in ("Cf", "Mn", "Me"):
                plain = ""
            elif not plain.isalnum():
                plain = " "
        self[code] = "".join(STANDS_FOR.get(c, c) for c in plain)
        return self[code]


TABLE = _Table()


def folded(text: str) -> str:
    """The text over the folded alphabet, with a space before and after."""
    text = text.lower()
    if not text.isascii() or any(c in text for c in "@$!|+"):
        text = INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(TABLE)} "


def grams(word: str) -> list[str]:
    """Beginnings of a word, each with a space before it, and the whole word with one after it too."""
    return [" " + word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            key = " " + " ".join(folded(phrase).split()) + " "
            machine.add_word(key, (len(key), None))
        for key, weight in self.weights.items():
            machine.add_word(key, (len(key), weight))
        machine.make_automaton()
        return machine


def matched(machine: ahocorasick.Automaton, text: str) -> tuple[int, float]:
    """Number of words of a text and the summed weights of its matches; a word counts once, with its
    heaviest entry."""
    text = folded(text)
    if not len(machine):
        return len(text.split()), 0.0
    hits, spared = {}, []
    for end, (length, weight) in machine.iter(text):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    total = sum(w for at, w in hits.items() if not any(a <= at < b for a, b in spared))
    return len(text.split()), total


def features(n_words: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum of weights and weights per hundred words, on a log scale."""
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(n_words, 1))], axis=1)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; classes weigh the same, slopes stay above zero."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.array([-2.0, 0.5, 0.5])
    penalty = ridge * np.array([0.01, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w[1:] = np.maximum(w[1:], 0.05)
    return tuple(float(v) for v in w)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: gram -> number of distinct toxic and clean texts with it."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {g for word in set(folded(text or "").split()) if len(word) >= SHORTEST for g in grams(word)}
            (toxic if label else clean).update(found)
    keys = list(toxic | clean)
    yield pa.RecordBatch.from_pydict({"gram": keys, "toxic": pa.array([toxic[k] for k in keys], pa.int64()), "clean": pa.array([clean[k] for k in keys], pa.int64())})


def evidence(toxic: int, clean: int, share: float) -> float:
    own = toxic / (toxic + clean)
    return toxic * np.log(own / share) + (clean * np.log((1 - own) / (1 - share)) if clean else 0.0)


def chosen(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Lexicon entries of ``gram -> (toxic, clean)``: the longest beginning that still covers (nearly)
    all of what its shorter ones cover."""
    odds = {g: np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) for g, (t, c) in counts.items()}
    share = n_toxic / max(1, n_toxic + n_clean)
    good = {g for g, (t, c) in counts.items() if t >= LEAST_DOCS and t >= LEAST_SHARE * (t + c) and evidence(t, c, share) >= LEAST_EVIDENCE}
    longer: dict[str, list[str]] = {}
    for g in good:
        stem = g[:-1] if not g.endswith(" ") else g[: min(len(g) - 1, LONGEST + 1)]
        longer.setdefault(stem, []).append(g)
    out: dict[str, float] = {}
    todo = [g for g in good if (g[:-1] if not g.endswith(" ") else g[: min(len(g) - 1, LONGEST + 1)]) not in good]
    while todo:
        g = todo.pop()
        most = max((counts[x][0] for x in longer.get(g, ()) if x != g), default=0)
        if most >= 0.9 * counts[g][0]:
            todo += [x for x in longer[g] if x != g]
        else:
            out[g] = float(odds[g])
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, at = shingles(*utf8(batch.column(0)), 5)
        some = np.flatnonzero(np.diff(at))
        keys = np.zeros((batch.num_rows, KEYS), np.int64)
        for k in range(KEYS if len(some) else 0):
            keys[some, k] = np.minimum.reduceat(mixed(values + np.uint64(k)), at[some]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], ["text", "label", "keys"])


def _unlike(rows: DataFrame) -> DataFrame:
    """``rows (text, label)`` with one of each set of copies or near copies: rows that agree in one
    of ``KEYS`` MinHash samples are taken for copies. Else a copied text would count as evidence
    again and again."""
    left = rows.mapInArrow(_keyed, "text string, label int, keys array<bigint>")
    for k in range(KEYS):
        pick = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label", "keys"))
        left = left.groupBy(F.col("keys")[k]).agg(pick.alias("one")).select("one.text", "one.label", "one.keys")
    return left.select("text", "label")


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1) -> Lexicon:
    """A lexicon and its logistic fit, from labelled documents whose fold is not ``held_out``."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("__label"))
        .orderBy(F.xxhash64(F.lit("toxicity"), "__id"), "__id")
        .limit(SAMPLE_DOCS)
    )
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(known), "__id")
    texts = _unlike(rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("__label").alias("label"))).cache()
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    grams_of = texts.mapInArrow(_counted, "gram string, toxic bigint, clean bigint").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = {r["gram"]: (r["toxic"], r["clean"]) for r in grams_of.where((F.col("toxic") >= LEAST_DOCS) & (F.col("clean") * 4 <= F.col("toxic"))).collect()}
    lexicon = Lexicon(chosen(counts, n.get(1, 0), n.get(0, 0)))
    facts = texts.mapInArrow(_measured(lexicon), "n bigint, total double, label int").toPandas()
    texts.unpersist()
    if facts["label"].nunique() == 2:
        lexicon.coefficients = fitted(features(facts["n"].to_numpy(), facts["total"].to_numpy()), facts["label"].to_numpy())
    return lexicon


def _measured(lexicon: Lexicon):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            found = [matched(machine, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([a for a, _ in found], pa.int64()), "total": pa.array([b for _, b in found], pa.float64()), "label": batch.column(1).cast(pa.int32())})

    return work


def _scored(lexicon: Lexicon, text_at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, w = lexicon.automaton(), np.array(lexicon.coefficients)
        for batch in batches:
            found = np.array([matched(machine, t.as_py() or "") for t in batch.column(text_at)], np.float64).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(features(found[:, 0], found[:, 1]) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "__score", "__toxic"])

    return work


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score`` (0 to 1) and ``__toxic`` (1 from ``THRESHOLD`` on) added.

    NULL and empty texts match nothing and get the score of a text without matches. Texts are
    scored whole and alike wherever they stand; other columns, of any name, stay as they are; an
    empty table gives no rows. An empty lexicon matches nothing.
    """
    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType()), StructField("__toxic", IntegerType())])
    return docs.mapInArrow(_scored(lexicon, docs.columns.index(text_col)), schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``. Labels of held-out ids
    are not read; ids with several labels are toxic if one says so."""
    found = score_toxicity(docs.select("doc_id", "text"), learned(docs, labels))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("__score").alias("score"), F.col("__toxic").alias("predicted"))
