"""Periodic runs of words, found by a sparse diagonal DP that reads a text once.

Position i and an earlier occurrence j of what stands at i lie on the diagonal of lag i - j. While a
lag matches from word to word its match length grows; when the diagonal ends, lag plus match length
is a maximal stretch with that period, and it is a run at once if it is long enough.

What keeps the DP sparse, and still exact: a run of period p has at least ``(periods - 1) * p``
matches on its diagonal, and at least as many as the shortest run allows, 16 for 24 words and three
periods. So an occurrence counts only if a whole *block* of words before it agrees. Blocks have 16,
32, 64, ... words; each position looks at the nearest earlier occurrence of its block, and a block
of w words answers for the periods above w / 2 up to w (the shortest one for all below). Within a
run of smallest period p the nearest occurrence of a block of w >= p words is exactly p back (a
nearer one would give a smaller period, by the theorem of Fine and Wilf), and between p and 2p there
is always a power of two. A position thus extends at most one diagonal a block size, n log n in all
even where one word fills the text; and the smallest period needs no separate test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretide.llm.text import NOT_SPACE, STEP, mixed, slices, utf8, words

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes and only for those."""
    if not len(starts):
        return np.zeros(0, np.int64)
    reach = np.r_[0, np.cumsum(ends - starts)]
    body = pa.py_buffer(np.ascontiguousarray(data[NOT_SPACE[data]]))
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(reach.astype(np.int64)), body])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _earlier(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each name the place of its nearest earlier occurrence (-1: none), and whether it occurs
    more than once."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    before = np.full(len(names), -1)
    before[order[1:][same]] = order[:-1][same]
    again = np.zeros(len(names), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return before, again


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = 24, periods: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (within it), length and period of every run of the word numbers ``ids``,
    sorted. ``first`` says where documents begin (one more than there are)."""
    if periods < 3 or least < 2:
        raise ValueError("runs need three periods and two words at least")
    block = 1 << max(0, (-(-least * (periods - 1) // periods)).bit_length() - 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(ids)) - first[doc]
    names = mixed(ids.astype(np.uint64) * STEP + mixed(doc.astype(np.uint64)))
    width = 1
    while width < block:
        names[width:] = mixed(names[:-width] * STEP + names[width:]) if len(names) > width else names[width:]
        width *= 2
    at, found = np.flatnonzero(place >= width - 1), []
    while len(at):
        before, again = _earlier(names[at])
        lag = np.where(before >= 0, at - at[before], 0)
        active = (lag > 0) & (lag <= width) & ((lag > width // 2) | (width == block))
        # a diagonal goes on where the next word has the same lag; else it ends and emits
        goes_on = np.zeros(len(at), bool)
        goes_on[1:] = active[1:] & active[:-1] & (lag[1:] == lag[:-1]) & (at[1:] == at[:-1] + 1)
        begin = np.flatnonzero(active & ~goes_on)
        end = np.flatnonzero(active & ~np.r_[goes_on[1:], False])
        matches = at[end] - at[begin] + width
        length, period = matches + lag[begin], lag[begin]
        emit = length >= np.maximum(least, periods * period)
        found.append(np.stack([at[end] - length + 1, length, period])[:, emit])
        twice = np.zeros(len(ids), bool)
        twice[at[again]] = True
        at = at[again]
        at = at[(place[at] >= 2 * width - 1)]
        at = at[twice[at - width]]
        names[at] = mixed(names[at - width] * STEP + names[at])
        width *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    real = _repeats(ids, start, length, period)
    start, length, period = start[real], length[real], period[real]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return doc[start], place[start], length, period


def _repeats(ids: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each stretch has its period, word by word: blocks were compared by hashes."""
    ok = np.ones(len(start), bool)
    for k, (s, n, p) in enumerate(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)):
        ok[k] = np.array_equal(ids[s : s + n - p], ids[s + p : s + n])
    return ok


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """The words of each document with one space between them."""
    size = ends - starts + 1
    reach = np.cumsum(size)
    index = np.repeat(starts - (reach - size), size) + np.arange(reach[-1] if len(reach) else 0)
    out = np.r_[data, np.uint8(0)][index]
    out[reach - 1] = 32
    last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(0, np.int64)
    keep = np.ones(len(out), bool)
    keep[reach[last] - 1] = False
    n = np.bincount(doc, size, minlength=docs).astype(np.int64)
    n[doc[last]] -= 1
    offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
    return pa.StringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out[keep])))


def _searched(least: int, periods: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in slices(offsets):
                part = data[offsets[low] : offsets[high]]
                starts, ends, first = words(part, offsets[low : high + 1] - offsets[low], NOT_SPACE)
                doc, start, length, period = find_runs(word_ids(part, starts, ends), first, least, periods)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[doc] + start + period, 1)
                np.add.at(edge, first[doc] + start + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                owner = np.repeat(np.arange(high - low), np.diff(first))
                runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(_RUN))
                at = np.r_[0, np.cumsum(np.bincount(doc, minlength=high - low))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(at), runs),
                        _joined(part, starts[kept], ends[kept], owner[kept], high - low),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return work


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, periods: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id (as ``id``), ``n_words``, ``runs`` (start, length and
    period of each, by start and period, words counted from 0) and the ``collapsed`` text: words
    joined by one space, each run cut to its first period.

    Words are runs of anything but the space and 0x09-0x0D. A run is a maximal stretch with smallest
    period p and at least ``least`` words and ``periods`` periods; runs may overlap, and a word goes
    if any run repeats it. NULL and empty texts have no words, no runs and collapse to the empty
    text. Repeated rows and NULL ids stay rows of their own. Further columns are not read. An empty
    table gives no rows. Every text is read whole in one task, whose memory follows the longest.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_searched(least, periods), f"id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: smallest start, then period."""

    def before(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        first = (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        return F.when(first, -1).otherwise(1)

    return F.get(F.array_sort(runs, before), 0)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col`` of ``docs``, where every tenth document (by crc32 of its id) goes
    on with a repeated stretch of its own words: a known share of runs of all periods for an audit.
    A NULL id has no crc32 and its text stays."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    split = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col)).withColumn("__w", F.when(h % 10 == 0, split))
    n = F.size("__w")
    start = F.pmod(g, n).cast("int")
    rows = rows.withColumns({"__n": n, "__a": F.when(n > 0, start)})
    period = (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))).cast("int")
    rows = rows.withColumn("__p", F.when(F.col("__a").isNotNull(), period))
    tail = F.col("__n") - F.col("__a")
    copies = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(tail / F.col("__p")).cast("int")))
    again = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.slice(copies, F.lit(1), tail)), " ")
    return rows.select(id_col, F.when(F.col("__p").isNotNull(), again).otherwise(F.col(text_col)).alias(text_col))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_runs``, the best run (``start, length, period, exponent_milli``; NULLs where
    there is none), ``runs_sha256`` and ``collapsed_sha256`` of every row, after ``planted``."""
    found = collapse_runs(planted(docs, id_col, text_col), id_col, text_col).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
