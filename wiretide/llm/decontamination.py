"""Benchmark decontamination: a broadcast set of n-gram hashes, a scan of every text, verified hits.

The benchmark goes out in parts of at most ``PART_BYTES`` of text; each part is one broadcast and
one scan of the documents, and the hits of all parts are merged per document. A worker turns a part
into a hash set of windows once. A window found by hash counts only if its words are equal too.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiretide.llm.shared import stored
from wiretide.llm.text import LOWER, WORD_BYTES, slices, utf8, window_hashes, word_hashes, words

#: Benchmark text of one broadcast; its hash set takes about six times that in a worker.
PART_BYTES = 32 << 20
FILTER_BITS = 22


class Windows:
    """All windows of some benchmark items: width -> sorted hashes, and what each hash stands for."""

    def __init__(self, items: list[tuple[str, str]], width: int) -> None:
        found: dict[int, dict[int, list[tuple[str, list[bytes]]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), WORD_BYTES)
            if not len(starts):
                continue
            whole, wide = data.tobytes(), min(width, len(starts))
            own = [whole[a:b] for a, b in zip(starts, ends, strict=True)]
            for i, h in enumerate(window_hashes(word_hashes(data, starts, ends), wide).tolist()):
                found[wide][h].append((name, own[i : i + wide]))
        self.stands_for = {w: dict(x) for w, x in found.items()}
        self.hashes = {w: np.array(sorted(x), np.uint64) for w, x in found.items()}
        self.filters = {}
        for w, x in self.hashes.items():
            self.filters[w] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[w][x >> np.uint64(64 - FILTER_BITS)] = True


_built: dict[str, Windows] = {}


def _windows(name: str, part, width: int) -> Windows:
    """The hash set of a broadcast part, kept for the next task of the same worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Windows(part.value, width)
    return _built[name]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HIT = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
HIT_SQL = "array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>"


def _scan(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Word counts, hit runs and item names of each row of a slice."""
    rows = len(offsets) - 1
    folded = LOWER[data]
    starts, ends, first = words(folded, offsets, WORD_BYTES)
    hashes = word_hashes(folded, starts, ends)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    hits: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    whole = None
    for width, known in windows.hashes.items():
        h = window_hashes(hashes, width)
        maybe = np.flatnonzero(windows.filters[width][h >> np.uint64(64 - FILTER_BITS)])
        maybe = maybe[row_of[maybe] == row_of[maybe + width - 1]]
        at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        for i in maybe[known[at] == h[maybe]].tolist():
            whole = folded.tobytes() if whole is None else whole
            own = [whole[a:b] for a, b in zip(starts[i : i + width], ends[i : i + width], strict=True)]
            names = [name for name, text in windows.stands_for[width][int(h[i])] if text == own]
            if names:
                row = int(row_of[i])
                hits[row].append((i - int(first[row]), i + width - int(first[row])))
                items[row].update(names)
    spans = []
    for row in range(rows):
        base, begin = int(first[row]), int(offsets[row])
        spans.append([(a, b, int(starts[base + a]) - begin, int(ends[base + b - 1]) - begin) for a, b in merged(hits[row])] if row in hits else [])
    return np.diff(first), spans, [sorted(items[row]) if row in items else [] for row in range(rows)]


def _scanner(part, width: int, text_at: int, number: int):
    name = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(name, part, width)
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            for low, high in slices(offsets):
                counts, spans, items = _scan(windows, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                cells = [[dict(zip(("first", "last", "begin", "end"), x, strict=True)) for x in row] for row in spans]
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(counts, pa.int64()), pa.array(cells, pa.list_(HIT)), pa.array(items, pa.list_(pa.string()))],
                    [*own.schema.names, f"__n_words{number}", f"__spans{number}", f"__items{number}"],
                )

    return work


def _parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of bounded size; each is collected by itself."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total * 2 // PART_BYTES)) if total > PART_BYTES else 1
    for i in range(parts):
        yield [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i).collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` (merged runs of hit words, by word and by byte),
    ``__items`` (sorted names of the items whose windows occur) and ``__n_hit`` added.

    Words are runs of digits, letters and non-ASCII characters, ASCII letters lower-cased. A window
    is ``width`` consecutive words of an item, or all of them if it has fewer; an item without words
    has none. NULL texts have no words. Repeated rows and items change nothing but their own rows;
    an empty benchmark hits nothing. Other columns are kept as they are.
    """
    context, found, parts = docs.sparkSession.sparkContext, docs, 0
    for part in _parts(benchmark, item_col, item_text):
        if parts:  # one part's windows at a time: what the last scan found is stored before the next
            found = stored(found, "scanned")
        fields = f"__n_words{parts} bigint, __spans{parts} {HIT_SQL}, __items{parts} array<string>"
        schema = StructType([*found.schema.fields, *StructType.fromDDL(fields).fields])
        found = found.mapInArrow(_scanner(context.broadcast(part), width, found.columns.index(text_col), parts), schema)
        parts += 1
    every = lambda name: F.concat(*[F.col(f"{name}{i}") for i in range(parts)])
    joined = """aggregate(array_sort(__all), cast(array() as %s), (done, x) -> if(size(done) > 0 and x.first <= element_at(done, -1).last,
        concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last),
        'begin', element_at(done, -1).begin, 'end', greatest(element_at(done, -1).end, x.end)))), concat(done, array(x))))""" % HIT_SQL
    return (
        found.withColumn("__all", every("__spans"))
        .withColumn("__spans", F.expr(joined) if parts > 1 else F.col("__all"))
        .withColumn("__items", F.array_sort(F.array_distinct(every("__items"))))
        .withColumn("__n_hit", F.expr("aggregate(__spans, 0L, (n, x) -> n + x.last - x.first)"))
        .select(*docs.columns, F.col("__n_words0").alias("__n_words"), "__spans", "__items", "__n_hit")
    )


def contaminated() -> Column:
    """At least one hit word, and hits of a twentieth of all words."""
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **columns) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit spans cut out of them (``remove =
    "spans"``; the text around a span is kept as it is). All columns stay, clean rows unchanged."""
    text_col = columns.get("text_col", "text")
    found = contamination(docs, benchmark, **columns)
    if remove == "documents":
        return found.where(~contaminated()).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is documents or spans")

    names = docs.columns
    text_at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, row in enumerate(batch.column(len(names)).to_pylist()):
                if row:
                    raw = texts[i].encode()
                    edges = [0, *(x for span in row for x in (span["begin"], span["end"])), len(raw)]
                    texts[i] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
            own = batch.select(names)
            yield own.set_column(text_at, text_col, pa.array(texts, own.schema.field(text_col).type))

    cut = F.when(contaminated(), F.col("__spans")).otherwise(F.array().cast(HIT_SQL)).alias("__cut")
    return found.select(*docs.columns, cut).mapInArrow(work, docs.schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = contamination(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, width=width)
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
