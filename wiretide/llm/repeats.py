"""Repeated passages: every byte that a repeated string of ``LENGTH`` bytes covers.

A suffix array of the whole corpus does not fit a machine, so windows of ``LENGTH`` bytes are first
dealt out by content. The anchor of a window is its smallest ``GRAM``-byte gram by hash; equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a *stretch*.

1. Stretches are counted by the hash of their bytes. A stretch that occurs twice is repeated as a
   whole, which settles the inside of all long repeats without moving text.
2. An anchor with several different stretches needs a closer look. One copy of each of them meets
   in a task that sorts suffixes by prefix doubling. In suffix order, the previous and the next
   smaller position of a suffix are the earlier suffixes that share most with it: this gives the
   longest-previous-factor array, and the same with positions reversed the longest next factor.
   A window is repeated where one of the two reaches ``LENGTH``; with ``keep="first"`` only
   previous factors count.
3. An anchor with more than ``MOST_VARIANTS`` different stretches is split further: its windows are
   counted one by one by hash, over all tasks.

With ``keep="first"`` a window goes only if an equal one comes earlier, by row and place. Copies of a
stretch after its first go as a whole. All windows of first copies take part in steps 2 and 3, as
their own first copy may stand in another stretch of the anchor.

Runs of repeated windows are merged per document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretide.llm.shared import shuffle_parts, stored, text_of
from wiretide.llm.text import BYTE_VALUES, running, slices, span_hashes, utf8

LENGTH, GRAM = 200, 16
#: Longer texts are scanned in sections of this many bytes.
SECTION = 1 << 21
MOST_VARIANTS = 3000
#: Bytes of stretches whose suffixes are sorted at once, and that one task gets.
CHUNK_BYTES, SHARE_BYTES = 1 << 21, 16 << 20


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys, from minima up to and from block borders."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    to_right = np.minimum.accumulate(grid, axis=1).ravel()
    to_left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_left[:n], to_right[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, hash) of every stretch of the rows of a slice."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    total = running(BYTE_VALUES[data])
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(total, at, at + GRAM)
    # the hash decides, then the place: a slice is shorter than 2**23 bytes or a single section
    places = np.uint64(23)
    keys = ((grams >> places) << places) | at.astype(np.uint64)
    least = least_in_windows(keys, LENGTH - GRAM + 1)
    anchor_at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    starts = np.arange(len(least))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + LENGTH <= offsets[1:][row]
    starts, row, anchor_at = starts[inside], row[inside], anchor_at[inside]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.r_[True, (row[1:] != row[:-1]) | (anchor_at[1:] != anchor_at[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(starts)])
    begin = starts[first]
    whole = span_hashes(total, begin, begin + count + LENGTH - 1)
    return row[first], begin - offsets[:-1][row[first]], count, grams[anchor_at[first]].view(np.int64), whole.view(np.int64)


def sections(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes skipped in it, data, offsets) of slices; long rows come in overlapping parts."""
    for low, high in slices(offsets):
        begin, end = int(offsets[low]), int(offsets[high])
        if high - low == 1 and end - begin > SECTION:
            for skip in range(0, end - begin - LENGTH + 1, SECTION):
                part = data[begin + skip : min(end, begin + skip + SECTION + LENGTH - 1)]
                yield low, skip, part, np.array([0, len(part)])
        else:
            yield low, 0, data[begin:end], offsets[low : high + 1] - begin


STRETCH = "row bigint, start bigint, windows int, anchor bigint, body bigint"


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_numpy()
        for low, skip, data, offsets in sections(*utf8(batch.column(1))):
            row, start, count, anchor, body = stretches(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[low + row]), pa.array(start + skip), pa.array(count.astype(np.int32)), pa.array(anchor), pa.array(body)],
                ["row", "start", "windows", "anchor", "body"],
            )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted stretches: columns row, text, wanted (start, windows, anchor, single)."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        whole, names, out = memoryview(data), batch.column(0).to_pylist(), []
        for i, wanted in enumerate(batch.column(2).to_pylist()):
            base = int(offsets[i])
            out += [(names[i], w["start"], w["windows"], w["anchor"], w["single"], bytes(whole[base + w["start"] : base + w["start"] + w["windows"] + LENGTH - 1])) for w in wanted]
        for part in range(0, len(out), 20_000):
            columns = list(zip(*out[part : part + 20_000], strict=True))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "start", "windows", "anchor", "single", "piece"])


def ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def prefix_ranks(data: np.ndarray) -> dict[int, np.ndarray]:
    """Rank of each position by its next 8, 16, ... 128 bytes (the end counts as zeros)."""
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(data)]
    out, size = {8: ranks(key)}, 8
    while size < 128:
        before = out[size]
        after = np.zeros_like(before)
        after[:-size] = before[size:] + np.uint64(1)
        size *= 2
        out[size] = ranks(before * np.uint64(len(data) + 2) + after)
    return out


def smaller_before(positions: np.ndarray) -> np.ndarray:
    """For each entry the nearest earlier entry of a smaller position, or -1. Pointers skip what
    their targets have skipped, so a few rounds are enough."""
    link = np.arange(-1, len(positions) - 1)
    active = np.flatnonzero(link >= 0)
    while len(active):
        active = active[positions[link[active]] > positions[active]]
        link[active] = link[link[active]]
        active = active[link[active] >= 0]
    return link


def common(by: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of two suffixes, in steps of 8 bytes, up to ``LENGTH``."""
    length, last = np.zeros(len(a), np.int64), len(by[8]) - 1
    for size in (128, 64, 32, 16, 8):
        same = (by[size][np.minimum(a + length, last)] == by[size][np.minimum(b + length, last)]) & (length + size <= LENGTH)
        length += size * same
    return length


def previous_factors(by: dict[int, np.ndarray], order: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest earlier match of each suffix. ``order``: suffixes in suffix order; ``position``: what
    counts as their place in the text. The nearest smaller positions on both sides in suffix order
    hold the longest earlier match."""
    best = np.zeros(len(order), np.int64)
    before, after = smaller_before(position), len(order) - 1 - smaller_before(position[::-1])[::-1]
    for link, known in ((before, before >= 0), (after, after < len(order))):
        at = np.flatnonzero(known)
        best[at] = np.maximum(best[at], common(by, order[at], order[link[at]]))
    return best


def repeated(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an earlier and which a later copy among ``starts`` (ascending)."""
    by = prefix_ranks(data)
    key = by[128][starts] * np.uint64(len(data) + 2) + by[128][np.minimum(starts + LENGTH - 128, len(data) - 1)]
    sorted_by = np.argsort(key, kind="stable")
    order = starts[sorted_by]
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[sorted_by] = previous_factors(by, order, order) >= LENGTH
    flipped = np.argsort(key[::-1], kind="stable")  # equal windows now come in falling order
    back = starts[::-1][flipped]
    later[len(starts) - 1 - flipped] = previous_factors(by, back, -back) >= LENGTH
    return earlier, later


def _settled(keep: str):
    return lambda table: _settled_share(table, keep)


def _settled_share(table: pa.Table, keep: str) -> pa.Table:
    """Repeated runs of the single stretches of a share of anchors."""
    table = table.sort_by([("anchor", "ascending"), ("row", "ascending"), ("start", "ascending")])
    rows, start, windows = table["row"].to_numpy(), table["start"].to_numpy(), table["windows"].to_numpy().astype(np.int64)
    anchor, single = table["anchor"].to_numpy(), table["single"].to_numpy(zero_copy_only=False).astype(bool)
    sizes = windows + LENGTH - 1
    ends, out = np.cumsum(sizes), []
    borders = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True]) if len(anchor) else np.zeros(1, np.int64)
    low = 0
    while low < len(rows):
        base = ends[low] - sizes[low]
        nth = max(np.searchsorted(ends[borders[1:] - 1], base + CHUNK_BYTES, "right"), np.searchsorted(borders, low, "right"))
        high = int(borders[min(nth, len(borders) - 1)])
        data = np.frombuffer(b"".join(table["piece"].slice(low, high - low).to_pylist()), np.uint8)
        first = ends[low:high] - sizes[low:high] - base
        piece = np.repeat(np.arange(high - low), windows[low:high])
        within = np.arange(len(piece)) - np.repeat(np.cumsum(windows[low:high]) - windows[low:high], windows[low:high])
        earlier, later = repeated(data, first[piece] + within)
        hit = np.flatnonzero((earlier if keep == "first" else earlier | later) & single[low:high][piece])
        if len(hit):
            cut = np.r_[True, (piece[hit][1:] != piece[hit][:-1]) | (within[hit][1:] != within[hit][:-1] + 1)]
            head, tail = hit[cut], hit[np.r_[np.flatnonzero(cut)[1:] - 1, len(hit) - 1]]
            at = low + piece[head]
            out.append(pa.table({"row": rows[at], "begin": start[at] + within[head], "end": start[at] + within[tail] + LENGTH}))
        low = high
    empty = pa.table({"row": pa.array([], pa.int64()), "begin": pa.array([], pa.int64()), "end": pa.array([], pa.int64())})
    return pa.concat_tables([empty, *out])


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the pieces of crowded anchors."""
    for batch in batches:
        for piece, row, start, single in zip(batch["piece"].to_pylist(), batch["row"].to_pylist(), batch["start"].to_pylist(), batch["single"].to_pylist(), strict=True):
            data = np.frombuffer(piece, np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            h = span_hashes(running(BYTE_VALUES[data]), at, at + LENGTH).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), row)), pa.array(at + start), pa.array(np.full(len(at), single))], ["window", "row", "begin", "single"])


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > reach[:-1]]
    return begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, spans (flat begin, end, ...)."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        whole, sizes, cuts, kept = memoryview(data), [], [], []
        spans = batch.column(2)
        for i in range(batch.num_rows):
            low, high = int(offsets[i]), int(offsets[i + 1])
            edges = spans[i].values.to_numpy() if spans[i].is_valid else np.zeros(0, np.int64)
            begin, end = (x.tolist() for x in merged(edges[::2], edges[1::2])) if len(edges) else ([], [])
            sizes.append(high - low)
            cuts.append([{"begin": a, "end": b} for a, b in zip(begin, end, strict=True)])
            kept.append(b"".join(whole[low + a : low + b] for a, b in zip([0, *end], [*begin, high - low], strict=True)))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(cuts, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeated_spans(rows: DataFrame, keep: str = "none") -> DataFrame:
    """``(row, begin, end)`` byte spans of repeated windows, from ``rows (row, text)``; they may overlap.
    ``keep`` is ``none`` or ``first``, for which each row has its own number."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    first = keep == "first"
    spark = rows.sparkSession
    found = stored(rows.mapInArrow(_stretched, STRETCH), "stretches")
    variants = stored(
        found.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows")).alias("one")), "variants"
    )
    span = [F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end")]
    again = variants.where("n > 1")
    if first:
        later = found.join(again.select("anchor", "body", F.col("one.row").alias("__row"), F.col("one.start").alias("__start")), ["anchor", "body"])
        settled = later.where((F.col("row") != F.col("__row")) | (F.col("start") != F.col("__start"))).select("row", *span)
    else:
        settled = found.join(again.select("anchor", "body"), ["anchor", "body"], "left_semi").select("row", *span)
    open_anchors = (
        variants.groupBy("anchor")
        .agg(F.count("*").alias("variants"), F.min("n").alias("least"), F.sum(F.col("one.windows") + (LENGTH - 1)).alias("bytes"))
        .where("variants > 1" if first else "variants > 1 and least = 1")
    )
    wanted = variants.join(open_anchors, "anchor").select("anchor", "variants", "one.*", (F.lit(True) if first else F.col("n") == 1).alias("single"))
    wanted = stored(wanted, "wanted")
    total = wanted.agg(F.sum(F.col("windows") + LENGTH)).first()[0] or 0
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "anchor", "single")).alias("wanted"))
    pieces = rows.join(lists, "row").select("row", "text", "wanted").mapInArrow(_pieces, "row bigint, start bigint, windows int, anchor bigint, single boolean, piece binary")
    crowded = stored(open_anchors.where(F.col("variants") > MOST_VARIANTS).select("anchor"), "crowded")
    some_crowded = not crowded.isEmpty()
    if some_crowded:
        pieces = stored(pieces, "pieces")
        few = pieces.join(crowded, "anchor", "left_anti")
    else:
        few = pieces
    shares = max(shuffle_parts(spark), -(-total // SHARE_BYTES))
    closer = few.withColumn("__share", F.pmod(F.xxhash64("anchor"), F.lit(shares))).groupBy("__share").applyInArrow(_settled(keep), "row bigint, begin bigint, end bigint")
    spans = settled.unionByName(closer)
    if some_crowded:
        windows = stored(pieces.join(crowded, "anchor", "left_semi").mapInArrow(_windowed, "window bigint, row bigint, begin bigint, single boolean"), "windows")
        again = windows.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("row", "begin")).alias("one")).where("n > 1")
        if first:
            twice = windows.join(again, "window").where(F.struct("row", "begin") != F.col("one"))
        else:
            twice = windows.where("single").join(again.select("window"), "window", "left_semi")
        spans = spans.unionByName(twice.select("row", "begin", (F.col("begin") + LENGTH).alias("end")))
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, spans`` (merged byte spans that are cut) and
    ``kept``, the bytes of the rest: a cut may split a character.

    With ``keep="none"`` each byte goes that is covered by a string of ``LENGTH`` bytes that also
    starts elsewhere, in the same text or another. With ``keep="first"`` it goes if that string starts
    earlier: in a row before it by id (then by hash of the text), or before it in the text. So where
    copies overlap, the later one takes its bytes from the first. Strings are judged on the input and
    do not cross texts. NULL texts are empty, texts shorter than ``LENGTH`` are never cut. Rows
    repeated with their id and text count as copies of each other. An empty table gives no rows;
    further columns are not read.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    if keep == "first":
        # numbers of sorted rows rise; stored, they stay. The last key only spreads equal rows.
        rows = rows.orderBy("doc_id", F.xxhash64("text"), F.monotonically_increasing_id())
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "sorted")
    else:
        rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.where(F.octet_length("text") >= LENGTH).select("row", "text"), keep)
    per_row = spans.distinct().groupBy("row").agg(F.flatten(F.collect_list(F.array("begin", "end"))).alias("spans"))
    schema = "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    return rows.join(per_row, "row", "left").select("doc_id", "text", "spans").mapInArrow(_cut, schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of
    ``remove_repeats``, which keeps no copy."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return remove_repeats(docs, id_col, text_col).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
