"""Near duplicates by MinHash bands, verified with odd sketches and then on the full sets.

1. A document is the set of its distinct word shingles. Documents of equal sets are one *class*.
2. A class draws ``BANDS * ROWS`` MinHash samples. Bands of them propose classes that may be alike;
   all samples together are folded into a parity bitmap (an odd sketch). The XOR of two bitmaps
   counts the samples that differ, which tells high similarities apart precisely and drops nearly
   all false proposals. A pair at the threshold is missed by all bands with a chance of 3e-6.
3. Proposed pairs fall into connected groups. The full sets of a group meet in one task, which
   finds all links by a matrix product. A group that is too large for a task is cut into blocks;
   leaders of the blocks' components are compared, then whatever is still apart from the group's
   main component is compared with every block. So no link between two components is lost.
4. Linked classes are connected; each component is named by its smallest document id.

Only classes take part in 2 to 4: copies cost one row. Only rows of candidates meet their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wiretide.llm.graph import components
from wiretide.llm.shared import shuffle_parts, stored
from wiretide.llm.text import LOWER, NOT_SPACE, mixed, slices, utf8, window_hashes, word_hashes, words

BANDS, ROWS = 32, 5
SKETCH_BITS = 1024
#: Estimated similarity from which a proposed pair is verified: five standard errors below 0.8.
LEAST_ESTIMATE = 0.62
#: Most classes of a bucket that are compared by sketch; a larger bucket is passed on as one group.
BUCKET = 1500
#: Rows of sketches in one comparing task.
SHARE_ROWS = 100_000
#: Most classes and most shingles that meet in one verifying task.
BLOCK, BLOCK_SHINGLES = 500, 4_000_000

_random = np.random.default_rng(8)
SALTS = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
FACTORS = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def most_bits(estimate: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """XOR population count of two odd sketches whose samples agree in a share ``estimate``."""
    return int(bits / 2 * (1 - np.exp(-4 * samples * (1 - estimate) / bits)))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows, repeats included, and where each row starts. A row of fewer words
    has its whole sequence as its one shingle, a row without words none."""
    folded = LOWER[data]
    starts, ends, first = words(folded, offsets, NOT_SPACE)
    hashes = word_hashes(folded, starts, ends)
    counts = np.diff(first)
    windows = window_hashes(hashes, size)
    per_row = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(per_row)])
    long_rows = counts >= size
    index = np.repeat(first[:-1] - at[:-1], per_row) + np.arange(at[-1])
    out = np.zeros(at[-1], np.uint64)
    is_long = np.repeat(long_rows, per_row)
    out[is_long] = windows[index[is_long]]
    for row in np.flatnonzero((counts > 0) & ~long_rows):
        sequence = hashes[first[row] : first[row + 1]]
        out[at[row]] = window_hashes(sequence, len(sequence))[0] ^ np.uint64(len(sequence))
    return out, at


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash samples, one row per non-empty run of shingle hashes."""
    high = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    buffer = np.empty_like(high)
    for j in range(BANDS * ROWS):
        np.bitwise_xor(high, SALTS[j], out=buffer)
        np.multiply(buffer, FACTORS[j], out=buffer)
        out[:, j] = np.minimum.reduceat(buffer, starts)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    wide = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), wide.shape[:2]).copy()
    for j in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, j])
    return keys.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps, ``SKETCH_BITS / 8`` bytes a row."""
    rows, n = samples.shape
    bit = mixed(samples.astype(np.uint64) + (np.arange(1, n + 1, dtype=np.uint64) << np.uint64(33))) % np.uint64(SKETCH_BITS)
    at = np.arange(rows)[:, None] * SKETCH_BITS + bit.astype(np.int64)
    parity = np.bincount(at.ravel(), minlength=rows * SKETCH_BITS).reshape(rows, SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), axis=1)


def class_of(own: np.ndarray) -> int:
    """Name of a set of hashes, equal for equal sets."""
    return int(mixed(own.sum(keepdims=True) + mixed(own).sum(keepdims=True) * np.uint64(3)).view(np.int64)[0])


def _sketched(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in slices(offsets):
                part = data[offsets[low] : offsets[high]]
                values, at = shingles(part, offsets[low : high + 1] - offsets[low], size)
                count, node = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64)
                some = np.flatnonzero(np.diff(at))
                for row in some:
                    own = np.unique(values[at[row] : at[row + 1]])
                    count[row], node[row] = len(own), class_of(own)
                keys: list = [None] * (high - low)
                sketch: list = [None] * (high - low)
                if len(some):
                    samples = signatures(values, at[some])
                    for row, k, s in zip(some, band_keys(samples), odd_sketches(samples), strict=True):
                        keys[row], sketch[row] = k, s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(count), pa.array(node, mask=count == 0), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "node", "keys", "sketch"],
                )

    return work


def local_roots(adjacent: np.ndarray) -> np.ndarray:
    """For each node of a small graph the smallest index of its component."""
    adjacent = adjacent | adjacent.T
    np.fill_diagonal(adjacent, True)
    n = len(adjacent)
    label = np.arange(n)
    while True:
        new = np.where(adjacent, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(values):
        edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
        yield from zip(edges[:-1], edges[1:], strict=True)


def _star(nodes: np.ndarray, roots: np.ndarray, a: list, b: list) -> None:
    other = roots != np.arange(len(roots))
    a.append(nodes[other])
    b.append(nodes[roots[other]])


def _edges(a: list, b: list) -> pa.Table:
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return pa.table({"a": join(a), "b": join(b)})


def _alike(table: pa.Table) -> pa.Table:
    """Sketch comparison of all buckets of a share: stars of the classes that look alike."""
    table = table.sort_by("bucket")
    nodes = table["node"].to_numpy()
    bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(nodes), SKETCH_BITS // 64)
    most, a, b = most_bits(LEAST_ESTIMATE), [], []
    for low, high in runs(table["bucket"].to_numpy()):
        own = bits[low:high]
        distance = np.empty((high - low, high - low), np.int32)
        for i in range(high - low):
            distance[i] = np.bitwise_count(own ^ own[i]).sum(axis=1, dtype=np.int32)
        _star(nodes[low:high], local_roots(distance <= most), a, b)
    return _edges(a, b)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets have 100 * intersection >= percent * union, from exact counts."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        x, y = sorted(sets, key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = np.array([[sizes[0], (y[at] == x).sum()], [0, sizes[1]]])
        common[1, 0] = common[0, 1]
    else:
        everything = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, seen = np.unique(everything, return_inverse=True, return_counts=True)
        rank = np.cumsum(seen > 1) - 1
        kept = seen[column] > 1
        column, owner = rank[column[kept]], owner[kept]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(sets), len(sets)))
        width = max(256, 8_000_000 // len(sets))
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            low, high = np.searchsorted(column, [start, start + width])
            block = np.zeros((len(sets), width), np.float32)
            block[owner[low:high], column[low:high] - start] = 1
            common += block @ block.T
        common = common.astype(np.int64)
        np.fill_diagonal(common, sizes)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _verified(percent: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("node", "ascending")])
        tasks, nodes = table["task"].to_numpy(), table["node"].to_numpy()
        first = np.flatnonzero(np.r_[True, (tasks[1:] != tasks[:-1]) | (nodes[1:] != nodes[:-1])][: len(nodes)])
        tasks, nodes, blobs, a, b = tasks[first], nodes[first], table["members"].take(first), [], []
        for low, high in runs(tasks):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in blobs.slice(low, high - low)]
            _star(nodes[low:high], local_roots(linked(sets, percent)), a, b)
        return _edges(a, b)

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            names = batch.column(0).to_numpy()
            for low, high in slices(offsets):
                values, at = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
                own = [np.unique(values[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                true = [i for i, x in enumerate(own) if len(x) and class_of(x) == names[low + i]]  # an id may have other texts
                yield pa.RecordBatch.from_arrays([pa.array(names[low:high][true]), pa.array([own[i].tobytes() for i in true], pa.binary())], ["node", "members"])

    return work


def _compare(tasks: DataFrame, sets: DataFrame, percent: int, shingle_count: int) -> DataFrame:
    """Links found in each task of ``tasks (task, node)``; tasks are dealt out in shares of bounded size."""
    shares = max(shuffle_parts(tasks.sparkSession), -(-shingle_count // BLOCK_SHINGLES))
    dealt = tasks.join(sets, "node").withColumn("__share", F.pmod(F.xxhash64("task"), F.lit(shares)))
    return stored(dealt.groupBy("__share").applyInArrow(_verified(percent), "a bigint, b bigint"), "verified")


def _verify(groups: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, component)`` of linked classes, from candidate groups ``(node, component)``."""
    sized = groups.join(classes.select("node", "n_shingles"), "node")
    weight = sized.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = stored(
        sized.join(weight, "component").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")), "placed"
    )
    total = placed.agg(F.sum("n_shingles")).first()[0] or 0
    edges = _compare(placed.select(F.xxhash64("component", "block").alias("task"), "node"), sets, percent, total)
    large = placed.where("blocks > 1")
    if large.isEmpty():
        roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    named = lambda found: large.withColumnRenamed("component", "whole").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leaders = named(components(edges)).where("component = node")
    per_group = leaders.groupBy("whole").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    meet = leaders.join(per_group, "whole").select(F.xxhash64(F.lit("lead"), "whole", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("task"), "node")
    edges = stored(edges.unionByName(_compare(meet, sets, percent, total)), "edges")
    now = stored(named(components(edges)), "named")
    counts = now.groupBy("whole", "component").agg(F.count("*").alias("__n"))
    main = counts.groupBy("whole").agg(F.max(F.struct("__n", "component"))["component"].alias("main"))
    apart = now.join(main, "whole").where("component <> main")
    chunks = apart.groupBy("whole").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    apart = apart.join(chunks, "whole").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int"))
    if not apart.isEmpty():
        tag = F.xxhash64(F.lit("apart"), "whole", "chunk", "block").alias("task")
        every_block = apart.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(tag, "node")
        blocks = now.join(chunks, "whole").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(tag, "node")
        met = every_block.unionByName(blocks).distinct()
        volume = met.join(classes.select("node", "n_shingles"), "node").agg(F.sum("n_shingles")).first()[0] or 0
        edges = edges.unionByName(_compare(met, sets, percent, volume))
    return components(edges)


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, node, component_id)`` of every row; ``node`` names its class."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>, sketch binary"
    rows = stored(base.mapInArrow(_sketched(shingle), schema), "sketches")
    classes = stored(
        rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")),
        "classes",
    )
    proposed = classes.select(F.explode("keys").alias("key"), "node")
    shared = proposed.groupBy("key").agg(F.count("*").alias("__n"), F.min("node").alias("low")).where("__n > 1")
    meeting = proposed.join(shared, "key")
    crowded = meeting.where(F.col("__n") > BUCKET).select(F.col("node").alias("a"), F.col("low").alias("b"))
    lists = meeting.where(F.col("__n") <= BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members").distinct()
    buckets = stored(lists.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("node")), "buckets")
    shares = max(shuffle_parts(docs.sparkSession), -(-buckets.count() // SHARE_ROWS))
    compared = (
        buckets.join(classes.select("node", "sketch"), "node")
        .withColumn("__share", F.pmod(F.xxhash64("bucket"), F.lit(shares)))
        .groupBy("__share")
        .applyInArrow(_alike, "a bigint, b bigint")
    )
    groups = components(compared.unionByName(crowded).distinct())
    wanted = groups.join(classes.select("node", F.col("first").alias("doc_id")), "node").select("node", "doc_id")
    texts = base.join(wanted, "doc_id").select("node", "text")
    sets = stored(texts.mapInArrow(_sets(shingle), "node bigint, members binary"), "sets")
    found = _verify(groups, classes, sets, percent)
    smallest = found.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = found.join(smallest, "component").select("node", "component_id")
    alone = classes.select("node", "first").join(named, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "node")
        .join(alone, "node", "left")
        .select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * intersection >= percent * union of their sets of ``shingle``
    words (ASCII letters lower-cased, split at white space). ``component_id`` is the smallest id
    that links lead to. A document of fewer words has one shingle, its whole text; NULL texts and
    texts without words have none and stay alone. Rows that share an id share a fate only if their
    texts do; rows whose id is NULL are linked only by equal sets. An empty table gives no rows;
    further columns are not read.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _grouped(docs, id_col, text_col, shingle, percent).select("doc_id", "n_shingles", "component_id", kept)


def _named(size: int, text_at: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            for low, high in slices(offsets):
                values, at = shingles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], size)
                nodes = [class_of(np.unique(values[x:y])) if y > x else None for x, y in zip(at[:-1], at[1:], strict=True)]
                own = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(nodes, pa.int64())], [*own.schema.names, "__node"])

    return work


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest id, and all
    rows that are alone. Of rows with the same id and set of shingles one stays."""
    stays = _grouped(docs, id_col, text_col, shingle, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.select(F.col("doc_id").alias("__id"), F.col("node").alias("__class")).distinct()
    schema = StructType([*docs.schema.fields, StructField("__node", LongType())])
    named = docs.mapInArrow(_named(shingle, docs.columns.index(text_col)), schema)
    here = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.col("__node").eqNullSafe(F.col("__class"))
    found = named.join(stays, here).withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__class").orderBy("__id")))
    return found.where("__nth = 1").select(*docs.columns)
