"""How far the sources of a language differ in their words, from count-level bitmaps.

For every (language, source) group and every count c above zero there is a set of the kept terms
that occur c times in the group. A pair of groups is then told by its joint cells: how many terms
occur a times here and b times there, the population count of the AND of two sets, times the
divergence f(a, b), which is evaluated once a cell. The set of count zero is never stored; it is the
complement of the others.

Terms of a language are dealt into blocks of some thousand by a hash and numbered within the block.
A set is stored per block as a bitmap, or as a sorted list of term numbers where that is shorter, as
compressed bitmaps do; members of such short sets are looked up one by one, since there are more
cells than terms among them. Blocks are independent, so neither a large language nor a hot source
meets in one task, and sources come in stripes of ``STRIPE``, so a task holds two stripes at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.shared import stored, text_of
from wiretide.llm.text import LOWER, slices, utf8, words

#: Terms of a block on average, and sources of a stripe.
BLOCK, STRIPE = 8192, 64
#: Rows that a task of the count holds before it merges them, and hands them on.
MERGE_ROWS, KEEP_ROWS = 600_000, 300_000
ONE = 1_000_000_000

#: Terms are runs of ASCII letters and of all bytes from 0x80 on.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slice_counts(lang: pa.Array, source: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """Occurrences of each (language, source, term), and the documents that hold it."""
    part = LOWER[data]
    starts, ends, first = words(part, offsets, LETTERS)
    reach = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(part[LETTERS[part]]))
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(reach), body).dictionary_encode()
    term, many = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    cell, n = np.unique(doc * many + term, return_counts=True)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    key, at = np.unique(group[cell // many] * many + cell % many, return_inverse=True)
    group, term = key // many, key % many
    return pa.table(
        [
            langs.dictionary.take(pa.array(group // len(sources.dictionary))),
            sources.dictionary.take(pa.array(group % len(sources.dictionary))),
            coded.dictionary.take(pa.array(term)).cast(pa.string()),
            pa.array(np.bincount(at, n, minlength=len(key)).astype(np.int64)),
            pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)),
        ],
        schema=_COUNTED,
    )


def _merged(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTED.names).cast(_COUNTED)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, rows = [], 0
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for low, high in slices(offsets, 4 << 20):
            found = _slice_counts(batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            parts.append(found)
            rows += len(found)
            if rows > MERGE_ROWS:
                parts = [_merged(parts)]
                rows = len(parts[0])
                if rows > KEEP_ROWS:
                    yield from parts[0].to_batches(100_000)
                    parts, rows = [], 0
    if parts:
        yield from _merged(parts).to_batches(100_000)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), without overflow."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, low = F.lit(ONE).cast("decimal(10,0)") * wide(count + 2), wide(total) + 2 * wide(kept)
    return F.lit(1) + F.call_function("div", top, low)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))"""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _bitmaps(table: pa.Table) -> pa.Table:
    """One row for a group and block: its counts, and the set of term numbers of each."""
    size = table["size"][0].as_py()
    ids, counts = table["id"].to_numpy(), table["n"].to_numpy()
    order = np.lexsort((ids, counts))
    ids, counts = ids[order], counts[order]
    edges = np.r_[0, np.flatnonzero(np.diff(counts)) + 1, len(counts)]
    sets = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if 2 * (b - a) > _bytes(size):
            bits = np.zeros(8 * _bytes(size), np.uint8)
            bits[ids[a:b]] = 1
            sets.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            sets.append(ids[a:b].astype(np.uint16).tobytes())
    first = {c: [table[c][0].as_py()] for c in ("lang", "source", "block")}
    return pa.table(
        {
            "lang": pa.array(first["lang"], pa.string()),
            "source": pa.array(first["source"], pa.string()),
            "block": pa.array(first["block"], pa.int64()),
            "counts": pa.array([counts[edges[:-1]].tolist()], pa.list_(pa.int64())),
            "members": pa.array([np.diff(edges).tolist()], pa.list_(pa.int32())),
            "sets": pa.array([sets], pa.list_(pa.binary())),
        }
    )


def _bytes(size: int) -> int:
    """Bytes of a bitmap, in whole 64-bit words."""
    return -(-size // 64) * 8


class _Levels:
    """The sets of one group in one block: bitmaps with their share p, and p of each term."""

    def __init__(self, size: int, total: int, kept: int, counts: list[int], members: list[int], sets: list[bytes]) -> None:
        self.p = np.full(size, 1 + ONE * 2 // (total + 2 * kept), np.int64)
        self.short = np.zeros(size, bool)
        maps, shares = [], []
        some = np.zeros(_bytes(size) // 8, np.uint64)
        for count, n, held in zip(counts, members, sets, strict=True):
            share = 1 + ONE * (count + 2) // (total + 2 * kept)
            if 2 * n > _bytes(size):
                bits = np.frombuffer(held, np.uint64)
                self.p[np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[:size])] = share
                maps.append(bits)
                shares.append(share)
                some |= bits
            else:
                ids = np.frombuffer(held, np.uint16)
                self.p[ids], self.short[ids] = share, True
        whole = np.packbits(np.r_[~self.short, np.zeros(8 * _bytes(size) - size, bool)], bitorder="little").view(np.uint64)
        maps.append(whole & ~some)  # count zero: what is in no set
        shares.append(1 + ONE * 2 // (total + 2 * kept))
        self.maps, self.shares = np.stack(maps), np.array(shares, np.int64)

    def divergence(self, other: _Levels) -> int:
        cells = np.empty((len(self.maps), len(other.maps)), np.int64)
        for k, bits in enumerate(self.maps):
            cells[k] = np.bitwise_count(bits & other.maps).sum(axis=1)
        total = int((cells * _gap(self.shares[:, None], other.shares[None, :])).sum())
        single = self.short | other.short
        return total + int(_gap(self.p[single], other.p[single]).sum())


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pairs(key: tuple, table: pa.Table) -> pa.Table:
    lang, _, low, high = (k.as_py() for k in key)
    rows = table.to_pylist()
    groups = [(r["stripe"], r["source"], _Levels(r["size"], r["total"], r["kept"], r["counts"] or [], r["members"] or [], r["sets"] or [])) for r in rows]
    left = [g for g in groups if g[0] == low]
    right = [g for g in groups if g[0] == high]
    found = [(a[1], b[1], a[2].divergence(b[2])) for a in left for b in right if low != high or a[1] < b[1]]
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "a": pa.array([f[0] for f in found], pa.string()), "b": pa.array([f[1] for f in found], pa.string()), "value": pa.array([f[2] for f in found], pa.int64())})


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language by the divergence of the two word
    distributions, the sum over kept terms of floor((p - q)^2 / (p + q)). Part ``term``: the ``top``
    kept terms that a group uses more than its language does. p and q are shares in 10^-9, smoothed
    by two a term; all arithmetic is in whole numbers, and equal values are ranked by item.

    Terms are runs of ASCII letters (lower-cased) and of all characters from U+0080 on; a language
    keeps those in at least ``least_docs`` of its rows. NULL text, language and source are the empty
    text. Repeated rows count each. A group without kept terms is there, its shares even; where a
    language keeps none all values are 0. A language of one source has no pairs. Other columns are
    not read; an empty table gives no rows.
    """
    slim = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    counts = slim.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
    counted = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = stored(
        counted.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"),
        "kept",
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("everywhere").alias("lang_total"))
    most = langs.agg(F.max("kept")).first()[0] or 0
    blocks = -(-most // BLOCK)
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(max(1, blocks))))
    in_block = Window.partitionBy("lang", "block")
    numbered = numbered.withColumns({"id": F.row_number().over(in_block.orderBy("term")) - 1, "size": F.count("*").over(in_block)})
    cells = stored(counted.drop("docs").join(numbered, ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    stripe = F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / STRIPE)
    groups = (
        slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .fillna(0, ["total", "kept", "lang_total"]).withColumn("stripe", stripe)
    )
    groups = stored(groups, "groups")
    return _pair_part(groups, cells).unionByName(_term_part(groups, cells, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _pair_part(groups: DataFrame, cells: DataFrame) -> DataFrame:
    sets = cells.groupBy("lang", "source", "block").applyInArrow(_bitmaps, "lang string, source string, block bigint, counts array<bigint>, members array<int>, sets array<binary>")
    sizes = cells.select("lang", "block", "size").distinct()
    held = groups.select("lang", "source", "stripe", "total", "kept").join(sizes, "lang").join(sets, ["lang", "source", "block"], "left")
    stripes = groups.groupBy("lang").agg(F.max("stripe").alias("last"))
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("partner")
    dealt = held.join(stripes, "lang").select("*", partner).withColumns({"low": F.least("stripe", "partner"), "high": F.greatest("stripe", "partner")})
    summed = dealt.drop("last", "partner").groupBy("lang", "block", "low", "high").applyInArrow(_pairs, "lang string, a string, b string, value bigint")
    found = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.unionByName(found.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # every pair of sources of a language is a row of the result
    pairs = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a <> b")
    every = pairs.join(both, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    return _ranked(every, "pair")


def _term_part(groups: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    facts = groups.select("lang", "source", "total", "kept", "lang_total")
    shares = cells.select("lang", "source", "term", "n", "everywhere").join(facts, ["lang", "source"])
    shares = shares.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("everywhere"), F.col("lang_total"), F.col("kept"))})
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(above, "term").where(F.col("rank") <= top)


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(t.n, 0) + 2 * l.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 10"""
