"""Mixing sources to target weights, by min-cost flow over membership patterns.

Documents that belong to the same set of sources are one pattern. Patterns send words to the sources
they belong to; sources take up to a quota. Words of a first pass are free, those of each further
pass cost more, so repetition is used only where a quota needs it. The flow is solved on the driver
over patterns and sources (both small tables of checked size). A pattern's flow is then turned into
whole passes and one partial pass over its documents in a seeded order. The order's cut point is
found from sums over hash buckets, so choosing documents shuffles no text and no group meets in one
task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretide.llm.shared import stored, text_of

#: Most patterns that the driver's flow takes; sources are fewer.
MOST_PATTERNS = 200_000
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Runs of anything but white space (space, 0x09-0x0D)."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shares(sizes: dict, weights: dict, cap: float) -> dict:
    """All of ``sum(sizes)`` shared by weight, none above ``cap`` times its size; what that leaves
    over is shared again among the others until nobody is above."""
    out: dict = {}
    left, free = float(sum(sizes.values())), set(sizes)
    while free:
        whole = sum(weights[s] for s in free)
        above = {s for s in free if left * weights[s] / whole > cap * sizes[s]}
        if not above:
            return out | {s: left * weights[s] / whole for s in free}
        for s in above:
            out[s] = cap * float(sizes[s])
        left -= sum(out[s] for s in above)
        free -= above
    return out


def cycled_weights(names: Sequence, cycle: Sequence[float] = (1, 2, 3)) -> dict:
    """Weights that repeat over the sources in code point order, NULL last."""
    ordered = sorted(names, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def route(patterns: dict[tuple, int], quotas: dict, costs: Sequence[int] = (0, 1, 3)) -> dict[tuple, dict]:
    """Min-cost flow of words: pattern -> source -> words. A pattern of n words can send n on each
    pass, at the pass's cost a word. Shortest augmenting paths with potentials."""
    names, start, end = [*patterns], 0, 1
    at_pattern = {p: 2 + i for i, p in enumerate(names)}
    at_source = {s: 2 + len(names) + i for i, s in enumerate(quotas)}
    to, room, price, out = [], [], [], [[] for _ in range(2 + len(names) + len(quotas))]

    def arc(u: int, v: int, most: int, cost: int) -> int:
        for a, b, m, c in ((u, v, most, cost), (v, u, 0, -cost)):
            out[a].append(len(to))
            to.append(b)
            room.append(m)
            price.append(c)
        return len(to) - 2

    routes = {}
    for p, n in patterns.items():
        for cost in costs:
            arc(start, at_pattern[p], n, cost)
        for s in p:
            routes[p, s] = arc(at_pattern[p], at_source[s], n * len(costs), 0)
    for s, quota in quotas.items():
        arc(at_source[s], end, quota, 0)
    potential = [0] * len(out)
    while True:
        reach: list = [None] * len(out)
        came: list = [-1] * len(out)
        heap = [(0, start)]
        reach[start] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > reach[u]:
                continue
            for e in out[u]:
                if room[e] and (reach[to[e]] is None or d + price[e] + potential[u] - potential[to[e]] < reach[to[e]]):
                    reach[to[e]] = d + price[e] + potential[u] - potential[to[e]]
                    came[to[e]] = e
                    heapq.heappush(heap, (reach[to[e]], to[e]))
        if reach[end] is None:
            break
        furthest = max(d for d in reach if d is not None)
        potential = [x + (furthest if d is None else d) for x, d in zip(potential, reach, strict=True)]
        path, v = [], end
        while v != start:
            path.append(came[v])
            v = to[came[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flow: dict[tuple, dict] = {p: {} for p in names}
    for (p, s), e in routes.items():
        flow[p][s] = room[e ^ 1]
    return flow


def _cuts(sized: DataFrame, taken: dict[str, int], totals: dict[str, int], rows: int) -> DataFrame:
    """Per pattern key: whole passes, and the hash at which the partial pass ends."""
    spark = sized.sparkSession
    plan = [(k, taken[k] // n, taken[k] % n) if (n := totals[k]) else (k, 0, 0) for k in totals]
    parts = F.broadcast(spark.createDataFrame(plan, "__key string, __full bigint, __rest bigint"))
    buckets = max(1, -(-rows // BUCKET_ROWS))
    spread = sized.withColumn("__bucket", F.floor((F.shiftrightunsigned("__hash", 32).cast("double") * buckets) / F.lit(2.0**32)).cast("int"))
    summed = spread.groupBy("__key", "__bucket").agg(F.sum("size").alias("__sum"))
    so_far = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut_at = (
        summed.withColumn("__before", F.coalesce(F.sum("__sum").over(so_far), F.lit(0)))
        .join(parts, "__key")
        .where("__rest > 0 and __before < __rest and __before + __sum >= __rest")
        .select("__key", "__bucket", (F.col("__rest") - F.col("__before")).alias("__in_bucket"))
    )
    ties = spread.join(F.broadcast(cut_at), ["__key", "__bucket"]).groupBy("__key", "__hash", "__in_bucket").agg(F.sum("size").alias("__block"))
    upto = Window.partitionBy("__key").orderBy("__hash_order").rowsBetween(Window.unboundedPreceding, -1)
    point = (
        ties.withColumn("__hash_order", F.shiftrightunsigned("__hash", 1))
        .withColumn("__before", F.coalesce(F.sum("__block").over(upto), F.lit(0)))
        .where("__before < __in_bucket and __before + __block >= __in_bucket")
        .select("__key", F.col("__hash_order").alias("__cut"), (F.col("__in_bucket") - F.col("__before")).alias("__part"), "__block")
    )
    return parts.join(point, "__key", "left")


def mix(
    docs: DataFrame,
    sources: Column,
    weights: dict | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_passes: int = 3,
    seed: int = 7,
    cycle: Sequence[float] = (1, 2, 3),
) -> DataFrame:
    """``docs`` with ``__size``, ``__sources``, ``__taken`` (words the mix takes, repeats counted),
    and, for the document's first source, ``__source_size`` and ``__target``.

    ``sources`` is an array of the sources a document belongs to; an empty one takes no part. A
    source's size is that of all its documents. ``weights`` per source, or a cycle over their code
    point order (NULL last). A pass goes over a pattern's documents in the order of a seeded hash of
    id and size; the partial pass ends within one document, of which it takes some words (equal
    documents that tie there share them). NULL and wordless texts have size 0 and are never taken.
    An empty table gives no rows. Reruns agree.
    """
    where = F.array_sort(F.array_distinct(sources))
    size = word_count(text_of(text_col))
    marked = docs.withColumns({"__size": size, "__sources": where})
    marked = marked.withColumns({"__key": F.to_json("__sources"), "__hash": F.xxhash64(F.lit(seed), F.col(id_col), F.col("__size"))})
    sized = stored(marked.select("__key", "__sources", F.col("__size").alias("size"), "__hash"), "sized")
    totals = sized.where(F.size("__sources") > 0).groupBy("__key").agg(F.first("__sources").alias("members"), F.sum("size").alias("words"), F.count("*").alias("rows"))
    found = totals.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    sizes: dict = {}
    for r in found:
        for s in r["members"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    targets = shares(sizes, weights or cycled_weights([*sizes], cycle), most_passes) if sizes else {}
    patterns = {tuple(r["members"]): r["words"] for r in found}
    costs = [k * (k + 1) // 2 for k in range(most_passes)]
    flow = route(patterns, {s: round(t) for s, t in targets.items()}, costs)
    taken = {r["__key"]: sum(flow[tuple(r["members"])].values()) for r in found}
    cuts = _cuts(sized, taken, {r["__key"]: r["words"] for r in found}, sum(r["rows"] for r in found))
    facts_of = docs.sparkSession.createDataFrame(
        [(r["__key"], sizes[r["members"][0]], float(targets[r["members"][0]])) for r in found], "__key string, __source_size bigint, __target double"
    )
    order = F.shiftrightunsigned("__hash", 1)
    extra = F.when(order < F.col("__cut"), F.col("__size")).when(order == F.col("__cut"), F.floor(F.col("__size") * F.col("__part") / F.col("__block")).cast("long"))
    both = stored(cuts.join(F.broadcast(facts_of), "__key"), "cuts")
    return (
        marked.join(F.broadcast(both), "__key", "left")
        .withColumn("__taken", F.coalesce(F.col("__full") * F.col("__size"), F.lit(0)) + F.coalesce(extra, F.lit(0)))
        .select(*docs.columns, "__size", "__sources", "__taken", "__source_size", "__target")
    )


def mixed_rows(docs: DataFrame, sources: Column, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document once for each whole pass, once more if at least
    half of it is taken in the partial pass, and not at all if nothing is."""
    found = mix(docs, sources, **options)
    copies = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size") + F.lit(0.5))).otherwise(0).cast("int")
    return found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``, for one source each."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    found = mix(rows, F.array("source"))
    return found.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))
