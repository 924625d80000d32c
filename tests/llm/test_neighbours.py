"""Nearest neighbours by collision counts against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from wiretide.llm import neighbours
from wiretide.llm.queries import QUERIES

COLUMNS = "vec_id bigint, embedding array<float>, label int, ids string, width int, block bigint"


def exact(rows, k=10, every=100):
    """rows: (id, vector); sorted (query id, rank, id, distance)."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, (q, v) in enumerate(good):
        if q is not None and q % every == 0:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i is not None, i or 0) for m, (i, x) in enumerate(good) if m != n and len(x) == len(v))
            out += [(q, rank, i if named else None, d) for rank, (d, named, i) in enumerate(near[:k], 1)]
    return sorted(out, key=repr)


def recall(found, wanted):
    """Share of the wanted ranks whose distance was reached; copies at one distance count alike."""
    key = lambda r: (r[0], r[1], r[3])
    pairs = zip(sorted(found, key=key), sorted(wanted, key=key), strict=True)
    return np.mean([a[3] <= b[3] + 1e-12 for a, b in pairs])


def test_threshold_keeps_what_lies_at_the_radius():
    rng = np.random.default_rng(2)
    inside = (np.abs(rng.normal(size=(20_000, neighbours.PROJECTIONS))) <= neighbours.REACH).sum(axis=1)
    share = (inside >= neighbours.threshold()).mean()
    assert share >= neighbours.FOUND - 0.005 and (inside >= neighbours.threshold() + 1).mean() < neighbours.FOUND + 0.005


def test_usable_vectors():
    column = pa.array([[1.0, 2.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [3.0], [0.0, -1.0]], pa.list_(pa.float32()))
    rows, found = neighbours.usable(column)
    assert [r.tolist() for r in rows] == [[7], [0, 8]] and found[1].tolist() == [[1, 2], [0, -1]]


def test_hard_cases(spark):
    """NULLs, zero and broken vectors, other widths, copies, repeated and missing ids, ties."""
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, vectors[i % 50]) for i in range(150)]
    rows += [(100, [1.0, None] * 4), (200, None), (300, []), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [float("inf")] + [1.0] * 7), (700, [1.0, 2.0]), (701, [1.0, 3.0]), (800, [5.0] * 3), (None, vectors[0]), (0, vectors[0]), (0, vectors[55])]
    rows += [(900 + i, vectors[7]) for i in range(40)]
    table = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], COLUMNS).repartition(3)
    found = [tuple(r) for r in neighbours.nearest_neighbours(table).collect()]
    wanted = exact(rows)
    assert sorted((q, rank) for q, rank, _, _ in found) == sorted((q, rank) for q, rank, _, _ in wanted)
    assert recall(found, wanted) > 0.97
    tied = [r for r in found if r[0] == 900]
    assert [r[1:] for r in sorted(tied, key=lambda r: r[1])] == [(rank, i, 0.0) for rank, i in enumerate([7, 57, 107, *range(901, 908)], 1)]
    assert neighbours.nearest_neighbours(spark.createDataFrame([], COLUMNS)).count() == 0
    lone = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 2.5])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest_neighbours(lone).collect()] == [(100, 1, 1, 0.5)]


def test_parts_and_blocks_change_nothing_but_chance(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(1000 * rng.normal(size=(900, 16)).astype(np.float32))]
    monkeypatch.setattr(neighbours, "BLOCK", 70)
    monkeypatch.setattr(neighbours, "PART", 20)
    monkeypatch.setattr(neighbours, "SAMPLE", 100)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(2)
    found = [tuple(r) for r in neighbours.search(neighbours.build_index(table), k=5, every=10).collect()]
    wanted = exact(rows, 5, 10)
    assert len(found) == len(wanted) and recall(found, wanted) > 0.95


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = [tuple(r) for r in QUERIES["op11_nearest_neighbours"](spark, folder).collect()]
    wanted = exact(rows)
    distance = {(q, i): d for q, i, d in ((q, i, d) for q, _, i, d in wanted)}
    assert len(found) == len(wanted) and recall(found, wanted) > 0.95
    assert all(abs(d - distance[q, i]) < 1e-12 for q, _, i, d in found if (q, i) in distance)
