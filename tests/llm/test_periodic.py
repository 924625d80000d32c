"""Periodic runs against trying every period."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from wiretide.llm import periodic
from wiretide.llm.queries import QUERIES

COLUMNS = "doc_id bigint, text string, runs string, collapsed string, id string, __w string, __n int"


def _runs(texts):
    ids = np.concatenate([np.array(t, np.int64) for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    out = [[] for _ in texts]
    for d, s, m, p in zip(*(x.tolist() for x in periodic.find_runs(ids, first)), strict=True):
        out[d].append((s, m, p))
    return out


piece = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9))
texts = st.lists(st.lists(piece, max_size=5).map(lambda ps: [x for unit, k in ps for x in unit * k]), max_size=4)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_equal_to_trying_every_period(found):
    assert _runs(found) == [brute.runs(t) for t in found]


def test_one_word_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    square_free_ends = [0] * 5000 + [1] + [0, 1, 2] * 400 + list(range(50)) * 7
    assert _runs([b, square_free_ends, [0] * 23, [0] * 24]) == [brute.runs(b), brute.runs(square_free_ends), [], [(0, 24, 1)]]


def rows():
    verse = " ".join(f"w{i}" for i in range(30))
    out = [None, "", " \t\n", "one two", "x " * 24, "x\t" * 40, f"{verse} {verse}", f"{verse} {verse}\n{verse} tail", "a b " * 30 + "a b c " * 20, "é ü " * 3000, " ".join(f"t{i % 700}" for i in range(9000)), verse]
    cases = [(i, t, "r", "c", "i", "w", 1) for i, t in enumerate(out)]
    return cases + [(1000 + i, " ".join(f"p{j}" for j in range(i)), "r", "c", "i", "w", 1) for i in range(1, 120)] + [cases[6], (None, "y " * 30, None, None, None, None, None)]


def test_report(spark):
    wanted = brute.run_report([(r[0], r[1]) for r in rows()])
    found = periodic.run_report(spark.createDataFrame(rows(), COLUMNS).repartition(3)).collect()
    assert len(found) == len(rows()) and all(tuple(r)[1:] == wanted[r.doc_id] for r in found)
    assert any(r.doc_id is not None and r.doc_id >= 1000 and r.n_runs for r in found)
    assert periodic.run_report(spark.createDataFrame([], COLUMNS)).count() == 0


def test_collapsed_text_and_runs(spark):
    found = periodic.collapse_runs(spark.createDataFrame([(1, " go   " + "la di " * 12 + "end")], "doc_id bigint, text string")).first()
    assert found.collapsed == "go la di end" and [tuple(r) for r in found.runs] == [(1, 24, 2)] and found.n_words == 26


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, folder).collect()} == brute.run_report(docs)
