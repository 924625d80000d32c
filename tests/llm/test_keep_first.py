"""Repeats with their first copy kept."""

import pytest

from tests.llm.test_operators import PROSE, cases
from wiretide.llm import repeats


def plain(rows, length=repeats.LENGTH):
    seen, out = set(), []
    for doc, text in sorted(((i, t or "") for i, t in rows), key=lambda r: r[0]):
        t = text.encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(t[i : i + length])
        edges = [i for i in range(len(t) + 1) if (i < len(t) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((doc, len(t), list(zip(edges[::2], edges[1::2])), bytes(c for c, x in zip(t, gone) if not x)))
    return sorted(out)


@pytest.mark.parametrize("most", [3000, 1])
def test_first_copies_stay(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_VARIANTS", most)
    rows = [(r[0], r[1]) for r in cases()]
    # a stretch that occurs twice, and parts of it in other surroundings before and after
    rows += [(-1, "front " + PROSE[300:700] + " back"), (50, "é" * 150 + PROSE[100:900]), (51, "other " + PROSE[100:900])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = repeats.remove_repeats(docs, keep="first").collect()
    assert sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found) == plain(rows)
