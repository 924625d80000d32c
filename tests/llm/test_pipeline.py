"""Stages of the pipeline on hard tables: no labels, names that clash, empty tables; and all of them
in a row against plain versions."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from tests.llm import brute
from wiretide.llm import language
from wiretide.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = ["__key", "__size", "__node", "__id", "__letter", "__score", "__lang", "__n_words0", "__all", "grown_shard", "__nth", "__bucket", "__before", "x0", "node", "shard"]
COLUMNS = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES)


@pytest.fixture(scope="module")
def clashing(spark):
    prose = [" ".join(f"{'abc'[i % 3]}word{(i * j) % 31}" for j in range(40)) for i in range(30)]
    texts = [*prose, prose[3], prose[4] + " tail", None, "", "123 456", "ok"]
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)], COLUMNS).repartition(3)


def test_names_that_clash(spark, clashing):
    """Each stage keeps every column and its values."""
    rows = {r.doc_id: r.asDict() for r in clashing.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, SMALL)
        own = [c if name != "sharding" or c != "shard" else "doc_shard" for c in clashing.columns]
        assert out.columns == own + (["shard", "slot"] if name == "sharding" else []), name
        found = out.collect()
        assert found, name
        for r in found:
            assert [r[c] for c in own] == list(rows[r.doc_id].values()), name


def test_unlabelled_and_empty_tables(spark, clashing):
    nameless = clashing.withColumn("lang", clashing["lang"].substr(9, 1))
    unlabelled = spark.createDataFrame([(r.doc_id, r.text, None, r.source, 1) for r in nameless.collect()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.language_id(spark, unlabelled, SMALL).collect()
    assert sorted(r.doc_id for r in kept) == [r.doc_id for r in sorted(unlabelled.collect()) if re.search("[a-z]", r.text or "")]
    empty = unlabelled.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name


def test_a_text_of_no_language_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.learned(docs)
    kept = {r.doc_id for r in language.of_a_language(docs, network).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    found = language.identify(docs, network).collect()
    weakest = min((r for r in found if r["__lang"] != "und"), key=lambda r: r["__score"])
    least = weakest["__score"] - 0.25 + 1e-9
    assert weakest.doc_id not in {r.doc_id for r in language.of_a_language(docs, network, least=least).collect()}


def test_stages_in_a_row(spark):
    """The chained run against plain versions: who is left after three stages, what the mixture
    takes from whom, and the law of the shards."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = [(i, r.text) for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")]
    left = [(i, rows[i].text) for i in sorted({c for _, c in brute.near_duplicates(left, 5).values()})]
    hit = brute.contamination(left, items)
    left = [i for i, _ in left if not hit[i][4]]
    out = corpus_pipeline.run(spark, SMALL).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text)) for i in left}
    share = Counter()
    for i in left:
        share[rows[i].source] += size[i]
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(share))}
    target, open_, rest = {}, dict(weight), float(sum(share.values()))
    while open_:
        whole = sum(open_.values())
        over = [s for s in open_ if rest * open_[s] / whole > 3 * share[s]]
        if not over:
            target |= {s: rest * w / whole for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3.0 * share[s]
            del open_[s]
        rest -= sum(target[s] for s in over)
    times = Counter(r.doc_id for r in out)
    assert set(times) <= set(left) and max(times.values()) <= 3
    for s, t in target.items():
        taken = sum(n * size[i] for i, n in times.items() if rows[i].source == s)
        assert abs(taken - t) <= max([size[i] for i in left if rows[i].source == s])
    shards = {r.doc_id: r.shard for r in QUERIES["op4_sharding"](spark, SMALL).collect()}
    assert all(r.shard == shards[r.doc_id] for r in out)
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_benchmark_in_parts(spark, monkeypatch):
    """Parts are scanned one after the other, each in a stage of its own, with the results of one."""
    from wiretide.llm import decontamination

    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontamination.contamination_report(docs, benchmark).collect()))
    written = []
    monkeypatch.setattr(decontamination, "PART_BYTES", 4000)
    kept = decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda df, what: written.append(what) or kept(df, what))
    parts = decontamination.contamination_report(docs, benchmark)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, parts.collect())) == whole
    assert len(written) > 2 and plan.count("MapInArrow") == 1
