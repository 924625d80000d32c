"""Each operator on a small table with hard cases, against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wiretide.llm import attention, graph, language, lm_score, mixing, near_dedup, quality, repeats, sharding, text, toxicity
from wiretide.llm.decontamination import contamination_report, decontaminate
from wiretide.llm.exact_dedup import exact_duplicates

COLUMNS = "doc_id bigint, text string, lang string, source string, node string, shard string, size string, __key string"
PROSE = " ".join(f"word{i % 97} and thing{i % 89}" for i in range(200))
CHANGED = PROSE.replace("word5 ", "other ")


def cases():
    """NULLs, empty and very long texts, copies, near copies, repeated rows."""
    texts = [None, "", " \t\n", "Hello", "hello ", PROSE, PROSE, CHANGED, PROSE.upper(), "x " * 3, "é ü ß", "12 34", PROSE * 60, "a" * 5000, PROSE[:150], "one two three four five six seven"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", "n", "s", "z", "k") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_word_hashes_follow_words():
    data = np.frombuffer("ab ab  éa\tab".encode(), np.uint8)
    starts, ends, first = text.words(data, np.array([0, 5, len(data)]), text.NOT_SPACE)
    h = text.word_hashes(data, starts, ends)
    assert first.tolist() == [0, 2, 4] and h[0] == h[1] == h[3] != h[2]
    assert (text.window_hashes(h, 2)[:1] == text.window_hashes(h[:2], 2)).all()


def test_exact(docs, empty):
    found = exact_duplicates(docs, heavy=4).collect()
    groups = {}
    for r in cases():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0]))
    assert len(found) == len(cases())
    wanted = {i: (min(g)[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, i in g}
    assert all((r.keep_id, r.group_size, r.text_sha256) == wanted[r.doc_id] and r.kept == (r.doc_id == r.keep_id) for r in found)
    assert exact_duplicates(empty).count() == 0


def test_near(docs, empty):
    wanted = brute.near_duplicates([(r[0], r[1]) for r in cases()])
    found = near_dedup.near_duplicates(docs, shingle=4).collect()
    assert len(found) == len(cases()) and all((r.n_shingles, r.component_id) == wanted[r.doc_id] for r in found)
    kept = near_dedup.keep_one(docs, shingle=4)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in wanted.values()})
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_groups_larger_than_a_block(spark, monkeypatch):
    """A group cut into many blocks keeps all links, the exact way for large groups."""
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[:k] + [f"new{k}"] + base[k + 1 :])) for k in range(60)]
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BUCKET", 10)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=4).collect()
    wanted = brute.near_duplicates(rows)
    assert all(r.component_id == wanted[r.doc_id][1] for r in found)


def test_odd_sketches_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.r_[a[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)]
    s = near_dedup.odd_sketches(near_dedup.signatures(np.r_[a, b], np.array([0, 1000])))
    bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
    assert near_dedup.most_bits(0.95) < bits < near_dedup.most_bits(0.65)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_repeats(docs, empty, monkeypatch):
    rows = cases()
    wanted = brute.repeats([(i, r[1]) for i, r in enumerate(rows)])  # rows repeated with their id are copies
    for most in (repeats.MOST_VARIANTS, 1):
        monkeypatch.setattr(repeats, "MOST_VARIANTS", most)
        found = repeats.cut_repeats(docs).collect()
        assert len(found) == len(rows)
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted[r.doc_id] for r in found)
    assert repeats.cut_repeats(empty).count() == 0


def test_previous_factors_keep_the_first_copy():
    rng = np.random.default_rng(2)
    a = rng.integers(97, 123, 260, dtype=np.uint8)
    data = np.r_[a, rng.integers(65, 91, 300, dtype=np.uint8), a]
    earlier, later = repeats.repeated(data, np.arange(len(data) - repeats.LENGTH + 1))
    assert np.flatnonzero(later).tolist() == list(range(61)) and np.flatnonzero(earlier).tolist() == list(range(560, 621))


def test_decontamination(spark, docs, empty):
    items = [(1, "thing3 word4 and thing4 word5 and thing5 word6 and thing6 word7 and thing7"), (2, "Hello"), (3, None), (4, "..."), (2, "Hello")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = brute.contamination([(r[0], r[1]) for r in cases()], [(i, t) for i, t in items])
    found = contamination_report(docs, bench).collect()
    assert len(found) == len(cases()) and all(tuple(r)[1:] == wanted[r.doc_id] for r in found)
    assert contamination_report(empty, bench).count() == 0
    assert contamination_report(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = {r.doc_id: r.text for r in decontaminate(docs, bench, remove="spans").collect()}
    assert clean[3] == "" and clean[15] == cases()[15][1] and decontaminate(docs, bench).columns == docs.columns


def test_decontamination_in_parts(spark, docs, monkeypatch):
    from wiretide.llm import decontamination

    bench = spark.createDataFrame([(i, PROSE[i * 40 : i * 40 + 200]) for i in range(6)], "item_id bigint, text string")
    whole = sorted(map(tuple, contamination_report(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontamination, "PART_BYTES", 300)
    assert sorted(map(tuple, contamination_report(docs, bench).collect()), key=repr) == whole


def test_sharding(docs, empty):
    plan = sharding.shard_plan(docs, 5).collect()
    assert len(plan) == len(cases())
    for shard in range(5):
        slots = sorted(r.slot for r in plan if r.shard == shard)
        assert slots == list(range(len(slots)))
    texts = {r[0]: (r[1] or "").encode() for r in cases()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.grown_shard in (r.shard, 5) for r in plan)
    assert sharding.shard_plan(empty).count() == 0


def test_sharding_by_weight(spark):
    rows = sharding.assign_shards(spark.range(20_000).withColumnRenamed("id", "doc_id"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in rows}[1] - 15_000) < 300


def test_mixing(docs, empty):
    found = mixing.mix_plan(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = {}, {}, {}
    source = {r[0]: r[3] for r in cases()}
    for r in found:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 3 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
    assert len(found) == len(cases()) and sum(sizes.values()) == sum(count(r[1]) for r in cases())
    assert all(r.source_size == sizes[source[r.doc_id]] for r in found)
    assert target == pytest.approx(mixing.shares(sizes, mixing.cycled_weights([*sizes]), 3))
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)
    assert mixing.mix_plan(empty).count() == 0


def test_flow_uses_cheap_passes_first():
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 120, "b": 80})
    assert sum(f.get("a", 0) for f in flow.values()) == 120 and sum(f.get("b", 0) for f in flow.values()) == 80
    assert sum(flow[("a",)].values()) <= 100 and sum(flow[("a", "b")].values()) <= 100
    assert mixing.route({("a",): 10}, {"a": 25})[("a",)] == {"a": 25}


def test_language(spark, docs, empty):
    words = {"aa": "kali moru tiva", "bb": "strunz gwelk brasht"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.permutation(words[k].split() * 6)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    table = spark.createDataFrame(rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 !", "aa")], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in language.language_report(table).collect()}
    assert all(found[i].lang_pred == k for i, _, k in rows) and {found[i].lang_pred for i in (900, 901, 902)} == {"und"}
    network = language.learned(table)
    spans = language.spans(network, "kali moru kali moru tiva kali")
    assert spans[0][0] == 0 and spans[-1][1] == 29 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(b - a for a, b, k in spans if k == "aa") > 20
    assert language.language_report(empty).count() == 0
    assert {r.lang_pred for r in language.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients():
    network = language.Network(["a", "b"])
    ids, labels = np.random.default_rng(0).integers(0, 256, (6, 5)), np.array([0, 1, 1, 0, 1])
    _, grads = network.gradients(ids, labels)
    p, g = network.parameters()[1], grads[1]
    at = np.unravel_index(np.abs(g).argmax(), g.shape)
    p[at] += 1e-2
    up, _ = network.gradients(ids, labels)
    p[at] -= 2e-2
    down, _ = network.gradients(ids, labels)
    assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1)


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(4)
    filler = lambda: " ".join(rng.permutation([f"calm{i}" for i in range(60)])[:25])
    rows = [(i, filler() + (" you grumblesnark fool" if i % 4 == 0 else "")) for i in range(240)]
    hidden = [(1000, filler() + " GRUMBL3SNARK, fool"), (1001, filler() + " grumblеsnаrk fool"), (1002, None), (1003, ""), (1004, filler())]
    table = spark.createDataFrame(rows + hidden, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)] + [(5000, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity_report(table, labels).collect()}
    assert all(found[i].predicted == (i % 4 == 0) for i, _ in rows)
    assert [found[i].predicted for i in range(1000, 1005)] == [1, 1, 0, 0, 0] and all(0 <= r.score <= 1 for r in found.values())
    assert toxicity.toxicity_report(empty, labels).count() == 0
    assert toxicity.toxicity_report(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_exception_phrases():
    machine = toxicity.Lexicon({" ciown ": 5.0}).automaton()
    assert toxicity.matched(machine, "A clown fish swims")[1] == 0 and toxicity.matched(machine, "What a CL0WN!")[1] == 5


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    words = [f"plain{chr(97 + j % 20)}{chr(97 + j // 20)}" for j in range(300)]
    good = [(i, " ".join(rng.choice(words, 60)) + ".") for i in range(150)]
    bad = [(1000 + i, "%%% ".join(rng.choice(words, 60)) + "$$$") for i in range(30)]
    found = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(good + bad, "doc_id bigint, text string")).collect()}
    assert np.mean([found[i].kept for i, _ in good]) > 0.95 and np.mean([found[i].kept for i, _ in bad]) < 0.1
    assert quality.score_quality(docs).count() == len(cases()) and quality.score_quality(empty).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) for a in (0.95, 0.8, 0.7)], axis=1) * 2 - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, right = quality.label_model(patterns, counts.astype(float))
    assert np.argmax(right) == 0 and good[(patterns == 1).all(axis=1)][0] > 0.9


def test_lm(docs, empty):
    rows = cases()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t)) + [None]
    train = [w for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1 for w in split(r[1])]
    counts = {w: train.count(w) for w in {w for r in rows for w in split(r[1])}}
    known = len({w for w in train})
    found = lm_score.score_texts(docs).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        own = split(texts[r.doc_id])
        base = sum(np.log10((counts[w] + 0.5) / (len(train) + 0.5 * (known + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), len(train))
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert lm_score.score_texts(empty).count() == 0


def small_model(seed=7):
    """A model over 12 ids with random weights, and sequences for it."""
    rng = np.random.default_rng(seed)
    group = np.r_[np.arange(8), 8, 8, 9, 9]
    model = attention.Attention(group, rng.normal(size=(12, attention.DEPTH)).astype(np.float32))
    model.direct[:] = rng.normal(size=model.direct.shape)
    model.distance[:] = rng.normal(size=model.distance.shape)
    return model, [rng.integers(0, 12, n) for n in (50, 1, 17, 40, 16)]


def joined(sequences):
    return np.concatenate(sequences).astype(np.int32), np.cumsum([0, *map(len, sequences)])


def test_attention_is_a_causal_probability():
    model, sequences = small_model()
    windows = attention.Windows(*joined(sequences[:1]), model.start_id)
    ids, real, target = windows.take(np.arange(len(windows)))
    ends = [np.flatnonzero(model.group == g)[:1] for g in range(10)]
    whole = sum(np.exp(model.log_probabilities(ids, real, np.full_like(target, e[0]))) for e in ends)
    logits = np.exp(model.log_probabilities(ids, real, target))
    assert (whole[real[:, attention.BEFORE :]] <= 1 + 1e-4).all() and (logits > 0).all()
    changed = sequences[0].copy()
    changed[30:] = 5
    again, real2, _ = attention.Windows(*joined([changed]), model.start_id).take(np.arange(len(windows)))
    a, b = model.log_probabilities(ids, real, target), model.log_probabilities(again, real2, target)
    assert np.allclose(a.ravel()[:31], b.ravel()[:31], atol=1e-5)


def plain_scores(model, counts, sequences):
    """Scores token by token, with a loop over all earlier tokens of the window."""
    out = []
    for s in sequences:
        inputs, score = [model.start_id, *s[:-1].tolist()], 0.0
        vector = lambda table, lift, i: table[model.group[i]].astype(np.float64) + model.embed[i].astype(np.float64) @ lift
        for t, token in enumerate(s.tolist()):
            first = max(0, t // attention.STRIDE * attention.STRIDE - attention.BEFORE)
            q = vector(model.query, model.lift_q, inputs[t])
            seen = range(first, t + 1)
            scores = np.array([q @ vector(model.key, model.lift_k, inputs[j]) / attention.WIDTH**0.5 + model.distance[t - j] for j in seen])
            weight = np.exp(scores - scores.max())
            context = sum(w * vector(model.value, model.lift_v, inputs[j]) for w, j in zip(weight / weight.sum(), seen, strict=True))
            logits = context @ model.out + model.direct[model.group[inputs[t]]]
            p = np.exp(logits - logits.max())
            score += np.log10(p[model.group[token]] / p.sum()) + counts.log10[model.group[inputs[t]], token]
        out.append(score)
    return out


def test_scores_equal_a_plain_loop():
    model, sequences = small_model()
    counts = attention.Counts(model.group[:-1], np.random.default_rng(3).normal(-1, 0.3, (attention.GROUPS + 1, 12)).astype(np.float32))
    ids, offsets = joined(sequences)
    loose = attention.token_logs(model, counts, ids, offsets, batch=3)
    model.settle()
    assert np.allclose(np.add.reduceat(loose, offsets[:-1]), plain_scores(model, counts, sequences), atol=1e-3)
    assert np.allclose(attention.token_logs(model, counts, ids, offsets), loose, atol=1e-3)


def test_words_encoded_together_are_those_encoded_alone():
    subwords = lm_score.Subwords(open(lm_score.VOCABULARY, "rb").read())
    words = [w.encode() for w in ["the", "a1b2", "x--y", "(!)", "é", "Straße", "a\u00a0b\u2003", "12345678", "\x01\x1c", "z" * 239, "z" * 240, "q" * 900, "don't", "日本語", "\u00a0"]]
    whole = b"  ".join(words)
    at = np.cumsum([0, *(len(w) + 2 for w in words)])[:-1]
    flat, n = subwords.of_all(whole, np.stack([at, at + [len(w) for w in words]], axis=1))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [subwords.of(w) for w in words]


def test_mixture_of_words():
    logs, counts = np.array([-3.0, -400.0, -2.0]), np.array([5, 5, 0])
    own, part = (1 - lm_score.ATTENTION) * 5 / 50, lm_score.ATTENTION
    wanted = [np.log10(part * 10**-3.0 + own), np.log10(own), np.log10(part) - 2]
    assert np.allclose(lm_score.mixture(logs, counts, 50), wanted) and (lm_score.mixture(logs, counts, 0) == logs).all()


def test_gradients_are_those_of_the_mean_loss():
    model, sequences = small_model(9)
    windows = attention.Windows(*joined(sequences), model.start_id)
    batch = windows.take(np.arange(len(windows)))
    scored = batch[1][:, attention.BEFORE :]

    def loss():
        return -(model.log_probabilities(*batch) * scored).sum(dtype=np.float64) / scored.sum()

    rng = np.random.default_rng(1)
    for p, g in zip(model.parameters(), model.gradients(*batch), strict=True):
        way = rng.normal(size=p.shape).astype(np.float32)
        way *= g != 0 if (g != 0).any() else 1
        kept, step = p.copy(), 3e-3
        p[...] = kept + step * way
        up = loss()
        p[...] = kept - step * way
        down = loss()
        p[...] = kept
        assert (up - down) / (2 * step) == pytest.approx(float((g * way).sum()), rel=0.05, abs=2e-3)


def test_fit_lowers_the_loss():
    model, _ = small_model()
    model.direct[:] = 0
    sequences = [np.tile([1, 4, 2, 9, 3], 30) for _ in range(6)]
    ids, offsets = joined(sequences)
    windows = attention.Windows(ids, offsets, model.start_id)
    before = model.log_probabilities(*windows.take(np.arange(len(windows)))).mean()
    model.fit(ids, offsets, 1, 0.02, 120)
    assert model.log_probabilities(*windows.take(np.arange(len(windows)))).mean() > before + 1


def test_lm_learns_from_every_training_token(spark):
    """More texts than the former sample held; the words of the later ones were unknown to it."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(PROSE.split(), 30)) + f" {chr(0x4E00 + i)} end") for i in range(1800)]
    lines = open(lm_score.VOCABULARY, "rb").read()
    subwords = lm_score.Subwords(lines)
    plain = [[x for w in t.encode().lower().split() for x in subwords.of(w)] + [subwords.end] for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    single = np.bincount(np.concatenate(plain), minlength=subwords.end + 1)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    chunks = table.mapInArrow(lm_score._chunked(spark.sparkContext.broadcast(lines)), lm_score.CHUNK).cache()
    model, counts, windows = lm_score.learned(chunks, single, subwords.end)
    assert windows == sum(-(-len(s) // attention.STRIDE) for s in plain) and len(plain) < len(rows)
    near = attention.frequent(single)
    beside = np.zeros((2 * (attention.SINGLE + 1), len(single)), np.int64)
    for s in map(np.array, plain):
        np.add.at(beside, (near[s[:-1]], s[1:]), 1)
        np.add.at(beside, (attention.SINGLE + 1 + near[s[1:]], s[:-1]), 1)
    assert (counts.group == attention.group_tokens(near, beside)).all()
    assert (model.embed[:-1] == attention.embeddings(beside)).all()
    assert (counts.group[single > 0] < attention.GROUPS - 1).all()
    assert np.isfinite(model.packed()).all()
