"""What the models learn from: all documents that they may, and not a sample."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import gru_lm, order_minhash, spans, toxicity
from granary.llm.common import PUNCT, Words, chunks

from .test_brute import prose


def test_toxicity_learns_from_all_labelled_documents(spark, monkeypatch):
    n = 13_500  # a third of them toxic
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    seen = []

    def trained(rows, keep):
        seen.extend((r["toxic"], r["count"]) for r in rows.groupBy("toxic").count().collect())
        return toxicity.first_state(*toxicity._shares(rows), n / 3, n - n / 3, np.random.default_rng(1))

    monkeypatch.setattr(toxicity, "trained", trained)
    assert toxicity.fit(docs, labels) is not None
    assert dict(seen) == {1: n // 3, 0: n - n // 3}


def test_toxicity_in_several_tasks(spark, monkeypatch):
    """Rounds of tasks that each hold a part tell held-out documents apart like one task does, and again alike."""
    monkeypatch.setattr(toxicity, "LEARN_BYTES", 40_000)
    rows = [(i, prose(20 + i % 30, i, 300) + (" badword9 " if i % 7 == 0 else " fine ") + prose(20, i + 9000, 300), "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    held = toxicity.bucket(F.col("doc_id"), 4) == 2
    parts = []
    fitted = toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda rows, keep: parts.append(rows.rdd.getNumPartitions()) or fitted(rows, keep))
    got = toxicity.score(docs, toxicity.fit(docs, labels, ~held)).where(held).collect()
    right = [(x["score"] >= 0.3) == (x["doc_id"] % 7 == 0) for x in got]
    assert parts[0] > 1 and len(got) > 150 and sum(right) / len(right) > 0.97


@pytest.mark.parametrize("seed", [1, 2])
def test_toxicity_thresholds_of_all_rows(spark, seed):
    """The thresholds are those of the sorted scores of all documents set aside; a sample of 4,000 toxic and 8,000 clean ones had others."""
    rng, n = np.random.default_rng(seed), 30_000
    toxic = (rng.random(n) < 0.3).astype(np.int32)
    z = (rng.normal(-1, 2, n) + 3 * toxic).astype(np.float32)
    lang = np.array(["", "de", "en", "xx"], object)[rng.choice(4, n, p=[0.1, 0.3, 0.599, 0.001])]
    bits = z.view(np.int32)
    key = np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits)
    rows = list(zip(lang.tolist(), toxic.tolist(), z.tolist(), key.tolist(), strict=True))
    scale = (0.9, -0.2)
    got = toxicity.thresholds(spark.createDataFrame(rows, "lang string, toxic int, z float, key int"), scale)
    score = 1 / (1 + np.exp(-(z.astype(np.float64) * scale[0] + scale[1])))
    want = {}
    for k in ("", "de", "en"):
        mask = (lang == k) | (k == "")
        clean, bad = np.sort(score[mask & (toxic == 0)]), np.sort(score[mask & (toxic == 1)])
        edge = clean[int(np.ceil(len(clean) * (1 - toxicity.FALSE_ALARMS))) - 1]
        want[k] = min(0.95, max(0.3, (edge + bad[bad > edge][0]) / 2))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_text_steps_hold_little():
    """Several MB of texts are hashed, sketched and cut into spans in steps that hold at most 64 MB at once."""
    text = "".join(prose(600, i, 20_000) for i in range(40)).encode()
    data = np.frombuffer(text * (1 + (6 << 20) // len(text)), np.uint8)
    offsets = np.append(np.arange(0, len(data), 4000), len(data))
    for step in (lambda d, o: spans.Spans(d, o), lambda d, o: order_minhash.sketches(*order_minhash.kmers(d, o)), lambda d, o: toxicity.features(Words(d, o, PUNCT))):
        tracemalloc.start()
        for lo, hi in chunks(offsets):
            step(data, offsets[lo : hi + 1])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20, peak


@pytest.mark.parametrize("size", [0.1, 40.0])
def test_lm_probabilities_with_bounds_on_logits(size):
    """Where the weights bound the logits, their greatest isn't looked for; where they don't, it is. Both are the plain softmax."""
    rng = np.random.default_rng(3)
    net = gru_lm.fresh_net(rng.integers(1, 1000, gru_lm.VOCABULARY).astype(float))
    net.to_class[:] = rng.normal(0, size, net.to_class.shape)
    net.to_word[:] = rng.normal(0, size, net.to_word.shape)
    assert gru_lm._bounded(net.to_word, net.word_bias) == (size < 1)
    states, targets = rng.uniform(-1, 1, (500, gru_lm.HIDDEN)).astype(np.float32), rng.integers(0, gru_lm.VOCABULARY, 500)
    got = gru_lm.log_probabilities(net, states, targets)
    cls, word, x = targets // gru_lm.CLASS_SIZE, targets % gru_lm.CLASS_SIZE, states.astype(float)
    log = lambda z: z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
    want = log(x @ net.to_class.astype(float) + net.class_bias)[np.arange(500), cls]
    want += log(np.einsum("nh,nhw->nw", x, net.to_word[cls].astype(float)) + net.word_bias[cls])[np.arange(500), word]
    assert np.isfinite(got).all() and np.abs(got - want).max() < 1e-3 * max(1, size)


def test_lm_slopes_of_windows_with_and_without_unknown_words():
    """A window without unknown words, and one of them alone, have slopes."""
    rng = np.random.default_rng(4)
    net = gru_lm.fresh_net(np.ones(gru_lm.VOCABULARY))
    for ids in (rng.integers(2, 50, (8, 5)), np.full((8, 5), gru_lm.UNKNOWN)):
        fresh, real = np.zeros((8, 5), np.float32), np.ones((8, 5), np.float32)
        _, g, _ = gru_lm.gradient(net, ids.astype(np.int32), ids.astype(np.int32), fresh, real, np.zeros((5, gru_lm.HIDDEN), np.float32))
        assert set(np.flatnonzero(np.abs(g.embed).sum(1))) == set(np.unique(ids))


def test_lm_classes_are_taken_in_few_groups():
    """Each member once, and not a pass a class: a window's 6,144 targets took 64 passes of small products."""
    rng = np.random.default_rng(5)
    cls = np.minimum(rng.zipf(1.3, 6144) - 1, gru_lm.CLASSES - 1)
    groups = list(gru_lm._by_class(cls))
    assert len(groups) < 20 and len(set(cls)) == gru_lm.CLASSES
    assert sorted(i for _, at in groups for i in at[at < len(cls)].tolist()) == list(range(len(cls)))
    assert all((cls[row[row < len(cls)]] == c).all() for some, at in groups for c, row in zip(some, at, strict=True))
    assert sum(at.size for _, at in groups) < 1.3 * len(cls) and not list(gru_lm._by_class(cls[:0]))


def test_lm_sums_by_word():
    rng = np.random.default_rng(6)
    for ids in (np.minimum(rng.zipf(1.2, 5000), 900), np.full(33, 7), rng.permutation(gru_lm.VOCABULARY)[:64]):
        rows, words = rng.normal(size=(3, len(ids), gru_lm.HIDDEN)).astype(np.float32), np.unique(ids)
        want = np.stack([rows[:, ids == w].astype(float).sum(1) for w in words], 1)
        assert np.abs(gru_lm._sums_by_word(rows, ids, words) - want).max() < 1e-3


def test_lm_arrays_that_are_taken_again():
    """Windows of several sizes, one after the other over one set of arrays, have the slopes and scores that each has alone."""
    rng, spare = np.random.default_rng(7), gru_lm.Spare()
    net = gru_lm.fresh_net(rng.integers(1, 1000, gru_lm.VOCABULARY).astype(float))
    for steps, lanes in ((8, 5), (32, 40), (3, 1), (32, 7)):
        feed, goal = (rng.integers(0, gru_lm.VOCABULARY, (steps, lanes)).astype(np.int32) for _ in range(2))
        fresh, real, state = (rng.random((steps, lanes)) < 0.2).astype(np.float32), np.ones((steps, lanes), np.float32), rng.uniform(-1, 1, (lanes, gru_lm.HIDDEN)).astype(np.float32)
        loss, g, last = gru_lm.gradient(net, feed, goal, fresh, real, state, spare)
        alone = gru_lm.gradient(net, feed, goal, fresh, real, state)
        assert loss == alone[0] and all((a == b).all() for a, b in zip((*g, last), (*alone[1], alone[2]), strict=True))
        states, last = gru_lm.run_window(net, feed, fresh, state, None, None, spare)
        assert np.allclose(last, alone[2])
        got = gru_lm.log_probabilities(net, states.reshape(-1, gru_lm.HIDDEN), goal.ravel(), spare)
        assert abs(got.mean() + loss) < 1e-4


def test_lm_look_up():
    """The most frequent token with the same first bits is met first, tokens that aren't there are not found, and the
    vocabulary alone has the same places."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64) * np.uint64(2)  # all even
    hashes[5] = gru_lm.END
    count = np.sort(rng.integers(1, 1000, len(hashes)))[::-1]
    c = gru_lm.head_counts(hashes, count, int(count.sum()), len(hashes))
    top = c.hash >> np.uint64(64 - gru_lm._TOP)
    assert (np.diff(top.astype(np.int64)) >= 0).all() and (np.diff(c.count)[top[1:] == top[:-1]] <= 0).all()
    at = gru_lm.look_up(c, hashes)
    assert (c.hash[at] == hashes).all() and (gru_lm.look_up(c, hashes[6:] | np.uint64(1)) == -1).all()
    known = gru_lm.vocabulary(c)
    assert len(known.hash) == gru_lm.VOCABULARY - 1 and (gru_lm.slots(known, hashes) == gru_lm.slots(c, hashes)).all()
    none = gru_lm.head_counts(hashes[:0], count[:0], 0, 0)
    assert (gru_lm.slots(gru_lm.vocabulary(none), hashes[:9]) == gru_lm.UNKNOWN).all()


def test_toxicity_calibration_compiles_nothing_new(spark, monkeypatch):
    """What the driver compiles for the steps of the calibration doesn't grow with their number, and the scale is that of the whole sums."""
    monkeypatch.setattr(toxicity, "thresholds", lambda judged, scale: {"": 0.5})
    model, compiled = toxicity._model(np.zeros(((1 << toxicity.BITS) + 55, toxicity.DIM), np.float32)), []
    for seed in (1, 2):
        rng = np.random.default_rng(seed)
        toxic = (rng.random(3000) < 0.3).astype(np.int32)
        z = (rng.normal(-1, 2, 3000) + 2 * toxic).astype(np.float32)
        judged = spark.createDataFrame(list(zip(["en"] * 3000, toxic.tolist(), z.tolist(), strict=True)), "lang string, toxic int, z float").repartition(3)
        judged.count()
        count = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount
        before = count()
        got = toxicity.calibrated(model, judged).scale
        compiled.append(count() - before)
        x, aim, beta = z.astype(np.float64), np.where(toxic == 1, 0.995, 0.005), np.array([1.0, 0.0])
        for _ in range(200):
            p = 1 / (1 + np.exp(-(x * beta[0] + beta[1])))
            w, off = p * (1 - p) + 1e-6, p - aim
            h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, np.array([(off * x).sum(), off.sum()]) + 1e-3 * (beta - [1, 0]))
            beta = beta - step / max(1.0, np.abs(step / [0.1, 0.5]).max())
        assert np.allclose(got, beta, rtol=0, atol=1e-6)
    assert compiled[1] <= 1
