"""The operators against brute force, exact round trips and held-out accuracy."""

import io
import itertools
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import decontaminate, gru_lm, html_cut, licenses, mixing, order_minhash, spans, toxicity, zip_warc
from granary.llm.common import Scratch, Words, utf8

import pyarrow as pa


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"v{r.randrange(vocabulary)}" + ("." if r.random() < 0.12 else "") for _ in range(n))


def edit(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(1)
    for _ in range(300):
        p, t = ([r.randrange(4) for _ in range(r.randrange(a, 14))] for a in (1, 0))
        assert decontaminate.myers(np.array(p), np.array(t, int))[0] == distance(p, t)
    items = [prose(40, 100 + i) for i in range(4)]
    texts = [prose(200, i) for i in range(6)]
    texts += [prose(60, 50) + " " + edit(items[i % 4], k, i) + " " + prose(60, 60) for i, k in enumerate([0, 3, 7, 12])]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    split = lambda s: re.findall(r"[a-z0-9]+", s.lower())
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if distance(split(x), split(t)) <= decontaminate.budget(40)}
    assert got == want and len(got) >= 3
    kept = decontaminate.clean(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_toxicity_held_out(spark):
    rows = [(i, prose(60 + i % 90, i, 300) + (" badword9 " if i % 7 == 0 else " fine ") + prose(30, i + 9000, 300), "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    held = toxicity.bucket(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.score(docs, model).where(held).collect()
    right = [(x["score"] >= 0.3) == (x["doc_id"] % 7 == 0) for x in got]
    assert len(got) > 150 and sum(right) / len(right) > 0.97
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    # whole texts count, however long, and wherever the word stands
    long_ = [(1, prose(60_000, 5, 300) + " badword9 " + prose(300, 6, 300)), (2, prose(60_000, 5, 300) + " fine " + prose(300, 6, 300)), (3, "badword9")]
    score = {x["doc_id"]: x["score"] for x in toxicity.score(spark.createDataFrame(long_, "doc_id long, text string"), model).collect()}
    assert score[1] >= 0.3 and score[2] < 0.3 and score[3] >= 0.3


@pytest.mark.parametrize("sf, auc, found, false", [("sf0.01", 0.7, 9, 1), ("sf0.1", 0.95, 110, 6)])
def test_toxicity_of_the_given_tables(spark, sf, auc, found, false):
    """Few hundred labels are enough to generalise from: held-out labelled documents."""
    sf_dir = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(F.broadcast(labels), "doc_id")
    held = toxicity.bucket(F.col("doc_id"), 4) == 2
    rows = toxicity.score(docs.where(held), toxicity.fit(docs.drop("toxic"), labels, ~held)).join(labels, "doc_id").collect()
    z = {k: [x["score"] for x in rows if x["toxic"] == k] for k in (0, 1)}
    assert np.mean([(a > b) + (a == b) / 2 for a in z[1] for b in z[0]]) >= auc
    assert (sum(x >= 0.3 for x in z[1]) >= found, sum(x >= 0.3 for x in z[0]) <= false) == (True, True), [sum(x >= 0.3 for x in z[k]) for k in (1, 0)]


def plain_logit(model, text):
    """By loops, in double precision."""
    data, offsets = utf8(pa.array([text]))
    rows = toxicity.features(Words(data, offsets, toxicity.PUNCT))
    if not rows.shape[1]:
        return float(model.offset)
    x = [sum(model.table[r].astype(float) for r in rows[:, t]) for t in range(rows.shape[1])]
    out, start, n = float(model.offset), 0, toxicity.FILTERS
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(n):
            at = lambda t: model.bias[i * n + f] + sum(float(x[t + j] @ model.kernel[:, start + j * n + f]) for j in range(width) if t + j < len(x))  # noqa: B023, E731
            out += max(0.0, max(map(at, range(len(x))))) * float(model.weight[i * n + f])
        start += width * n
    return out


def some_model(seed):
    rng, n = np.random.default_rng(seed), len(toxicity.WIDTHS) * toxicity.FILTERS
    f = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    return toxicity.Model(f(1 << toxicity.BITS, toxicity.DIM), f(toxicity.DIM, sum(toxicity.WIDTHS) * toxicity.FILTERS), f(n), f(n), 0.3, (0.5, -0.2), {"": 0.5, "de": 0.9})


def test_toxicity_by_hand(spark):
    model = some_model(2)
    texts = ["one", "two words", "Three words, here!", prose(40, 1), prose(300, 2), "", None, " ... ", "bad " * 50, prose(40, 1)]
    rows = spark.createDataFrame([(i if i < 9 else None, t, "de" if i == 3 else None, 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    got = {x["doc_id"]: x for x in toxicity.score(rows, model).collect()}
    assert len(got) == 10
    for i, t in enumerate(texts[:9]):
        want = 1 / (1 + math.exp(-(0.5 * plain_logit(model, t or "") - 0.2)))
        assert abs(got[i]["score"] - want) < 1e-4 and got[i]["threshold"] == (0.9 if i == 3 else 0.5)
    assert abs(got[None]["score"] - got[3]["score"]) < 1e-6
    kept = toxicity.reject(rows, model)
    assert kept.columns == rows.columns and {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["score"] < (0.5 if i is None else x["threshold"])}
    assert {x["score"] for x in kept.collect()} <= {7}


def test_toxicity_slopes_against_differences():
    model, r = some_model(5), random.Random(5)
    data, offsets = utf8(pa.array([prose(n, n) for n in (1, 2, 3, 30, 80)]))
    w = Words(data, offsets, toxicity.PUNCT)
    rows, labels = toxicity.features(w), np.array([1, 0, 1, 0, 1], np.float32)
    g = toxicity.slopes(model, rows, w.first, labels)

    def loss(m):
        z = toxicity.pooled(m, rows, w.first).astype(float) @ m.weight.astype(float) + m.offset
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    table = np.zeros_like(model.table)
    table[g.once] = g.table
    for name, slope in (("table", table), ("kernel", g.kernel), ("bias", g.bias), ("weight", g.weight)):
        way = slope / np.sqrt((slope**2).sum())
        up, down = (loss(model._replace(**{name: getattr(model, name) + np.float32(s) * way})) for s in (1e-3, -1e-3))
        assert abs((up - down) / 2e-3 - (slope * way).sum()) < 0.01 * (slope * way).sum(), name
    assert abs((loss(model._replace(offset=model.offset + 1e-3)) - loss(model._replace(offset=model.offset - 1e-3))) / 2e-3 - g.offset) < 1e-4


def test_known_notices_hold_a_hint():
    assert all(any(h in body.lower() for h in licenses.HINTS) for _, body in licenses.TEXTS if "\n" not in body)


def test_licenses(spark):
    mit = licenses.TEXTS[0][1]
    texts = [mit, mit.upper().replace(",", " ;"), "Copyright (c) 2020 Someone\n" + mit, mit.replace("sublicense", "sub-licence"), mit + " And more.", "x\nReleased under the MIT licence\ny"]
    got = {x["doc_id"]: (x["license"], x["notices"]) for x in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i][0] for i in range(6)] == ["MIT"] * 4 + [None] * 2 and got[5][1] == "MIT"


def test_mixing(spark):
    docs = documents(spark, [prose(20 + i % 50, i) for i in range(600)]).withColumn("source", F.when(F.col("doc_id") < 20, "tiny").when(F.col("doc_id") < 300, "mid"))
    out = mixing.mix(docs).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all() and len(out) == 600
    for _, g in out.groupby(out["source"].fillna("")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    assert abs(out.groupby(out["source"].fillna(""))["target"].first().sum() - out["size"].sum()) < 1e-6
    assert out["taken"].sum() <= out["size"].sum()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(out["doc_id"], out["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_language_model(spark):
    texts = [prose(80, i, 50) for i in range(60)] + ["unseen words only", "", None]
    docs = documents(spark, texts)
    held = toxicity.bucket(F.col("doc_id"), 5) == 1
    got = {x["doc_id"]: x for x in gru_lm.score(docs, held).collect()}
    assert len(got) == 63
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    count: dict = {}
    for i, t in enumerate(texts):
        if not got[i]["held_out"]:
            for w in tokens(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        w = tokens(t)
        base = sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(got[i]["base_score"] - base) < 1e-6 and got[i]["n_tokens"] == len(w) and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(x in count for x in w) and got[i]["score"] < 0


def test_language_model_is_a_distribution():
    net = gru_lm.fresh_net(np.random.default_rng(0).random(gru_lm.VOCABULARY) * 9)
    state = np.random.default_rng(1).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    p = np.exp(gru_lm.log_probabilities(net, np.repeat(state, gru_lm.VOCABULARY, 0), np.arange(gru_lm.VOCABULARY)))
    assert abs(p.sum() - 1) < 1e-3
    ids = np.random.default_rng(2).integers(2, 900, 400).astype(np.int32)
    alone = [gru_lm.text_scores(net, ids[a:b], np.array([0, b - a]))[0] for a, b in ((0, 90), (90, 90), (90, 400))]
    assert np.allclose(gru_lm.text_scores(net, ids, np.array([0, 90, 90, 400])), alone, atol=1e-3)  # state goes on across windows


def small_net(seed):
    rng = np.random.default_rng(seed)
    net = gru_lm.fresh_net(rng.random(gru_lm.VOCABULARY) * 9)
    return gru_lm.Net(*(x + rng.normal(0, 0.15, x.shape).astype(np.float32) for x in net))


def plain_score(net, ids):
    """Natural log probability of one document's vocabulary entries and its end, token by token in double precision."""
    embed, into, again, bias, to_class, class_bias, to_word, word_bias = (x.astype(float) for x in net)
    h, out, feed, n = np.zeros(gru_lm.HIDDEN), 0.0, gru_lm.END_SLOT, gru_lm.HIDDEN
    for v in [*ids, gru_lm.END_SLOT]:
        x, a = embed[feed] @ into + bias, h @ again
        r, z = (1 / (1 + np.exp(-(x[k * n : k * n + n] + a[k * n : k * n + n]))) for k in (0, 1))
        new = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = (1 - z) * new + z * h
        c, w = divmod(int(v), gru_lm.CLASS_SIZE)
        top, word = h @ to_class + class_bias, h @ to_word[c] + word_bias[c]
        out += top[c] - np.log(np.exp(top).sum()) + word[w] - np.log(np.exp(word).sum())
        feed = v
    return out


def test_network_scores_by_hand():
    net, rng = small_net(3), np.random.default_rng(4)
    texts = [rng.integers(0, gru_lm.VOCABULARY, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 150, 7)]
    got = gru_lm.text_scores(net, np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    assert np.allclose(got, [plain_score(net, x) for x in texts], rtol=2e-5, atol=1e-3)


def test_large_logits_stay_a_distribution():
    net = small_net(7)
    net = net._replace(class_bias=net.class_bias + np.linspace(-300, 300, gru_lm.CLASSES).astype(np.float32), word_bias=net.word_bias * 900)
    state = np.repeat(np.random.default_rng(1).normal(size=(1, gru_lm.HIDDEN)).astype(np.float32), gru_lm.VOCABULARY, 0)
    p = np.exp(gru_lm.log_probabilities(net, state, np.arange(gru_lm.VOCABULARY)).astype(float))
    assert abs(p.sum() - 1) < 1e-3 and np.isfinite(p).all()


def test_gradient_against_differences():
    net, rng = small_net(5), np.random.default_rng(6)
    shape = (6, 5)
    feed, goal = (rng.integers(0, gru_lm.VOCABULARY, shape).astype(np.int32) for _ in range(2))
    goal[1:3] = goal[0]  # several of one class
    fresh, real = (rng.random(shape) < 0.3).astype(np.float32), (rng.random(shape) < 0.8).astype(np.float32)
    state = rng.normal(0, 0.5, (5, gru_lm.HIDDEN)).astype(np.float32)
    _, g, last = gru_lm.gradient(net, feed, goal, fresh, real, state)
    assert np.allclose(last, gru_lm.run_window(net, feed, fresh, state)[1])
    for k, name in enumerate(net._fields):
        way = g[k] / (np.sqrt((g[k] ** 2).sum()) + 1e-12)
        loss = lambda s: gru_lm.gradient(net._replace(**{name: net[k] + np.float32(s) * way}), feed, goal, fresh, real, state)[0]  # noqa: B023, E731
        assert abs((loss(0.01) - loss(-0.01)) / 0.02 - (g[k] * way).sum()) < 2e-3 * max(1.0, float((g[k] * way).sum())), name


def test_score_is_the_network_and_the_shares_of_rare_words(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{int(9000 * r.random() ** 2)}" for _ in range(30_000)]
    docs = documents(spark, [" ".join(words[i * 300 : i * 300 + 300]) for i in range(100)] + ["never seen at all", "", None])
    kept = []
    train = gru_lm.train
    monkeypatch.setattr(gru_lm, "train", lambda d, keep: kept.append(train(d, keep)) or kept[0])
    got = {x["doc_id"]: x for x in gru_lm.score(docs, F.col("doc_id") % 5 == 1).collect()}
    head, net, table = kept[0]
    count = {np.uint64(x["hash"] % 2**64): x["n"] for x in table.collect()}
    slot = dict(zip(head.hash.tolist(), head.slot.tolist()))
    inside = sum(count[np.uint64(h)] + 0.5 for h, s in slot.items() if s != gru_lm.UNKNOWN)
    assert sum(s == gru_lm.UNKNOWN for s in slot.values()) > 100
    rest = sum(count.values()) + 0.5 * (len(count) + 1) - inside
    for x in docs.where("doc_id % 9 = 1 OR doc_id >= 100").collect():
        data, offsets = utf8(pa.array([x["text"]]))
        tokens = Words(data, offsets, gru_lm.SPACES).hash.tolist()
        ids = [slot.get(h, gru_lm.UNKNOWN) for h in tokens]
        want = plain_score(net, ids) / math.log(10) + sum(math.log10((count.get(np.uint64(h), 0) + 0.5) / rest) for h, s in zip(tokens, ids) if s == gru_lm.UNKNOWN)
        assert abs(got[x["doc_id"]]["score"] - want) < 1e-3 + 2e-5 * abs(want)


def sentences(text):
    out = []
    for s in re.findall(r"\S[^\n]*?(?:[.!?](?=\s|$)|(?=\n|$))", text):
        w = s.split()
        out += [w[i : i + 20] for i in range(0, len(w), 20)]
    return out


def brute_spans(texts):
    """For each text, the sentences that stay."""
    runs, first = [], {}
    for t in texts:
        s, own = sentences(t), set()
        for i in range(len(s)):
            for step in (range(i + 3, len(s) + 1), range(i - 2, -1, -1)):
                for j in step:
                    lo, hi = (i, j) if j > i else (j, i + 1)
                    if sum(map(len, s[lo:hi])) >= 12:
                        own.add((lo, hi))
                        break
        runs.append((s, sorted(own)))
    out = []
    for d, (s, own) in enumerate(runs):
        gone = set()
        for lo, hi in own:
            key = tuple(w.lower() for x in s[lo:hi] for w in x)
            if first.setdefault(key, (d, lo)) != (d, lo):
                gone |= set(range(lo, hi))
        out.append([x for i, x in enumerate(s) if i not in gone])
    return out


def test_spans(spark):
    passage = "This passage is shared by many. It goes on for a while. Yes. It has short sentences, too! And it ends only here, after these words."
    texts = [prose(60, i) + "\n" + passage + " " + prose(40, 70 + i) for i in range(4)] + [prose(90, 99), "Same again and again here. " * 9, passage, "A. B. C.", ""]
    got = {x["doc_id"]: x["text"] for x in spans.dedup(documents(spark, texts)).collect()}
    want = brute_spans(texts)
    for d in range(len(texts)):
        assert got[d].split() == [w for x in want[d] for w in x], d
    assert got[4] == texts[4] and "shared by many" in got[0] and all("shared by many" not in got[d] for d in (1, 2, 3, 6))


def test_minimum_cut():
    r = random.Random(3)
    for _ in range(60):
        n = r.randrange(1, 8)
        e = [r.choice([-3, -1.5, -0.5, 0.7, 2, 4.1]) for _ in range(n)]
        edges = [(i, j, r.choice([0.3, 0.9, 1.6])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda s: sum(max(x, 0) if not k else max(-x, 0) for x, k in zip(e, s)) + sum(w for a, b, w in edges if s[a] != s[b])  # noqa: B023, E731
        assert abs(cost(html_cut.minimum_cut(e, edges)) - min(cost(s) for s in itertools.product([False, True], repeat=n))) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="cookie-notice">We use cookies, accept them all please.</div>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav><main><article><header><h1>The &amp; title</h1></header><p>First <b>para</b>graph of the
article&nbsp;here.<div class="ad-slot">Buy now</div><p>Yes.<p>Third paragraph with <a href=z>a link</a> in it.<script>if (a < b) {}</script></article><section class="comments"><p>I like this article very much, thanks for it.</p></section></main>
<aside>Related: more things to read</aside><form>Name <input></form><footer>&copy; 2020 Someone</footer></body></html>"""


P = "<p>" + "Several words make up this sentence of the article, as they do. " * 2 + "</p>"
PLAIN_P = ("Several words make up this sentence of the article, as they do. " * 2).strip()
#: Pages, and their main text.
PAGES = [
    (PAGE, "The & title First paragraph of the article here. Yes. Third paragraph with a link in it."),
    ("", ""),
    ("<p>" + "word " * 60 + "</p>", ("word " * 60).strip()),
    (f'<div style="overflow:hidden"><article>{P}</article></div><div aria-hidden="false">{P}</div>', f"{PLAIN_P} {PLAIN_P}"),
    (f'<svg width="3" /><article>{P}</article><button>Menu<article>{P}</article><footer>Foot <button>ok</button></footer>', f"{PLAIN_P} {PLAIN_P}"),
    (f'<article>{P}<iframe src="x" />{P}<iframe src="y"></iframe>{P}</article>', " ".join([PLAIN_P] * 3)),
    (f'<article class="post tags">{P}<section class="social-history"><h2>A social history</h2>{P}</section></article>', f"{PLAIN_P} A social history {PLAIN_P}"),
    ("<div>Nine words stand alone on this short page</div>", "Nine words stand alone on this short page"),
    (f"<nav><a href=/>Home</a></nav><article>{P}<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(30)) + "</ul></article>", " ".join([PLAIN_P] + [f"Part {i}" for i in range(30)])),
    ("<article>" + "<p>Of.</p>" * 200 + "</article>", " ".join(["Of."] * 200)),
    (f'<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><div>{P}<p>So be it.</p>{P}</div><div>© 2020 Someone</div>', f"{PLAIN_P} So be it. {PLAIN_P}"),
    (f'<article>{P}<div class="ad-slot">' + "Buy this now, it is the best of all things that there are. " * 9 + f'</div>{P}<section id="comments">{P * 9}</section></article>', f"{PLAIN_P} {PLAIN_P}"),
    # readers' comments as articles: inside the article, behind it, without any name, and what is like them but isn't
    (f'<article><h1>Top</h1>{P}<section><h2>Comments</h2><article class="comment">{P}</article><article id="comment-2">{P}</article></section></article>', f"Top {PLAIN_P}"),
    (f'<article><h1>Top</h1>{P}</article><article class="comment">{P}</article><article class="comment-body depth">{P}</article>'.replace(" depth", ""), f"Top {PLAIN_P}"),
    (f"<article><h1>Top</h1>{P}<h3>Readers say</h3><article>{P}<p>{PLAIN_P}</p></article></article>", f"Top {PLAIN_P}"),
    (f'<article class="wrap"><article class="post"><h1>Top</h1>{P}</article></article>', f"Top {PLAIN_P}"),
    (f'<article><h1>Top</h1><article>{P}</article></article>', f"Top {PLAIN_P}"),
    (f'<article class="post comments-open"><h1>Top</h1>{P}<h2>Next</h2><aside>{P}</aside>{P}</article>', f"Top {PLAIN_P} Next {PLAIN_P}"),
    (f'<main>{P}<article class="related">{P}</article></main>', PLAIN_P),
    (f'<article class="share">{P}</article>', PLAIN_P),
    (f"<main><div class=share>Share this</div><article><header><h1>Top</h1></header>{P}</article></main><aside>{P}</aside>", f"Top {PLAIN_P}"),
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_main_text(i):
    assert html_cut.main_text(PAGES[i][0]) == PAGES[i][1]


def test_main_text_of_all_pages(spark):
    """In the given pages the article is an element of its own: the text comes back whole, with weights fitted to the pages; and the cut
    decides against some blocks' own evidence."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_cut.fit(pages)
    got = {x["page_id"]: x["text"] for x in html_cut.extract(pages).collect()}
    changed = 0
    for x in pages.collect():
        article = re.search("<article>(.*?)</article>", x["html"], re.S)[1]
        bare = re.sub("</?b>", "", re.sub("</?(?:p|h1|br|li|ul|div)[^>]*>", " ", article))
        assert got[x["page_id"]] == " ".join(html_cut.unescape(bare).split())
        blocks, roots = html_cut.blocks_of(x["html"])
        nodes, edges = html_cut.graph(blocks, roots, weights)
        changed += sum((e > 0) != side for e, side in zip(nodes[: len(blocks)], html_cut.minimum_cut(nodes, edges)))
    assert changed > 0


def test_fitted_weights():
    assert html_cut.fitted([]) == html_cut.fitted([((0, 1), 5, 5)]) == list(html_cut.PRIOR)
    counts = [((0, 6, 7), 40_000, 30_000), ((0, 1, 9), 50_000, 500), ((0, 3, 7, 10), 30_000, 15_000)]
    w = html_cut.fitted(counts)
    assert w[6] + w[7] > 0 > w[1] + w[9]
    # in the maximum, the slope of the likelihood is that of the prior
    total, yes = sum(c[1] for c in counts), sum(c[2] for c in counts)
    slope = np.zeros(len(w))
    for which, n, k in counts:
        a, b = k * total / 2 / yes, (n - k) * total / 2 / (total - yes)
        p = 1 / (1 + math.exp(-sum(w[i] for i in which)))
        slope[list(which)] += (a - (a + b) * p) * 2000 / total
    assert np.allclose(slope, html_cut.FIRM * (np.array(w) - html_cut.PRIOR), atol=1e-5)


def test_zip_files(spark):
    for big in (False, True):
        raw = io.BytesIO()
        raw.close_ = raw.close
        raw.close = lambda: None
        w = zip_warc.ZipWriter(raw, big)
        for name, body in (("a", b"x" * 1000), ("b/c", b"")):
            w.begin(name)
            w.write(body)
            w.end()
        w.close()
        data = raw.getvalue()
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and z.read("a") == b"x" * 1000
        at, n = zip_warc.zip_members(len(data), lambda a, k: data[a : a + k])["a"]  # noqa: B023
        assert data[at : at + n] == b"x" * 1000
    pages = spark.createDataFrame([(i, f"http://e/{i}", f"<p>{'ä' * 80}{i // 3}</p>") for i in range(30)] + [(99, "u", "x"), (98, "u", "x")], "page_id long, url string, html string")
    for big in (False, True):
        got = {x["page_id"]: x for x in zip_warc.round_trip(pages, big).collect()}
        assert len(got) == 32 and got[4]["refers_to"] == 3 and got[3]["record_type"] == got[98]["record_type"] == got[99]["record_type"] == "response"
        assert got[4]["payload_bytes"] == got[3]["payload_bytes"] == len(f"<p>{'ä' * 80}1</p>".encode())
    keep = Scratch(spark)
    read = zip_warc.read_archives(zip_warc.write_archives(zip_warc.archived(pages), keep.path("z")))
    assert {x["page_id"]: bytes(x["payload"]).decode() for x in read.where("record_type = 'response'").collect()}[3] == f"<p>{'ä' * 80}1</p>"


def test_near_duplicates(spark):
    base = [prose(150 + 40 * i, i) for i in range(5)]
    texts = base + [edit(b, 2, 7 + i) for i, b in enumerate(base)] + [edit(b, 40, 70 + i) for i, b in enumerate(base)] + [base[0], base[0].upper(), "one two", "one two", "", ""]
    texts += [edit(base[4], 1, 700 + i) for i in range(30)]
    data, offsets = utf8(pa.array(texts))
    h, first = order_minhash.kmers(data, offsets)
    n = len(texts)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        a, b = (h[first[k] : first[k + 1]].tolist() for k in (i, j))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        if a and b and row[-1] / (len(a) + len(b) - row[-1]) >= 0.8 - 1e-12:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(n)}
    assert sorted(x["doc_id"] for x in order_minhash.keep_one(documents(spark, texts)).collect()) == sorted({find(i) for i in range(n)})


def test_words_by_hand():
    data, offsets = utf8(pa.array(["Ab c", None, "  c\tAB\n", "é x"]))
    w = Words(data, offsets)
    assert w.counts.tolist() == [2, 0, 2, 2] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (3, 40, 900, 5000):
        a = rng.integers(0, n // 2 + 1, n)
        b = np.concatenate([a[rng.random(n) > 0.1], rng.integers(n, 2 * n, n // 10)])
        hashes = [(np.uint64(1) + x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b)]
        x, y = (np.frombuffer(order_minhash.parities(h, np.array([0, len(h)]))[0], np.uint8)[None] for h in hashes)
        count = lambda v: dict(zip(*np.unique(v, return_counts=True)))
        ca, cb = count(a), count(b)
        real = sum(abs(ca.get(k, 0) - cb.get(k, 0)) for k in {*ca, *cb})
        seen = int(order_minhash.differing(x, y)[0])
        assert seen <= real and seen % 2 == real % 2 and seen >= 0.8 * real
        assert order_minhash.differing(x, x)[0] == 0 == order_minhash.differing(y, np.concatenate([y, 0 * y], 1))[0]


@pytest.mark.parametrize("size", [50, 700])
def test_alignment_in_a_window_equals_whole_masks(size, monkeypatch):
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = rng.integers(0, size // 2, size).astype(np.uint64)
        b = a[rng.random(size) > rng.choice([0.02, 0.1, 0.2])]
        b = np.insert(b, rng.integers(0, len(b), 5), rng.integers(size, 2 * size, 5).astype(np.uint64))
        whole = order_minhash.aligned(a, b)
        monkeypatch.setattr(order_minhash, "_WHOLE", 0)
        assert order_minhash.aligned(a, b) == whole
        monkeypatch.undo()
