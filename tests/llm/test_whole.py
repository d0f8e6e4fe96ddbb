"""What must not be left out: pairs, passages, elements, texts and training documents that a shortcut would miss."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import gru_lm, html_cut, licenses, order_minhash, spans
from granary.llm.common import Scratch
from tests.llm.test_brute import documents, prose


def substituted(words, places, tag):
    return " ".join(f"{tag}{p}" if p in places else w for p, w in enumerate(words))


def test_copies_around_an_original(spark):
    """Each copy is over the threshold to its original only, and all texts are equally long."""
    texts, want = [], []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(404)]
        own = []
        for c in range(60):
            r = random.Random(1000 * g + c)
            own.append(substituted(words, {5 * x + 2 for x in r.sample(range(80), 8)}, f"c{g}x{c}y"))
        at = len(texts)
        texts += [*own, " ".join(words)]
        want += [at] * 61
    got = {x["doc_id"]: x["class_id"] for x in order_minhash.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_all_pairs_of_a_bucket(spark):
    """Groups of any size, in cells of few nodes: all aligned pairs are in one class by the links found and the roots given,
    and each link is an aligned pair."""
    r = random.Random(4)
    bases = [prose(120, 300 + i) for i in range(5)]
    texts = []
    for b in bases:
        for c in range(14):
            w = b.split()
            texts.append(substituted(w, set(r.sample(range(len(w)), r.choice([0, 1, 2, 3, 9]))), f"z{c}_") + f" end{c}")
    n = len(texts)
    nodes = [i.to_bytes(16, "big") for i in range(n)]
    marks = [[-1, 1 if i % 3 else 100 + i, *range(1000 * i + 1000, 1000 * i + 1010)] for i in range(n)]
    bodies = spark.createDataFrame(list(zip(nodes, texts, marks)), "node binary, text string, marks array<long>")
    sizes = [len(t.split()) - 4 for t in texts]
    rows = [(b, nodes[i], nodes[i % 4 and i], sizes[i]) for b, i in itertools.product((-1, 1), range(n)) if b < 0 or i % 3]
    buckets = spark.createDataFrame(rows, "bucket long, node binary, root binary, size long")
    hashes = [order_minhash.kmers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    good = {(a, b) for a, b in itertools.combinations(range(n), 2) if order_minhash.aligned(hashes[a], hashes[b]) > 0}

    def parts(pairs):
        top = list(range(n))
        for a, b in [*pairs, *((0, i) for i in range(0, n, 4))]:
            x, y = top[a], top[b]
            top = [x if t == y else t for t in top]
        return {frozenset(i for i in range(n) if top[i] == t) for t in top}

    for cell in (1, 6, 1000):
        found = order_minhash._others(Scratch(spark), buckets, bodies, 0.8, cell).select("a", "b").collect()
        got = {tuple(sorted(int.from_bytes(x, "big") for x in p)) for p in found}
        assert got <= good and parts(got) == parts(good) and len(good) > 50 and len(got) < n * (1 + n // cell)


def test_passages_inside_long_sentences(spark):
    """A passage of 60 words without an end mark loses its middle wherever it begins in a sentence."""
    passage = [f"shared{i}" for i in range(60)]
    texts = []
    for k in range(40):
        r = random.Random(k)
        before, after = ([f"own{k}_{r.randrange(10**6)}" for _ in range(n)] for n in (3 + 7 * k % 41, 15))
        texts.append(" ".join([*before, *passage, *after]))
    got = {x["doc_id"]: x["text"].split() for x in spans.dedup(documents(spark, texts)).collect()}
    assert got[0] == texts[0].split()
    for k in range(1, 40):
        left = sum(w.startswith("shared") for w in got[k])
        assert left <= 36 and all(w in got[k] for w in texts[k].split()[:1]), (k, left)


def test_elements_that_only_mention_hidden():
    seen = ['style="overflow:hidden"', 'aria-hidden="false"', 'data-sidebar="hidden"', 'title="display:none"', 'style="--x-display:none"', 'data-hidden', 'class="overflow-hidden"', "alt='a hidden thing'"]
    gone = ["hidden", 'class="a hidden"', 'hidden=""', 'HIDDEN="until-found"', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display: none"', 'style="visibility:hidden !important"', "style=display:none"]
    assert [a for a in seen if html_cut.named(f" {a}")[1] or html_cut.named(f" {a}")[0] == "ad"] == []
    assert [a for a in gone if html_cut.named(f" {a} ")[0] != "ad"] == []
    assert html_cut.named(' class="article" data-class="ad"') == ("content", False)
    text = "word " * 60
    assert html_cut.main_text(f'<article style="overflow:hidden"><p>{text}</p></article><article hidden><p>{text}</p></article>') == text.strip()


def test_network_learns_from_all_training_documents(spark, monkeypatch):
    learnt = []
    averaged = gru_lm._averaged
    monkeypatch.setattr(gru_lm, "_averaged", lambda nets, keep: learnt.append(nets.where("part = 0").agg(F.sum("weight")).first()[0]) or averaged(nets, keep))
    docs = documents(spark, [prose(20 + i % 9, i, 50) for i in range(200)])
    got = gru_lm.score(docs, F.col("doc_id") % 5 == 1).collect()
    assert sum(n or 0 for n in learnt) == sum(x["n_tokens"] for x in got if not x["held_out"]) == got[0]["train_tokens"]


def test_whole_licences(spark):
    known = licenses.whole_texts()
    assert {"BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"} <= {n for n, _ in known}
    assert all(any(h in t.lower() for h in licenses.MORE_HINTS) for _, t in known)
    zlib = dict(known)["Zlib"].replace("\n", " ")
    got = {x["doc_id"]: x for x in licenses.scan(documents(spark, [*(t.upper() for _, t in known), "x\n" + zlib + "\ny"])).collect()}
    assert [got[i]["license"] for i in range(len(known))] == [n for n, _ in known] and got[len(known)]["notices"] == "Zlib"


def test_notices_of_the_caller(spark):
    known = licenses.known_licenses(spark, [("Own", "Do as you like.")])
    assert licenses.scan(documents(spark, ["x\nDo as you like!\ny"]), known).first()["notices"] == "Own"


@pytest.mark.parametrize("apart", [1, 300])
def test_nodes_of_one_class_are_not_dealt_against_each_other(spark, apart):
    """Rows of a bucket's cells grow with its nodes times those apart, and every two nodes of different roots meet once."""
    n, most = 40_000, 256
    rows = spark.range(n, numPartitions=4).selectExpr("1L AS bucket", "id AS node", "IF(id < {0}, id, 0L - 1) AS root".format(apart), "100L AS size")
    dealt = order_minhash._cells(rows, 0.8, most)
    count = dealt.count()
    assert n <= count <= n * -(-apart // most) + apart * (2 + n // most + apart // most)
    few = order_minhash._cells(rows.where(f"node < {min(apart, 40)} OR node % 400 = 399"), 0.8, 16)
    by = {}
    for r in few.where("mine").collect():
        by.setdefault((r["band"], r["x"], r["y"]), []).append(r)
    met = [tuple(sorted((a["node"], b["node"]))) for cell in by.values() for i, a in enumerate(cell) for b in cell[:i] if a["root"] != b["root"] and (a["part"] != b["part"] or a["x"] == a["y"])]
    nodes = {r["node"]: r["root"] for r in few.collect()}
    assert sorted(met) == sorted((a, b) for a in nodes for b in nodes if a < b and nodes[a] != nodes[b])
