"""The whole pipeline against a brute-force version of its five stages, on planted documents."""

import re

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from granary.llm import decontaminate, mixing, order_minhash, toxicity
from granary.llm.common import utf8
from granary.llm.queries import toxicity_model
from tests.llm.test_brute import brute_spans, distance, edit, plain_logit, prose

N = 600
PASSAGE = "A passage that many share stands here. It goes on for some sentences. Each of them is short enough. So it is found again."


def fixture(spark, folder):
    """(doc_id, text, lang, source, n_chars) rows, labels of most, and a benchmark."""
    items = [prose(40, 9000 + i) for i in range(3)]
    texts = [prose(20 + i % 40, i, 300) for i in range(N)]
    for i in range(0, N, 3):  # toxic ones
        texts[i] += " vilest slur of all. " + prose(5, 5000 + i, 300)
    texts += [edit(texts[i], k, i) for i, k in ((31, 1), (34, 1), (37, 1), (38, 20), (40, 0))]
    texts += [prose(40, 7000 + i) + "\n" + PASSAGE + "\n" + prose(40, 7500 + i) for i in range(5)]
    texts += [prose(30, 8000) + " " + edit(items[0], 2, 5) + " " + prose(30, 8001), items[1], prose(20, 8002) + " " + edit(items[2], 25, 6)]
    texts += ["", None, "...", "Two words", "Two words"]
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(N) if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def aligned(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1]) if a and b else 0.0


def one_of_each(rows):
    data, offsets = utf8(pa.array([r[1] or "" for r in rows], pa.string()))
    h, first = order_minhash.kmers(data, offsets)
    own, top = [h[first[i] : first[i + 1]].tolist() for i in range(len(rows))], list(range(len(rows)))
    sets = [set(x) for x in own]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] and rows[i][1].strip() and rows[i][1] == rows[j][1]
            if same or (sets[i] & sets[j] and aligned(own[i], own[j]) >= 0.8 - 1e-12):
                top = [top[j] if t == top[i] else t for t in top]
    return [r for i, r in enumerate(rows) if i == top.index(top[i])]


def test_run(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity_model(spark, docs, folder)
    score = lambda t: 1 / (1 + np.exp(-(model.scale[0] * plain_logit(model, t or "") + model.scale[1])))
    kept = [r for r in rows if score(r[1]) < model.thresholds.get(r[2], model.thresholds[""])]
    assert 0.9 * N / 3 < len(rows) - len(kept) < 1.1 * N / 3
    once = one_of_each(kept)
    assert 3 <= len(kept) - len(once) <= 8
    left = [" ".join(w for s in x for w in s) for x in brute_spans([r[1] or "" for r in once])]
    assert sum(" ".join((r[1] or "").split()) != t for r, t in zip(once, left)) == 4
    split = lambda s: re.findall(r"[a-z0-9]+", s.lower())
    clean = [(r, t) for r, t in zip(once, left) if not any(distance(split(x), split(t)) <= decontaminate.budget(40) for x in items)]
    assert len(once) - len(clean) == 2
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], t, r[3]) for r, t in clean])
    taken = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, taken FROM ({mixing.mix_sql()})").fetchall() if r[1]}
    got = corpus_pipeline.run(spark, folder).collect()
    words = {r[0]: t for r, t in clean}
    assert {x["doc_id"]: x["taken"] for x in got} == taken and len(got) == len(taken) > 300
    assert all(" ".join(x["text"].split()) == words[x["doc_id"]] and x["n_chars"] == len(x["text"]) for x in got)


def test_the_last_stage_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "one two", "a", 9, "x"), (2, "three", "b", 9, "y")], "doc_id long, text string, source string, copies int, finish string")
    out = corpus_pipeline.sources_to_weights(spark, docs, "")
    assert sorted(out.columns) == ["copies", "doc_id", "finish", "source", "taken", "text"] and {x["copies"] for x in out.collect()} <= {1, 2, 3}
