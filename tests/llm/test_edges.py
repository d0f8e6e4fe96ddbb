"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import decontaminate, gru_lm, html_cut, licenses, mixing, order_minhash, spans, topk, toxicity, zip_warc
from tests.conftest import DATA

LONG = " ".join(f"word{i % 997} thing{i % 31}." for i in range(40_000))
DOCS = [
    (1, "Released under the MIT License.\nmore", "en", "a"), (1, "Released under the MIT License.\nmore", "en", "a"), (2, None, None, None), (None, "some text here. And more of it. Yes.", "de", None),
    (None, None, "en", "b"), (3, "", "en", "b"), (4, " \n\t ", "en", "b"), (5, LONG, "fr", "c"), (6, LONG, "fr", "c"), (7, "...", "en", "a"), (8, "one", "en", "a"), (8, "two", "en", "a"),
]
CLASH = ["_text", "_key", "_node", "score", "size", "hash", "doc", "n_removed", "_doc", "_spans", "row", "source_size"]


def docs(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def bench(spark, rows=((1, "a b c d e f g h i j k l"), (2, None), (3, ""), (None, "x y"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "leaks": lambda s, d: decontaminate.leaks(d, bench(s)),
    "clean": lambda s, d: decontaminate.clean(d, bench(s)),
    "toxicity": lambda s, d: toxicity.score(d, None),
    "reject": lambda s, d: toxicity.reject(d, None),
    "licenses": lambda s, d: licenses.scan(d),
    "mixing": lambda s, d: mixing.mix(d),
    "lm": lambda s, d: gru_lm.score(d, toxicity.bucket(F.col("doc_id"), 5) == 1),
    "spans": lambda s, d: spans.dedup(d),
    "near": lambda s, d: order_minhash.near_duplicates(d),
    "keep_one": lambda s, d: order_minhash.keep_one(d),
}
ROWS = {"leaks": 0, "keep_one": 10}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, spark):
    got = OPERATORS[name](spark, docs(spark)).collect()
    assert len(got) == ROWS.get(name, len(DOCS))


def by_place(got, of):
    """Values in the order of DOCS; rows equal in id and text are alike."""
    found = {(r["doc_id"], r["text"]): r for r in got}
    return [of(found[(i, t)]) for i, t, *_ in DOCS]


def test_odd_values(spark):
    """Nulls, empty and long texts, ties and repeated rows have the results that the operators state."""
    d = docs(spark)
    sizes = [len((t or "").split()) for _, t, *_ in DOCS]
    near = [(r["doc_id"], r["class_id"], r["kept"]) for r in order_minhash.near_duplicates(d).collect()]
    want = [(1, 1), (1, 1), (2, 2), (None, None), (None, None), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (8, 8)]
    assert sorted(near, key=str) == sorted(((i, c, i == c) for i, c in want), key=str)
    mixed = mixing.mix(d)
    assert by_place(mixed.collect(), lambda r: r["size"]) == sizes
    assert all(r["taken"] == 0 for r in mixed.collect() if not r["size"]) and mixed.agg(F.sum("taken")).first()[0] <= sum(sizes)
    scored = gru_lm.score(d, F.col("doc_id") == 6).collect()
    tokens = sorted((r["doc_id"], r["n_tokens"], r["held_out"]) for r in scored if r["doc_id"] is not None)
    assert tokens == sorted((i, n + 1, i == 6) for (i, *_), n in zip(DOCS, sizes) if i is not None)
    five, six = (next(r for r in scored if r["doc_id"] == k) for k in (5, 6))
    assert abs(five["score"] - six["score"]) < 1e-3 * abs(five["score"]) and abs(five["base_score"] - six["base_score"]) < 1e-5 and six["n_known"] == 80_001
    assert len({r["score"] for r in scored if r["n_tokens"] == 1}) == 1
    cut = spans.dedup(d).collect()
    assert by_place([r for r in cut if not r["n_removed"]] + d.where("doc_id IN (5, 6)").collect(), lambda r: r["text"]) == [t for _, t, *_ in DOCS]
    assert {r["doc_id"]: r["n_removed"] for r in cut if r["n_removed"]} == {5: 40_000 - 997 * 31, 6: 40_000}
    found = licenses.scan(d).collect()
    assert sorted(((r["doc_id"], r["license"], r["notices"]) for r in found if r["notices"] or r["license"]), key=str) == [(1, None, "MIT"), (1, None, "MIT")]
    assert {r["score"] for r in toxicity.score(d, None).collect()} == {0.0} and toxicity.reject(d, None).count() == len(DOCS)
    assert decontaminate.clean(d, bench(spark, [(1, "word3 thing3. word4 thing4. word5 thing5. word6"), (2, None), (None, "one")])).where("doc_id IN (5, 6)").count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, spark):
    assert OPERATORS[name](spark, docs(spark, [])).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(stage, spark):
    d = docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    out = corpus_pipeline.STAGES[stage][1](spark, d, DATA)
    rows = out.collect()
    ids = sorted((r["doc_id"] for r in rows), key=str)
    if stage < 4:
        assert out.columns == d.columns
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASH))
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    every = sorted((r[0] for r in DOCS), key=str)
    if stage in (0, 2, 3):
        assert ids == every
    elif stage == 1:
        assert ids == sorted([1, 2, None, None, 3, 4, 5, 7, 8, 8], key=str)
    else:
        assert set(ids) <= {1, None, 5, 6, 7, 8} and all(r["taken"] == r["copies"] * len(r["text"].split()) for r in rows)
    assert corpus_pipeline.STAGES[stage][1](spark, d.limit(0), DATA).collect() == []


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<article><p>Text here.</p></article>" * 3000), (4, "u", "<<<>>> &bogus; <p"), (5, "u", "<div>" * 3000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "digest": F.lit(2), "n_chars": F.lit(3)})
    assert html_cut.extract(p).count() == 7 and html_cut.extract(p.limit(0)).collect() == []
    got = zip_warc.round_trip(p).collect()
    assert len(got) == 7 and {r["record_type"] for r in got} == {"response"}
    same = spark.createDataFrame([(None, "a\r\nb", "x" * 100), (4, "u", "x" * 100), (9, "u", "x" * 100), (None, "u", "y" * 100), (None, "u", "y" * 100), (None, None, None)], "page_id long, url string, html string")
    rows = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in zip_warc.round_trip(same).collect()), key=str)
    assert rows == [(4, 100, "response", None), (9, 100, "revisit", 4), (None, 0, "response", None), (None, 100, "response", None), (None, 100, "response", None), (None, 100, "revisit", 4)]
    assert zip_warc.round_trip(p.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (100, []), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"c": F.lit(1), "q": F.lit(2)})
    got = [tuple(r) for r in topk.top_k(v, F.col("vec_id") % 50 == 0, 3).where("query_id = 50").orderBy("rank").collect()]
    assert got == [(50, 1, 3, 131072), (50, 2, 1, 65536), (50, 3, 1, 65536)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    twice = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (7, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(twice, F.col("vec_id") % 50 == 0, 3).collect()] == [(50, 1, 7, 393216)]  # one query, its greatest vector


def test_spans_of_rows_without_clear_ids(spark):
    """Rows with null or repeated ids don't change who is first among the others."""
    text = "These words are shared by all. They come in a few sentences. So they are a span. And that is all."
    rows = [(5, "own five. " + text), (3, "own three. " + text), (None, text), (9, "some more. " + text), (9, text)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"][:9]): r["n_removed"] for r in spans.dedup(d).collect()}
    assert got[(3, "own three")] == 0 and got[(5, "own five.")] == 4 and sum(got.values()) == 4 * 4
    clean = spans.dedup(d.where("doc_id < 9")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in clean) == [(3, 0), (5, 4)]
    named = d.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sum(r["n_removed"] for r in spans.dedup(named).collect()) == 4 * 4


def test_ids_of_any_type(spark):
    text = "a b c d e f g h i j k l"
    d = spark.createDataFrame([("x", f"so {text} it is"), (None, text)], "doc_id string, text string")
    for kind, value in (("string", "one"), ("smallint", 1), ("decimal(5,2)", None), ("bigint", 2**40)):
        items = spark.createDataFrame([(value, text)], "v string, text string" if kind == "string" else "v long, text string").select(F.col("v").cast(kind).alias("item_id"), "text")
        got = decontaminate.leaks(d, items)
        assert dict(got.dtypes)["item_id"] == kind and sorted(((r["doc_id"], r["item_id"], r["edits"], r["first_word"]) for r in got.collect()), key=str) == [("x", value, 0, 0), (None, value, 0, 0)]
