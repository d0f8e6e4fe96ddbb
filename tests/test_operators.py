import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary import queries
from granary.functions import identity, session, text
from granary.jobs import api
from granary.operators import audit, chunking, dense, evaluate, fusion, graph, maintenance, shaping, sparse
from granary.sources import postings, tables
from granary.streaming import monitor


def words(n, start=0):
    return [f"w{i}" for i in range(start, start + n)]


def test_stitch_trims_overlap():
    a, b = " ".join(words(300)), " ".join(words(140, 260))
    assert shaping.stitch(a, b).split() == words(400)
    assert shaping.stitch("a b", "b c") == "a b\nb c"  # one shared word stays
    assert shaping.stitch("", "b") == "b" and shaping.stitch("a", " ") == "a" and shaping.stitch(" ", "b") == "b"
    assert shaping.stitch("x a b", "a b\nc d") == "x a b\nc d"


@given(st.integers(301, 900))
def test_windows_come_together_again(n):
    w = words(n)
    parts = [" ".join(w[i : i + 300]) for i in range(0, n, 260)]
    out = parts[0]
    for p in parts[1:]:
        out = shaping.stitch(out, p)
    assert out.split() == w + (w[-1:] if n % 260 == 1 else [])


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id string, page int, chunk_part int, total_parts int, rank int, content string")


def test_runs(spark):
    hits = rows(spark, [("a", 1, 2, 4, 1, "two"), ("a", 1, 1, 4, 2, "one"), ("a", 1, 4, 4, 3, "four"), ("a", 2, 3, 4, 4, "next page"), ("b", 1, None, None, 5, "x"), ("b", 1, 1, 1, 6, "y"), ("c", 1, 1, 3, 7, "p"), ("c", 1, 1, 3, 8, "q"), ("c", 1, 2, 3, 9, "r")])
    out = {(r["doc_id"], r["rank"]): (r["content"], r["stitched_parts"]) for r in shaping.stitch_parts(hits, ["doc_id", "page"]).collect()}
    assert out == {("a", 1): ("one\ntwo", 2), ("a", 3): ("four", None), ("a", 4): ("next page", None), ("b", 5): ("x", None), ("b", 6): ("y", None), ("c", 7): ("p", None), ("c", 8): ("q\nr", 2)}


def test_shape(spark):
    hits = spark.createDataFrame([(1, i, f"text {i % 7}", "d" if i < 6 else f"e{i}") for i in range(1, 12)], "query_id int, rank int, content string, doc string")
    take = lambda keep, per: [r["rank"] for r in shaping.shape(hits, F.col("doc"), keep, per).orderBy("rank").collect()]
    assert take(3, 1) == [1, 6, 7] and take(4, 2) == [1, 2, 6, 7] and take(3, -1) == [1, 6, 7] and take(0, 2) == []


def test_quota_bucket_falls_through(spark):
    df = spark.createDataFrame([("m", "d", "t"), ("", "d", "t"), (None, "", "text")], "a string, b string, c string")
    assert [r[0] for r in df.select(text.quota_bucket(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["m", "d", "text"]


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, doc_id string, rank int")
    assert fusion.rrf(a, b, k=3).collect() == fusion.rrf(b, a, k=3).collect()
    assert [r["doc_id"] for r in fusion.rrf(a, b, k=3).orderBy("rank").collect()] == ["y", "x", "z"]


TABLE = "## 5.2.1 Data\n\n| name | use |\n|---|---|\n" + "\n".join(f"| row{i} {'word ' * 20}| u{i} |" for i in range(30))


def test_chunks_keep_rows():
    out = chunking.chunk_page(TABLE)
    lines = [x for c in out for x in c.text.split("\n")]
    assert len(out) > 1 and all("| name | use |" in c.text and c.clause == "5.2.1" and c.block_kind == "table" for c in out)
    assert [sum(f"| row{i} " in x for x in lines) for i in range(30)] == [1] * 30


def test_chunks_of_prose():
    assert [len(c.text.split()) for c in chunking.chunk_page(" ".join(words(700)))] == [300, 300, 180]
    assert len(chunking.chunk_page(" ".join(words(520)))) == 2
    assert chunking.chunk_page("12\n\n- 7 -\n") == [] and len(chunking.chunk_page("![f](a.png)")) == 1
    assert chunking.chunk_page("") == []
    assert [c.clause for c in chunking.chunk_page("##### 5.1 Start\n" + " ".join(words(700)) + "\n")][:2] == ["5.1", "5.1"]


def test_furniture():
    foot, running = "_ETSI_", "## ETSI GR MEC 077-1 V2.0.3 (2031-11)"
    only = [foot, "204", running, f"{running}\n\n> 204\n", "***\n  _ETSI_  \n---", "`7`"]
    assert [chunking.chunk_page(x) for x in only] == [[]] * len(only)
    kept = ["Etsi", "20477", "ETSI GR MEC 077-1 is cited here", "![](plots/load.svg)", f"{running}\n204 kettles\n{foot}"]
    assert [[c.text for c in chunking.chunk_page(x)] for x in kept] == [[x] for x in kept]  # and nothing is taken out of a chunk


def test_tables_name_their_clauses():
    page = "| 9.3 | Pumps |\n|:--|--:|\n| flow | 12 |\n| head | 40 |\n| 9.4.1 | Valves |\n|:--|--:|\n| bore | 7 |\n\n| just | a header |\n|--|--|"
    got = [(u.kind, u.body, u.header.split("\n")[0], u.clause) for u in chunking.units(page)]
    assert got == [("row", "| flow | 12 |", "| 9.3 | Pumps |", "9.3"), ("row", "| head | 40 |", "| 9.3 | Pumps |", "9.3"), ("row", "| bore | 7 |", "| 9.4.1 | Valves |", "9.4.1")]
    many = "\n".join(f"| {k}.2.{k} | group |\n|---|---|\n| item{k} | {'long ' * k}entry |" for k in (3, 5, 8))
    assert [c.clause for c in chunking.chunk_page(many)] == ["3.2.3"]  # under the floor they stay together
    assert [c.clause for c in chunking.chunk_page(many, min_words=8)] == ["3.2.3", "5.2.5", "8.2.8"]


def test_breaks_count_as_tokens(spark):
    df = spark.createDataFrame([("a<br/>b<BR />c<br>d | e",)], "t string")
    assert df.select(text.estimate_tokens(F.col("t"))).first()[0] == chunking._tokens("a<br/>b<BR />c<br>d | e") == 4 + 1 + 6
    page = "|a|b|\n|---|---|\n" + "\n".join(f"|r{i}|{'x<br/>' * 9}|" for i in range(12))
    assert all(chunking._tokens(c.text) <= 60 for c in chunking.chunk_page(page, max_tokens=60)) and len(chunking.chunk_page(page, max_tokens=60)) > 3


def test_clause_floor():
    rows_ = "\n".join(f"| {i}.1.1 | |\n| a{i} | b |" for i in range(1, 5))
    page = "| x | y |\n|---|---|\n" + rows_
    assert len(chunking.chunk_page(page)) == 1 and len(chunking.chunk_page(page, min_words=1)) == 4


def test_cover(spark):
    texts = ["x ETSI  GR\nMEC 003-2 V2.10.1 (2023-04) y", "no cover", "ETSI TS MEC-DEC 9 V3.1.1(2022-03) On one line"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i")
    a, b, c = [r[0] for r in df.select(identity.cover(F.col("t")), "i").orderBy("i").collect()]
    assert (a["spec_id"], a["edition"], a["pub_date"], tuple(a["key"])) == ("MEC 003-2", "V2.10.1", "2023-04", (2, 10, 1)) and b is None
    assert (c["spec_id"], c["edition"], c["pub_date"]) == ("MEC-DEC 9", "V3.1.1", "2022-03")
    assert [r[0] for r in df.select(identity.title(F.col("t")), "i").orderBy("i").collect()] == ["y", None, "On one line"]


def test_ids_and_editions(spark):
    df = spark.createDataFrame([("mec 003-01", "3.1", "V3.1.1"), ("MEC‑3", "3.1", "V3.11.1")], "c string, a string, e string")
    got = [tuple(r) for r in df.select(identity.canonical_id("c"), identity.cited_id(F.col("c")), identity.edition_matches(F.col("a"), F.col("e"))).collect()]
    assert got[0] == ("MEC-3-1", "MEC 003-1", True) and got[1][1:] == ("MEC 003", False)


def test_current_editions(spark):
    df = spark.createDataFrame([("s", (1, 9, 1)), ("s", (1, 10, 1)), ("s", (1, 10, 1)), (None, None)], "spec_id string, key struct<major:int,minor:int,patch:int>")
    assert sorted(r["is_current"] for r in maintenance.current_editions(df).collect()) == [False, True, True, True]


#: What every answer was given: code, edition, page.
GIVEN = [("MEC 211", "V5.0.2", 31), ("MEC-211", "V5.0.2", 47), ("MEC 118-4", "V1.9.1", 12), ("mec dec 305", "V2.2.2", 3), ("Field Handbook", None, 77), ("MEC 600", "", 5), ("MEC 601", "V1.1.1", None)]
FAR = "and so on " * 15
#: Answers, and the complaints about each.
AUDITED = {
    "Alarms clear by themselves [MEC 211, p. 31] or by hand [mec-211 pp 47].": [],
    "Alarms clear by hand [MEC 211, p. 48].": ["MEC 211 p.48: page not in its excerpts"],
    "Page 12 of MEC 118-04 lists the states, and pages 12 - 14 of MEC 118-4 the rest.": ["MEC 118-4 p.14: page not in its excerpts"],
    "MEC-118 p 12 is another document than its part.": ["MEC 118 p.12: not retrieved"],
    "Decided on p.3 in MEC\u2013DEC\u00a0305 V2.2.2; see also page\u20033 of MEC DEC305.": [],
    "field handbook p.77, Field\u202fHandbook p.78": ["FIELD-HANDBOOK p.78: page not in its excerpts"],
    "MEC 211 V5.0 p.31": [],
    "MEC 211 V5 p.31": [],
    "MEC 211 v5.1 p.31 and MEC 211 (V50.2) p.47": ["MEC 211 V5.1: edition not in its excerpts", "MEC 211 V50.2: edition not in its excerpts"],
    "MEC 211 p.31 (V4.0.2)": ["MEC 211 V4.0.2: edition not in its excerpts"],
    "MEC 211 p.31, MEC 118-4 V1.9.1 p.12": [],  # the second edition is the second document's
    "MEC 600 V9.9.9 p.5": [],  # its edition is not known
    "MEC 601 p.1": ["MEC 601 p.1: not retrieved"],
    "MEC 777 pp. 8-9, MEC 777 p. 8": ["MEC 777 p.8: not retrieved", "MEC 777 p.9: not retrieved"],
    f"MEC 211 {FAR} p.31": ["p.31: no specification named"],
    "No document at all, but p. 2 and page 4.": ["p.2: no specification named", "p.4: no specification named"],
    "MEC 211 says, for MEC 5 hosts and MEC 12 of them, p.31": [],  # fewer than three digits are no code
    "Without pages, MEC 777 is only mentioned.": [],
    "": [],
}


def test_audit(spark):
    every = list(AUDITED)
    answers = spark.createDataFrame([(str(i), a) for i, a in enumerate(every)] + [("null", None), ("bare", "MEC 777 p.3")], "answer_id string, answer string")
    excerpts = spark.createDataFrame([(i, *e) for i in [*map(str, range(len(every))), "null"] for e in GIVEN] + [("bare", None, None, 3), ("bare", "MEC 777", "V1.1.1", None)], "answer_id string, spec_id string, edition string, page int")
    found = {i: [] for i in [*map(str, range(len(every))), "null", "bare"]}
    for r in audit.complaints(answers, excerpts).collect():
        found[r["answer_id"]].append(r["complaint"])
    assert {a: sorted(found[str(i)]) for i, a in enumerate(every)} == AUDITED and found["null"] == found["bare"] == []
    assert audit.complaints(answers.limit(0), excerpts).collect() == []


def test_verdicts(spark):
    rows = [("a", "MEC 003 p. 5"), ("b", "Short."), ("c", "p.3 " + "word " * 50), ("d", "word " * 50), ("e", "MEC 003 p 6"), ("f", None)]
    answers = spark.createDataFrame(rows, "answer_id string, answer string")
    excerpts = spark.createDataFrame([(i, "MEC-003", "V1.1.1", 5) for i in "abdef"] + [("c", None, None, 3)], "answer_id string, spec_id string, edition string, page int")
    got = {r["answer_id"]: (r["cites"], r["complaints"], r["verdict"]) for r in audit.verdicts(answers, excerpts).collect()}
    assert got["a"] == (1, 0, "all present") and got["b"] == (0, 0, "canned") and got["c"] == (1, 0, "skipped") and got["d"] == (0, 0, "none") and got["e"] == (1, 1, "unsupported")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(str(tmp_path / "one"))
    n = tables.copy_and_switch(spark, "switched", str(tmp_path / "one"), str(tmp_path / "two"), lambda d: d.withColumn("w", F.lit(1)))
    assert n == 2 and spark.table("switched").columns == ["k", "v", "w"]
    assert tables.read_manifest(spark, str(tmp_path / "none")).count() == 0
    up = tables.upserted(df, spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "z"), (3, "c")]


def test_names(spark):
    row = lambda expr, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(expr).first()[0]
    c = [F.col(f"c{i}") for i in range(4)]
    forms = {"mec-3": "MEC003", " gs 012-2 ": "MEC012-2", "MEC 010-2": "MEC010-2", "deck": "DECK", "003": "MEC003"}
    assert {x: row(identity.normal_id(c[0]), x) for x in forms} == forms
    labels = {"MEC-003": "MEC003", "MEC-010-2": "MEC010-2", "MEC-DEC-063": "MEC-DEC063", "Deck": "Deck"}
    assert {x: row(identity.label(c[0]), x) for x in labels} == labels
    assert [row(identity.colour_group(c[0]), x) for x in ("MEC-003", "MEC-059", "MEC-312", "deck")] == [0, 5, 11, 0]
    cover = "ETSI GS MEC 003 V4.1.1 (2025-05) "
    assert row(identity.title(c[0]), cover + "Edge\nComputing; Framework, Disclaimer The text") == "Edge Computing; Framework"
    assert row(identity.title(c[0]), cover + "t" * 200) == "t" * 139 and row(identity.title(c[0]), "no cover") is None and row(identity.title(c[0]), cover + " Keywords") is None
    name = lambda *v: row(identity.file_name(c[0], c[1], c[2], c[3]), *v)
    assert name("MEC003", "a.pdf", "Framework; and/or: Reference", "V4.1.1") == "MEC003-V4.1.1-Framework-andor-Reference.pdf"
    assert name(None, "deck.pptx", "T", "V1.1.1") == "deck.pptx" and name("MEC003", "a.pdf", None, None) == "MEC003.pdf"
    long = name("MEC003", "a.pdf", " ".join(["words"] * 20), None)
    assert long == "MEC003-" + "-".join(["words"] * 10) + ".pdf"
    assert row(identity.disagrees(c[0], c[1]), "MEC 040", "MEC-041") and not row(identity.disagrees(c[0], c[1]), "mec 40", "MEC-040") and not row(identity.disagrees(c[0], c[1]), None, "MEC-040")


def test_stitching_keeps_the_lowest_part(spark):
    hits = spark.createDataFrame([("a", 1, 2, 3, 1, "two", "h2", ["y"]), ("a", 1, 1, 3, 2, "one", "h1", ["x"])], "doc_id string, page int, chunk_part int, total_parts int, rank int, content string, heading string, diagram_paths array<string>")
    r = shaping.stitch_parts(hits, ["doc_id", "page"]).first()
    assert (r["rank"], r["chunk_part"], r["content"], r["stitched_parts"], r["heading"], r["diagram_paths"], r["total_parts"]) == (1, 1, "one\ntwo", 2, "h1", ["x"], 3)


def corpus(spark):
    rows = [(i, f"common words alpha{i % 4} and beta{i}", [float(i % 5), 1.0, float(i % 3)] if i != 7 else None, None if i % 3 else i % 2 == 0, i % 2 == 0, f"d{i // 4}", i // 2, i % 2 + 1, 2, f"m{i // 4}", f"MEC {i // 4}", "V1.1.1", f"h{i}", [f"{i}.png"] if i % 2 else None) for i in range(24)]
    return spark.createDataFrame(rows, "id long, text string, embedding array<double>, is_current boolean, has_diagram boolean, doc_id string, page int, chunk_part int, total_parts int, content_md5 string, spec_id string, edition string, heading string, diagram_paths array<string>")


def test_search_and_context(spark):
    chunks = corpus(spark)
    queries = spark.createDataFrame([(1, "beta5 alpha1", [1.0, 1.0, 1.0]), (2, "beta16", [0.0, 1.0, 2.0])], "query_id long, text string, embedding array<double>")
    display, evidence = api.search(chunks, queries)
    rows = evidence.orderBy("query_id", "rank").collect()
    gone = {r["id"] for r in chunks.where("NOT is_current").collect()}
    assert len(gone) > 2 and not {r["id"] for r in rows} & gone
    assert display.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty() and evidence.groupBy("query_id", "content_md5").count().where("count > 2").isEmpty()
    assert any(r["stitched_parts"] == 2 and r["content"].count("common") == 2 and r["chunk_part"] == 1 for r in rows)
    only = api.search(chunks, queries, diagrams_only=True)[1]
    assert {r["has_diagram"] for r in only.collect()} == {True} and not only.isEmpty()
    every = api.search(chunks, queries, current_only=False, answer_context=40, per_doc=9)[1]
    assert any(f" beta{g}" in r["content"] for g in gone for r in every.collect())
    text = {r["query_id"]: r["context"] for r in api.context(evidence).collect()}
    first = rows[0]
    assert text[1].startswith(f"--- [Source 1] {first['spec_id']} V1.1.1 p.{first['page']} \u2014 {first['heading']}") and text[1].count("--- [Source ") == sum(r["query_id"] == 1 for r in rows)
    counted = {r["query_id"]: (r["excerpts"], r["merged"]) for r in api.answer_counts(evidence).collect()}
    assert counted[1] == (sum(r["query_id"] == 1 for r in rows), sum(r["query_id"] == 1 and r["stitched_parts"] is not None for r in rows))
    assert api.search(chunks.limit(0), queries)[1].collect() == []


def test_more_queries_than_go_to_all_tasks(spark):
    chunks = corpus(spark).select("id", "text", "embedding")
    queries = spark.createDataFrame([(i, f"beta{i} alpha{i % 4} words", [1.0, float(i), 0.5]) for i in range(9)], "query_id long, text string, embedding array<double>")
    both = lambda one, other: sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert both(sparse.search(chunks, queries, 5, "id"), sparse.search(chunks, queries, 5, "id", terms=3))
    assert both(dense.top_k(chunks, queries, 5, "id"), dense.top_k(chunks, queries, 5, "id", most=2))
    assert sparse.search(chunks.limit(0), queries, 5, "id").collect() == [] == sparse.search(chunks, queries.limit(0), 5, "id").collect()
    assert dense.top_k(chunks.limit(0), queries, 5, "id").collect() == [] == dense.top_k(chunks, queries.limit(0), 5, "id").collect()


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_stored_postings(spark, tmp_path, monkeypatch, kind):
    """Ids of any type, blocks of few documents, appends, a filter with nulls, and a batch whose job has not ended."""
    monkeypatch.setattr(postings, "BLOCK", 5)
    chunks = corpus(spark).select(F.col("id").cast(kind).alias("id"), "text", "is_current", "has_diagram")
    queries = spark.createDataFrame([(i, f"beta{i} alpha{i % 4} words common common") for i in range(9)] + [(50, ""), (51, None), (52, "absent")], "query_id long, text string")
    queries = queries.select(F.col("query_id").cast(kind).alias("query_id"), "text")
    store = postings.Postings(spark, str(tmp_path / "store"), "id", ("is_current", "has_diagram"))
    store.append(chunks.where("cast(id AS INT) < 15"))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    store.append(chunks.where("cast(id AS INT) >= 15").unionByName(chunks.limit(0)))
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)  # an append leaves what is there alone
    (tmp_path / "store" / "batch=2" / "range=0").mkdir(parents=True)  # a job that was stopped: no _SUCCESS
    for where in (None, maintenance.search_filter(), maintenance.search_filter(True, True), maintenance.search_filter(False, True)):
        want = sorted(map(tuple, sparse.search(chunks if where is None else chunks.where(where), queries, 4, "id").collect()))
        for terms in (sparse.TERMS, 3):
            got = store.search(queries, 4, where, terms)
            assert sorted(map(tuple, got.collect())) == want and got.columns == ["query_id", "id", "score", "rank"] and dict(got.dtypes)["query_id"] == dict(queries.dtypes)["query_id"]
    plan = store.of_tokens(np.array([7, 1 << 30]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [range" in plan and "(-1,0,16)" in plan and "PushedFilters: [In(token_id" in plan
    assert store.search(queries.limit(0), 4).collect() == []
    with pytest.raises(ValueError):
        postings.Postings(spark, str(tmp_path / "none"), "id").search(queries)


def test_late_interaction(spark):
    """Both levels are filtered, documents without token vectors drop out, and more queries than go to all tasks give the same."""
    r = np.random.default_rng(3)
    docs = [(i, r.normal(size=4).tolist() if i % 11 else None, [r.normal(size=4).tolist() for _ in range(i % 4)] if i % 7 else None, None if i % 3 else i % 2 == 0, i % 2 == 0) for i in range(60)]
    docs += [(100, [1.0] * 4, [[float("inf")] * 4], None, True), (101, [1.0] * 4, [[None] * 4], None, True)]
    asked = [(f"q{i}", r.normal(size=4).tolist(), [r.normal(size=4).tolist() for _ in range(3)] if i != 2 else []) for i in range(5)]
    d = spark.createDataFrame(docs, "id long, embedding array<double>, tokens array<array<double>>, is_current boolean, has_diagram boolean")
    q = spark.createDataFrame(asked, "query_id string, embedding array<double>, tokens array<array<double>>")
    cosine = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    want = set()
    for name, e, tokens in asked:
        pool = sorted((-cosine(e, x[1]), x[0]) for x in docs if x[1] and x[3] is not False and x[4])[:12]
        by = {x[0]: x[2] for x in docs}
        scores = [(-round(sum(max(float(np.dot(a, b)) for b in by[i]) for a in tokens), 6), i) for _, i in pool if by[i] and i < 100] if tokens else []
        want |= {(name, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scores)[:6])}
    got = fusion.late(d, q, 6, 12, True, True, "id")
    assert set(map(tuple, got.collect())) == want and len(want) > 12
    pool = dense.top_k(d.where(maintenance.search_filter(True, True)), q, 12, "id")
    assert set(map(tuple, dense.rerank(pool, d, q, 6, "id", most=2).collect())) == want
    assert fusion.late(d.limit(0), q, 6, 12, id_="id").collect() == [] == fusion.late(d, q.limit(0), 6, 12, id_="id").collect()


def test_tokens_by_bytes():
    texts = ["the cat. the dog42 \u00e9a the", "", "a" * 40 + "\u00e9x", None, "cat the\u2003CAT"]
    wanted = {zlib.crc32(w.encode()) & 0x7FFFFFFF: w for w in ("the", "cat", "dog42", "x", "a", "a" * 40)}
    ids = np.array(sorted(wanted))
    got = {(lo + d, wanted[ids[p]]): n for lo, _, docs, places, counts in sparse.counts(pa.array(texts), ids) for d, p, n in zip(docs.tolist(), places.tolist(), counts.tolist())}
    assert got == {(0, "the"): 3, (0, "cat"): 1, (0, "dog42"): 1, (0, "a"): 1, (2, "a" * 40): 1, (2, "x"): 1, (4, "cat"): 1, (4, "the"): 1}
    assert list(sparse.counts(pa.array([], pa.string()), ids)) == []


def test_evidence_of_short_and_long_keywords(spark):
    golden = spark.createDataFrame([(1, None, ["Art of war and peace"]), (2, ["b"], ["zz", "art of"]), (3, ["c"], ["art"]), (4, None, ["war of art"]), (5, None, []), (6, None, ["f w"])], "id int, docs array<string>, kw array<string>")
    docs = spark.createDataFrame([("a", "smART OF WAR AND PEACEful"), ("b", "art  of"), ("b", "part of it"), ("c", None)], "doc string, text string")
    for most in (evaluate.KEYWORDS, 1):
        assert {r["id"]: r["evidence"] for r in evaluate.evidence(golden, docs, most).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
        blank = spark.createDataFrame([(1, None, [""]), (2, ["c"], [""]), (3, None, [None, "\u00c9T"])], "id int, docs array<string>, kw array<string>")
        more = docs.union(spark.createDataFrame([("z", "un \u00e9t\u00e9")], "doc string, text string"))
        assert {r["id"]: r["evidence"] for r in evaluate.evidence(blank, more, most).collect()} == {1: True, 2: False, 3: True}
        assert evaluate.evidence(golden.limit(0), docs, most).collect() == [] and {r["evidence"] for r in evaluate.evidence(golden, docs.limit(0), most).collect()} == {False}


def test_manifest_of_a_stopped_job(spark, tmp_path):
    """Whatever step a writer stops at, readers have the version before; of two writers of one version the later fails."""
    path = str(tmp_path / "manifest")
    rows = lambda *ids: spark.createDataFrame([(x, "u") for x in ids], "spec_id string, url string")
    assert tables.read_manifest(spark, path).collect() == [] and tables.Manifest(spark, path).read()[0] == -1
    for k in range(6):
        assert tables.write_manifest(rows(*(f"S-{i}" for i in range(k))), path) == k
        assert tables.read_manifest(spark, path).count() == k

    class Stops(tables.Manifest):
        def _put(self, aside, there):
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        Stops(spark, path).write(rows("lost"))
    (tmp_path / "manifest" / "rows" / "000000000006-half").mkdir()  # rows without a commit
    assert tables.read_manifest(spark, path).count() == 5
    slow, fast = tables.Manifest(spark, path), tables.Manifest(spark, path)
    put = slow._put
    slow._put = lambda aside, there: (fast.write(rows("fast")), put(aside, there))
    with pytest.raises(Exception, match="exist"):
        slow.write(rows("slow"))
    assert [r["spec_id"] for r in tables.read_manifest(spark, path).collect()] == ["fast"]
    last = sorted(p for p in (tmp_path / "manifest" / "rows").iterdir() if p.name.startswith("000000000006") and "half" not in p.name)
    assert len(last) == 3 and len(list((tmp_path / "manifest" / "commits").glob("[0-9]*"))) == 3  # older ones are gone
    whole = tables.Manifest(spark, path).write(tables.read_manifest(spark, path).union(rows("more")), "note")
    broken = next((tmp_path / "manifest" / "rows").glob(f"{whole:012d}-*"))
    (broken / "part-x.json").write_text('not json\n{"spec_id": "S-9", "url": "u"}\n')
    number, found, note = tables.Manifest(spark, path).read()
    assert (number, note, sorted(r["spec_id"] for r in found.collect())) == (7, "note", ["S-9", "fast", "more"])


def test_keyed_table_changes_only_what_is_touched(spark, tmp_path):
    table = tables.Keyed(spark, str(tmp_path / "t"), ["k"], 8)
    table.create(spark.range(200).selectExpr("id AS k", "'a' AS v"))
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    folders = lambda names: {n.split("/")[1] for n in names}
    want = {i: "a" for i in range(200)}
    for change, rows, apply in (
        (table.upsert, [(3, "b"), (500, "c")], lambda: want.update({3: "b", 500: "c"})),
        (table.update, [(7, "d"), (999, "e")], lambda: want.update({7: "d"})),
        (table.delete, [(11, ""), (12345, "")], lambda: want.pop(11)),
    ):
        before = files()
        assert 1 <= change(spark.createDataFrame(rows, "k long, v string")) <= 2
        apply()
        after = files()
        same = set(before.items()) & set(after.items())
        assert len(folders(before)) - len(folders(n for n, _ in same)) <= 2 and len(same) >= 6  # untouched files keep their names
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
    bucket = sorted(folders(files()))[0].split("=")[1]
    gone = spark.read.parquet(table.folder).where(f"_bucket = {bucket}")
    assert table.delete(gone) == 1 and f"_bucket={bucket}" not in folders(files())  # a folder that has no rows left
    assert table.delete(spark.createDataFrame([], "k long")) == 0 and 0 < table.read().count() < 199


def test_ingest(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, " ".join(words(700)), "m1"), ("b", 1, "same content as a by digest", "m1"), ("c", 1, "other", "m2")], "doc_id string, page int, text string, content_md5 string")
    folder = str(tmp_path / "chunks")
    assert api.ingest(spark, pages, folder) == 4 and api.ingest(spark, pages, folder) == 0
    assert {r["doc_id"] for r in spark.read.parquet(folder).collect()} == {"a", "c"}
    store, folder = postings.Postings(spark, str(tmp_path / "postings"), "id", ("doc_id",)), str(tmp_path / "more")
    assert api.ingest(spark, pages.where("doc_id <> 'c'"), folder, store) == 3 and api.ingest(spark, pages, folder, store) == 1 and api.ingest(spark, pages, folder, store) == 0
    asked = spark.createDataFrame([(1, "other w3")], "query_id long, text string")
    ids = {r["id"]: r["doc_id"] for r in spark.read.parquet(folder).collect()}
    assert sorted(ids[r["id"]] for r in store.search(asked).collect()) == ["a", "c"] and [ids[r["id"]] for r in store.search(asked, where=F.col("doc_id") == "a").collect()] == ["a"]


def test_vectors_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [inf, 1.0]), ("c", [nan, 1.0]), ("d", [None, 1.0]), ("e", None), ("f", [-inf, 0.0]), ("g", [0.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0]), ("r", [inf, 0.0])], "query_id string, embedding array<double>")
    for most in (4096, 1):
        assert [tuple(r) for r in dense.top_k(v, asked, 5, "id", most).orderBy("rank").collect()] == [("q", "a", 1.0, 1), ("q", "g", 0.0, 2)]


def test_tokens_that_share_an_id(spark, duck, tmp_path):
    """Postings by token keep two tokens of one id apart, and lower case is that of the SQL."""
    known, (one, other) = queries.queries(), ("undenkeitkeitung", "ettionaien")
    assert zlib.crc32(one.encode()) & 0x7FFFFFFF == zlib.crc32(other.encode()) & 0x7FFFFFFF
    rows = [(1, f"{one} {other} x {other}"), (2, f"{other}, \u0130zm\u0130r 5\u212a"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duck.sql(queries.oracle_sql()["postings"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = sorted(map(tuple, known["postings"](spark, str(tmp_path)).select("doc_id", "token", "tf").collect()))
    assert got == sorted(want) and {(1, one, 1), (1, other, 2), (2, "izmir", 1), (2, "5k", 1)} <= set(got)
    asked, docs = spark.createDataFrame([(7, "izmir")], "query_id long, text string"), spark.read.parquet(f"{tmp_path}/documents.parquet")
    store = postings.Postings(spark, str(tmp_path / "store"))
    store.append(docs)
    for found in (sparse.search(docs, asked), sparse.search(docs, asked, terms=0), store.search(asked)):
        assert [r["doc_id"] for r in found.collect()] == [2]


def test_scores_are_held_in_steps():
    """Of many queries and vectors a step's scores are held at once, and the best are the same, ties by id."""
    r = np.random.default_rng(5)
    q, v = r.normal(size=(1024, 4)).astype(np.float32), r.normal(size=(16_384, 4)).astype(np.float32)
    v[9000:] = v[: 16_384 - 9000]
    tables = pa.table({"query_id": np.arange(1024), "embedding": pa.array(list(q))}), pa.table({"id": np.arange(16_384)[::-1], "embedding": pa.array(list(v))})
    tracemalloc.start()
    got = dense._best(*tables, 7, "id")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20  # all scores take 128 MB
    scores = np.round((q.astype(float) / np.linalg.norm(q.astype(float), axis=1, keepdims=True)) @ (v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)).T, 6)[:, ::-1]
    order = np.argsort(-scores, axis=1, kind="stable")[:, :7]
    assert got["id"].to_pylist() == order.ravel().tolist() and got["score"].to_pylist() == np.take_along_axis(scores, order, 1).ravel().tolist()
    assert got["query_id"].to_pylist() == np.repeat(np.arange(1024), 7).tolist()


def test_late_interaction_searches_once(spark):
    """The pool is made once, not again for its size; queries beyond BYTES are joined, with the same result."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        made.add(1)
        return x

    r = np.random.default_rng(6)
    docs = [(i, [[float(x) for x in r.integers(-4, 5, 3)] for _ in range(2)]) for i in range(20)]
    d = spark.createDataFrame(docs, "id long, tokens array<array<float>>")
    q = spark.createDataFrame([(i, docs[i][1]) for i in range(4)], "query_id long, tokens array<array<float>>")
    pool = spark.createDataFrame([(a, b) for a in range(4) for b in range(a, 20, 3)], "query_id long, id long").coalesce(1).select(counted("query_id").alias("query_id"), "id")
    got = [sorted(map(tuple, dense.rerank(pool, d, q, 3, "id").collect()))]
    assert made.value == pool.count()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(dense, "BYTES", 64)
        got.append(sorted(map(tuple, dense.rerank(pool, d, q, 3, "id").collect())))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = []
    for a in range(4):
        best = sorted((-sum(max(dot(x, y) for y in docs[b][1]) for x in docs[a][1]), b) for b in range(a, 20, 3))[:3]
        want += [(a, b, -s, n + 1) for n, (s, b) in enumerate(best)]
    assert got == [sorted(want)] * 2


def test_images_are_pruned(spark):
    pages = spark.createDataFrame([("d", 1, "x ![a](i\\1.png) ![b](i/2.png)"), ("e", 1, "![a](i/1.png)"), ("d", None, None)], "doc_id string, page int, text string")
    images = spark.createDataFrame([("d", "i/1.png", False), ("d", "i/2.png", True), ("e", "i/1.png", True)], "doc_id string, path string, keep boolean")
    got = {(r["doc_id"], r["page"]): r["text"] for r in maintenance.prune_images(pages, images).collect()}
    assert got == {("d", 1): "x  ![b](i/2.png)", ("e", 1): "![a](i/1.png)", ("d", None): None}


def test_stream_of_versions(spark, tmp_path):
    """Several batches, nulls as in the batch operator, a restart, and a batch that is run again at either step."""
    rows = [("k", i, float((i * 7) % 23), i % 3) for i in range(60)] + [("n", 1, None, 1), ("n", 2, 5.0, None), ("n", 3, 5.0, 1), ("n", 4, float("nan"), 9), ("n", 5, 4.0, 1), ("n", 6, 6.0, 0), (None, 1, 1.0, 1), (None, 2, 0.0, 1), (None, 3, 2.0, 1)]
    schema, found = "key string, at int, major double, minor int", "key string, major double, minor int, at int"
    source, path = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run(upto):
        for i, lo in enumerate(range(0, upto, 23)):
            if not (source / f"{i}.parquet").exists():
                spark.createDataFrame(rows[lo : lo + 23], schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
                next((tmp_path / f"w{i}").glob("*.parquet")).rename(source / f"{i}.parquet")
        watch = monitor.Monitor(spark, path, "key", ["major", "minor"], "at")
        watch.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))).awaitTermination()
        return watch

    rows_of = lambda df: sorted((str(r["key"]), r["at"], r["major"], r["minor"]) for r in df.collect())
    empty = monitor.Monitor(spark, str(tmp_path / "none"), "key", ["major", "minor"], "at")
    assert empty.found(found).collect() == []
    run(23)
    watch = run(len(rows))  # a restart goes on where it stopped
    want = rows_of(monitor.increases(spark.createDataFrame(rows, schema), "key", F.struct("major", "minor"), ["at"]))
    assert rows_of(watch.found(found)) == want and ("n", 3, 5.0, 1) in want and ("n", 6, 6.0, 0) in want and len([x for x in want if x[0] == "n"]) == 2
    kinds = {"key": "string", "major": "double", "minor": "int"}
    number, known, note = watch._versions(kinds).read()
    last = spark.createDataFrame(rows[46:], schema)
    watch.take(last, int(note))  # the manifest has this batch: nothing changes
    assert watch._versions(kinds).read()[0] == number and rows_of(watch.found(found)) == want
    more = spark.createDataFrame([("k", 99, 50.0, 0)], schema)
    written = tables.Manifest.write

    def stop(*_):
        raise RuntimeError("stopped")

    tables.Manifest.write = stop
    try:
        with pytest.raises(RuntimeError):
            watch.take(more, int(note) + 1)  # stops between the rows and the manifest
    finally:
        tables.Manifest.write = written
    watch.take(more, int(note) + 1)
    assert rows_of(watch.found(found)) == sorted([*want, ("k", 99, 50.0, 0)])
    assert {r["key"]: tuple(r["version"]) for r in watch._versions(kinds).read()[1].collect()} == {"k": (50.0, 0), "n": (6.0, 0), None: (2.0, 1)}


def test_increases_of_versions(spark):
    rows = [("k", i, (i * 7) % 11, i % 3) for i in range(200)] + [("z", 1, 0, 0), (None, 1, 5, 5), (None, 2, 5, 4), (None, 3, 5, 6)]
    e = spark.createDataFrame(rows, "key string, at int, major int, minor int")
    got = {(r["key"], r["at"]) for r in monitor.increases(e, "key", F.struct("major", "minor"), ["at"]).collect()}
    best, want = {}, set()
    for k, at, *v in rows:
        if k not in best or v > best[k]:
            best[k] = v
            want.add((k, at))
    assert got == want


def test_merged_tiles(spark):
    """Against a plain sweep; boxes that touch by an edge, empty boxes, nulls, and a page of very many boxes."""
    import random

    r = random.Random(8)
    boxes = [(f"p{i % 7}", *(lambda x, y: (x, y, x + r.choice([0, 3, 20, 60]), y + r.choice([2, 15, 40])))(r.randrange(500), r.randrange(700))) for i in range(600)]
    boxes += [("edge", 0, 0, 10, 10), ("edge", 15, 0, 20, 10), ("grown", 0, 0, 10, 10), ("grown", 14, 0, 20, 10), ("flat", 0, 0, 0, 10), ("flat", 1, 1, 9, 9), ("null", 0, 0, None, 5), ("null", 0, 0, 5, 5), (None, 0, 0, 9, 9), (None, 1, 1, 3, 3)]
    want = []
    for page in {b[0] for b in boxes}:
        groups = []
        for x0, y0, x1, y1 in sorted((b[1:] for b in boxes if b[0] == page and None not in b[1:]), key=lambda b: (b[1], b[0], b[3], b[2])):
            g = groups[-1] if groups else None
            if g and max(x0 - 5, g[0]) < min(x1 + 5, g[2]) and max(y0 - 5, g[1]) < min(y1 + 5, g[3]) and g[0] < g[2] and g[1] < g[3]:
                groups[-1] = (min(x0, g[0]), min(y0, g[1]), max(x1, g[2]), max(y1, g[3]), g[4] + 1)
            else:
                groups.append((x0, y0, x1, y1, 1))
        want += [(str(page), *map(float, g[:4]), g[4]) for g in groups if g[4] > 1]
    df = spark.createDataFrame(boxes, "page string, x0 int, y0 int, x1 int, y1 int")
    got = maintenance.merge_tiles(df, ["page"])
    assert sorted((str(r["page"]), *tuple(r)[1:]) for r in got.collect()) == sorted(want)
    assert {w[0] for w in want} & {"edge", "grown", "flat", "null", "None"} == {"grown", "None"} and maintenance.merge_tiles(df.limit(0), ["page"]).collect() == []
    strip = spark.range(50_000).selectExpr("1 AS page", "0 AS x0", "id * 3 AS y0", "100 AS x1", "id * 3 + 2 AS y1")
    assert [tuple(r) for r in maintenance.merge_tiles(strip, ["page"]).collect()] == [(1, 0.0, 0.0, 100.0, 149999.0, 50_000)]


def test_catalog_matches(spark):
    catalog = [(5, "five", None, "Atlas", "nothing here"), (2, "two", "", "", "Edge edge Services"), (9, "nine", r"/v\d+/", "zzz", None), (1, "one", None, None, "Mobile Network Roaming Guide"), (7, "seven", None, "", "abc de the"), (3, "three", None, "", "roaming guide")]
    paths = {"docs/ROAMING-guide.pdf": "one", "x/atlas-core": "five", "edges": "two", "the/abc": None, "a/v12/atlas": "five", "a/v3/b": "nine", "network": None, "mobilenetworks": "one", "": None}
    c = spark.createDataFrame(catalog, "position int, code string, pattern string, repository string, title string")
    p = spark.createDataFrame([(x,) for x in [*paths, None, "edges"]], "path string")
    assert {r["path"]: r["code"] for r in maintenance.match_catalog(p, c).collect()} == {k: v for k, v in paths.items() if v}
    assert maintenance.match_catalog(p, c.limit(0)).collect() == [] == maintenance.match_catalog(p.limit(0), c).collect()
    large = spark.range(100_000).selectExpr("id AS position", "concat('c', id) AS code", "string(null) AS pattern", "concat('repo', id) AS repository", "concat('word', id, ' term', id % 5000) AS title")
    some = spark.createDataFrame([("src/repo77777/x",), ("word123-term123",), ("term4 only",)], "path string")
    found = maintenance.match_catalog(some, large)
    # names and words are parts of longer ones
    assert {r["path"]: r["code"] for r in found.collect()} == {"src/repo77777/x": "c7", "word123-term123": "c1"}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def most(plan, metric):
    """The most that a step of an executed plan tells of a metric."""
    inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if "QueryStage" in plan.nodeName() else None
    below = plan.children() if inner is None else None
    own, out = plan.metrics().get(metric), 0
    for x in [inner] if below is None else [below.apply(i) for i in range(below.size())]:
        out = max(out, most(x, metric))
    return max(out, own.get().value() if own.isDefined() else 0)


def test_texts_of_one_part_stay_in_the_jvm(spark):
    """Only texts that are stitched go to the function."""
    hits = rows(spark, [(f"d{i}", 1, j + 1, n, 10 * i + j, f"{'x' * 20_000} {i} {j}") for i in range(40) for n in [1 + (i == 7)] for j in range(n)] + [("null", 1, 1, 1, 999, None)])
    got = shaping.stitch_parts(hits, ["doc_id", "page"])
    content = {r["doc_id"]: r["content"] for r in got.collect()}
    assert len(content) == 41 and content["null"] is None and content["d3"] == f"{'x' * 20_000} 3 0" and content["d7"] == f"{'x' * 20_000} 7 0\n{'x' * 20_000} 7 1"
    assert 40_000 < most(got._jdf.queryExecution().executedPlan(), "pythonDataSent") < 100_000  # all texts are 800 KB


def test_catalog_of_few_words(spark):
    """Words that very many entries share: paths don't meet the entries one by one."""
    catalog = spark.range(3000).selectExpr("3000 - id AS position", "concat('c', 3000 - id) AS code", "string(null) AS pattern", "'' AS repository", "CASE WHEN id % 2 = 0 THEN concat('large ring ', id) ELSE 'ring bolt ring' END AS title")
    paths = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN concat('ring of large ', id) WHEN id % 3 = 1 THEN concat('ring', id) ELSE concat('a large bolt ', id) END AS path")
    found = maintenance.match_catalog(paths, catalog)
    got = {r["path"]: r["code"] for r in found.collect()}
    assert got == {p: "c1" for p in (r["path"] for r in paths.collect()) if "ring" in p}
    assert most(found._jdf.queryExecution().executedPlan(), "numOutputRows") < 50_000  # 300 paths, 3000 entries


def test_functions_in_sql(spark):
    session.register(spark)
    spark.createDataFrame([("a", TABLE), ("b", None), ("c", " ".join(words(700)))], "doc_id string, text string").createOrReplaceTempView("sql_pages")
    got = spark.sql("SELECT p.doc_id, c.* FROM sql_pages p, LATERAL chunk_page(p.text) c")
    want = chunking.chunk_pages(spark.table("sql_pages"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
    small = spark.sql("SELECT p.doc_id, c.* FROM sql_pages p, LATERAL chunk_page(p.text, max_words => 100, overlap => 10) c")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, chunking.chunk_pages(spark.table("sql_pages"), max_words=100, overlap=10).collect())) and small.count() > got.count()
    for wrong in ("chunk_page(1)", "chunk_page('x', most => 3)", "chunk_page('x', max_words => 'y')"):
        with pytest.raises(Exception, match="chunk_page|max_words"):
            spark.sql(f"SELECT * FROM {wrong}").collect()
    spans = spark.sql("SELECT cite_spans('MEC 211 V5.0.2 p. 31, deck pp 4-5', array('Deck')) AS s").first()["s"]
    assert [c["value"] for c in spans["codes"]] == ["MEC 211", "deck"] and [p["cited"] for p in spans["pages"]] == [[31], [4, 5]] and spans["editions"][0]["start"] == 8
    assert spark.sql("SELECT size(cite_spans(CAST(null AS STRING), null).pages) AS n").first()["n"] == 0


def test_edges_of_near_documents(spark, monkeypatch):
    """As by brute force; blocks that can't reach the threshold don't meet; ids of any type, and vectors that take no part."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 6)) * 4
    rows = [(f"d{d:02}", d * 100 + i, (centres[d // 2] + r.normal(size=6)).tolist()) for d in range(24) for i in range(2 + d % 9)]
    odd = [("d00", 9001, None), ("d01", 9002, [float("nan")] * 6), ("d30", 9003, []), ("d02", 9004, [0.0] * 6)]
    df = spark.createDataFrame(rows + odd, "doc_id string, vec_id long, embedding array<double>")
    unit = {i: np.array(v) / (np.linalg.norm(v) + 1e-9) for _, i, v in rows + odd[3:]}
    of = {d: [i for x, i, _ in rows + odd[3:] if x == d] for d, *_ in rows}
    for threshold in (0.9, 0.3, -0.5):
        want = {}
        for a in of:
            for b in of:
                if a < b:
                    s = np.concatenate([np.sort([float(unit[x] @ unit[y]) for y in of[b]])[::-1][:3] for x in of[a]])
                    if round(float(s.mean()), 6) >= threshold:
                        want[(a, b)] = round(float(s.mean()), 6)
        got = {(x["a"], x["b"]): x["weight"] for x in graph.chunk_edges(df, 3, threshold).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got) and len(got) > 5
        centers = graph.centroids(df.where("vec_id < 9000"), "doc_id")
        c = {x["doc_id"]: np.array(x["centroid"]) for x in centers.collect()}
        cosines = {(a, b): float(c[a] @ c[b] / np.linalg.norm(c[a]) / np.linalg.norm(c[b])) for a in c for b in c if a < b}
        assert {(x["a"], x["b"]) for x in graph.centroid_edges(centers, threshold).collect()} == {k for k, v in cosines.items() if v >= threshold}
    blocks = graph._blocks(df, "doc_id", "vec_id")
    met = lambda t: graph.block_pairs(blocks, graph.close_documents(blocks, t, "doc_id"), "doc_id").count()
    n = blocks.select("block").distinct().count()
    assert 0 < met(0.95) < met(0.5) <= met(-1.0) <= n * (n + 1) // 2 and met(0.95) < 0.75 * met(-1.0)
    assert graph.chunk_edges(df.limit(0), 3, 0.3).collect() == []
