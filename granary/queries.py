"""The reference operators applied to the given tables, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import identity, session, text, vectors
from granary.functions.sizes import if_small
from granary.jobs import api
from granary.jobs.scratch import folder, saved
from granary.operators import audit, chunking, dense, evaluate, fusion, graph, maintenance, shaping, sparse
from granary.sources import tables
from granary.sources.postings import Postings
from granary.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries, whole."""
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# ---------------------------------------------------------------- text and identity

_WORDS = r"regexp_extract_all({0}, '[^ \t\n\r\f\v]+')".replace(r" \t\n\r\f\v", r"\s")
_FP = r"trim(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\s+', ' ', 'g'))"


@query("SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL")
def postings(spark, sf_dir):
    return sparse.postings(t(spark, sf_dir, "documents"), key="token").select("doc_id", "token", "tf")


@query("SELECT token, count(DISTINCT doc_id) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token")
def inverse_document_frequency(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    df = sparse.document_frequency(sparse.postings(docs, key="token"), "token")
    return df.select("token", "df", F.round(sparse.idf(F.col("df"), docs.count()), 6).alias("idf"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '\S+')) + len(regexp_extract_all(text, '\|')) + 2 * len(regexp_extract_all(lower(text), '<br\s*/?>')) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    d = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", text.word_count(d).cast("long").alias("words"), text.estimate_tokens(d).cast("long").alias("tokens"))


@query(f"SELECT doc_id, md5({_FP}) AS whole, md5(substr({_FP}, 1, 600)) AS head FROM documents")
def fingerprints(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("whole"), text.fingerprint(F.col("text"), 600).alias("head"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN a <> '' THEN a END, text], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS body,
  array_to_string(list_filter([coalesce(nullif(role, ''), 'unknown'), CASE WHEN turn % 2 = 0 THEN 'V1.' || turn || '.0' END, 'p.' || turn], lambda x: x IS NOT NULL AND x <> ''), ' ') AS label
FROM (SELECT *, array_to_string(list_filter([role, CASE WHEN turn % 2 = 0 THEN 'V1.' || turn || '.0' END, ''], lambda x: x IS NOT NULL AND x <> ''), ' ') AS a FROM conversations)""")
def context_texts(spark, sf_dir):
    edition = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("V1."), F.col("turn").cast("string"), F.lit(".0")))
    c = t(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", text.context_text(F.col("role"), edition, F.lit(""), F.lit(None).cast("string"), F.col("text")).alias("body"),
        text.source_label(F.col("role"), F.lit(None).cast("string"), edition, F.col("turn")).alias("label"),
    )


_PAGE_ENDS = "concat(chr(10), '# ', doc_id, chr(10), '---', chr(10), '**_ETSI_**', chr(10), '_ETSI_ says', chr(10), 'ETSI GS MEC 003 V1.2.', doc_id, ' (2020-01)', chr(10), '![](x.png)', chr(10), '- ')"


@query(rf"""SELECT page_id, line_no, contains(line, '![') OR bare <> '' AND NOT regexp_matches(bare, '^(?:_+ETSI_+|\d{{1,4}}|(?i:ETSI\s+(?:GS|GR|TS|ISG)\s+MEC.*\bV\d+\.\d+\.\d+\b.*))$') AS signal
FROM (SELECT page_id, no AS line_no, line, regexp_replace(line, '^[\s#*>`~.-]+|[\s#*>`~.-]+$', '', 'g') AS bare FROM
 (SELECT doc_id AS page_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no FROM (SELECT doc_id, text || {_PAGE_ENDS} AS t FROM documents)))""")
def signal_lines(spark, sf_dir):
    """Lines of the documents, with a page's furniture at their ends."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.expr(_PAGE_ENDS)).alias("t"))
    lines = d.select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), text.carries_signal(F.col("line")).alias("signal"))


@query(r"""SELECT page_id, h AS heading, list_transform(r, lambda x: replace(x, chr(92), '/')) AS refs FROM
 (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h0, trim(regexp_extract('x' || chr(10) || '## ' || regexp_extract(html, '<h1>([^<]*)</h1>', 1), '(?:^|\n)[ \t]*#+([^\n]*)', 1)) AS h, ['img' || chr(92) || page_id || '.png'] AS r FROM pages)""")
def headings_and_images(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h"))
    md = p.select("page_id", F.concat(F.lit("x\n## "), "h").alias("a"), F.concat(F.lit("see ![fig](img\\"), F.col("page_id").cast("string"), F.lit(".png) here")).alias("b"))
    return md.select("page_id", text.heading(F.col("a")).alias("heading"), text.image_refs(F.col("b")).alias("refs"))


_NUM = "item_id % 60 + 1"


@query(f"""SELECT item_id, 'MEC ' || lpad(({_NUM})::VARCHAR, 3, '0') AS spec_id, 'V' || item_id % 4 || '.' || item_id % 7 || '.1' AS edition, '20' || lpad((item_id % 30)::VARCHAR, 2, '0') || '-05' AS pub_date,
 (item_id % 4)::INT AS major, (item_id % 7)::INT AS minor, 'MEC-' || ({_NUM}) AS canonical, 'MEC ' || lpad(({_NUM})::VARCHAR, 3, '0') AS cited, 'mec-' || ({_NUM}) || '-v' || item_id % 4 AS short_name FROM benchmark""")
def cover_identities(spark, sf_dir):
    """Covers are put together around the benchmark's texts, as no table holds any."""
    i = F.col("item_id")
    s = lambda c: c.cast("string")
    number = F.lpad(s(i % 60 + 1), 3, "0")
    cover = F.concat("text", F.lit("\nETSI  GS\nMEC "), number, F.lit(" V"), s(i % 4), F.lit("."), s(i % 7), F.lit(".1 (20"), F.lpad(s(i % 30), 2, "0"), F.lit("-05)\n"), "text")
    b = t(spark, sf_dir, "benchmark").select(i, identity.cover(cover).alias("c"), s(i % 4).alias("v"))
    c = F.col("c")
    return b.select(
        "item_id", c["spec_id"].alias("spec_id"), c["edition"].alias("edition"), c["pub_date"].alias("pub_date"), c["key"]["major"].alias("major"), c["key"]["minor"].alias("minor"),
        identity.canonical_id(F.lower(c["spec_id"])).alias("canonical"), identity.cited_id(F.replace(c["spec_id"], F.lit(" "), F.lit("‑"))).alias("cited"),
        F.lower(F.concat_ws("-", identity.canonical_id(c["spec_id"]), F.concat(F.lit("v"), "v"))).alias("short_name"),
    )


#: Covers in SQL that Spark and the check read alike: one space, several or none between edition and date, parts, two families, no cover at all.
_COVERS = """concat(text, CASE item_id % 6 WHEN 0 THEN concat(' ETSI GS MEC 0', item_id % 90 + 10, ' V', item_id % 4 + 1, '.1.1 (2020-05)') WHEN 1 THEN concat(chr(10), 'ETSI', chr(10), 'GR MEC 0', item_id % 90 + 10, '-2 V3.', item_id % 20, '.1(2022-03)')
 WHEN 2 THEN concat(' ETSI GS MEC-DEC 0', item_id % 90 + 10, ' V1.2.', item_id % 3, '   (2019-', lpad(concat('', item_id % 12 + 1), 2, '0'), ')') WHEN 3 THEN ' ETSI GS MEC 003 (2020-05)' WHEN 4 THEN ' ETSI XX MEC 003 V1.1.1 (2020-05)' ELSE ' ETSI TS MEC 003 V1.1 (2020-05)' END, chr(10), text)"""


@query(rf"""SELECT item_id, m[1] AS family, regexp_replace(split_part(m[1], ' V', 1), '\s+', ' ', 'g') AS spec_id, 'V' || regexp_extract(m[1], ' V([0-9.]+)', 1) AS edition, regexp_extract(m[1], '([0-9-]+)\)$', 1) AS pub_date
 FROM (SELECT item_id, regexp_extract_all(regexp_replace({_COVERS}, '\s+', ' ', 'g'), 'ETSI (?:GS|GR|TS|ISG) (MEC(?:-DEC)? [0-9]+(?:-[0-9]+)? V[0-9]+[.][0-9]+[.][0-9]+ ?\([0-9]{{4}}-[0-9]{{2}}\))', 1) AS m FROM benchmark) WHERE len(m) > 0""".replace("m[1] AS family, ", ""))
def parsed_covers(spark, sf_dir):
    c = identity.cover(F.expr(_COVERS))
    return t(spark, sf_dir, "benchmark").select("item_id", c["spec_id"].alias("spec_id"), c["edition"].alias("edition"), c["pub_date"].alias("pub_date")).where("spec_id IS NOT NULL")


@query("""SELECT page_id, 'MEC-' || lpad((page_id % 60)::VARCHAR, 3, '0') || CASE WHEN page_id % 2 = 0 THEN '-02' ELSE '' END AS spec, (page_id % 5)::INT AS major, (page_id % 9)::INT AS minor, 1 AS patch,
 page_id % 3 <> 0 AS release, page_id % 60 <> page_id % 7 AS mislabeled FROM pages""")
def release_addresses(spark, sf_dir):
    """Release addresses are made from the pages' ids."""
    i = F.col("page_id")
    two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    digits = F.concat(two(i % 60, 3), F.when(i % 2 == 0, "02").otherwise(""))
    url = F.concat(F.lit("https://example.org/"), F.when(i % 3 != 0, "Deliver").otherwise("other"), F.lit("/gs_mec"), digits, F.lit("v"), two(i % 5), two(i % 9), F.lit("01p.PDF"))
    p = t(spark, sf_dir, "pages").select(i, url.alias("u"))
    v = identity.release_version(F.col("u"))
    return p.select(
        "page_id", identity.release_id(F.col("u")).alias("spec"), v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), identity.is_release(F.col("u")).alias("release"),
        identity.mislabeled(F.concat(F.lit("file "), two(i % 7, 3)), identity.release_id(F.col("u"))).alias("mislabeled"),
    )


_RAW = "CASE doc_id % 5 WHEN 0 THEN concat('mec-0', doc_id % 90) WHEN 1 THEN concat(' gs_', doc_id % 500, '-2 ') WHEN 2 THEN concat('MEC-DEC-0', doc_id % 90) WHEN 3 THEN source ELSE 'no number' END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(x, '{{0}}') THEN 'MEC' || lpad(regexp_extract(x, '{{0}}', 1), 3, '0') || regexp_extract(x, '{{0}}', 2) ELSE x END AS normal,
 CASE WHEN starts_with(x, 'MEC-DEC-') THEN 'MEC-DEC' || substr(x, 9) WHEN starts_with(x, 'MEC-') THEN 'MEC' || substr(x, 5) ELSE x END AS label,
 CASE WHEN d = '' THEN 0 ELSE (d::BIGINT // 10) % 20 END::INT AS colour FROM (SELECT doc_id, upper(trim({_RAW})) AS x, regexp_replace({_RAW}, '\D', '', 'g') AS d FROM documents)""".format(r"(?:MEC|GS|GR)?[_\-\s]?0*([0-9]{1,3})(-[0-9]+)?"))
def name_forms(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW).alias("raw"))
    raw = F.col("raw")
    return d.select("doc_id", identity.normal_id(raw).alias("normal"), identity.label(F.upper(F.trim(raw))).alias("label"), identity.colour_group(raw).alias("colour"))


_COVER_TEXT = "concat('x ETSI GS', chr(10), 'MEC ', lpad(concat('', item_id % 60 + 1), 3, '0'), ' V', item_id % 4, '.1.1 (2020-05)  ', text, CASE WHEN item_id % 2 = 0 THEN ' Keywords: a, b' ELSE '' END)"
_TITLE_SQL = f"(SELECT item_id, nullif(trim(CASE WHEN regexp_matches(rest, '{identity.TITLE_STOP}') THEN regexp_extract(rest, '^(.*?){identity.TITLE_STOP}', 1) ELSE substr(rest, 1, 140) END, ' ,;.-'), '') AS title FROM (SELECT item_id, regexp_extract(regexp_replace({_COVER_TEXT}, '\\s+', ' ', 'g'), '{identity.COVER}(.*)$', 7) AS rest FROM benchmark))"


@query(rf"""SELECT item_id, title, CASE WHEN item_id % 3 = 0 THEN item_id || '.pdf' ELSE concat_ws('-', 'MEC00' || item_id % 9, CASE WHEN item_id % 4 <> 0 THEN 'V1.1.1' END, nullif(CASE WHEN length(slug) > 60 THEN regexp_extract(substr(slug, 1, 60), '^(.*?)(?:-[^-]*)?$', 1) ELSE slug END, '')) || '.pdf' END AS name
FROM (SELECT *, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[^\p{{L}}\p{{N}}_ ;().-]', '', 'g'), '[ ;]+', '-', 'g'), '-.') AS slug FROM {_TITLE_SQL})""")
def file_names(spark, sf_dir):
    """Titles behind covers that are put before the benchmark's texts, and the names that files get from them."""
    b = t(spark, sf_dir, "benchmark").select("item_id", identity.title(F.expr(_COVER_TEXT)).alias("title"))
    i = F.col("item_id")
    label = F.when(i % 3 != 0, F.concat(F.lit("MEC00"), (i % 9).cast("string")))
    return b.select("item_id", "title", identity.file_name(label, F.concat(i.cast("string"), F.lit(".pdf")), F.col("title"), F.when(i % 4 != 0, "V1.1.1")).alias("name"))


@query("""SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 7 + 1 <> page_id % 5 + 1""")
def cover_disagreements(spark, sf_dir):
    """Pages as releases: the cover's code against the one in the address; every third has no cover."""
    i = F.col("page_id")
    cover = F.when(i % 3 != 0, F.concat(F.lit("mec 0"), (i % 7 + 1).cast("string")))
    url = F.concat(F.lit("https://example.org/deliver/gs_mec00"), (i % 5 + 1).cast("string"), F.lit("v010101p.pdf"))
    return t(spark, sf_dir, "pages").where(identity.disagrees(cover, identity.release_id(url))).select("page_id")


# ---------------------------------------------------------------- retrieval

#: CRC-32 of a token by its table, 31 bits.
_TOKEN_ID = """(SELECT token, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT)) & 2147483647 AS id
 FROM (SELECT DISTINCT token, hex(encode(token)) AS x FROM {0}), (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i)) AS t))"""
_SPARSE = f"""(WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
 ids AS MATERIALIZED {_TOKEN_ID.format("(SELECT token FROM d UNION ALL SELECT token FROM q)")}, p AS (SELECT doc_id, id, count(*) AS tf FROM d JOIN ids USING (token) GROUP BY ALL), f AS (SELECT id, count(*) AS df FROM p GROUP BY id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, doc_id, round(sum(q_tf * tf * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score
 FROM p JOIN (SELECT query_id, id, count(*) AS q_tf FROM q JOIN ids USING (token) GROUP BY ALL) USING (id) JOIN f USING (id), (SELECT count(*) AS n FROM documents) GROUP BY ALL) QUALIFY rank <= {{0}})"""


def sparse_sql(k: int, documents: str = "documents") -> str:
    return _SPARSE.format(k).replace("FROM documents", f"FROM {documents}")


_stores: dict[tuple, Postings] = {}


def stored(spark: SparkSession, sf_dir: str) -> Postings:
    """The documents' postings, by the marks that searches filter by. They are written once for the tables' files as they are, so
    all searches of a session read one store; ingest would write them with the documents."""
    files = []
    for name in ("documents", "labels"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path)]
    key = (spark.sparkContext.applicationId, *files)
    if key not in _stores:
        store = Postings(spark, folder(spark), "doc_id", ("is_current", "has_diagram"))
        store.append(marked(spark, sf_dir))
        _stores[key] = store
    return _stores[key]


@query(sparse_sql(25))
def sparse_search(spark, sf_dir):
    return stored(spark, sf_dir).search(asked(spark, sf_dir), 25)


@query(sparse_sql(10))
def sparse_scan(spark, sf_dir):
    """The same without stored postings, in two passes over the texts."""
    return sparse.search(t(spark, sf_dir, "documents"), asked(spark, sf_dir), 10)


@query(f"SELECT id AS token_id, count(*) AS postings, sum(tf)::BIGINT AS occurrences FROM (SELECT doc_id, id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) JOIN {_TOKEN_ID.format("(SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)")} USING (token) GROUP BY ALL) GROUP BY id")
def stored_postings(spark, sf_dir):
    """What the store holds of each token, over all of its blocks."""
    rows = stored(spark, sf_dir).rows().where("range >= 0")
    tf = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.groupBy("token_id").agg(F.sum("n").alias("postings"), F.sum(tf).alias("occurrences"))


_DENSE = """SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, (SELECT * FROM embeddings LEFT JOIN labels ON doc_id = vec_id WHERE coalesce(quality, 1) <> 0) v) QUALIFY rank <= 25"""


def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose document isn't marked as superseded; those without a mark count as current."""
    marks = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") != 0).alias("is_current"))
    return t(spark, sf_dir, "embeddings").join(marks, "vec_id", "left").where(maintenance.is_current())


@query(_DENSE)
def dense_search(spark, sf_dir):
    queries_ = t(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k(current_vectors(spark, sf_dir), queries_, 25)


#: Documents that a search may return: not superseded, and with a diagram if asked for. Every fifth document has one.
_MAY = "(SELECT * FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) WHERE coalesce(quality, 1) <> 0{0})"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their marks."""
    marks = t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") != 0).alias("is_current"))
    return t(spark, sf_dir, "documents").withColumn("has_diagram", F.col("doc_id") % 5 == 0).join(marks, "doc_id", "left")


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their marks and vectors (null where there is none)."""
    dense_ = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return marked(spark, sf_dir).join(dense_, "doc_id", "left")


def asked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as texts and vectors; the vector of an item's number stands in for its own, as no table holds any. Items without
    one are searched by terms alone."""
    v = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return asked(spark, sf_dir).join(v, "query_id", "left")


def hybrid_sql(k: int, prefetch: int, more: str = "") -> str:
    may = _MAY.format(more)
    near = f"""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id AS query_id, d.doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v JOIN {may} d ON d.doc_id = v.vec_id) QUALIFY rank <= {prefetch}"""
    return f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
 SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM ({sparse_sql(prefetch, may)}) UNION ALL SELECT query_id, doc_id, rank FROM ({near})) GROUP BY ALL) QUALIFY rank <= {k}"""


@query(hybrid_sql(30, 100))
def hybrid_fusion(spark, sf_dir):
    return fusion.hybrid(searchable(spark, sf_dir), asked_twice(spark, sf_dir), 30, 100, stored=stored(spark, sf_dir))


@query(hybrid_sql(10, 40, " AND doc_id % 5 = 0"))
def hybrid_with_diagrams(spark, sf_dir):
    return fusion.hybrid(searchable(spark, sf_dir), asked_twice(spark, sf_dir), 10, 40, diagrams_only=True, stored=stored(spark, sf_dir))


_LATE = """WITH d AS (SELECT vec_id // 4 AS doc_id, list(embedding::DOUBLE[] ORDER BY vec_id) AS v FROM embeddings GROUP BY ALL),
pool AS (SELECT query_id, vec_id // 4 AS doc_id FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS r
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings v) WHERE r <= 60 GROUP BY ALL),
s AS (SELECT p.query_id, p.doc_id, list_sum(list_transform(q.v, lambda x: list_max(list_transform(d.v, lambda y: list_inner_product(x, y))))) AS s
  FROM pool p JOIN d ON d.doc_id = p.doc_id JOIN d q ON q.doc_id = p.query_id // 4)
SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 15"""


@query(_LATE)
def late_interaction(spark, sf_dir):
    """Four neighbouring vectors stand in for a document's token vectors, as no table holds any."""
    e = t(spark, sf_dir, "embeddings").withColumn("doc_id", F.expr("vec_id div 4"))
    docs = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p")).select("doc_id", F.transform("p", lambda x: x["embedding"]).alias("tokens"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "doc_id")
    pool = dense.top_k(e, q, 60).select("query_id", F.expr("vec_id div 4").alias("doc_id")).distinct()
    asked_ = q.select("query_id", "doc_id").join(docs, "doc_id").select("query_id", "tokens")
    return dense.rerank(pool, docs, asked_, 15)


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS cosine, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
 round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first_unit FROM embeddings""")
def vector_functions(spark, sf_dir):
    e = F.col("embedding")
    return t(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(vectors.cosine(e, F.reverse(e)), 6).alias("cosine"), F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.unit(e)[0], 6).alias("first_unit")
    )


# ---------------------------------------------------------------- chunks and shaping

_WINDOWS = r"""SELECT doc_id, (i + 1)::INT AS chunk_part, n AS total_parts, array_to_string(w[(i * 260 + 1):(i * 260 + 300)], ' ') AS text
FROM (SELECT doc_id, w, n, unnest(range(0, n::BIGINT)) AS i FROM (SELECT doc_id, w, CASE WHEN len(w) > 300 THEN ceil(len(w) / 260.0) ELSE 1 END::INT AS n FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)) WHERE len(w) > 0)"""


@query(_WINDOWS)
def prose_windows(spark, sf_dir):
    return chunking.prose_windows(t(spark, sf_dir, "documents"))


def sentence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page: a heading, its text and a table of its sentences."""
    rows = F.array_join(F.transform(F.split("text", r"\. "), lambda s, k: F.concat(F.lit("| "), k.cast("string"), F.lit(" | "), F.translate(s, "\r\n|", "  /"), F.lit(" |"))), "\n")
    page = F.concat(F.lit("## 5."), F.col("doc_id").cast("string"), F.lit(" Part\n\n"), "text", F.lit("\n\n| no | sentence |\n|---|---|\n"), rows)
    return t(spark, sf_dir, "documents").select("doc_id", page.alias("text"))


@query()
def chunk_pages(spark, sf_dir):
    return chunking.chunk_pages(sentence_pages(spark, sf_dir))


@query(r"""SELECT doc_id, count(*) AS n_rows, md5(string_agg('| ' || k || ' | ' || translate(sentence, chr(13) || chr(10) || '|', '  /') || ' |', chr(10) ORDER BY k)) AS rows FROM
 (SELECT doc_id, unnest(string_split(text, '. ')) AS sentence, unnest(range(len(string_split(text, '. ')))) AS k FROM documents) GROUP BY doc_id""")
def chunked_rows(spark, sf_dir):
    """The table rows of all chunks: each row of the page is in one chunk, whole, under its header."""
    c = chunking.chunk_pages(sentence_pages(spark, sf_dir)).where(F.contains("text", F.lit("| no | sentence |\n|---|---|\n| ")))
    table = F.substring_index("text", "| no | sentence |\n|---|---|\n", -1)
    rows = c.select("doc_id", F.explode(F.split(table, "\n")).alias("row"))
    rows = rows.select("doc_id", F.regexp_extract("row", r"^\| (\d+) \|", 1).cast("int").alias("k"), "row")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.md5(F.array_join(ordered, "\n")).alias("rows"))


@query(_sql["chunked_rows"])
def chunked_rows_by_sql(spark, sf_dir):
    """The same in SQL: pages meet the table function laterally."""
    session.register(spark)
    pages = sentence_pages(spark, sf_dir)
    return spark.sql(
        r"""WITH c AS (SELECT p.doc_id, c.text FROM {pages} p, LATERAL chunk_page(p.text) c WHERE contains(c.text, '| no | sentence |\n|---|---|\n| ')),
        r AS (SELECT doc_id, explode(split(substring_index(text, '| no | sentence |\n|---|---|\n', -1), '\n')) AS row FROM c),
        k AS (SELECT doc_id, cast(regexp_extract(row, '^\\| ([0-9]+) \\|', 1) AS INT) AS k, row FROM r)
        SELECT doc_id, count(*) AS n_rows, md5(array_join(transform(array_sort(collect_list(struct(k, row))), x -> x.row), '\n')) AS rows FROM k GROUP BY doc_id""",
        pages=pages,
    )


@query(r"""SELECT doc_id, CASE WHEN len(w) > 300 THEN ceil(len(w) / 260.0) ELSE 1 END::INT AS stitched_parts, md5(array_to_string(w, ' ') || CASE WHEN len(w) > 300 AND len(w) % 260 = 1 THEN ' ' || w[-1] ELSE '' END) AS words FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents) WHERE len(w) > 0""")
def stitched_windows(spark, sf_dir):
    """Windows put together again give the words they were cut from (and a last window of one word, which is never trimmed)."""
    parts = chunking.prose_windows(t(spark, sf_dir, "documents")).select("doc_id", F.col("chunk_part").alias("rank"), "chunk_part", "total_parts", F.col("text").alias("content"))
    out = shaping.stitch_parts(parts, ["doc_id"])
    return out.select("doc_id", F.coalesce("stitched_parts", F.lit(1)).alias("stitched_parts"), F.md5(F.regexp_replace("content", r"\s+", " ")).alias("words"))


@query("""SELECT conv_id, min(turn)::INT AS first_part, count(*) AS parts, min(rank) AS rank FROM (
 SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, rank) AS run FROM (
  SELECT *, CASE WHEN turn = lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, rank) + 1 THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn, turn * 7 % 11 AS rank FROM conversations WHERE (conv_id + turn) % 4 <> 1)))
 GROUP BY conv_id, run""")
def part_runs(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").where("(conv_id + turn) % 4 <> 1")
    hits = c.select("conv_id", F.col("turn").cast("int").alias("chunk_part"), F.lit(99).alias("total_parts"), (F.col("turn") * 7 % 11).alias("rank"))
    return shaping.runs(hits, ["conv_id"]).groupBy("conv_id", "run").agg(F.min("chunk_part").alias("first_part"), F.count("*").alias("parts"), F.min("rank").alias("rank")).drop("run")


@query(f"SELECT min(doc_id) AS doc_id, md5({_FP}) AS print FROM documents GROUP BY 2")
def distinct_texts(spark, sf_dir):
    d = shaping.distinct_texts(t(spark, sf_dir, "documents"), [], ["doc_id"], "text")
    return d.select("doc_id", text.fingerprint(F.col("text")).alias("print"))


def shaped_sql(keep: int, per_doc: int) -> str:
    return f"""SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n2 FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM (
  SELECT s.*, d.source, row_number() OVER (PARTITION BY query_id, md5({_FP}) ORDER BY rank) AS k FROM ({sparse_sql(100)}) s JOIN documents d USING (doc_id)) WHERE k = 1) WHERE n <= {per_doc}) WHERE n2 <= {keep}"""


def _shaped(spark: SparkSession, sf_dir: str, keep: int, per_doc: int) -> DataFrame:
    """Hits take their document's print and head along, not its text; only documents that were found get a print."""
    hits = saved(spark, stored(spark, sf_dir).search(asked(spark, sf_dir), 100))
    docs = t(spark, sf_dir, "documents").join(if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    known = docs.select("doc_id", "source", text.fingerprint(F.col("text")).alias("print"), F.substring("text", 1, 40).alias("head"))
    bucket = text.quota_bucket(F.lit(""), F.col("source"), F.col("head"))
    return shaping.shape(hits.join(known, "doc_id"), bucket, keep, per_doc, text="print").select("query_id", "doc_id", "rank")


@query(shaped_sql(5, 1))
def display_budget(spark, sf_dir):
    return _shaped(spark, sf_dir, 5, 1)


@query(shaped_sql(15, 2))
def evidence_budget(spark, sf_dir):
    return _shaped(spark, sf_dir, 15, 2)


def chunks_to_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: a page each, its source as the document."""
    d = searchable(spark, sf_dir).withColumnRenamed("doc_id", "id")
    return d.select(
        "id", "text", "embedding", "is_current", "has_diagram", F.col("source").alias("doc_id"), F.col("id").alias("page"), F.lit(1).alias("chunk_part"), F.lit(1).alias("total_parts"),
        F.lit("").alias("content_md5"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("MEC "), F.col("id").cast("string"))).alias("spec_id"), F.when(F.col("id") % 4 == 0, "V1.1.1").alias("edition"),
        F.when(F.col("has_diagram"), F.array(F.lit("a.png"), F.concat("source", F.lit(".png")))).alias("diagram_paths"), F.when(F.col("id") % 7 == 0, F.col("lang")).alias("heading"),
    )


_EVIDENCE_ROWS = f"""SELECT query_id, doc_id AS id, rank, source, text, lang, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM (
  SELECT s.*, d.source, d.text, d.lang, row_number() OVER (PARTITION BY query_id, md5({_FP}) ORDER BY rank) AS k FROM ({hybrid_sql(90, 180)}) s JOIN documents d USING (doc_id)) WHERE k = 1) WHERE n <= 2 QUALIFY i <= 15"""


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(spark, sf_dir)[1]


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of chunks has their ids; here they are the documents'."""
    store = stored(spark, sf_dir)
    by_chunk = Postings(spark, store.folder, "id", tuple(store.by))
    return api.search(chunks_to_search(spark, sf_dir), asked_twice(spark, sf_dir), stored=by_chunk)


@query(f"SELECT query_id, id, rank FROM ({_EVIDENCE_ROWS})")
def search_evidence(spark, sf_dir):
    return evidence_rows(spark, sf_dir).select("query_id", "id", "rank")


@query(f"SELECT query_id, id, rank FROM ({_EVIDENCE_ROWS})".replace("n <= 2", "n <= 1").replace("i <= 15", "i <= 5"))
def search_display(spark, sf_dir):
    return searched(spark, sf_dir)[0].select("query_id", "id", "rank")


@query(f"""SELECT query_id, md5(string_agg('--- [Source ' || i || '] ' || concat_ws(' ', CASE WHEN id % 3 <> 0 THEN 'MEC ' || id ELSE source END, CASE WHEN id % 4 = 0 THEN 'V1.1.1' END, 'p.' || id)
 || CASE WHEN id % 7 = 0 THEN ' \u2014 ' || lang ELSE '' END || CASE WHEN id % 5 = 0 THEN ' \u2014 Diagrams: a.png, ' || source || '.png' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS context FROM ({_EVIDENCE_ROWS}) GROUP BY query_id""")
def search_context(spark, sf_dir):
    return api.context(evidence_rows(spark, sf_dir)).select("query_id", F.md5("context").alias("context"))


@query(rf"SELECT query_id, count(*) AS excerpts, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS words, 0 AS merged FROM ({_EVIDENCE_ROWS}) GROUP BY query_id")
def answer_counts(spark, sf_dir):
    return api.answer_counts(evidence_rows(spark, sf_dir))


_LATE_ROWS = f"""WITH v AS (SELECT vec_id, list(embedding::DOUBLE[]) OVER (ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS tokens, embedding FROM embeddings),
may AS (SELECT v.*, d.source, d.text FROM v JOIN {_MAY.format("")} d ON d.doc_id = v.vec_id),
pool AS (SELECT q.vec_id AS query_id, m.vec_id AS id, q.tokens AS q, m.tokens AS d, source, text FROM v q, may m WHERE q.vec_id % 50 = 0
 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) DESC, m.vec_id) <= 45),
s AS (SELECT *, round(list_sum(list_transform(q, lambda x: list_max(list_transform(d, lambda y: list_inner_product(x, y))))), 6) AS score FROM pool),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, md5({_FP}) ORDER BY rank) AS k FROM r WHERE rank <= 45) WHERE k = 1) WHERE n <= 2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 15"""


@query(_LATE_ROWS)
def late_search(spark, sf_dir):
    """The job's search by late interaction, filtered on both levels. A vector and the two behind it stand in for token vectors."""
    e = t(spark, sf_dir, "embeddings")
    ahead = e.select(F.explode(F.array(*(F.col("vec_id") - i for i in range(3)))).alias("id"), "vec_id", "embedding")
    tokens = ahead.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("tokens"))
    queries_ = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding").join(tokens, F.col("query_id") == F.col("id")).drop("id")
    chunks = chunks_to_search(spark, sf_dir).join(tokens, "id", "left")
    return api.search(chunks, queries_, mode="late")[1].select("query_id", "id", "rank")


# ---------------------------------------------------------------- maintenance


@query("SELECT d.doc_id, d.lang, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT (l.quality IS NOT DISTINCT FROM 0)")
def current_documents(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    marks = t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") != 0).alias("is_current"))
    return d.join(marks, "doc_id", "left").where(maintenance.is_current()).drop("is_current")


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(substr({_FP}, 1, 600)) ORDER BY CASE WHEN regexp_matches(lower(source), '^src1[0-9]$') THEN 0 ELSE 1 END, doc_id::VARCHAR) AS n FROM documents) WHERE n = 1""")
def survivors(spark, sf_dir):
    return maintenance.elect_survivors(t(spark, sf_dir, "documents"), "source", "doc_id", "^src1[0-9]$").select("doc_id")


@query("""SELECT name, md5 FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY CASE WHEN contains(name, digits) THEN 0 ELSE 1 END, CASE WHEN contains(name, digits) THEN 0 ELSE length(name) END, name) AS n, max(indexed) OVER (PARTITION BY md5) AS have
 FROM (SELECT md5(text) AS md5, source || '-' || doc_id AS name, doc_id % 9 = 4 AS indexed, lpad((doc_id % 10)::VARCHAR, 2, '1') AS digits FROM documents)) WHERE CASE WHEN have THEN indexed ELSE n = 1 END""")
def keepers(spark, sf_dir):
    i = F.col("doc_id")
    files = t(spark, sf_dir, "documents").select(
        F.md5("text").alias("md5"), F.concat_ws("-", "source", i.cast("string")).alias("name"), (i % 9 == 4).alias("indexed"), F.lpad((i % 10).cast("string"), 2, "1").alias("cover_digits")
    )
    return maintenance.elect_keepers(files).select("name", "md5")


@query("SELECT doc_id, md5(text) AS md5, min(doc_id) OVER (PARTITION BY md5(text)) AS first, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents")
def files_by_content(spark, sf_dir):
    return maintenance.by_content(t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5")), "md5", "doc_id")


_EDITIONS = "(SELECT doc_id, CASE WHEN doc_id % 41 <> 0 THEN source END AS spec_id, {major: (doc_id % 4)::INT, minor: (doc_id % 12)::INT, patch: (doc_id % 3)::INT} AS key, source || doc_id % 5 AS file FROM documents)"


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    key = F.struct((i % 4).cast("int").alias("major"), (i % 12).cast("int").alias("minor"), (i % 3).cast("int").alias("patch"))
    return t(spark, sf_dir, "documents").select("doc_id", F.when(i % 41 != 0, F.col("source")).alias("spec_id"), key.alias("key"), F.concat("source", (i % 5).cast("string")).alias("file"))


@query(f"SELECT doc_id, spec_id, spec_id IS NULL OR key = max(key) OVER (PARTITION BY spec_id) AS is_current FROM {_EDITIONS}")
def newest_editions(spark, sf_dir):
    return maintenance.current_editions(editions(spark, sf_dir)).select("doc_id", "spec_id", "is_current")


@query(f"SELECT spec_id, key.major AS major, key.minor AS minor, key.patch AS patch, n AS rows, row_number() OVER (PARTITION BY spec_id ORDER BY key DESC) AS place FROM (SELECT spec_id, key, count(*) AS n FROM {_EDITIONS} WHERE spec_id IS NOT NULL GROUP BY ALL)")
def edition_listing(spark, sf_dir):
    listed = maintenance.edition_listing(editions(spark, sf_dir))
    return listed.select("spec_id", "key.major", "key.minor", "key.patch", "rows", "place")


@query(f"""SELECT spec_id, sum(CASE WHEN cur THEN 0 ELSE n END)::BIGINT AS superseded, sum(n * (s - 1) // s)::BIGINT AS duplicates FROM (
 SELECT spec_id, key, count(*) AS n, count(DISTINCT file) AS s, bool_and(cur) AS cur FROM (SELECT *, spec_id IS NULL OR key = max(key) OVER (PARTITION BY spec_id) AS cur FROM {_EDITIONS}) GROUP BY spec_id, key) GROUP BY spec_id""")
def superseded_rows(spark, sf_dir):
    return maintenance.superseded(editions(spark, sf_dir))


_CHUNKS = "(SELECT d.doc_id, CASE WHEN d.doc_id % 6 <> 0 THEN source ELSE '' END AS spec_id, lang AS filename, CASE WHEN d.doc_id % 4 <> 0 THEN 'V' || d.doc_id % 4 END AS edition, d.doc_id % 5 = 0 AS has_diagram, l.quality <> 0 AS is_current FROM documents d LEFT JOIN labels l USING (doc_id))"


def stat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    marks = t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") != 0).alias("is_current"))
    d = t(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 6 != 0, F.col("source")).otherwise("").alias("spec_id"), F.col("lang").alias("filename"), F.when(i % 4 != 0, F.concat(F.lit("V"), (i % 4).cast("string"))).alias("edition"), (i % 5 == 0).alias("has_diagram")
    )
    return d.join(marks, "doc_id", "left")


@query(f"SELECT coalesce(nullif(spec_id, ''), nullif(filename, ''), '?') AS spec, coalesce(edition, '?') AS edition, count(*) AS chunks, sum(has_diagram::INT)::BIGINT AS diagrams, bool_and(coalesce(is_current, true)) AS is_current FROM {_CHUNKS} GROUP BY 1, 2")
def corpus_stats(spark, sf_dir):
    return maintenance.stats(stat_chunks(spark, sf_dir))


@query(f"SELECT count(*) AS chunks, count(DISTINCT spec_id) AS specs, count(DISTINCT CASE WHEN edition IS NOT NULL THEN spec_id || '/' || edition END) AS editions, sum(has_diagram::INT)::BIGINT AS diagrams FROM {_CHUNKS}")
def headline_metrics(spark, sf_dir):
    return maintenance.headline(stat_chunks(spark, sf_dir))


@query("SELECT source, doc_id FROM (SELECT source, unnest(range(1, top + 1)) AS doc_id FROM (SELECT source, max(doc_id // 10) AS top FROM documents GROUP BY source)) ANTI JOIN (SELECT source, doc_id // 10 AS doc_id FROM documents) USING (source, doc_id)")
def number_gaps(spark, sf_dir):
    return maintenance.gaps(t(spark, sf_dir, "documents").select("source", F.expr("doc_id div 10").alias("doc_id")), "doc_id", "source")


@query("""WITH RECURSIVE b AS (SELECT l_suppkey AS page, (l_partkey % 400)::DOUBLE AS x0, (l_orderkey % 900)::DOUBLE AS y0, x0 + l_quantity AS x1, y0 + l_linenumber * 4.0 AS y1 FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, y1, x1) AS i FROM b),
s AS (SELECT page, i, x0, y0, x1, y1, 1 AS g, 1 AS tiles FROM n WHERE i = 1 UNION ALL
 SELECT n.page, n.i, CASE WHEN m THEN least(s.x0, n.x0) ELSE n.x0 END, CASE WHEN m THEN least(s.y0, n.y0) ELSE n.y0 END, CASE WHEN m THEN greatest(s.x1, n.x1) ELSE n.x1 END, CASE WHEN m THEN greatest(s.y1, n.y1) ELSE n.y1 END, CASE WHEN m THEN s.g ELSE s.g + 1 END, CASE WHEN m THEN s.tiles + 1 ELSE 1 END
 FROM s JOIN n ON n.page = s.page AND n.i = s.i + 1, LATERAL (SELECT greatest(n.x0 - 5, s.x0) < least(n.x1 + 5, s.x1) AND greatest(n.y0 - 5, s.y0) < least(n.y1 + 5, s.y1) AS m) t)
SELECT page, x0, y0, x1, y1, tiles::BIGINT AS tiles FROM s QUALIFY row_number() OVER (PARTITION BY page, g ORDER BY i DESC) = 1 AND tiles > 1""")
def merged_tiles(spark, sf_dir):
    """Boxes from the numbers of the line items, a page a supplier."""
    boxes = t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS page", "double(l_partkey % 400) AS x0", "double(l_orderkey % 900) AS y0", "l_quantity", "l_linenumber")
    return maintenance.merge_tiles(boxes.withColumns({"x1": F.col("x0") + F.col("l_quantity"), "y1": F.col("y0") + F.col("l_linenumber") * 4.0}), ["page"])


_TITLES = "lower(concat(p_name, ' ', p_type))"


@query(f"""WITH w AS (SELECT p_partkey, unnest(list_filter(string_split({_TITLES}, ' '), lambda w: length(w) > 3)) AS w FROM part), c AS (SELECT p_partkey, w, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[^ ]+')[1:12])) AS x FROM documents), paths AS (SELECT doc_id, lower(concat(substr(text, 1, 40), ' ', (SELECT string_agg(p_name, '/' ORDER BY p_partkey) FROM part WHERE p_partkey IN (doc_id % 190 + 1, doc_id % 7 + 1)))) AS path FROM documents),
hits AS (SELECT doc_id, p_partkey, sum(n) AS n FROM paths JOIN c ON contains(path, w) GROUP BY ALL HAVING sum(n) >= 2)
SELECT path, 'part ' || min(p_partkey) AS code FROM hits JOIN paths USING (doc_id) GROUP BY path""".replace("s AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[^ ]+')[1:12])) AS x FROM documents), ", ""))
def catalog_of_parts(spark, sf_dir):
    """The parts as a catalog of titles; paths hold a document's first characters and two parts' names. No patterns, so equal joins only."""
    parts = t(spark, sf_dir, "part")
    catalog = parts.select(F.col("p_partkey").alias("position"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("code"), F.lit(None).cast("string").alias("pattern"), F.lit("").alias("repository"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    i = F.col("doc_id")
    both = t(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("head"), F.explode(F.array_distinct(F.array(i % 190 + 1, i % 7 + 1))).alias("p_partkey"))
    named = both.join(parts.select("p_partkey", "p_name"), "p_partkey").groupBy("doc_id", "head").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("p"))
    paths = named.select(F.lower(F.concat("head", F.lit(" "), F.array_join(F.transform("p", lambda x: x["p_name"]), "/"))).alias("path"))
    return maintenance.match_catalog(paths, catalog)


@query("SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_report(spark, sf_dir):
    return maintenance.missing(t(spark, sf_dir, "documents").select("source", "doc_id"), t(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT url AS path, min_by(code, pos) AS code FROM pages, (VALUES (0, 'news', '/en/[0-9]*1$', 'zzz', 'x'), (1, 'blog', 'nomatch', 'blog.', 'x'), (2, 'mail', 'nomatch', '', 'then example thing'), (3, 'all', '/de/', 'zzz', 'x')) c(pos, code, pattern, repo, title)
 WHERE regexp_matches(lower(url), pattern) OR (repo <> '' AND contains(lower(url), repo)) OR len(list_filter(string_split(lower(title), ' '), lambda w: length(w) > 3 AND contains(lower(url), w))) >= 2 GROUP BY url""")
def catalog_matches(spark, sf_dir):
    catalog = spark.createDataFrame(
        [(0, "news", "/en/[0-9]*1$", "zzz", "x"), (1, "blog", "nomatch", "blog.", "x"), (2, "mail", "nomatch", "", "then example thing"), (3, "all", "/de/", "zzz", "x")],
        "position int, code string, pattern string, repository string, title string",
    )
    return maintenance.match_catalog(t(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct(), catalog)


_IMAGES = "(SELECT p_type AS doc_id, p_partkey AS path, p_size * 12 AS width, p_size * 9 AS height, p_size % 9 AS hi, md5(p_brand) AS md5 FROM part)"


@query(f"SELECT doc_id, path, good AND row_number() OVER (PARTITION BY doc_id, md5, good ORDER BY path) = 1 AS keep, width >= 100 AND height >= 60 AND NOT (width > 0.95 * 600 AND height > 0.95 * 450) AS figure FROM (SELECT *, width >= 200 AND height >= 200 AND hi > 5 AS good FROM {_IMAGES})")
def image_quality(spark, sf_dir):
    """Sizes and contents of images are read off the parts table."""
    size = F.col("p_size")
    images = t(spark, sf_dir, "part").select(
        F.col("p_type").alias("doc_id"), F.col("p_partkey").alias("path"), (size * 12).alias("width"), (size * 9).alias("height"), F.lit(0).alias("lo"), (size % 9).alias("hi"), F.md5("p_brand").alias("md5")
    )
    fits = maintenance.figure_fits(F.col("width"), F.col("height"), F.lit(600), F.lit(450))
    return maintenance.keep_images(images).select("doc_id", "path", "keep", fits.alias("figure"))


@query("SELECT doc_id, lang, 'new' AS state FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang, 'old' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 2")
def upserted_rows(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    old = d.where("doc_id % 2 = 0 OR doc_id % 3 <> 0").withColumn("state", F.lit("old"))
    merged = tables.upserted(old, d.where("doc_id % 3 = 0").withColumn("state", F.lit("new")), ["doc_id"])
    return tables.without(merged, d.where("doc_id % 7 = 2 AND doc_id % 3 <> 0"), ["doc_id"])


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents WHERE doc_id % 7 <> 2 OR doc_id % 3 = 0""")
def keyed_table(spark, sf_dir):
    """A table in the shared folder, changed by an upsert, a delete and a payload update, each of the folders that hold its keys only."""
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    table = tables.Keyed(spark, folder(spark), ["doc_id"], 16)
    table.create(d.where("doc_id % 2 = 0 OR doc_id % 3 <> 0").withColumn("state", F.lit("old")))
    table.upsert(d.where("doc_id % 3 = 0").withColumn("state", F.lit("new")))
    table.delete(d.where("doc_id % 7 = 2 AND doc_id % 3 <> 0"))
    table.update(d.where("doc_id % 11 = 5").select("doc_id", F.lit("xx").alias("lang")))
    return table.read()


@query("""SELECT d.doc_id AS id, CASE WHEN s % 2 = 0 THEN 'MEC ' || s ELSE source END AS spec_id, CASE WHEN s % 2 = 0 THEN 'V1.1.1' END AS edition, coalesce(s % 3 <> 0 OR s % 4 = 1, true) AS is_current
 FROM (SELECT doc_id, source, regexp_replace(source, '\\D', '', 'g')::INT AS s FROM documents) d""")
def stamped_chunks(spark, sf_dir):
    """Sources as files: every other has a cover, every fourth isn't among the files."""
    n = F.regexp_replace("source", r"\D", "").cast("int")
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"))
    files = t(spark, sf_dir, "documents").select("source", n.alias("n")).distinct().where("n % 4 <> 1")
    even = F.col("n") % 2 == 0
    files = files.select(F.col("source").alias("stem"), F.when(even, F.concat(F.lit("MEC "), F.col("n").cast("string"))).alias("spec_id"), F.when(even, "V1.1.1").alias("edition"), F.lit(None).cast("string").alias("pub_date"), (F.col("n") % 3 != 0).alias("is_current"))
    return maintenance.stamp(d, files).select("id", "spec_id", "edition", "is_current")


_WITH_IMAGES = "concat('![one](img', chr(92), page_id % 50, '.png) ', url, ' ![](img/', page_id % 7, '.png)![two](x/y.png)')"


@query(f"SELECT page_id, CASE WHEN page_id % 50 % 4 = 0 THEN '' ELSE '![one](img' || chr(92) || page_id % 50 || '.png)' END || ' ' || url || ' ' || CASE WHEN page_id % 7 % 4 = 0 THEN '' ELSE '![](img/' || page_id % 7 || '.png)' END || '![two](x/y.png)' AS text FROM pages")
def pruned_pages(spark, sf_dir):
    """Pages with references to images, of which every fourth isn't worth keeping."""
    p = t(spark, sf_dir, "pages").select(F.lit("d").alias("doc_id"), F.col("page_id").alias("page"), F.expr(_WITH_IMAGES).alias("text"))
    n = (F.col("page_id") % 50).cast("string")
    images = t(spark, sf_dir, "pages").select(F.lit("d").alias("doc_id"), F.concat(F.lit("img/"), n, F.lit(".png")).alias("path"), (F.col("page_id") % 50 % 4 != 0).alias("keep")).distinct()
    return maintenance.prune_images(p, images).select(F.col("page").alias("page_id"), "text")


@query("""SELECT (SELECT count(*) FROM pages) AS keys, (SELECT count(*) FROM pages WHERE page_id % 9 = page_id % 4) AS right_keys, sum(n)::BIGINT AS files, count(*) AS contents, sum((n > 1)::INT)::BIGINT AS shared_contents,
 (SELECT count(DISTINCT CASE WHEN doc_id % 3 <> 0 THEN doc_id % 70 END) FROM documents) AS numbered FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text))""")
def audit_counts(spark, sf_dir):
    i, j = F.col("page_id"), F.col("doc_id")
    manifest = t(spark, sf_dir, "pages").select(F.concat(F.lit("MEC-00"), (i % 9).cast("string")).alias("key"), F.concat(F.lit("x/deliver/gs_mec00"), (i % 4).cast("string"), F.lit("v010101p.pdf")).alias("url"))
    files = t(spark, sf_dir, "documents").select(j.alias("name"), F.md5("text").alias("md5"), F.when(j % 3 != 0, j % 70).alias("number"))
    return maintenance.audit_counts(manifest, files)


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 300")
def first_vectors(spark, sf_dir):
    """The limited scan behind the similarity graph: as many rows as asked for, in the order of ids."""
    return maintenance.first_rows(t(spark, sf_dir, "embeddings"), "vec_id", 300).select("vec_id", "label")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || l.quality ELSE lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def payload_updates(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang")
    return tables.updated(d, t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang")), ["doc_id"])


# ---------------------------------------------------------------- evaluation, graph, audit, monitor

_GOLDEN = "(SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN ['en', 'de'] END AS docs, [string_split(text, '. ')[1]] AS kw FROM benchmark)"


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from the benchmark: the keyword is an item's first sentence; some ask for two languages only."""
    i = F.col("item_id")
    return t(spark, sf_dir, "benchmark").select(i.alias("id"), F.when(i % 3 == 0, F.array(F.lit("en"), F.lit("de"))).alias("docs"), F.array(F.split("text", r"\. ")[0]).alias("kw"))


_EVIDENCE = f"SELECT g.id, coalesce(bool_or(contains(lower(d.text), lower(g.kw[1])) AND (g.docs IS NULL OR list_contains(g.docs, d.lang))), false) AS evidence FROM {_GOLDEN} g, documents d GROUP BY g.id"


@query(_EVIDENCE)
def evidence_check(spark, sf_dir):
    return evaluate.evidence(golden(spark, sf_dir), t(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), "text"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    one, both = sparse_search(spark, sf_dir), hybrid_fusion(spark, sf_dir)
    hits = saved(spark, one.withColumn("path", F.lit("sparse")).unionByName(both.withColumn("path", F.lit("hybrid"))))
    docs = docs.join(if_small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return hits.join(docs.select("doc_id", F.col("lang").alias("doc"), "text"), "doc_id").select(F.col("query_id").alias("id"), "path", "rank", "doc", "text")


_FIRST = f"""SELECT g.id, path, min(CASE WHEN rank <= 15 AND contains(lower(d.text), lower(g.kw[1])) AND (g.docs IS NULL OR list_contains(g.docs, d.lang)) THEN rank END) AS first_rank
 FROM (SELECT query_id, doc_id, rank, 'sparse' AS path FROM ({sparse_sql(25)}) UNION ALL SELECT query_id, doc_id, rank, 'hybrid' FROM ({_sql["hybrid_fusion"]})) h JOIN documents d USING (doc_id) JOIN {_GOLDEN} g ON g.id = h.query_id GROUP BY g.id, path"""


@query(f"SELECT id, path, coalesce(first_rank, 0) AS first_rank FROM ({_FIRST})")
def first_hit_ranks(spark, sf_dir):
    return evaluate.first_hits(golden(spark, sf_dir), _hits(spark, sf_dir), 15).select("id", "path", F.coalesce("first_rank", F.lit(0)).cast("long").alias("first_rank"))


@query(f"""WITH f AS (SELECT f.* FROM ({_FIRST}) f JOIN ({_EVIDENCE}) e USING (id) WHERE e.evidence), a AS (SELECT path, id, first_rank IS NOT NULL AS hit FROM f UNION ALL SELECT 'union', id, bool_or(first_rank IS NOT NULL) FROM f GROUP BY id)
SELECT path, count(*) AS questions, sum(hit::INT)::BIGINT AS hits, round(avg(hit::INT), 6) AS recall FROM a GROUP BY path""")
def recall_at_k(spark, sf_dir):
    return evaluate.recall(evaluate.first_hits(golden(spark, sf_dir), _hits(spark, sf_dir), 15), evidence_check(spark, sf_dir))


_CENTROID = "(SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)"


@query(f"SELECT label, unnest(list_transform(c, lambda x: round(x, 6))) AS m, generate_subscripts(c, 1) - 1 AS pos FROM {_CENTROID}")
def label_centroids(spark, sf_dir):
    c = graph.centroids(t(spark, sf_dir, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.round("x", 6).alias("m"), F.col("pos").cast("long").alias("pos"))


_EDGES = f"""WITH u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))) + 1e-9)) AS v FROM embeddings),
p AS (SELECT a.label AS a, b.label AS b, a.vec_id, list_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.label < b.label),
k AS (SELECT a, b, round(avg(s), 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY a, b, vec_id ORDER BY s DESC) AS n FROM p) WHERE n <= 3 GROUP BY a, b HAVING round(avg(s), 6) >= 0.25),
c AS (SELECT l.label AS a, r.label AS b, round(list_cosine_similarity(l.c, r.c), 6) AS x FROM {_CENTROID} l JOIN {_CENTROID} r ON l.label < r.label WHERE round(list_cosine_similarity(l.c, r.c), 6) >= 0.1),
e AS (SELECT a, b, round(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (x + y) / 2 ELSE coalesce(x, y) END, 6) AS weight FROM c FULL JOIN k USING (a, b))"""


@query(_EDGES + " SELECT a, b, weight FROM e")
def similarity_graph(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return graph.merge_edges(graph.centroid_edges(graph.centroids(e, "label"), 0.1, "label"), graph.chunk_edges(e, 3, 0.25, "label"))


@query(_EDGES + " SELECT label AS node, coalesce(d, 0) AS degree FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN (SELECT n, count(*) AS d FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n) ON n = label")
def node_degrees(spark, sf_dir):
    nodes = t(spark, sf_dir, "embeddings").select(F.col("label").alias("node")).distinct()
    return graph.degrees(similarity_graph(spark, sf_dir), nodes)


def cited_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as answers: each first turn's whole text, and cites of several shapes behind it; the excerpts are the
    later turns. No table has citations of its own."""
    c = t(spark, sf_dir, "conversations")
    answers = c.where("turn = 0").select(F.col("conv_id").cast("string").alias("answer_id"), F.expr(f"concat(text, {_CITE_TAIL})").alias("answer"))
    excerpts = c.where("turn > 0").select(
        F.col("conv_id").cast("string").alias("answer_id"), F.expr("concat('MEC-', lpad(cast(conv_id % 9 + 1 AS STRING), 3, '0'))").alias("spec_id"), F.lit("V1.1.1").alias("edition"), F.col("turn").cast("int").alias("page")
    )
    return answers, excerpts


#: Cites behind a text, in SQL that Spark and the check read alike: before and after the code, ranges, without a dot, far from any code.
_CITE_TAIL = """CASE conv_id % 6
 WHEN 0 THEN concat(' [MEC ', lpad(concat('', conv_id % 9 + 1), 3, '0'), ' V', conv_id % 2 + 1, '.1 p.', conv_id % 4 + 1, '] ', repeat('word ', 30), 'see page ', conv_id % 3 + 1)
 WHEN 1 THEN concat(' Page ', conv_id % 3 + 1, ' of MEC-', lpad(concat('', conv_id % 9 + 1), 3, '0'), ' V', conv_id % 3 + 1, '.1.1 has it.')
 WHEN 2 THEN concat(' (MEC ', lpad(concat('', conv_id % 9 + 1), 3, '0'), ', pp. ', conv_id % 2 + 1, '-', conv_id % 5 + 1, ')')
 WHEN 3 THEN concat(' As MEC ', lpad(concat('', conv_id % 9 + 1), 3, '0'), ' clause 5.2 p ', conv_id % 4 + 1, ' and pp ', conv_id % 2 + 1, ' say.')
 WHEN 4 THEN concat(' See MEC ', lpad(concat('', conv_id % 7 + 1), 3, '0'), ' p.', conv_id % 4 + 1, '.') ELSE ' No cite.' END"""
_PAGE_SQL, _CODE_SQL = audit._PAGE.replace("(?:(pp?)", "(?:(?:pp?)"), audit._CODE
_CITED = f"""(SELECT *, regexp_extract(cite, '(\\d+)', 1)::INT AS first, nullif(regexp_extract(cite, '-\\s*(\\d+)', 1), '')::INT AS last, pos + length(regexp_extract(cite, '^\\D*\\d+')) AS stop FROM
 (SELECT answer_id, answer, code, c0, c0 + length(code) AS c1, cite, list_sum(list_transform(s[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) AS pos FROM
  (SELECT *, unnest(m) AS cite, unnest(range(1, len(m) + 1)) AS k FROM (SELECT answer_id, answer, regexp_extract_all(answer, '(?i){_PAGE_SQL}') AS m, string_split_regex(answer, '(?i){_PAGE_SQL}') AS s,
   regexp_extract(answer, '(?i){_CODE_SQL}') AS code, length(regexp_extract(answer, '(?is)^(.*?)(?:{_CODE_SQL})', 1)) AS c0 FROM (SELECT conv_id::VARCHAR AS answer_id, concat(text, {_CITE_TAIL}) AS answer FROM conversations WHERE turn = 0)))))"""
_GIVEN = "(SELECT conv_id::VARCHAR AS answer_id, 'MEC ' || lpad((conv_id % 9 + 1)::VARCHAR, 3, '0') AS spec, list(DISTINCT turn) AS pages FROM conversations WHERE turn > 0 GROUP BY ALL)"
_ED = r"[Vv](\d+(?:\.\d+)+)"
_COMPLAINTS = f"""SELECT DISTINCT answer_id, unnest(list_concat(CASE WHEN NOT near THEN ['p.' || first || ': no specification named'] WHEN spec <> name THEN list_transform(cited, lambda x: name || ' p.' || x || ': not retrieved')
  ELSE list_transform(list_filter(cited, lambda x: NOT list_contains(pages, x)), lambda x: name || ' p.' || x || ': page not in its excerpts') END,
 CASE WHEN near AND spec = name AND claimed <> '' AND NOT starts_with('1.1.1.', claimed || '.') THEN [name || ' V' || claimed || ': edition not in its excerpts'] ELSE [] END)) AS complaint FROM
 (SELECT answer_id, pages, spec, first, CASE WHEN last IS NULL THEN [first] ELSE [first, last] END AS cited, code <> '' AND least(abs(c0 - pos), abs(c1 - pos)) <= 120 AS near, 'MEC ' || lpad(regexp_extract(code, '(\\d+)', 1), 3, '0') AS name,
  coalesce(nullif(CASE WHEN c1 <= pos THEN regexp_extract(substr(answer, greatest(c1, pos - 60)::BIGINT + 1, (pos - greatest(c1, pos - 60))::BIGINT), '{_ED}', 1) END, ''), regexp_extract(substr(answer, stop::BIGINT + 1, 24), '{_ED}', 1), '') AS claimed
  FROM {_CITED} JOIN {_GIVEN} USING (answer_id))"""


@query(_COMPLAINTS)
def citation_complaints(spark, sf_dir):
    return audit.complaints(*cited_answers(spark, sf_dir)).select("answer_id", "complaint")


@query(f"""SELECT a.conv_id::VARCHAR AS answer_id, coalesce(n, 0) AS cites, coalesce(k, 0) AS complaints,
 CASE WHEN g.answer_id IS NULL THEN 'skipped' WHEN k > 0 THEN 'unsupported' WHEN n > 0 THEN 'all present' WHEN len(regexp_extract_all(concat(a.text, ' No cite.'), '\\S+')) < 40 THEN 'canned' ELSE 'none' END AS verdict
 FROM conversations a LEFT JOIN {_GIVEN} g ON g.answer_id = a.conv_id::VARCHAR LEFT JOIN (SELECT answer_id, count(*) AS n FROM {_CITED} GROUP BY 1) c ON c.answer_id = a.conv_id::VARCHAR
 LEFT JOIN (SELECT answer_id, count(*) AS k FROM ({_COMPLAINTS}) GROUP BY 1) x ON x.answer_id = a.conv_id::VARCHAR WHERE a.turn = 0""")
def citation_verdicts(spark, sf_dir):
    return audit.verdicts(*cited_answers(spark, sf_dir))


@query(f"SELECT answer_id, count(*) AS pages, min(first) AS first, bool_or(code <> '') AS coded FROM {_CITED} GROUP BY answer_id")
def cites_by_sql(spark, sf_dir):
    """Pages that answers cite, by the registered function in SQL."""
    session.register(spark)
    return spark.sql(
        "SELECT answer_id, count(*) AS pages, min(p.cited[0]) AS first, bool_or(size(s.codes) > 0) AS coded FROM (SELECT answer_id, s, explode(s.pages) AS p FROM (SELECT answer_id, cite_spans(answer, array()) AS s FROM {answers})) GROUP BY answer_id",
        answers=cited_answers(spark, sf_dir)[0],
    )


@query(f"SELECT answer_id, spec AS code, list_sort(pages)::INT[] AS pages, ['V1.1.1'] AS editions FROM {_GIVEN}")
def excerpt_pages(spark, sf_dir):
    pages = audit.excerpt_pages(cited_answers(spark, sf_dir)[1])
    return pages.select("answer_id", "code", F.sort_array("pages").alias("pages"), "editions")


_UP = "SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE m IS NULL OR value > m"


@query(_UP)
def version_increases(spark, sf_dir):
    return monitor.increases(t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", F.col("value"), ["event_id"])


@query(_UP)
def version_increases_stream(spark, sf_dir):
    """The same by a stream over the table's files, whose state is a row a user."""
    schema = t(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(schema)
    events = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    watch = monitor.Monitor(spark, folder(spark), "user_id", ["value"], "event_id")
    watch.start(events).awaitTermination()
    return watch.found("user_id long, value double, event_id long")


@query("""SELECT source, major, minor, patch, doc_id FROM (SELECT *, {a: major, b: minor, c: patch} AS v, max({a: major, b: minor, c: patch}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
 FROM (SELECT source, doc_id, (doc_id % 5)::DOUBLE AS major, (doc_id % 13)::DOUBLE AS minor, (doc_id % 3)::DOUBLE AS patch FROM documents WHERE source IS NOT NULL)) WHERE m IS NULL OR v > m""")
def release_stream(spark, sf_dir):
    """Documents as sightings of releases of their source, as a stream with versions of three numbers."""
    path = f"{sf_dir}/documents.parquet"
    source = spark.readStream.schema(t(spark, sf_dir, "documents").schema)
    docs = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    i = F.col("doc_id")
    seen = docs.where("source IS NOT NULL").select("source", *(x.cast("double").alias(name) for name, x in (("major", i % 5), ("minor", i % 13), ("patch", i % 3))), "doc_id")
    watch = monitor.Monitor(spark, folder(spark), "source", ["major", "minor", "patch"], "doc_id")
    watch.start(seen).awaitTermination()
    return watch.found("source string, major double, minor double, patch double, doc_id long")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT DISTINCT n AS number FROM (SELECT doc_id AS n FROM labels UNION ALL SELECT max(doc_id) + k FROM labels, (VALUES (1), (2), (3)) v(k) GROUP BY k)")
def numbers_to_poll(spark, sf_dir):
    return monitor.poll_list(t(spark, sf_dir, "labels").select(F.col("doc_id").alias("number")), "number")
