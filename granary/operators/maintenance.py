"""Keeping a corpus: elections among copies and editions, statistics, gaps, and what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.identity import release_id
from granary.functions.sizes import if_small
from granary.functions.text import fingerprint, image_refs, without_images
from granary.jobs.scratch import saved


def elect(df: DataFrame, group: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in this order; Spark stops at one row a group before it shuffles."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def elect_survivors(chunks: DataFrame, name: str, id_: str, canonical: str, length: int = 600) -> DataFrame:
    """One row for each 600-character fingerprint: canonical names (a pattern) first, then the smaller id as text."""
    score = F.when(F.lower(name).rlike(canonical), 0).otherwise(1)
    return elect(chunks, [fingerprint(F.col("text"), length)], [score, F.col(id_).cast("string")])


def by_content(files: DataFrame, content: str, name: str) -> DataFrame:
    """Adds first (the smallest name of the row's content) and copies (its rows). The totals are sums by content, joined back, so
    a content of very many rows is never in one place."""
    totals = files.groupBy(content).agg(F.min(name).alias("first"), F.count("*").alias("copies")).withColumnRenamed(content, "_content")
    return files.join(totals, F.col(content).eqNullSafe(F.col("_content"))).drop("_content")


def elect_keepers(files: DataFrame) -> DataFrame:
    """The rows to keep of files (md5, name, indexed, cover_digits): all indexed copies of a content, else the first whose
    name holds the cover's digits, else the shortest name, then the first. Names are unique within a content."""
    fits = F.coalesce(F.contains("name", F.col("cover_digits")), F.lit(False))
    order = F.struct(F.when(fits, 0).otherwise(1).alias("a"), F.when(~fits, F.length("name")).otherwise(0).alias("b"), F.col("name").alias("c"))
    best = files.groupBy("md5").agg(F.max("indexed").alias("_some"), F.min(order).alias("_best")).withColumnRenamed("md5", "_md5")
    files = files.join(best, F.col("md5").eqNullSafe(F.col("_md5")))
    return files.where(F.when(F.col("_some"), F.col("indexed")).otherwise(order == F.col("_best"))).drop("_md5", "_some", "_best")


def current_editions(editions: DataFrame) -> DataFrame:
    """Adds is_current: rows with the greatest key (a struct) of their spec_id, and all rows without a spec_id. The greatest keys
    are one row a spec_id, joined back."""
    newest = editions.where("spec_id IS NOT NULL").groupBy(F.col("spec_id").alias("_spec")).agg(F.max("key").alias("_newest"))
    rows = editions.join(newest, F.col("spec_id") == F.col("_spec"), "left")
    return rows.withColumn("is_current", F.coalesce(F.col("key") == F.col("_newest"), F.lit(True))).drop("_spec", "_newest")


def edition_listing(editions: DataFrame) -> DataFrame:
    """Adds place: 1 for the rows of the newest edition of their spec_id, 2 for the one before, and so on. Editions are few a spec_id,
    however many rows they have."""
    keys = editions.where("spec_id IS NOT NULL").groupBy("spec_id", "key").agg(F.count("*").alias("rows"))
    place = F.row_number().over(W.partitionBy("spec_id").orderBy(F.desc("key")))
    return keys.withColumn("place", place)


def superseded(editions: DataFrame) -> DataFrame:
    """spec_id, superseded (rows that a newer edition hides), duplicates (n * (s - 1) div s for the s files of an edition)."""
    marked = current_editions(editions)
    by_edition = marked.groupBy("spec_id", "key").agg(F.count("*").alias("n"), F.countDistinct("file").alias("s"), F.min("is_current").alias("current"))
    return by_edition.groupBy("spec_id").agg(
        F.sum(F.when(~F.col("current"), F.col("n")).otherwise(0)).alias("superseded"), F.sum(F.expr("n * (s - 1) div s")).alias("duplicates")
    )


def stats(chunks: DataFrame) -> DataFrame:
    """spec, edition (? where unknown), chunks, diagrams, is_current (of all its rows; missing counts as current)."""
    spec = F.coalesce(F.nullif("spec_id", F.lit("")), F.nullif("filename", F.lit("")), F.lit("?"))
    return chunks.groupBy(spec.alias("spec"), F.coalesce("edition", F.lit("?")).alias("edition")).agg(
        F.count("*").alias("chunks"), F.sum(F.col("has_diagram").cast("int")).alias("diagrams"), F.every(F.coalesce("is_current", F.lit(True))).alias("is_current")
    )


def headline(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("spec_id").alias("specs"), F.countDistinct("spec_id", "edition").alias("editions"), F.sum(F.col("has_diagram").cast("int")).alias("diagrams"))


def is_current(flag: str = "is_current") -> Column:
    """True unless the flag is false: rows that never had it are current."""
    return F.coalesce(F.col(flag), F.lit(True))


def search_filter(current_only: bool = True, diagrams_only: bool = False, current: str = "is_current", diagram: str = "has_diagram") -> Column:
    """What a search may return: with a diagram, if asked for, and not superseded, unless all editions are asked for."""
    out = is_current(current) if current_only else F.lit(True)
    return out & F.coalesce(F.col(diagram), F.lit(False)) if diagrams_only else out


def gaps(ids: DataFrame, number: str, by: str) -> DataFrame:
    """by, number: the numbers from 1 to each group's greatest that the group lacks."""
    have = ids.select(by, F.col(number).cast("long").alias(number)).distinct()
    all_ = have.groupBy(by).agg(F.max(number).alias("_top")).select(by, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("_top", F.lit(1)))).alias(number))
    return all_.join(have, [by, number], "left_anti")


def missing(known: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Rows of known that indexed has no row for."""
    return known.join(if_small(indexed.select(key).distinct()), key, "left_anti")


def match_catalog(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, code: the first catalog entry (position, code, pattern, repository, title) that a path matches, by its pattern,
    or its repository's name, or two words of its title of over three letters; a word that a title repeats counts as often.

    Names and words are an index: each path's parts of the lengths that they have meet them in an equal join. An entry that a path
    matches so has two of the path's parts, or one that counts twice, so the index is turned into the first entry of each two parts, and a
    path meets one row for two of its parts, however many entries have them. Neither a large catalog nor a path is looked
    through. Patterns can't be indexed: the entries that have one (not null, not empty) are tried on each path; a catalog
    without patterns has no such step.
    """
    word = F.explode(F.filter(F.split(F.lower("title"), " "), lambda w: F.length(w) > 3)).alias("_part")
    words = catalog.select("position", word).groupBy("position", "_part").agg(F.count("*").alias("_hits"))
    names = catalog.where(F.coalesce("repository", F.lit("")) != "").select("position", F.lower("repository").alias("_part"), F.lit(2).cast("long").alias("_hits"))
    spark = catalog.sparkSession
    index = saved(spark, words.union(names))  # read for the lengths, the parts and the pairs
    lengths = sorted(r[0] for r in index.select(F.length("_part")).distinct().collect())  # a few numbers
    # dealt out by number, as paths are so few bytes for the work on them that Spark would take them all in a few tasks
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths, p = paths.select("path").distinct().repartition(n), F.lower("path")
    parts = F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>")
    each = paths.select("path", p.alias("_p"), F.explode(F.filter(parts, lambda n: n <= F.length(p))).alias("_n"))
    each = each.select("path", "_p", "_n", F.explode(F.sequence(F.lit(1), F.length("_p") - F.col("_n") + 1)).alias("_i"))
    pieces = each.select("path", F.substring("_p", F.col("_i"), F.col("_n")).alias("_part"))
    held = pieces.join(if_small(index.select("_part").distinct()), "_part").groupBy("path").agg(F.collect_set("_part").alias("_parts"))
    once = index.groupBy("position").agg(F.collect_set("_part").alias("_parts"), F.collect_set(F.when(F.col("_hits") >= 2, F.col("_part"))).alias("_twice"))
    counts = (F.col("_a") < F.col("_b")) | F.array_contains("_twice", F.col("_a"))
    firsts = _two(once, "position", "_twice").where(counts).groupBy("_a", "_b").agg(F.min("position").alias("position"))
    met = _two(held, "path").join(if_small(firsts), ["_a", "_b"]).select("path", "position")
    patterns = catalog.where(F.coalesce("pattern", F.lit("")) != "").select("position", "pattern")
    if not patterns.isEmpty():
        met = met.union(paths.join(if_small(patterns, 1000), F.regexp(p, F.col("pattern"))).select("path", "position"))
    first = met.groupBy("path").agg(F.min("position").alias("position"))
    return first.join(catalog.select("position", "code"), "position").select("path", "code")


def _two(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, _a, _b: each two of a row's list _parts, _a not after _b, and each part with itself; the list is gone through row by row."""
    first = rows.select(*keep, "_parts", F.explode("_parts").alias("_a"))
    return first.select(*keep, "_a", F.explode("_parts").alias("_b")).where("_a <= _b")


def merge_tiles(boxes: DataFrame, by: list[str], near: float = 5.0) -> DataFrame:
    """by, x0, y0, x1, y1, tiles of the groups of two boxes or more. Boxes (by, x0, y0, x1, y1) of a page are taken from top to
    bottom, then from left to right; each that meets the last group's box when grown by `near` on all sides joins it, and any
    other opens the next group. Boxes that share only an edge don't meet, nor does a box without area.

    The rows are sorted by page and place within their partitions and swept once: a task holds one group's box, not a page.
    Rows without all four numbers take no part.
    """
    sides = ["x0", "y0", "x1", "y1"]
    rows = boxes.select(*by, *(F.col(c).cast("double") for c in sides)).dropna(subset=sides)
    out = rows.withColumn("tiles", F.lit(0).cast("long")).schema
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = rows.repartition(n, *by).sortWithinPartitions(*by, "y0", "x0", "y1", "x1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, group, tiles = None, None, 0

        def flush(done: list) -> None:
            if tiles > 1:
                done.append((*page, *group, tiles))

        def given(done: list, schema: pa.Schema) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * (len(by) + 5)
            kinds = [*(schema.field(c).type for c in by), *[pa.float64()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*by, *sides, "tiles"])

        schema = None
        for batch in batches:
            done, schema = [], batch.schema
            keys = zip(*(batch.column(schema.get_field_index(c)).to_pylist() for c in by), strict=True)
            places = zip(*(batch.column(schema.get_field_index(c)).to_pylist() for c in sides), strict=True)
            for key, (x0, y0, x1, y1) in zip(keys, places, strict=True):
                meets = page == key and max(x0 - near, group[0]) < min(x1 + near, group[2]) and max(y0 - near, group[1]) < min(y1 + near, group[3])
                if meets and group[0] < group[2] and group[1] < group[3]:
                    group = (min(x0, group[0]), min(y0, group[1]), max(x1, group[2]), max(y1, group[3]))
                    tiles += 1
                else:
                    flush(done)
                    page, group, tiles = key, (x0, y0, x1, y1), 1
            yield given(done, schema)
        if schema is not None:
            done = []
            flush(done)
            yield given(done, schema)

    return swept.mapInArrow(run, out)


def keep_images(images: DataFrame) -> DataFrame:
    """Adds keep: both sides of 200 pixels at least, a luminance range over 5, and the first of its content in the document."""
    good = (F.col("width") >= 200) & (F.col("height") >= 200) & (F.col("hi") - F.col("lo") > 5)
    w = W.partitionBy("doc_id", "md5", "_good").orderBy("path")
    return images.withColumn("_good", good).withColumn("keep", F.col("_good") & (F.row_number().over(w) == 1)).drop("_good")


def figure_fits(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Large enough, and not the page itself."""
    whole = (width > 0.95 * page_width) & (height > 0.95 * page_height)
    return (width >= 100) & (height >= 60) & ~whole


def stamp(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks with spec_id, edition, pub_date and is_current of their file. chunks: doc_id; files: stem (once), spec_id, edition,
    pub_date, is_current. A file without a cover gives its stem as spec_id; chunks without a file stay, and count as current."""
    known = files.select(F.col("stem").alias("_stem"), F.coalesce("spec_id", "stem").alias("spec_id"), "edition", "pub_date", F.coalesce("is_current", F.lit(True)).alias("is_current"))
    old = chunks.drop("spec_id", "edition", "pub_date", "is_current")
    out = old.join(if_small(known), F.col("doc_id") == F.col("_stem"), "left").drop("_stem")
    return out.withColumns({"spec_id": F.coalesce("spec_id", F.col("doc_id").cast("string")), "is_current": F.coalesce("is_current", F.lit(True))})


def prune_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages without references to images that aren't worth keeping. pages: doc_id, page, text; images: doc_id, path, keep."""
    refs = pages.select("doc_id", "page", F.explode(image_refs(F.col("text"))).alias("path")).distinct()
    bad = refs.join(images.where("NOT keep").select("doc_id", "path"), ["doc_id", "path"], "left_semi")
    bad = bad.groupBy(F.col("doc_id").alias("_doc"), F.col("page").alias("_page")).agg(F.collect_set("path").alias("_bad"))
    rows = pages.join(bad, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("page").eqNullSafe(F.col("_page")), "left")
    return rows.withColumn("text", without_images(F.col("text"), F.coalesce("_bad", F.array().cast("array<string>")))).select(pages.columns)


def audit_counts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: keys, right_keys (whose address names them), files, contents, shared_contents (in several files), numbered (distinct
    numbers in files). manifest: key, url; files: name, md5, number (null without a cover)."""
    keys = manifest.agg(F.count("*").alias("keys"), F.count_if(F.coalesce(F.col("key") == release_id(F.col("url")), F.lit(False))).alias("right_keys"))
    by = files.groupBy("md5").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("shared_contents"))
    return keys.crossJoin(by).crossJoin(files.agg(F.countDistinct("number").alias("numbered")))  # a row each


def first_rows(table: DataFrame, id_: str, limit: int) -> DataFrame:
    """The first rows in the order of ids: each task passes on as many at most."""
    return table.orderBy(id_).limit(limit)
