"""Mixing sources to target weights by weighted fair queueing.

Every source plays its documents in a shuffled order, up to `repeats` times over. A copy's virtual finish time is the
source's cumulative size after it, divided by the source's target; copies are served in the order of that time until
the budget is spent. Nothing of a source's size meets in one task: running totals are taken by ranges of the shuffled
order, and the ranges' sums are put in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions, text_column

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source that one range of its shuffled order holds, about.
RANGE_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, budget: int | None = None, cycle: int = 3, repeats: int = 3) -> DataFrame:
    """sources: source, source_size. Adds weight (1 to cycle, repeating, by code point, null last) and target: the budget
    (all sizes, if None) shared by weight, held at repeats times the size, the excess shared again until none is above.

    With caps ordered by cap / weight, the sources held at their cap are those before the first whose cap is not below its
    share of what is left. The table has a row for each source, not for each document.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    rows = sources.select("source", "source_size", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long").alias("weight"))
    rows = rows.withColumn("_cap", F.col("source_size") * repeats)
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.least(F.sum("source_size").over(W.partitionBy()) if budget is None else F.lit(budget), F.sum("_cap").over(W.partitionBy()))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weights = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.select("*", left.alias("_left"), weights.alias("_weights"))
    rows = rows.withColumn("_free", F.col("_cap") * F.col("_weights") >= F.col("_left") * F.col("weight"))
    first = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("_left").alias("l"), F.col("_weights").alias("w")))).over(W.partitionBy())
    rows = rows.withColumn("_first", first)
    held = F.col("_first").isNull() | (F.col("_cap") / F.col("weight") < F.col("_first.r"))
    share = F.col("_first.l").cast("double") / F.col("_first.w") * F.col("weight")
    return rows.select("source", "source_size", "weight", F.when(held, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def shuffle_key(seed: int = 0) -> Column:
    """Ten hex digits that put a document in its place in its source's order."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 10)


def mix(docs: DataFrame, budget: int | None = None, repeats: int = 3, seed: int = 0) -> DataFrame:
    """docs with size (words), source_size, weight, target (of the source), copies, taken (words of all copies taken) and
    finish (virtual time at which the first copy ends).

    A copy is served if its middle is not after virtual time 1, where each source has had its target, and its turn comes
    before the budget is spent: a source misses its target by less than its last document. Null texts have size 0 and null
    sources are one source, the last. Documents of size 0 are never taken. Rows equal in doc_id are ordered by text hash;
    rows equal in both follow each other in any order. Reruns agree. A docs column of an output name is replaced.
    """
    spark = docs.sparkSession
    keep = Scratch(spark)
    docs = docs.drop("size", "source_size", "weight", "target", "copies", "taken", "finish")
    key, tie, part, mine, theirs = fresh(docs, "_key", "_tie", "_part", "_mine", "_theirs")
    text = text_column()
    rows = docs.withColumns({"size": word_count(text), key: shuffle_key(seed), tie: F.xxhash64(text)})
    # one pass over the texts gives a narrow table; all totals and the cut come from that
    narrow = keep.save(rows.select("source", "doc_id", "size", F.col(key).alias("key"), F.col(tie).alias("tie")), "narrow")
    sizes = keep.save(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sizes")
    most = sizes.agg(F.max("rows")).first()[0] or 0
    ranges = max(1, -(-most // RANGE_ROWS), min(64, 4 * partitions(spark)))
    in_range = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int")
    goals = targets(sizes.select("source", "source_size"), budget, repeats=repeats)
    sums = narrow.groupBy("source", in_range.alias("part")).agg(F.sum("size").alias("part_size"))
    ahead = F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranged = sums.select("source", "part", ahead.alias("ahead"))
    ranged = keep.save(
        ranged.join(goals.withColumnRenamed("source", theirs), F.col("source").eqNullSafe(F.col(theirs))).drop(theirs), "ranges"
    )

    def served(df: DataFrame, key: str, tie: str) -> DataFrame:
        """Adds what ranged has, and _end: the source's cumulative size with this document."""
        own = in_range if key == "key" else F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int")
        r = ranged.withColumnsRenamed({"source": theirs, "part": mine})
        df = df.withColumn(part, own).join(r, F.col("source").eqNullSafe(F.col(theirs)) & (F.col(part) == F.col(mine))).drop(theirs, mine)
        run = W.partitionBy("source", part).orderBy(key, "doc_id", tie).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("_end", F.col("ahead") + F.sum("size").over(run)).drop("ahead")

    def finish(copy: Column | int) -> Column:
        return (F.col("_end") + F.col("source_size") * copy) / F.col("target")

    # the global order of all copies by virtual finish time, cut where the budget is spent
    copies = served(narrow, "key", "tie").where((F.col("size") > 0) & (F.col("target") > 0)).select(
        "doc_id", "size", "source", "source_size", "target", "_end", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy")
    )
    copies = copies.withColumn("at", finish(F.col("copy"))).where(in_time(F.col("copy")))
    stop = _cut(keep, copies.select("at", "doc_id", "copy", "size"), budget, sizes, repeats)
    n = sum(F.when(in_time(F.lit(c)) & ((finish(c) <= 1) | (finish(c) < stop)), 1).otherwise(0) for c in range(repeats))
    out = served(rows, key, tie).withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), n).otherwise(0))
    out = out.withColumns({"taken": F.col("copies") * F.col("size"), "finish": F.when(F.col("target") > 0, finish(0))})
    return out.select(*docs.columns, "size", "source_size", "weight", "target", "copies", F.col("taken").cast("long").alias("taken"), "finish")


def in_time(copy: Column) -> Column:
    """The copy's middle is not after the source's target."""
    return 2 * (F.col("_end") + F.col("source_size") * copy) - F.col("size") <= 2 * F.col("target")


def _cut(keep: Scratch, copies: DataFrame, budget: int | None, sizes: DataFrame, repeats: int) -> float:
    """The virtual time at which the budget is spent: the copies go into ranges of time, then only the range in which the
    budget ends is looked at row by row. The copies that end after their source's target can make the total pass the
    budget by a little; the last of the order give way."""
    total = sizes.agg(F.sum("source_size").alias("t"), F.count("*").alias("n")).first()
    goal = min(budget if budget is not None else total["t"] or 0, repeats * (total["t"] or 0))
    n = partitions(keep.spark)
    ordered = keep.save(copies.repartitionByRange(n, "at", "doc_id", "copy").withColumn("part", F.spark_partition_id()), "order")
    sums = ordered.groupBy("part").agg(F.sum("size").alias("s"))
    parts = sums.select("part", F.sum("s").over(W.orderBy("part")).alias("upto"), "s")
    here = parts.where(F.col("upto") > goal).orderBy("part").limit(1).first()
    if here is None:
        return float("inf")
    run = W.orderBy("at", "doc_id", "copy").rowsBetween(W.unboundedPreceding, 0)
    row = (
        ordered.where(F.col("part") == here["part"])
        .select("at", (F.sum("size").over(run) + F.lit(here["upto"] - here["s"])).alias("upto"))
        .where(F.col("upto") > goal)
        .agg(F.min("at"))
        .first()
    )
    return row[0]


def mix_sql(repeats: int = 3, cycle: int = 3) -> str:
    """The same in DuckDB's SQL, for documents with unique ids and the budget of all sizes."""
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                      substr(md5('0/' || coalesce(doc_id::VARCHAR, '')), 1, 10) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * {repeats} AS cap FROM d GROUP BY source),
    w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {cycle} + 1)::BIGINT AS weight FROM s),
    o AS (SELECT *, cap / weight::DOUBLE AS r,
                 (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER q, 0)::BIGINT AS l,
                 (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER q, 0)::BIGINT AS ws
          FROM w WINDOW q AS (ORDER BY cap / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT r, l, ws FROM o WHERE cap * ws >= l * weight ORDER BY r, l, ws LIMIT 1),
    g AS (SELECT o.source, o.source_size, CASE WHEN f.r IS NULL OR o.r < f.r THEN o.cap::DOUBLE ELSE f.l::DOUBLE / f.ws * o.weight END AS target
          FROM o LEFT JOIN f ON true),
    e AS (SELECT d.*, g.source_size, g.target, (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS e
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    c AS (SELECT *, (e + source_size * copy) / target AS t FROM e, (SELECT unnest(range({repeats})) AS copy)
          WHERE size > 0 AND target > 0 AND 2 * (e + source_size * copy) - size <= 2 * target),
    u AS (SELECT *, sum(size) OVER (ORDER BY t, doc_id, copy ROWS UNBOUNDED PRECEDING) AS upto FROM c),
    stop AS (SELECT coalesce((SELECT t FROM u WHERE upto > (SELECT sum(source_size) FROM s) ORDER BY t, doc_id, copy LIMIT 1), 'inf'::DOUBLE) AS stop),
    n AS (SELECT doc_id, count(*) AS n FROM c, stop WHERE t <= 1 OR t < stop GROUP BY doc_id)
    SELECT e.doc_id, e.size, e.source_size, e.target, (coalesce(n.n, 0) * e.size)::BIGINT AS taken
    FROM e LEFT JOIN n ON n.doc_id = e.doc_id"""
