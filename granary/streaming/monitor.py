"""Release monitor: of a stream of sightings, those that raise the highest version seen of their key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, DoubleType, FloatType, StructType

from granary.jobs.scratch import folder
from granary.sources.tables import Manifest


def _is_known(version: Column, kind: DataType) -> Column:
    """Not null, and not NaN, in any part: what isn't known is neither raised nor above anything."""
    if isinstance(kind, StructType):
        return version.isNotNull() & reduce(Column.__and__, (_is_known(version[f.name], f.dataType) for f in kind.fields))
    return version.isNotNull() & ~F.isnan(version) if isinstance(kind, (DoubleType, FloatType)) else version.isNotNull()


def increases(events: DataFrame, key: str, version: Column, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Rows whose version is above all of their key's rows before, in this order. version may be a struct, such as (major, minor, patch);
    rows whose version is null or NaN, or has a part that is, take no part. known: key and version seen before, a row a key.

    The rows are sorted into ranges of (key, order), written in the shared folder; the ranges' maxima, few a key, tell what
    is before a range. So a key of very many rows goes to many tasks. All columns of events are written: select those wanted first.
    """
    spark, path = events.sparkSession, folder(events.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = events.withColumn("_version", version)
    seen = seen.where(_is_known(F.col("_version"), seen.schema["_version"].dataType))
    ranged = seen.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    tops = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_range")).agg(F.max("_version").alias("_top"))
    ahead = F.max("_top").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    tops = tops.select("_key", "_range", ahead.alias("_ahead"))
    if known is not None:
        known = known.select(F.col(key).alias("_k"), F.col("version").cast(seen.schema["_version"].dataType).alias("_known"))
        tops = tops.join(known, F.col("_key").eqNullSafe(F.col("_k")), "left").select("_key", "_range", F.greatest("_ahead", "_known").alias("_ahead"))
    rows = rows.join(tops, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range")))
    here = F.max("_version").over(W.partitionBy(key, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.greatest(here, "_ahead"))
    return rows.where(F.col("_before").isNull() | (F.col("_version") > F.col("_before"))).select(events.columns)


class Monitor:
    """The same for a stream: of each batch the rows that raise their key's highest version, the batches' and all before.

    The highest versions are a manifest, one row a key, whose next version is written for each batch that raises any, with the batch's number as its note. A
    batch is range-sorted like a table, so its rows of a key count in their order, and a key of very many rows is never
    in one task; a stateful operator would get them in no order. The rows found are written before the manifest, each batch in a folder of its own: a
    batch that is run again finds the same and writes it in the same place, or, if the manifest has it, changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: list[str], order: str):
        self.spark, self.path, self.key, self.version, self.order = spark, path.rstrip("/"), key, version, order
        self.manifest: Manifest | None = None

    def _versions(self, kinds: dict[str, str]) -> Manifest:
        fields = ", ".join(f"{c}: {kinds[c]}" for c in self.version)
        return Manifest(self.spark, f"{self.path}/manifest", f"{self.key} {kinds[self.key]}, version struct<{fields}>")

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch of the stream."""
        columns = [self.key, *self.version, self.order]
        rows, manifest = batch.select(columns), self._versions(dict(batch.dtypes))
        _, known, note = manifest.read()
        if note and int(note) >= number:
            return
        found = increases(rows, self.key, F.struct(*self.version), [self.order], known)
        found.write.mode("overwrite").parquet(f"{self.path}/found/batch={number}")
        found = self.spark.read.schema(found.schema).parquet(f"{self.path}/found/batch={number}")
        higher = found.select(self.key, F.struct(*self.version).alias("version"))
        manifest.write(known.union(higher).groupBy(self.key).agg(F.max("version").alias("version")), str(number))

    def start(self, events: DataFrame) -> StreamingQuery:
        """Takes all that is there, and stops."""
        stream = events.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint")
        return stream.trigger(availableNow=True).start()

    def found(self, schema: str) -> DataFrame:
        """All rows found so far; none before the first batch. schema: the key's, the version's and the order's columns."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/found")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.path}/found/*") if there else self.spark.createDataFrame([], schema)


def poll_list(known: DataFrame, key: str, ahead: int = 3, first: int = 9) -> DataFrame:
    """Numbers to ask for: all known, the next `ahead` after the highest, and the first few while nothing is known."""
    top = known.agg(F.max(key).cast("long").alias("t"))
    numbers = F.when(F.col("t").isNull(), F.sequence(F.lit(1).cast("long"), F.lit(first).cast("long"))).otherwise(F.sequence(F.col("t") + 1, F.col("t") + ahead))
    return known.select(F.col(key).cast("long").alias(key)).union(top.select(F.explode(numbers).alias(key))).distinct()
