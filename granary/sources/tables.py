"""Tables on any file system that Spark writes to: append, upsert, delete, update, copy with cutover, and manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.jobs.scratch import saved


def new_rows(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table doesn't have: what an ingest that skips what is there appends."""
    return rows.join(table.select(*key).distinct(), key, "left_anti")


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows in the place of those of the same key; rows' keys are unique."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def without(table: DataFrame, victims: DataFrame, key: list[str]) -> DataFrame:
    return table.join(victims.select(*key).distinct(), key, "left_anti")


def updated(table: DataFrame, payload: DataFrame, key: list[str]) -> DataFrame:
    """The table with payload's columns set where it has a row of the key; unique keys in payload."""
    columns = [c for c in payload.columns if c not in key]
    new = payload.withColumn("_set", F.lit(True)).withColumnsRenamed({c: f"_new_{c}" for c in columns})
    out = table.join(new, key, "left")
    old = {c: F.col(c) if c in table.columns else F.lit(None) for c in columns}
    out = out.withColumns({c: F.when(F.col("_set"), F.col(f"_new_{c}")).otherwise(old[c]) for c in columns})
    return out.drop("_set", *(f"_new_{c}" for c in columns))


def copy_and_switch(spark: SparkSession, view: str, source: str, target: str, change) -> int:
    """Writes change(source) to the new folder target, and points the view there if no row is missing; returns the rows.

    Refuses a target that is the source or exists, and leaves the view alone if the counts differ.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("source and target are one folder")
    old = spark.read.parquet(source)
    change(old).write.mode("errorifexists").parquet(target)
    before, after = old.count(), spark.read.parquet(target).count()
    if before != after:
        raise ValueError(f"{target} has {after} rows, {source} has {before}")
    spark.read.parquet(target).createOrReplaceTempView(view)
    return after


class Manifest:
    """A table of few columns in versions, in a folder. A version is written aside, and counts from the one step on that puts its
    commit file in place; readers take the last version that has one. So a job that stops anywhere leaves the version before,
    and of two that write the same version one fails. The last few versions' rows are kept for readers that have begun."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = "spec_id string, url string", keep: int = 3):
        self.spark, self.folder, self.schema, self.kept = spark, folder.rstrip("/"), schema, keep
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _commits(self) -> list[str]:
        """Names of the commit files, such as 000000000012, the last one last."""
        there = self._path("commits")
        names = [x.getPath().getName() for x in self.files.listStatus(there)] if self.files.exists(there) else []
        return sorted(x for x in names if x.isdigit())

    def read(self) -> tuple[int, DataFrame, str]:
        """The last version's number, rows and note; -1, no rows and no note without any."""
        names = self._commits()
        if not names:
            return -1, self.spark.createDataFrame([], self.schema), ""
        said = json.loads(self.spark.read.text(f"{self.folder}/commits/{names[-1]}").first()[0])
        # a line that isn't JSON is left out
        rows = self.spark.read.schema(f"{self.schema}, _corrupt_record string").json(f"{self.folder}/{said['rows']}")
        known = rows.columns[:-1]
        return int(names[-1]), rows.where(F.coalesce(*(F.col(c).cast("string") for c in known)).isNotNull()).select(known), said["note"]

    def write(self, rows: DataFrame, note: str = "") -> int:
        """Writes the next version, of these rows; returns its number. rows may read the version before."""
        turn = int((self._commits() or ["-1"])[-1]) + 1
        name = f"rows/{turn:012d}-{uuid.uuid4().hex}"
        rows.write.json(f"{self.folder}/{name}")
        aside = self._path(f"commits/new-{uuid.uuid4().hex}")
        out = self.files.create(aside, True)
        out.write(json.dumps({"rows": name, "note": note}).encode())
        out.close()
        self._put(aside, self._path(f"commits/{turn:012d}"))
        for old in self._commits()[: -self.kept]:
            said = json.loads(self.spark.read.text(f"{self.folder}/commits/{old}").first()[0])
            self.files.delete(self._path(f"commits/{old}"), False)
            self.files.delete(self._path(said["rows"]), True)
        return turn

    def _put(self, aside, there) -> None:
        """One step; fails if the commit is there already."""
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self.context.rename(aside, there, options)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """spec_id, url of the last complete version of the manifest folder; no rows if there is none."""
    return Manifest(spark, path).read()[1]


def write_manifest(rows: DataFrame, path: str) -> int:
    return Manifest(rows.sparkSession, path).write(rows.select("spec_id", "url"))


class Keyed:
    """A table in a folder, its rows dealt to folders by the hash of their key, so that a change rewrites only the folders that
    hold keys of the change. The new folders' rows are written aside first, so nothing is read that is being replaced."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        by = rows.repartition("_bucket")
        by.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.folder)

    def create(self, rows: DataFrame) -> None:
        self._write(self._dealt(rows))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop("_bucket")

    def upsert(self, rows: DataFrame) -> int:
        """Puts rows in the place of those of the same key (unique in rows), or adds them. Returns the folders that were rewritten."""
        return self._change(rows, lambda table, rows: upserted(table, rows, self.key))

    def delete(self, victims: DataFrame) -> int:
        return self._change(victims.select(*self.key).distinct(), lambda table, rows: without(table, rows, self.key))

    def update(self, payload: DataFrame) -> int:
        """Sets payload's columns where the table has a row of the key (unique in payload)."""
        return self._change(payload, lambda table, rows: updated(table, rows, self.key))

    def _change(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        rows = saved(self.spark, self._dealt(rows))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return 0
        table = self.spark.read.parquet(self.folder).where(F.col("_bucket").isin(touched))
        new = saved(self.spark, self._dealt(change(table.drop("_bucket"), rows.drop("_bucket"))))
        left = {r[0] for r in new.select("_bucket").distinct().collect()}
        self._write(new)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for gone in set(touched) - left:  # nothing was written that could take its place
            files.delete(path(f"{self.folder}/_bucket={gone}"), True)
        return len(touched)
