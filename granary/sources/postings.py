"""Stored postings: an inverted index as a Parquet table, written once, appended to by ingest, and read by tokens.

Documents are numbered in blocks. A row holds one token's postings in one block: token_id, block, n (documents), docs (numbers in
the block), tfs. The table is partitioned by range of token ids, so a search reads the folders that its tokens are in, and in
these the row groups that hold them; a token's document frequency is the sum of its rows' n. A block's own row, in the range
-1, has the ids of its documents. Columns that searches filter by are the same for all of a block's documents and are
in every row, so a filter is applied where rows are read, and frequencies are those of the documents left.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.sizes import if_small
from granary.functions.text import lowered
from granary.operators import sparse

#: Folders of token ranges; documents of a block; tokens that are looked for by their numbers in the filter, not by a join.
RANGES, BLOCK, LITERALS = 32, 4096, 200
#: Queries that are scored at once, and tokens.
QUERY_BLOCK, TOKEN_BLOCK = 256, 1024


class Asked(NamedTuple):
    """What queries ask for: their names; token ids in order; and for each term its query, its token's place, and its weight."""

    names: pa.Array
    tokens: np.ndarray
    query: np.ndarray
    place: np.ndarray
    weight: np.ndarray


class Postings:
    """A store in a folder. by: columns that searches may filter by."""

    def __init__(self, spark: SparkSession, folder: str, id_: str = "doc_id", by: tuple[str, ...] = ()):
        self.spark, self.folder, self.id_, self.by = spark, folder.rstrip("/"), id_, list(by)

    def _files(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def append(self, docs: DataFrame, text: str = "text") -> None:
        """Adds documents (id, text and the columns to filter by); what is stored is not read and stays as it is. Ids are not looked for
        among those stored. Each call writes a folder of its own, which counts once its job has ended."""
        turn = sum(x.startswith("batch=") for x in self._files())
        kinds = dict(docs.dtypes)
        schema = f"range int, token_id long, block long, n int, docs array<int>, tfs array<int>, ids array<{kinds[self.id_]}>" + "".join(f", {c} {kinds[c]}" for c in self.by)
        rows = docs.select(self.id_, *self.by, lowered(F.col(text)).alias("_text"))
        id_, by = self.id_, self.by

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, turns = (turn << 48) | (TaskContext.get().partitionId() << 20), 0
            for batch in batches:
                table = pa.Table.from_batches([batch])
                keys = table.select(by).combine_chunks()
                group = np.zeros(len(table), np.int64)
                for c in by:
                    group = group * (len(table) + 1) + keys[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                    group = np.unique(group, return_inverse=True)[1]
                for g in np.unique(group).tolist():
                    some = table.filter(pa.array(group == g)).sort_by(id_)
                    for lo in range(0, len(some), BLOCK):
                        yield from _block(some.slice(lo, BLOCK).combine_chunks(), base + turns)
                        turns += 1

        def _block(part: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
            doc, token, tf = (np.concatenate(x) for x in zip(*((lo + d, t, n) for lo, d, t, n in sparse.token_counts(_flat(part["_text"]))), strict=True))
            order = np.lexsort((doc, token))
            doc, token, tf = doc[order], token[order], tf[order]
            known, first = np.unique(token, return_index=True)
            bounds = pa.array(np.append(first, len(token)).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32)))
            k, ids = len(known), _flat(part[id_])
            same = lambda m: [pa.repeat(part[c][0], m) if part[c][0].is_valid else pa.nulls(m, part[c].type) for c in by]
            names = ["range", "token_id", "block", "n", "docs", "tfs", "ids", *by]
            here = lambda m, kind=pa.int64(), v=block: pa.array(np.full(m, v), kind)
            own = [here(1, pa.int32(), -1), here(1, v=-1), here(1), here(1, pa.int32(), len(part)), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            yield pa.RecordBatch.from_arrays([*own, *same(1)], names=names)
            ranges = (known * RANGES >> 31).astype(np.int32)
            sizes = np.diff(np.append(first, len(token))).astype(np.int32)
            rest = [pa.array(ranges), pa.array(known), here(k), pa.array(sizes), lists(doc), lists(tf), pa.nulls(k, pa.list_(ids.type))]
            yield pa.RecordBatch.from_arrays([*rest, *same(k)], names=names)

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        share = F.pmod(F.xxhash64("block"), F.lit(max(1, n // RANGES)))  # a range's rows are dealt out, too
        dealt = rows.mapInArrow(run, schema).repartition(n, "range", share).sortWithinPartitions("range", "token_id")
        dealt.write.partitionBy("range").parquet(f"{self.folder}/batch={turn}")

    def rows(self, where: Column | None = None) -> DataFrame:
        """The rows of all batches whose jobs have ended."""
        whole = [x for x in self._files() if x.startswith("batch=") and self._ended(x)]
        if not whole:
            raise ValueError(f"{self.folder} holds no postings")
        table = self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/{x}" for x in whole))
        return table if where is None else table.where(where)

    def _ended(self, batch: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{batch}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def of_tokens(self, tokens: np.ndarray, where: Column | None = None) -> DataFrame:
        """The rows of these token ids, and the blocks' own rows. Only the folders of their ranges are read."""
        ranges = sorted({-1, *(tokens.astype(np.int64) * RANGES >> 31).tolist()})
        table = self.rows(where).where(F.col("range").isin(ranges))
        if len(tokens) <= LITERALS:
            return table.where(F.col("token_id").isin([-1, *tokens.tolist()]))
        wanted = self.spark.createDataFrame(pa.table({"token_id": pa.array(np.append(tokens.astype(np.int64), -1))}))
        return table.join(F.broadcast(wanted), "token_id")  # TERMS bounds it

    def search(self, queries: DataFrame, k: int = 25, where: Column | None = None, terms: int = sparse.TERMS) -> DataFrame:
        """query_id, id, score, rank: as sparse.search over the stored documents that meet the condition on the columns `by`.

        Up to `terms` terms of queries go to the tasks: one pass over their postings for the frequencies, one in which each
        block's postings meet and its k best of each query go on. More terms meet the postings in joins.
        """
        asked = sparse.postings(queries, "query_id").select("query_id", "token_id", F.col("tf").alias("q_tf"))
        local = asked.limit(terms + 1).toArrow()
        if local.num_rows > terms:
            return self._by_joins(asked, k, where)
        names = local["query_id"].combine_chunks().dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        tokens, place = np.unique(local["token_id"].to_numpy().astype(np.int64), return_inverse=True)
        found = self.of_tokens(tokens, where).groupBy("token_id").agg(F.sum("n").alias("df")).toArrow()
        df = dict(zip(found["token_id"].to_pylist(), found["df"].to_pylist(), strict=True))
        n, many = df.pop(-1, 0), np.array([df.get(t, 0) for t in tokens.tolist()], float)
        weight = local["q_tf"].to_numpy() * np.log(1 + (n - many + 0.5) / (many + 0.5))[place]
        shared = self.spark.sparkContext.broadcast(Asked(names.dictionary, tokens, names.indices.to_numpy().astype(np.int64), place, weight))
        id_ = self.id_

        def best(table: pa.Table) -> pa.Table:
            return _best(shared.value, table, k, id_)

        rows = self.of_tokens(tokens[many > 0], where).select("token_id", "block", "docs", "tfs", "ids")
        kind = rows.schema["ids"].dataType.elementType.simpleString()
        scored = rows.groupBy("block").applyInArrow(best, f"query_id {dict(queries.dtypes)['query_id']}, {id_} {kind}, score double")
        return sparse.ranked(scored, k, id_)

    def _by_joins(self, asked: DataFrame, k: int, where: Column | None) -> DataFrame:
        wanted = if_small(asked.select("token_id").distinct())
        rows = self.rows(where)
        own, posted = rows.where("range = -1"), rows.where("range >= 0").join(wanted, "token_id")
        n = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        idf = posted.groupBy("token_id").agg(F.sum("n").alias("df")).select("token_id", sparse.idf(F.col("df"), n).alias("idf"))
        each = posted.select("token_id", "block", F.inline(F.arrays_zip("docs", "tfs")))
        scored = each.join(asked.join(idf, "token_id"), "token_id").groupBy("query_id", "block", "docs")
        scored = scored.agg(F.round(F.sum(F.col("q_tf") * F.col("tfs") * F.col("idf")), 6).alias("score"))
        named = own.select("block", F.posexplode("ids").alias("docs", self.id_))
        return sparse.ranked(scored.join(named, ["block", "docs"]).select("query_id", self.id_, "score"), k, self.id_)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return (out.chunk(0) if out.num_chunks else pa.array([], out.type)) if isinstance(out, pa.ChunkedArray) else out


def _best(asked: Asked, table: pa.Table, k: int, id_: str) -> pa.Table:
    """A block's k best documents of each query, from its rows; ids are in order, so of equals the first by id."""
    token = table["token_id"].to_numpy()
    at = int(np.flatnonzero(token == -1)[0])
    ids = table["ids"][at].values
    rest = table.take(pa.array(np.flatnonzero(token != -1)))
    docs, tfs = _flat(rest["docs"]), _flat(rest["tfs"])
    sizes = np.diff(docs.offsets.to_numpy()) if len(docs) else np.zeros(0, np.int64)
    place = np.repeat(np.searchsorted(asked.tokens, rest["token_id"].to_numpy()), sizes)
    doc, tf = docs.flatten().to_numpy(), tfs.flatten().to_numpy().astype(float)
    order = np.argsort(place, kind="stable")
    place, doc, tf = place[order], doc[order], tf[order]
    found = []
    for q in range(0, len(asked.names), QUERY_BLOCK):
        mine = (asked.query >= q) & (asked.query < q + QUERY_BLOCK)
        used, column = np.unique(asked.place[mine], return_inverse=True)
        query, weight = asked.query[mine] - q, asked.weight[mine]
        scores = np.zeros((len(ids), min(QUERY_BLOCK, len(asked.names) - q)))
        for lo in range(0, len(used), TOKEN_BLOCK):
            part = used[lo : lo + TOKEN_BLOCK]
            a, b = np.searchsorted(place, [part[0], part[-1] + 1])
            to = np.searchsorted(part, place[a:b])
            hit = part[to] == place[a:b]
            block, weights = np.zeros((len(ids), len(part))), np.zeros((len(part), scores.shape[1]))
            block[doc[a:b][hit], to[hit]] = tf[a:b][hit]
            some = (column >= lo) & (column < lo + len(part))
            weights[column[some] - lo, query[some]] = weight[some]
            scores += block @ weights
        scores = np.round(scores, 6)
        for i in range(scores.shape[1]):
            there = np.flatnonzero(scores[:, i] > 0)
            if len(there) > k:
                there = there[scores[there, i] >= np.partition(scores[there, i], len(there) - k)[len(there) - k]]
            there = there[np.argsort(-scores[there, i], kind="stable")][:k]
            found.append((np.full(len(there), q + i), there, scores[there, i]))
    found = found or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"query_id": asked.names.take(pa.array(query.astype(np.int64))), id_: ids.take(pa.array(doc.astype(np.int64))), "score": pa.array(score.astype(float))})
