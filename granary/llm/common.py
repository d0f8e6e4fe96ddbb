"""What the operators share: scratch tables in the shared folder, and vectorised word hashing of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are cut at these bytes. Bytes from 0x80 on belong to letters beyond ASCII in UTF-8.
SPACES = b" \t\n\x0b\x0c\r"
PUNCT = SPACES + bytes(c for c in range(128) if not chr(c).isalnum())
#: Bytes of text that one step of the vectorised code takes at once; longer documents are taken alone and whole.
CHUNK = 1 << 19

_B, _B_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


# ---------------------------------------------------------------- scratch tables


class Scratch:
    """A folder of Parquet tables under spark.checkpoint.dir, which the driver and all executors share.

    Writing a table cuts the lineage: a lost executor costs no more than the files that it was writing. Results are read from
    these tables when the caller asks for rows, so the folder stays as long as the driver does, and is deleted as it ends.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.gettempdir()
        self.spark, self.dir = spark, f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.dir)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as a table and reads it again."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_column(name: str = "text") -> Column:
    """The column, with the empty text for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- vectorised text


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Row ranges of about `most` bytes: no row is cut, a longer one stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (1 << 18))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h + np.uint64((seed * 0xBF58476D1CE4E5B9 + 0x632BE59BD9B4E019) % (1 << 64))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _table(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32 * fold)
    cut = np.zeros(256, bool)
    cut[list(separators)] = True
    return lower + np.uint64(1), cut


class Words:
    """The words of some documents: 64-bit hashes after lower-casing A-Z (if fold), and where each stands.

    hash, start, end: one entry a word (byte positions in data); first: index of each document's first word, and the end.
    breaks: marks of bytes (from the first document's on, and the end) before which a word ends, besides separators.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES, fold: bool = True, breaks: np.ndarray | None = None):
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        self.base, self.bytes = base, data[base : base + n]
        offs = (offsets - base).astype(np.int64)
        lower, cut = _table(separators, fold)
        inside = (~cut).take(self.bytes)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        if breaks is not None:
            edge |= breaks
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)
        self._sums = np.zeros(n + 1, np.uint64)
        values = lower.take(self.bytes)
        values *= _power(_B, n)
        np.cumsum(values, out=self._sums[1:])
        self.hash = mix(self._span(self.start, self.end))

    def _span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * _power(_B_INV, len(self._sums))[start]

    def heads(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes."""
        return mix(self._span(self.start, np.minimum(self.start + n, self.end)), n)

    def tails(self, n: int) -> np.ndarray:
        """Hashes of the words' last n bytes."""
        return mix(self._span(np.maximum(self.end - n, self.start), self.end), 64 + n)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Each word's document, by number."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words that stay in one document, each run's first word, and the runs' offsets by document.

    A document with some words, but fewer than `size`, has one run of all its words.
    """
    counts = np.diff(first)
    short = (counts > 0) & (counts < size)
    runs = np.where(short, 1, np.maximum(counts - size + 1, 0))
    out_first = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first[:-1], runs)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    acc = np.zeros(len(at), np.uint64)
    length = np.repeat(np.where(short, counts, size), runs)
    for j in range(size):
        part = padded[at + j]
        if short.any():
            part = np.where(j < length, part, np.uint64(0))
        acc = acc * np.uint64(_B) + part
    return mix(acc, size), at, out_first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The longest runs of marked bytes, none over two rows: as strings, each one's row, and its place in data.

    inside: a mark for each byte from offsets[0] to offsets[-1]; data: these bytes, in the form that the strings are to have.
    """
    first = (offsets - offsets[0]).astype(np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    ends = np.concatenate([[0], np.cumsum(end - start)])
    strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside])))
    return strings, np.searchsorted(first, start, "right") - 1, start


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of strings, from zero on."""
    data, offsets = utf8(strings)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _crc_table() -> np.ndarray:
    """The remainders of CRC-32 by byte."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, np.uint32(0xEDB88320) ^ (r >> np.uint32(1)), r >> np.uint32(1)).astype(np.uint32)
    return r


_CRC = _crc_table()


def crc32(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what `before` is the CRC-32 of, followed by data[start:end], row by row."""
    crc, at, left = ~before.astype(np.uint32), start.copy(), np.flatnonzero(start < end)
    while len(left):
        crc[left] = _CRC[(crc[left] ^ data[at[left]]) & 0xFF] ^ (crc[left] >> np.uint32(8))
        at[left] += 1
        left = left[at[left] < end[left]]
    return ~crc


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
