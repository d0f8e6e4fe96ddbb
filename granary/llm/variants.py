"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. Each reduced word of the vocabulary generates its full one-edit neighbourhood, these
meet the reduced vocabulary in an equal join, and what meets is verified on the words themselves. Reduced words are few and
their neighbourhoods small, so the work follows the vocabulary and not the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, chunks, column, crc32, lower_ascii, runs, signed, text_column, utf8

#: Letters of a word, once A-Z are in lower case; symbols that they are hashed to; occurrences and letters of a word at least.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
SYMBOLS, OFTEN, LONG = 8, 3, 5
#: One in so many occurrences' words, by the document's own hash, loses a letter before words are counted.
TYPO_EVERY = 97
#: A form is at least so many times as frequent as the word.
TIMES = 2
_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
#: Neighbours that one step of the generation holds.
_STEP = 1 << 21


def symbol(letter: int) -> int:
    """The symbol of a letter: the top bits of a multiplicative hash."""
    return (letter * 0x9E3779B1 % (1 << 32)) * SYMBOLS >> 32


def _letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of A-Z, a-z and U+00C0 to U+00FF, which are those of lead byte 0xC3 and one more."""
    lead = data == 0xC3
    inside = (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122) | lead
    inside[1:] |= lead[:-1]
    return inside


def words(docs: DataFrame, often: int = OFTEN, long_: int = LONG, every: int = TYPO_EVERY) -> DataFrame:
    """word, n: the words of whole texts with at least `long_` code points and `often` occurrences.

    Runs of letters, A-Z in lower case. Where `every` divides h, the CRC-32 of `<doc_id>:<run>`, the run's code point h % length
    is deleted; a null id counts as the empty text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            ids = column(batch, "id").to_pylist()
            for lo, hi in chunks(offsets):
                part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]
                found, doc, _ = runs(lower_ascii(part), bounds, _letters(part))
                coded = found.dictionary_encode()
                known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                pairs, times = np.unique(doc * max(1, len(known)) + code, return_counts=True)
                doc, code = pairs // max(1, len(known)), pairs % max(1, len(known))
                raw, ends = bytes_of(known)
                before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[lo:hi]], np.uint32)
                h = crc32(before[doc], raw, ends[code], ends[code + 1])
                hurt = h % every == 0
                n = np.bincount(code[~hurt], times[~hurt], len(known)).astype(np.int64)
                some = (n > 0) & (pc.utf8_length(known).to_numpy() >= long_)
                cut = [w[:i] + w[i + 1 :] for w, x in zip(known.take(pa.array(code[hurt])).to_pylist(), h[hurt].tolist(), strict=True) for i in [x % len(w)]]
                whole = np.array([len(w) >= long_ for w in cut], bool)
                cut = pa.array([w for w in cut if len(w) >= long_], pa.large_string())
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([known.filter(pa.array(some)), cut]).cast(pa.string()), pa.array(np.concatenate([n[some], times[hurt][whole]]))], names=["word", "n"]
                )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_column().alias("text"))
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


_OF = np.zeros(256, np.uint64)
for _x in LETTERS:
    _OF[_x] = symbol(_x) + 1


def reduced(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters as symbols from 1 on, and the offsets. strings: of LETTERS, so Latin-1 holds them."""
    raw = [w.encode("latin-1") for w in strings.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    return _OF[np.frombuffer(b"".join(raw), np.uint8)], offsets


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def neighbourhoods(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row of equally long reduced words (m, length): their keys, and the keys of all that one deletion, replacement or insertion
    of a symbol makes of them, themselves included. A key is sum(symbol * B ** place), modulo 2 ** 64."""
    m, length = symbols.shape
    power, s = _powers(length + 1, _B), np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    ahead = np.zeros((m, length + 1), np.uint64)
    np.cumsum(symbols * power[:length], axis=1, out=ahead[:, 1:])
    whole = ahead[:, -1:]
    deleted = ahead[:, :-1] + (whole - ahead[:, 1:]) * np.uint64(_B_INV)
    replaced = whole[:, :, None] + (s - symbols[:, :, None]) * power[:length, None]
    inserted = (ahead + (whole - ahead) * np.uint64(_B))[:, :, None] + s * power[: length + 1, None]
    return whole[:, 0], np.concatenate([deleted, replaced.reshape(m, -1), inserted.reshape(m, -1)], axis=1)


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with each word's reduced form, as text and as its key."""
    to = "".join(chr(0x30 + symbol(x)) for x in LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, offsets = reduced(column(batch, "word"))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _powers(len(symbols), _B)[:-1], dtype=np.uint64)])
            keys = (sums[offsets[1:]] - sums[offsets[:-1]]) * _powers(len(symbols), _B_INV)[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "n"), pa.array(signed(keys))], names=["word", "n", "key"])

    keyed = vocabulary.mapInArrow(run, "word string, n long, key long")
    return keyed.withColumn("reduced", F.translate("word", "".join(map(chr, LETTERS)), to))


def _generated(reduced_words: DataFrame) -> DataFrame:
    """reduced, near: for each reduced word, once each, the keys of its one-edit neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "reduced")
            length = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            for n in np.unique(length).tolist():
                same = texts.filter(pa.array(length == n))
                step = max(1, _STEP // ((2 * n + 1) * (SYMBOLS + 1)))
                for lo in range(0, len(same), step):
                    part = same.slice(lo, step)
                    data, _ = bytes_of(part)
                    _, near = neighbourhoods(data.reshape(len(part), n).astype(np.uint64) - np.uint64(0x2F))
                    near.sort(axis=1)
                    new = np.ones(near.shape, bool)
                    new[:, 1:] = near[:, 1:] != near[:, :-1]
                    names = part.take(pa.array(np.repeat(np.arange(len(part)), new.sum(1))))
                    yield pa.RecordBatch.from_arrays([names, pa.array(signed(near[new]))], names=["reduced", "near"])

    return reduced_words.mapInArrow(run, "reduced string, near long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: every two words of the vocabulary (word, n) that are one inserted, deleted or replaced code point apart, in
    both directions, each once. The vocabulary is read three times, so it should be a table."""
    keyed = _keyed(vocabulary)
    generated = _generated(keyed.select("reduced").distinct())
    met = generated.join(keyed.select(F.col("key").alias("near"), F.col("word").alias("_y"), F.col("n").alias("near_n")), "near").select("reduced", "_y", "near_n")
    both = keyed.select("word", "reduced").join(met, "reduced").where(F.levenshtein("word", "_y", 1) == 1)
    return both.select("word", F.col("_y").alias("near"), "near_n")


def roots(keep: Scratch, forms: DataFrame) -> DataFrame:
    """word, root of each row of forms (word, form) that has a form: where following the forms ends. Pointers are doubled in rounds of
    joins. Every step at least doubles the frequency, so a chain has at most 62 steps and there are at most six rounds."""
    up = keep.save(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "up-0")
    k = 0
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumped = keep.save(up.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"up-{k + 1}")
        keep.drop(f"up-{k}")
        up, k = jumped, k + 1
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def group(docs: DataFrame, often: int = OFTEN, long_: int = LONG, every: int = TYPO_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (see words): n its occurrences, n_near its near words, form the most
    frequent of them (ties: smallest code points) if that one is at least TIMES as frequent, form_n its occurrences, and root
    the last of the forms' chain; the word itself without a form.

    Null and empty texts have no words; repeated rows count each; null ids count as the empty text. No documents, no rows.
    """
    keep = Scratch(docs.sparkSession)
    vocabulary = keep.save(words(docs, often, long_, every), "words")
    none = F.lit(None)
    each = vocabulary.select("word", "n", none.cast("string").alias("near"), none.cast("long").alias("near_n"))
    near = near_words(vocabulary).select("word", none.cast("long").alias("n"), "near", "near_n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))))
    rows = each.union(near).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.n") >= TIMES * F.col("n")
    forms = rows.select("word", F.when(chosen, F.col("best.word")).alias("form"), "n", "n_near", F.when(chosen, -F.col("best.n")).alias("form_n"))
    forms = keep.save(forms, "forms")
    out = forms.join(roots(keep, forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_sql() -> str:
    """The same as SQL: CRC-32 by its table, near words by what is left when one code point is masked or taken out."""
    return f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i)) AS t),
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
    coded AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM counted),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT),
                 lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT)) AS h FROM coded, crc),
    kept AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= {LONG} GROUP BY word HAVING sum(n) >= {OFTEN}),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    masked AS (SELECT word, n, substring(word, 1, i - 1) || '_' || substring(word, i + 1) AS m, substring(word, 1, i - 1) || substring(word, i + 1) AS d FROM places),
    pairs AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.m = b.m WHERE a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM masked a JOIN v b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM masked a JOIN v b ON a.d = b.word),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * v.n THEN near_n END AS form_n
              FROM v LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
    ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
