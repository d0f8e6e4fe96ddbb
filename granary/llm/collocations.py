"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow from their prefixes. A phrase occurs at most as often as its prefix, so the prefix's counts bound the score of
all that it grows into; a suffix bounds it likewise. The prefixes of each language with the highest bounds are expanded first,
and the bar is lowered until the language's last wanted score is settled: what was not expanded can't reach it. Expanding
a set of prefixes is a pass over the texts that counts their continuations; tasks know the set from bitmaps of fixed size,
which can let more through, but never less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, chunks, column, lower_ascii, mix, runs, text_column, utf8

#: Occurrences of a candidate at least; rows of each language; share (in percent) of a candidate's occurrences inside a longer one that
#: drops it; scores are whole numbers of SCALE.
OFTEN, MOST, INSIDE, SCALE = 10, 2000, 50, 1_000_000
#: The first expansion takes prefixes down to this rank of each language, in multiples of MOST; each further one so many times deeper.
DEPTH, DEEPER = 2, 8
#: Shares of a language's phrases that are ranked before they are ranked together.
SHARES = 16
#: Bits of a bitmap, as a power of two; bytes of text that a task takes at once.
BITS, _TEXT = 25, 1 << 20
NO_LANGUAGE = "und"
_SPLIT, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_SPLIT[[*b".,;:!?\n\x0b\x0c\r"]] = True
_BLANK[[*b" \t"]] = True
_B = 0x9E3779B97F4A7C15


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: sums of byte * B ** place, scrambled."""
    data, offsets = bytes_of(strings)
    power = np.full(len(data) + 1, _B, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    back = np.full(len(data) + 1, pow(_B, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]], 7)


class Tokens:
    """The words of some documents: code (place in `known`), language (place in `languages`), and whether the next word
    follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: pa.Array):
        part = lower_ascii(data[offsets[0] : offsets[-1]])
        split = _SPLIT[part]
        found, doc, start = runs(part, offsets, ~(split | _BLANK[part]))
        coded, lang = found.dictionary_encode(), languages.dictionary_encode()
        self.known, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.languages = lang.dictionary
        self.lang = lang.indices.to_numpy().astype(np.int64)[doc]
        piece = np.cumsum(split)[start] if len(start) else start
        self.next = np.zeros(len(start), bool)
        self.next[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        #: of each language and word of `known`
        self.hash = np.add.outer(mix(hashes(self.languages), 3), hashes(self.known)) if len(self.known) else np.zeros((len(self.languages), 0), np.uint64)

    def counted(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """lang, phrase, n of the phrases of `size` words that begin at these places."""
        k = max(1, len(self.known))
        key = self.lang[at] * k + self.code[at]
        parts = [self.code[at]]
        for j in range(1, size):  # each step's key is the place of a distinct prefix, so it can't overflow
            prefix, key = np.unique(key, return_inverse=True)
            key = key * k + self.code[at + j]
            parts.append(self.code[at + j])
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        words = [self.known.take(pa.array(p[first])) for p in parts]
        phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
        return pa.RecordBatch.from_arrays([self.languages.take(pa.array(self.lang[at][first])).cast(pa.string()), phrase.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])


def _pairs_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(_B) + mix(second, 11), 13)


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold a hash, by two of its bits."""
    one, other = (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    bit = lambda at: bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
    return (bit(one) & bit(other)).astype(bool)


def _bitmaps(rows: DataFrame, sets: list[str]) -> Broadcast:
    """For each of the named conditions a bitmap of the rows (lang, phrase of one or two words) that meet it. What comes to the
    driver and goes to the tasks is the bitmaps, whose size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = np.zeros((len(sets), 1 << BITS - 6), np.uint64)
        for batch in batches:
            words = pc.split_pattern(column(batch, "phrase").cast(pa.large_string()), " ")
            size = np.unique(pc.list_value_length(words).to_numpy())
            own = mix(hashes(column(batch, "lang")), 3)
            parts = [own + hashes(pc.list_element(words, j)) for j in range(int(size.max(initial=1)))]
            h = parts[0] if len(parts) == 1 else _pairs_hash(parts[0], parts[1])
            for i, name in enumerate(sets):
                some = h[column(batch, name).to_numpy(zero_copy_only=False)]
                for at in ((some >> np.uint64(64 - BITS)).astype(np.int64), (some & np.uint64((1 << BITS) - 1)).astype(np.int64)):
                    np.bitwise_or.at(maps[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slot = np.flatnonzero(maps.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(m[slot].view(np.int64)) for m in maps)], names=["slot", *sets])

    made = rows.select("lang", "phrase", *sets).mapInArrow(run, ", ".join(["slot long", *(f"{s} long" for s in sets)]))
    found = made.groupBy("slot").agg(*(F.bit_or(s).alias(s) for s in sets)).toArrow()
    maps = {s: np.zeros(1 << BITS - 6, np.uint64) for s in sets}
    for s in sets:
        maps[s][found["slot"].to_numpy()] = found[s].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(maps)


def _counts(docs: DataFrame, choose) -> DataFrame:
    """lang, phrase, n: occurrences of phrases; choose: places of the phrases that count among Tokens, and the phrases' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(column(batch, "text"))
            languages = column(batch, "lang").cast(pa.large_string())
            for lo, hi in chunks(offsets, _TEXT):
                tokens = Tokens(data, offsets[lo : hi + 1], languages.slice(lo, hi - lo))
                at, size = choose(tokens)
                if len(at):
                    yield tokens.counted(at, size)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang") if "lang" in docs.columns else F.lit(NO_LANGUAGE).alias("lang"), text_column().alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)) in whole numbers of up to 38 digits, so exact for counts under 10 ** 15."""
    big = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)"), (big(left) * big(right)).cast("decimal(31,0)"))


def _first(phrase: str, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def _pairs(keep: Scratch, docs: DataFrame, often: int) -> tuple[DataFrame, DataFrame]:
    """The languages' totals (lang, total), and all candidates of two words: lang, phrase, a, l, r, score."""
    counted = keep.save(_counts(docs, lambda t: (np.arange(len(t.code)), 1)), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counted.where(F.col("n") >= often).withColumn("frequent", F.lit(True))
    known = _bitmaps(frequent, ["frequent"])

    def grow(t: Tokens) -> tuple[np.ndarray, int]:
        may = _held(known.value["frequent"], t.hash.ravel()).reshape(t.hash.shape)[t.lang, t.code]
        at = np.flatnonzero(t.next & may)
        return at[may[at + 1]], 2

    two = _counts(docs, grow).where(F.col("n") >= often).select("lang", "phrase", F.col("n").alias("a"))
    word = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    two = two.withColumns({"w1": _first("phrase", 1), "w2": _first("phrase", -1)}).join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    return totals, keep.save(two.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score")), "pairs")


def _bars(pairs: DataFrame, rank: int) -> DataFrame:
    """lang, bar: the score that `rank` pairs of the language reach; 0 if it has fewer. A language has at most SCALE + 1 scores."""
    scores = pairs.groupBy("lang", "score").agg(F.count("*").alias("n"))
    deep = scores.withColumn("n", F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("score"))))
    return deep.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("n") >= rank, F.col("score"))), F.lit(0)).alias("bar"))


def _triples(docs: DataFrame, pairs: DataFrame, often: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates of three words that may reach their language's bar, and of all that hold a pair
    that reaches it. pairs: with bar.

    A phrase of three words scores at most a / l of its first two, and at most a / r of its last two."""
    up = lambda n: F.call_function("div", F.col("a").cast("decimal(15,0)") * F.lit(SCALE).cast("decimal(7,0)"), F.col(n).cast("decimal(15,0)"))
    marked = pairs.withColumns({"any": F.lit(True), "prefix": up("l") >= F.col("bar"), "suffix": up("r") >= F.col("bar"), "reached": F.col("score") >= F.col("bar")})
    frontier = _bitmaps(marked, ["any", "prefix", "suffix", "reached"])

    def grow(t: Tokens) -> tuple[np.ndarray, int]:
        two = np.flatnonzero(t.next)
        h = _pairs_hash(t.hash[t.lang[two], t.code[two]], t.hash[t.lang[two], t.code[two + 1]])
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        held = {k: np.zeros(len(t.code) + 1, bool) for k in frontier.value}
        for k, bitmap in frontier.value.items():
            held[k][two] = _held(bitmap, h[first])[same]
        now, after = (lambda k: held[k][:-1]), (lambda k: held[k][1:])
        good = now("prefix") & after("suffix") | now("reached") & after("any") | now("any") & after("reached")
        return np.flatnonzero(good), 3

    three = _counts(docs, grow).where(F.col("n") >= often).select("lang", "phrase", F.col("n").alias("a"))
    three = three.withColumns({"head": _first("phrase", 2), "tail": _first("phrase", -2)})
    head = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("two"), F.col("l").alias("one"))
    tail = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("last_two"), F.col("r").alias("last"))
    three = three.join(head, ["lang", "head"]).join(tail, ["lang", "tail"])
    three = three.withColumns({"s1": _score("a", "one", "last_two"), "s2": _score("a", "two", "last")})
    lower = F.col("s2") < F.col("s1")  # ties to the shorter first part
    return three.select(
        "lang", "phrase", "a", F.when(lower, F.col("two")).otherwise(F.col("one")).alias("l"), F.when(lower, F.col("last")).otherwise(F.col("last_two")).alias("r"), F.least("s1", "s2").alias("score")
    )


def mine(docs: DataFrame, most: int = MOST, often: int = OFTEN, inside: int = INSIDE, depth: int = DEPTH) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's best phrases of two and three words, by score, then a,
    both descending, then phrase.

    a: occurrences; l, r: those of the two parts of the lowest-scoring cut (ties: the shorter first part); score: floor(SCALE *
    a * a / (l * r)); n: all words of the language. Candidates occur `often` times at least. Those inside a longer candidate
    that has `inside` percent of their occurrences are dropped. Text is cut into pieces at . , ; : ! ? and line ends; phrases
    don't cross pieces. Null languages are "und", null texts empty. Without documents, or with rare phrases only, no rows.
    """
    keep = Scratch(docs.sparkSession)
    totals, pairs = _pairs(keep, docs, often)
    done, rank, turn = None, depth * most, 0
    while True:
        barred = pairs.join(_bars(pairs, rank), "lang")
        three = keep.save(_triples(docs, barred, often), f"triples-{turn}")
        longer = three.select("lang", F.explode(F.array(_first("phrase", 2), _first("phrase", -2))).alias("phrase"), F.col("a").alias("_longer"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
        reached = F.col("score") >= F.col("bar")
        two = barred.where(reached).join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < inside * F.col("a")))
        bars = barred.select("lang", "bar").distinct()
        left = two.drop("_longer").unionByName(three.join(bars, "lang").where(reached))
        left = keep.save(left.select("lang", "phrase", "a", "l", "r", "score", "bar"), f"left-{turn}")
        known = left.groupBy("lang").agg(F.count("*").alias("_n"))
        settled = bars.join(known, "lang", "left").where((F.coalesce("_n", F.lit(0)) >= most) | (F.col("bar") == 0)).select("lang")
        good = left.join(settled, "lang", "left_semi").drop("bar")
        done = good if done is None else done.union(good)
        pairs = pairs.join(settled, "lang", "left_anti")
        if pairs.isEmpty():
            break
        pairs = keep.save(pairs, f"pairs-{turn}")
        rank, turn = rank * DEEPER, turn + 1
    # a language's rows are ranked in SHARES first, so that no task ranks more than that many times `most` of them
    first = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = done.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", first("lang", "_share")).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", first("lang")).where(F.col("rank") <= most).join(totals, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def mine_sql(most: int = MOST, often: int = OFTEN, inside: int = INSIDE) -> str:
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(lang, '{NO_LANGUAGE}') AS lang, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
    w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces WHERE regexp_matches(piece, '[^\x20\x09]')),
    grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS p FROM w, (SELECT unnest([1, 2, 3]) AS k)),
    f AS MATERIALIZED (SELECT lang, k, p, count(*) AS n FROM grams GROUP BY ALL),
    c AS (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k > 1 AND n >= {often}),
    cuts AS (SELECT lang, k, p, a, w, unnest(range(1, k)) AS cut FROM c),
    scored AS (SELECT x.lang, x.k, x.p, x.a, cut, l.n AS l, r.n AS r, ({SCALE}::HUGEINT * x.a * x.a // (l.n::HUGEINT * r.n))::BIGINT AS score FROM cuts x
               JOIN f l ON l.lang = x.lang AND l.k = cut AND l.p = array_to_string(x.w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.k = x.k - cut AND r.p = array_to_string(x.w[cut + 1 :], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
    longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p, a FROM c WHERE k = 3),
    most AS (SELECT lang, p, max(a) AS longest FROM longer GROUP BY ALL),
    kept AS (SELECT x.* FROM lowest x LEFT JOIN most m ON m.lang = x.lang AND m.p = x.p AND x.k = 2 WHERE longest IS NULL OR 100 * longest < {inside} * x.a),
    n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n.n, score FROM kept JOIN n USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) <= {most}"""
