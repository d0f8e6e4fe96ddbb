"""Toxicity by a convolutional text classifier, trained here in numpy by rounds of tasks over all labelled documents.

A word's vector is the sum of hashed embeddings of the word, its first bytes and its last bytes. Filters over one, two and
three words, a ramp, and the maximum over the whole text feed a logistic output. Thresholds are calibrated by language.
The embeddings begin with how the classes share each word, so that a few hundred labels are enough to begin with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import if_small
from .common import PUNCT, Scratch, Words, chunks, column, fresh, partitions, text_column, utf8

BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
#: Bytes of labelled text that a task holds at once, about, as features of 16 bytes a word.
LEARN_BYTES = 16 << 20
EPOCHS, BATCH, RATE = 8, 48, 0.08
#: A row of the table begins with what its words tell of the class, times SHARE_WEIGHT, if so many texts have them; PRIOR texts weigh against it.
LEAST_TEXTS, PRIOR, SHARE_WEIGHT = 3, 1.0, 0.75
#: A language's own threshold needs so many calibration documents of each class; else that of all languages holds.
LEAST_OF_LANGUAGE = 40
#: A threshold lets at most this share of the language's clean calibration documents through as toxic.
FALSE_ALARMS = 0.002


class Model(NamedTuple):
    table: np.ndarray  # (1 << BITS, DIM)
    kernel: np.ndarray  # (DIM, slices * FILTERS): for each width, a slice for each of its words
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    weight: np.ndarray
    offset: float
    scale: tuple[float, float]  # the calibrated score is the sigmoid of scale[0] * z + scale[1]
    thresholds: dict[str, float]  # by language; "" for others


def features(w: Words) -> np.ndarray:
    """Rows of the table for each word (4, words)."""
    shift = np.uint64(64 - BITS)
    return np.stack([(h >> shift).astype(np.int32) for h in (w.hash, w.heads(4), w.heads(6), w.tails(4))])


def _conv(model: Model, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors, and the filters' values with each word as first; words beyond the text's end count as zeros."""
    x = model.table[rows[0]]
    for r in rows[1:]:
        x = x + model.table[r]
    z = x @ model.kernel
    out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
    last = first[1:][np.diff(first) > 0] - 1
    at = 0
    for i, width in enumerate(WIDTHS):
        acc = z[:, at : at + FILTERS].copy()
        for j in range(1, width):
            part = z[j:, at + j * FILTERS : at + (j + 1) * FILTERS].copy()
            for back in range(j):  # words whose j-th successor is in the next text
                gone = last - back
                part[gone[(gone >= 0) & (gone < len(part))]] = 0
            acc[:-j or None] += part
        out[:, i * FILTERS : (i + 1) * FILTERS] = acc
        at += width * FILTERS
    return x, out + model.bias


def pooled(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The filters' maxima, not below zero, for each text; zeros for texts without words."""
    out = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        _, values = _conv(model, rows, first)
        out[some] = np.maximum(np.maximum.reduceat(values, first[:-1][some], axis=0), 0)
    return out


def logits(model: Model, w: Words) -> np.ndarray:
    return pooled(model, features(w), w.first) @ model.weight + model.offset


class Slopes(NamedTuple):
    """Of the mean logistic loss of some texts: by the table's rows `once`, and by the other weights."""

    once: np.ndarray
    table: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float


def slopes(model: Model, rows: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Slopes:
    """rows: features (4, words) of texts that all have words. The slope of a maximum goes to its first place."""
    x, values = _conv(model, rows, first)
    top = np.maximum.reduceat(values, first[:-1], axis=0)
    pool = np.maximum(top, 0)
    own = np.repeat(np.arange(len(labels)), np.diff(first))
    p = 1 / (1 + np.exp(-(pool @ model.weight + model.offset)))
    g = ((p - labels) / len(labels)).astype(np.float32)
    g_pool = g[:, None] * model.weight * (top > 0)
    place = np.zeros(top.shape, np.int64)
    at, f = np.nonzero(values == top[own])
    place[own[at[::-1]], f[::-1]] = at[::-1]
    g_kernel, touched, g_x, start = np.zeros_like(model.kernel), [], [], 0
    for i, width in enumerate(WIDTHS):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(width):
            t = place[:, cols] + j
            inside = (t < first[1:, None]) & (g_pool[:, cols] != 0)
            d, f = np.nonzero(inside)
            t, amount = t[d, f], g_pool[:, cols][d, f]
            col = start + j * FILTERS + f
            np.add.at(g_kernel.T, col, x[t] * amount[:, None])
            touched.append(t)
            g_x.append(model.kernel[:, col].T * amount[:, None])
        start += width * FILTERS
    t, g_x = np.concatenate(touched), np.concatenate(g_x)
    once, inverse = np.unique(rows[:, t].ravel(), return_inverse=True)
    g_table = np.zeros((len(once), DIM), np.float32)
    np.add.at(g_table, inverse, np.tile(g_x, (len(rows), 1)))
    return Slopes(once, g_table, g_kernel, g_pool.sum(0), pool.T @ g, float(g.sum()))


def first_state(with_: np.ndarray, without: np.ndarray, toxic: float, clean: float, rng: np.random.Generator) -> np.ndarray:
    """The weights before training. The first component of a row of the table is the log-odds, if positive, of toxic among the texts that
    have its words, against all texts; the filters take it with positive weights. All else is small and random.
    with_, without: toxic and clean texts that have words of a row; toxic, clean: of all texts."""
    toxic, clean = max(1.0, toxic), max(1.0, clean)
    share = toxic / (toxic + clean)
    odds = np.log((with_ + PRIOR * share) / (without + PRIOR * (1 - share))) - np.log(toxic / clean)
    table = rng.normal(0, 0.02, (1 << BITS, DIM)).astype(np.float32)
    table[:, 0] = np.where(with_ + without >= LEAST_TEXTS, np.maximum(odds, 0) * SHARE_WEIGHT, 0)
    kernel = rng.normal(0, 0.4, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
    kernel[0] = np.abs(kernel[0])
    weight = np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
    return _packed(table, kernel, np.zeros(len(weight), np.float32), weight, float(np.log(toxic / clean)))


def _packed(table: np.ndarray, kernel: np.ndarray, bias: np.ndarray, weight: np.ndarray, offset: float) -> np.ndarray:
    """All weights in rows of DIM, the table's first."""
    rest = np.concatenate([kernel.ravel(), bias, weight, [offset]])
    return np.concatenate([table.ravel(), rest, np.zeros(-len(rest) % DIM)]).astype(np.float32).reshape(-1, DIM)


def _model(state: np.ndarray) -> Model:
    """The packed weights as a model; arrays are views."""
    many, rest = len(WIDTHS) * FILTERS, state[1 << BITS :].ravel()
    kernel, bias, weight, offset = np.split(rest, np.cumsum([DIM * sum(WIDTHS) * FILTERS, many, many]))
    return Model(state[: 1 << BITS], kernel.reshape(DIM, -1), bias, weight, float(offset[0]), (1.0, 0.0), {})


def epoch(state: np.ndarray, sums: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray) -> None:
    """Goes on training in place, once over the texts (feature rows (4, words) each) in this order: Adagrad on the logistic loss.
    sums: of the squared slopes, packed like the weights."""
    model, total = _model(state), _model(sums)
    offset, offset_sum = model.offset, total.offset
    for lo in range(0, len(order), BATCH):
        pick = [i for i in order[lo : lo + BATCH] if texts[i].shape[1]]
        if not pick:
            continue
        first = np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in pick])])
        g = slopes(model._replace(offset=offset), np.concatenate([texts[i] for i in pick], axis=1), first, labels[pick])
        total.table[g.once] += g.table**2
        model.table[g.once] -= RATE * g.table / np.sqrt(total.table[g.once])
        for a, s, slope in ((model.kernel, total.kernel, g.kernel), (model.bias, total.bias, g.bias), (model.weight, total.weight, g.weight)):
            s += slope**2
            a -= RATE * slope / np.sqrt(s)
        offset_sum += g.offset**2
        offset -= RATE * g.offset / offset_sum**0.5
    state[:] = _packed(model.table, model.kernel, model.bias, model.weight, offset)
    sums[:] = _packed(total.table, total.kernel, total.bias, total.weight, offset_sum)


class Part(NamedTuple):
    """Some labelled documents in the order of their hashes."""

    texts: list[np.ndarray]
    labels: np.ndarray
    langs: list[str | None]
    aside: np.ndarray


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The rows (h, lang, toxic, aside, text) in parts of about LEARN_BYTES of text, or one longer document."""
    held, size = [], 0
    for batch in batches:
        data, offsets = utf8(column(batch, "text"))
        for lo, hi in chunks(offsets):
            if held and size + offsets[hi] - offsets[lo] > LEARN_BYTES:
                yield _sorted(held)
                held, size = [], 0
            w = Words(data, offsets[lo : hi + 1], PUNCT)
            f = features(w)
            own = batch.slice(lo, hi - lo)
            values = [column(own, c).to_numpy(zero_copy_only=False) for c in ("h", "toxic", "aside")]
            held.append(([f[:, w.first[i] : w.first[i + 1]].copy() for i in range(hi - lo)], column(own, "lang").to_pylist(), *values))
            size += int(offsets[hi] - offsets[lo])
    if held:
        yield _sorted(held)


def _sorted(held: list[tuple]) -> Part:
    texts, langs = ([x for h in held for x in h[i]] for i in (0, 1))
    h, y, aside = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
    order = np.argsort(h, kind="stable")
    return Part([texts[i] for i in order], y[order].astype(np.float32), [langs[i] for i in order], aside[order])


def _logits_at(model: Model, part: Part, pick: np.ndarray) -> np.ndarray:
    z = [_logits_of(model, part.texts, pick[i : i + 256]) for i in range(0, len(pick), 256)]
    return np.concatenate(z) if z else np.zeros(0, np.float32)


def _shares(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many of the documents to learn from have words of each row of the table: toxic ones, clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        for part in parts(batches):
            for x, label in zip(part.texts, part.labels, strict=True):
                n[0 if label else 1][np.unique(x)] += 1
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *n[:, at])], names=["at", "toxic", "clean"])

    got = rows.mapInArrow(run, "at long, toxic long, clean long").groupBy("at").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()
    out = np.zeros((2, 1 << BITS))
    out[:, got["at"].to_numpy()] = got["toxic"].to_numpy(), got["clean"].to_numpy()
    return out[0], out[1]


def _round(rows: DataFrame, state: np.ndarray, sums: np.ndarray, k: int, draw: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """State and sums after the k-th epoch, and the loss of the state before it on the documents set aside. Each task goes on from the
    state over the documents that it reads; a row of weights becomes the mean of the tasks that changed it, by their documents."""
    shared = rows.sparkSession.sparkContext.broadcast((state, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        after, first, loss, n = [x.copy() for x in before], _model(before[0]), 0.0, 0
        for part in parts(batches):
            pick = np.flatnonzero(part.aside)
            loss += float((np.logaddexp(0, z := _logits_at(first, part, pick)) - part.labels[pick] * z).sum(dtype=np.float64))
            pick, rng = np.flatnonzero(~part.aside), np.random.default_rng()
            rng.bit_generator.state = draw
            for _ in range(k + 1):
                order = rng.permutation(len(pick))
            epoch(*after, part.texts, part.labels, pick[order])
            n += len(pick)
        change = np.concatenate([a - b for a, b in zip(after, before, strict=True)], axis=1)
        at = np.flatnonzero(change.any(1))
        own = np.zeros((1, 2 * DIM), np.float32)  # the loss, in two floats
        own[0, 0] = loss
        own[0, 1] = loss - float(own[0, 0])
        values = [pa.array(np.ascontiguousarray(x)) for x in (np.append(at, -1), np.full(len(at) + 1, n), *np.append(change[at], own, axis=0).T)]
        yield pa.RecordBatch.from_arrays(values, names=["at", "n", *names])

    names = [f"c{i}" for i in range(2 * DIM)]
    tuned = rows.mapInArrow(run, ", ".join(["at long", "n long", *(f"{c} float" for c in names)]))
    weight = F.when(F.col("at") < 0, F.lit(1)).otherwise(F.col("n"))  # losses are summed
    total = F.when(F.col("at") < 0, F.lit(1)).otherwise(F.sum("n"))
    mean = [(F.sum(F.col(c).cast("double") * weight) / total).cast("float").alias(c) for c in names]
    got = tuned.groupBy("at").agg(*mean).toArrow()  # a row a row of weights, however many tasks
    shared.destroy()
    at = got["at"].to_numpy()
    loss, some = sum(float(got[c].to_numpy()[at < 0].sum(dtype=np.float64)) for c in names[:2]), at >= 0
    state, sums = state.copy(), sums.copy()
    for i, c in enumerate(names):  # one column at a time, as the driver has all rows of weights
        (state if i < DIM else sums)[at[some], i % DIM] += got[c].to_numpy()[some]
    return state, sums, loss


def _judged(rows: DataFrame, state: np.ndarray, keep: Scratch, name: str) -> DataFrame:
    """lang, toxic, z (the state's logit), key (its bits as an integer in the same order) of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for part in parts(batches):
            z = _logits_at(model, part, np.arange(len(part.labels))).astype(np.float32)
            bits = z.view(np.int32)
            key = np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits)
            values = [pa.array([x or "" for x in part.langs], pa.string()), *map(pa.array, (part.labels.astype(np.int32), z, key))]
            yield pa.RecordBatch.from_arrays(values, names=["lang", "toxic", "z", "key"])

    out = keep.save(rows.mapInArrow(run, "lang string, toxic int, z float, key int"), name)
    shared.destroy()
    return out


def trained(rows: DataFrame, keep: Scratch) -> np.ndarray:
    """The state after the epoch with the least loss on the documents set aside; after the last, if there are none.
    rows: h, lang, toxic, aside, text; every document is learnt from or set aside."""
    learn, apart = rows.where("not aside"), rows.where("aside")
    n = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    rng = np.random.default_rng(1)
    state = first_state(*_shares(learn), float(n.get(1, 0)), float(n.get(0, 0)), rng)
    many = len(WIDTHS) * FILTERS
    sums = _packed(np.ones((1 << BITS, DIM)), *(np.full(x, 0.1) for x in (DIM * sum(WIDTHS) * FILTERS, many, many)), 0.1)
    draw, best, least = rng.bit_generator.state, state, np.inf
    for k in range(EPOCHS):
        before = state
        state, sums, loss = _round(rows, state, sums, k, draw)
        if k and loss < least:
            best, least = before, loss
    if apart.isEmpty():
        return state
    z = F.col("z").cast("double")
    judged = _judged(apart, state, keep, "last")
    loss = judged.agg(F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("toxic") * z)).first()[0]
    keep.drop("last")
    return state if loss < least else best


def _curve(judged: DataFrame, beta: np.ndarray) -> list[float]:
    """The sums of a Newton step over all rows, five numbers a task. beta is no part of the plan, so the driver plans and compiles
    the same query each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(5)
        for batch in batches:
            z = column(batch, "z").to_numpy().astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(z * beta[0] + beta[1], -30, 30)))
            target = np.where(column(batch, "toxic").to_numpy() == 1, 0.995, 0.005)  # keeps separable scores finite
            w, off = p * (1 - p) + 1e-6, p - target
            total += [(w * z * z).sum(), (w * z).sum(), w.sum(), (off * z).sum(), off.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=list("abcde"))

    sums = judged.select("toxic", "z").mapInArrow(run, ", ".join(f"{c} double" for c in "abcde")).toArrow()
    return [math.fsum(sums[c].to_pylist()) for c in "abcde"]


def calibrated(model: Model, judged: DataFrame) -> Model:
    """Fits the sigmoid's scale by Newton's method, and a threshold for each language: the score that most of its toxic
    documents reach while FALSE_ALARMS of its clean ones do, halfway up to the next toxic one. judged: lang, toxic, z, of which
    each step takes sums over all rows."""
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        a, b, c, d, e = _curve(judged, beta)
        step = np.linalg.solve(np.array([[a, b], [b, c]]) + 1e-3 * np.eye(2), np.array([d, e]) + 1e-3 * (beta - [1, 0]))
        step = step / max(1.0, np.abs(step / [0.1, 0.5]).max())  # separable classes flatten the curve
        beta = beta - step
        if np.abs(step).max() < 1e-12:
            break
    scale = (float(np.clip(beta[0], 0.05, 4)), float(np.clip(beta[1], -20, 20)))
    return model._replace(scale=scale, thresholds=thresholds(judged, scale))


def thresholds(judged: DataFrame, scale: tuple[float, float]) -> dict[str, float]:
    """By language, and "" for all. A clean document's place in the order is found exactly by counts: first of the upper halves of
    the logits' bits, then of the lower ones in one upper half."""
    each = judged.select(F.explode(F.array_distinct(F.array(F.lit(""), "lang"))).alias("of"), "toxic", "z", "key")
    n = {r["of"]: (r["clean"], r["toxic"]) for r in each.groupBy("of").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).where(F.expr(f"of = '' or least(clean, toxic) >= {LEAST_OF_LANGUAGE}")).collect()}
    place = {k: min(clean - 1, int(np.ceil(clean * (1 - FALSE_ALARMS))) - 1) for k, (clean, _) in n.items() if clean}
    clean, key = each.where("toxic = 0"), dict.fromkeys(place, 0)
    for half in (F.shiftright("key", 16), F.col("key").bitwiseAND(0xFFFF)):
        counts: dict[str, list[tuple[int, int]]] = {}
        for r in clean.where(F.col("of").isin(list(place))).groupBy("of", half.alias("half")).count().collect():  # 65,536 a language at most
            counts.setdefault(r["of"], []).append((r["half"], r["count"]))
        for k, rows in counts.items():
            for value, many in sorted(rows):
                if place[k] < many:
                    key[k] = key[k] << 16 | value
                    break
                place[k] -= many
        chosen = F.lit(False)
        for k, value in key.items():
            chosen = chosen | ((F.col("of") == k) & (F.shiftright("key", 16) == value))
        clean = clean.where(chosen)
    edges = {k: float(np.array([v if v >= 0 else v ^ 0x7FFFFFFF], np.int32).view(np.float32)[0]) for k, v in key.items()}
    score = lambda x: float(1 / (1 + np.exp(-np.clip(x * scale[0] + scale[1], -30, 30))))
    edges = {k: edges.get(k, -scale[1] / scale[0]) for k in n}
    over = F.lit(False)
    for k, edge in edges.items():
        over = over | ((F.col("of") == k) & (F.col("z").cast("double") > edge))
    above = {r["of"]: r["z"] for r in each.where((F.col("toxic") == 1) & over).groupBy("of").agg(F.min("z").alias("z")).collect()}
    return {k: min(0.95, max(0.3, (score(edge) + (score(above[k]) if k in above else 1)) / 2)) for k, edge in edges.items()}


def fit(docs: DataFrame, labels: DataFrame, of: Column | None = None) -> Model | None:
    """Fits on all labelled documents (labels: doc_id, toxic), or those that the condition on doc_id names; None if there are
    not both classes. Each epoch is a round of tasks, whose weights are averaged.

    A fifth of the documents is not learnt from: it tells which epoch's weights to take, and calibrates. If either part would lack a
    class, all documents are learnt from and calibrate, and the last epoch's weights are taken."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if of is not None:
        known = known.where(of)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if known.select("toxic").distinct().count() < 2:
        return None
    keep, spark = Scratch(docs.sparkSession), docs.sparkSession
    h, lang = F.xxhash64("doc_id", "text"), F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", h.alias("h"), lang.alias("lang"), text_column().alias("text"))
    rows = rows.join(if_small(known), F.col("doc_id") == F.col("_id")).select("h", "lang", "toxic", (F.pmod("h", F.lit(5)) == 0).alias("aside"), "text")
    rows = keep.save(rows.repartition(partitions(spark)), "labelled")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return None
    classes = rows.select("aside", "toxic").distinct().count()
    if classes < 4:
        rows = rows.withColumn("aside", F.lit(False))
    rows = rows.coalesce(-(-max(1, size) // LEARN_BYTES))
    state = trained(rows, keep)
    judged = _judged(rows.where("aside") if classes == 4 else rows, state, keep, "judged")
    model = calibrated(_model(state), judged)
    keep.drop("labelled", "judged")
    return model


def _logits_of(model: Model, texts: list[np.ndarray], pick: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in pick])])
    return pooled(model, np.concatenate([texts[i] for i in pick], axis=1), first) @ model.weight + model.offset


def _scores(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model is None:
        return np.zeros(len(offsets) - 1)
    parts = [logits(model, Words(data, offsets[lo : hi + 1], PUNCT)) for lo, hi in chunks(offsets, 1 << 20)]
    z = np.concatenate(parts) if parts else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) * model.scale[0] + model.scale[1], -30, 30)))


def _threshold(model: Model | None, lang: str | None) -> float:
    return 2.0 if model is None else model.thresholds.get(lang or "", model.thresholds[""])


def _marked(docs: DataFrame, model: Model | None, names: list[str]) -> DataFrame:
    """The named columns, with score and threshold."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # the size of a model is fixed
    text, lang = fresh(docs, "_text", "_lang")
    rows = docs.withColumns({text: text_column(), lang: F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(shared.value, *utf8(column(batch, text)))
            edge = [_threshold(shared.value, x) for x in column(batch, lang).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(score), pa.array(edge, pa.float64())], names=[*names, "score", "threshold"])

    schema = docs.select(names).withColumns({"score": F.lit(0.0), "threshold": F.lit(0.0)}).schema
    return rows.select(*names, *({text, lang} - set(names))).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier), threshold (of the row's language) for each row of docs.

    Null texts are empty; a text without words gets the score of no evidence. The whole text counts, however long; only
    the threshold looks at lang. Without a model (no labels of both classes) scores are 0 and nothing passes a threshold.
    """
    return _marked(docs, model, ["doc_id"])


def reject(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without the rows whose score reaches their language's threshold. Rows are decided where they are read."""
    names = [c for c in docs.columns if c not in ("score", "threshold")]
    clash = [c for c in docs.columns if c in ("score", "threshold")]
    if clash:
        renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
        return reject(renamed, model).withColumnsRenamed({f"_own_{c}": c for c in clash}).select(docs.columns)
    return _marked(docs, model, names).where("score < threshold").select(names)


def bucket(of: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(of.cast("string"), F.lit("")).cast("binary")) % n
