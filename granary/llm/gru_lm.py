"""Scoring by a gated recurrent language model with a class-factored output.

The most frequent tokens are the model's vocabulary, in classes of equal number by frequency; all others are one more
entry, whose probability is shared among them by their smoothed counts, so the model is a distribution over all tokens.
The network is trained by truncated backpropagation in numpy. All training documents are dealt by hash to a few rounds; in
each, every task goes on from one network over all of the round's documents that it holds, and the results are averaged.
Scoring carries the state across windows from a document's start to its end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, Words, chunks, column, signed, text_column, utf8

CLASSES, CLASS_SIZE, EMBED, HIDDEN = 64, 64, 32, 32
VOCABULARY = CLASSES * CLASS_SIZE
#: Steps of a window, and documents side by side.
STEPS, LANES, TRAIN_LANES = 32, 512, 192
#: Rounds of training: up to which sixteenth of the documents each goes, and its rate. Together they have every document once.
ROUNDS = ((1, 6e-3), (4, 4e-3), (16, 2e-3))
#: Tokens whose counts every task holds; counts of rarer ones join by hash. 16 bytes each.
HEAD = 1 << 18
#: Tokens that a step of training sums up at least: windows in which few lanes are left wait for others.
STEP_TOKENS = 2048
#: Words that a task scores, or learns from, side by side, about: with few, most lanes would end long before the longest document.
BLOCK_WORDS, LEARN_WORDS = 1 << 22, 1 << 22
#: Rows whose logits are held at once.
ROWS = 4096
#: Weights that a step changes at once: they and their moments stay in a cache.
STEP_SIZE = 1 << 14
#: Bytes of text that are hashed at once, about: few enough for a cache.
STEP_BYTES = 1 << 18
#: Hash of the end token. Words hash anywhere, so it stands for a word that no text holds.
END = np.uint64(0x5EEDE0D5EEDE0D01)
END_SLOT, UNKNOWN = 0, 1


class Counts(NamedTuple):
    """hash and count of the HEAD most frequent training tokens, by the hashes' first bits and then by frequency, and of what
    the totals are."""

    hash: np.ndarray
    count: np.ndarray
    slot: np.ndarray  # place in the vocabulary, or UNKNOWN
    start: np.ndarray  # where the hashes with given first bits begin
    total: int  # all training tokens
    distinct: int

    @property
    def base(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


_TOP = 18


def head_counts(hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> Counts:
    """From tokens in order of frequency."""
    slot = np.full(len(hashes), UNKNOWN, np.int32)
    slot[hashes == END] = END_SLOT
    words = np.flatnonzero(hashes != END)[: VOCABULARY - 2]
    slot[words] = 2 + np.arange(len(words))
    top = hashes >> np.uint64(64 - _TOP)
    order = np.argsort(top, kind="stable")
    hashes = hashes[order]
    start = np.searchsorted(top[order], np.arange((1 << _TOP) + 1, dtype=np.uint64)).astype(np.int32)
    return Counts(hashes, counts[order], slot[order], start, total, distinct)


def look_up(c: Counts, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the head, or -1."""
    if not len(c.hash):
        return np.full(len(h), -1, np.int32)
    top = (h >> np.uint64(64 - _TOP)).view(np.int64)
    out = c.start.take(top)
    # most tokens are the most frequent one with their first bits; the others are looked for further on
    miss = c.hash.take(out, mode="clip") != h
    open_ = np.flatnonzero(miss)
    at, end, h = out[open_] + 1, c.start.take(top[open_] + 1), h[open_]
    out[miss] = -1
    while len(open_):
        more = np.flatnonzero(at < end)
        open_, at, end, h = open_[more], at[more], end[more], h[more]
        hit = c.hash[at] == h
        out[open_[hit]] = at[hit]
        more = np.flatnonzero(~hit)
        open_, at, end, h = open_[more], at[more] + 1, end[more], h[more]
    return out


def vocabulary(c: Counts) -> Counts:
    """The part of c that has places of its own."""
    own = c.slot != UNKNOWN
    before = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
    return c._replace(hash=c.hash[own], count=c.count[own], slot=c.slot[own], start=before[c.start])


# ---------------------------------------------------------------- the network


class Net(NamedTuple):
    embed: np.ndarray  # (VOCABULARY, EMBED)
    into: np.ndarray  # (EMBED, 3 * HIDDEN): reset, update, new
    again: np.ndarray  # (HIDDEN, 3 * HIDDEN)
    bias: np.ndarray  # (3 * HIDDEN)
    to_class: np.ndarray  # (HIDDEN, CLASSES)
    class_bias: np.ndarray
    to_word: np.ndarray  # (CLASSES, HIDDEN, CLASS_SIZE)
    word_bias: np.ndarray  # (CLASSES, CLASS_SIZE)


def fresh_net(weights: np.ndarray, seed: int = 7) -> Net:
    """weights: training counts by slot; the output starts as these frequencies."""
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    share = (weights + 0.5).reshape(CLASSES, CLASS_SIZE)
    by_class = share.sum(1)
    return Net(
        f(VOCABULARY, EMBED, s=0.1),
        f(EMBED, 3 * HIDDEN, s=EMBED**-0.5),
        f(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5),
        np.zeros(3 * HIDDEN, np.float32),
        f(HIDDEN, CLASSES, s=0.02),
        np.log(by_class / by_class.sum()).astype(np.float32),
        f(CLASSES, HIDDEN, CLASS_SIZE, s=0.02),
        np.log(share / by_class[:, None]).astype(np.float32),
    )


_ONES = np.ones(max(CLASSES, CLASS_SIZE), np.float32)


class Spare:
    """Arrays by name, that each window takes again: memory that is in a cache already."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size, have = math.prod(shape), self.held.get(name)
        if have is None or len(have) < size:
            have = self.held[name] = np.empty(size, np.float32)
        return have[:size].reshape(shape)


def _by_gate(a: np.ndarray) -> np.ndarray:
    """Weights of the gates' sums, one gate after the other: what a step does with a gate runs over unbroken memory. Those of
    reset and update are halved, as a sigmoid is (1 + tanh(half its sum)) / 2."""
    out = np.ascontiguousarray(a.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
    out[:2] *= 0.5
    return out


def input_sums(net: Net, embed: np.ndarray) -> np.ndarray:
    """What words with these embeddings add to the gates' sums: (3, words, HIDDEN)."""
    return _by_gate(embed @ net.into + net.bias)


def run_window(net: Net, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: list | None = None, table: np.ndarray | None = None, spare: Spare | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step (steps, lanes, HIDDEN), and the last. fresh: 1 where a document begins, whose state is zero.
    table: the vocabulary's input sums, if they are at hand. keep: takes what each step's slopes need."""
    steps, lanes = inputs.shape
    table, weights, spare = input_sums(net, net.embed) if table is None else table, _by_gate(net.again), spare or Spare()
    rows = 1 if keep is None else steps
    # by step: the new state's part, the gates (reset, update), and what reset lets through of the old state
    out, old, sums = spare("states", steps, lanes, HIDDEN), spare("old", rows, lanes, HIDDEN), spare("sums", 4, rows, lanes, HIDDEN)
    x, begins = spare("inputs", 3, lanes, HIDDEN), fresh.any(1)
    for t in range(steps):
        k = 0 if keep is None else t
        if begins[t]:
            state = np.multiply(state, (1 - fresh[t])[:, None], out=old[k])
        elif keep is not None:
            old[k] = state
        np.matmul(state, weights, out=sums[1:, k])
        table.take(inputs[t], 1, out=x, mode="clip")
        new, again, gates, after = sums[0, k], sums[3, k], sums[1:3, k], out[t]
        gates += x[:2]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[0], again, out=new)
        new += x[2]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((old[k], again, *gates, new))
        np.subtract(state, new, out=after)
        after *= gates[1]
        after += new
        state = after
    return out, state.copy()


def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether the exponentials of all logits can be held: states are between -1 and 1, so the weights' sums bound them."""
    return bool((np.abs(weights).sum(-2) + np.abs(bias)).max() <= 60)


def _held(logits: np.ndarray, bounded: bool) -> np.ndarray:
    """In place: rows lowered by their greatest, if any number is so large that its exponential might not be held."""
    if not bounded and logits.size and max(float(logits.max()), -float(logits.min())) > 60:
        logits -= logits.max(1, keepdims=True)
    return logits


def _by_class(cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes that have about as many members, and where these are, a row a class; len(cls) where a class has fewer."""
    order, size = np.append(np.argsort(cls.astype(np.uint8), kind="stable"), len(cls)), np.bincount(cls, minlength=CLASSES)
    largest = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[largest], size[largest]
    sizes, lo = [*size.tolist(), 0], 0
    while sizes[lo]:
        hi, place = lo + 1, np.arange(sizes[lo])
        while sizes[hi] >= 0.65 * sizes[lo]:
            hi += 1
        yield largest[lo:hi], order[np.where(place < size[lo:hi, None], start[lo:hi, None] + place, len(cls))]
        lo = hi


def log_probabilities(net: Net, states: np.ndarray, targets: np.ndarray, spare: Spare | None = None) -> np.ndarray:
    """Natural log probability of each target: its class, then the word in the class."""
    n, spare = len(targets), spare or Spare()

    def of(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, bounded: bool, out: np.ndarray) -> None:
        """Log probability of column at[i] in row i; layers side by side."""
        for lo in range(0, x.shape[1], ROWS):
            part, here = x[:, lo : lo + ROWS], at[:, lo : lo + ROWS].ravel()
            logits = np.matmul(part, weights, out=spare("logits", *part.shape[:2], weights.shape[2]))
            logits += bias[:, None]
            flat = _held(logits.reshape(len(here), -1), bounded)
            hit = flat[np.arange(len(here)), here]
            np.exp(flat, out=flat)
            hit -= np.log(flat @ _ONES[: flat.shape[1]])
            out[:, lo : lo + ROWS] = hit.reshape(len(x), -1)

    cls, word = targets // CLASS_SIZE, np.append(targets % CLASS_SIZE, 0)
    out, inside, bounded = np.empty(n, np.float32), np.empty(n + 1, np.float32), _bounded(net.to_word, net.word_bias)
    of(states[None], net.to_class[None], net.class_bias[None], cls[None], _bounded(net.to_class, net.class_bias), out[None])
    for some, at in _by_class(cls):
        hit = spare("hit", *at.shape)
        of(states.take(at, 0, out=spare("members", *at.shape, HIDDEN), mode="clip"), net.to_word[some], net.word_bias[some], word[at], bounded, hit)
        inside[at] = hit
    out += inside[:n]
    return out


def _output(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, goal: np.ndarray, share: np.ndarray, bounded: bool, spare: Spare, by_x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Softmax layers side by side (layers, rows, ...): the probability of each row's goal, and the slopes of weights and bias of
    the loss that weighs rows by share. by_x: takes those of x."""
    hits, by_weights, by_bias = np.empty(goal.shape, np.float32), np.zeros_like(weights), np.zeros_like(bias)
    back = np.ascontiguousarray(weights.transpose(0, 2, 1))
    for lo in range(0, x.shape[1], ROWS):
        part, at, w = x[:, lo : lo + ROWS], goal[:, lo : lo + ROWS].ravel(), share[:, lo : lo + ROWS].ravel()
        p = np.matmul(part, weights, out=spare("logits", *part.shape[:2], weights.shape[2]))
        p += bias[:, None]
        flat, row = p.reshape(len(at), -1), np.arange(len(at))
        np.exp(_held(flat, bounded), out=flat)
        total = flat @ _ONES[: flat.shape[1]]
        hit = flat[row, at]
        hit /= total
        hits[:, lo : lo + ROWS] = hit.reshape(len(x), -1)
        flat *= (w / total)[:, None]
        flat[row, at] -= w
        by_weights += (p.transpose(0, 2, 1) @ part).transpose(0, 2, 1)
        by_bias += np.ones(p.shape[1], np.float32) @ p
        np.matmul(p, back, out=by_x[:, lo : lo + ROWS])
    return hits, by_weights, by_bias


def _sums_by_word(rows: np.ndarray, ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of rows (3, tokens, HIDDEN) over each word's tokens; words: those in ids, in order. Very frequent words are a product
    each. The others' tokens are taken in runs of powers of two, all words' runs of one length at once."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    size = np.bincount(ids, minlength=VOCABULARY)[words]
    at, run = np.cumsum(size) - size, 1
    out = np.zeros((3, len(words), HIDDEN), np.float32)
    for k in np.flatnonzero(size * 8 > len(ids)):
        out[:, k], size[k] = (ids == words[k]).astype(np.float32) @ rows, 0
    while run <= size.max():
        some = np.flatnonzero(size & run)
        if len(some):
            part = rows.take(order[at[some][:, None] + np.arange(run)].ravel(), 1).reshape(3, len(some), run, HIDDEN)
            while part.shape[2] > 1:
                part = part[:, :, ::2] + part[:, :, 1::2]
            out[:, some] += part[:, :, 0]
            at[some] += run
        run *= 2
    return out


def gradient(net: Net, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, real: np.ndarray, state: np.ndarray, spare: Spare | None = None) -> tuple[float, Net, np.ndarray]:
    """Loss a token, its gradient through this window, and the last state. real: 1 where a token counts."""
    steps, lanes = inputs.shape
    keep: list = []
    ids, spare = inputs.ravel(), spare or Spare()
    here = np.bincount(ids, minlength=VOCABULARY) > 0
    once = np.flatnonzero(here)  # the window's words
    states, last = run_window(net, (np.cumsum(here) - 1)[inputs], fresh, state, keep, input_sums(net, net.embed[once]), spare)
    flat, goal, w = states.reshape(-1, HIDDEN), targets.ravel(), real.ravel()
    n = max(1.0, float(w.sum()))
    cls, word, share = goal // CLASS_SIZE, np.append(goal % CLASS_SIZE, 0), np.append(w / np.float32(n), np.float32(0))
    g = Net(*(np.zeros_like(a) for a in net))
    top = spare("top", len(goal), HIDDEN)
    hit, g.to_class[:], g.class_bias[:] = (a[0] for a in _output(flat[None], net.to_class[None], net.class_bias[None], cls[None], share[None, :-1], _bounded(net.to_class, net.class_bias), spare, top[None]))
    inside, d_states, bounded = np.empty(len(goal) + 1, np.float32), spare("d_states", len(goal) + 1, HIDDEN), _bounded(net.to_word, net.word_bias)
    for some, at in _by_class(cls):
        x, by_x = flat.take(at, 0, out=spare("members", *at.shape, HIDDEN), mode="clip"), spare("by_x", *at.shape, HIDDEN)
        inside[at], g.to_word[some], g.word_bias[some] = _output(x, net.to_word[some], net.word_bias[some], word[at], share[at], bounded, spare, by_x)
        d_states[at] = by_x
    d_states = d_states[:-1]
    d_states += top
    hit *= inside[:-1]
    loss = -float((np.log(hit + 1e-30) * w).sum()) / n
    d_states = d_states.reshape(steps, lanes, HIDDEN)
    # each step's slopes take the place of what they are slopes of: new, reset, update, and what reset lets through
    slopes, through = spare("sums", 4, steps, lanes, HIDDEN), spare("through", 3, lanes, HIDDEN)
    d, kept, d_new, left, begins = *spare("steps", 4, lanes, HIDDEN), fresh.any(1)
    back = np.ascontiguousarray(net.again.reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
    d[:] = 0
    for t in range(steps - 1, -1, -1):
        before, again, r, z, new = keep[t]
        d += d_states[t]
        np.multiply(d, z, out=kept)
        np.subtract(d, kept, out=d_new)
        np.multiply(new, new, out=left)
        d_new *= np.subtract(1, left, out=left)
        np.subtract(1, z, out=left)
        np.subtract(before, new, out=z)
        z *= kept
        z *= left
        new[:] = d_new
        d_new *= r
        np.subtract(1, r, out=r)
        r *= again
        r *= d_new
        again[:] = d_new
        np.matmul(slopes[1:, t], back, out=through)
        np.add(kept, through[0], out=d)
        d += through[1]
        d += through[2]
        if begins[t]:
            d *= (1 - fresh[t])[:, None]
    slopes, old = slopes.reshape(4, -1, HIDDEN), spare("old", steps * lanes, HIDDEN)
    g.again[:] = (slopes[1:].transpose(0, 2, 1) @ old).reshape(-1, HIDDEN).T
    sums = _sums_by_word(slopes[:3], ids, once)[[1, 2, 0]].transpose(1, 0, 2).reshape(-1, 3 * HIDDEN)
    g.bias[:] = np.ones(len(once), np.float32) @ sums
    g.into[:] = net.embed[once].T @ sums
    g.embed[once] = sums @ net.into.T
    return loss, g, last


def lanes_of(first: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents by lane; the longest first, each to the shortest lane so far, so that lanes end at about one time."""
    length = np.diff(first) + 1
    heap = [(0, i) for i in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-length, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (size + int(length[d]), i))
    return [x for x in out if x]


def stream(ids: np.ndarray, first: np.ndarray, lanes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows over the lanes: inputs, targets, fresh, real, and the targets' places in ids (ends: after the last word).

    A document's inputs are the end token, then its words; its targets are its words, then the end token."""
    plan = lanes_of(first, lanes)
    total = np.array([sum(int(first[d + 1] - first[d]) + 1 for d in x) for x in plan], np.int64)
    order = np.argsort(-total, kind="stable")  # so the lanes that have not ended come first
    plan, total = [plan[i] for i in order], total[order]
    docs = np.concatenate([np.array(x, np.int64) for x in plan]) if plan else np.zeros(0, np.int64)
    length = np.diff(first)[docs]
    ends = np.cumsum(length + 1) - 1
    # targets of all lanes, one after the other: a place for words, -1 - document for ends
    where = np.arange(int(total.sum())) + np.repeat(first[:-1][docs] - (ends - length), length + 1)
    where[ends] = -1 - docs
    goal = ids.take(where, mode="clip") if len(ids) else np.empty(len(where), np.int32)
    goal[ends] = END_SLOT
    begins = np.zeros(len(where), np.float32)
    begins[ends - length] = 1
    feed = np.full(len(where), END_SLOT, np.int32)
    feed[1:] = goal[:-1]
    feed[begins > 0] = END_SLOT
    offset = np.cumsum(total) - total
    for t in range(0, int(total.max(initial=0)), STEPS):
        n = int(np.searchsorted(-total, -t, "left"))
        steps = np.arange(t, min(t + STEPS, int(total[0])))[:, None]
        real = (steps < total[:n]).astype(np.float32)
        at = np.minimum(offset[:n] + steps, len(where) - 1)
        yield feed.take(at), goal.take(at), begins.take(at), real, where.take(at)


class Adam:
    def __init__(self, net: Net, rate: float):
        self.m, self.v, self.t, self.rate = [np.zeros_like(a) for a in net], [np.zeros_like(a) for a in net], 0, rate

    def step(self, net: Net, g: Net) -> None:
        """Overwrites g. The moments are held without their factors 0.1 and 0.001."""
        self.t += 1
        norm = float(np.sqrt(sum(float(np.dot(x.ravel(), x.ravel())) for x in g)))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate = np.float32(0.1 / 0.001**0.5 * self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t))
        for arrays in zip(net, g, self.m, self.v, strict=True):
            for lo in range(0, arrays[0].size, STEP_SIZE):
                a, x, m, v = (y.reshape(-1)[lo : lo + STEP_SIZE] for y in arrays)
                if clip < 1:
                    x *= clip
                m *= 0.9
                m += x
                x *= x
                v *= 0.999
                v += x
                np.sqrt(v, out=x)
                x += 1e-8 / 0.001**0.5
                np.divide(m, x, out=x)
                x *= rate
                a -= x


def gathered(blocks: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks (word ids, first word of each document), put together up to about so many words."""
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def whole() -> tuple[np.ndarray, np.ndarray]:
        out = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        ids.clear()
        counts.clear()
        return out

    for x, first in blocks:
        ids.append(x)
        counts.append(np.diff(first))
        if sum(map(len, ids)) >= most:
            yield whole()
    if ids:
        yield whole()


def learn(net: Net, blocks: Iterator[tuple[np.ndarray, np.ndarray]], rate: float) -> tuple[Net, int]:
    """Goes on training over blocks of (word ids, first word of each document); also the number of tokens."""
    net = Net(*(a.copy() for a in net))
    adam, n, held, tokens, spare = Adam(net, rate), 0, None, 0, Spare()

    def step() -> None:
        nonlocal held, tokens
        if held is not None:
            adam.step(net, held)
        held, tokens = None, 0

    for ids, first in gathered(blocks, LEARN_WORDS):
        state = None
        for feed, goal, fresh, real, _ in stream(ids, first, TRAIN_LANES):
            state = np.zeros((feed.shape[1], HIDDEN), np.float32) if state is None else state[: feed.shape[1]]
            _, g, state = gradient(net, feed, goal, fresh, real, state, spare)
            here = int(real.sum())
            if held is None:
                held = g
            else:  # the mean of both, by tokens
                for a, b in zip(held, g, strict=True):
                    a += (b - a) * np.float32(here / max(1, tokens + here))
            tokens += here
            n += here
            if tokens >= STEP_TOKENS:
                step()
    step()
    return net, n


def text_scores(net: Net, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's words, as vocabulary entries, and its end."""
    state, table, spare = None, input_sums(net, net.embed), Spare()
    scores = np.zeros(len(ids) + len(first) - 1, np.float32)  # of words, then of ends, the last document's first
    for feed, goal, fresh, real, where in stream(ids, first, LANES):
        state = np.zeros((feed.shape[1], HIDDEN), np.float32) if state is None else state[: feed.shape[1]]
        states, state = run_window(net, feed, fresh, state, None, table, spare)
        states, goal, at, use = states.reshape(-1, HIDDEN), goal.ravel(), where.ravel(), real.ravel() > 0
        if not use.all():
            states, goal, at = states[use], goal[use], at[use]
        scores[at] = log_probabilities(net, states, goal, spare)
    scores = scores.astype(np.float64)
    return scores[len(ids) :][::-1] + _sums(scores[: len(ids)], first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(values)])[first])


# ---------------------------------------------------------------- the jobs


def word_blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Parts of the batches, and their words."""
    for batch in batches:
        data, offsets = utf8(column(batch, text))
        for lo, hi in chunks(offsets, STEP_BYTES):
            yield batch.slice(lo, hi - lo), Words(data, offsets[lo : hi + 1], SPACES)


def token_counts(docs: DataFrame) -> DataFrame:
    """hash, n: how often each token is in all of docs (column text), ends included. Each task first counts what it reads
    block by block, so a frequent word is a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch, w in word_blocks(batches, "text"):
            held += [w.hash, np.full(batch.num_rows, END)]
            if sum(map(len, held)) > BLOCK_WORDS:
                yield counted()
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def slots(c: Counts, h: np.ndarray) -> np.ndarray:
    at, out = look_up(c, h), np.full(len(h), UNKNOWN, np.int32)
    found = at >= 0
    out[found] = c.slot[at[found]]
    return out


def slot_counts(c: Counts) -> np.ndarray:
    out = np.zeros(VOCABULARY)
    np.add.at(out, c.slot, c.count)
    out[UNKNOWN] += c.total - c.count.sum()
    return out


def _averaged(nets: DataFrame, keep: Scratch) -> Net | None:
    """The mean of all tasks' networks, weighted by their tokens. nets: task, part, weight, values (float32 bytes); parts
    are summed in groups of at most 64 tasks, level by level, so no group grows with the number of tasks."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.float32).astype(np.float64) * w for v, w in zip(frame["values"], frame["weight"], strict=True))
        weight = float(frame["weight"].sum())
        return pd.DataFrame({"task": [int(frame["task"].iloc[0]) // 64], "part": [frame["part"].iloc[0]], "weight": [weight], "values": [(total / weight).astype(np.float32).tobytes()]})

    most = nets.agg(F.max("task")).first()[0]
    if most is None:
        return None
    while most > 0:
        nets = nets.groupBy("part", (F.col("task") / 64).cast("long").alias("g")).applyInPandas(lambda key, f: add(f), "task long, part int, weight double, values binary")
        most //= 64
    rows = nets.orderBy("part").collect()  # one network
    return Net(*(np.frombuffer(r["values"], np.float32).reshape(s).copy() for r, s in zip(rows, _shapes(), strict=True)))


def _shapes() -> list[tuple[int, ...]]:
    return [(VOCABULARY, EMBED), (EMBED, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (3 * HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, CLASS_SIZE), (CLASSES, CLASS_SIZE)]


def train(docs: DataFrame, keep: Scratch) -> tuple[Counts, Net, DataFrame]:
    """Counts, network, and the table of all counts (hash, n), from docs (doc_id, text)."""
    spark = docs.sparkSession
    counts = keep.save(token_counts(docs), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(HEAD).toArrow()
    head = head_counts(top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy(), total, distinct)
    net, at = fresh_net(slot_counts(head)), 0
    last = ROUNDS[-1][0]
    part, tasks = F.pmod(F.xxhash64("doc_id", "text"), F.lit(last)), docs.rdd.getNumPartitions()
    for k, (end, rate) in enumerate(ROUNDS):
        # as many documents a task in a small round as in a large one: a task with few words can't keep its lanes full
        rows = docs.where((part >= at) & (part < end)).select("text").coalesce(max(1, -(-tasks * (end - at) // last)))
        net = _round(rows, head, net, rate, keep, f"nets-{k}")
        at = end
    return head, net, counts


def _round(docs: DataFrame, head: Counts, net: Net, rate: float, keep: Scratch, name: str) -> Net:
    """The mean of the networks that docs' tasks get to from net; net itself, if there are no documents."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(head), net))

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        net, n = learn(net, ((slots(known, w.hash), w.first) for _, w in word_blocks(batches, "text")), rate)
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"task": pa.array([task] * len(net), pa.int64()), "part": pa.array(range(len(net)), pa.int32()), "weight": [float(n)] * len(net), "values": pa.array([a.tobytes() for a in net], pa.binary())}
            )

    tuned = keep.save(docs.mapInArrow(tune, "task long, part int, weight double, values binary"), name)
    out = _averaged(tuned, keep) or net
    keep.drop(name)
    return out


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs; learns from the rows
    where held_out is false.

    Tokens: the text's runs of other bytes than white space (A-Z in lower case), then one end. Null texts are empty: one
    token, the end. base_score and score are log10 probabilities of the whole text. Rows that repeat are learnt and scored
    each. Tokens go by 64-bit hashes. Without training rows all tokens are unknown.
    """
    spark = docs.sparkSession
    keep = Scratch(spark)
    rows = docs.select("doc_id", text_column().alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    head, net, counts = train(rows.where(~F.col("held_out")).select("doc_id", "text"), keep)
    in_vocabulary = head.slot != UNKNOWN
    # what the unknown entry shares among all tokens that aren't in the vocabulary, unseen ones included
    rest = head.base - float((head.count[in_vocabulary] + 0.5).sum())
    shared = spark.sparkContext.broadcast((head, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, net = shared.value
        logs = np.log10(head.count + 0.5)
        end_at = int(look_up(head, np.array([END]))[0])
        end_log, end_known = (logs[end_at], 1) if end_at >= 0 else (np.log10(0.5), 0)
        row = TaskContext.get().partitionId() << 40
        waiting: list[tuple[dict, np.ndarray, np.ndarray]] = []

        def finished() -> Iterator[pa.RecordBatch]:
            firsts, base = [np.zeros(1, np.int64)], 0
            for _, slot, first in waiting:
                firsts.append(first[1:] + base)
                base += len(slot)
            model = text_scores(net, np.concatenate([x for _, x, _ in waiting]), np.concatenate(firsts)) / np.log(10)
            at = 0
            for columns, _, first in waiting:
                columns["model"] = pa.array(model[at : at + len(first) - 1])
                at += len(first) - 1
                yield pa.RecordBatch.from_pydict(columns)
            waiting.clear()

        for batch, w in word_blocks(batches, "text"):
            at = look_up(head, w.hash)
            found = at >= 0
            slot = np.where(found, head.slot[at] if len(head.slot) else UNKNOWN, UNKNOWN).astype(np.int32)
            log = np.where(found, logs[at] if len(logs) else 0.0, 0.0)
            other = slot == UNKNOWN
            # tokens whose counts aren't at hand, by document
            rare = np.flatnonzero(~found)
            doc = w.doc()[rare]
            order = np.lexsort((w.hash[rare], doc))
            h, doc = w.hash[rare][order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            places = np.flatnonzero(new)
            times = np.diff(np.append(places, len(h)))
            offsets = pa.array(np.searchsorted(doc[places], np.arange(batch.num_rows + 1)).astype(np.int32))
            n = batch.num_rows
            columns = {
                "row": pa.array(row + np.arange(n)),
                "doc_id": column(batch, "doc_id"),
                "held_out": column(batch, "held_out"),
                "n_tokens": pa.array(w.counts + 1),
                "known": pa.array(_sums(found.astype(np.float64), w.first).astype(np.int64) + end_known),
                "logs": pa.array(_sums(log, w.first) + end_log),
                "other_logs": pa.array(_sums(np.where(other, log, 0.0), w.first)),
                "others": pa.array(_sums(other.astype(np.float64), w.first).astype(np.int64)),
                "rare": pa.ListArray.from_arrays(offsets, pa.array(signed(h[places]))),
                "times": pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
            }
            row += n
            waiting.append((columns, slot, w.first))
            if sum(len(x) for _, x, _ in waiting) >= BLOCK_WORDS:
                yield from finished()
        if waiting:
            yield from finished()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, other_logs double, others long, rare array<long>, times array<long>, model double"
    scored = keep.save(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("hash"), F.col("r.times").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    rare = (
        rare.join(counts, "hash", "left")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.sum(F.col("times") * F.log10(count + 0.5)).alias("_logs"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("_known"))
    )
    out = scored.drop("rare", "times").join(rare, F.col("row") == F.col("_row"), "left")
    extra = F.coalesce("_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * float(np.log10(head.base))).alias("base_score"),
        (F.col("model") + F.col("other_logs") + extra - F.col("others") * float(np.log10(max(rest, 0.5)))).alias("score"),
    )
