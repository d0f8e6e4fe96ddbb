"""Packing examples into training sequences: vector bin packing by the dot-product heuristic.

An example asks for tokens, segments and loss-bearing tokens, and a sequence has a limit on each. The open sequence takes, of
the examples that still fit, the one whose demands have the largest dot product with what is left of the limits (Panigrahy
et al., "Heuristics for Vector Bin Packing", 2011). What no example fills is filled by a piece of one. Examples are packed
where they are read, in blocks of bounded size, and open sequences are carried from block to block, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import SPACES, Words, chunks, column, text_column, utf8

#: Id that ends each example.
END = 2
#: A sequence may end so many tokens short of the limit before an example is cut to fill it.
SLACK = 8
#: Tokens of a block that is packed at once, and examples.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 21, 1 << 14
#: Different words whose ids a Python worker remembers, about.
REMEMBERED = 1 << 20


class Limits(NamedTuple):
    """Of a sequence: tokens, segments (pieces) and loss-bearing tokens."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


class Piece(NamedTuple):
    """Tokens start to start + length of the example `row`."""

    row: int
    start: int
    length: int


# ---------------------------------------------------------------- ids


_ALNUM, _MARK, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*b".,;:!?"]] = True
_SPACE[[*SPACES]] = True


def breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks where runs of . , ; : ! ? begin and end that stand between letters, digits or spaces: the tokenizer cuts there, too, so
    words are known apart from their punctuation. Letters: A-Z, a-z, and U+00C0 to U+024F without three that aren't, or that
    lower case takes apart."""
    n = len(data)
    lead = (data >= 0xC3) & (data <= 0xC9)
    odd = np.zeros(n, bool)
    odd[1:] = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    ends = _ALNUM[data] | _SPACE[data]
    ends[1:] |= lead[:-1] & ~odd[1:]
    begins = _ALNUM[data] | _SPACE[data] | lead
    begins[:-1] &= ~odd[1:]
    edge = np.zeros(n + 1, bool)
    edge[offsets - offsets[0]] = True
    mark, out = _MARK[data], np.zeros(n + 1, bool)
    start = np.flatnonzero(mark & (np.concatenate([[True], ~mark[:-1]]) | edge[:-1])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(mark & (np.concatenate([~mark[1:], [True]]) | edge[1:])) + 1 if n else start
    good = (edge[start] | ends[start - 1]) & (edge[end] | begins[np.minimum(end, n - 1)])
    out[start[good]] = out[end[good]] = True
    return out


class _Known(NamedTuple):
    """Words' hashes in order, their ids, and where each word's begin."""

    hash: np.ndarray = np.zeros(0, np.uint64)
    ids: np.ndarray = np.zeros(0, np.uint32)
    first: np.ndarray = np.zeros(1, np.int64)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place; -1 if it isn't there."""
        at = np.searchsorted(self.hash, hashes)
        there = at < len(self.hash)
        there[there] = self.hash[at[there]] == hashes[there]
        return np.where(there, at, -1)

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places one after another, and each word's first."""
        start, size = self.first[places], self.first[places + 1] - self.first[places]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends

    def more(self, other: _Known) -> _Known:
        both = _Known(np.concatenate([self.hash, other.hash]), np.concatenate([self.ids, other.ids]), np.concatenate([self.first, self.first[-1] + other.first[1:]]))
        order = np.argsort(both.hash, kind="stable")
        return _Known(both.hash[order], *both.of(order))


class Ids:
    """Ids of texts by a tokenizer that never joins what white space separates, and takes letters in lower case: each different
    word is tokenized once, as far as memory goes, and a text's ids are put together from its words'."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.old, self.new = _Known(), _Known()

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, size = [], np.zeros(len(words), np.int64)
        for lo in range(0, len(words), 2000):
            found = self.tokenizer.encode(words[lo : lo + 2000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            size[lo : lo + 2000] += np.bincount(np.array(found.word_ids, np.int64), minlength=min(2000, len(words) - lo))
        self.new = self.new.more(_Known(hashes, np.concatenate(ids), np.concatenate([[0], np.cumsum(size)])))

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after another, and each text's first."""
        part = data[offsets[0] : offsets[-1]]
        special = part.tobytes().find(b"<|") >= 0  # the tokenizer's own strings count only in lower case
        w = Words(data, offsets, SPACES, fold=not special, breaks=breaks(part, offsets))
        different, first, same = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.new.hash) > REMEMBERED // 16:
            self.old, self.new = (self.old.more(self.new) if len(self.old.hash) < REMEMBERED else self.new), _Known()
        old, new = self.old.place(different), self.new.place(different)
        fresh = (old < 0) & (new < 0)
        if fresh.any():
            self._learn(different[fresh], [w.bytes[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace") for i in first[fresh].tolist()])
            new = self.new.place(different)
        mine = self.old.of(old[old >= 0])
        added = self.new.of(new[old < 0])
        # both parts' ids side by side; a word's are in the part that knows it
        ids, start = np.concatenate([mine[0], added[0]]), np.empty(len(different), np.int64)
        size = np.empty(len(different), np.int64)
        start[old >= 0], size[old >= 0] = mine[1][:-1], np.diff(mine[1])
        start[old < 0], size[old < 0] = len(mine[0]) + added[1][:-1], np.diff(added[1])
        ends = np.concatenate([[0], np.cumsum(size[same])])
        return ids[np.repeat(start[same] - ends[:-1], size[same]) + np.arange(ends[-1])], ends[w.first]


@functools.cache
def ids_by(path: str) -> Ids:
    """A Python worker's next tasks go on with the words that it knows."""
    return Ids(path)


# ---------------------------------------------------------------- packing


class Packer:
    """Packs examples block by block. Each call gives the sequences that are complete; `rest` at the end gives the others."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = 1 / np.array(limits, float)
        self.open: list[Piece] = []

    def demand(self, piece: Piece, prompt: int) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens: all but the example's first `prompt` tokens bear loss."""
        return piece.length, 1, piece.length - max(0, min(piece.start + piece.length, prompt) - piece.start)

    def cut(self, piece: Piece, prompt: int, tokens: int, loss: int) -> tuple[Piece | None, Piece | None]:
        """The longest beginning of the piece within the limits, and what is left."""
        free = max(0, min(prompt - piece.start, piece.length))  # the tokens without loss come first
        n = min(piece.length, tokens, free + loss)
        head = Piece(piece.row, piece.start, n) if n > 0 else None
        tail = Piece(piece.row, piece.start + n, piece.length - n) if n < piece.length else None
        return head, tail

    def pack(self, pieces: list[Piece], prompts: dict[int, int], last: bool = False) -> list[list[Piece]]:
        """Complete sequences of these pieces and those left open before. prompts: by row, tokens at the beginning without loss."""
        done: list[list[Piece]] = []
        # pieces of one demand are alike: the heuristic chooses among the different demands
        waiting: dict[tuple[int, int, int], list[Piece]] = {}
        for p in reversed(self.open + pieces):
            waiting.setdefault(self.demand(p, prompts[p.row]), []).append(p)
        kinds = sorted(waiting, reverse=True)
        table = np.zeros((2 * len(kinds) + 64, 3))
        table[: len(kinds)] = kinds
        alive = np.zeros(len(table), bool)
        alive[: len(kinds)] = True
        places = {k: i for i, k in enumerate(kinds)}
        used, total = len(kinds), sum(len(v) for v in waiting.values())

        def take(i: int) -> Piece:
            nonlocal total
            kind = tuple(int(x) for x in table[i])
            p = waiting[kind].pop()
            alive[i], total = bool(waiting[kind]), total - 1
            return p

        def put(p: Piece) -> None:
            nonlocal table, alive, used, total
            kind, total = self.demand(p, prompts[p.row]), total + 1
            i = places.get(kind)
            if i is None:
                if used == len(table):
                    table, alive = np.concatenate([table, np.zeros_like(table)]), np.concatenate([alive, np.zeros_like(alive)])
                i = places[kind] = used
                table[i], used = kind, used + 1
            waiting.setdefault(kind, []).append(p)
            alive[i] = True

        now: list[Piece] = []
        left = np.array(self.limits, float)
        while total:
            fits = alive[:used] & (table[:used] <= left).all(axis=1)
            gain = np.where(fits, table[:used] @ (left * self.scale**2), -1.0)
            best = int(gain.argmax())
            if gain[best] >= 0:
                p = take(best)
                now.append(p)
                left -= table[best]
                continue
            if left[0] > SLACK and left[1] >= 1 and left[2] >= 1 or not now:  # nothing fits whole: a piece of the one that matches best
                gain = np.where(alive[:used], table[:used] @ (left * self.scale**2), -1.0)
                p = take(int(gain.argmax()))
                head, tail = self.cut(p, prompts[p.row], int(left[0]), int(left[2]))
                if head is None:  # a loss limit of nothing: the example can't be placed at all
                    raise ValueError("limits leave no room for a token")
                now.append(head)
                left -= self.demand(head, prompts[p.row])
                if tail:
                    put(tail)
                continue
            done += self.close(now)
            now, left = [], np.array(self.limits, float)
        if now and (last or left[0] <= SLACK):
            done += self.close(now)
            now = []
        self.open = now
        return done

    def close(self, now: list[Piece]) -> list[list[Piece]]:
        """The sequence, if it is full but for SLACK; else its pieces in sequences of powers of two, which need no padding."""
        n = sum(p.length for p in now)
        if n >= self.limits.tokens - SLACK or n & (n - 1) == 0:
            return [now]
        out, pieces = [], list(reversed(now))
        while n:
            room, one = 1 << (n.bit_length() - 1), []
            n -= room
            while room:
                p = pieces.pop()
                if p.length > room:
                    pieces.append(Piece(p.row, p.start + room, p.length - room))
                    p = Piece(p.row, p.start, room)
                one.append(p)
                room -= p.length
            out.append(one)
        return out


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), prompt: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs' rows in the sequences.

    A row is an example: the ids of `prompt` (a column's name, if there is one), which bear no loss, and of text, then END, which
    bear loss. Null texts and prompts are empty, so such a row is END alone. Rows that repeat an id are examples of their own,
    ids may be null. start, length: the piece's place among the row's doc_tokens ids; ids_crc32: of its ids as little-endian
    unsigned 32-bit numbers; offset: its place in the sequence, without gaps from 0. Sequences keep within the limits; they are
    up to SLACK short of limits.tokens, or a power of two long. sequence_id: the task's number, times 2 ** 40, and its turn.

    tokenizer: a file of a tokenizer that takes white space as a boundary and drops it. Each task packs the rows that it reads, in
    their order, so a task that is run again packs them alike.
    """
    aside = text_column(prompt) if prompt else F.lit("")
    rows = docs.select("doc_id", text_column().alias("text"), aside.alias("prompt"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = ids_by(tokenizer), Packer(limits)
        base, turn, row = TaskContext.get().partitionId() << 40, 0, 0
        # by row: id, tokens, prompt's tokens; the tokens' numbers; pieces still to come
        held: dict[int, tuple[pa.Scalar, np.ndarray, int]] = {}

        def given(done: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal turn
            out = [[] for _ in range(7)]
            for sequence in done:
                at = 0
                for p in sequence:
                    id_, ids, _ = held[p.row]
                    crc = zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes())
                    for c, v in zip(out, (id_, p.start, p.length, crc, len(ids), base + turn, at), strict=True):
                        c.append(v)
                    at += p.length
                turn += 1
            of = {p.row for p in packer.open}
            for r in [r for r in held if r not in of]:
                del held[r]
            kinds = [id_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        waiting, tokens, id_type = [], 0, pa.int64()
        for batch in batches:
            names, id_type = column(batch, "doc_id").to_pylist(), column(batch, "doc_id").type
            texts, prompts = utf8(column(batch, "text")), utf8(column(batch, "prompt"))
            for lo, hi in chunks(texts[1] + prompts[1]):
                ids, first = ids_of.of(texts[0], texts[1][lo : hi + 1])
                asked, asked_first = ids_of.of(prompts[0], prompts[1][lo : hi + 1])
                for i in range(hi - lo):
                    own = np.concatenate([asked[asked_first[i] : asked_first[i + 1]], ids[first[i] : first[i + 1]], [END]]).astype(np.uint32)
                    held[row] = (names[lo + i], own, int(asked_first[i + 1] - asked_first[i]))
                    waiting.append(Piece(row, 0, len(own)))
                    tokens, row = tokens + len(own), row + 1
                    if tokens >= BLOCK_TOKENS or len(waiting) >= BLOCK_ROWS:
                        yield given(packer.pack(waiting, {r: x[2] for r, x in held.items()}))
                        waiting, tokens = [], 0
        if waiting or packer.open:
            yield given(packer.pack(waiting, {r: x[2] for r, x in held.items()}, last=True))

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
