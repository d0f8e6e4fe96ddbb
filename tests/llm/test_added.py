"""Spelling variants, collocations and packing against brute force, and their odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import collocations, licenses, packing, variants

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(None, None, None), (7, None, "en"), (8, "", "en"), (8, " \t\n", None), (None, "...", "de")]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["word", "n", "phrase", "a", "l", "score", "rank", "start", "offset", "prompt", "key", "id"])})


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# ---------------------------------------------------------------- spelling variants


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_variants(rows, often, every):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_variants(spark):
    r = random.Random(4)
    base = ["receive", "separate", "Straße", "égalité", "×weird÷", "aaaaaa", "ababab", "longer" * 40]
    words = []
    for k, w in enumerate(base):
        words += [w] * 64
        for _ in range(6):  # chains: each variant is rarer than what it is made of
            at = r.randrange(len(w))
            w = w[:at] + r.choice(["", "e", "ê", w[at] + "x"]) + w[at + 1 :]
            words += [w] * r.choice([1, 3, 7, 15, 31])
    rows = [(i, ", ".join(r.sample(words, 120)), "en") for i in range(20)] + [(3, "Receive RECEIVE recieve", None)] * 3 + ODD
    got = sorted(tuple(x) for x in variants.group(documents(spark, rows), often=2, every=5).collect())
    want = brute_variants(rows, 2, 5)
    assert got == want and sum(x[1] is not None for x in want) > 10 and any(x[2] not in (x[0], x[1]) for x in want)
    assert variants.group(documents(spark, ODD)).collect() == [] and variants.group(documents(spark, [])).collect() == []


def test_neighbourhoods():
    r = random.Random(1)
    key = lambda s: sum(x * pow(variants._B, i, 1 << 64) for i, x in enumerate(s)) % (1 << 64)
    for length in (1, 5, 9):
        s = [r.randrange(1, variants.SYMBOLS + 1) for _ in range(length)]
        every = range(1, variants.SYMBOLS + 1)
        want = {key(s[:i] + s[i + 1 :]) for i in range(length)} | {key(s[:i] + [x] + s[i + 1 :]) for i in range(length) for x in every}
        want |= {key(s[:i] + [x] + s[i:]) for i in range(length + 1) for x in every}
        own, near = variants.neighbourhoods(np.array([s], np.uint64))
        assert set(near[0].tolist()) == want and own[0] == key(s)


# ---------------------------------------------------------------- collocations


def brute_phrases(rows, most, often, inside):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= often}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(2)) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(rows[:most])]
    return sorted(out)


@pytest.mark.parametrize("most, depth", [(5, 1), (40, 2), (10_000, 1)])
def test_collocations(spark, most, depth):
    r = random.Random(9)
    fixed = ["New York city", "of the", "État état", "a b a", "machine learning model"]
    rows = []
    for i in range(60):
        parts = [r.choice(fixed) if r.random() < 0.3 else f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(150)]
        rows.append((i, "".join(p + r.choice([" ", " ", "  ", "\t", ", ", ".\n", " "]) for p in parts), r.choice(["en", "de", None, "und"])))
    rows += ODD + [rows[0]] * 3
    got = sorted(tuple(x) for x in collocations.mine(documents(spark, rows), most, 4, depth=depth).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, most, 4, 50) and len(got) > 10
    if most == 5:  # nothing, blank rows, and a table without languages
        assert collocations.mine(documents(spark, ODD)).collect() == [] == collocations.mine(documents(spark, [])).collect()
        assert {x["lang"] for x in collocations.mine(documents(spark, rows).drop("lang"), 5, 4).collect()} == {"und"}


def test_scores_past_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 10**12 + 7, 3 * 10**12)], "a long, l long, r long")
    assert rows.select(collocations._score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * 10**24 // ((10**12 + 7) * 3 * 10**12)


# ---------------------------------------------------------------- packing


def checked(rows, got, limits, examples):
    """Every id in one piece, sequences without gaps and within the limits; returns padding and tokens. examples: by row (id, prompt, text)."""
    tokenizer = Tokenizer.from_file(PATH)
    encode = lambda x: tokenizer.encode(x or "", add_special_tokens=False).ids
    want, there = Counter(), Counter()
    prompts = {}
    for i, prompt, text in examples:
        own = np.array([*encode(prompt), *encode(text), 2], "<u4")
        prompts[i] = len(encode(prompt))
        want.update((i, int(k)) for k in range(len(own)))
        for x in (x for x in got if x["doc_id"] == i and x["doc_tokens"] == len(own)):
            if zlib.crc32(own[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"]:
                there[(i, x["start"], x["length"], x["sequence_id"], x["offset"])] += 1
    assert sum(there.values()) >= len(got)  # rows that repeat an id may match twice
    have = Counter((x["doc_id"], k) for x in got for k in range(x["start"], x["start"] + x["length"]))
    assert have == want
    sequences, padding = defaultdict(list), 0
    for x in got:
        sequences[x["sequence_id"]].append(x)
    for pieces in sequences.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at and x["length"] > 0
            at += x["length"]
        loss = sum(x["length"] - max(0, min(prompts[x["doc_id"]], x["start"] + x["length"]) - x["start"]) for x in pieces)
        assert at <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding, sum(want.values())


def test_packing(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["Some", "words here", "État's", "12345", "<|endoftext|>", "<|ENDOFTEXT|>", "don't,", "ẞ́x", "你好"]) for _ in range(n))
    rows = [(i, text(int(r.paretovariate(0.6) * 8) % 3000), "en") for i in range(90)] + [(200, text(30_000), None)] + ODD + [(3, None, "x"), (4, "one more", "y")]
    limits = packing.Limits(512, 16, 512)
    got = packing.pack(documents(spark, rows).repartition(2), PATH, limits).collect()
    padding, total = checked(rows, got, limits, [(i, None, t) for i, t, _ in rows])
    assert padding <= 0.02 * total
    assert packing.pack(documents(spark, []), PATH).collect() == []
    assert [tuple(x) for x in packing.pack(documents(spark, [(None, None, None)]), PATH).select("doc_id", "start", "length", "doc_tokens", "offset").collect()] == [(None, 0, 1, 1, 0)]


def test_packing_instructions(spark):
    """Prompts bear no loss; the limit on loss and the one on segments bind."""
    r = random.Random(5)
    rows = [(i, " ".join(["answer"] * r.randrange(60)), " ".join(["question"] * r.randrange(90))) for i in range(120)] + [(500, "word " * 900, "ask " * 700), (501, None, None), (502, "", "ask " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, asked string").coalesce(1)
    for limits in (packing.Limits(256, 8, 96), packing.Limits(256, 2, 256), packing.Limits(64, 64, 8)):
        got = packing.pack(df, PATH, limits, "asked").collect()
        padding, total = checked(rows, got, limits, [(i, p, t) for i, t, p in rows])
        assert padding <= 0.05 * total


def test_dot_product_heuristic():
    """Sequence by sequence, as a plain loop over the examples chooses."""
    r = random.Random(2)
    limits = packing.Limits(100, 6, 60)
    sizes = [(r.randrange(1, 60), 0) for _ in range(80)]
    prompts = {i: r.randrange(n + 1) for i, (n, _) in enumerate(sizes)}
    pieces = [packing.Piece(i, 0, n) for i, (n, _) in enumerate(sizes)]
    packer = packing.Packer(limits)
    done = packer.pack(pieces, prompts)
    left, want = {p.row: packer.demand(p, prompts[p.row]) for p in pieces}, []
    room = list(limits)
    while True:
        fits = [(sum(x * y / z**2 for x, y, z in zip(d, room, limits)), d, -i) for i, d in left.items() if all(x <= y for x, y in zip(d, room))]
        if not fits:
            break
        i = -max(fits)[2]
        want.append((i, left[i]))
        room = [x - y for x, y in zip(room, left.pop(i))]
    first = [packer.demand(p, prompts[p.row]) for s in done for p in s][: len(want)]
    assert sum(x[0] for x in first) == sum(x[1][0] for x in want) and first == [d for _, d in want]


def test_ids_from_words(monkeypatch):
    """Texts of any characters, as the tokenizer itself has them; also with a memory that begins anew again and again."""
    r = random.Random(1)
    signs = [*"aZé ÷×İŉß0½٣.,;:!?'\"-_|<>=\u0301\u0307\u00a0\u2003\t\n”“你я", " ", " ", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "word", "Word", "İ,", "é.", "3.14", "\u0338"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)] + [" ".join(f"w{r.randrange(300)}." for _ in range(50)) for _ in range(100)]
    tokenizer = Tokenizer.from_file(PATH)
    for memory in (1 << 20, 64):
        monkeypatch.setattr(packing, "REMEMBERED", memory)
        ids = packing.Ids(PATH)
        for lo in range(0, len(texts), 20):
            some = texts[lo : lo + 20]
            raw = np.frombuffer("".join(some).encode(), np.uint8)
            got, first = ids.of(raw, np.cumsum([0] + [len(t.encode()) for t in some]))
            for t, a, b in zip(some, first[:-1], first[1:]):
                assert got[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_license_sql_knows_whole_texts(spark, duck):
    """The SQL and the query agree on documents that are whole licences, among others."""
    texts = [t for _, t in licenses.whole_texts()] + [t for _, t in licenses.TEXTS] + ["Copyright (c) 2031 Somebody\n" + t for _, t in licenses.whole_texts()[:3]] + ["nothing of it", "", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = licenses.scan(documents(spark, rows)).collect()
    con = duck.cursor()
    con.execute("CREATE OR REPLACE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = con.sql(licenses.scan_sql()).fetchall()
    assert sorted((r["doc_id"], r["digest"], r["license"], r["notices"], r["notice_lines"]) for r in got) == sorted(want)
    assert sum(r["license"] is not None for r in got) >= len(texts) - 4
