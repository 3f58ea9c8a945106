"""Locally consistent parsing against a scalar version; edited texts against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from shelfsight.llm import fingerprints as module
from shelfsight.llm.fingerprints import (
    BINS, EMPTY, LEAST_LEVEL, edited, fingerprint_documents, fingerprint_edits, fingerprints, likeness, parse, phrase_starts, printed,
)

MASK = (1 << 64) - 1
STEP, ONE, TWO = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x):
    x = ((x ^ (x >> 30)) * ONE) & MASK
    x = ((x ^ (x >> 27)) * TWO) & MASK
    return x ^ (x >> 31)


def _label(symbols):
    out = list(symbols)
    for _ in range(4):
        made = []
        for i, x in enumerate(out):
            differ = x ^ out[i - 1] if i else 1
            place = (differ & -differ).bit_length() - 1
            made.append(2 * place + (x >> place & 1))
        out = made
    return out


def _print_by_hand(text):
    """One text, symbol by symbol."""
    symbols, level, best = [ord(c) for c in text], 0, [EMPTY] * BINS

    def keep(names):
        for name in names:
            h = _mix((name + STEP) & MASK)
            best[h >> 58] = min(best[h >> 58], min((h >> 32) & 0xFFFF, EMPTY - 1))

    while symbols:
        if level >= LEAST_LEVEL or len(symbols) == 1:
            keep(symbols)
        if len(symbols) == 1:
            break
        runs, i = [], 0
        while i < len(symbols):
            j = i
            while j < len(symbols) and symbols[j] == symbols[i]:
                j += 1
            named = _mix((symbols[i] * STEP + j - i) & MASK)
            runs.append(symbols[i] if j == i + 1 else named if level else named & 0xFFFFFFFF | 1 << 31)
            i = j
        labels = _label(runs)
        starts = [i for i in range(len(runs)) if i == 0 or i + 1 < len(runs) and labels[i - 1] < labels[i] > labels[i + 1]]
        symbols = [_mix(sum(_mix((runs[i] + (i - a + 1) * STEP) & MASK) for i in range(a, b)) & MASK)
                   for a, b in zip(starts, [*starts[1:], len(runs)], strict=True)]
        level += 1
    return best


def _texts(seed=3):
    rng = random.Random(seed)
    return ["", "a", "aaaa", "ab", "aab", "日本語" * 9, "é" * 500 + "x", "x\x00y"] + [
        "".join(rng.choice("abcd  \nÄ日") for _ in range(rng.randrange(1, 400))) for _ in range(40)]


def test_fingerprints_equal_the_scalar_version(monkeypatch):
    texts = _texts()
    want = [_print_by_hand(t) for t in texts]
    assert fingerprints(texts).tolist() == want
    monkeypatch.setattr(module, "SLICE", 16)
    assert fingerprints(texts[::-1]).tolist() == want[::-1]
    assert fingerprints([]).shape == (0, BINS)


def test_equal_substrings_are_cut_alike_at_any_offset():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 3000).astype(np.uint32)
    names = []
    for before in (0, 1, 17, 400):
        symbols = np.concatenate([rng.integers(97, 123, before).astype(np.uint32), shared, rng.integers(97, 123, 50).astype(np.uint32)])
        starts = np.zeros(len(symbols), bool)
        starts[0] = True
        cuts = np.flatnonzero(phrase_starts(symbols, starts)) - before
        names.append((cuts[(cuts > 8) & (cuts < 2990)].tolist(), set(parse(symbols, starts)[0].tolist())))
        sizes = np.diff(np.flatnonzero(phrase_starts(symbols, starts)))
        assert sizes.max() <= 12 and sizes[1:].min() >= 2
    assert all(cuts == names[0][0] for cuts, _ in names)
    assert all(len(names[0][1] & other) > 0.97 * len(names[0][1]) for _, other in names)


def test_likeness_follows_shared_text():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    one, two = (" ".join(word() for _ in range(3000)) for _ in range(2))
    a, b, c, d = fingerprints([one, edited(one, two), two, "x " + one])
    assert likeness(a, c) < 0.1 < 0.3 < likeness(a, b) < 0.7 and likeness(a, d) > 0.9
    empty = fingerprints([""])[0]
    assert likeness(empty, empty) == 1.0 and likeness(empty, a) == 0.0


@pytest.mark.parametrize("parts", ["1", "5"])
def test_edits_equal_plain_python(spark, rows, parts):
    rng = random.Random(2)
    data = [(i, t) for i, t in enumerate(_texts(5))] + [(77, None), (80, "long " * 60_000), (None, "no id"), (81, "same"), (82, "same")]
    rng.shuffle(data)
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0)))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprint_edits(rows("doc_id int, text string, part string, first string", *[(*d, "c", "d") for d in data])).collect()
        alone = fingerprint_edits(rows("doc_id int, text string", (4, "abcdef"))).collect()
        assert fingerprint_edits(rows("doc_id int, text string")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        new = edited(text, following)
        a, b, c = fingerprints([text, new, following])
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), printed(a), printed(b), likeness(a, b), likeness(a, c)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone[0]["near_next"] == 1.0
    plain = fingerprint_documents(rows("doc_id int, text string", *data)).collect()
    assert {(r["doc_id"], r["fingerprint"]) for r in plain} == {(w[0], w[3]) for w in want}
