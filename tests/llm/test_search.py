"""Ranked search against plain loops over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfsight.llm.ranked_search import UPPER, LOWER, WINDOW, Best, Shard, rank_documents, search_shard

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def _by_hand(docs, items, k):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    documents = sum(bool(c) for _, c in counted)
    length = sum(c.total() for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for doc, c in counted:
            size = 50 + (50 * c.total() * documents) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * size)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)}
    return out


def test_ranks_equal_plain_loops(rows):
    rng = random.Random(4)
    words = ["The", "the", "ÄPFEL", "äpfel", "x1", "日本", "a", "b", "rare", "Z"] + [f"w{i}" for i in range(30)]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(150)] + [(3, None), (None, "the the x1"), (None, "rare"), (5, ""), (7, "?!"), (9, "a " * 9000)]
    docs += docs[:20]
    items = [(i, text(12)) for i in range(12)] + [(None, "the rare Z"), (1, "日本 more"), (50, None), (51, "nowhere"), (52, "")]
    left = rows("doc_id int, text string, score string", *[(*d, "clash") for d in docs])
    right = rows("item_id long, text string, rank string", *[(*i, "clash") for i in items])
    want = _by_hand(docs, items, 10)
    for block in (50_000, 15):
        got = rank_documents(left.repartition(3), right, 10, block)
        assert {tuple(r) for r in got.collect()} == want
    assert rank_documents(left.limit(0), right).count() == 0
    assert rank_documents(left, right.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_skipping_loses_nothing(seed):
    """Long and short lists over several windows and shards, many equal scores."""
    rng = np.random.default_rng(seed)
    sizes = [3, 20, 60, 400, 2500, 4000]
    items = [np.array(sorted(rng.choice(6, rng.integers(1, 7), replace=False))) for _ in range(8)]
    best = [Best(20) for _ in items]
    everything = []
    for part in range(3):
        count = 4 * WINDOW + 77
        ids = np.sort(rng.choice(10 * count, count, replace=False)) * 3 + part
        none = np.zeros(count, bool)
        none[-2:] = True
        doc = np.concatenate([rng.choice(count, s, replace=False) for s in sizes])
        term = np.repeat(np.arange(6), sizes)
        score = rng.integers(1, 6, len(doc)) * np.repeat([40, 20, 10, 5, 2, 1], sizes)
        mixed = rng.permutation(len(doc))
        shard = Shard(ids, doc[mixed], term[mixed], score[mixed], 6)
        for terms, b in zip(items, best, strict=True):
            search_shard(shard, none, terms, b)
        everything.append((ids, none, doc, term, score))
    for terms, b in zip(items, best, strict=True):
        totals = Counter()
        for ids, none, doc, term, score in everything:
            for d, t, s in zip(doc, term, score, strict=True):
                if t in terms:
                    totals[bool(none[d]), int(ids[d])] += int(s)
        want = sorted((-s, *d) for d, s in totals.items())[:20]
        assert [(-int(s), bool(n), int(i)) for s, n, i in zip(b.score, b.none, b.ids, strict=True)] == want
