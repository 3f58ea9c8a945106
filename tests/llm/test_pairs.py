"""SimHash links, benchmark overlaps and repeated strings against brute force."""

import hashlib
import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfsight.llm import simhash, suffix_dedup
from shelfsight.llm.decontaminate import BenchmarkIndex, _Coder, _overlaps, decontaminate, find_overlaps, masks
from shelfsight.llm.simhash import components, golay_keys, keep_one_of_each, links, near_duplicates


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
@settings(max_examples=200, deadline=None)
def test_linked_prints_share_a_key(value, flips):
    other = value
    for bit in flips:
        other ^= 1 << bit
    keys, _ = golay_keys(np.array([value, other], np.uint64))
    assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_codewords_are_all_within_four():
    words = np.array([0, 1, 0x7FFFFF, 0b1010101])
    low, high, patterns = simhash._golay()
    assert patterns.shape == (2048, 6)
    for w, row in zip(words.tolist(), simhash.codewords(words).tolist(), strict=True):
        for index in row:  # the codeword with this index: only it has syndrome zero
            found = [index << 11 | c for c in range(2048) if low[(index << 11 | c) & 0xFFF] ^ high[(index << 11 | c) >> 12] == 0]
            assert len(found) == 1 and (found[0] ^ w).bit_count() <= 4


def _texts(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(150)) for _ in range(6)]
    out = [None, "", " \n", "One", "one", "ONE two", "É x", "é x"]
    for b in base:
        out += [b, b, b.upper()]
        for _ in range(4):
            words = b.split()
            words[rng.randrange(len(words))] = "edit"
            out.append(" ".join(words))
    return out


def test_near_duplicates_equal_brute_force(rows):
    texts = _texts()
    df = rows("doc_id long, text string, fingerprint int", *[(10 + i, t, 0) for i, t in enumerate(texts)])
    prints = [_fingerprint(t) for t in texts]
    want = {10 + i: (f"{p:016x}", 10 + g) for i, (p, g) in enumerate(zip(prints, _groups(prints), strict=True))}
    for block in (4096, 2):  # the second cuts every larger bucket into pieces
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(df, block=block).collect()}
        assert got == want
    stay = keep_one_of_each(df)
    assert stay.columns == df.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted({g for _, g in want.values()})


def test_near_duplicates_with_null_and_repeated_ids(rows):
    df = rows("doc_id long, text string", (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "other words stand here now"))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in keep_one_of_each(df).collect()) == ["3", "None"]
    assert near_duplicates(df.filter("false")).count() == 0


def test_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    while len(prints) < 60:
        value = centre
        for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            value ^= 1 << int(bit)
        prints.add(value)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    want = _groups(prints)
    for block in (4096, 8):
        root = {r["node"]: r["root"] for r in components(links(df, block=block)).collect()}
        got = [root.get(x, x) for x in signed]
        pairs = [(got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(len(prints)), 2)]
        assert all(pairs)


def test_components_of_a_long_chain(rows):
    df = rows("a long, b long", *[(i, i + 1) for i in range(200)], (500, 501), (501, 500), (7, 7))
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[501] == 500


def _norm(text):
    return [w for w in ("".join(c for c in t if c.isalnum()) for t in (text or "").lower().split()) if w]


def _leaks(text, item, window=12, share=0.8, shortest=8):
    a, b = _norm(text), _norm(item)
    if len(b) < shortest:
        return False
    w = min(window, len(b))
    return any(
        sum(x == y for x, y in zip(a[i: i + w], b[j: j + w], strict=True)) >= share * w - 1e-9
        for i in range(len(a) - w + 1) for j in range(len(b) - w + 1)
    )


def test_masks_cover_every_choice_of_substitutions():
    for span, k in ((12, 2), (8, 1), (10, 2), (9, 1), (5, 0)):
        for hit in combinations(range(span), k):
            assert any(not set(hit) & set(m) for m in masks(span, k)), (span, hit)


def test_overlaps_equal_brute_force(rows):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (8, 9, 12, 20, 30, 30)] + ["too short", None, ""]
    texts: list = [None, "", "w1", "w1 " * 200]
    for _ in range(60):
        words = [rng.choice([*vocab, "zz", "--"]) for _ in range(rng.randrange(5, 60))]
        source = rng.choice(items[:6]).split()
        piece = source[rng.randrange(len(source)):][: rng.randrange(1, 25)]
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = rng.choice(["Sub!", vocab[0].upper() + ","])
        at = rng.randrange(len(words))
        texts.append(" ".join(words[:at] + piece + words[at:]))
    df = rows("doc_id int, text string, overlaps int", *[(i, t, 1) for i, t in enumerate(texts)])
    bench = rows("item_id int, text string", *enumerate(items), (2, items[2]))
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if _leaks(t, x)}
    assert want
    for block_words in (200_000, 40):  # the second takes several passes
        found = find_overlaps(df, bench, block_words=block_words).collect()
        got = {(r["doc_id"], o["item"]) for r in found for o in r["overlaps"]}
        assert got == want
    for r in found:
        for o in r["overlaps"]:
            assert 0 <= o["start"] < o["end"] <= len(_norm(texts[r["doc_id"]])) and o["words"] <= o["end"] - o["start"]
    kept = decontaminate(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate(df, bench.filter("false")).count() == len(texts)
    assert decontaminate(df.filter("false"), bench).count() == 0


def _removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    often = Counter(x[i: i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if often[x[i: i + length]] > 1:
                gone[i: i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


def _repeat_texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    exact, one_less = shared.encode()[:200].decode(errors="ignore"), shared.encode()[:199].decode(errors="ignore")
    texts = [None, "", "x", "a" * 199, "a" * 200, "b" * 201, "c" * 700, "ab" * 150, shared, shared, shared + prose(3)]
    texts += [prose(n) + " " + shared[: rng.randrange(150, len(shared))] + " " + prose(9) for n in range(0, 40, 3)]
    texts += [prose(5) + exact + "!", prose(11) + exact + "?", prose(7) + one_less + "#", prose(40) + " " + shared + shared + prose(8)]
    return texts


def test_repeats_equal_brute_force(rows, monkeypatch):
    texts = _repeat_texts()
    want = {i: x for i, x in enumerate(_removed(texts, 200))}
    assert 0 < sum(x[1] for x in want.values()) < sum(x[0] for x in want.values())
    df = rows("doc_id int, text string, n_bytes string", *[(i, t, "clash") for i, t in enumerate(texts)])
    for parts in (1, 3):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500 * parts)
        got = suffix_dedup.remove_repeats(df.repartition(parts), keep_text=True).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
        assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix_dedup.remove_repeats(df.filter("false")).count() == 0


def test_repeats_around_a_hot_passage(rows, monkeypatch):
    """One passage in many contexts: no bucket of pieces holds them all, and results equal brute force."""
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(230)
    texts = [prose(150) + passage + prose(150) for _ in range(60)] + _repeat_texts()
    want = dict(enumerate(_removed(texts, 200)))
    df = rows("doc_id int, text string", *enumerate(texts))
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2000)
    named, real = [], suffix_dedup._hot_anchors
    monkeypatch.setattr(suffix_dedup, "_hot_anchors", lambda m, most: named.append((m, real(m, most))) or named[-1][1])
    got = suffix_dedup.remove_repeats(df.repartition(3)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    pieces, hot = named[0]
    assert len(hot)
    sent = lambda m: max(r["n"] for r in m.filter("kind = 1").groupBy("bucket").agg(F.sum(F.length("data")).alias("n")).collect())
    rest = pieces.mapInArrow(suffix_dedup._name_hot(200, 64, hot), suffix_dedup.MESSAGE)
    assert sent(rest) < sent(pieces) / 2


def test_names_in_slices_equal_names_of_the_whole(monkeypatch):
    data = np.frombuffer(random.Random(4).randbytes(5000), np.uint8)
    starts = np.flatnonzero(np.arange(4801) % 7 != 3)
    whole, anchors = suffix_dedup.names(data, 200), suffix_dedup._smallest(suffix_dedup.names(data, 16), 185)
    for size in (1, 64, 999, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", size)
        assert (suffix_dedup.names_at(data, starts, 200) == whole[starts]).all()
        assert (suffix_dedup.anchors_at(data, starts, 200) == anchors[starts]).all()


def test_repeats_in_a_text_of_several_blocks(rows):
    """Far longer than a block, with one repeat inside itself and one in another document."""
    rng = random.Random(6)
    text = rng.randbytes(6 << 20).hex()
    long = text[:5_000_000] + text[100:400] + text[5_000_000:]
    got = suffix_dedup.remove_repeats(rows("doc_id int, text string", (1, long), (2, "x" + text[9_000_000:9_000_500]), (3, None))).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {1: (len(long), 1100, 3), 2: (501, 500, 1), 3: (0, 0, 0)}


def test_cover_has_every_difference_once():
    found = Counter((a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER if a != b)
    assert found == Counter(range(1, suffix_dedup.MODULUS))


def _overlaps_by_loops(text, items, window=12, share=0.8, shortest=8):
    """item: (words, start, end, item_words, item_share, best), every window with every window."""
    plain = lambda x: [w for w in ("".join(c for c in t if c.isalnum()) for t in (x or "").lower().split()) if w]
    words, out = plain(text), {}
    for item, body in items:
        asked = plain(body)
        span = min(window, len(asked))
        if len(asked) < shortest:
            continue
        own, theirs, best = set(), set(), 0.0
        for a in range(len(words) - span + 1):
            for b in range(len(asked) - span + 1):
                same = sum(x == y for x, y in zip(words[a: a + span], asked[b: b + span], strict=True))
                if same >= share * span - 1e-9:
                    own |= set(range(a, a + span))
                    theirs |= set(range(b, b + span))
                    best = max(best, same / span)
        if own:
            out[item] = (len(own), min(own), max(own) + 1, len(theirs), len(theirs) / len(asked), best)
    return out


def test_places_and_shares_equal_loops_with_repeated_words(rows):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(25)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(4, 30)))) for i in range(25)] + [(30, "go " * 20), (31, "a b " * 12), (32, "go " * 20), (33, None)]
    texts = [None, "", "go " * 40, "x " + "a b " * 20 + "c", "go go go"]
    for _ in range(40):
        words = say(rng.randrange(0, 40))
        words[5:5] = [w if rng.random() > 0.1 else "Zz!" for w in (rng.choice(items[:-1])[1]).split()]
        texts.append(" ".join(words))
    found = find_overlaps(rows("doc_id int, text string, overlaps int", *[(i, t, 0) for i, t in enumerate(texts)]), rows("item_id int, text string", *items))
    for r in found.collect():
        got = {o["item"]: (o["words"], o["start"], o["end"], o["item_words"], o["item_share"], o["best"]) for o in r["overlaps"]}
        assert got == _overlaps_by_loops(texts[r["doc_id"]], items), texts[r["doc_id"]]


def test_very_repetitive_texts_are_searched_in_linear_time(rows):
    started = time.monotonic()
    index = BenchmarkIndex([(1, "same " * 600), (2, "x y " * 300)], 12, 0.8, 8)
    found = _overlaps(index, _Coder(index.words), ["same " * 20_000, "x y " * 20_000])
    assert time.monotonic() - started < 5
    assert [[(o["item"], o["words"], o["item_words"]) for o in x] for x in found] == [[(0, 20_000, 600)], [(1, 40_000, 600)]]


def test_messages_grow_with_the_blocks_and_not_with_their_square(rows, monkeypatch):
    """A block sends a message per bucket, and buckets hold many blocks; all shares of a bucket are sorted apart."""
    texts = _repeat_texts() * 3
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    sent, real = [], suffix_dedup._hot_anchors
    monkeypatch.setattr(suffix_dedup, "_hot_anchors", lambda m, most: sent.append(m) or real(m, most))
    got = suffix_dedup.remove_repeats(rows("doc_id int, text string", *enumerate(texts)).repartition(2)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(_removed(texts, 200)))
    numbers = [r["bucket"] for r in sent[0].filter("kind = 1").select("bucket").distinct().collect()]
    assert numbers and max(numbers) < suffix_dedup.LEAST_BUCKETS < sum(len((t or "").encode()) for t in texts) / 300
    own = np.unique(np.frombuffer(random.Random(1).randbytes(80_000), np.uint64))
    packed = dict(suffix_dedup._pack_names(own, 5))
    back = [suffix_dedup._unpack_names(packed[b]) for b in range(5)]
    assert [len(np.unique(x)) for x in back] == [int((suffix_dedup._bucket(own, 5) == b).sum()) for b in range(5)]
