"""SimHash near-duplicates: fingerprints, Golay-code keys, links and components.

Two fingerprints link when at most four of 64 bits differ. Six blocks of bits:
four errors leave two blocks exact, and of the two halves of the other four
blocks one has at most two errors. A half has at most 22 bits; its keys are the
indices of all Golay codewords within distance four. Two words at distance two
have a word between them at distance one from both, and the codeword nearest to
that word (the code is perfect with radius three) is within four of both: the
halves share a key. So linked fingerprints share at least one (two exact blocks,
half, codeword) key, with about 160 keys of some 33 bits each.

Keys are sorted by Spark and compared in the sorted order, batch by batch. A
bucket gives the edges of a spanning forest of its links, not its pairs. Buckets
beyond ``block`` members are cut, and every pair of pieces is compared in a task
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written
from shelfsight.operators.topk import first_n

GENERATOR = 0b101011100011  # fixed value: x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code, lowest power first
BLOCKS = (11, 11, 11, 11, 10, 10)
BLOCK = 4096


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each low and high half of a 23-bit word, and per syndrome the error patterns of weight four or less.

    Systematic form: a codeword is twelve free bits (its index) above eleven
    check bits. Unused places of the pattern table repeat its first pattern.
    """
    poly = int(f"{GENERATOR:012b}"[::-1], 2)
    remainder = np.zeros(23, np.int64)
    for bit in range(23):
        r = 1 << bit
        for top in range(22, 10, -1):
            if r >> top & 1:
                r ^= poly << (top - 11)
        remainder[bit] = r
    def syndromes(bits: range) -> np.ndarray:
        out = np.zeros(1 << len(bits), np.int64)
        for i, bit in enumerate(bits):
            out[1 << i: 2 << i] = out[: 1 << i] ^ remainder[bit]
        return out
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(remainder[list(places)])) if places else 0
            found[s].append(sum(1 << p for p in places))
    patterns = np.array([x + x[:1] * (6 - len(x)) for x in found], np.int64)
    return syndromes(range(12)), syndromes(range(12, 23)), patterns


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance four of each 23-bit word, six per word, repeated where fewer."""
    low, high, patterns = _golay()
    words = words.astype(np.int64)
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[s]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """180 key places for each fingerprint (uint64), and which of them are not repeats."""
    at, blocks = 0, []
    for size in BLOCKS:
        blocks.append((prints >> np.uint64(at)) & np.uint64((1 << size) - 1))
        at += size
    blocks = [b.astype(np.int64) for b in blocks]
    keys, fresh = [], []
    for n, (i, j) in enumerate(combinations(range(6), 2)):
        rest = [k for k in range(6) if k not in (i, j)]
        exact = blocks[i] << BLOCKS[j] | blocks[j]
        for half in (0, 1):
            a, b = rest[2 * half: 2 * half + 2]
            code = codewords(blocks[a] << BLOCKS[b] | blocks[b])
            keys.append((np.int64(2 * n + half) << 34) | (exact << 12)[:, None] | code)
            new = code != code[:, :1]
            new[:, 0] = True
            fresh.append(new)
    return np.concatenate(keys, axis=1), np.concatenate(fresh, axis=1)


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """The ``keep`` columns and fingerprint (long): bit b is set if over half of the shingle hashes have it.

    Words of the whole text with A-Z lower-cased, shingles joined by one blank
    with repeats, hashed by XXH64 with seed 42. Fewer words than a shingle make
    one shingle; no words, or a null text, make fingerprint zero.
    """
    import xxhash

    def of(text: bytes | None) -> int:
        words = (text or b"").lower().split()
        if not words:
            return 0
        joined = b" ".join(words)
        n, h = len(words), xxhash.xxh64_intdigest
        if n <= shingle:
            return h(joined, 42)
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
        ends = (starts[shingle:] - 1).tolist()
        shingles = (joined[a:b] for a, b in zip(starts.tolist(), ends, strict=False))
        hashes = np.fromiter((h(x, 42) for x in shingles), np.uint64, n - shingle + 1)
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])

    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            made = np.fromiter((of(x.as_py()) for x in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(made.view(np.int64))], [*keep, "fingerprint"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "fingerprint long"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints.

    Walks from one unreached fingerprint to the next; every member meets the
    still unreached ones once, so no pairs are held.
    """
    left, edges = prints, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = _near(left, at, most)
            if hit.any():
                edges += [(int(at), int(x)) for x in left[hit]]
                front += list(left[hit])
                left = left[~hit]
    return edges


def _bucket_edges(keys: np.ndarray, prints: np.ndarray, most: int, block: int):
    """Edges among equal keys (sorted), and the rows of buckets too large for one piece."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    pairs = start[size == 2]
    pairs = pairs[_near(prints[pairs], prints[pairs + 1], most)]
    edges = [np.stack([prints[pairs], prints[pairs + 1]], axis=1)]
    large = []
    for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if n > block:
            large.append(slice(s, s + n))
        elif found := _forest(prints[s: s + n], most):
            edges.append(np.array(found, np.uint64))
    return np.concatenate(edges), large


EDGES = "a long, b long, bucket long"


def _edge_batch(edges: np.ndarray, large: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    edges = np.unique(np.sort(edges.reshape(-1, 2), axis=1), axis=0).view(np.int64)
    a = np.concatenate([edges[:, 0], *[p.view(np.int64) for _, p in large]])
    b = np.concatenate([edges[:, 1], *[p.view(np.int64) for _, p in large]])
    key = np.concatenate([np.full(len(edges), -1), *[k for k, _ in large]])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key.astype(np.int64))], ["a", "b", "bucket"])


def _scan_buckets(most: int, block: int):
    """Over rows (key, fingerprint) sorted by key: edges with bucket -1, rows of too large buckets with their key.

    Holds one batch and at most one unfinished bucket up to the size of a piece;
    a bucket that has outgrown it is passed on as it comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, passing = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            large = []
            if passing is not None:  # the rest of a bucket that is already passed on
                n = int(np.searchsorted(keys, passing, side="right"))
                large.append((keys[:n], prints[:n]))
                keys, prints = keys[n:], prints[n:]
                if len(keys):
                    passing = None
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            edges, over = _bucket_edges(keys[:last], prints[:last], most, block) if last else (np.zeros((0, 2), np.uint64), [])
            large += [(keys[:last][x], prints[:last][x]) for x in over]
            keys, prints = keys[last:], prints[last:]
            if len(keys) > block:
                passing = int(keys[0])
                large.append((keys, prints))
                keys, prints = keys[:0], prints[:0]
            yield _edge_batch(edges, large)
        if len(keys):
            edges, over = _bucket_edges(keys, prints, most, block)
            yield _edge_batch(edges, [(keys[x], prints[x]) for x in over])

    return run


def links(prints: DataFrame, most: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): edges whose components are those of all links among distinct fingerprints (column fingerprint)."""
    if not 0 <= most <= 4:
        raise ValueError("the keys find links of up to four bits")

    def emit(batches):
        for batch in batches:
            all_prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_prints), 2000):
                part = all_prints[i: i + 2000]
                keys, fresh = golay_keys(part)
                owner = np.broadcast_to(part[:, None], keys.shape)[fresh].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh]), pa.array(owner)], ["key", "fingerprint"])

    keyed = prints.select("fingerprint").mapInArrow(emit, "key long, fingerprint long")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_scan_buckets(most, block), EDGES)
    found = written(found.distinct(), "simhash-links")
    small = found.filter("bucket = -1").select("a", "b")
    large = found.filter("bucket <> -1").select(F.col("bucket").alias("key"), F.col("a").alias("fingerprint"))
    if large.isEmpty():
        return small
    # pieces of a large bucket, each pair of pieces by itself
    pieces = large.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(block)).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int")
    paired = (
        large.join(pieces, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .filter(F.col("own") != F.col("other"))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fingerprint")
    )

    def compare(keys, piece):
        got = piece.column("fingerprint").to_numpy().view(np.uint64)
        edges = np.array(_forest(got, most), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return small.union(paired.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component.

    Alternating large and small stars: edges move towards the smallest neighbour
    until every component is a star, in a number of rounds that grows with the
    logarithm of its size. Minima are combined before the shuffle and joined
    back, so no node's neighbours are gathered. Loops and repeats are harmless.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        down = wide.join(least, "a").select(
            F.explode(
                F.when(F.col("b") == F.col("m"), F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))
                .otherwise(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            ).alias("e")
        )
        now = written(down.select("e.a", "e.b").distinct(), "stars")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen


def _grouped(docs: DataFrame, id_col: str, text: str, most: int, block: int) -> DataFrame:
    """(id, _text, fingerprint, _root, component_id) of every row: hash of the text, smallest fingerprint and id of the group."""
    hashed = docs.select(id_col, text, F.xxhash64(text).alias("_text"))
    prints = written(fingerprints(hashed, [id_col, "_text"], text), "simhash-prints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min(id_col).alias("_least")), "simhash-nodes")
    stars = components(links(nodes.select("fingerprint"), most, block))
    rooted = nodes.join(stars, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("_print"), F.coalesce("root", "fingerprint").alias("_root"), "_least"
    )
    rooted = written(rooted, "simhash-roots")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.select("_print", "_root").join(least, "_root")
    return prints.join(named, F.col("fingerprint") == F.col("_print")).drop("_print")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 4, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id): component_id is the smallest id reachable over links.

    Documents with equal fingerprints are one node, whatever their number. Null
    and empty texts have fingerprint zero and link like any other. A null id is
    never the smallest unless the component has no other; repeated rows stay.
    Other columns are left out. An empty table gives an empty one.
    """
    return _grouped(docs, id_col, text, most, block).select(
        id_col, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 4, block: int = BLOCK) -> DataFrame:
    """One document of every group, that with the smallest id, all columns as they came.

    Of rows of one group that share that id the one with the smallest text hash
    stays, of rows equal in both any one. Ids and hashes alone decide; full rows move once, to meet those that stay.
    """
    groups = _grouped(docs, id_col, text, most, block)
    own = F.struct("_text", F.col(id_col).alias("id"))
    first = groups.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("_root").agg(F.min(own).alias("_own"))
    stay = written(first.select(F.col("_own.id").alias("_stay"), F.col("_own._text").alias("_hash")).distinct(), "simhash-stay")
    # one plan at every size: rows and ids meet by hash, only ids are held
    rows = docs.join(stay.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_stay")) & (F.xxhash64(text) == F.col("_hash")))
    twice = groups.groupBy(F.col(id_col).alias("_id"), "_text").agg(F.count("*").alias("_n")).filter("_n > 1")
    twice = written(twice.join(stay, F.col("_id").eqNullSafe(F.col("_stay")) & (F.col("_text") == F.col("_hash")), "left_semi"), "simhash-twice")
    if twice.isEmpty():
        return rows.select(*docs.columns)
    again = F.col("_stay").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    once = rows.join(twice, again, "left_anti")
    many = first_n(rows.join(twice, again, "left_semi"), ["_stay", "_hash"], [F.xxhash64(text)], 1)
    return once.select(*docs.columns).union(many.select(*docs.columns))
