"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points. Each level cuts the
sequence into phrases and names every phrase by a hash of its symbols; the names
are the next level's symbols, until one is left. Runs of an equal symbol become
one symbol. Where phrases begin is decided by deterministic coin tossing: a symbol
is labelled by the lowest bit in which it differs from its left neighbour and the
value of that bit; four such rounds bring labels below six, and neighbours still
differ. Phrases begin at local maxima, hence have two to some ten symbols, and a
beginning depends on five symbols to the left and one to the right only. Equal
substrings are therefore cut alike, but for a few phrases at their ends, wherever
they stand.

The fingerprint holds the least hash of the names in each of 64 bins, over all
levels from ``LEAST_LEVEL`` on and the last name. The share of equal bins is the
likeness of two fingerprints, an estimate of the Jaccard index of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.common import whole_text, written

BINS = 64
EMPTY = 0xFFFF  # a bin without a name
LEAST_LEVEL = 2
SLICE = 1 << 17  # symbols handled at a time
LEFT, RIGHT = 8, 2  # symbols around a slice on which its phrases may depend
GROUP_CHARS = 2_000_000
_STEP, _ONE, _TWO = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_RUN = np.uint32(1 << 31)  # marks the code of a run of code points


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def coin_labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours within a sequence differ if their symbols do."""
    label = symbols
    for _ in range(4):
        differ = np.empty_like(label)
        differ[0] = 1
        np.bitwise_xor(label[1:], label[:-1], out=differ[1:])
        differ[starts] = 1  # the first symbol is labelled by its own lowest bit
        one = label.dtype.type(1)
        place = np.bitwise_count((differ & (~differ + one)) - one)
        place = np.minimum(place, 8 * label.dtype.itemsize - 1).astype(label.dtype)
        label = ((place << one) | ((label >> place) & one)).astype(np.uint8)
    return label


def phrase_starts(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases begin: at sequence starts and at local maxima of the labels."""
    out, n = starts.copy(), len(symbols)
    last = np.append(starts[1:], True)
    for a in range(0, n, SLICE):
        lo, b = max(0, a - LEFT), min(n, a + SLICE)
        hi = min(n, b + RIGHT)
        label = coin_labels(symbols[lo:hi], starts[lo:hi])
        peak = np.zeros(hi - lo, bool)
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        out[a:b] |= peak[a - lo: b - lo] & ~last[a:b]
    return out


def _without_runs(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = starts.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    if head.all():
        return symbols, starts
    at = np.flatnonzero(head)
    size = np.diff(at, append=len(symbols))
    once, long = symbols[at], np.flatnonzero(size > 1)
    named = _mixed(once[long].astype(np.uint64) * _STEP + size[long].astype(np.uint64))
    once[long] = (named.astype(np.uint32) | _RUN) if once.dtype == np.uint32 else named
    return once, starts[at]


def parse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all sequences, and which of them are first in theirs."""
    symbols, starts = _without_runs(symbols, starts)
    begin = np.flatnonzero(phrase_starts(symbols, starts))
    ends = np.append(begin[1:], len(symbols))
    names, j = np.empty(len(begin), np.uint64), 0
    while j < len(begin):
        k = max(j + 1, int(np.searchsorted(ends, begin[j] + SLICE, side="right")))
        part = symbols[begin[j]: ends[k - 1]].astype(np.uint64)
        inside = begin[j:k] - begin[j]
        offset = np.arange(len(part), dtype=np.int64) - np.repeat(inside, ends[j:k] - begin[j:k])
        names[j:k] = np.add.reduceat(_mixed(part + (offset + 1).astype(np.uint64) * _STEP), inside)
        j = k
    return _mixed(names), starts[begin]


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``BINS`` 16-bit values per text."""
    table = np.full(len(texts) * BINS, EMPTY, np.uint16)

    def keep(owners: np.ndarray, names: np.ndarray) -> None:
        hashed = _mixed(names.astype(np.uint64) + _STEP)
        bins = owners * BINS + (hashed >> np.uint64(58)).astype(np.int64)
        values = np.minimum((hashed >> np.uint64(32)).astype(np.uint16), EMPTY - 1)
        np.minimum.at(table, bins, values.astype(np.uint16))

    lengths = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owners = np.flatnonzero(lengths)
    starts = np.zeros(len(symbols), bool)
    starts[np.cumsum(lengths)[owners] - lengths[owners]] = True
    level = 0
    while len(symbols):
        sizes = np.diff(np.flatnonzero(starts), append=len(symbols))
        if level >= LEAST_LEVEL:
            keep(np.repeat(owners, sizes), symbols)
        done = sizes == 1
        if done.any():
            if level < LEAST_LEVEL:
                keep(owners[done], symbols[starts][done])
            left = ~np.repeat(done, sizes)
            symbols, starts, owners = symbols[left], starts[left], owners[~done]
            if not len(symbols):
                break
        symbols, starts = parse(symbols, starts)
        level += 1
    return table.reshape(len(texts), BINS)


def printed(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills; 1 if both are empty."""
    filled = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of another."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["text"])
            if size >= GROUP_CHARS or len(held) >= 5000:
                yield held
                held, size = [], 0
    if held:
        yield held


_PRINT_SQL = "doc_id long, n_chars long, fingerprint string"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        texts = [r["text"] for r in rows]
        prints = fingerprints(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([printed(p) for p in prints], pa.string())], names=["doc_id", "n_chars", "fingerprint"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row of ``docs`` (``doc_id, text``).

    A null text counts as empty; its fingerprint has no name in any bin. Ids may be
    null or repeat; further columns are ignored. A task holds about
    ``GROUP_CHARS`` code points, or one longer text at some 20 bytes per code point.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    return docs.mapInArrow(_fingerprint, _PRINT_SQL)


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PARTS = [*_RESULT, ("part", pa.int32()), ("first", pa.string()), ("last", pa.string())]
_PARTS_SQL = f"{_RESULT_SQL}, part int, first string, last string"


def _compared(rows: list[tuple[object, str, np.ndarray]], following: list[tuple[str, np.ndarray]]) -> list[dict]:
    """Results of (id, text, fingerprint) rows, each with the text and fingerprint of the next one."""
    changed = [edited(text, other) for (_, text, _), (other, _) in zip(rows, following, strict=True)]
    prints = fingerprints(changed)
    return [
        {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
         "fingerprint": printed(own), "edited_fingerprint": printed(of_new),
         "near_edited": likeness(own, of_new), "near_next": likeness(own, of_next)}
        for (doc_id, text, own), new, of_new, (_, of_next) in zip(rows, changed, prints, following, strict=True)
    ]


def _compare_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All results but the last row's, which needs the next partition's first text."""
    first = held = part = None
    for group in _groups(batches):
        part = group[0]["part"]
        prints = fingerprints([r["text"] for r in group])
        rows = [(r["doc_id"], r["text"], p) for r, p in zip(group, prints, strict=True)]
        first = rows[0][1] if first is None else first
        rows = rows if held is None else [held, *rows]
        held = rows[-1]
        yield pa.RecordBatch.from_pylist(_compared(rows[:-1], [r[1:] for r in rows[1:]]), pa.schema(_PARTS))
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "part": part, "first": first, "last": held[1]}], pa.schema(_PARTS))


def _compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            own, following = fingerprints([row["last"], row["first"]])
            result = _compared([(row["doc_id"], row["last"], own)], [(row["first"], following)])
            yield pa.RecordBatch.from_pylist(result, pa.schema(_RESULT))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next document are.

    ``docs`` has ``doc_id, text``; further columns are ignored. The next document is
    that with the next smaller id, after the last one the first; equal ids go by a
    hash of the text, null ids come last, and a null text counts as empty. A single
    document is its own next one. No rows give no rows.

    Texts are shuffled once, range-partitioned by id. Each partition leaves its
    first and last text for the step across its border.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col("text")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    made = written(dealt.mapInArrow(_compare_partition, _PARTS_SQL), "fingerprint-parts")
    edges = made.filter(F.col("part").isNotNull())
    ring = Window.orderBy("part")  # one number per partition
    turn = edges.select("part").select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(
        ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_next"))
    tails = edges.select("part", "doc_id", "last").join(turn, "part")
    heads = edges.select(F.col("part").alias("_next"), "first")
    rest = tails.join(heads, "_next").select("doc_id", "last", "first").mapInArrow(_compare_edges, _RESULT_SQL)
    return made.filter(F.col("part").isNull()).select(*[n for n, _ in _RESULT]).unionByName(rest)
