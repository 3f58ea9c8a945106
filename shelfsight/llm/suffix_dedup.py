"""Exact repeats of long byte strings by a distributed difference-cover sample.

Which bytes lie in a string of ``length`` bytes that starts anywhere else too?
Suffixes need no full order for that: only those that share their first
``length`` bytes have to become neighbours. The steps are those of a
difference-cover suffix sort, each cut off at that depth.

1. Sample: places whose offset modulo 133 lies in a perfect difference cover of
   12 residues. Of any two equal strings some common offset below 133 falls on
   sampled places in both. Every sampled place is named by its next ``length`` -
   132 bytes; names are made from the names of their halves, level by level.
2. Names are dealt out by their leading bits and sorted. A place whose name
   occurs once starts nothing that is repeated and drops out.
3. The remaining suffixes, every start up to 132 bytes before a place that is left,
   are merged with their like: they are dealt out by the smallest 16-byte name
   inside their first ``length`` bytes, which equal starts have in common. A run
   of neighbouring starts with one such name travels as one piece of text.
   Where the pieces of one such name add up to more than ``HOT_BYTES``, as around a
   passage in very many contexts, the starts themselves are named by their
   ``length`` bytes and dealt out by that name.
4. Starts with equal prefixes are adjacent after sorting; equal neighbours are repeats.

Texts lie in blocks of a few MB, written once and bucketed by their number, so that answers find their blocks without moving texts. A block sends each
name and each piece of text once, however often it holds it, in one message per bucket. A bucket has the names
and pieces of some ``BUCKET_BYTES`` of text and is sorted in ``SHARES`` shares, so that buckets are few and sorts small.
Nothing depends on how many copies a text has.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from shelfsight.llm.common import whole_text, written
from shelfsight.session import shared_folder

MODULUS = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)  # fixed values: all differences modulo 133 occur once
ANCHOR = 16
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 32
SHARES = 16
SLICE_BYTES = 256 << 10
HOT_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _B
    out += right
    out ^= out >> np.uint64(32)
    out *= _C
    out ^= out >> np.uint64(29)
    return out


def names(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit name of the ``length`` bytes from every place that has so many. Some 40 bytes of memory per byte of data."""
    level, width = (data.astype(np.uint64) + np.uint64(1)) * _A, 1
    level ^= level >> np.uint64(31)
    made, done = None, 0
    while width <= length:
        if length & width:
            made = level if made is None else _mix(made[: max(0, len(level) - done)], level[done:])
            done += width
        if 2 * width <= length:
            level = _mix(level[: max(0, len(level) - width)], level[width:])
        width *= 2
    return made[: max(0, len(data) - length + 1)]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in every window of ``width``."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _sliced(data: np.ndarray, places: np.ndarray, length: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` at ascending places, over slices that overlap by the ``length`` bytes a place looks at."""
    out = np.empty(len(places), np.uint64)
    cuts = np.searchsorted(places, np.arange(0, len(data) + SLICE_BYTES, SLICE_BYTES))
    for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if lo < hi:
            a = i * SLICE_BYTES
            out[lo:hi] = of(data[a: a + SLICE_BYTES + length - 1])[places[lo:hi] - a]
    return out


def names_at(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    return _sliced(data, places, length, lambda part: names(part, length))


def anchors_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Smallest ``ANCHOR``-byte name inside the ``length`` bytes from each start."""
    return _sliced(data, starts, length, lambda part: _smallest(names(part, ANCHOR), length - ANCHOR + 1))


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the leading 32 bits; grows with the value."""
    return ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Block:
    """Texts one behind another."""

    def __init__(self, data: bytes, lengths: np.ndarray):
        self.raw, self.lengths = data, lengths.astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths

    def sampled(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places with a whole name, ascending, and their names."""
        depth = length - MODULUS + 1
        if len(self.data) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        long = self.lengths >= length
        counts = np.where(long, self.lengths - depth + 1, 0)
        whole, rest = counts // MODULUS, counts % MODULUS
        cover = np.array(COVER)
        sizes = whole * len(COVER) + np.searchsorted(cover, rest)
        owner = np.repeat(np.arange(len(counts)), sizes)
        k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = self.begins[owner] + k // len(COVER) * MODULUS + cover[k % len(COVER)]
        return places, names_at(self.data, places, depth)

    def starts_near(self, places: np.ndarray, length: int) -> np.ndarray:
        """Starts with room for ``length`` bytes that lie up to 132 before one of ``places``, ascending."""
        doc = np.searchsorted(self.ends, places, side="right")
        low = np.maximum(places - MODULUS + 1, self.begins[doc])
        high = np.minimum(places, self.ends[doc] - length)
        low, high = low[high >= low], high[high >= low]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, low, 1)
        np.add.at(change, high + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32) > 0)


def _pack_pieces(pieces: list[bytes], shares: bytes) -> bytes:
    """Number, sizes, pieces and, a byte for each, their shares."""
    return struct.pack("<I", len(pieces)) + np.array([len(p) for p in pieces], "<u4").tobytes() + b"".join(pieces) + shares


def _sizes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4", struct.unpack_from("<I", packed)[0], 4).astype(np.int64)


def _pack_names(own: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Per bucket how many ascending names each of its shares has, and their low halves."""
    cuts = np.searchsorted(_bucket(own, buckets * SHARES), np.arange(buckets * SHARES + 1))
    counts, low = np.diff(cuts).astype("<u4").reshape(buckets, SHARES), own.astype("<u4")
    ends = cuts[::SHARES].tolist()
    return [(b, counts[b].tobytes() + low[ends[b]: ends[b + 1]].tobytes()) for b in range(buckets) if ends[b] < ends[b + 1]]


def _unpack_names(data: bytes) -> np.ndarray:
    counts = np.frombuffer(data, "<u4", SHARES)
    return np.repeat(np.arange(SHARES, dtype=np.uint64) << np.uint64(32), counts) | np.frombuffer(data, "<u4", offset=4 * SHARES)


def _blocks(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
    """Rows (block, ids, lengths, data), bucketed by block number; and the table's name."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    ids = pa.list_(to_arrow_type(kind))

    def pack(batches):
        block, held, lengths, size = TaskContext.get().partitionId() << 24, [], [], 0
        keys: list = []

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([keys], ids), pa.array([lengths], pa.list_(pa.int32())), pa.array([b"".join(held)], pa.binary())],
                ["block", "ids", "lengths", "data"],
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for key, x in zip(batch.column(0), texts, strict=True):
                data = x.as_py()
                if held and size + len(data) > BLOCK_BYTES:
                    yield row()
                    block, held, lengths, keys, size = block + 1, [], [], [], 0
                keys.append(key.as_py())
                held.append(data)
                lengths.append(len(data))
                size += len(data)
        if held:
            yield row()

    schema = f"block long, ids array<{kind.simpleString()}>, lengths array<int>, data binary"
    packed = docs.select(F.col(id_col), whole_text(F.col(text)).alias("_text")).mapInArrow(pack, schema)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packed.rdd.getNumPartitions())
    name = f"text_blocks_{uuid.uuid4().hex}"
    (
        packed.write.bucketBy(buckets, "block").option("compression", "zstd")
        .option("path", shared_folder(spark, "text-blocks")).saveAsTable(name)
    )
    return spark.table(name), name


def _by_block(rows: DataFrame, purpose: str) -> DataFrame:
    """Answers to every block as one row; they are about a hundredth of its text."""
    return written(rows.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "data")).alias("answers")), purpose)


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the answers to them. Blocks stay where they are read; only answers move."""
    joined = blocks.join(answers.withColumnRenamed("block", "_block").hint("shuffle_hash"), F.col("block") == F.col("_block"), "left")
    return joined.withColumn("answers", F.coalesce("answers", F.array())).drop("_block")


MESSAGE = "block long, kind int, bucket int, data binary"
_MESSAGE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
PIECE_MESSAGE = MESSAGE + ", anchors binary"
_PIECE_MESSAGE = _MESSAGE.append(pa.field("anchors", pa.binary()))
NAMES, PIECES, PLACES, BITS, WHOLE, AGAIN = 0, 1, 2, 3, 4, 5


def _messages(rows: list[tuple], schema: pa.Schema = _MESSAGE) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(batch.column(c)[i].as_py() for c in columns)


def _send_names(length: int, buckets: int):
    def run(batches):
        for block, lengths, data in _rows(batches, ["block", "lengths", "data"]):
            _, made = Block(data, np.array(lengths)).sampled(length)
            yield _messages([(block, NAMES, b, packed) for b, packed in _pack_names(np.unique(made), buckets)])

    return run


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` numbers from each of ``first``, one run behind another."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _repeated_pieces(parts: list[bytes], length: int) -> list[bytes]:
    """Per message a bit for every start in its pieces: whether an equal start is anywhere in the bucket. Equal starts are in one share."""
    sizes = [_sizes(p) for p in parts]
    lead = [4 + 4 * len(s) for s in sizes]
    text = np.concatenate([np.frombuffer(p, np.uint8, len(p) - k - len(s), k) for p, s, k in zip(parts, sizes, lead, strict=True)])
    share = np.concatenate([np.frombuffer(p, np.uint8, offset=len(p) - len(s)) for p, s in zip(parts, sizes, strict=True)])
    flat = np.concatenate(sizes)
    starts = flat - length + 1
    begin, place = np.cumsum(flat) - flat, np.cumsum(starts) - starts
    again = np.zeros(starts.sum(), bool)
    for k in np.unique(share).tolist():
        mine = np.flatnonzero(share == k)
        own = np.concatenate([text[b: b + n] for b, n in zip(begin[mine].tolist(), flat[mine].tolist(), strict=True)])
        made = names_at(own, _ranges(np.cumsum(flat[mine]) - flat[mine], starts[mine]), length)
        order = np.argsort(made, kind="stable")
        same = np.flatnonzero(made[order][1:] == made[order][:-1])
        found = np.zeros(len(made), bool)
        found[order[same + 1]] = True
        found[order[same]] = True
        again[_ranges(place[mine], starts[mine])] = found
    out, done = [], 0
    for s in sizes:
        n = int((s - length + 1).sum())
        out.append(np.packbits(again[done: done + n]).tobytes())
        done += n
    return out


def _answer(length: int):
    """Over messages sorted by bucket: a bit per name or start of every message. Place lists pass through."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        if rows[0][1] == NAMES:
            parts = [_unpack_names(r[3]) for r in rows]
            values = np.sort(np.concatenate(parts))
            twice = np.unique(values[1:][values[1:] == values[:-1]])
            bits = []
            for p in parts:
                at = np.searchsorted(twice, p)
                at[at == len(twice)] = 0
                bits.append(np.packbits(twice[at] == p if len(twice) else np.zeros(len(p), bool)).tobytes())
        elif rows[0][1] == WHOLE:  # whole names; those that come from several messages go back
            parts = [np.frombuffer(r[3], "<u8") for r in rows]
            values = np.sort(np.concatenate(parts))
            twice = np.unique(values[1:][values[1:] == values[:-1]])
            return _messages([(r[0], AGAIN, r[2], x.tobytes()) for r, p in zip(rows, parts, strict=True) if len(x := np.intersect1d(p, twice))])
        else:
            bits = _repeated_pieces([r[3] for r in rows], length)
        return _messages([(r[0], BITS, r[2], b) for r, b in zip(rows, bits, strict=True)])

    def run(batches):
        held: list[tuple] = []
        for row in _rows(batches, ["block", "kind", "bucket", "data"]):
            if row[1] == PLACES:
                yield _messages([row])
                continue
            if held and held[0][1:3] != row[1:3]:
                yield settle(held)
                held = []
            held.append(row)
        if held:
            yield settle(held)

    return run


def _send_pieces(length: int, buckets: int):
    def run(batches):
        for number_of, lengths, data, answers in _rows(batches, ["block", "lengths", "data", "answers"]):
            block = Block(data, np.array(lengths))
            places, made = block.sampled(length)
            if not len(places):
                continue
            own, inverse, counts = np.unique(made, return_inverse=True, return_counts=True)
            cuts = np.searchsorted(_bucket(own, buckets), np.arange(buckets + 1))
            again = counts > 1
            for a in answers:
                lo, hi = cuts[a["bucket"]], cuts[a["bucket"] + 1]
                again[lo:hi] |= np.unpackbits(np.frombuffer(a["data"], np.uint8), count=hi - lo).astype(bool)
            starts = block.starts_near(places[again[inverse]], length)
            if not len(starts):
                continue
            least = anchors_at(block.data, starts, length)
            first = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (least[1:] != least[:-1])])
            sizes = np.diff(np.r_[first, len(starts)])
            where, shares = np.divmod(_bucket(least[first] * _A, buckets * SHARES).astype(np.int64), SHARES)
            pieces: dict[int, dict[bytes, int]] = {}
            twice: set[tuple[int, int]] = set()
            numbers = np.zeros(len(first), np.int64)
            for i, (s, n, b) in enumerate(zip(starts[first].tolist(), sizes.tolist(), where.tolist(), strict=True)):
                known = pieces.setdefault(b, {})
                piece = data[s: s + n + length - 1]
                number = known.get(piece)
                if number is None:
                    number = known[piece] = len(known)
                else:
                    twice.add((b, number))
                numbers[i] = number
            sure = np.array([(b, n) in twice for b, n in zip(where.tolist(), numbers.tolist(), strict=True)])
            anchor = least[first]
            table = np.stack([starts[first], sizes, where, numbers, sure, anchor.view(np.int64)], axis=1).astype("<i8")
            of: dict[int, np.ndarray] = {b: np.zeros(len(known), "<u8") for b, known in pieces.items()}
            dealt = {b: bytearray(len(known)) for b, known in pieces.items()}
            for b, n, a, share in zip(where.tolist(), numbers.tolist(), anchor, shares.tolist(), strict=True):
                of[b][n], dealt[b][n] = a, share
            out = [(number_of, PLACES, number_of % buckets, table.tobytes(), None)]
            out += [(number_of, PIECES, b, _pack_pieces(list(known), dealt[b]), of[b].tobytes()) for b, known in sorted(pieces.items())]
            yield _messages(out, _PIECE_MESSAGE)

    return run


def _unpack_pieces(data: bytes) -> list[bytes]:
    sizes = _sizes(data)
    ends = np.cumsum(sizes) + 4 + 4 * len(sizes)
    return [data[e - n: e] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _anchor_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of pieces per anchor of every batch of messages."""
    for batch in batches:
        sizes, anchors = [np.zeros(0, np.int64)], [np.zeros(0, "<u8")]
        for data, mine in _rows([batch], ["data", "anchors"]):
            sizes.append(_sizes(data))
            anchors.append(np.frombuffer(mine, "<u8"))
        own, inverse = np.unique(np.concatenate(anchors), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(sizes), minlength=len(own)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["anchor", "n"])


def _hot_anchors(messages: DataFrame, most: int) -> np.ndarray:
    """Anchors whose pieces have more than ``most`` bytes; there are few, as they share the bytes of all pieces."""
    sizes = messages.filter(F.col("kind") == PIECES).select("data", "anchors").mapInArrow(_anchor_bytes, "anchor long, n long")
    hot = sizes.groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in hot], np.int64).view(np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _name_hot(length: int, buckets: int, hot: np.ndarray):
    """Pieces of hot anchors become whole names of their starts, each once per message; all other messages stay."""

    def named(block: int, b: int, data: bytes, is_hot: np.ndarray) -> list[tuple]:
        pieces, shares = _unpack_pieces(data), np.frombuffer(data, np.uint8, offset=len(data) - len(is_hot))
        cold = [p for p, h in zip(pieces, is_hot, strict=True) if not h]
        out = [(block, PIECES, b, _pack_pieces(cold, shares[~is_hot].tobytes()))] if cold else []
        whole = [names(np.frombuffer(p, np.uint8), length) for p, h in zip(pieces, is_hot, strict=True) if h]
        own = np.unique(np.concatenate(whole))
        cuts = np.searchsorted(_bucket(own, buckets), np.arange(buckets + 1))
        return out + [(block, WHOLE, k, own[cuts[k]: cuts[k + 1]].astype("<u8").tobytes()) for k in np.flatnonzero(np.diff(cuts)).tolist()]

    def run(batches):
        held, size = [], 0
        for block, kind, b, data, anchors in _rows(batches, ["block", "kind", "bucket", "data", "anchors"]):
            some = kind == PIECES and (is_hot := _among(np.frombuffer(anchors, "<u8"), hot)).any()
            held += (out := named(block, b, data, is_hot) if some else [(block, kind, b, data)])
            size += sum(len(r[3]) for r in out)
            if size > BLOCK_BYTES:
                yield _messages(held)
                held, size = [], 0
        if held:
            yield _messages(held)

    return run


def _covered(block: Block, length: int, answers: list[dict], hot: np.ndarray) -> np.ndarray:
    """Which bytes of a block lie in a repeated string."""
    change = np.zeros(len(block.data) + 1, np.int32)
    tables = [np.frombuffer(a["data"], "<i8").reshape(-1, 6) for a in answers if a["kind"] == PLACES]
    if tables:
        table = tables[0]
        is_hot = np.isin(np.ascontiguousarray(table[:, 5]).view(np.uint64), hot)
        if is_hot.any():
            mine = table[is_hot]
            n = mine[:, 1]
            at = np.repeat(mine[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            _, inverse, counts = np.unique(own := names_at(block.data, at, length), return_inverse=True, return_counts=True)
            again = [np.frombuffer(a["data"], "<u8") for a in answers if a["kind"] == AGAIN]
            at = at[(counts[inverse] > 1) | np.isin(own, np.concatenate(again) if again else own[:0])]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
            table = table[~is_hot].copy()
        table = table[np.argsort(table[:, 2], kind="stable")]
        for a in answers:
            if a["kind"] != BITS:
                continue
            mine = table[slice(*np.searchsorted(table[:, 2], [a["bucket"], a["bucket"] + 1]))].copy()
            mine[:, 3] = np.unique(mine[:, 3], return_inverse=True)[1]  # as numbered among the pieces that were sent
            count = int(mine[:, 3].max()) + 1
            sizes = np.zeros(count, np.int64)
            sizes[mine[:, 3]] = mine[:, 1]
            offset = np.cumsum(sizes) - sizes
            bits = np.unpackbits(np.frombuffer(a["data"], np.uint8), count=int(sizes.sum())).astype(bool)
            n = mine[:, 1]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = bits[np.repeat(offset[mine[:, 3]], n) + k] | np.repeat(mine[:, 4] > 0, n)
            at = (np.repeat(mine[:, 0], n) + k)[hit]
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, keep_text: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept (binary).

    Texts are bytes in UTF-8, null as empty. A byte is removed if a string of
    ``length`` bytes around it also starts at any other place of any document,
    the same one included; all strings are judged on the input. n_spans:
    maximal removed runs. Texts shorter than ``length`` keep everything. Rows are
    documents: repeated rows are copies of each other, whatever their id, and
    null ids stay null. An empty table gives an empty one. Equal means equal
    64-bit names among the starts of one bucket, or of all hot anchors.
    """
    if length < 2 * ANCHOR + MODULUS - 1:
        raise ValueError(f"length must be at least {2 * ANCHOR + MODULUS - 1}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    blocks, name = _blocks(docs, id_col, text)
    batch = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(2 * BLOCK_BYTES))  # a few blocks at a time between Spark and Python
    try:
        return written(_without_repeats(blocks, id_col, kind, length, keep_text), "repeats-removed")
    finally:
        spark.conf.set(_BATCH, batch)
        spark.sql(f"drop table {name}")


def _without_repeats(blocks: DataFrame, id_col: str, kind: DataType, length: int, keep_text: bool) -> DataFrame:
    total = blocks.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES))

    def dealt(messages: DataFrame) -> DataFrame:
        return messages.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer(length), MESSAGE)

    known = _by_block(dealt(blocks.select("block", "lengths", "data").mapInArrow(_send_names(length, buckets), MESSAGE)), "repeat-names")
    asked = _with_answers(blocks.select("block", "lengths", "data"), known)
    pieces = written(asked.mapInArrow(_send_pieces(length, buckets), PIECE_MESSAGE), "repeat-pieces")
    hot = _hot_anchors(pieces, HOT_BYTES)
    found = _by_block(dealt(pieces.mapInArrow(_name_hot(length, buckets, hot), MESSAGE)), "repeat-starts")

    def finish(batches):
        for ids, lengths, data, answers in _rows(batches, ["ids", "lengths", "data", "answers"]):
            block = Block(data, np.array(lengths))
            gone = _covered(block, length, answers, hot)
            rise = gone & ~np.r_[False, gone[:-1]]
            rise[block.begins[block.lengths > 0]] = gone[block.begins[block.lengths > 0]]
            removed, spans = (np.r_[0, np.cumsum(x)] for x in (gone, rise))
            kept = [block.data[b:e][~gone[b:e]].tobytes() for b, e in zip(block.begins.tolist(), block.ends.tolist(), strict=True)]
            columns = [
                pa.array(ids, to_arrow_type(kind)), pa.array(block.lengths), pa.array(removed[block.ends] - removed[block.begins]),
                pa.array(spans[block.ends] - spans[block.begins]), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
            ]
            labels = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                labels.append("kept")
            yield pa.RecordBatch.from_arrays(columns, labels)

    schema = f"`{id_col}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if keep_text else ""
    return _with_answers(blocks, found).select("ids", "lengths", "data", "answers").mapInArrow(finish, schema)
