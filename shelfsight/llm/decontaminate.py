"""Benchmark decontamination by spaced-seed hashing.

A seed looks at some places of a window of words and ignores the others. With
``k`` substitutions allowed in a window its places are dealt to ``k + 2`` groups,
and every pair of groups makes a mask: whichever k words differ, one mask sees
none of them. Hashes of all masked windows of the benchmark are joined with those
of all training windows; around every hit the whole windows are compared. Equal
windows, of a text or of the benchmark, are one entry each, whose places are spread
back afterwards.

The benchmark is the small side and goes to the tasks in blocks of a fixed
number of words, one pass over the documents per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shelfsight.llm.common import word_count

MOST_CACHED = 300_000
BATCH_WORDS = 200_000
BLOCK_WORDS = 200_000
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], np.uint64)


def normal(token: str) -> str:
    """Letters and digits of a lower-case token."""
    return token if token.isalnum() else "".join(ch for ch in token if ch.isalnum())


def masks(span: int, substitutions: int) -> list[list[int]]:
    """Places that each mask looks at; any ``substitutions`` places of ``span`` are ignored together by one mask."""
    groups = [list(range(g, span, substitutions + 2)) for g in range(min(span, substitutions + 2))]
    if len(groups) < 2:
        return [list(range(span))]
    return [sorted(a + b) for a, b in combinations(groups, 2)]


def _hash(words: np.ndarray, mask: list[int], count: int) -> np.ndarray:
    """Hash of every window start of ``words`` (0: not a benchmark word)."""
    out = np.zeros(count, np.uint64)
    for j, place in enumerate(mask):
        out += words[place: place + count] * _FACTORS[j]
    return out ^ (out >> np.uint64(29))


def _classes(words: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """A first start of every distinct window, and which of these each start is equal to. Equality is checked, not hashed only."""
    full = np.zeros(len(starts), np.uint64)
    for j in range(span):
        full += words[starts + j] * _FACTORS[j]
    _, first, of = np.unique(full, return_index=True, return_inverse=True)
    if any((words[starts + j] != words[starts[first[of]] + j]).any() for j in range(span)):
        _, first, of = np.unique(words[starts[:, None] + np.arange(span)], axis=0, return_index=True, return_inverse=True)
    return starts[first], of.reshape(-1)


@dataclass
class Windows:
    """Starts of windows, grouped by (distinct window, owner)."""

    starts: np.ndarray
    begin: np.ndarray
    kind: np.ndarray
    owner: np.ndarray

    @classmethod
    def grouped(cls, starts: np.ndarray, kind: np.ndarray, owner: np.ndarray) -> Windows:
        order = np.lexsort((starts, owner, kind))
        starts, kind, owner = starts[order], kind[order], owner[order]
        new = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (owner[1:] != owner[:-1]))) if len(starts) else np.zeros(0, np.int64)
        return cls(starts, np.append(new, len(starts)), kind[new], owner[new])

    def of_kinds(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of each of ``kinds``: places in ``kinds`` and group numbers."""
        lo = np.searchsorted(self.kind, kinds, side="left")
        n = np.searchsorted(self.kind, kinds, side="right") - lo
        return np.repeat(np.arange(len(kinds)), n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def places(self, groups: np.ndarray) -> np.ndarray:
        """All starts of some groups."""
        return np.concatenate([self.starts[self.begin[g]: self.begin[g + 1]] for g in groups.tolist()])


@dataclass
class SeedTable:
    """One span: the distinct windows of the benchmark; per mask their sorted hashes with a bit table in front."""

    span: int
    least: int
    masks: list[list[int]]
    first: np.ndarray
    windows: Windows
    hashes: list[np.ndarray]
    owners: list[np.ndarray]
    bits: list[np.ndarray]


class BenchmarkIndex:
    """Seed hashes of a block of benchmark items."""

    BITS = 20

    def __init__(self, items: list[tuple[object, str | None]], window: int, share: float, shortest: int):
        self.ids = [i for i, _ in items]
        self.words: dict[str, int] = {}
        coded = []
        for _, text in items:
            tokens = [w for w in map(normal, (text or "").lower().split()) if w]
            coded.append(np.array([self.words.setdefault(w, len(self.words) + 1) for w in tokens], np.uint64))
        self.flat = np.concatenate([*coded, np.zeros(window, np.uint64)])
        lengths = np.array([len(x) for x in coded], np.int64)
        self.begin = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.tables = []
        for span in sorted({min(window, int(n)) for n in lengths if n >= shortest}):
            fits = [i for i, n in enumerate(lengths) if n >= shortest and min(window, n) == span]
            starts = np.concatenate([self.begin[i] + np.arange(lengths[i] - span + 1) for i in fits])
            first, kind = _classes(self.flat, starts, span)
            grouped = Windows.grouped(starts, kind, np.searchsorted(self.begin, starts, side="right") - 1)
            least = math.ceil(share * span - 1e-9)
            table = SeedTable(span, least, masks(span, span - least), first, grouped, [], [], [])
            for mask in table.masks:
                hashes = _hash(self.flat, mask, len(self.flat) - span + 1)[first]
                order = np.argsort(hashes, kind="stable")
                table.hashes.append(hashes[order])
                table.owners.append(order)
                bits = np.zeros(1 << self.BITS, bool)
                bits[hashes >> np.uint64(64 - self.BITS)] = True
                table.bits.append(bits)
            self.tables.append(table)

    def _pairs(self, table: SeedTable, words: np.ndarray, first: np.ndarray, made: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(distinct window of the texts, of the benchmark, equal words) wherever enough words are equal."""
        pairs = []
        for hashes, owners, bits, every in zip(table.hashes, table.owners, table.bits, made, strict=True):
            own = every[first]
            at = np.flatnonzero(bits[own >> np.uint64(64 - self.BITS)])
            lo = np.searchsorted(hashes, own[at], side="left")
            n = np.searchsorted(hashes, own[at], side="right") - lo
            place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.stack([np.repeat(at, n), owners[place]], axis=1))
        hits = np.unique(np.concatenate(pairs), axis=0)
        same = np.zeros(len(hits), np.int64)
        for i in range(0, len(hits), 100_000):
            part = hits[i: i + 100_000]
            for k in range(table.span):
                same[i: i + 100_000] += words[first[part[:, 0]] + k] == self.flat[table.first[part[:, 1]] + k]
        good = same >= table.least
        return hits[good, 0], hits[good, 1], same[good]

    def matches(self, words: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, int]]:
        """(text, item, span, starts in ``words``, starts in ``flat``, most equal words) of every text and item that overlap.

        Equal windows are compared once, on either side, and their starts are listed
        once per text and item, so the work grows with the texts and not with how
        often they or an item repeat a window.
        """
        for table in self.tables:
            counts = np.maximum(lengths - table.span + 1, 0)
            owner = np.repeat(np.arange(len(counts)), counts)
            starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            if not len(starts):
                continue
            made = [_hash(words, mask, len(words) - table.span + 1) for mask in table.masks]
            seen = np.zeros(len(starts), bool)
            for bits, every in zip(table.bits, made, strict=True):
                seen |= bits[every[starts] >> np.uint64(64 - self.BITS)]
            starts, owner = starts[seen], owner[seen]
            if not len(starts):
                continue
            first, kind = _classes(words, starts, table.span)
            left, right, same = self._pairs(table, words, first, made)
            grouped = Windows.grouped(starts, kind, owner)
            pair, text_group = grouped.of_kinds(left)
            again, item_group = table.windows.of_kinds(right[pair])
            text_group, same = text_group[again], same[pair][again]
            doc, item = grouped.owner[text_group], table.windows.owner[item_group]
            order = np.lexsort((item, doc))
            cuts = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                yield (int(doc[rows[0]]), int(item[rows[0]]), table.span, grouped.places(np.unique(text_group[rows])),
                       table.windows.places(np.unique(item_group[rows])), int(same[rows].max()))


class _Coder(dict):
    """Benchmark word numbers of tokens, 0 for other words, -1 for tokens without letter or digit."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) >= MOST_CACHED:
            self.clear()
        word = normal(token)
        self[token] = n = self.words.get(word, 0) if word else -1
        return n


def _overlaps(index: BenchmarkIndex, coder: _Coder, texts: list[str | None]) -> list[list[dict]]:
    """Per text the items it overlaps with. Texts stand one behind another, with gaps no window crosses unharmed."""
    gap = max((t.span for t in index.tables), default=0)
    coded = []
    for text in texts:
        words = np.array(list(map(coder.__getitem__, (text or "").lower().split())), np.int64)
        coded.append(words[words >= 0])
    lengths = np.array([len(x) for x in coded], np.int64)
    begin = np.cumsum(lengths + gap) - lengths - gap
    flat = np.zeros(int((lengths + gap).sum()), np.uint64)
    for b, x in zip(begin.tolist(), coded, strict=True):
        flat[b: b + len(x)] = x
    out: list[list[dict]] = [[] for _ in texts]
    for d, i, width, at, place, same in index.matches(flat, begin, lengths):
        own, theirs = at - begin[d], place - index.begin[i]
        covered, asked = (len(np.unique(x[:, None] + np.arange(width))) for x in (own, theirs))
        out[d].append({
            "item": i, "words": covered, "start": int(own.min()), "end": int(own.max()) + width,
            "item_words": asked, "item_share": asked / int(index.lengths[i]), "best": same / width,
        })
    return [sorted(found, key=lambda x: x["item"]) for found in out]


FIELDS = "words int, start int, end int, item_words int, item_share double, best double"


def _add(docs: DataFrame, items: list, item_kind, column: str, text: str, window: int, share: float, shortest: int) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(items, window, share, shortest))
    kind = pa.list_(pa.struct([
        ("item", to_arrow_type(item_kind)), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
        ("item_words", pa.int32()), ("item_share", pa.float64()), ("best", pa.float64()),
    ]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += f", `{column}` array<struct<item {item_kind.simpleString()}, {FIELDS}>>"

    def run(batches):
        coder = _Coder(index.value.words)
        ids = index.value.ids
        for batch in batches:
            found, held, size = [], [], 0
            for x in batch.column(text):
                held.append(x.as_py())
                size += len(held[-1] or "") // 6
                if size >= BATCH_WORDS:
                    found += _overlaps(index.value, coder, held)
                    held, size = [], 0
            found += _overlaps(index.value, coder, held) if held else []
            for row in found:
                for x in row:
                    x["item"] = ids[x["item"]]
            yield batch.append_column(column, pa.array(found, kind))

    return docs.mapInArrow(run, schema)


def find_overlaps(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 12, share: float = 0.8, shortest: int = 8, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add ``overlaps``: one struct per benchmark item that a document overlaps with.

    An overlap is a window of ``window`` words (the whole item if it has fewer) of
    which at least ``share`` stand in the same places in the document. Words are
    compared in lower case without marks; tokens without a letter or digit do not
    count as words. Fields: item, words and start, end (place in the document,
    in words, over all windows), item_words and item_share (covered of the item),
    best (largest share of equal words in a window). Items under ``shortest`` words
    say nothing and are never overlapped with; neither are null or empty ones.
    Null and empty texts have no overlaps; repeated rows have the same ones, and
    repeated items one each. Other columns stay, one named overlaps is replaced.
    Every document is searched whole for every item; the benchmark goes to tasks
    in blocks of about ``block_words`` words.
    """
    docs = docs.drop("overlaps")
    bench = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    total = bench.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    kind = bench.schema["id"].dataType
    names = []
    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        names.append(f"_overlaps_{b}")
        rows = sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1] or ""))
        docs = _add(docs, rows, kind, names[-1], text, window, share, shortest)
    return docs.withColumn("overlaps", F.concat(*names)).drop(*names)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows without any overlap, columns as they came."""
    kept = docs.columns
    return find_overlaps(docs, items, **options).filter(F.size("overlaps") == 0).select(*kept)
