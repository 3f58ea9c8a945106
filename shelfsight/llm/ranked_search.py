"""Ranked lexical search: short lists term by term, long lists document by document.

Documents stay where they are read. One pass turns every text into its counts of
query terms; corpus statistics come from that table. A second pass indexes it
task by task, in shards of at most ``SHARD_POSTINGS`` postings, and answers all
items of a block over each shard; a task hands over its best rows only.

In a shard, an item's short posting lists are summed term by term into
accumulators. Their sorted documents then act as one more posting list, with a
bound of their own, among the long lists. Those are read document by document in
windows of document numbers. Per window every list has its highest score; windows
that cannot reach the item's k-th best score are skipped whole. Within a window
lists are ordered by bound, and documents found only in the lists whose bounds
together stay below the k-th best are never looked at; for the others these lists
are probed, the strongest first, until a document cannot reach the k-th best.

Scores are whole numbers, so a bound is exact and no document is lost to rounding.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.common import whole_text, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a term stay, upper case becomes lower case, all other bytes part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BLOCK_TERMS = 50_000
SHARD_POSTINGS = 1_000_000
WINDOW = 1024
SHORT = 32  # a list is short if it holds fewer than one of so many documents of its shard


def terms_of(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.translate(whole_text(text), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list[object], list[list[str]]]]:
    """(item ids, their terms) of consecutive items with at most ``most`` terms, or one item with more."""
    ids: list[object] = []
    terms: list[list[str]] = []
    size = 0
    for row in items.toLocalIterator():
        if ids and size + len(row["terms"]) > most:
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(row["item_id"])
        terms.append(row["terms"])
        size += len(row["terms"])
    if ids:
        yield ids, terms


def _count_terms(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found, times = [], [], []
            for text in batch.column("text"):
                tokens = text.as_buffer().to_pybytes().translate(_BYTES).split() if text.is_valid else []
                seen = Counter(map(numbers.get, tokens))
                seen.pop(None, None)
                lengths.append(len(tokens))
                found.append(list(seen))
                times.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "times"],
            )

    return run


class Shard:
    """Inverted lists over some documents, in the order of their ids."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n_terms: int):
        order = np.lexsort((doc, term))
        self.ids, self.doc, self.score = ids, doc[order], score[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.windows = -(-len(ids) // WINDOW)
        places = term[order].astype(np.int64) * self.windows + self.doc // WINDOW
        used, at = np.unique(places, return_index=True)
        self.cells, self.cell_begin = used, np.append(at, len(places))
        self.cell_best = np.maximum.reduceat(self.score, at) if len(at) else self.score
        self.cell_of = np.searchsorted(used, np.arange(n_terms + 1, dtype=np.int64) * self.windows)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.begin[term], self.begin[term + 1]
        return self.doc[lo:hi], self.score[lo:hi]

    def window_bounds(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Per window the best score of a list, and the range of its postings there."""
        lo, hi = self.cell_of[term], self.cell_of[term + 1]
        at = self.cells[lo:hi] - term * self.windows
        best, ends = np.zeros(self.windows, np.int64), np.zeros((self.windows, 2), np.int64)
        best[at] = self.cell_best[lo:hi]
        ends[at, 0], ends[at, 1] = self.cell_begin[lo:hi], self.cell_begin[lo + 1: hi + 1]
        return best, ends


class Best:
    """The k best (score, id) so far; equal scores by ascending id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = np.append(self.score, score), np.append(self.ids, ids), np.append(self.none, none)
        keep = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.ids, self.none = score[keep], ids[keep], none[keep]
        if len(keep) == self.k:
            self.least = max(1, int(self.score[-1]))


def accumulate(shard: Shard, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of some lists in ascending order, and their summed scores."""
    lists = [shard.list_of(t) for t in terms]
    docs = np.concatenate([d for d, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], np.concatenate([s for _, s in lists])[order]
    at = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    return docs[at], np.add.reduceat(scores, at)


def search_shard(shard: Shard, none: np.ndarray, terms: np.ndarray, best: Best) -> None:
    """Adds to ``best`` every document of the shard that belongs there. ``none``: documents without id."""
    sizes = shard.begin[terms + 1] - shard.begin[terms]
    terms, sizes = terms[sizes > 0], sizes[sizes > 0]
    if not len(terms):
        return
    short = sizes * SHORT < len(shard.ids)
    lists, bounds, ends = [], [], []
    if short.any():
        docs, sums = accumulate(shard, list(terms[short]))
        cut = np.searchsorted(docs, np.arange(shard.windows + 1) * WINDOW)
        bound = np.zeros(shard.windows, np.int64)
        full = cut[1:] > cut[:-1]
        bound[full] = np.maximum.reduceat(sums, cut[:-1][full])
        lists.append((docs, sums))
        bounds.append(bound)
        ends.append(np.stack([cut[:-1], cut[1:]], axis=1))
    for term in terms[~short]:
        bound, end = shard.window_bounds(term)
        lists.append((shard.doc, shard.score))
        bounds.append(bound)
        ends.append(end)
    table = np.stack(bounds)
    total = table.sum(axis=0)
    for window in np.flatnonzero(total >= best.least):
        if total[window] < best.least:
            continue
        order = np.argsort(table[:, window], kind="stable")
        upper = np.cumsum(table[order, window])
        first = int(np.searchsorted(upper, best.least, side="left"))  # lists before it cannot carry a document alone
        base = window * WINDOW
        sums = np.zeros(WINDOW, np.int64)
        for i in order[first:]:
            lo, hi = ends[i][window]
            sums[lists[i][0][lo:hi] - base] += lists[i][1][lo:hi]
        docs = np.flatnonzero(sums)
        scores = sums[docs]
        for j in range(first - 1, -1, -1):
            good = scores + upper[j] >= best.least
            docs, scores = docs[good], scores[good]
            lo, hi = ends[order[j]][window]
            if hi > lo and len(docs):
                there, value = lists[order[j]][0][lo:hi] - base, lists[order[j]][1][lo:hi]
                at = np.minimum(np.searchsorted(there, docs), hi - lo - 1)
                scores = scores + np.where(there[at] == docs, value[at], 0)
        good = scores >= best.least
        docs = docs[good] + base
        if len(docs):
            best.add(scores[good], shard.ids[docs], none[docs])


def _search(ids: list[object], items: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                held.append(part)
                size += len(part.column("terms").flatten())
                if size >= SHARD_POSTINGS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in items]
        for rows in shards(batches):
            none = np.asarray(rows["doc_id"].is_null())
            number = rows["doc_id"].fill_null(0).to_numpy()
            order = np.lexsort((number, none))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lists = rows["terms"].combine_chunks()
            counts = np.diff(np.asarray(lists.offsets))
            times = rows["times"].combine_chunks().flatten().to_numpy()
            term = lists.flatten().to_numpy()
            size = 50 + (50 * rows["n"].to_numpy() * documents) // max(1, length)
            score = weights[term] * ((1_000_000_000 * times) // (1000 * times + 20 * np.repeat(size, counts)))
            shard = Shard(number[order], np.repeat(place, counts), term, score, len(weights))
            for terms, best in zip(items, found, strict=True):
                search_shard(shard, none[order], terms, best)
        for item, best in zip(ids, found, strict=True):
            if len(best.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(best.score), pa.int64()), pa.array(best.ids, mask=best.none), pa.array(best.score)],
                    names=["item_id", "doc_id", "score"],
                )

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; further columns
    are ignored. Null texts have no terms; a document without terms is no document
    of the corpus. Rows with one ``item_id`` (null too) are one item with the terms
    of all of them. Each row of ``docs`` is a document, also where ids repeat or
    are null; equal scores go by id, null ids last. Items that no document
    matches have no rows, nor have empty tables. Items go to the tasks in blocks of
    about ``block_terms`` terms, with two passes over the documents per block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term"))
    wanted = wanted.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")).orderBy("item_id")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for ids, terms in _blocks(wanted, block_terms):
        numbers = {t: i for i, t in enumerate(sorted({t for each in terms for t in each}))}
        count = _count_terms({t.encode(): i for t, i in numbers.items()})
        counted = written(docs.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<long>"), "search-counts")
        documents, length = counted.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = {r["term"]: r["df"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(numbers))], np.int64)
        coded = [np.array(sorted(numbers[t] for t in each), np.int64) for each in terms]
        search = _search(ids, coded, weights, documents, length, k)
        best = counted.filter(F.size("terms") > 0).mapInArrow(search, "item_id long, doc_id long, score long")
        found = found.unionByName(written(best, "search-best"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_salt", F.spark_partition_id() % 64)
    salted = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", "_salt").orderBy(*order))).filter(F.col("_rank") <= k)
    ranked = salted.select("item_id", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).alias("rank"), "doc_id", "score")
    return ranked.filter(F.col("rank") <= k)
