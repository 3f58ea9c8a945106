"""Language identification word by word: a linear-chain conditional random field.

A word's features are itself (lexicon), its affixes and its character n-grams,
hashed into one weight table; transitions between languages are weights too.
Training sequences are pieces of labelled documents put one behind another, so
that switches occur in them. Forward-backward gives every word its posterior;
a document's language is the one with the largest share of its words.

The model is fitted on the driver from a bounded sample of labelled documents
and sent to the tasks, each of which labels whole texts, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import words_of
from shelfsight.operators.topk import first_n

UNKNOWN = "und"
MOST_CACHED = 200_000
UNIT_WORDS = 300_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _core(word: str) -> str:
    """Letters of a lower-case word, with inner hyphens and apostrophes; empty without a letter."""
    if word.isalpha():
        return word
    core = "".join(ch for ch in word if ch.isalpha() or ch in "'-")
    return core if any(ch.isalpha() for ch in core) else ""


def _features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hashed feature) of all features of the words: n-grams of the framed word, affixes, the word itself.

    A feature's hash is that of its characters and its kind. Works on the code
    points of all words at once.
    """
    framed = ["^" + c + "$" if c else "" for c in map(_core, words)]
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in framed], np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(begin + size, size) - np.arange(len(code))  # characters from here to the end of the word

    def mix(x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind)) * _MUL
        x ^= x >> np.uint64(29)
        return (x * _MUL) >> np.uint64(64 - bits)

    owners, hashes = [], []
    pair = code[:-1] * _MUL + code[1:] if len(code) else code
    triple = pair[:-1] * _MUL + code[2:] if len(code) > 1 else code[:0]
    for kind, grams, n in ((2, pair, 2), (3, triple, 3)):
        at = np.flatnonzero(left[: len(grams)] >= n)
        owners.append(owner[at])
        hashes.append(mix(grams[at], kind))
    some = np.flatnonzero(size)
    first, last = begin[some] + 1, begin[some] + size[some] - 2
    for n in (1, 2, 3):
        long = size[some] >= n + 2
        pre, suf = np.zeros(int(long.sum()), np.uint64), np.zeros(int(long.sum()), np.uint64)
        for k in range(n):
            pre = pre * _MUL + code[first[long] + k]
            suf = suf * _MUL + code[last[long] - k]
        owners += [some[long], some[long]]
        hashes += [mix(pre, 10 + n), mix(suf, 20 + n)]
    if len(some):
        power = np.cumprod(np.full(int(size.max()), _MUL, np.uint64))
        place = np.arange(len(code)) - np.repeat(begin, size)
        owners.append(some)
        hashes.append(mix(np.add.reduceat(code * power[place], begin[some]), 30))
    return np.concatenate(owners), np.concatenate(hashes).astype(np.int64)


class _Words(dict):
    """Numbers of words, and a table of their scores per language that follows in steps; forgotten when too many."""

    def __init__(self, model: ChainModel):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.scores = np.zeros((0, len(self.model.labels)), np.float32)
        self.letters = np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def follow(self) -> None:
        """Score the words that came in since the last call."""
        if not self.new:
            return
        owner, idx = _features(self.new, self.model.bits)
        n = len(self.new)
        counts = np.bincount(owner, minlength=n)
        sums = [np.bincount(owner, self.model.weights[idx, k], minlength=n) for k in range(len(self.model.labels))]
        scores = np.stack(sums, axis=1) / np.sqrt(np.maximum(1, counts))[:, None]
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
        self.letters = np.concatenate([self.letters, counts > 0])
        self.new = []


@dataclass
class ChainModel:
    """Languages, hashed feature weights (2^bits x languages), and log scores of first words and transitions."""

    labels: list[str]
    bits: int = 16
    weights: np.ndarray = field(default=None)  # type: ignore[assignment]
    start: np.ndarray = field(default=None)  # type: ignore[assignment]
    move: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self):
        n = len(self.labels)
        if self.weights is None:
            self.weights = np.zeros((1 << self.bits, n), np.float32)
            self.start, self.move = np.zeros(n), np.zeros((n, n))


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Posteriors of every place of many chains, laid end to end in ``scores``; optionally expected transitions.

    Chains advance together, longest first, so a step is one small product over
    all chains that still go on. Rows of the result stand as in ``scores``.
    """
    order = np.argsort(-lengths, kind="stable")
    lens, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # chains longer than t
    offset = np.concatenate([[0], np.cumsum(active)])
    chain = np.arange(offset[-1]) - np.repeat(offset[:-1], active)
    rows = begin[chain] + np.repeat(np.arange(steps), active)  # time-major place of every row
    e = scores[rows]
    e = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
    m, first = np.exp(move - move.max()), np.exp(start - start.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = None
    for t in range(steps):
        lo, hi = offset[t], offset[t + 1]
        a = e[lo:hi] * (first if t == 0 else a[: hi - lo] @ m)
        a /= a.sum(axis=1, keepdims=True)
        alpha[lo:hi] = a
    for t in range(steps - 2, -1, -1):
        lo, hi, n = offset[t], offset[t + 1], active[t + 1]
        b = (beta[hi: hi + n] * e[hi: hi + n]) @ m.T
        beta[lo: lo + n] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    out = np.empty_like(post)
    out[rows] = post
    if not pairs:
        return out
    expected = np.zeros_like(m)
    for t in range(steps - 1):
        lo, hi, n = offset[t], offset[t + 1], active[t + 1]
        x = alpha[lo: lo + n, :, None] * m[None] * (beta[hi: hi + n] * e[hi: hi + n])[:, None, :]
        expected += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return out, expected


def train_chain(
    pieces: list[tuple[str, list[str]]], bits: int = 16, epochs: int = 5, rate: float = 0.3, seed: int = 7, length: int = 80
) -> ChainModel:
    """Fit by stochastic gradient on the log likelihood, with adaptive rates.

    ``pieces``: (language, words) from labelled documents. They are shuffled and
    chained to sequences of about ``length`` words. No pieces: a model without
    languages.
    """
    model = ChainModel(sorted({lang for lang, _ in pieces}), bits)
    if not pieces:
        return model
    rng, of = np.random.default_rng(seed), {x: i for i, x in enumerate(model.labels)}
    vocabulary: dict[str, int] = {}
    coded = [(of[lang], np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for w in words], np.int64)) for lang, words in pieces if words]
    owners, hashed = _features(list(vocabulary), bits)
    counts = np.bincount(owners, minlength=len(vocabulary))
    flat, first = hashed[np.argsort(owners, kind="stable")], np.cumsum(counts) - counts
    scale = 1 / np.sqrt(np.maximum(1, counts))
    sums = [np.full_like(x, 1e-2, dtype=np.float64) for x in (model.weights, model.start, model.move)]
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        chains, now = [], []
        for k in order:
            label, words = coded[k]
            cut = int(rng.integers(1, len(words) + 1)) if rng.random() < 0.5 else len(words)
            now.append((np.full(cut, label), words[:cut]))
            if sum(len(x) for _, x in now) >= length:
                chains.append(now)
                now = []
        chains += [now] if now else []
        for i in range(0, len(chains), 32):
            batch = chains[i: i + 32]
            y = np.concatenate([lab for c in batch for lab, _ in c])
            w = np.concatenate([x for c in batch for _, x in c])
            lengths = np.array([sum(len(x) for _, x in c) for c in batch])
            used, row = np.unique(w, return_inverse=True)
            n = counts[used]
            at = np.repeat(first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            idx, owner = flat[at], np.repeat(np.arange(len(used)), n)
            table = np.zeros((len(used), len(model.labels)))
            np.add.at(table, owner, model.weights[idx])
            table *= scale[used][:, None]
            post, expected = forward_backward(table[row], lengths, model.start, model.move, pairs=True)
            error = -post
            error[np.arange(len(y)), y] += 1
            by_word = np.zeros_like(table)
            np.add.at(by_word, row, error)
            by_word *= scale[used][:, None]
            places, where = np.unique(idx, return_inverse=True)
            grad = np.zeros((len(places), len(model.labels)))
            np.add.at(grad, where, by_word[owner])
            ends = np.cumsum(lengths)
            begins = ends - lengths
            inner = np.ones(len(y), bool)
            inner[begins] = False
            seen = np.zeros_like(model.move)
            np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            sums[0][places] += grad**2
            model.weights[places] += rate * grad / np.sqrt(sums[0][places])
            for j, (param, g) in enumerate(((model.start, error[begins].sum(axis=0)), (model.move, seen - expected)), 1):
                sums[j] += g**2
                param += rate * g / np.sqrt(sums[j])
    return model


LEAST_PER_LABEL = 5


def training_pieces(
    docs: DataFrame, label: str, id_col: str, text: str, per_label: int = 400, per_doc: int = 3, words: int = 40,
    most: int = 20_000,
) -> list[tuple[str, list[str]]]:
    """At most ``per_label`` documents of each label by hashed id, ``per_doc`` runs of ``words`` words from places all over each.

    Ids are chosen first, from two columns, and broadcast; only those documents'
    texts are cut. With many labels each has an equal share of ``most``, but
    never less than ``LEAST_PER_LABEL`` documents: no label is left out.
    """
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    n_labels = labelled.select(label).distinct().count()
    per_label = min(per_label, max(LEAST_PER_LABEL, most // max(1, n_labels)))
    ids = first_n(labelled.select(id_col, label), [label], order, per_label).distinct()
    tokens = labelled.join(F.broadcast(ids), [id_col, label]).select(
        F.col(label).alias("label"), F.col(id_col).alias("id"), words_of(F.col(text)).alias("w")
    )
    span = F.greatest(F.size("w") - words, F.lit(0))
    parts = tokens.filter(F.size("w") > 0).select(
        "label", "id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(per_doc - 1)),
                lambda k: F.slice("w", F.lit(1) + F.pmod(F.xxhash64("id", k), span + 1).cast("int"), F.lit(words)),
            )
        ).alias("words"),
    ).distinct()
    parts = first_n(parts, ["label"], [F.xxhash64("words")], per_label * per_doc)
    return sorted((r["label"], list(r["words"])) for r in parts.collect())


def train_language(docs: DataFrame, label: str = "lang", id_col: str = "doc_id", text: str = "text", **options) -> ChainModel:
    """Fit on the labelled rows of ``docs``; the sample bound is per_label * per_doc runs of words for each label."""
    sample = {k: options.pop(k) for k in ("per_label", "per_doc", "words", "most") if k in options}
    return train_chain(training_pieces(docs, label, id_col, text, **sample), **options)


def label_words(model: ChainModel, texts: Iterable[str | None]) -> Iterator[tuple[str, float, np.ndarray]]:
    """Per text: language, its share of the words, and the label number of every blank-separated word (-1: no letter)."""
    if not model.labels:
        yield from ((UNKNOWN, 0.0, np.zeros(0, np.int64)) for _ in texts)
        return
    cache = _Words(model)
    unit: list[list[int]] = []
    size = 0

    def decide():
        lengths = np.array([len(x) for x in unit], np.int64)
        rows = np.concatenate([np.array(x, np.int64) for x in unit]) if size else np.zeros(0, np.int64)
        cache.follow()
        scores, letters = cache.scores, cache.letters[rows]
        some = lengths > 0
        post = forward_backward(scores[rows], lengths[some], model.start, model.move) if size else np.zeros((0, len(model.labels)))
        post[~letters] = 0
        ends = np.cumsum(lengths)
        for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
            share = post[lo:hi].sum(axis=0)
            if not letters[lo:hi].any():
                yield UNKNOWN, 0.0, np.full(hi - lo, -1)
                continue
            best = int(share.argmax())
            yield model.labels[best], float(min(1.0, share[best] / share.sum())), np.where(letters[lo:hi], post[lo:hi].argmax(axis=1), -1)

    for text in texts:
        unit.append([cache[w] for w in (text or "").lower().split()])
        size += len(unit[-1])
        if size >= UNIT_WORDS:
            yield from decide()
            unit, size = [], 0
            if len(cache) > MOST_CACHED:
                cache.forget()
    yield from decide()


def _runs(labels: list[str], marks: np.ndarray) -> list[dict]:
    """Runs of one language in word numbers, end exclusive; words without letters belong to the run before them."""
    out: list[dict] = []
    for i, mark in enumerate(marks.tolist()):
        if out and mark in (-1, out[-1]["_l"]):
            out[-1]["end"] = i + 1
        elif mark >= 0:
            out.append({"lang": labels[mark], "start": i, "end": i + 1, "_l": mark})
    return [{k: v for k, v in x.items() if k != "_l"} for x in out]


def identify_language(docs: DataFrame, model: ChainModel, text: str = "text", runs: bool = False) -> DataFrame:
    """Add lang_pred and lang_score, with ``runs`` also lang_runs: array of (lang, start, end) in words.

    lang_pred is the language with the largest expected share of the words that
    have a letter, lang_score that share. Null texts and texts without a letter
    are ``und`` with score 0; so is everything under a model without languages.
    Of equal shares the first language by name wins. Input columns with an
    output's name are replaced; rows and other columns stay as they are.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_runs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += ", lang_pred string, lang_score double"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    if runs:
        schema += ", lang_runs array<struct<lang:string,start:int,end:int>>"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = list(label_words(sent.value, (x.as_py() for x in batch.column(text))))
            batch = batch.append_column("lang_pred", pa.array([x[0] for x in got], pa.string()))
            batch = batch.append_column("lang_score", pa.array([x[1] for x in got], pa.float64()))
            if runs:
                batch = batch.append_column("lang_runs", pa.array([_runs(sent.value.labels, x[2]) for x in got], kind))
            yield batch

    return docs.mapInArrow(run, schema)

