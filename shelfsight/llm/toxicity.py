"""Toxicity: a classifier whose scores do not move when identity terms are swapped.

In labelled texts that mention a group, the term is swapped for others and for a
neutral word. The loss adds the squared difference between the log odds of a text
and of its swapped form, so a term cannot carry weight of its own however often
it stands in texts labelled toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written
from shelfsight.llm.linear import Rows, TokenHasher, dense, newton, only, sigmoid, telling_features, telling_in_table

# Terms for groups of people, and neutral words that may stand in their place. One word each.
IDENTITY_TERMS = (
    "asian", "atheist", "atheists", "bisexual", "black", "blind", "buddhist", "catholic", "christian", "christians",
    "deaf", "disabled", "elderly", "female", "females", "gay", "hindu", "immigrant", "immigrants", "jew", "jewish",
    "jews", "latino", "lesbian", "male", "males", "man", "men", "mexican", "muslim", "muslims", "old", "queer",
    "refugee", "refugees", "straight", "trans", "transgender", "white", "woman", "women", "young",
)
NEUTRAL_TERMS = ("person", "people")


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    bits: int


def _swaps(
    found: list[int], terms: list[tuple[int, ...]], others: list[tuple[int, ...]], rng: np.random.Generator, each: int
) -> list[list[int]]:
    """Up to ``each`` forms of a row in which its identity terms give way to one other term."""
    there = set(found)
    present = [x for x in terms if x[0] in there]
    choices = [x for x in others if x not in present]
    if not present or not choices:
        return []
    rest = there.difference(*present)
    picked = rng.choice(len(choices), min(each, len(choices)), replace=False)
    return [sorted(rest.union(choices[i])) for i in picked]


def _unlike(rows: list[list[int]], labels: list[int]) -> tuple[list[list[int]], list[int]]:
    """Without rows equal to an earlier one in features and label."""
    once = {(tuple(r), y): None for r, y in zip(rows, labels, strict=True)}
    return [list(r) for r, _ in once], [y for _, y in once]


def fit_toxicity(texts: list[str | None], labels: list[int], bits: int = 18, least: float = 25.0, **options) -> ToxicityModel:
    """Fit on labelled texts; see ``fit_toxicity_rows``."""
    hasher = TokenHasher(bits)
    rows, labels = _unlike([hasher.of(x) for x in texts], labels)
    chosen = telling_features(Rows(rows), np.array(labels, float), 1 << bits, least)
    return fit_toxicity_rows(rows, labels, chosen.tolist(), bits, **options)


def fit_toxicity_rows(
    rows: list[list[int]], labels: list[int], chosen: list[int], bits: int = 18, penalty: float = 1.0, swaps: int = 3, seed: int = 5,
    terms: tuple[str, ...] = IDENTITY_TERMS, neutral: tuple[str, ...] = NEUTRAL_TERMS,
) -> ToxicityModel:
    """Fit on rows of feature numbers.

    The classifier reads the ``chosen`` features, and all identity terms where
    any occurs. ``penalty`` 0 is a plain classifier. No rows: a score of one half
    for all.
    """
    hasher, rng = TokenHasher(bits), np.random.default_rng(seed)
    groups = [hasher[x] for x in terms]
    others = groups + [hasher[x] for x in neutral]
    swapped, made_from = [], []
    for i, found in enumerate(rows):
        for form in _swaps(found, groups, others, rng, swaps):
            swapped.append(form)
            made_from.append(i)
    sparse, marks = Rows(rows), np.array(labels, float)
    used = np.unique([*chosen, *(f for x in groups for f in x if swapped)]).astype(np.int64)
    gaps = dense(sparse, used)[made_from] - dense(Rows(swapped), used) if swapped else None
    picked, bias = newton(dense(sparse, used), marks, gaps=gaps, penalty=penalty)
    weights = np.zeros(1 << bits)
    weights[used] = picked
    return ToxicityModel(weights, bias, bits)


def hashed_rows(docs: DataFrame, text: str, bits: int, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``features``: array of distinct feature numbers of the whole text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        hasher = TokenHasher(bits)
        for batch in batches:
            made = pa.array([hasher.of(x.as_py()) for x in batch.column(text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], [*keep, "features"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "features array<int>"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """The labelled documents with the ``most`` first ids by hash. Ids come from the labels alone, and at most ``most`` are broadcast."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = (
        labels.filter(F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(order, id_col).limit(most)
    )
    return docs.join(F.broadcast(chosen), id_col)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text",
    sample: int = 12_000, bits: int = 18, least: float = 25.0, **options,
) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents, of equal ones (by hash of their features) one.

    A document with both labels counts as toxic; null labels do not count. Only
    telling features and identity terms of the sample reach the driver.
    """
    chosen = labelled_sample(docs.select(id_col, text), labels.select(id_col, label), label, id_col, sample)
    rows = hashed_rows(chosen, text, bits, ["_label"])
    rows = rows.groupBy("_label", F.xxhash64("features").alias("_h")).agg(F.first("features").alias("features"))
    rows = written(rows, "toxicity-sample")
    telling = telling_in_table(rows, "features", "_label", least)
    hasher = TokenHasher(bits)
    terms = {f for x in (*IDENTITY_TERMS, *options.get("terms", ())) for f in hasher[x]}
    got = rows.select("_label", only("features", [*telling, *terms]).alias("f")).orderBy("_h").limit(sample).collect()
    return fit_toxicity_rows([sorted(r["f"]) for r in got], [r["_label"] for r in got], telling, bits, **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", cut: float = 0.3) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``cut``). A null text scores like an empty one.

    Whole texts are read where they lie; no shuffle. Input columns with an
    output's name are replaced, all others stay.
    """
    docs = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        hasher = TokenHasher(model.bits)
        for batch in batches:
            odds = np.array([model.weights[hasher.of(x.as_py())].sum() for x in batch.column(text)], float) + model.bias
            score = sigmoid(odds)
            batch = batch.append_column("score", pa.array(score, pa.float64()))
            yield batch.append_column("predicted", pa.array((score >= cut).astype(np.int32)))

    return docs.mapInArrow(run, schema + ", score double, predicted int")
