"""Quality by co-training: a classifier of what a text says and one of where it stands.

The two views are fitted apart on labelled documents. In every round each view
labels the unlabelled documents it is surest of, and the other view learns from
them too. Their scores are calibrated on labelled documents kept aside, and a
last small regression on the two calibrated scores says how far each can be trusted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written
from shelfsight.llm.linear import Rows, TokenHasher, dense, newton, only, sigmoid, telling_features, telling_in_table
from shelfsight.operators.topk import first_n

SHAPE = ("words", "word_size", "symbols", "exclaims", "capitals", "letters", "repeated_lines", "line_words", "distinct", "ends")
BITS = 18
TEXT_CACHED = 150_000


def shape(text: str) -> list[float]:
    """How a text looks: SHAPE, all bounded or logarithmic; zeros without words."""
    words = text.split()
    if not words:
        return [0.0] * len(SHAPE)
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), sum(map(len, words))
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    return [
        np.log1p(n), min(30.0, chars / n), min(3.0, sum(map(text.count, "#*$%&|<>")) / n), min(3.0, text.count("!") / n),
        upper / max(1, letters), letters / chars, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        len(set(words)) / n, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines),
    ]


def metadata_tokens(columns: dict[str, Column]) -> Column:
    """``name=value`` of every column; a null value is a value of its own."""
    return F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in columns.items()])


@dataclass
class View:
    """A logistic regression on chosen hashed features and, in the text view, the shape of the text."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def matrix(self, rows: Rows, shapes: np.ndarray) -> np.ndarray:
        scaled = np.clip((shapes - self.mean) / self.spread, -6, 6)
        return np.concatenate([dense(rows, self.features), scaled, scaled**2 / 6], axis=1)

    def odds(self, rows: Rows, shapes: np.ndarray) -> np.ndarray:
        return self.slope * (self.matrix(rows, shapes) @ self.weights + self.bias) + self.shift


def _fit_view(rows: list[list[int]], shapes: np.ndarray, labels: np.ndarray, share: np.ndarray, least: float) -> View:
    sparse = Rows(rows)
    spread = shapes.std(axis=0) if len(shapes) else np.ones(shapes.shape[1])
    mean = shapes.mean(axis=0) if len(shapes) else np.zeros(shapes.shape[1])
    view = View(telling_features(sparse, (labels > 0.5).astype(float), 1 << BITS, least), np.zeros(0), 0.0, mean, np.maximum(spread, 1e-3))
    view.weights, view.bias = newton(view.matrix(sparse, shapes), labels, l2=2.0, share=share)
    return view


@dataclass
class CoModel:
    """Both views, and the regression on their calibrated log odds."""

    text: View
    meta: View
    joint: np.ndarray
    bias: float

    def join(self, text_odds: np.ndarray, meta_rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p_text, p_meta and their joint score."""
        meta_odds = self.meta.odds(Rows(meta_rows), np.zeros((len(meta_rows), 0)))
        both = np.clip(np.stack([text_odds, meta_odds], axis=1), -8, 8)
        return sigmoid(text_odds), sigmoid(meta_odds), sigmoid(both @ self.joint + self.bias)


def _calibrated(views: dict[str, View], raw: dict[str, np.ndarray], y: np.ndarray) -> CoModel:
    """The two scores are calibrated, then weighed against each other, on rows ``y`` neither view has learned from."""
    told = []
    for name, view in views.items():
        slope, shift = newton(np.clip(raw[name], -8, 8)[:, None], y, l2=0.1)
        if slope[0] > 0:
            view.slope, view.shift = float(slope[0]), float(shift)
        elif len(y):  # no better than chance: the share of good documents for all
            rate = min(1 - 1e-3, max(1e-3, float(y.mean())))
            view.slope, view.shift = 0.0, float(np.log(rate / (1 - rate)))
        told.append(np.clip(view.slope * raw[name] + view.shift, -8, 8))
    joint, bias = newton(np.stack(told, axis=1), y, l2=0.1)
    if not len(y) or y.min() == y.max() or joint[0] <= 0:
        joint, bias = np.array([1.0, 0.0]), 0.0
    return CoModel(views["text"], views["meta"], np.maximum(joint, 0.0), bias)


def _text_view(hasher: TokenHasher, texts: list[str | None]) -> tuple[list[list[int]], np.ndarray]:
    whole = [x or "" for x in texts]
    return [hasher.of(x) for x in whole], np.array([shape(x) for x in whole], float).reshape(-1, len(SHAPE))


def _meta_view(hasher: TokenHasher, tokens: list[list[str] | None]) -> list[list[int]]:
    return [sorted({f for t in row or [] for f in hasher[t]}) for row in tokens]


def _odds_by_row(rows: DataFrame, view: View, features: str, shape: str | None, keep: list[str], name: str) -> DataFrame:
    """``keep`` and the view's log odds, computed where the rows are."""
    sent = rows.sparkSession.sparkContext.broadcast(view)

    def run(batches):
        view = sent.value
        table = np.zeros(1 << BITS)
        table[view.features] = view.weights[: len(view.features)]
        for batch in batches:
            column = batch.column("_f")
            lengths = np.diff(column.offsets.to_numpy())
            owner = np.repeat(np.arange(len(batch)), lengths)
            odds = np.bincount(owner, table[column.flatten().to_numpy()], minlength=len(batch)) + view.bias
            if shape:
                looks = batch.column("_s").flatten().to_numpy().reshape(len(batch), -1)
                scaled = np.clip((looks - view.mean) / view.spread, -6, 6)
                odds = odds + np.concatenate([scaled, scaled**2 / 6], axis=1) @ view.weights[len(view.features):]
            columns = [batch.column(c) for c in keep] + [pa.array(view.slope * odds + view.shift)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, name])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"{name} double"])
    looks = [F.col(shape).alias("_s")] if shape else []
    return rows.select(*keep, F.col(features).alias("_f"), *looks).mapInArrow(run, schema)


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the text view's features in place of the text, written once for all that reads them.

    ``_row`` numbers the rows, ``_rows`` holds feature numbers, ``_shape`` the look
    of the text. Null texts count as empty.
    """
    others = [f for f in docs.schema.fields if f.name not in (text, "meta", "_row", "_rows", "_shape")]

    def text_part(batches):
        hasher = TokenHasher(BITS, most=TEXT_CACHED)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, len(batch), 500):
                piece = batch.slice(i, 500)
                rows, shapes = _text_view(hasher, piece.column(text).to_pylist())
                piece = piece.drop_columns([text]).append_column("_row", pa.array(range(at, at + len(piece)), pa.int64()))
                at += len(piece)
                piece = piece.append_column("_rows", pa.array(rows, pa.list_(pa.int32())))
                yield piece.append_column("_shape", pa.array(list(shapes), pa.list_(pa.float64())))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    made = docs.select(*[f.name for f in others], text).mapInArrow(text_part, f"{columns}, _row long, _rows array<int>, _shape array<double>")
    return written(made, "quality-texts")


def _surest(free: DataFrame, odds: str, most: int, sure: float) -> Column:
    """1, 0 or null: whether a row is among the ``most`` surest of a class. Of rows as sure as the last one a share by hash."""
    level = F.round(F.col(odds), 3)
    counts = sorted((r["level"], r["n"]) for r in free.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect())
    least = float(np.log(sure / (1 - sure)))
    luck = F.pmod(F.xxhash64("_key", "_row"), F.lit(1 << 20)) / float(1 << 20)
    told = F.lit(None).cast("int")
    for label, sign, ranked in ((1, 1, counts[::-1]), (0, -1, counts)):
        left, cut, share = most, None, 1.0
        for value, n in ranked:
            if sign * value < least or not left:
                break
            cut, share, left = value, min(1.0, left / n), max(0, left - n)
        if cut is not None:
            inside = (level * sign > cut * sign) | ((level == cut) & (luck < share))
            told = F.when(inside, label).otherwise(told)
    return told


def train_quality(
    docs: DataFrame, labels: DataFrame, add_meta: Callable[[DataFrame], DataFrame], label: str = "quality", id_col: str = "doc_id",
    text: str = "text", sample: int = 6000, unlabelled: int = 6000, rounds: int = 4, each: float = 0.05, sure: float = 0.95,
    least: float = 25.0, seed: int = 3,
) -> CoModel:
    """Fit both views; in each of ``rounds`` every unlabelled document is scored by both, and each view teaches the other.

    ``docs`` may also be what ``text_features`` made of them. A quarter of the
    labelled documents is kept for calibration. The surest share ``each`` per class of all unlabelled documents is passed on, if
    a view gives them at least ``sure``, with half the weight of a label; a document both views
    pass on with different labels goes to neither. Without labels of both classes
    the scores are constant. Repeated rows count as often as they occur.
    Only what is fitted is bounded: ``sample`` labelled documents and, per view,
    ``unlabelled`` of the passed-on ones, by hashed id. The features of the text
    view are chosen anew in every round by counts over these rows, and only the
    chosen ones reach the driver. ``add_meta`` adds ``meta``, an array of
    name=value strings, to documents without their text. A document with both
    labels counts as good; null labels do not count.
    """
    def meta_part(batches):
        hasher = TokenHasher(BITS, ())
        for batch in batches:
            meta = _meta_view(hasher, batch.column("meta").to_pylist())
            yield batch.drop_columns(["meta"]).append_column("_meta", pa.array(meta, pa.list_(pa.int32())))

    texts = docs if "_rows" in docs.columns else text_features(docs, text)

    named = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_named")).agg(F.max(label).cast("int").alias("_label"))
    chosen = named.orderBy(F.xxhash64(F.col("_named").cast("string")), "_named").limit(sample).select(F.col("_named").alias("_id"), "_label")
    state = add_meta(texts.drop("_rows", "_shape")).select("_row", F.col(id_col).alias("_key"), "meta")
    state = state.join(named.select("_named"), F.col("_key") == F.col("_named"), "left")
    state = state.join(F.broadcast(chosen), F.col("_key") == F.col("_id"), "left").filter("_named is null or _label is not null")
    state = state.select("_row", F.xxhash64(F.col("_key").cast("string")).alias("_key"), "_label", "meta")
    state = state.mapInArrow(meta_part, "_row long, _key long, _label int, _meta array<int>")
    for view in ("text", "meta"):
        state = state.withColumn(f"_for_{view}", F.lit(None).cast("int"))
    state = written(state, "quality-rows")

    aside = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(4)) == 0
    known = state.filter("_label is not null").orderBy("_key", "_row").limit(sample).withColumn("_aside", aside)
    known = known.select("_row", "_label", "_aside", "_meta")
    known = written(texts.select("_row", "_rows", "_shape").join(F.broadcast(known), "_row"), "quality-labelled")
    taught = known.filter(~F.col("_aside")).select("_row", F.col("_label").alias("_y"), F.lit(1.0).alias("_share"), "_rows", "_shape", "_meta")

    def passed_on(view: str) -> DataFrame:
        name = f"_for_{view}"
        rows = first_n(state.filter(F.col(name).isNotNull()), [name], ["_key", "_row"], max(1, unlabelled // 2))
        return rows.select("_row", F.col(name).alias("_y"), F.lit(0.5).alias("_share"), "_meta")

    def fit(view: str, more: bool) -> View:
        if view == "text":
            rows = taught.drop("_meta")
            if more:
                extra = passed_on(view).drop("_meta")
                rows = rows.unionByName(texts.select("_row", "_rows", "_shape").join(F.broadcast(extra), "_row"))
            rows = written(rows, "quality-sample")
            rows = rows.withColumn("_rows", only("_rows", telling_in_table(rows, "_rows", "_y", least)))
        else:
            rows = taught.select("_row", "_y", "_share", F.col("_meta").alias("_rows"))
            rows = rows.unionByName(passed_on(view).withColumnRenamed("_meta", "_rows")) if more else rows
        got = rows.orderBy("_row", "_share").toArrow()
        looks = np.array(got.column("_shape").to_pylist(), float).reshape(-1, len(SHAPE)) if view == "text" else np.zeros((len(got), 0))
        y, share = (np.array(got.column(c).to_pylist(), float) for c in ("_y", "_share"))
        return _fit_view(got.column("_rows").to_pylist(), looks, y, share, least)

    views = {view: fit(view, False) for view in ("text", "meta")}
    both = taught.select("_y").distinct().count() == 2
    free = state.filter("_label is null").count() if both and rounds else 0
    most, before = max(1, int(each * free)), {"text": 0, "meta": 0}
    for _ in range(rounds if free else 0):
        odds = _odds_by_row(texts, views["text"], "_rows", "_shape", ["_row"], "_text_odds")
        held = ["_row", "_key", "_label", "_meta", "_for_text", "_for_meta"]
        scored = _odds_by_row(state.filter("_label is null"), views["meta"], "_meta", None, held, "_meta_odds")
        scored = written(scored.join(odds, "_row"), "quality-round")
        for_text, for_meta = _surest(scored, "_meta_odds", most, sure), _surest(scored, "_text_odds", most, sure)
        told = scored.withColumns({"_t": for_text, "_m": for_meta})
        agree = F.coalesce(F.col("_t") == F.col("_m"), F.lit(True))
        state = told.select(
            "_row", "_key", "_label", "_meta", F.coalesce("_for_text", F.when(agree, F.col("_t"))).alias("_for_text"),
            F.coalesce("_for_meta", F.when(agree, F.col("_m"))).alias("_for_meta"),
        )
        after = state.agg(F.count("_for_text").alias("text"), F.count("_for_meta").alias("meta")).first().asDict()
        if after == before:
            break
        before = after
        views = {view: fit(view, True) for view in views}

    kept = known.filter("_aside")
    raw = _odds_by_row(kept, views["text"], "_rows", "_shape", ["_row", "_label", "_meta"], "_text_odds")
    got = _odds_by_row(raw, views["meta"], "_meta", None, ["_row", "_label", "_text_odds"], "_meta_odds").orderBy("_row").toArrow()
    column = lambda c: np.array(got.column(c).to_pylist(), float)
    return _calibrated(views, {"text": column("_text_odds"), "meta": column("_meta_odds")}, column("_label"))


def score_quality_views(
    docs: DataFrame, model: CoModel, add_meta: Callable[[DataFrame], DataFrame], text: str = "text", cut: float = 0.5
) -> DataFrame:
    """All columns but the text, with meta, p_text, p_meta, score and kept (score from ``cut``).

    ``docs`` may also be what ``text_features`` made of them, so that no text is
    read twice. Texts are scored where they lie, and only then metadata is joined.
    Null texts count as empty; null metadata is a value of its own. Columns with an
    output's name are replaced. No rows give no rows.
    """
    docs = docs.drop("p_text", "p_meta", "score", "kept", "meta")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def meta_part(batches):
        hasher = TokenHasher(BITS, ())
        for batch in batches:
            meta = _meta_view(hasher, batch.column("meta").to_pylist())
            made = sent.value.join(batch.column("_odds").to_numpy(), meta)
            batch = batch.drop_columns(["_odds"])
            for name, x in zip(("p_text", "p_meta", "score"), made, strict=True):
                batch = batch.append_column(name, pa.array(x, pa.float64()))
            yield batch.append_column("kept", pa.array(made[2] >= cut))

    texts = docs if "_rows" in docs.columns else text_features(docs, text)
    keep = [c for c in texts.columns if c not in ("_row", "_rows", "_shape")]
    both = add_meta(_odds_by_row(texts, model.text, "_rows", "_shape", keep, "_odds"))
    return both.mapInArrow(meta_part, columns(both.drop("_odds")) + ", p_text double, p_meta double, score double, kept boolean")


def page_metadata(docs: DataFrame, pages: DataFrame, length: str = "length") -> DataFrame:
    """Add ``meta``: source, language, size class, and host, scheme, path and query of the page with the document's id.

    Documents without a page have nulls for it. Of pages that share an id the
    first by address counts. Only addresses are joined, not page bodies.
    """
    url = F.col("_url")
    address = pages.groupBy(F.col("page_id").alias("_page")).agg(F.min("url").alias("_url"))
    joined = docs.join(address, F.col("doc_id") == F.col("_page"), "left")
    return joined.withColumn(
        "meta",
        metadata_tokens({
            "source": F.col("source"), "lang": F.col("lang"), "size": F.floor(F.log2(F.coalesce(F.col(length), F.lit(0)) + 1)),
            "host": F.regexp_extract(url, r"^\w+://([^/?#]+)", 1), "scheme": F.regexp_extract(url, r"^(\w+)://", 1),
            "depth": F.size(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")), "query": url.contains("?"),
        }),
    ).drop("_page", "_url")
