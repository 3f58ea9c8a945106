"""Quality rules under weak supervision, in DataFrame expressions only.

Each rule votes for or against a text or abstains. Nobody labels anything:
expectation-maximisation over the vote patterns estimates how often each rule
votes against good and against bad texts, and the posterior probability of a
good text takes the place of "all rules must pass".

The corpus meets the fit as counts per vote pattern, at most 3^rules rows at any
corpus size. Per text everything is one row-local expression: no shuffle but
that of the pattern counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.binding import with_once
from shelfsight.llm.common import SEPARATORS, whole_text, words_of, written

PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]?(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good), -1 (bad) or 0 (abstains) on the statistics of a text."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return (
            F.when(F.coalesce(self.bad, F.lit(False)), -1)
            .when(F.coalesce(self.good, F.lit(False)), 1)
            .otherwise(0)
            .alias(self.name)
        )


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def default_rules() -> list[Rule]:
    words, lines = F.col("n_words"), F.col("n_lines")
    size = _share("word_chars", "n_words")
    symbols, shouts = _share("n_symbols", "n_words"), _share("n_exclaims", "n_words")
    repeats, dups = _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    upper, letters = _share("n_upper", "n_letters"), _share("n_letters", "word_chars")
    plain = _share("n_plain_words", "n_words")
    return [
        Rule("v_length", words >= 80, words < 20),
        Rule("v_word_size", size.between(3, 9), (size < 2) | (size > 14)),
        Rule("v_symbols", symbols <= 0.02, symbols > 0.1),
        Rule("v_exclaims", shouts <= 0.05, shouts > 0.25),
        Rule("v_repeats", repeats <= 0.15, repeats > 0.35),
        Rule("v_dup_lines", (lines >= 2) & (dups <= 0.1), (lines >= 2) & (dups > 0.3)),
        Rule("v_upper", upper <= 0.2, upper > 0.5),
        Rule("v_letters", letters >= 0.85, letters < 0.75),
        Rule("v_plain", plain >= 0.9, plain < 0.6),
    ]


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read; ``text`` itself is dropped.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines,
    n_repeat_words, n_lines (lines with a word), n_letters, n_upper, n_exclaims
    and n_plain_words (letters with at most one mark behind them), all long. A null or empty text has zero everywhere. Words in three-word
    windows that occur twice or more count once each, the first occurrence
    included: windows are sorted by a 64-bit hash with their positions, equal
    neighbours are repeats, and a repeat adds up to three words.
    """
    one = docs.withColumn("_text", whole_text(F.col(text))).drop(text)
    one = with_once(one, "_words", words_of(F.col("_text")))
    one = with_once(one, "_lines", F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, SEPARATORS, "") != ""))
    n = F.size("_words")
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    one = with_once(one, "_sorted", F.sort_array(windows))
    same = lambda s, k: F.coalesce(F.get("_sorted", k)["h"] == s["h"], F.lit(False))
    one = with_once(
        one, "_at",
        F.sort_array(F.transform(F.filter("_sorted", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"])),
    )
    added = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3))).cast("long"))
    count = lambda pattern: F.length(F.regexp_replace("_text", pattern, "")).cast("long")
    return one.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": count(SEPARATORS),
            "n_symbols": count(r"[^#*$%&|<>]+"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x),
            "n_lines": F.size("_lines").cast("long"),
            "n_letters": count(r"[^\p{L}]+"),
            "n_upper": count(r"[^\p{Lu}]+"),
            "n_exclaims": count(r"[^!]+"),
            "n_plain_words": F.regexp_count("_text", F.lit(PLAIN_WORD)).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_sorted", "_at")


@dataclass(frozen=True)
class RuleModel:
    """P(good), and per rule how often it votes against bad and against good texts."""

    prior: float
    hits: dict[str, float]
    alarms: dict[str, float]

    def log_odds(self) -> Column:
        """Log odds of a good text given its votes."""
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, hit in self.hits.items():
            alarm = self.alarms[name]
            out = out + (
                F.when(F.col(name) == -1, math.log(alarm / hit))
                .when(F.col(name) == 1, math.log((1 - alarm) / (1 - hit)))
                .otherwise(0.0)
            )
        return out

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def fit_rules(votes: DataFrame, names: list[str], rounds: int = 15, prior_share: float = 0.01) -> RuleModel:
    """Expectation-maximisation over vote counts.

    The prior weighs ``prior_share`` of the corpus, so the fit behaves alike at
    every size; it also fixes which class is the good one. Rates stay within
    bounds that keep "votes against bad texts more often than against good ones"
    true. An empty table gives the prior itself.
    """
    model = RuleModel(0.85, dict.fromkeys(names, 0.35), dict.fromkeys(names, 0.02))
    patterns = written(votes.groupBy(*names).agg(F.count("*").alias("_n")), "vote-patterns").coalesce(1)
    for _ in range(rounds):
        good, n = F.col("_p") * F.col("_n"), F.col("_n")
        sums = [F.sum(n).alias("all"), F.sum(good).alias("good")]
        for name in names:
            cast, against = F.col(name) != 0, F.col(name) == -1
            for label, weight in (("good", good), ("bad", n - good)):
                sums.append(F.sum(F.when(cast, weight).otherwise(0.0)).alias(f"{name}_{label}"))
                sums.append(F.sum(F.when(against, weight).otherwise(0.0)).alias(f"{name}_{label}_against"))
        row = patterns.withColumn("_p", model.posterior()).agg(*sums).first()
        if not row["all"]:
            break
        weight = prior_share * row["all"]
        rate = lambda name, label, start: (
            (row[f"{name}_{label}_against"] + weight * start) / (row[f"{name}_{label}"] + weight)  # noqa: B023
        )
        model = RuleModel(
            min(0.98, max(0.5, (row["good"] + weight * 0.85) / (row["all"] + weight))),
            {x: min(0.95, max(0.1, rate(x, "bad", 0.35))) for x in names},
            {x: min(0.08, max(0.0005, rate(x, "good", 0.02))) for x in names},
        )
    return model


def score_quality(
    docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, keep_from: float = 0.5, rounds: int = 15
) -> DataFrame:
    """All columns but the text, the statistics, one vote column per rule, p_good, base_failed and kept.

    base_failed: under 50 words, or more than half of the words in repeated
    windows. kept: false if base_failed, else p_good >= ``keep_from``. Null and
    empty texts have no words and fail. Repeated rows are scored each; other
    columns pass through, except that a column with the name of an output is
    replaced.
    """
    rules = default_rules() if rules is None else rules
    names = [r.name for r in rules]
    made = written(text_statistics(docs, text), "text-statistics").withColumns({r.name: r.vote() for r in rules})
    model = fit_rules(made, names, rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        made.withColumn("p_good", model.posterior())
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_from))
    )
