"""Secret scans: fixed patterns, and formats learned from what the patterns find.

Values found by the patterns are labelled credentials. Per kind a prefix tree of
a sample of them, over classes of characters, is folded into a probabilistic
automaton by merging states whose outgoing frequencies agree. Every run of
characters outside those values and every part of it between joiners, with a
letter and a digit and as long as credentials are, is a candidate; it is a secret
if an automaton gives it about the likelihood it gives its own credentials,
relative to how likely such a run is in ordinary text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written
from shelfsight.operators.topk import first_n

# Fixed patterns. Letters of the assignment match in either case, ASCII only.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GRAMMAR = "grammar"
LONG = 16
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORTEST = 6  # no fixed pattern finds a shorter value
WITH_DIGIT = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+")  # whole runs that hold a digit
JOINERS = "=/.-"
SPLITS = [re.compile(f"[^{''.join(re.escape(c) for c in x)}]+") for n in range(1, 5) for x in combinations(JOINERS, n)]

END = "$"
_CLASSES = str.maketrans(
    {c: "d" for c in "0123456789"} | {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
    | {c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
)


def classes(value: str) -> str:
    """d digit, h a-f, l other lower-case letter, U capital; anything else is its own class."""
    return value.translate(_CLASSES)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, by start, then kind as listed. Code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    for run in RUN.finditer(text):  # a run of 24 hex digits lies in one of these
        if run.end() - run.start() >= 24:
            found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text, *run.span()) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def text_spans(text: str) -> tuple[list[tuple[str, int, int, str]], list[re.Match]]:
    """Spans of the fixed patterns, and the long runs that touch none of them."""
    base = base_spans(text)
    starts = [b[1] for b in base]
    ends = list(accumulate((b[2] for b in base), max))
    free = []
    for m in RUN.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            free.append(m)
    return base, free


def is_candidate(run: str) -> bool:
    """A letter and a digit."""
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def candidate_runs(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """What the fixed patterns leave of every run with a digit, where a candidate fits in."""
    out, k, taken = [], 0, 0
    spans = sorted((b[1], b[2]) for b in base)
    for m in WITH_DIGIT.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            out.append((max(at, taken), spans[k][0]))
            taken = max(taken, spans[k][1])
            k += 1
        out.append((max(at, taken), end))
    return [(s, e) for s, e in out if e - s >= SHORTEST and is_candidate(text[s:e])]


def parts_of(run: str) -> set[tuple[int, int]]:
    """The run and its parts between any choice of the joiners, each also without joiners at its ends."""
    found = {(0, len(run))}
    if any(c in run for c in JOINERS):
        found |= {m.span() for split in SPLITS for m in split.finditer(run)}
        for s, e in list(found):
            part = run[s:e]
            low = s + len(part) - len(part.lstrip(JOINERS))
            found |= {(low, e), (s, s + len(part.rstrip(JOINERS))), (low, max(low, s + len(part.rstrip(JOINERS))))}
    return found


@dataclass
class Automaton:
    """States with counts and targets per class of characters; state 0 is the start."""

    counts: list[Counter] = field(default_factory=lambda: [Counter()])
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    cut: float = 0.0
    shortest: int = LONG

    def add(self, word: str) -> None:
        at = 0
        for c in word:
            self.counts[at][c] += 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.counts)
                self.counts.append(Counter())
                self.next.append({})
            at = self.next[at][c]
        self.counts[at][END] += 1

    def _alike(self, a: int, b: int, alpha: float, least: int) -> bool:
        """Hoeffding's bound on every frequency of two states and of what follows them; rare states agree with all."""
        stack, looked = [(a, b)], set()
        spread = math.sqrt(0.5 * math.log(2 / alpha))
        while stack:
            pair = stack.pop()
            if pair in looked:
                continue
            looked.add(pair)
            x, y = (self.counts[s] for s in pair)
            n, m = x.total(), y.total()
            if n < least or m < least:
                continue
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for c in x.keys() | y.keys():
                if abs(x[c] / n - y[c] / m) > bound:
                    return False
                if c in self.next[pair[0]] and c in self.next[pair[1]]:
                    stack.append((self.next[pair[0]][c], self.next[pair[1]][c]))
        return True

    def _fold(self, into: int, state: int) -> None:
        stack = [(into, state)]
        while stack:
            a, b = stack.pop()
            if a == b:
                continue
            self.counts[a].update(self.counts[b])
            for c, target in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], target))
                else:
                    self.next[a][c] = target

    def merge(self, alpha: float, least: int) -> None:
        """Keep states that differ from all kept ones, fold the others into the first they agree with."""
        kept, turn = [0], 0
        waiting = [(0, c) for c in sorted(self.next[0])]
        while turn < len(waiting):
            source, c = waiting[turn]
            turn += 1
            state = self.next[source][c]
            if state in kept:
                continue
            for old in kept:
                if self._alike(old, state, alpha, least):
                    self.next[source][c] = old
                    self._fold(old, state)
                    known = {(s, x) for s, x in waiting}
                    waiting += [(k, x) for k in kept for x in sorted(self.next[k]) if (k, x) not in known and self.next[k][x] not in kept]
                    break
            else:
                kept.append(state)
                waiting += [(state, x) for x in sorted(self.next[state])]
        number = {s: i for i, s in enumerate(kept)}
        self.counts = [self.counts[s] for s in kept]
        self.next = [{c: number[t] for c, t in self.next[s].items() if t in number} for s in kept]

    def log_likelihood(self, word: str) -> float:
        """Per character; a class that a state has never seen has a small share of its mass."""
        at, out = 0, 0.0
        for c in word + END:
            seen = self.counts[at]
            out += math.log((seen[c] + 0.01) / (seen.total() + 0.1))
            at = self.next[at].get(c, at)
        return out / (len(word) + 1)


@dataclass
class Grammar:
    """One automaton per kind of credential, and how ordinary text follows one class by another."""

    automata: dict[str, Automaton]
    ordinary: dict[str, dict[str, float]]

    def plain(self, word: str) -> float:
        out, before = 0.0, "^"
        for c in word + END:
            out += self.ordinary.get(before, {}).get(c, math.log(1e-3))
            before = c
        return out / (len(word) + 1)

    def gain(self, kind: str, word: str) -> float:
        return self.automata[kind].log_likelihood(word) - self.plain(word)

    def accepts(self, value: str) -> bool:
        word = classes(value)
        return any(self.gain(kind, word) >= a.cut for kind, a in self.automata.items())

    def secrets(self, run: str) -> list[tuple[int, int]]:
        """Accepted parts of a run that do not overlap, those with the largest gain over their whole length first."""
        least = min((a.shortest for a in self.automata.values()), default=len(run) + 1)
        found = []
        for s, e in parts_of(run):
            if e - s < least or not is_candidate(run[s:e]):
                continue
            word = classes(run[s:e])
            gains = [self.gain(kind, word) for kind, a in self.automata.items() if e - s >= a.shortest and self.gain(kind, word) >= a.cut]
            if gains:
                found.append((-max(gains) * (e - s + 1), s, e))
        kept: list[tuple[int, int]] = []
        for _, s, e in sorted(found):
            i = bisect_left(kept, (s, e))
            if (not i or kept[i - 1][1] <= s) and (i == len(kept) or kept[i][0] >= e):
                kept.insert(i, (s, e))
        return kept


def infer_grammar(
    credentials: list[tuple[str, str]], ordinary: dict[tuple[str, str], int], alpha: float = 0.01, least: int = 30,
    quantile: float = 0.02, margin: float = 0.3,
) -> Grammar:
    """Automata from (kind, value) and counts of class pairs in ordinary runs.

    A kind with fewer than ``least`` credentials gets no automaton. An automaton
    accepts from the ``quantile`` of its own credentials' gains on, but never below ``margin``,
    and from that quantile of their lengths on, or from ``LONG`` if they are longer.
    """
    totals = Counter()
    for (a, _), n in ordinary.items():
        totals[a] += n
    pairs: dict[str, dict[str, float]] = {}
    for (a, b), n in ordinary.items():
        pairs.setdefault(a, {})[b] = math.log((n + 0.5) / (totals[a] + 5))
    grammar = Grammar({}, pairs)
    by_kind: dict[str, list[str]] = {}
    for kind, value in sorted(credentials):
        by_kind.setdefault(kind, []).append(classes(value))
    for kind, words in by_kind.items():
        if len(words) < least:
            continue
        grammar.automata[kind] = made = Automaton()
        for word in words:
            made.add(word)
        made.merge(alpha, least)
        gains = sorted(grammar.gain(kind, w) for w in words)
        made.cut = max(margin, gains[int(quantile * len(gains))])
        made.shortest = min(LONG, sorted(map(len, words))[int(quantile * len(words))])
    return grammar


SCAN = (
    "base array<struct<kind:string,start:int,end:int,value:string>>, "
    "runs array<struct<start:int,end:int,value:string>>, pairs map<string,int>"
)


def scan_texts(docs: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """``id_cols`` with base (spans of the fixed patterns), runs (what they leave of runs with a letter and a digit) and pairs (class pairs of long runs)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    span = [("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
    base_type, run_type = pa.list_(pa.struct([("kind", pa.string()), *span])), pa.list_(pa.struct(span))

    def one(text: str):
        base, free = text_spans(text)
        runs, pairs = [], Counter()
        for m in free:
            word = f"^{classes(m[0])}{END}"
            pairs.update(map("".join, zip(word, word[1:], strict=False)))
        runs += [{"start": s, "end": e, "value": text[s:e]} for s, e in candidate_runs(text, base)]
        return [dict(zip(("kind", "start", "end", "value"), b, strict=True)) for b in base], runs, list(pairs.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(x.as_py() or "") for x in batch.column(text)]
            columns = [batch.column(c) for c in id_cols] + [
                pa.array([g[0] for g in got], base_type), pa.array([g[1] for g in got], run_type),
                pa.array([g[2] for g in got], pa.map_(pa.string(), pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*id_cols, "base", "runs", "pairs"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in id_cols], SCAN])
    return docs.select(*id_cols, text).mapInArrow(run, schema)


def train_grammar(scanned: DataFrame, sample: int = 2000, longest: int = 200, **options) -> Grammar:
    """Fit on at most ``sample`` distinct credentials of each kind, of at most ``longest`` characters, by hash.

    Class pairs are counted over the whole corpus.
    """
    values = scanned.select(F.explode("base").alias("b")).select("b.kind", "b.value").filter(F.length("value") <= longest).distinct()
    chosen = first_n(values, ["kind"], [F.xxhash64("value"), F.col("value")], sample).collect()
    pairs = scanned.select(F.explode("pairs").alias("pair", "n")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return infer_grammar([(r["kind"], r["value"]) for r in chosen], {(r["pair"][0], r["pair"][1:]): r["n"] for r in pairs}, **options)


def find_secrets(docs: DataFrame, id_cols: list[str], text: str = "text", **options) -> DataFrame:
    """``id_cols`` with ``base`` and ``added``: arrays of (kind, start, end) by start, then kind as listed.

    Positions are code points of the whole text, end exclusive. base: matches of
    the fixed patterns; added: runs or parts of runs that an automaton accepts, kind
    ``grammar``, none of which overlaps a base span. Null and empty texts have
    none. Without enough credentials to learn from, nothing is added. Repeated
    rows are scanned each; texts are read once, and only candidates after that.
    """
    scanned = written(scan_texts(docs, id_cols, text), "secret-scan")
    grammar = scanned.sparkSession.sparkContext.broadcast(train_grammar(scanned, **options))
    slim = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            added = [
                [{"kind": GRAMMAR, "start": r["start"] + s, "end": r["start"] + e} for r in runs.as_py() for s, e in grammar.value.secrets(r["value"])]
                for runs in batch.column("runs")
            ]
            columns = [batch.column(c) for c in [*id_cols, "base"]] + [pa.array(added, spans)]
            yield pa.RecordBatch.from_arrays(columns, [*id_cols, "base", "added"])

    span = "array<struct<kind:string,start:int,end:int>>"
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in id_cols], f"base {span}, added {span}"])
    return scanned.select(*id_cols, slim.alias("base"), "runs").mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span of ``find_secrets`` replaced by ``mark``; touching spans become one mark.

    The text column alone changes; a text without secrets, null or empty, stays
    as it is. Texts are read twice, to learn and to rewrite, and never move.
    """
    scanned = written(scan_texts(docs, [], text), "secret-scan")
    grammar = docs.sparkSession.sparkContext.broadcast(train_grammar(scanned, **options))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def one(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = [(s, e) for _, s, e, _ in base]
        spans += [(at + s, at + e) for at, end in candidate_runs(text, base) for s, e in grammar.value.secrets(text[at:end])]
        out, at, last = [], 0, -1
        for s, e in sorted(spans):
            if s > last:
                out += [text[at:s], mark]
            at = last = max(last, e)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches):
        for batch in batches:
            made = pa.array([one(x.as_py()) for x in batch.column(text)], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text), text, made)

    return docs.mapInArrow(run, schema)


def span_list(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined, by start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, GRAMMAR)]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s["kind"].alias("k")))
    return F.array_join(
        F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["c"].cast("string"))), ","
    )
