"""Conversation structure repair: cheapest edits that make the turns of a conversation alternate.

Edits of a row are keep, rerole and delete; rows without text may be inserted.
The result must read ``(system? (user assistant)+)?``. Among cheapest edits the
one with the least audit (the edits' initials) is taken.

Every state of the dynamic programme holds its edits as a node of a shared tree:
a node has a letter, its parent and, at distances of powers of two, further
ancestors, and the rolling hash of all letters up to it. Two candidates of equal
cost are ordered by their longest common prefix, found by descending through
ancestors with equal hashes; that the prefixes are equal is verified by following
the nodes until they are the same one, so a hash collision costs time only.

Rows are range-partitioned by conversation and turn, so that a conversation of
any size is spread over tasks. A task ends each conversation that lies within it.
Others are pieces (at most ``piece_rows`` rows); a piece says, for each state
before and after it, what its cheapest edits cost and how their audits rank. Two
audits over the same rows are never prefixes of each other as a piece ends with
an edit of a row, so ranks of pieces combine as ranks of whole audits: one pass
forward over these short rows and one backward settle every piece's states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.llm.common import written

PIECE_ROWS = 4096
PIECE_CHARS = 4_000_000
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
CLEAN, BLANK, DUPLICATE, CUT = range(4)
FAR = 1 << 60
MODULUS, BASE = (1 << 61) - 1, 1_000_003
NOT_BLANK = r"[^\x20\x09-\x0D]"
OPEN_END = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
# States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = (2, 2, 3, 2)  # state after an inserted or reroled row
NAMES = {2: "user", 3: "assistant"}
CLOSING = ("", "II", "I", "")  # what is inserted behind the last row
LEGAL = {"su", "ua", "au"}


class AuditTree:
    """Edit sequences that share their prefixes. Node 0 is the empty sequence."""

    def __init__(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # up[n][j]: the ancestor 2**j letters before

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % MODULUS)
        lifts, at, j = [parent], parent, 0
        while len(self.up[at]) > j:
            at = self.up[at][j]
            lifts.append(at)
            j += 1
        self.up.append(lifts)
        return node

    def lift(self, node: int, depth: int) -> int:
        """The ancestor with ``depth`` letters."""
        away = self.depth[node] - depth
        while away:
            step = away.bit_length() - 1
            node = self.up[node][step]
            away -= 1 << step
        return node

    def text(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of equal depth spell the same; at the first shared node they do."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the letters of ``a`` come before those of ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        p, q = x, y
        if self.hash[p] != self.hash[q]:
            for j in range(len(self.up[p]) - 1, -1, -1):
                if j < len(self.up[p]) and self.hash[self.up[p][j]] != self.hash[self.up[q][j]]:
                    p, q = self.up[p][j], self.up[q][j]
            if self.letter[p] != self.letter[q] and self.same(self.up[p][0], self.up[q][0]):
                return self.letter[p] < self.letter[q]
        return self.text(x) < self.text(y)  # hashes collided: compare letter by letter


class PieceEdits:
    """Cheapest edits of a piece from one state before it to every state behind it. ``rows``: (initial, fault)."""

    def __init__(self, rows: list[tuple[str, int]], entry: int):
        self.tree = AuditTree()
        self.cost = [FAR] * 4
        self.node = [0] * 4
        self.cost[entry] = 0
        for initial, fault in rows:
            self._insert()
            self._take(initial, fault)

    def _better(self, cost: int, parent: int, letter: str, best: tuple[int, int]) -> tuple[int, int]:
        if cost > best[0]:
            return best
        node = self.tree.add(parent, letter)
        return (cost, node) if cost < best[0] or self.tree.less(node, best[1]) else best

    def _insert(self) -> None:
        step = list(zip(self.cost, self.node, strict=True))
        best = list(step)
        for _ in range(2):
            more = [(FAR, 0)] * 4
            for state, (cost, node) in enumerate(step):
                if cost + INSERT < FAR and cost + INSERT <= best[ADDED[state]][0]:
                    more[ADDED[state]] = self._better(cost + INSERT, node, "I", more[ADDED[state]])
            for state, (cost, node) in enumerate(more):
                if cost < best[state][0] or cost < FAR and cost == best[state][0] and self.tree.less(node, best[state][1]):
                    best[state] = (cost, node)
            step = more
        self.cost, self.node = [c for c, _ in best], [n for _, n in best]

    def _take(self, initial: str, fault: int) -> None:
        best = [(FAR, 0)] * 4
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            cost, node = self.cost[state], self.node[state]
            if cost >= FAR:
                continue
            best[state] = self._better(cost + DELETE, node, "D", best[state])
            if fault in (BLANK, DUPLICATE):
                continue
            kept = AFTER[state].get(initial)
            if kept is not None:
                best[kept] = self._better(cost + extra, node, "K", best[kept])
            best[ADDED[state]] = self._better(cost + REROLE + extra, node, "R", best[ADDED[state]])
        self.cost, self.node = [c for c, _ in best], [n for _, n in best]

    def ranks(self) -> list[int]:
        """Place of each end state's audit in their order."""
        order: list[int] = []
        for state in range(4):
            at = 0
            while at < len(order) and (self.cost[state] >= FAR or self.tree.less(self.node[order[at]], self.node[state])):
                at += 1
            order.insert(at, state)
        return [order.index(s) for s in range(4)]

    def audit(self, state: int) -> str:
        return self.tree.text(self.node[state])


def last_state(cost: list[int], rank: list[int]) -> int:
    """The state behind the last row from which the conversation ends cheapest."""
    return min((s for s in range(4) if cost[s] < FAR), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), rank[s]))


class Repair:
    """One conversation as it is repaired, piece by piece. Holds a hash of its text, not the text."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.turn = self.initial = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = 0

    def tally(self, row: dict) -> None:
        self.blank += row["fault"] == BLANK
        self.duplicate += row["fault"] == DUPLICATE
        self.truncated += row["fault"] == CUT
        initial, turn = row["role"][:1], row["turn"]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = self.most = turn
            self.least = turn if self.least is None else self.least

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add(self, rows: list[dict], edits: PieceEdits, entry: int, exit: int, closing: bool) -> None:
        """Rows of a piece with the edits that lead from ``entry`` to ``exit``."""
        for row in rows:
            self.tally(row)
        audit = edits.audit(exit)
        self.cost += edits.cost[exit]
        if closing:
            audit += CLOSING[exit]
            self.cost += INSERT * len(CLOSING[exit])
        state, at = entry, 0
        for letter in audit:
            if letter == "I":
                state = ADDED[state]
                self.line(NAMES[state], "")
                continue
            row, at = rows[at], at + 1
            if letter == "K":
                state = AFTER[state][row["role"][:1]]
                self.line(row["role"], row["text"])
            elif letter == "R":
                state = ADDED[state]
                self.line(NAMES[state], row["text"])
        self.audit.append(audit)

    def result(self, conv: object) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"conv_id": conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _edits(rows: list[dict], entry: int) -> PieceEdits:
    return PieceEdits([(r["role"][:1], r["fault"]) for r in rows], entry)


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])
_RESULT = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
_RESULT += [("audit", pa.string()), ("repaired_sha256", pa.string())]
_RESULT_SQL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS_SQL = "rows array<struct<turn: long, role: string, text: string, fault: int>>"


def _batches(rows: Iterator[dict], fields: list, most: int = 2000) -> Iterator[pa.RecordBatch]:
    schema, held, size = pa.schema(fields), [], 0
    for row in rows:
        held.append(row)
        size += 1 + len(row.get("rows") or ())
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[object, int, int, list[dict], bool]]:
    """(conversation, partition, number, rows, whole) of each piece of a sorted partition."""
    conv, part, number, rows, chars, before, first = None, None, 0, [], 0, None, True

    def faulty(row: dict) -> dict:
        fault = BLANK if row["blank"] else CLEAN
        if not fault and (row["later"] or before == (row["turn"], row["role"], row["text"])):
            fault = DUPLICATE
        if not fault and row["truncated"]:
            fault = CUT
        return {"turn": row["turn"], "role": row["role"], "text": row["text"], "fault": fault}

    for batch in batches:
        for row in batch.to_pylist():
            if part is None:
                conv, part = row["conv_id"], row["part"]
            if row["conv_id"] != conv:
                yield conv, part, number, rows, not first and not number
                conv, number, rows, chars, before, first = row["conv_id"], 0, [], 0, None, False
            elif len(rows) >= most or chars >= PIECE_CHARS:
                yield conv, part, number, rows, False
                number, rows, chars = number + 1, [], 0
            if not row["dropped"]:
                rows.append(faulty(row))
                before = (row["turn"], row["role"], row["text"])
                chars += len(row["text"])
    if part is not None:
        yield conv, part, number, rows, False


def _repair_partition(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[dict]:
        for conv, part, number, rows, whole in _pieces(batches, piece_rows):
            if whole:
                edits, repair = _edits(rows, 0), Repair()
                repair.add(rows, edits, 0, last_state(edits.cost, edits.ranks()), True)
                yield repair.result(conv)
            else:
                each = [_edits(rows, entry) for entry in range(4)]
                yield {"conv_id": conv, "part": part, "number": number, "rows": rows,
                       "costs": [c for e in each for c in e.cost], "ranks": [r for e in each for r in e.ranks()]}

    yield from _batches(out(), _FIRST)


_FIRST = [("conv_id", pa.int64()), *_RESULT, ("part", pa.int32()), ("number", pa.int64()),
          ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("rows", pa.list_(_ROW))]
_FIRST_SQL = f"conv_id long, {_RESULT_SQL}, part int, number long, costs array<long>, ranks array<int>, {_ROWS_SQL}"
_STEP = [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("before", pa.list_(pa.int32())), ("last", pa.int32())]
_STEP_SQL = "conv_id long, part int, number long, before array<int>, last int"
_ENDS = [("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()),
         ("entry", pa.int32()), ("exit", pa.int32()), ("closing", pa.bool_())]
_ENDS_SQL = "conv_id long, part int, number long, entry int, exit int, closing boolean"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before a piece that is best for each state behind it; at a conversation's last piece also its end state."""
    def out() -> Iterator[dict]:
        held, cost, rank = None, [0, FAR, FAR, FAR], [0, 1, 2, 3]
        for batch in batches:
            for row in batch.to_pylist():
                if held is not None:
                    if held["conv_id"] != row["conv_id"]:
                        held["last"] = last_state(cost, rank)
                        cost, rank = [0, FAR, FAR, FAR], [0, 1, 2, 3]
                    yield held
                costs, ranks = row["costs"], row["ranks"]
                options = [min((min(cost[m] + costs[4 * m + x], FAR), rank[m], ranks[4 * m + x], m) for m in range(4)) for x in range(4)]
                order = sorted(range(4), key=lambda x: (options[x][0] >= FAR, *options[x][1:3]))
                cost, rank = [o[0] for o in options], [order.index(x) for x in range(4)]
                held = {"conv_id": row["conv_id"], "part": row["part"], "number": row["number"], "before": [o[3] for o in options], "last": None}
        if held is not None:
            yield held | {"last": last_state(cost, rank)}

    yield from _batches(out(), _STEP)


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[dict]:
        exit = 0
        for batch in batches:
            for row in batch.to_pylist():
                closing = row["last"] is not None
                exit = row["last"] if closing else exit
                entry = row["before"][exit]
                yield {"conv_id": row["conv_id"], "part": row["part"], "number": row["number"], "entry": entry, "exit": exit, "closing": closing}
                exit = entry

    yield from _batches(out(), _ENDS)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[dict]:
        repair = Repair()
        for batch in batches:
            for row in batch.to_pylist():
                repair.add(row["rows"], _edits(row["rows"], row["entry"]), row["entry"], row["exit"], row["closing"])
                if row["closing"]:
                    yield repair.result(row["conv_id"])
                    repair = Repair()

    yield from _batches(out(), [("conv_id", pa.int64()), *_RESULT])


def damage(conversations: DataFrame) -> DataFrame:
    """Conversation rows with seeded faults: ``conv_id, turn, role, text, dropped``.

    By crc32 of ``conv_id:turn`` modulo 20 a row is dropped (kept with the mark
    ``dropped``, so that its conversation is not forgotten), emptied, rid of
    sentence ends, doubled, or given to the user. Nulls count as one space,
    except that ``conv_id`` and ``turn`` themselves stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        blank("role").alias("role"), blank("text").alias("text"), code.alias("code"),
    )
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("code") == 0).alias("dropped"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Faults and cheapest repair of every conversation in ``rows`` (``conv_id, turn, role, text, dropped``).

    Rows go by turn, null turns first; rows of one turn by role and SHA-256 of the
    text. A row whose ``dropped`` is true only names its conversation. Null roles
    and texts count as one space. A null ``conv_id`` is a conversation like any
    other. Rows after the first with the same role and text are duplicates, also
    within a turn. Empty input gives no rows; further columns are ignored.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Tasks hold one piece of rows at a time. Of a conversation
    spread over tasks its pieces' cost tables, and in the last step its pieces in
    order, pass through one task, as its hash is of the text in sequence.
    """
    spark = rows.sparkSession
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                       F.coalesce("dropped", F.lit(False)).alias("dropped"))
    rows = rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"))
    key = ["conv_id", "role", "digest"]
    turn = F.coalesce("turn", F.lit(-(1 << 63)))
    often = (
        rows.filter(~F.col("dropped")).groupBy(*key).agg(F.min(turn).alias("first"), F.max(turn).alias("final"))
        .filter("first < final").select(*[F.col(k).alias(f"_{k}") for k in key], "first")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    flagged = rows.join(often, on=same, how="left").select(
        "conv_id", "turn", "role", "text", "dropped", "digest",
        F.coalesce(turn > F.col("first"), F.lit(False)).alias("later"),
        (~F.col("text").rlike(NOT_BLANK)).alias("blank"), F.col("text").rlike(OPEN_END).alias("truncated"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = flagged.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text", "dropped", "later", "blank", "truncated", F.spark_partition_id().alias("part"))
    repaired = dealt.mapInArrow(lambda batches: _repair_partition(batches, piece_rows), T.StructType.fromDDL(_FIRST_SQL))
    first = written(repaired, "conversation-pieces")
    whole = first.filter(F.col("part").isNull()).select("conv_id", *_names(_RESULT))
    pieces = first.filter(F.col("part").isNotNull()).select("conv_id", "part", "number", "costs", "ranks", "rows")
    place = ["conv_id", "part", "number"]
    sort = lambda df, up: df.repartition(parts, "conv_id").sortWithinPartitions(
        *[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c in place])
    steps = sort(pieces.drop("rows"), True).mapInArrow(_forward, T.StructType.fromDDL(_STEP_SQL))
    ends = sort(steps, False).mapInArrow(_backward, T.StructType.fromDDL(_ENDS_SQL))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in place], "entry", "exit", "closing")
    placed = pieces.join(ends, on=[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]).select(*place, "rows", "entry", "exit", "closing")
    rest = sort(placed, True).mapInArrow(_finish, T.StructType.fromDDL(f"conv_id long, {_RESULT_SQL}"))
    return whole.unionByName(rest)


def _names(fields: list) -> list[str]:
    return [n for n, _ in fields]
