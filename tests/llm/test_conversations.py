"""Conversation repair: brute force over all edits, pieces against whole conversations, damaged rows."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from shelfsight.llm.conversation_repair import AuditTree, damage, repair_conversations

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def _expected(rows):
    """All edit sequences by memoised recursion over (row, roles so far), strings compared as strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = re.compile(r"(s?(ua)+)?")

    def may_grow(roles):
        return any(legal.fullmatch(roles + more) for more in ("", "a", "ua", "uaua"))

    @lru_cache(maxsize=None)
    def best(i, roles, added):
        options = []
        if i == len(rows) and legal.fullmatch(roles):
            options.append((0, "", ()))
        if added < 3:
            for role in ("user", "assistant"):
                if may_grow(short(roles + role[0])):
                    cost, audit, lines = best(i, short(roles + role[0]), added + 1)
                    options.append((cost + 3, "I" + audit, (f"{role}:", *lines)))
        if i < len(rows):
            cost, audit, lines = best(i + 1, roles, 0)
            options.append((cost + 4, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                for role, letter, price in ((rows[i][2], "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if role and may_grow(short(roles + role[0])):
                        cost, audit, lines = best(i + 1, short(roles + role[0]), 0)
                        options.append((cost + price + 3 * (faults[i] == "truncated"), letter + audit, (f"{role}:{rows[i][3]}", *lines)))
        return min(options, default=(10**9, "", ()))

    def short(roles):
        return re.sub(r"^(s?)(ua)+(?=ua)", r"\1", roles)

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _conversations(seed, count):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["One.", "Two", "Three!", " ", "", None, "why?", "One. ", "Ä?\n", "a\nb"]
    for conv in [None, *range(count)]:
        turn = rng.choice([0, 3])
        for _ in range(rng.randrange(0, 9)):
            rows.append((conv, None if rng.random() < 0.1 else turn, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


def _check(got, rows, kept):
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        mine = [k for k in kept if k[0] == r["conv_id"]]
        assert tuple(r[c] for c in COLUMNS) == _expected(mine), mine


def test_damage_and_repair_equal_brute_force(rows):
    data = _conversations(1, 120)
    df = rows("conv_id long, turn long, role string, text string, cost string", *[(*r, "clash") for r in data])
    broken = damage(df)
    assert sorted(map(str, _damaged(data))) == sorted(str(tuple(r)[:4]) for r in broken.collect() if not r["dropped"])
    _check(repair_conversations(broken).collect(), data, _damaged(data))


def test_pieces_give_what_whole_conversations_give(spark, rows):
    """One conversation holds most rows, and pieces are of one to three rows."""
    rng = random.Random(5)
    data = [(7, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", f"No {i}.", "so", ""])) for i in range(60)]
    data += [(conv, turn, role, text) for conv, turn, role, text in _conversations(3, 30) if conv != 7]
    df = rows("conv_id long, turn long, role string, text string", *data)
    for size in (1, 3):
        _check(repair_conversations(damage(df), size).collect(), data, _damaged(data))


def test_empty_conversations(rows):
    schema = "conv_id long, turn long, role string, text string"
    assert repair_conversations(damage(rows(schema))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (only,) = repair_conversations(damage(rows(schema, (gone, 0, "user", "x")))).collect()
    assert tuple(only[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_audits_compare_by_common_prefix_and_survive_collisions():
    rng, tree = random.Random(2), AuditTree()
    nodes = [0]
    for _ in range(600):
        nodes.append(tree.add(rng.choice(nodes[-20:]), rng.choice("DIKR")))
    words = {n: tree.text(n) for n in nodes}
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(3000)]
    assert all(tree.less(a, b) == (words[a] < words[b]) for a, b in pairs)
    tree.hash = [h % 2 for h in tree.hash]
    assert all(tree.less(a, b) == (words[a] < words[b]) for a, b in pairs)
