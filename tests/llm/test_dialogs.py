"""Conversation repair against a parse of every split, a plain reading and long conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from assayline.llm import dialogs

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Cheapest (cost, audit, outputs) by trying every edit, with insertions up to three."""
    best = {0: (0, "", ())}
    goes = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def insert(cells):
        for _ in range(3):
            for state, (cost, audit, outs) in list(cells.items()):
                for name in ("user", "assistant"):
                    to = goes.get((state, name[0]))
                    new = (cost + 3, audit + "I", (*outs, (name, "")))
                    if to is not None and (to not in cells or new[:2] < cells[to][:2]):
                        cells[to] = new
        return cells

    for role, text, fault in rows:
        cells = {}

        def put(state, cost, audit, outs):
            if state is not None and (state not in cells or (cost, audit) < cells[state][:2]):
                cells[state] = (cost, audit, outs)

        for state, (cost, audit, outs) in insert(best).items():
            put(state, cost + 4, audit + "D", outs)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                put(goes.get((state, role[:1])), cost + more, audit + "K", (*outs, (role, text)))
                for name in ("user", "assistant"):
                    put(goes.get((state, name[0])), cost + 3 + more, audit + "R", (*outs, (name, text)))
        best = cells
    return min((v for k, v in insert(best).items() if k in (0, 3)), key=lambda v: v[:2])


def plain(rows):
    """What the query returns for rows (conv_id, turn, role, text), by plain loops."""
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(name.encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        if h:
            held += [(turn is not None, turn or 0, role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort()
        seen, judged = set(), []
        for _, _, role, text in held:
            body = text.rstrip(SPACE)
            fault = None
            if not body:
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif body[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for there, t, _, _ in held if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(judged)]
        cost, audit, outs = brute(judged)
        lines = "\n".join(f"{r}:{t}" for r, t in outs)
        out.append(
            (
                conv,
                gaps,
                *[sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")],
                sum(p not in ("su", "ua", "au") for p in pairs),
                cost,
                audit,
                hashlib.sha256(lines.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def every_split(rows):
    """The cells of all spans, over all splits."""
    cells = {(i, i + 1): dialogs.short_span(rows[i]) for i in range(len(rows))}
    for size in range(2, len(rows) + 1):
        for i in range(len(rows) - size + 1):
            found = {}
            for k in range(i + 1, i + size):
                for key, new in dialogs.join_cells(cells[i, k], cells[k, i + size]).items():
                    found[key] = min(found.get(key, new), new)
            cells[i, i + size] = found
    return cells[0, len(rows)]


@pytest.mark.parametrize("seed", range(40))
def test_parse(seed):
    draw = random.Random(seed)
    rows = "".join(draw.choice("dsuaxSUAXuaua") for _ in range(draw.randint(1, 24)))
    assert dialogs.parse(rows) == every_split(rows)
    cost, path = dialogs.cheapest(dialogs.parse(rows))
    fault = {True: "truncated", False: None}
    want = brute([(c.lower(), c, "blank" if c == "d" else fault[c.isupper()]) for c in rows])
    assert (cost, path.translate(str.maketrans("HS", "IR"))) == want[:2]


def random_rows(seed, n, convs):
    draw = random.Random(seed)
    texts = ["Yes.", "No", "", "  \n", None, "What?\n ", "é!", "a ", "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]
    return [
        (draw.choice(convs), draw.choice([None, *range(12)]), draw.choice(roles), draw.choice(texts))
        for _ in range(n)
    ]


def ran(spark, rows):
    df = spark.createDataFrame(
        [(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pos string"
    )
    return sorted(map(tuple, dialogs.repair_damaged(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_random_tables(spark, seed):
    rows = random_rows(seed, 200, [None, *range(-3, 20)])
    rows += [(100 + i, t, r, x) for i in range(60) for t, r, x in [(0, "user", "Hi."), (1, "assistant", "Ok.")]]
    assert ran(spark, rows) == plain(rows)


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(dialogs, "BLOCK_ROWS", 4)
    monkeypatch.setattr(dialogs, "FAN", 3)
    rows = random_rows(7, 150, [None]) + random_rows(8, 40, [1, 2])
    assert ran(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert ran(spark, []) == []


def test_own_rows_without_damage(spark):
    rows = [(1, 0, "assistant", "Sure."), (1, 1, "user", "And"), (1, 2, "user", "More?")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    verdicts, repaired = dialogs.repair(df)
    v = verdicts.first()
    assert (v.illegal, v.truncated, v.gaps) == (1, 1, 0)
    want = brute([("assistant", "Sure.", None), ("user", "And", "truncated"), ("user", "More?", None)])
    assert (v.cost, v.audit) == want[:2]
    got = [(r.role, r.text) for r in repaired.orderBy("pos", "nth").collect()]
    assert got == list(want[2])
