"""Line dedup against a plain version, and the runs against one large set."""

from __future__ import annotations

from collections import defaultdict

from assayline.llm import lines

LONG = "a line that is long enough to count"


def brute(rows, min_chars=20, min_docs=3):
    space = " \t\n\x0b\x0c\r"
    key = lambda l: "".join(c.lower() if c.isascii() else c for c in l.strip(space))
    held, out = defaultdict(list), []
    for i, text in rows:
        for k in {key(l) for l in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = []
        for l in parts:
            ids = held.get(key(l), [])
            known = [x for x in ids if x is not None]
            if len(ids) < min_docs or not known or i == max(known):
                kept.append(l)
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(rows):
    return sorted(
        ((r.id, r.n_lines, r.n_dropped, r.kept or "") for r in rows.collect()), key=str
    )


ROWS = [
    (1, f"{LONG}\nown one\n  {LONG.upper()}\t"),
    (2, f"x\n{LONG}"),
    (3, f"{LONG}\r\nÄ{LONG}\nÄ{LONG}"),
    (4, None),
    (5, ""),
    (None, f"{LONG}\nä{LONG}"),
    (6, f"Ä{LONG}\n\n"),
    (7, f"Ä{LONG}\nshort"),
    (7, f"Ä{LONG}\nshort"),
    (8, "\n".join(f"{LONG} {n % 7}" for n in range(5000))),
    (9, "\n".join(f"{LONG} {n}" for n in range(40))),
    (10, f"{LONG} 3\n{LONG} 3"),
    (11, f"{LONG} 1"),
]
SCHEMA = "doc_id long, text string, kept string, h1 string, row string, id string"


def test_rule(spark):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in ROWS], SCHEMA)
    got = lines.drop_frequent_lines(docs)
    assert result(got) == brute(ROWS)
    assert got.select("row.*").columns == docs.columns
    assert lines.drop_frequent_lines(docs.limit(0)).count() == 0


def test_batches_do_not_matter(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for batches, fanout in ((1, 2), (7, 2), (5, 3)):
        got = lines.drop_frequent_lines(docs, batches=batches, fanout=fanout)
        assert result(got) == brute(ROWS)


def test_levels(spark):
    runs = lines.LineRuns(fanout=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(1, n, 1, n), (7, 7, 1, n)], "h1 long, h2 long, docs long, last long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {(r.h1, r.h2): (r.docs, r["last"]) for r in runs.merged(spark).collect()}
    assert got == {(1, n): (1, n) for n in range(5)} | {(7, 7): (5, 4)}


def test_incremental(spark):
    runs = lines.LineRuns(fanout=2)
    other = "quite another line, long enough"
    first = spark.createDataFrame([(1, f"{LONG}\n{LONG}"), (2, LONG)], "doc_id long, text string")
    second = spark.createDataFrame([(3, f"{LONG}\n{other}"), (4, "new")], "doc_id long, text string")
    third = spark.createDataFrame([(5, f"{other}\nrest\n {LONG}"), (6, None)], "doc_id long, text string")
    kept = [
        {r.id: r.kept for r in lines.drop_seen_lines(b, runs).collect()}
        for b in (first, second, third)
    ]
    assert kept[0] == {1: f"{LONG}\n{LONG}", 2: LONG}
    assert kept[1] == {3: other, 4: "new"}
    assert kept[2] == {5: "rest", 6: None}
