"""Learned operators: held-out accuracy, fixed parts against brute force, edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import language, pii, toxicity
from assayline.llm.boosting import Boosted

from conftest import SF

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_base_spans_on_random_texts():
    rng = random.Random(3)
    alphabet = "a.@+-() 0123456789012345é\n%Z"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111 x", "a@b.c@d.e", "a@b@c.d-.e", "1.2.3.4.5.6.7.8", "+1 (22) 333-4444."):
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_personal_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pii.find_personal_data(docs)
    got = rows.select("row.doc_id", "row.text", *[c.alias(k) for k, c in pii.digest(F.col("found")).items()])
    for r in got.collect():
        want = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(r.text)]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


def test_forms_the_patterns_do_not_know_are_added(spark):
    """Learned from base spans alone: spelled mails, other phones and cards, no plain numbers."""
    rng = random.Random(9)
    word = lambda n=9: "".join(rng.choice("aeinorstl") for _ in range(rng.randint(2, n)))
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    full = lambda head: next(head + c for c in "0123456789" if pii.luhn(head + c))

    def text(span):
        words = [word() for _ in range(30)]
        words.insert(rng.randrange(5, 25), span)
        return " ".join(words)

    known = [
        lambda: f"{word()}.{some(2)}@{word()}.example.com",
        lambda: f"{rng.randint(100, 255)}.{rng.randint(10, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}",
        lambda: full("4" + some(14)),
        lambda: f"+1 ({rng.randint(200, 999)}) 555-{some(4)}",
    ]
    others = [
        (0, lambda: f"{word()} (at) {word()} (dot) com"),
        (2, lambda: full("4" + some(11))),
        (3, lambda: f"({rng.randint(200, 999)}) 555-{some(4)}"),
    ]
    plain = [lambda: "9" + some(9), lambda: f"20{some(2)}-10-1{some(1)}", lambda: "1234567", lambda: "8" + some(15)]
    rows = [(text(rng.choice(known)()), None, "") for _ in range(600)]
    rows += [(text(s := make()), kind, s) for kind, make in others for _ in range(40)]
    rows += [(text(s := make()), None, s) for make in plain for _ in range(40)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, kind int, span string")
    got = pii.find_personal_data(docs).select("row.*", "found.*").where("span <> ''").collect()
    share = {k: [] for k in (0, 2, 3, None)}
    for r in got:
        start = r.text.index(r.span)
        added = [(s["start"], s["kind"], s["end"]) for s in r.every if s not in r.base]
        if r.kind is None:
            share[None].append(bool(added))
        elif not r.base:
            hit = [a for a in added if a[1] == r.kind and a[0] <= start and a[2] >= start + len(r.span)]
            share[r.kind].append(bool(hit))
    found = {k: sum(v) / len(v) for k, v in share.items()}
    assert min(found[k] for k in (0, 2, 3)) >= 0.8 and found[None] <= 0.02, found


def test_personal_data_cases(spark):
    rows = [(1, None, "x"), (None, "", "x"), (2, "to a.b@c.de or +1 (222) 333-4444", "x"), (2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {(r.doc_id, r.text) for r in pii.redact(docs).collect()}
    assert got == {(1, None), (None, ""), (2, "to [email] or [phone]"), (2, "")}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_cover_and_apart():
    rng = np.random.default_rng(0)
    for _ in range(200):
        spans = sorted((int(a), 0, int(a + n)) for a, n in zip(rng.integers(0, 60, 9), rng.integers(1, 9, 9)))
        meets = lambda s, o: s[0] < o[2] and o[0] < s[2]
        held, taken, added = pii.Cover(spans[:4]), pii.Cover(), []
        for s in spans:
            assert held.meets(s) == any(meets(s, o) for o in spans[:4])
            assert taken.meets(s) == any(meets(s, o) for o in added)
            if not taken.meets(s):
                taken.add(s)
                added.append(s)
        alone = [s for n, s in enumerate(spans) if not any(meets(s, o) for o in spans[:n] + spans[n + 1 :])]
        assert pii.apart(spans) == alone


def test_very_many_spans_in_one_text(spark):
    """Ten megabytes of addresses and numbers, in the sample and in use."""
    line = "write to anna{0}@mail.example.org or call 555-38{0} at once. "
    text = "".join(line.format(i % 89 + 10) for i in range(160_000))
    start = time.time()
    docs = spark.createDataFrame([(1, text), (2, "x@y.zz"), (3, None)], "doc_id int, text string")
    got = {r["row"].doc_id: len(r.found.base) for r in pii.find_personal_data(docs).collect()}
    assert got == {1: 160_000, 2: 1, 3: 0} and time.time() - start < 90


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    model = Boosted().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_boosting_over_stored_rows_equals_the_array_version(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 40, size=(1500, 3)).astype("<i2")
    y = ((x[:, 0] > 12) ^ (x[:, 1] > 20)).astype(int)
    rows = [(bytes(r.tobytes()), int(v), 1) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "x binary, y int, n long")
    one, two = (Boosted(trees=4).fit_rows(df.repartition(n).groupBy("x", "y").agg(F.sum("n").alias("n"))) for n in (1, 5))
    plain = Boosted(trees=4).fit(x.astype(float), y)
    assert all(np.allclose(a, b) for a, b in zip(one.edges, plain.edges))
    assert one.model[0][0] == two.model[0][0] == plain.model[0][0]
    assert (one.score(x) == two.score(x)).all() and np.allclose(one.score(x), plain.score(x), atol=1e-4)


def test_every_base_span_and_every_text_teaches(spark):
    mails = " ".join(f"u{i}@host{i}.org, " for i in range(100))
    docs = spark.createDataFrame([(i, f"{mails} 12345{i:05} and") for i in range(50)], "doc_id long, text string")
    held = docs.where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(3)) == 0).count()
    rows = pii.labelled(docs).groupBy("held").agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("ones"))
    got = {r["held"]: r for r in rows.collect()}
    # of each text two rewritings of 100 mails, not of 32 drawn ones (some give no candidate)
    assert got[True]["ones"] > 150 * held and got[False]["ones"] > 150 * (50 - held)


def test_toxicity_accuracy(spark):
    base = SF.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels).select("row.doc_id", "score", "predicted")
    rows = scored.join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    test = [r for r in rows if held(r.doc_id)]
    ones, zeros = [r.predicted for r in test if r.toxic], [r.predicted for r in test if not r.toxic]
    assert sum(ones) / len(ones) > 0.65 and sum(zeros) / len(zeros) < 0.01


def test_toxicity_cases(spark):
    rows = [(i, "you stupid clown" if i % 2 else "a fine day", "s") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, "s"), (70, "", "s"), (0, "again", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {(r.doc_id, r.predicted) for r in toxicity.score_documents(docs, labels).select("row.doc_id", "predicted").collect()}
    assert {(1, 1), (2, 0), (None, 0), (70, 0)} <= got
    none = toxicity.score_documents(docs, labels.limit(0))
    assert {r.score for r in none.select("score").collect()} == {0.5}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def plain_ftrl(rows, epochs, bits):
    """One coordinate at a time, over (id order, label, text) with dictionaries."""
    z, n = {}, {}
    rate, beta, l1 = 2.0, 1.0, 10.0
    held = [(sorted({int(f) for f in toxicity.features(toxicity.word_hashes(t), bits)}), y) for y, t in rows]
    seen = {}
    for at, _ in held:
        for c in at:
            seen[c] = seen.get(c, 0) + 1
    held = [([c for c in at if seen[c] >= toxicity.MIN_DOCS] + [1 << bits], y) for at, y in held if at]
    ones = sum(y for _, y in held)
    up = ((len(held) - ones) / ones) ** 0.5

    def weight(c):
        if abs(z.get(c, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[c]) - z[c]) / ((beta + math.sqrt(n[c])) / rate)

    for _ in range(epochs):
        for at, y in held:
            w = {c: weight(c) for c in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (up if y else 1.0)
            for c in at:
                old = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / rate * w[c]
                n[c] = old + g * g
    return {c: weight(c) for c in z if weight(c)}


def test_weights_against_plain_ftrl(spark):
    """All weights and scores of a small table; one row of an id that is there very often."""
    rng = np.random.default_rng(3)
    mild, bad = ["tea", "cup", "the", "of", "sun"], ["grr", "foul", "the", "of", "zap"]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else mild, 30)), int(i % 3 == 0)) for i in range(90)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id int, toxic int")
    again = [(6, f"copy {k}", 0) for k in range(3000)] + [(None, "null id", 0), (9, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows + again], "doc_id int, text string")
    learned = docs.join(labels, "doc_id").where("text IS NOT NULL AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    learned = learned.selectExpr("doc_id", "text", "toxic", "xxhash64(text) h")
    order = spark.createDataFrame([(i,) for i in range(90)], "id int").selectExpr("id", "xxhash64(id, 7) o").collect()
    place = {r.id: r.o for r in order}
    one = {}
    for r in learned.collect():
        if r.doc_id not in one or r.h < one[r.doc_id].h:
            one[r.doc_id] = r
    train = [(one[i].toxic, one[i].text) for i in sorted(one, key=lambda i: place[i])]
    want = plain_ftrl(train, 3, 10)
    got = toxicity.train(docs, labels, shards=1, epochs=3, bits=10)
    assert {int(c) for c in np.flatnonzero(got)} == set(want)
    assert all(abs(got[c] - w) < 1e-9 for c, w in want.items())


def test_word_hashes_in_pieces(monkeypatch):
    text = "some words, of any length " * 40 + "x" * 300 + " end"
    whole = toxicity.word_hashes(text)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    assert (toxicity.word_hashes(text) == whole).all()


def test_language_accuracy(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r.lang_pred == r.lang for r in got if r.held_out]
    assert len(test) > 100 and sum(test) / len(test) > 0.97
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)


def test_language_cases(spark):
    rows = [(i, "the and of with" if i % 2 else "und der die mit", "en" if i % 2 else "de", "x") for i in range(40)]
    rows += [(90, None, "en", "x"), (91, "12 .. 3", "de", "x"), (None, "der mit und", None, "x"), (92, "漢字", None, "x"), (92, "漢字", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs).collect()]
    facts = {(i, p) for i, p, _ in got}
    assert len(got) == len(rows)
    assert {(90, "und"), (91, "und"), (None, "de"), (1, "en"), (2, "de")} <= facts
    assert [s for i, _, s in got if i == 92] == [0.0, 0.0]
    none = language.identify(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 10, 1 << 20])
def test_grams_in_blocks(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    text = "Ein Satz, über ein y und É. zwei  drei-vier z"
    got = sorted(np.concatenate(list(language.gram_hashes(text))).tolist())
    monkeypatch.setattr(language, "BLOCK", 1 << 20)
    assert got == sorted(np.concatenate(list(language.gram_hashes(text))).tolist())
    padded = ["_" + w + "_" for w in re.findall(r"[^\W\d_]+", text.lower())]
    count = sum(max(0, len(w) - n + 1) for w in padded for n in (3, 4)) + sum(len(w) - 3 for w in padded)
    assert len(got) == count
