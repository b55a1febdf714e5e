"""n-grams, contamination, cleaning and windows against naive versions."""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayline.functions import text as T
from assayline.operators import ngrams as N
from assayline.operators import reshape as B

TEXT = "The river, wide and slow,  ran past\tthe mill.\n\n\"Quiet -- too quiet!\" said the miller; then it rained."


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 13])
def test_ngrams_equal_sliding_window(spark, n):
    rows = N.ngram_rows(frame(spark, [TEXT]), ["id"], "text", n, distinct=False).collect()
    w = TEXT.lower().split()
    assert [r["ngram"] for r in rows] == [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n  \x1c.é", max_size=30), min_size=1, max_size=8))
def test_normalize_like_python_split(spark, texts):
    got = frame(spark, texts).select(T.normalize(F.col("text")).alias("t"), F.size(T.words(F.col("text"))).alias("n")).collect()
    assert [r["t"] for r in got] == [" ".join(t.lower().split()) for t in texts]
    assert [r["n"] for r in got] == [len(t.split()) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_offsets_point_into_the_text(spark, n):
    rows = N.ngrams_with_offsets(frame(spark, [TEXT]), ["id"], "text", n).collect()
    spans = [(m.start(), m.end() - 1) for m in re.finditer(r"\S+", TEXT)]
    assert [(r["start"], r["stop"]) for r in rows] == [
        (spans[i][0], spans[i + n - 1][1]) for i in range(len(spans) - n + 1)
    ]
    assert all(r["ngram"].split()[0] == TEXT[r["start"] :].split()[0] for r in rows)


def naive_clean(text, dirty, n, window, most, least, compat):
    table = str.maketrans(string.ascii_uppercase, string.ascii_lowercase, string.punctuation)
    words = [(m.group(), m.start(), m.end() - 1) for m in re.finditer(r"\S+", text)]
    hits = []
    for i in range(len(words) - n + 1):
        gram = " ".join(w[0] for w in words[i : i + n])
        if gram.translate(table) in dirty:
            hits.append((words[i][1], words[i + n - 1][2]))
    if not hits:
        return [text] if not compat or len(text) >= least else []
    if len(hits) > most:
        return []
    out, splice = [], 0
    for start, stop in hits:
        start, stop = max(0, start - window), min(len(text), stop + window)
        if start - splice > least:
            out.append(text[splice:start])
        splice = stop
    if splice < len(text) - least:
        out.append(text[splice + 1 :])
    return out


SENTENCE = "Some plain words stand here so that this sentence is long enough to keep it. "
CASES = [
    SENTENCE * 6 + "BAD!word " + SENTENCE * 5,
    SENTENCE * 6 + "BADword " + SENTENCE * 6 + "badword, " + SENTENCE * 7,
    SENTENCE * 2,
    "badword",
    SENTENCE + "badword " * 11 + SENTENCE * 4,
    "short and clean",
    SENTENCE * 4 + " - badword - " + SENTENCE * 4,
    "",
]


@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("n", [1, 2])
def test_clean_chunks_like_naive_version(spark, n, compat):
    bad = spark.createDataFrame([("Badword",), ("words stand badword some",)], "text string")
    dirty = N.dirty_ngrams(bad, "text", n)
    known = {r["ngram"] for r in dirty.collect()}
    got = {}
    for r in N.clean_chunks(frame(spark, CASES), dirty, "id", "text", n=n, compat=compat).orderBy("id", "chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    for i, text in enumerate(CASES):
        assert got.get(i, []) == naive_clean(text, known, n, 200, 10, 200, compat), i


def test_contaminated_paths_agree(spark):
    train = frame(spark, [TEXT, "no match here at all", TEXT.upper() + " more", "the river wide"])
    test = spark.createDataFrame([("x said the miller; then it rained. y",)], "text string")
    for limit in (10**6, 0):
        got = N.contaminated(train, test, ["id"], "text", "text", n=4, max_rows=limit)
        assert sorted(r["id"] for r in got.collect()) == [0, 2]


def test_fold_protects_later_sources_with_kept_rows_only(spark):
    test = spark.createDataFrame([("one two three four",)], "text string")
    a = spark.createDataFrame([(1, "one two three x"), (2, "red green blue white")], "id long, text string")
    b = spark.createDataFrame([(3, "red green blue grey"), (4, "two three x y"), (5, "fresh words only here")], "id long, text string")
    kept = N.decontaminate_sources([a, b], test, ["id"], "text", "text", n=3)
    assert sorted(r["id"] for r in kept.collect()) == [2, 4, 5]


def test_index_written_in_sorted_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    N.write_ngram_index(frame(spark, [TEXT, TEXT, "a b"]), path, "id", "text", 3, buckets=4)
    rows = spark.read.parquet(path)
    assert rows.select("bucket").distinct().count() <= 4
    words = len(re.sub(f"[{re.escape(string.punctuation)}]", "", TEXT).split())
    assert rows.count() == 2 * (words - 2)
    assert N.frequent_ngrams(rows, "id", 1).count() == rows.select("ngram").distinct().count()


# tokens 0..33, window 10, context 1: predictions by tens, the last reaches back
@pytest.mark.parametrize("max_len,ctx", [(10, 1), (10, 5), (5, 5), (40, 1), (3, 2)])
def test_rolling_windows_predict_each_token_once(spark, max_len, ctx):
    tokens = [str(i) for i in range(34)]
    df = spark.createDataFrame([(0, tokens), (1, [])], "id int, t array<string>")
    rows = B.rolling_windows(df, "id", "t", max_len, ctx, "BOS").orderBy("window_no").collect()
    assert [x for r in rows for x in r["predicted"]] == tokens
    for r in rows:
        joined = ["BOS", *tokens]
        end = joined.index(r["predicted"][-1])
        assert r["context"] == joined[max(0, end - max_len if r["window_no"] else 0) : end]
    if (max_len, ctx) == (10, 1):
        assert rows[-1]["context"] == [str(i) for i in range(23, 33)]
        assert rows[-1]["predicted"] == ["30", "31", "32", "33"]
    split = B.rolling_windows(df, "id", "t", max_len, ctx, "BOS", disjoint=True).collect()
    assert all(not set(r["context"]) & set(r["predicted"]) for r in split)


def test_prepare_pair(spark):
    df = spark.createDataFrame([("It ca n't be .", "Yes ( it can )"), ("", "x"), (None, "x")], "a string, b string")
    assert [tuple(r) for r in B.prepare_pair(df, "a", "b").collect()] == [("It can't be", "yes (it can)")]


def test_word_spans_of_a_batch_come_in_slices():
    import pyarrow as pa

    texts = ["ab  cd", None, "", "x " * T.SPAN_CHARS, " y", None]
    got = list(T.word_spans.func(iter([pa.array(texts)])))
    assert [len(part) for part in got] == [4, 2]
    want = [
        None if t is None else [{"word": m.group(), "start": m.start(), "stop": m.end() - 1} for m in re.finditer(r"\S+", t)]
        for t in texts
    ]
    assert [spans for part in got for spans in part.to_pylist()] == want


def test_intake_streams_a_folder_of_part_files(spark, tmp_path):
    from assayline.queries import QUERIES, load_all

    load_all()
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string").withColumn("doc_id", F.monotonically_increasing_id())
    rows.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["m1_stream_intake"](spark, str(tmp_path)).collect()
    assert sorted(str(r["text"]) for r in got) == ["None", "a", "b"]


REPEATING = [(1, "a b a b a b"), (2, "a b c"), (2, "b a b A"), (None, "a b"), (None, "a b a"), (3, "a"), (4, None), (5, "")]


def naive_grams(text, n):
    w = (text or "").lower().split()
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_gram_counts_are_made_inside_the_row(spark):
    df = spark.createDataFrame(REPEATING, "id long, text string")
    want = Counter((i, g) for i, t in REPEATING for g in naive_grams(t, 2))
    got = N.ngram_counts(df, "id", "text", 2).collect()
    assert {(r["id"], r["ngram"]): r["n"] for r in got} == want and len(got) == len(want)
    alone = N.ngram_counts(df.where("id IN (1, 3, 4, 5)"), "id", "text", 2)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert {r["ngram"]: r["n"] for r in alone.collect()} == {"a b": 3, "b a": 2}


def test_index_files_are_written_without_a_shuffle_of_grams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "PART_BYTES", 40)
    path = str(tmp_path / "index")
    N.write_ngram_index(frame(spark, ["a b c d e f g h"] * 12), path, "id", "text", 3, buckets=2)
    rows = spark.read.parquet(path)
    assert sorted((r["id"], r["ngram"]) for r in rows.collect()) == sorted(
        (i, g) for i in range(12) for g in naive_grams("a b c d e f g h", 3)
    )
    files = defaultdict(list)
    for r in rows.select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect():
        files[r["f"]].append((r["i"], r["ngram"], r["id"]))
    assert all([x[1:] for x in sorted(f)] == sorted(x[1:] for x in f) for f in files.values())
    # every task writes its own file of a bucket: a gram that all texts hold is spread
    assert len({f for f, held in files.items() if any(x[1] == "a b c" for x in held)}) > 1


def test_only_frequent_grams_are_shuffled_as_text(spark):
    rows = [(i, f"w{i} common words here") for i in range(5)] + [(None, "common words here")]
    index = N.ngram_rows(spark.createDataFrame(rows, "id long, text string"), ["id"], "text", 2)
    got = N.frequent_ngrams(index, "id", 4)
    assert {r["ngram"]: r["docs"] for r in got.collect()} == {"common words": 5, "words here": 5}
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert N.frequent_ngrams(index, "id", 5).count() == 0


def test_overlap_counts_grams_once(spark):
    index = N.ngram_rows(frame(spark, ["a b c a b c", "a b x"]), ["id"], "text", 2, distinct=False)
    got = N.overlap_stats(index, frame(spark, ["a b", "q r"]), "text", 2).collect()
    assert [tuple(r) for r in got] == [(7, 4, 1, 3)]
    plan = N.overlap_stats(index, frame(spark, ["a b", "q r"]), "text", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) AS n" not in plan  # a hash is sent without a number beside it
    empty = N.overlap_stats(index.where("id < 0"), frame(spark, ["a b"]), "text", 2).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, 0)]


def test_gram_hashes_follow_the_grams(spark):
    texts = [("a b c d",), ("",), (None,), ("a",), ("x a b c d a b",), ("a b é😀 b a",)]
    t = F.col("t")
    rows = spark.createDataFrame(texts, "t string").select(
        "t", T.grams(t, 2).alias("g"), T.gram_hashes(t, 2).alias("h")
    ).collect()
    known = {}
    for row in rows:
        assert (row.h is None) == (row.t is None) and len(row.h or []) == len(row.g or [])
        for gram, code in zip(row.g or [], row.h or []):
            assert known.setdefault(gram, code) == code
    assert len(set(known.values())) == len(known)


def test_full_stops_of_abbreviations_close_no_sentence(spark):
    from assayline.functions import checks as C

    rows = [("Mr. A met Dr. B. He has a Ph.D. now. xMr. is not. It is 3.5 m. Co.",), ("St.Mrs. a.b. 1. 2.3.",)]
    found = [r.s for r in spark.createDataFrame(rows, "t string").select(C.sentences(F.col("t")).alias("s")).collect()]
    assert found[0] == ["Mr. A met Dr. B.", "He has a Ph.D. now.", "xMr.", "is not.", "It is 3.5 m.", "Co."]
    assert found[1] == ["St.Mrs. a.b.", "1.", "2.3."]


def test_index_keeps_overlapping_grams_in_one_file(spark, tmp_path):
    import random

    draw, letters = random.Random(7), string.ascii_lowercase
    known = ["".join(draw.choices(letters, k=draw.randint(2, 11))) for _ in range(8000)]
    texts = [" ".join(draw.choices(known, k=600)) for _ in range(60)]
    rows = [*enumerate(texts), (60, texts[3]), (60, texts[4]), (None, texts[5]), (61, None), (62, ""), (63, "too few words")]
    df, path = spark.createDataFrame(rows, "id long, text string"), str(tmp_path / "index")
    N.write_ngram_index(df, path, "id", "text", 13, buckets=16)
    held = spark.read.parquet(path).collect()
    want = Counter((i, g) for i, t in rows for g in naive_grams(t, 13))
    assert Counter((r["id"], r["ngram"]) for r in held) == want
    back = N.read_ngram_index(spark, path, "id")
    assert back.columns == ["ngram", "id"] and Counter((r["id"], r["ngram"]) for r in back.collect()) == want
    bucket = {}
    assert all(bucket.setdefault(r["ngram"], r["bucket"]) == r["bucket"] for r in held)
    assert set(bucket.values()) == set(range(16))
    pairs = [(bucket[a], bucket[b]) for t in texts for a, b in zip(naive_grams(t, 13), naive_grams(t, 13)[1:])]
    assert sum(a == b for a, b in pairs) > 0.7 * len(pairs)
    # 34 bytes a gram with buckets by the whole gram
    stored = sum(f.stat().st_size for f in (tmp_path / "index").rglob("*.parquet"))
    assert stored < 25 * len(held)


def test_index_is_read_back_document_by_document(spark, tmp_path):
    path = str(tmp_path / "index")
    N.write_ngram_index(frame(spark, [f"a b c d{i} e f g h" for i in range(40)]), path, "id", "text", 3, buckets=4)
    back = N.read_ngram_index(spark, path, "id").withColumn("_p", F.spark_partition_id()).collect()
    seen = [(r["_p"], r["id"]) for r in back]
    runs = [x for k, x in enumerate(seen) if not k or seen[k - 1] != x]
    assert len(back) == 240 and len(runs) == len(set(runs))


@pytest.mark.parametrize("n", [1, 2, 13])
def test_gram_marks_follow_the_grams(spark, n):
    texts = [("a b c d",), ("",), (None,), ("a",), ("x a b c d a b",), ("é😀 " * 20 + "b",), ("w" * 300 + " a" * 30,)]
    t = F.col("t")
    rows = spark.createDataFrame(texts, "t string").select(
        "t", T.grams(T.normalize_spaced(t), n).alias("g"), T.gram_marks(T.normalize_spaced(t), n).alias("m")
    ).collect()
    known = {}
    for row in rows:
        assert len(row.m or []) == len(row.g or [])
        for gram, code in zip(row.g or [], row.m or []):
            assert known.setdefault(gram, code) == code
            assert code >> 56 == min(127, max(map(len, gram.split())))
