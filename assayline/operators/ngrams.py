"""n-gram indexes, contamination marks, cleaning and corpus statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.fixed_values import (
    CLEAN_MAX_MATCHES,
    CLEAN_MIN_CHARS,
    CLEAN_WINDOW,
    CORPUS_BUCKETS,
    CORPUS_NGRAM,
    FREQUENT_DOCS,
    QUESTION_NGRAM,
)
from assayline.functions.text import (
    gram_hashes,
    gram_marks,
    gram_starts,
    grams,
    normalize,
    normalize_spaced,
    normalize_strict,
    word_spans,
)
from assayline.operators.bits import bit_table
from assayline.operators.leaders import displaced, same, side
from assayline.operators.scale import (
    BROADCAST_ROWS,
    broadcast_if_small,
    first_k,
    is_scan,
    small,
)
from assayline.session import materialize

#: Text of one task whose grams are sorted or grouped.
PART_BYTES = 8 << 20
#: Text of a task for each bucket it writes: the grams of one index file fit the window of zstd.
FILE_BYTES = 128 << 10
#: Index files: a column of a file is one page, so that zstd sees the grams that overlap. Version 2
#: writes a gram without what it shares with the one before.
INDEX_FILES = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "9",
    "parquet.writer.version": "v2",
    "parquet.page.size": str(64 << 20),
    "parquet.page.row.count.limit": str(1 << 22),
    "parquet.enable.dictionary": "false",
}


def ngram_rows(
    df: DataFrame,
    ids: Sequence[str],
    text: str,
    n: int = QUESTION_NGRAM,
    normalizer=normalize,
    distinct: bool = True,
) -> DataFrame:
    """One row ``(ids, ngram)`` per gram; repeats inside a text merge before explode."""
    found = grams(normalizer(F.col(text)), n)
    if distinct:
        found = F.array_distinct(found)
    return df.select(*ids, F.explode(found).alias("ngram"))


def hashed_ngrams(df: DataFrame, ids: Sequence[str], text: str, n: int) -> DataFrame:
    """``ngram_rows`` with the hash ``_g`` of every gram beside it, and with repeats: structs of a
    text are not made distinct in the row, which takes quadratic time."""
    plain = df.select(*ids, normalize(F.col(text)).alias("_t"))
    both = F.arrays_zip(grams(F.col("_t"), n).alias("ngram"), gram_hashes(F.col("_t"), n).alias("_g"))
    return plain.select(*ids, F.inline(both))


def in_parts(df: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """Rows dealt to tasks of about ``size`` (``PART_BYTES``) bytes of text, which is moved once: the
    grams of a task, several times its text, can then be sorted or grouped in memory."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(1, -(-total // (size or PART_BYTES))))


def _row_counts(found: Column) -> Column:
    """Array of (ngram, n): the distinct values of an array of texts and how often each is
    in it. The array is sorted once; equal values are neighbours."""
    last = F.lit(-1)

    def runs(a: Column) -> Column:
        is_first = lambda i: (i == 0) | (F.get(a, i) != F.get(a, i + last))
        at = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        starts = F.array(F.filter(at, is_first))

        def counted(s: Column) -> Column:
            return F.transform(
                s,
                lambda p, k: F.struct(
                    F.get(a, p).alias("ngram"),
                    (F.coalesce(F.get(s, k + 1), F.size(a)) - p).cast("long").alias("n"),
                ),
            )

        # lambdas over arrays of one element: the value is computed once, not for every use
        return F.get(F.transform(starts, counted), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(found)), runs), F.lit(0))


def ngram_counts(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """Rows ``(doc_id, ngram, n)``: how often a gram is in the texts of an id. Counted inside
    the row; only texts that share an id (null is one) are added up by a shuffle."""
    shared = df.groupBy(doc_id).count().where("count > 1").select(F.col(doc_id).alias("_k0"))
    shared = materialize(shared, "shared-ids")

    def counted(part: DataFrame) -> DataFrame:
        found = _row_counts(grams(normalize(F.col(text)), n))
        return part.select(doc_id, F.inline(found))

    if shared.isEmpty():
        return counted(df)
    shared = broadcast_if_small(shared)
    alone = df.join(shared, same([doc_id]), "left_anti")
    rest = counted(df.join(shared, same([doc_id]), "left_semi"))
    summed = rest.groupBy(doc_id, "ngram").agg(F.sum("n").alias("n"))
    return counted(alone).unionAll(summed)


def ngram_index(df: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """Inverted index as a long table of distinct ``(ngram, doc_id)``. Repeats inside a text
    merge in the row; only texts that share an id (null is one) are compared by a shuffle."""
    shared = df.groupBy(doc_id).count().where("count > 1").select(F.col(doc_id).alias("_k0"))
    shared = materialize(shared, "shared-ids")
    if shared.isEmpty():
        return ngram_rows(df, [doc_id], text, n).select("ngram", doc_id)
    shared = broadcast_if_small(shared)
    alone = df.join(shared, same([doc_id]), "left_anti")
    rest = df.join(shared, same([doc_id]), "left_semi")
    parts = [ngram_rows(part, [doc_id], text, n).select("ngram", doc_id) for part in (alone, rest)]
    return parts[0].unionAll(parts[1].distinct())


def keep_known(df: DataFrame, known: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the stored table ``known`` of distinct keys.

    Within the bounds of a broadcast this is one. Beyond them a bit table of the keys drops
    rows where they are read, and only the survivors are shuffled to be compared whole.
    """
    if small(known, max_rows):
        return df.join(F.broadcast(known), key, "left_semi")
    code = F.col(key) if dict(known.dtypes)[key] == "bigint" else F.xxhash64(key)
    table = bit_table(known.select(code.alias("_code")), "_code", known.count())
    return table.survivors(df, code).join(known, key, "left_semi")


def contaminated_by(
    train: DataFrame,
    ids: Sequence[str],
    text: str,
    protected: DataFrame,
    n: int = QUESTION_NGRAM,
    max_rows: int = BROADCAST_ROWS,
    normalizer=normalize,
) -> DataFrame:
    """Ids of ``train`` rows holding any gram of the ``protected`` table (``ngram``).

    A protected set within the row and byte bounds of a broadcast is broadcast, so the corpus
    is scanned once and only the hits are shuffled. Beyond ``max_rows`` a bit table of the
    64-bit gram hashes drops corpus grams where they are read, and the survivors' hashes are
    shuffled to find candidate rows; the grams of the candidates are then compared as text,
    again without moving the protected side.
    """
    protected = protected if is_scan(protected) else materialize(protected, "protected")
    if small(protected, max_rows):
        rows = ngram_rows(train, ids, text, n, normalizer)
        hits = rows.join(F.broadcast(protected), "ngram", "left_semi")
        return hits.select(*ids).distinct()

    hashes = F.transform(grams(normalizer(F.col(text)), n), lambda g: F.xxhash64(g))
    coarse = train.select(*ids, F.explode(F.array_distinct(hashes)).alias("_g"))
    known = protected.select(F.xxhash64("ngram").alias("_g")).distinct()
    known = materialize(known, "protected-hashes")
    candidates = keep_known(coarse, known, "_g", max_rows).select(*ids).distinct()
    candidates = materialize(candidates, "candidates")
    narrowed = train.join(broadcast_if_small(candidates, max_rows), list(ids), "left_semi")
    rows = ngram_rows(narrowed, ids, text, n, normalizer)
    found = matching_grams(protected, rows, max_rows)
    return rows.join(found, "ngram", "left_semi").select(*ids).distinct()


def contaminated(
    train: DataFrame,
    test: DataFrame,
    ids: Sequence[str],
    text: str,
    test_text: str,
    n: int = QUESTION_NGRAM,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    protected = ngram_rows(test, [], test_text, n).distinct()
    return contaminated_by(train, ids, text, protected, n, max_rows)


def decontaminate(
    train: DataFrame,
    test: DataFrame,
    ids: Sequence[str],
    text: str,
    test_text: str,
    n: int = QUESTION_NGRAM,
) -> tuple[DataFrame, DataFrame]:
    """Remaining rows and a one-row report; the marks are computed once."""
    flagged = materialize(
        contaminated(train, test, ids, text, test_text, n), "contaminated"
    )
    kept = train.join(broadcast_if_small(flagged), list(ids), "left_anti")
    marks = train.select(*ids).join(
        broadcast_if_small(flagged.withColumn("_hit", F.lit(1))), list(ids), "left"
    )
    total, bad = F.count(F.lit(1)), F.count("_hit")
    report = marks.agg(
        total.alias("total"),
        bad.alias("contaminated"),
        F.coalesce(F.try_divide(bad * 100.0, total), F.lit(0.0)).alias("rate_percent"),
        (total - bad).alias("remaining"),
    )
    return kept, report


def decontaminate_sources(
    sources: Sequence[DataFrame],
    test: DataFrame,
    ids: Sequence[str],
    text: str,
    test_text: str,
    n: int = QUESTION_NGRAM,
    select: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ordered fold: kept rows of a source protect all later sources.

    ``select`` picks among the clean rows of a source; rows it leaves out are dropped and
    protect nothing.

    Only a gram that is protected or met in two sources can decide anything: one count by
    64-bit hash finds those, and only their rows are stored. Without ``select`` these rows are
    settled in rounds (`leaders.displaced`), whose number does not grow with the number of sources, and
    grams are compared as text; rows of a source that share their ids (nulls are equal) are
    one row. With it the loop runs over sources: it joins hashes to find suspects, and
    compares grams as text only between suspects and the rows that share a hash with them.
    """
    place = ["source_rank", *ids]
    rows = [
        s.select(F.lit(i).alias("source_rank"), *ids, text) for i, s in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, rows)
    hashes = rows.select(*place, gram_hashes(normalize(F.col(text)), n).alias("_g"))
    hashed = hashes.select(*place, F.explode("_g").alias("_g"))
    fixed = materialize(hashed_ngrams(test, [], test_text, n).distinct(), "grams")
    met = hashed.groupBy("_g").agg(F.min("source_rank").alias("lo"), F.max("source_rank").alias("hi"))
    deciding = met.where("lo < hi").select("_g").unionByName(fixed.select("_g")).distinct()
    deciding = materialize(deciding, "deciding")
    marked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    whole = reduce(lambda a, b: a.unionByName(b), marked)
    if select is None:
        # the grams are built for the rows that hold a deciding hash, not for all
        holders = materialize(keep_known(hashed, deciding, "_g").select(*place).distinct(), "holders")
        open_rows = rows.join(broadcast_if_small(side(holders, place)), same(place), "left_semi")
        told = hashed_ngrams(open_rows, place, text, n)
        held = materialize(keep_known(told, deciding, "_g").drop("_g").distinct(), "held")
        removed = displaced(held, place, "source_rank", "ngram", fixed)
        return whole.join(broadcast_if_small(side(removed, place)), same(place), "left_anti")
    hashed = materialize(keep_known(hashed, deciding, "_g").distinct(), "hashes", ["source_rank"])

    removed: DataFrame | None = None
    for rank, source in enumerate(sources):
        earlier = hashed.where(F.col("source_rank") < rank)
        if removed is not None:
            earlier = earlier.join(broadcast_if_small(removed), place, "left_anti")
        known = fixed.select("_g").unionByName(earlier.select("_g")).distinct()
        own = hashed.where(F.col("source_rank") == rank)
        hits = materialize(own.join(known, "_g", "left_semi").select(*ids, "_g"), "hits")
        hint = F.broadcast if hits.count() <= BROADCAST_ROWS else (lambda df: df)
        wanted = hint(hits.select("_g").distinct())

        def wanted_grams(df: DataFrame, cols: Sequence[str], wanted=wanted) -> DataFrame:
            found = hashed_ngrams(df, cols, text, n)
            return found.join(wanted, "_g", "left_semi").drop("_g")

        proof = fixed.join(wanted, "_g", "left_semi").select("ngram")
        if rank:
            holders = earlier.join(wanted, "_g", "left_semi").select(*place).distinct()
            holders = broadcast_if_small(materialize(holders, "holders"))
            before = rows.where(F.col("source_rank") < rank)
            proof = proof.unionByName(
                wanted_grams(before.join(holders, place, "left_semi"), [])
            )
        suspects = source.join(hint(hits.select(*ids).distinct()), list(ids), "left_semi")
        agreed = wanted_grams(suspects, ids).join(proof, "ngram", "left_semi")
        flagged = agreed.select(F.lit(rank).alias("source_rank"), *ids).distinct()
        flagged = materialize(flagged, "flagged")
        bad = broadcast_if_small(flagged.select(*ids))
        picked = select(source.join(bad, list(ids), "left_anti")).select(*ids)
        picked = broadcast_if_small(materialize(picked, "picked"))
        left = source.select(*ids).join(picked, list(ids), "left_anti").distinct()
        flagged = materialize(left.select(F.lit(rank).alias("source_rank"), *ids), "left-out")
        removed = flagged if removed is None else removed.unionByName(flagged)

    return whole.join(broadcast_if_small(removed), place, "left_anti")


def ngrams_with_offsets(
    df: DataFrame, ids: Sequence[str], text: str, n: int
) -> DataFrame:
    """Rows ``(ids, ngram, start, stop)`` over the original text, inclusive ends."""
    spans = df.select(*ids, word_spans(F.col(text)).alias("_s"))
    s = F.col("_s")
    pieces = F.transform(
        gram_starts(s, n),
        lambda i: F.struct(
            F.concat_ws(" ", *[F.get(s, i + k)["word"] for k in range(n)]).alias("ngram"),
            F.get(s, i)["start"].alias("start"),
            F.get(s, i + (n - 1))["stop"].alias("stop"),
        ),
    )
    return spans.select(*ids, F.inline(pieces))


def _cut(text: Column, spans: Column, window: int, min_chars: int) -> Column:
    """Chunks left after cutting ``window`` characters around the ordered spans."""
    size = F.length(text)
    start_state = F.struct(
        F.lit(0).alias("splice"),
        F.lit(-1).alias("stop"),
        F.array().cast("array<string>").alias("chunks"),
    )

    def step(state: Column, span: Column) -> Column:
        left = F.greatest(F.lit(0), span["start"] - window)
        right = F.least(size, span["stop"] + window)
        piece = F.substring(text, state["splice"] + 1, left - state["splice"])
        return F.struct(
            right.alias("splice"),
            right.alias("stop"),
            F.when(
                left - state["splice"] > min_chars,
                F.array_append(state["chunks"], piece),
            )
            .otherwise(state["chunks"])
            .alias("chunks"),
        )

    def finish(state: Column) -> Column:
        tail = F.substring(text, state["stop"] + 2, size)
        return F.when(
            state["stop"] < size - min_chars, F.array_append(state["chunks"], tail)
        ).otherwise(state["chunks"])

    return F.aggregate(spans, start_state, step, finish)


def clean_chunks(
    df: DataFrame,
    dirty: DataFrame,
    doc_id: str,
    text: str,
    n: int = CORPUS_NGRAM,
    window: int = CLEAN_WINDOW,
    max_matches: int = CLEAN_MAX_MATCHES,
    min_chars: int = CLEAN_MIN_CHARS,
    compat: bool = True,
) -> DataFrame:
    """Clean chunks ``(doc_id, chunk_no, chunk)`` around matches of ``dirty`` grams.

    Clean texts shorter than ``min_chars`` are dropped too; ``compat=False`` keeps them
    whole. Documents with more than ``max_matches`` matches are dropped.
    """
    dirty = materialize(dirty.select("ngram").distinct(), "dirty")
    # a cheap scan that can only find too many rows, then positions for those alone
    marked = contaminated_by(df, [doc_id], text, dirty, n, normalizer=normalize_spaced)
    marked = materialize(marked, "marked")
    suspects = df.join(broadcast_if_small(marked), doc_id, "left_semi")
    scanned = ngrams_with_offsets(suspects, [doc_id], text, n).withColumn(
        "ngram", normalize_strict(F.col("ngram"))
    )
    hits = scanned.join(broadcast_if_small(dirty), "ngram", "left_semi").drop("ngram")
    # one match more than allowed is enough to drop a document
    few = first_k(hits, [doc_id], [F.col("start"), F.col("stop")], max_matches + 1)
    spans = few.groupBy(doc_id).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_spans")
    )
    spans = materialize(spans, "spans")
    joined = df.select(doc_id, text).join(broadcast_if_small(spans), doc_id, "left")
    cut = _cut(F.col(text), F.col("_spans"), window, min_chars)
    nothing = F.array().cast("array<string>")
    whole = F.array(F.col(text))
    untouched = (
        F.when(F.length(text) >= min_chars, whole).otherwise(nothing)
        if compat
        else whole
    )
    chunks = (
        F.when(F.col("_spans").isNull(), untouched)
        .when(F.size("_spans") > max_matches, nothing)
        .otherwise(cut)
    )
    return joined.select(doc_id, F.posexplode(chunks).alias("chunk_no", "chunk"))


def dirty_ngrams(df: DataFrame, text: str, n: int = CORPUS_NGRAM) -> DataFrame:
    """Grams to cut: normalized without case and punctuation before splitting."""
    return ngram_rows(df, [], text, n, normalize_spaced).distinct()


def write_ngram_index(
    df: DataFrame,
    path: str,
    doc_id: str,
    text: str,
    n: int = CORPUS_NGRAM,
    buckets: int = CORPUS_BUCKETS,
) -> None:
    """Corpus index in hash buckets, sorted inside a file of a bucket, zstd Parquet.

    The texts are dealt to tasks of even size and each task writes one sorted file for every
    bucket, so the grams, many times the texts, are neither shuffled nor spilled, and a very
    frequent gram is spread over the tasks. The grams are computed once.

    The bucket is a hash of one word of the gram (``gram_marks``), so equal grams share it, and so
    do most grams that overlap: a file then holds their common words, and zstd writes these once.
    """
    order = ["bucket", "ngram", doc_id]
    dealt = in_parts(df.select(doc_id, text), text, min(PART_BYTES, buckets * FILE_BYTES))
    plain = dealt.select(doc_id, normalize_spaced(F.col(text)).alias("_t"))
    both = F.arrays_zip(grams(F.col("_t"), n).alias("ngram"), gram_marks(F.col("_t"), n).alias("_m"))
    bucket = F.pmod(F.xxhash64("_m"), F.lit(buckets)).cast("int").alias("bucket")
    rows = plain.select(doc_id, F.inline(both)).select(doc_id, "ngram", bucket)
    rows.sortWithinPartitions(*order).write.partitionBy("bucket").options(
        **INDEX_FILES, **{f"parquet.enable.dictionary#{doc_id}": "true"}
    ).parquet(path)


def read_ngram_index(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """Rows ``(ngram, doc_id)`` of a stored index, those of a document together inside a task: their
    grams overlap, so what is written of them takes about half the space of sorted grams."""
    return spark.read.parquet(path).select("ngram", doc_id).sortWithinPartitions(doc_id)


def frequent_ngrams(
    index: DataFrame, doc_id: str, min_docs: int = FREQUENT_DOCS
) -> DataFrame:
    """Grams found in more than ``min_docs`` documents, with that number. ``index`` has a
    gram once per document, so a plain count with partial sums is enough.

    A first pass counts 64-bit hashes, which can only find too many; the grams whose hash is
    frequent are then counted as text, and only these are shuffled as text.
    """
    per_hash = index.select(F.xxhash64("ngram").alias("_g"), doc_id).groupBy("_g")
    often = per_hash.agg(F.count(doc_id).alias("docs")).where(F.col("docs") > min_docs)
    often = materialize(often.select("_g"), "frequent")
    told = index.withColumn("_g", F.xxhash64("ngram"))
    counted = keep_known(told, often, "_g").groupBy("ngram").agg(F.count(doc_id).alias("docs"))
    return counted.where(F.col("docs") > min_docs)


def matching_grams(
    index: DataFrame, wanted: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Distinct wanted grams present in a (large) index. The index is not shuffled: wanted
    grams beyond a broadcast are looked up in a bit table first."""
    wanted = materialize(wanted.select("ngram").distinct(), "wanted")
    return keep_known(index.select("ngram"), wanted, "ngram", max_rows).distinct()


def train_overlap(
    tasks: DataFrame,
    index: DataFrame,
    ids: Sequence[str],
    text: str,
    n: int = CORPUS_NGRAM,
) -> DataFrame:
    """Ids (task, split, document) of evaluation rows found in the corpus index, which is read
    once; the grams of the evaluation texts are stored, and those found in the index."""
    rows = materialize(ngram_rows(tasks, ids, text, n, normalize_spaced), "wanted-grams")
    found = matching_grams(index, rows)
    return (
        rows.join(broadcast_if_small(found), "ngram", "left_semi")
        .select(*ids)
        .distinct()
    )


def overlap_stats(
    index: DataFrame, tasks: DataFrame, text: str, n: int = CORPUS_NGRAM
) -> DataFrame:
    """One row over the corpus index: all grams, distinct grams, and how many of the
    distinct ones occur in the evaluation texts or not. Grams are counted by a 128-bit hash,
    of which a task sends one row each; the evaluation grams are compared as text."""
    wanted = ngram_rows(tasks, [], text, n, normalize_spaced)
    found = matching_grams(index, wanted).agg(F.count(F.lit(1)).alias("matching"))
    codes = index.select(
        F.xxhash64("ngram").alias("_a"), F.xxhash64("ngram", F.lit(1)).alias("_b")
    )
    counts = index.agg(F.count(F.lit(1)).alias("total")).join(
        F.broadcast(codes.distinct().agg(F.count(F.lit(1)).alias("distinct_grams")))
    )
    return counts.join(F.broadcast(found)).withColumn(
        "non_matching", F.col("distinct_grams") - F.col("matching")
    )


def metric_clean(
    scores: DataFrame, flagged: DataFrame, ids: Sequence[str], by: Sequence[str], value: str
) -> DataFrame:
    """Mean of ``value`` over all rows and over rows not in ``flagged``."""
    marked = scores.join(
        broadcast_if_small(flagged.select(*ids).distinct().withColumn("_hit", F.lit(1))),
        list(ids),
        "left",
    )
    clean = F.when(F.col("_hit").isNull(), F.col(value))
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_hit").alias("n_contaminated"),
        F.avg(value).alias("score"),
        F.avg(clean).alias("score_clean"),
    )


def corpus_stats(df: DataFrame, file: str, text: str) -> DataFrame:
    """Documents, characters and first document offset per file, in file order."""
    from pyspark.sql import Window

    per_file = df.groupBy(file).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.length(text)).alias("characters"),
    )
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    return per_file.withColumn(
        "start_offset", F.coalesce(F.sum("documents").over(before), F.lit(0))
    )
