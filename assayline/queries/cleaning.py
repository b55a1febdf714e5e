"""n-grams, contamination and corpus statistics on documents and benchmark."""

from pyspark.sql import functions as F

from assayline.fixed_values import CLEAN_MAX_MATCHES, CLEAN_MIN_CHARS, CLEAN_WINDOW
from assayline.functions import text as T
from assayline.operators import ngrams as N
from assayline.operators import selection as S
from assayline.operators.aggregate import value_counts
from assayline.queries import query, table, texts
from assayline.queries.sqltext import grams, norm, strict
from assayline.session import scratch_path

DOC8 = grams("documents", "doc_id", 8)
BEN8 = grams("benchmark", "", 8)
HIT8 = f"SELECT DISTINCT doc_id FROM ({DOC8}) WHERE ngram IN (SELECT ngram FROM ({BEN8}))"


@query("c1_normalize", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def _(spark, sf):
    return texts(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(
    "c2_word_ngrams",
    f"SELECT doc_id, ngram, count(*) AS n FROM ({grams('documents', 'doc_id', 13)}) GROUP BY ALL",
)
def _(spark, sf):
    return N.ngram_counts(texts(spark, sf), "doc_id", "text", 13)


@query("c3_ngram_index", f"SELECT DISTINCT ngram, doc_id FROM ({DOC8})")
def _(spark, sf):
    return N.ngram_index(texts(spark, sf), "doc_id", "text", 8)


@query("c4_contaminated", HIT8)
def _(spark, sf):
    return N.contaminated(
        texts(spark, sf), table(spark, sf, "benchmark"), ["doc_id"], "text", "text"
    )


@query("c4_contaminated_large_set", HIT8)
def _(spark, sf):
    return N.contaminated(
        texts(spark, sf),
        table(spark, sf, "benchmark"),
        ["doc_id"],
        "text",
        "text",
        max_rows=0,
    )


@query("c5_decontaminate", f"SELECT doc_id, lang FROM documents WHERE doc_id NOT IN ({HIT8})")
def _(spark, sf):
    kept, _report = N.decontaminate(
        texts(spark, sf), table(spark, sf, "benchmark"), ["doc_id"], "text", "text"
    )
    return kept.select("doc_id", "lang")


@query(
    "c5_decontaminate_report",
    f"""SELECT count(*) AS total, count(h.doc_id) AS contaminated,
        round(count(h.doc_id) * 100.0 / count(*), 6) AS rate_percent,
        count(*) - count(h.doc_id) AS remaining
        FROM documents d LEFT JOIN ({HIT8}) h ON h.doc_id = d.doc_id""",
)
def _(spark, sf):
    _kept, report = N.decontaminate(
        texts(spark, sf), table(spark, sf, "benchmark"), ["doc_id"], "text", "text"
    )
    return report.withColumn("rate_percent", F.round("rate_percent", 6))


LANGS = ["en", "de", "es", "fr"]


def _fold_sql(pick: str = "") -> str:
    parts = [f"g0 AS MATERIALIZED (SELECT DISTINCT ngram FROM ({BEN8}))"]
    parts.append(f"d AS MATERIALIZED ({DOC8})")
    for i, lang in enumerate(LANGS):
        parts.append(
            f"k{i} AS MATERIALIZED (SELECT doc_id FROM documents WHERE lang = '{lang}' AND doc_id NOT IN "
            f"(SELECT doc_id FROM d WHERE ngram IN (SELECT ngram FROM g{i})) {pick})"
        )
        parts.append(
            f"g{i + 1} AS MATERIALIZED (SELECT ngram FROM g{i} UNION "
            f"SELECT ngram FROM d WHERE doc_id IN (SELECT doc_id FROM k{i}))"
        )
    picks = " UNION ALL ".join(f"SELECT doc_id, {i} AS source_rank FROM k{i}" for i in range(len(LANGS)))
    return f"WITH {', '.join(parts)} {picks}"


@query("c6_decontaminate_sources", _fold_sql())
def _(spark, sf):
    docs = texts(spark, sf)
    kept = N.decontaminate_sources(
        [docs.where(F.col("lang") == lang) for lang in LANGS],
        table(spark, sf, "benchmark"),
        ["doc_id"],
        "text",
        "text",
    )
    return kept.select("doc_id", "source_rank")


@query(
    "c6_select_sources",
    _fold_sql("QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"),
)
def _(spark, sf):
    docs = texts(spark, sf)
    kept = N.decontaminate_sources(
        [docs.where(F.col("lang") == lang) for lang in LANGS],
        table(spark, sf, "benchmark"),
        ["doc_id"],
        "text",
        "text",
        select=lambda clean: S.dedup_first(clean, "text", ["doc_id"]),
    )
    return kept.select("doc_id", "source_rank")


@query("c7_normalize_strict", f"SELECT item_id, {strict('text')} AS norm FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", T.normalize_strict(F.col("text")).alias("norm")
    )


def positions_sql(n: int) -> str:
    """CTEs ending in ``placed``: (doc_id, ngram, start, stop) of the raw document texts. A word
    starts after all words and all white space before it."""
    words = ", ".join(f"lead(word, {k}) OVER o" for k in range(1, n))
    return f"""t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w,
          regexp_split_to_array(text, '\\S+') AS s FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, unnest(s[1:len(w)]) AS gap, unnest(range(1, len(w) + 1)) AS i FROM t),
        q AS (SELECT doc_id, i, word, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM p),
        placed AS (SELECT doc_id, concat_ws(' ', word, {words}) AS ngram, CAST(after - length(word) AS INTEGER) AS start,
          CAST(lead(after, {n - 1}) OVER o - 1 AS INTEGER) AS stop FROM q
          WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(after, {n - 1}) OVER o IS NOT NULL)"""


@query("c7_ngrams_with_offsets", f"WITH {positions_sql(5)} SELECT * FROM placed")
def _(spark, sf):
    return N.ngrams_with_offsets(texts(spark, sf), ["doc_id"], "text", 5)


@query(
    "c8_clean_chunks",
    f"""WITH {positions_sql(8)},
        h AS (SELECT doc_id, start, stop FROM placed WHERE {strict("ngram")} IN
          (SELECT ngram FROM ({grams("benchmark", "", 8, strict("text"))}))),
        e AS (SELECT h.doc_id, text, length(text) AS size, greatest(0, start - {CLEAN_WINDOW}) AS l,
            least(length(text), stop + {CLEAN_WINDOW}) AS r, row_number() OVER v AS i, count(*) OVER (PARTITION BY h.doc_id) AS n
          FROM h JOIN documents d ON d.doc_id = h.doc_id WINDOW v AS (PARTITION BY h.doc_id ORDER BY start, stop)),
        c AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY doc_id ORDER BY i), 0) AS b FROM e WHERE n <= {CLEAN_MAX_MATCHES}),
        o AS (SELECT doc_id, 2 * i AS i, substring(text, b + 1, l - b) AS chunk FROM c WHERE l - b > {CLEAN_MIN_CHARS}
          UNION ALL SELECT doc_id, 2 * i + 1, substring(text, r + 2) FROM c WHERE i = n AND r < size - {CLEAN_MIN_CHARS}
          UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) >= {CLEAN_MIN_CHARS} AND doc_id NOT IN (SELECT doc_id FROM h))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, chunk FROM o""",
)
def _(spark, sf):
    dirty = N.dirty_ngrams(table(spark, sf, "benchmark"), "text", 8)
    return N.clean_chunks(texts(spark, sf), dirty, "doc_id", "text", n=8)


@query(
    "c9_write_ngram_index",
    f"SELECT ngram, doc_id FROM ({grams('documents', 'doc_id', 13, strict('text'))})",
)
def _(spark, sf):
    path = scratch_path(spark, "grams13")
    N.write_ngram_index(texts(spark, sf), path, "doc_id", "text", 13, buckets=16)
    return N.read_ngram_index(spark, path, "doc_id")


@query(
    "c10_frequent_ngrams",
    f"SELECT ngram, count(DISTINCT doc_id) AS docs FROM ({DOC8}) GROUP BY ngram HAVING count(DISTINCT doc_id) > 10",
)
def _(spark, sf):
    # one row per document: repeats merge inside the text, so one shuffle counts the grams
    rows = N.ngram_rows(N.in_parts(texts(spark, sf).select("doc_id", "text"), "text"), ["doc_id"], "text", 8)
    return N.frequent_ngrams(rows, "doc_id")


BEN_STRICT = grams("benchmark", "item_id", 8, strict("text"))
DOC_STRICT = grams("documents", "doc_id", 8, strict("text"))


@query(
    "c11_train_overlap",
    f"SELECT DISTINCT item_id FROM ({BEN_STRICT}) WHERE ngram IN (SELECT ngram FROM ({DOC_STRICT}))",
)
def _(spark, sf):
    index = N.ngram_rows(texts(spark, sf), ["doc_id"], "text", 8, T.normalize_spaced)
    return N.train_overlap(table(spark, sf, "benchmark"), index, ["item_id"], "text", 8)


DOC_STRICT13 = grams("documents", "doc_id", 13, strict("text"))


@query(
    "c12_overlap_stats",
    f"""WITH i AS ({DOC_STRICT13}), u AS (SELECT DISTINCT ngram FROM i),
        m AS (SELECT ngram FROM u WHERE ngram IN
          (SELECT ngram FROM ({grams("benchmark", "", 13, strict("text"))})))
        SELECT (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM u) AS distinct_grams,
        (SELECT count(*) FROM m) AS matching,
        (SELECT count(*) FROM u) - (SELECT count(*) FROM m) AS non_matching""",
)
def _(spark, sf):
    path = scratch_path(spark, "grams13")
    N.write_ngram_index(texts(spark, sf), path, "doc_id", "text", buckets=16)
    return N.overlap_stats(spark.read.parquet(path), table(spark, sf, "benchmark"), "text")


@query(
    "c13_metric_clean",
    f"""WITH h AS ({HIT8})
        SELECT d.lang, count(*) AS n, count(h.doc_id) AS n_contaminated,
        round(avg(l.quality), 6) AS score,
        round(avg(CASE WHEN h.doc_id IS NULL THEN l.quality END), 6) AS score_clean
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN h ON h.doc_id = l.doc_id
        GROUP BY d.lang""",
)
def _(spark, sf):
    docs = texts(spark, sf)
    flagged = N.contaminated(docs, table(spark, sf, "benchmark"), ["doc_id"], "text", "text")
    scores = table(spark, sf, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    out = N.metric_clean(scores, flagged, ["doc_id"], ["lang"], "quality")
    return out.withColumns({c: F.round(c, 6) for c in ["score", "score_clean"]})


@query(
    "c14_corpus_stats",
    """SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters,
       CAST(coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS BIGINT) AS start_offset
       FROM documents GROUP BY source""",
)
def _(spark, sf):
    return N.corpus_stats(texts(spark, sf), "source", "text")


@query(
    "flow_clean_counts",
    f"""WITH c AS (SELECT * FROM documents WHERE doc_id NOT IN ({HIT8})),
        d AS (SELECT lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM c)
        SELECT lang, count(*) AS n FROM d WHERE rn = 1 GROUP BY lang""",
)
def _(spark, sf):
    kept, _report = N.decontaminate(
        texts(spark, sf), table(spark, sf, "benchmark"), ["doc_id"], "text", "text"
    )
    return value_counts(S.dedup_first(kept, "text", ["doc_id"]), "lang")
