"""Registered queries of the operators in this package, with check SQL where it can be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import (
    covertree,
    decontaminate,
    dialogs,
    language,
    lines,
    mixing,
    packing,
    phrases,
    pii,
    repeats,
    simhash,
    tokens,
    toxicity,
)
from assayline.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_simhash")
def _(spark, sf):
    rows = simhash.classes(read(spark, sf, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("code")).alias("fingerprint"), "component_id")


@query("op2_personal_data")
def _(spark, sf):
    rows = pii.find_personal_data(read(spark, sf, "documents"))
    return rows.select("row.doc_id", *[c.alias(k) for k, c in pii.digest(F.col("found")).items()])


@query("op3_suffix_dedup")
def _(spark, sf):
    rows = repeats.remove_repeats(read(spark, sf, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op4_language_id")
def _(spark, sf):
    return language.identify(read(spark, sf, "documents"))


@query("op5_toxicity")
def _(spark, sf):
    rows = toxicity.score_documents(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return rows.select("row.doc_id", "held_out", "score", "predicted")


OP7_SQL = """
WITH e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         label IS NOT NULL AND embedding IS NOT NULL
         AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
         AND len([x FOR x IN embedding IF x <> 0]) > 0 AS ok
  FROM embeddings
), n AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE ok
), p AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), c AS (SELECT i, count(*) AS n_links FROM p GROUP BY i),
r AS (
  WITH RECURSIVE t(i, k) AS (
    SELECT vec_id, vec_id FROM e UNION SELECT t.i, p.j FROM t JOIN p ON p.i = t.k
  ) SELECT i, min(k) AS component_id FROM t GROUP BY i
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id,
       vec_id = component_id AS kept
FROM e JOIN r ON r.i = vec_id LEFT JOIN c ON c.i = vec_id
"""


@query("op7_embedding_dedup", OP7_SQL)
def _(spark, sf):
    return covertree.classes(read(spark, sf, "embeddings"))


WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {WORDS6} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i)
  WHERE len(w) > 0
), docs AS (SELECT doc_id, {WORDS6} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, lens WHERE len(w) >= n)
), found AS (
  SELECT doc_id, s.n, i, item FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def _(spark, sf):
    rows = decontaminate.scan_documents(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    facts = decontaminate.contamination(F.col("found"))
    return rows.select("row.doc_id", *[c.alias(k) for k, c in facts.items()])


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), often AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, coalesce(last <> doc_id, false) AS gone
  FROM k LEFT JOIN often USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def _(spark, sf):
    rows = lines.drop_frequent_lines(read(spark, sf, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op9_token_counts")
def _(spark, sf):
    return tokens.count_tokens(read(spark, sf, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3 AS cap,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), f AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, cap / (rank % 3 + 1)::DOUBLE AS fill FROM t),
v AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, rank
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), x AS (SELECT level AS mark FROM v WHERE fill >= level ORDER BY fill, rank LIMIT 1),
g AS (SELECT source, source_size, least(cap, (SELECT mark FROM x) * weight) AS target FROM v),
c AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id) - size
           AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target - passes * source_size) - before)))
         ::BIGINT AS taken
FROM c
"""


@query("op10_mixing", OP10_SQL)
def _(spark, sf):
    mixed = mixing.by_first_position(mixing.curriculum(read(spark, sf, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op11_best_fit_packing")
def _(spark, sf):
    limits = packing.Capacity(tokens=1024, documents=1024, attention=1024 * 1024)
    return packing.pack_documents(read(spark, sf, "documents"), capacity=limits).select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        "sequence_id",
        "offset",
    )


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(list_prepend(i, range(8)), lambda c, b:
            CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
          FOR i IN range(256)] AS t
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), hashed AS (
  SELECT raw.*, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(name, '')]),
           lambda c, b: xor(t[(xor(c, b) % 256) + 1], c >> 8))) % 20 AS h
  FROM raw, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
           AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE h <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
              ORDER BY turn NULLS FIRST, role, text, copy) AS pos
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1
                   THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated'
                 ELSE 'none' END AS fault,
         left(role, 1) AS i,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM ordered
), go(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
states AS (SELECT unnest(range(4))::INT AS p),
ins(p, q, n, path) AS (
  SELECT p, p, 0, '' FROM states
  UNION ALL
  SELECT ins.p, go.q, n + 1, path || CASE go.r WHEN 'u' THEN 'H' ELSE 'I' END
  FROM ins JOIN go ON go.p = ins.q WHERE go.r <> 's' AND n < 3
), edits AS (
  SELECT f.fault, x.i, p, p AS q, 4 AS cost, 'D' AS e
  FROM states, (VALUES ('none'), ('truncated'), ('blank'), ('duplicate')) f(fault),
       (VALUES ('s'), ('u'), ('a'), ('x')) x(i)
  UNION ALL
  SELECT f.fault, x.i, go.p, go.q, 3 + f.more, CASE go.r WHEN 'u' THEN 'R' ELSE 'S' END
  FROM go, (VALUES ('none', 0), ('truncated', 3)) f(fault, more),
       (VALUES ('s'), ('u'), ('a'), ('x')) x(i)
  WHERE go.r <> 's'
  UNION ALL
  SELECT f.fault, go.r, go.p, go.q, f.more, 'K'
  FROM go, (VALUES ('none', 0), ('truncated', 3)) f(fault, more)
), moves AS (
  SELECT fault, i, a.p, b.q,
         min({'cost': 3 * a.n + cost + 3 * b.n, 'path': a.path || e || b.path}) AS best
  FROM edits JOIN ins a ON a.q = edits.p JOIN ins b ON b.p = edits.q GROUP BY ALL
), walk(conv_id, pos, st, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0, 'path': ''} FROM judged
  UNION ALL
  SELECT w.conv_id, j.pos, m.q,
         min({'cost': w.best.cost + m.best.cost, 'path': w.best.path || m.best.path})
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1
  JOIN moves m ON m.fault = j.fault AND m.p = w.st
       AND m.i = CASE WHEN j.i IN ('s', 'u', 'a') THEN j.i ELSE 'x' END
  GROUP BY w.conv_id, j.pos, m.q
), facts AS (
  SELECT conv_id, max(pos) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au'))
           AS illegal
  FROM judged GROUP BY conv_id
), best AS (
  SELECT f.*, (SELECT min(w.best) FROM walk w WHERE w.pos = f.n AND w.st IN (0, 3)
               AND w.conv_id IS NOT DISTINCT FROM f.conv_id) AS best
  FROM facts f
), letters AS (
  SELECT conv_id, unnest(string_split(best.path, '')) AS e,
         generate_subscripts(string_split(best.path, ''), 1) AS k
  FROM best
), placed AS (
  SELECT conv_id, e, k, count(*) FILTER (WHERE e IN ('D', 'K', 'R', 'S'))
           OVER (PARTITION BY conv_id ORDER BY k) AS pos
  FROM letters
), lines AS (
  SELECT p.conv_id, string_agg(
           CASE WHEN e IN ('H', 'R') THEN 'user' WHEN e IN ('I', 'S') THEN 'assistant'
                ELSE role END || ':' || CASE WHEN e IN ('H', 'I') THEN '' ELSE text END,
           chr(10) ORDER BY k) AS whole
  FROM placed p LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.pos = p.pos
  WHERE e <> 'D' GROUP BY p.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       translate(coalesce(best.path, ''), 'HS', 'IR') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_repair", OP13_SQL)
def _(spark, sf):
    return dialogs.repair_damaged(read(spark, sf, "conversations"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
  GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k
  FROM grams WHERE m > 1
), scores AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, l.a AS l, r.a AS r, n,
         (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
), best AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, unnest(list_distinct(flatten(
           [[array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ')
             FOR i IN range(1, m - s + 2)] FOR s IN range(2, m)]))) AS phrase, a AS longer
  FROM grams WHERE m > 2
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase
    AND 100 * i.longer >= 100 * b.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept
QUALIFY rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def _(spark, sf):
    return phrases.collocations(read(spark, sf, "documents"))
