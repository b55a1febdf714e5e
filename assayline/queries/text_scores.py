"""Token, n-gram, edit and instruction scores on documents and conversations."""

import re

from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.functions import checks as C
from assayline.operators import aggregate as A
from assayline.operators import text_scores as S
from assayline.queries import query, table
from assayline.queries.answers import EN, qa_sql
from assayline.queries.sqltext import word_list

# Prediction of a turn: its text without the first word; reference: the whole text.
PRED = "regexp_replace(text, '^\\S+\\s*', '')"


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role",
        F.col("text").alias("ref"),
        F.regexp_replace("text", r"^\S+\s*", "").alias("pred"),
    )


IDS = ["conv_id", "turn"]


def bag_sql(source: str, ids: str, pred: str, ref: str) -> str:
    """(ids, match, p, r) from two normalized expressions."""
    keys = ids.replace(" ", "").split(",")
    same = " AND ".join(f"n.{k} = x.{k}" for k in keys)
    return f"""(WITH x AS (SELECT {ids}, {word_list(pred)} AS pw, {word_list(ref)} AS rw FROM {source}),
      pc AS (SELECT {ids}, w, count(*) AS c FROM (SELECT {ids}, unnest(pw) AS w FROM x) GROUP BY ALL),
      rc AS (SELECT {ids}, w, count(*) AS c FROM (SELECT {ids}, unnest(rw) AS w FROM x) GROUP BY ALL),
      n AS (SELECT {", ".join(f"pc.{k}" for k in keys)}, sum(least(pc.c, rc.c)) AS m FROM pc JOIN rc
        ON {" AND ".join(f"pc.{k} = rc.{k}" for k in keys)} AND pc.w = rc.w GROUP BY ALL)
      SELECT {", ".join(f"x.{k}" for k in keys)}, coalesce(m, 0) AS match, len(pw) AS p, len(rw) AS r FROM x LEFT JOIN n ON {same})"""


F1 = "CASE WHEN p + r = 0 THEN 1.0 ELSE 2.0 * match / (p + r) END"


@query(
    "g5_token_f1",
    f"""SELECT b.conv_id, b.turn, CAST({qa_sql(PRED, EN)} = {qa_sql('text', EN)} AS INT) AS em, round({F1}, 6) AS f1
        FROM {bag_sql('conversations', 'conv_id, turn', qa_sql(PRED, EN), qa_sql('text', EN))} b
        JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = b.turn""",
)
def _(spark, sf):
    out = S.token_scores(turns(spark, sf), IDS, "pred", "ref")
    return out.withColumn("f1", F.round("f1", 6))


REFS = """(SELECT conv_id, turn, {p} AS pred, unnest([text, role, 'the ' || role]) AS ref, unnest([0, 1, 2]) AS k FROM conversations)""".format(p=PRED)
PER_REF = f"""(SELECT b.conv_id, b.turn, b.k, {F1} AS f1, CAST({qa_sql('pred', EN)} = {qa_sql('ref', EN)} AS INT) AS em
    FROM {bag_sql(REFS, 'conv_id, turn, k', qa_sql('pred', EN), qa_sql('ref', EN))} b JOIN {REFS} c
    ON c.conv_id = b.conv_id AND c.turn = b.turn AND c.k = b.k)"""


def with_refs(spark, sf):
    return turns(spark, sf).withColumn("refs", F.array("ref", "role", F.concat(F.lit("the "), "role")))


@query(
    "g6_max_over_refs",
    f"SELECT conv_id, turn, max(em) AS em, round(max(f1), 6) AS f1 FROM {PER_REF} GROUP BY 1, 2",
)
def _(spark, sf):
    out = S.max_over_refs(with_refs(spark, sf), IDS, "pred", "refs")
    return out.withColumn("f1", F.round("f1", 6))


@query(
    "g7_leave_one_out",
    f"""WITH s AS {PER_REF}, l AS (SELECT a.conv_id, a.turn, a.k, max(b.em) AS em, max(b.f1) AS f1 FROM s a
          JOIN s b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.k <> b.k GROUP BY 1, 2, 3)
        SELECT conv_id, turn, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM l GROUP BY 1, 2""",
)
def _(spark, sf):
    out = S.leave_one_out(with_refs(spark, sf), IDS, "pred", "refs")
    return out.withColumns({c: F.round(c, 6) for c in ("em", "f1")})


@query(
    "g8_span_f1",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS em,
       CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.33 ELSE 0.83 END AS f1 FROM part""",
)
def _(spark, sf):
    kind = F.col("p_partkey") % 3
    gold = F.array("p_name", F.concat(F.lit("item "), F.col("p_partkey").cast("string")))
    pred = (
        F.when(kind == 0, F.array(F.concat(F.lit("Item "), F.col("p_partkey").cast("string"), F.lit(".0")), F.concat(F.lit("the "), "p_name")))
        .when(kind == 1, F.array(F.lit("item 0.5"), F.substring_index("p_name", " ", 1)))
        .otherwise(F.array(F.substring_index("p_name", " ", 1), F.concat(F.lit("item "), F.col("p_partkey").cast("string"))))
    )
    rows = table(spark, sf, "part").select("p_partkey", pred.alias("p"), F.array(gold).alias("g"))
    # a small file is one task whatever its rows cost
    rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return rows.select("p_partkey", S.span_f1("p", "g").alias("s")).select("p_partkey", "s.em", "s.f1")


@query(
    "h10_group_best",
    f"""WITH q AS (SELECT conv_id, turn, {qa_sql(PRED, EN)} AS p, {qa_sql('text', EN)} AS r FROM conversations),
        f AS (SELECT conv_id, arg_min(p, turn) AS fp FROM q GROUP BY 1),
        x AS (SELECT q.conv_id, q.turn, fp, r FROM q JOIN f ON f.conv_id = q.conv_id),
        b AS (SELECT conv_id, max(CASE WHEN match = 0 THEN 0.0 ELSE 2.0 * match / (p + r) END) AS f1 FROM {bag_sql('x', 'conv_id, turn', 'fp', 'r')} GROUP BY 1),
        e AS (SELECT conv_id, avg(CAST(p IN (SELECT r FROM q z WHERE z.conv_id = q.conv_id) AS INT)) AS em, count(*) AS n FROM q GROUP BY 1)
        SELECT e.conv_id, round(em, 6) AS em, n AS "rows", round(f1, 6) AS f1 FROM e JOIN b ON b.conv_id = e.conv_id""",
)
def _(spark, sf):
    out = S.group_best(turns(spark, sf), "conv_id", "turn", "pred", "ref")
    return out.withColumns({c: F.round(c, 6) for c in ("em", "f1")})


@query("g13_true_false_refs")
def _(spark, sf):
    rows = turns(spark, sf).withColumns(
        {"true_refs": F.array("ref", F.lit(" ")), "false_refs": F.array("role", F.reverse("ref"))}
    )
    out = None
    for metric in ("bleu", "rouge1", "rouge2", "rougeL"):
        part = S.true_false_refs(rows, IDS, "pred", "true_refs", "false_refs", metric)
        out = part if out is None else out.join(part, IDS)
    return out


# order k of prediction against both true and the two false references
TF_REFS = f"""(SELECT conv_id, turn * 10 + k AS turn, regexp_replace(lower({PRED}), '[^a-z0-9]+', ' ', 'g') AS p,
      regexp_replace(lower(ref), '[^a-z0-9]+', ' ', 'g') AS r FROM (SELECT *,
      unnest([CASE WHEN text LIKE '%.' THEN text ELSE text || '.' END, 'I have no comment.', role || '.',
        CASE WHEN reverse(text) LIKE '%.' THEN reverse(text) ELSE reverse(text) || '.' END]) AS ref, unnest([0, 1, 2, 3]) AS k
      FROM (SELECT * REPLACE (trim(text, ' ' || chr(10)) AS text) FROM conversations)))"""


def _tf_sql() -> str:
    union = " UNION ALL ".join(gram_counts(s, t, k) for k in (1, 2) for s, t in (("p", "pw"), ("r", "rw")))
    best = lambda k: (
        f"max(f) FILTER (k = {k} AND no < 2)", f"max(f) FILTER (k = {k} AND no >= 2)"
    )
    cols = ", ".join(
        f"round({best(k)[0]}, 6) AS rouge{k}_max, round({best(k)[0]} - {best(k)[1]}, 6) AS rouge{k}_diff, "
        f"CAST({best(k)[0]} > {best(k)[1]} AS INT) AS rouge{k}_acc" for k in (1, 2)
    )
    return f"""WITH x AS (SELECT conv_id, turn, {word_list('p')} AS pw, {word_list('r')} AS rw FROM {TF_REFS}),
        g AS ({union}), c AS (SELECT conv_id, turn, k, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL),
        m AS (SELECT conv_id, turn, k, 200.0 * sum(least(p, r)) / (sum(p) + sum(r)) AS f FROM c GROUP BY 1, 2, 3),
        f AS (SELECT x.conv_id, x.turn // 10 AS turn, x.turn % 10 AS no, o.k, coalesce(m.f, 0.0) AS f
          FROM x CROSS JOIN (SELECT unnest([1, 2]) AS k) o LEFT JOIN m ON m.conv_id = x.conv_id AND m.turn = x.turn AND m.k = o.k)
        SELECT conv_id, turn, {cols} FROM f GROUP BY 1, 2"""


def code_sql(col: str) -> str:
    """Token list of the code tokenizer, spaced again by the translation rules."""
    spaced = f"array_to_string(regexp_extract_all(lower(trim({col}, ' ' || chr(10))), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{M}}\\p{{N}}_]'), ' ')"
    out = f"' ' || {spaced} || ' '"
    for pattern, by in [
        ("([{-~\\[-` -&(-+:-@/])", " \\1 "), ("([^0-9])([.,])", "\\1 \\2 "),
        ("([.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 "),
    ]:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return word_list(f"({out})")


def gram_counts(name: str, tokens: str, order: int) -> str:
    return f"""SELECT conv_id, turn, unnest(list_transform(range(1, len({tokens}) - {order} + 2),
      lambda i: array_to_string({tokens}[i:i + {order} - 1], ' '))) AS g, {order} AS k, '{name}' AS side FROM x"""


GRAM_UNION = " UNION ALL ".join(gram_counts(s, t, k) for k in (1, 2, 3, 4) for s, t in (("p", "pw"), ("r", "rw")))
TINY = "2.2250738585072014e-308"
LOGS = " + ".join(
    f"ln(m{k} + {int(k > 1)} + {TINY}) - ln(p{k} + {int(k > 1)} + {TINY})" for k in (1, 2, 3, 4)
)


@query("g13_rouge_refs", _tf_sql())
def _(spark, sf):
    rows = turns(spark, sf).withColumns(
        {"true_refs": F.array("ref", F.lit(" ")), "false_refs": F.array("role", F.reverse(F.btrim("ref", F.lit(" \n"))))}
    )
    one, two = (
        S.true_false_refs(rows, IDS, "pred", "true_refs", "false_refs", m) for m in ("rouge1", "rouge2")
    )
    out = one.join(two, IDS)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("rouge") and not c.endswith("acc")})


@query(
    "g14_smoothed_bleu4",
    f"""WITH x AS (SELECT conv_id, turn, {code_sql(PRED)} AS pw, {code_sql('text')} AS rw FROM conversations),
        g AS ({GRAM_UNION}), c AS (SELECT conv_id, turn, k, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL),
        s AS (SELECT conv_id, turn, {", ".join(f"coalesce(sum(least(p, r)) FILTER (k = {k}), 0) AS m{k}, coalesce(sum(p) FILTER (k = {k}), 0) AS p{k}" for k in (1, 2, 3, 4))},
          coalesce(sum(r) FILTER (k = 1), 0) AS r1 FROM c GROUP BY 1, 2)
        SELECT x.conv_id, x.turn, round(100 * exp(({LOGS}) / 4 + least(0.0, 1 - (r1 + 1.0) / (p1 + 1.0))), 6) AS bleu
        FROM x JOIN s ON s.conv_id = x.conv_id AND s.turn = x.turn""",
)
def _(spark, sf):
    out = S.smoothed_bleu4(turns(spark, sf), IDS, "pred", "ref")
    return out.withColumn("bleu", F.round("bleu", 6))


def translation_sql(col: str) -> str:
    out = col
    for a, b in [("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&amp;'", "'&'")]:
        out = f"replace({out}, {a}, {b})"
    out = f"' ' || {out} || ' '"
    for pattern, by in [
        ("([{-~\\[-` -&(-+:-@/])", " \\1 "), ("([^0-9])([.,])", "\\1 \\2 "),
        ("([.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 "),
    ]:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return word_list(f"({out})")


# the same references with the words of the translation tokenizer
BLEU_REFS = f"""(SELECT conv_id, turn * 10 + k AS turn, {PRED} AS p, ref AS r FROM (SELECT *,
      unnest([CASE WHEN text LIKE '%.' THEN text ELSE text || '.' END, 'I have no comment.', role || '.',
        CASE WHEN reverse(text) LIKE '%.' THEN reverse(text) ELSE reverse(text) || '.' END]) AS ref, unnest([0, 1, 2, 3]) AS k
      FROM (SELECT * REPLACE (trim(text, ' ' || chr(10)) AS text) FROM conversations)))"""
FOUR = (1, 2, 3, 4)
ZEROS = {k: " + ".join(f"CAST(m{i} = 0 AS INT)" for i in FOUR[:k]) for k in FOUR}
SMOOTH = " + ".join(f"ln(CASE WHEN m{k} = 0 THEN 1 / (pow(2.0, {ZEROS[k]}) * p{k}) ELSE m{k} / p{k} END)" for k in FOUR)


@query(
    "g13_bleu_refs",
    f"""WITH x AS (SELECT conv_id, turn, {translation_sql('p')} AS pw, {translation_sql('r')} AS rw FROM {BLEU_REFS}),
        g AS ({GRAM_UNION}), c AS (SELECT conv_id, turn, k, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL),
        s AS (SELECT conv_id, turn, {", ".join(f"CAST(coalesce(sum(least(p, r)) FILTER (k = {k}), 0) AS DOUBLE) AS m{k}, CAST(coalesce(sum(p) FILTER (k = {k}), 0) AS DOUBLE) AS p{k}" for k in FOUR)},
          CAST(coalesce(sum(r) FILTER (k = 1), 0) AS DOUBLE) AS r1 FROM c GROUP BY 1, 2),
        b AS (SELECT conv_id, turn // 10 AS turn, turn % 10 AS no,
          CASE WHEN m1 = 0 OR p4 = 0 THEN 0.0 ELSE 100 * CASE WHEN p1 < r1 THEN exp(1 - r1 / p1) ELSE 1.0 END * exp(({SMOOTH}) / 4) END AS f FROM s)
        SELECT conv_id, turn, round(max(f) FILTER (no < 2), 6) AS bleu_max, round(max(f) FILTER (no < 2) - max(f) FILTER (no >= 2), 6) AS bleu_diff,
          CAST(max(f) FILTER (no < 2) > max(f) FILTER (no >= 2) AS INT) AS bleu_acc FROM b GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = turns(spark, sf).withColumns(
        {"true_refs": F.array("ref", F.lit(" ")), "false_refs": F.array("role", F.reverse(F.btrim("ref", F.lit(" \n"))))}
    )
    out = S.true_false_refs(rows, IDS, "pred", "true_refs", "false_refs", "bleu")
    return out.withColumns({c: F.round(c, 6) for c in ("bleu_max", "bleu_diff")})


def corpus_sums(orders) -> str:
    union = " UNION ALL ".join(gram_counts(s, t, k) for k in orders for s, t in (("p", "pw"), ("r", "rw")))
    sums = ", ".join(
        f"CAST(sum(least(p, r)) FILTER (k = {k}) AS DOUBLE) AS m{k}, CAST(sum(p) FILTER (k = {k}) AS DOUBLE) AS p{k}, "
        f"CAST(sum(r) FILTER (k = {k}) AS DOUBLE) AS r{k}" for k in orders
    )
    return f"""g AS ({union}), c AS (SELECT conv_id, turn, k, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r
      FROM g GROUP BY ALL), s AS (SELECT {sums} FROM c)"""


@query(
    "h12_corpus_bleu",
    f"""WITH x AS (SELECT conv_id, turn, {translation_sql(PRED)} AS pw, {translation_sql('text')} AS rw FROM conversations), {corpus_sums((1, 2, 3, 4))}
        SELECT round(100 * CASE WHEN p1 < r1 THEN exp(1 - r1 / p1) ELSE 1 END * exp(({" + ".join(f"ln(m{k} / p{k})" for k in (1, 2, 3, 4))}) / 4), 6) AS bleu FROM s""",
)
def _(spark, sf):
    out = S.corpus_bleu(turns(spark, sf), IDS, "pred", "ref")
    return out.withColumn("bleu", F.round("bleu", 6))


CHARS = "string_split(regexp_replace({0}, '\\s+', '', 'g'), '')"
SIX = (1, 2, 3, 4, 5, 6)


@query(
    "h12_chrf",
    f"""WITH x AS (SELECT conv_id, turn, {CHARS.format(PRED)} AS pw, {CHARS.format('text')} AS rw FROM conversations), {corpus_sums(SIX)},
        a AS (SELECT ({" + ".join(f"m{k} / p{k}" for k in SIX)}) / 6 AS p, ({" + ".join(f"m{k} / r{k}" for k in SIX)}) / 6 AS r FROM s)
        SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM a""",
)
def _(spark, sf):
    return S.chrf(turns(spark, sf), IDS, "pred", "ref").withColumn("chrf", F.round("chrf", 6))


MULTI = """SELECT conv_id, turn, k, g, count(*) FILTER (side = 'p') AS p,
    greatest(count(*) FILTER (side = 'r'), count(*) FILTER (side = 'q')) AS r FROM g GROUP BY ALL"""


@query(
    "h12_corpus_bleu_refs",
    # second reference: the text without its last word, which has the length of the prediction
    f"""WITH x AS (SELECT conv_id, turn, {translation_sql(PRED)} AS pw, {translation_sql('text')} AS rw,
          {translation_sql("regexp_replace(text, '\\s*\\S+$', '')")} AS qw FROM conversations),
        g AS ({" UNION ALL ".join(gram_counts(s, t, k) for k in (1, 2, 3, 4) for s, t in (("p", "pw"), ("r", "rw"), ("q", "qw")))}),
        c AS ({MULTI}),
        s AS (SELECT {", ".join(f"CAST(sum(least(p, r)) FILTER (k = {k}) AS DOUBLE) AS m{k}, CAST(sum(p) FILTER (k = {k}) AS DOUBLE) AS p{k}" for k in (1, 2, 3, 4))},
          (SELECT CAST(sum(CASE WHEN abs(len(qw) - len(pw)) <= abs(len(rw) - len(pw)) THEN len(qw) ELSE len(rw) END) AS DOUBLE) FROM x) AS r1 FROM c)
        SELECT round(100 * CASE WHEN p1 < r1 THEN exp(1 - r1 / p1) ELSE 1 END * exp(({" + ".join(f"ln(m{k} / p{k})" for k in (1, 2, 3, 4))}) / 4), 6) AS bleu FROM s""",
)
def _(spark, sf):
    cut = F.regexp_replace("ref", r"\s*\S+$", "")
    rows = turns(spark, sf).withColumn("ref", F.array("ref", cut))
    return S.corpus_bleu(rows, IDS, "pred", "ref").withColumn("bleu", F.round("bleu", 6))


@query(
    "h12_ter_moves",
    # the first word is moved to the end: one edit, or two where that is too far for a move
    f"""SELECT role, round(100.0 * coalesce(sum(CASE WHEN len(w) <= {S.SHIFT_REACH + 1} THEN 1 ELSE 2 END)
          FILTER (len(w) > 1 AND w[1:len(w) - 1] <> w[2:]), 0) / sum(len(w)), 6) AS ter FROM (SELECT role, {word_list('text')} AS w FROM conversations) GROUP BY 1""",
)
def _(spark, sf):
    first = F.regexp_extract("ref", r"(\S+)", 1)
    rows = turns(spark, sf).withColumn("pred", F.concat_ws(" ", "pred", first))
    return S.ter(rows, "pred", "ref", ["role"]).withColumn("ter", F.round("ter", 6))


# the prediction only lacks the first word, so the edits are known
@query(
    "h12_ter",
    f"SELECT round(100.0 * count(*) FILTER (len({word_list('text')}) > 0) / sum(len({word_list('text')})), 6) AS ter FROM conversations",
)
def _(spark, sf):
    return S.ter(turns(spark, sf), "pred", "ref").withColumn("ter", F.round("ter", 6))


@query(
    "g24_wer",
    f"""SELECT role, round(CAST(count(*) FILTER (len({word_list('text')}) > 0) AS DOUBLE) / sum(len({word_list('text')})), 6) AS wer
        FROM conversations GROUP BY 1""",
)
def _(spark, sf):
    return S.wer(turns(spark, sf), "pred", "ref", ["role"]).withColumn("wer", F.round("wer", 6))


# Every line against the next line of its turn; the check fills the edit table row by row.
LINE_PAIRS = f"""(SELECT row_number() OVER () AS id, role, {word_list('l[i]')} AS pw, {word_list('l[i + 1]')} AS rw
    FROM (SELECT role, l, unnest(range(1, len(l))) AS i FROM (SELECT role, string_split(text, chr(10)) AS l FROM conversations)))"""


@query(
    "g24_wer_lines",
    f"""WITH RECURSIVE p AS MATERIALIZED {LINE_PAIRS},
        e AS (SELECT id, 0 AS i, range(0, len(rw) + 1) AS d FROM p
          UNION ALL SELECT id, i, list_transform(range(1, len(t) + 1), lambda j: list_min(list_transform(t[1:j], lambda x, k: x + j - k))) FROM (
            SELECT e.id, e.i + 1 AS i, list_concat([CAST(e.i + 1 AS BIGINT)], list_transform(range(1, len(rw) + 1),
              lambda j: least(d[j + 1] + 1, d[j] + CAST(pw[e.i + 1] <> rw[j] AS BIGINT)))) AS t
            FROM e JOIN p ON p.id = e.id WHERE e.i < len(pw)))
        SELECT role, round(CAST(sum(d[len(d)]) AS DOUBLE) / sum(len(rw)), 6) AS wer FROM e JOIN p ON p.id = e.id WHERE i = len(pw) GROUP BY 1""",
)
def _(spark, sf):
    lines = F.split("text", "\n")
    later = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    pairs = F.transform(later, lambda r, i: F.struct(lines[i].alias("pred"), r.alias("ref")))
    rows = table(spark, sf, "conversations").select("role", F.inline(pairs))
    return S.wer(rows, "pred", "ref", ["role"]).withColumn("wer", F.round("wer", 6))


CLEAN = "lower(trim(regexp_replace(regexp_replace({0}, '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')))"
ROUGE = "regexp_replace({0}, '[^a-z0-9]+', ' ', 'g')"


@query(
    "h13_rouge1",
    f"""SELECT round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * match / (p + r) END), 6) AS rouge1,
        round((SELECT avg(len({word_list(CLEAN.format(PRED))})) FROM conversations), 6) AS average_len
        FROM {bag_sql('conversations', 'conv_id, turn', ROUGE.format(CLEAN.format(PRED)), ROUGE.format(CLEAN.format('text')))}""",
)
def _(spark, sf):
    out = S.rouge1(turns(spark, sf), IDS, "pred", "ref")
    return out.withColumns({c: F.round(c, 6) for c in ("rouge1", "average_len")})


WORD = "[\\p{L}\\p{M}\\p{N}_]+"


@query(
    "g18_checks",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) >= 100 AS words, len(regexp_extract_all(text, '\\[[^\\n]*?\\]')) >= 1 AS placeholders,
        text LIKE '%,%' = false AS no_commas, regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)and') AS keywords,
        len(regexp_extract_all(text, '(?i)en')) < 20 AS keyword_frequency, length(lower(text)) - length(replace(lower(text), 'e', '')) >= 50 AS letters,
        len(string_split(text, '***')) = 1 AND trim(text, ' ' || chr(10)) <> '' AS paragraphs, regexp_matches(text, '[a-z]') AND lower(text) = text AS low,
        false AS json, lower(rtrim(text, ' ' || chr(10))) LIKE '%.' AS ends FROM documents""",
)
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        C.check_number_words(t, "at least", 100).alias("words"),
        C.check_number_placeholders(t, 1).alias("placeholders"),
        C.check_no_commas(t).alias("no_commas"),
        C.check_keywords(t, ["the", "and"]).alias("keywords"),
        C.check_keyword_frequency(t, "en", "less than", 20).alias("keyword_frequency"),
        C.check_letter_frequency(t, "e", "at least", 50).alias("letters"),
        C.check_number_paragraphs(t, 1).alias("paragraphs"),
        C.check_lower_case(t).alias("low"),
        C.check_json(t).alias("json"),
        C.check_end_phrase(t, ".").alias("ends"),
    )


SPLIT = "string_split(text, chr(10))"
STOPS = "|".join(re.escape(a) for a in V.ABBREVIATIONS)
SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '\\b({STOPS})\\.', '\\1' || chr(1), 'g'),
      '([.!?]+["''”]?)(\\s|$)', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"""
WORDS = f"regexp_extract_all(lower(text), '{WORD}')"
LISTED = "('* ' || replace(text, chr(10), chr(10) || '* '))"
STARRED = "regexp_replace(text, '(?m)^(\\S+)', '*\\1*', 'g')"
BLANK_LINES = "string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))"
SHOUTED = "replace(text, ' the ', ' THE ')"
HALVES = "list_transform(string_split(array_to_string(l[1:2], '******'), '******'), lambda p: trim(p, ' ' || chr(10)))"
REPHRASED = "(string_split(l[1], ' ')[1] || ' *' || coalesce(string_split(l[1], ' ')[2], '') || '* end')"
FULL_LINE = "The and attion to thanedble the, anea."


def filled_sql(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all({STARRED}, '{pattern}'), lambda h: trim(trim(h, '*')) <> ''))"


# The responses are the texts in other forms; every expectation is counted from the texts.
@query(
    "g18_checks_forms",
    f"""SELECT doc_id, len({SENTENCES}) >= 30 AS sentences, list_contains({SENTENCES}, '{FULL_LINE}') AS key_sentences,
        len(list_filter(string_split({LISTED}, chr(10)), lambda b: regexp_matches(b, '^\\s*(\\*[^*]|\\*$|-)'))) = 9 AS bullets,
        contains(text, 'tion of') OR contains(text, 'the en') AS constrained,
        len(list_filter(l, lambda b: ltrim(b) LIKE 'The%')) > 0 AS starts,
        {filled_sql('\\*[^\\n\\*]*\\*')} + {filled_sql('\\*\\*[^\\n\\*]*\\*\\*')} >= 10 AS highlights,
        len(l) >= 10 AS sections, contains(text, chr(10) || 'T') OR regexp_matches(lower(text), 'p\\.\\s?s\\.') AS postscript,
        NOT list_has_any({WORDS}, ['ou', 'scum']) AS forbidden,
        len(list_filter({BLANK_LINES}, lambda b: trim(b) <> '')) = 9 AND lower(regexp_extract(trim({BLANK_LINES}[1]), '^[^.,?!''" ]*')) = 'the' AS first_word,
        contains(text, 'the, ') AS title, regexp_matches(text, '^\\p{{Lu}}') AS upper_case,
        len(list_filter(regexp_extract_all({SHOUTED}, '[\\p{{L}}\\p{{M}}\\p{{N}}_''-]+'), lambda w: upper(w) = w AND regexp_matches(w, '\\p{{Lu}}'))) >= 3 AS capitals,
        text LIKE '%.' OR text LIKE '%"' AS quoted,
        len({HALVES}) = 2 AND {HALVES}[1] <> '' AND {HALVES}[2] <> '' AND {HALVES}[1] <> {HALVES}[2] AS two_responses,
        lower(text) LIKE 'the and%' AS repeats, regexp_replace({REPHRASED}, '\\*.*\\*', '', 'g') = 'The  end' AS rephrased_marks,
        len(list_filter(['the', 'and', 'is', 'that', 'with'], lambda w: list_contains({WORDS}, w))) BETWEEN 3 AND 4 AS rephrased
        FROM (SELECT doc_id, text, {SPLIT} AS l FROM documents)""",
)
def _(spark, sf):
    t = F.col("text")
    lines = F.split(t, "\n")
    numbered = F.transform(lines, lambda x, i: F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(" "), x))
    first = F.split(lines[0], " ")
    marked = F.concat(first[0], F.lit(" *"), F.coalesce(F.get(first, F.lit(1)), F.lit("")), F.lit("* end"))
    return table(spark, sf, "documents").select(
        "doc_id",
        C.check_number_sentences(t, "at least", 30).alias("sentences"),
        C.check_key_sentences(t, [FULL_LINE], 1).alias("key_sentences"),
        C.check_number_bullets(F.concat(F.lit("* "), F.replace(t, F.lit("\n"), F.lit("\n* "))), 9).alias("bullets"),
        C.check_constrained_response(t, ["tion of", "the en"]).alias("constrained"),
        C.check_constrained_start(t, "The").alias("starts"),
        C.check_number_highlights(F.regexp_replace(t, r"(?md)^(\S+)", r"*$1*"), 10).alias("highlights"),
        C.check_number_sections(F.array_join(numbered, "\n"), "Section", 10).alias("sections"),
        C.check_postscript(F.replace(t, F.lit("\nT"), F.lit("\nP. S. T")), "P.S.").alias("postscript"),
        C.check_forbidden_words(t, ["ou", "scum"]).alias("forbidden"),
        C.check_paragraph_first_word(F.replace(t, F.lit("\n"), F.lit("\n\n")), 9, 1, "The").alias("first_word"),
        C.check_title(F.replace(t, F.lit("the, "), F.lit("<<the>> "))).alias("title"),
        C.check_upper_case(F.left(t, F.lit(1))).alias("upper_case"),
        C.check_capital_words(F.replace(t, F.lit(" the "), F.lit(" THE ")), "at least", 3).alias("capitals"),
        C.check_quoted(F.concat(F.lit('"'), F.regexp_replace(t, r"\.\z", '."'))).alias("quoted"),
        C.check_two_responses(F.array_join(F.slice(lines, 1, 2), "******")).alias("two_responses"),
        C.check_repeat_prompt(t, "The and").alias("repeats"),
        C.check_rephrased_marks(marked, "The *big* end").alias("rephrased_marks"),
        C.check_rephrased_paragraph(t, "The and is that with", 3, 4).alias("rephrased"),
    )


RULES = [
    ("no_commas", {}),
    ("number_words", {"relation": "at least", "n": 50}),
    ("keywords", {"keywords": ["the"]}),
]


def rule_sql(e: str) -> list[str]:
    return [
        f"({e} NOT LIKE '%,%')",
        f"(len(regexp_extract_all({e}, '{WORD}')) >= 50)",
        f"regexp_matches({e}, '(?i)the')",
    ]


def loose_sql() -> list[str]:
    forms = ["array_to_string(l, chr(10))", *[f"trim(array_to_string(l[{a}:{b}], chr(10)), ' ' || chr(10))" for a, b in (("2", "len(l)"), ("1", "len(l) - 1"), ("2", "len(l) - 1"))]]
    forms += [f"replace({f}, '*', '')" for f in forms]
    checks = [[f"(trim({f}, ' ' || chr(10)) <> '' AND {r})" for r in rule_sql(f)] for f in forms]
    return ["(" + " OR ".join(c[i] for c in checks) + ")" for i in range(len(RULES))]


STRICT = [f"(trim(text, ' ' || chr(10)) <> '' AND {r})" for r in rule_sql("text")]


@query(
    "g17_follow",
    f"""SELECT doc_id, {" AND ".join(STRICT)} AS strict_all, {" AND ".join(loose_sql())} AS loose_all,
        {" + ".join(f"CAST({s} AS INT)" for s in STRICT)} AS strict_count, {" + ".join(f"CAST({s} AS INT)" for s in loose_sql())} AS loose_count
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""",
)
def _(spark, sf):
    t = F.col("text")
    rows = table(spark, sf, "documents").select(
        "doc_id", C.follow(t, RULES).alias("s"), C.follow(t, RULES, loose=True).alias("l")
    )
    count = lambda c: F.size(F.filter(c, lambda x: x))
    return rows.select(
        "doc_id",
        C.follow_all(F.col("s")).alias("strict_all"),
        C.follow_all(F.col("l")).alias("loose_all"),
        count("s").alias("strict_count"),
        count("l").alias("loose_count"),
    )


@query(
    "g18_inst_accuracy",
    f"""SELECT round(avg(f), 6) AS inst_accuracy FROM (SELECT unnest([{", ".join(f"CAST({s} AS INT)" for s in STRICT)}]) AS f FROM documents)""",
)
def _(spark, sf):
    flags = table(spark, sf, "documents").select(C.follow(F.col("text"), RULES).alias("flags"))
    out = A.inst_accuracy(flags, "flags")
    return out.select(F.round("inst_accuracy", 6).alias("inst_accuracy"))
