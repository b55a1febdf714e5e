"""Choice and likelihood scores; the first embedding components serve as likelihoods."""

from pyspark.sql import functions as F

from assayline.functions import scores as S
from assayline.queries import query, table


def lls(spark, sf, n=4, start=1):
    arr = F.transform(F.slice("embedding", start, n), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding", arr.alias("lls"))


def dbl(start, n):
    return f"list_transform(embedding[{start}:{start + n - 1}], lambda x: CAST(x AS DOUBLE))"


ARGMAX = "CAST(list_position({0}, list_max({0})) - 1 AS INT)"
LENS = "[1.0, 2.0, 3.0, 4.0]"


@query(
    "g1_exact_match",
    """SELECT o_orderkey, o_orderpriority = lower(o_orderpriority) AS plain, true AS cased,
       true AS loose FROM orders""",
)
def _(spark, sf):
    pred, ref = F.lower("o_orderpriority"), F.col("o_orderpriority")
    marked = F.concat(F.lit("#7 "), pred, F.lit("!"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        S.exact_match(pred, ref).alias("plain"),
        S.exact_match(pred, ref, ignore_case=True).alias("cased"),
        S.exact_match(marked, ref, [r"^#\d+ "], True, True, True).alias("loose"),
    )


@query(
    "g2_choice_scores",
    f"""WITH e AS (SELECT vec_id, CAST(label % 5 AS INT) AS gold, {dbl(1, 4)} AS l, {dbl(5, 4)} AS u FROM embeddings),
        n AS (SELECT *, list_transform(range(1, 5), lambda i: l[i] / {LENS}[i]) AS ln, list_transform(range(1, 5), lambda i: l[i] - u[i]) AS lu FROM e)
        SELECT vec_id, CAST({ARGMAX.format('l')} = gold AS DOUBLE) AS acc, CAST({ARGMAX.format('ln')} = gold AS DOUBLE) AS acc_norm,
          gold > 3 AS gold_error, CASE WHEN gold > 3 THEN 0 ELSE CAST(l[gold + 1] > 0 AS INT) END AS exact_match,
          CAST({ARGMAX.format('lu')} = gold AS DOUBLE) AS acc_mutual_info FROM n""",
)
def _(spark, sf):
    rows = lls(spark, sf).withColumns(
        {
            "choices": F.array(*[F.lit(x) for x in ("a", "bb", "ccc", "dddd")]),
            "gold": (F.col("label") % 5).cast("int"),
            "greedy": F.transform("lls", lambda x: x > 0),
            "uncond": F.transform(F.slice("embedding", 5, 4), lambda x: x.cast("double")),
        }
    )
    scores = S.choice_scores(*[F.col(c) for c in ("lls", "choices", "gold", "greedy", "uncond")])
    return rows.select("vec_id", *[c.alias(n) for n, c in scores.items()])


@query(
    "g3_acc_multi",
    f"""SELECT vec_id, CAST({ARGMAX.format('embedding[1:4]')} IN (label % 4, (label + 1) % 4) AS DOUBLE) AS acc FROM embeddings""",
)
def _(spark, sf):
    golds = F.array((F.col("label") % 4).cast("int"), ((F.col("label") + 1) % 4).cast("int"))
    return lls(spark, sf).select("vec_id", S.acc_multi(S.argmax(F.col("lls")), golds).alias("acc"))


@query(
    "g4_softmax",
    f"""WITH e AS (SELECT vec_id, list_transform({dbl(1, 10)}, lambda x: exp(x)) AS e FROM embeddings)
        SELECT vec_id, round(e[1] / list_sum(e), 6) AS p1, round(e[10] / list_sum(e), 6) AS p10 FROM e""",
)
def _(spark, sf):
    p = S.softmax(F.col("lls"))
    return lls(spark, sf, 10).select("vec_id", F.round(p[0], 6).alias("p1"), F.round(p[9], 6).alias("p10"))


@query(
    "g10_truth_mass",
    f"""WITH e AS (SELECT vec_id, label % 3 + 1 AS k, list_transform({dbl(1, 5)}, lambda x: exp(x)) AS e FROM embeddings)
        SELECT vec_id, round(list_sum(e[1:k]) / list_sum(e), 6) AS acc FROM e""",
)
def _(spark, sf):
    marks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i <= F.col("label") % 3, 1).otherwise(0))
    return lls(spark, sf, 5).select("vec_id", F.round(S.truth_mass(F.col("lls"), marks), 6).alias("acc"))


@query(
    "g11_pair_preference",
    """SELECT vec_id, round(abs(CAST(embedding[1] AS DOUBLE) - embedding[2]), 6) AS likelihood_diff,
       CAST(embedding[1] > embedding[2] AS DOUBLE) AS prefers_first FROM embeddings""",
)
def _(spark, sf):
    diff, first = S.pair_preference(F.col("lls")[0], F.col("lls")[1])
    return lls(spark, sf, 2).select("vec_id", F.round(diff, 6).alias("likelihood_diff"), first.alias("prefers_first"))


@query(
    "g12_rank_scores",
    f"""WITH e AS (SELECT vec_id, CAST(label % 4 AS INT) + 1 AS g, {dbl(1, 4)} AS l FROM embeddings),
        r AS (SELECT vec_id, list_position(l, list_max(l)) = g AS first, list_position(list_reverse_sort(l), l[g]) AS place FROM e)
        SELECT vec_id, CAST(first AS INT) AS r1, CAST(place = 2 AS INT) + CAST(first AS INT) AS r2, round(1.0 / place, 6) AS mrr FROM r""",
)
def _(spark, sf):
    scores = S.rank_scores(F.col("lls"), (F.col("label") % 4).cast("int"))
    out = lls(spark, sf).select("vec_id", *[c.alias(n) for n, c in scores.items()])
    return out.withColumn("mrr", F.round("mrr", 6))


@query(
    "g9_contains_any",
    """SELECT doc_id, CAST(lower(text) LIKE '%the%' OR lower(text) LIKE '%' || source || '%' AS INT) AS any_label, text LIKE '%en%' AS included
       FROM documents""",
)
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        S.contains_any(text, F.array(F.lit("THE"), F.col("source"))).alias("any_label"),
        S.is_included(F.lit("en"), text).alias("included"),
    )


@query(
    "g15_emotion_score",
    """WITH v AS (SELECT vec_id, label, [abs(CAST(round(embedding[1] * 20) AS DOUBLE)), label, 3.0, 9.0] AS p, [2.0, 1.0, 3.0, 9.0] AS r FROM embeddings),
       d AS (SELECT *, list_transform(range(1, 5), lambda i: abs(p[i] - r[i])) AS d FROM v)
       SELECT vec_id, round(CASE WHEN label = 7 THEN 0.0 ELSE 10 * (10 - 0.7477 * list_sum(list_transform(d, lambda x: CASE WHEN x = 0 THEN 0.0
         WHEN x <= 5 THEN 6.5 / (1 + exp(-1.2 * (x - 4))) ELSE x END))) END, 6) AS score, CASE WHEN label = 7 THEN 0 ELSE 100 END AS parseable FROM d""",
)
def _(spark, sf):
    names = lambda last: F.array(*[F.lit(n) for n in ("Joy", "Fear", "Calm")], last)
    first = F.abs(F.round(F.col("embedding")[0].cast("double") * 20))
    values = F.array(first, F.col("label").cast("double"), F.lit(3.0), F.lit(9.0))
    last = F.when(F.col("label") == 7, F.lit("Rage")).otherwise(F.lit("Hope"))
    pred = F.map_from_arrays(names(last), values)
    ref = F.map_from_arrays(names(F.lit("Hope")), F.array(*[F.lit(v) for v in (2.0, 1.0, 3.0, 9.0)]))
    rows = table(spark, sf, "embeddings").select("vec_id", pred.alias("p"), ref.alias("r"))
    score, readable = S.emotion_score(F.col("p"), F.col("r"))
    return rows.select("vec_id", F.round(score, 6).alias("score"), readable.alias("parseable"))


@query(
    "g16_referent_match",
    """SELECT p_partkey, CAST((CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE false END) = (p_size > 20) AS DOUBLE) AS accuracy FROM part""",
)
def _(spark, sf):
    kind = F.col("p_partkey") % 3
    pred = (
        F.when(kind == 0, F.concat(F.lit("The "), F.substring_index("p_name", " ", -1)))
        .when(kind == 1, F.concat(F.col("p_name"), F.lit("'s"))).otherwise(F.lit("something else"))
    )
    rows = table(spark, sf, "part").select("p_partkey", "p_name", pred.alias("pred"), (F.col("p_size") > 20).alias("label"))
    return rows.select("p_partkey", S.referent_match(F.col("pred"), F.col("p_name"), F.col("label")).alias("accuracy"))


@query(
    "g19_ll_tuples",
    """SELECT doc_id, -n_chars / 10.0 AS ll, CAST(len(regexp_split_to_array(text, '\\s+')) AS INT) AS words, CAST(strlen(text) AS INT) AS bytes FROM documents""",
)
def _(spark, sf):
    parts = S.ll_tuples(-F.col("n_chars") / 10.0, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in parts.items()])


@query("g21_toxic_flag", "SELECT event_id, CAST(value / 200 >= 0.5 AS INT) AS score FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.toxic_flag(F.col("value") / 200).alias("score"))


@query(
    "g22_sample_hashes",
    """SELECT doc_id, sha256('{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '"}') AS doc_hash, sha256(text) AS prompt_hash,
       sha256(CAST(n_chars AS VARCHAR)) AS target_hash FROM documents""",
)
def _(spark, sf):
    hashes = S.sample_hashes(F.to_json(F.struct("doc_id", "lang")), F.col("text"), F.col("n_chars"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in hashes.items()])


@query(
    "g23_keyed_score",
    """SELECT p_partkey, '1.0,' || CASE WHEN p_size > 10 THEN '1.0' ELSE '0.0' END || ',0.0,1.0' AS scores FROM part""",
)
def _(spark, sf):
    pred = F.create_map(
        F.lit("a"), F.concat(F.lit("  "), F.upper("p_name"), F.lit(".")),
        F.lit("b"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("wrong"),
        F.lit("c"), F.lit(""),
    )
    ref = F.map_from_arrays(
        F.array(*[F.lit(k) for k in "abcd"]),
        F.array(
            F.array("p_brand", "p_name"), F.array("p_type"), F.array("p_name"), F.array().cast("array<string>")
        ),
    )
    rows = table(spark, sf, "part").select("p_partkey", pred.alias("p"), ref.alias("r"))
    scores = S.keyed_score(F.col("p"), F.col("r"))
    return rows.select("p_partkey", F.array_join(F.transform(scores, lambda x: x.cast("string")), ",").alias("scores"))
