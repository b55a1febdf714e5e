"""All registered aggregations at once, and their bootstrap errors, replayed by the check SQL."""

from pyspark.sql import functions as F

from assayline.functions.text import words
from assayline.operators import registry as R
from assayline.operators import statistics as ST
from assayline.queries import query, table
from assayline.queries.sqltext import word_list
from assayline.queries.text_scores import CHARS, translation_sql

EVERY = {
    "mean": "mean", "bypass": "bypass", "median": "median", "perplexity": "perplexity",
    "weighted_perplexity": "weighted_perplexity", "bits_per_byte": "bits_per_byte", "f1": "f1",
    "mcc": "mcc", "brier": "brier", "bleu": "bleu", "chrf": "chrf", "ter": "ter",
    "mean_last": "mean_last",
}


def every_aggregation() -> None:
    """One metric per registered aggregation, its score the argument itself."""
    for name, how in EVERY.items():
        if f"all_{name}" not in R.METRICS:
            R.register_metric(f"all_{name}", aggregation=how)(lambda score: score)


ALL_PRED = "regexp_replace(text, '^\\S+\\s*', '')"


@query(
    "n2_every_aggregation",
    f"""WITH t AS (SELECT role, conv_id * 100 + turn AS id, text, {ALL_PRED} AS pred, len({word_list('text')}) AS nw,
          length(text) AS size, (length(text) % 3 = 0)::INT AS gold, (length(text) % 4 < 2)::INT AS guess, -(length(text) % 50) / 10 AS ll FROM conversations),
        pw AS (SELECT *, {translation_sql('pred')} AS pw, {translation_sql('text')} AS rw, {CHARS.format('pred')} AS pc, {CHARS.format('text')} AS rc FROM t),
        grams AS ({" UNION ALL ".join(f"SELECT role, id, '{s}{side}' AS s, {k} AS k, array_to_string({col}[i:i + {k - 1}], chr(1)) AS g FROM (SELECT role, id, {col}, unnest(range(1, len({col}) - {k} + 2)) AS i FROM pw)"
          for s, top in (("w", 4), ("c", 6)) for k in range(1, top + 1) for side, col in (("p", f"p{s}"), ("r", f"r{s}")))}),
        counts AS (SELECT role, id, s[1] AS kind, k, g, count(*) FILTER (s[2] = 'p') AS p, count(*) FILTER (s[2] = 'r') AS r FROM grams GROUP BY ALL),
        c AS (SELECT role, kind, k, sum(least(p, r))::DOUBLE AS m, sum(p)::DOUBLE AS p, sum(r)::DOUBLE AS r FROM counts GROUP BY ALL),
        b AS (SELECT role, 100 * CASE WHEN max(p) FILTER (k = 1) < max(r) FILTER (k = 1) THEN exp(1 - max(r) FILTER (k = 1) / max(p) FILTER (k = 1)) ELSE 1 END
            * exp(avg(ln(m / p))) AS bleu FROM c WHERE kind = 'w' GROUP BY 1),
        x AS (SELECT role, 100 * 5 * avg(m / p) * avg(m / r) / (4 * avg(m / p) + avg(m / r)) AS chrf FROM c WHERE kind = 'c' GROUP BY 1),
        l AS (SELECT role, CASE WHEN count(*) < 30 THEN -1.0 ELSE avg(size) END AS last FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY role ORDER BY id DESC) <= 30) GROUP BY 1),
        n AS (SELECT role, avg(size) AS mean, -1.0 AS bypass, median(size) AS median, exp(-avg(ll)) AS perplexity, exp(-sum(ll) / sum(nw)) AS weighted_perplexity,
            -sum(ll) / sum(size) / ln(2) AS bits_per_byte, count(*)::DOUBLE AS n, sum(gold * guess)::DOUBLE AS tp, sum(gold)::DOUBLE AS g, sum(guess)::DOUBLE AS p,
            avg(CASE WHEN gold = 1 THEN 2 * 0.75 * 0.75 ELSE 2 * 0.25 * 0.25 END) AS brier, 100 * count(*) FILTER (nw > 0) / sum(nw) AS ter FROM t GROUP BY 1)
        SELECT role, round(mean, 6) AS all_mean, bypass AS all_bypass, round(median, 6) AS all_median, round(perplexity, 6) AS all_perplexity,
          round(weighted_perplexity, 6) AS all_weighted_perplexity, round(bits_per_byte, 6) AS all_bits_per_byte, round(2 * tp / (g + p), 6) AS all_f1,
          round((tp * (n - g - p + tp) - (g - tp) * (p - tp)) / sqrt(g * p * (n - g) * (n - p)), 6) AS all_mcc,
          round(brier, 6) AS all_brier, round(bleu, 6) AS all_bleu, round(chrf, 6) AS all_chrf, round(ter, 6) AS all_ter, round(last, 6) AS all_mean_last
        FROM n JOIN b USING (role) JOIN x USING (role) JOIN l USING (role)""",
)
def _(spark, sf):
    every_aggregation()
    rows = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    size, guess = F.length("text"), (F.length("text") % 4 < 2).cast("int")
    gold, ll = (F.length("text") % 3 == 0).cast("int"), -(size % 50) / 10
    texts = F.struct(F.regexp_replace("text", r"^\S+\s*", "").alias("pred"), F.col("text").alias("ref"))
    labels = F.struct(gold.alias("gold"), guess.alias("pred"))
    sized = lambda by: F.struct(ll.alias("ll"), by.alias("size"))
    probs = F.struct(F.array(F.lit(0.75), F.lit(0.25)).alias("probs"), gold.alias("gold"))
    scores = {
        "mean": size, "bypass": size, "median": size, "perplexity": ll, "mean_last": size,
        "weighted_perplexity": sized(F.size(words(F.col("text")))), "bits_per_byte": sized(size),
        "f1": labels, "mcc": labels, "brier": probs, "bleu": texts, "chrf": texts, "ter": texts,
    }
    out = R.evaluate_metrics(
        rows, ["role"], {f"all_{n}": [c] for n, c in scores.items()}, order="id"
    )
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in out.columns if c != "role"})


REPS = 24

#: Weights of a row in a block of replicates, as in ``statistics.replicate_weights``.
WEIGHTS = f"""w AS (SELECT t.*, b.block * {ST.DRAWS} + r AS rep,
          ({" + ".join(f"(u >= {s})::INT" for s in ST.poisson_limits())})::DOUBLE AS w
        FROM (SELECT t.*, b.block, r, ('0x' || substr(md5(t.id || '|42|' || b.block), 4 * r + 1, 4))::INT AS u
          FROM t, (SELECT unnest(range({REPS // ST.DRAWS})) AS block) b, (SELECT unnest(range({ST.DRAWS})) AS r)) t, (SELECT 0 AS block) b)"""


@query(
    "h17_bootstrap_stderr",
    f"""WITH t AS (SELECT event_type, event_id AS id, value, (event_id % 3 = 0)::INT AS gold, (value > 40)::INT AS guess FROM events),
        {WEIGHTS.replace("b.block * 8 + r", "t.block * 8 + r")},
        s AS (SELECT event_type, rep, sum(w) AS n, sum(w * value) / sum(w) AS mean, exp(sum(w * value / 100) / sum(w)) AS ppl,
            sum(w * gold * guess) AS tp, sum(w * gold) AS g, sum(w * guess) AS p FROM w GROUP BY 1, 2),
        m AS (SELECT event_type, rep, value, sum(w) AS w FROM w GROUP BY ALL HAVING sum(w) > 0),
        c AS (SELECT *, sum(w) OVER (PARTITION BY event_type, rep ORDER BY value) AS upto, sum(w) OVER (PARTITION BY event_type, rep) AS total FROM m),
        d AS (SELECT event_type, rep, (min(value) FILTER (2 * upto >= total) + min(value) FILTER (2 * upto > total)) / 2 AS median FROM c GROUP BY ALL)
        SELECT event_type, round(stddev_samp(mean), 6) AS mean_stderr, round(stddev_samp(ppl), 6) AS ppl_stderr,
          round(stddev_samp(coalesce(2 * tp / nullif(g + p, 0), 0)), 6) AS f1_stderr,
          round(stddev_samp(CASE WHEN g * p * (n - g) * (n - p) > 0 THEN (tp * (n - g - p + tp) - (g - tp) * (p - tp)) / sqrt(g * p * (n - g) * (n - p)) ELSE 0 END), 6) AS mcc_stderr,
          round(stddev_samp(median), 6) AS median_stderr
        FROM s JOIN d USING (event_type, rep) GROUP BY 1""",
)
def _(spark, sf):
    labels = F.struct(
        (F.col("event_id") % 3 == 0).cast("int").alias("gold"), (F.col("value") > 40).cast("int").alias("pred")
    )
    items = {
        "mean": (ST.mean, F.col("value")),
        "ppl": (ST.perplexity, -F.col("value") / 100),
        "f1": (ST.f1(), labels),
        "mcc": (ST.mcc, labels),
    }
    rows = table(spark, sf, "events")
    out = ST.bootstrap(rows, ["event_type"], items, ["event_id"], REPS)
    middle = ST.bootstrap_median(rows, ["event_type"], "value", ["event_id"], REPS)
    out = out.join(middle.withColumnRenamed("stderr", "median_stderr"), "event_type")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "event_type"})


@query(
    "h17_bootstrap_bleu",
    f"""WITH t AS (SELECT role, conv_id * 100 + turn AS id, {translation_sql(ALL_PRED)} AS pw, {translation_sql('text')} AS rw FROM conversations),
        grams AS ({" UNION ALL ".join(f"SELECT id, '{side}' AS s, {k} AS k, array_to_string({side}w[i:i + {k - 1}], chr(1)) AS g FROM (SELECT id, {side}w, unnest(range(1, len({side}w) - {k} + 2)) AS i FROM t)"
          for k in range(1, 5) for side in "pr")}),
        counts AS (SELECT id, k, g, count(*) FILTER (s = 'p') AS p, count(*) FILTER (s = 'r') AS r FROM grams GROUP BY ALL),
        per AS (SELECT id, k, sum(least(p, r)) AS m, sum(p) AS p, sum(r) AS r FROM counts GROUP BY ALL),
        {WEIGHTS.replace("b.block * 8 + r", "t.block * 8 + r").replace("SELECT t.*, b.block, r,", "SELECT t.role, t.id, b.block, r,")},
        c AS (SELECT w.role, w.rep, per.k, sum(w.w * per.m) AS m, sum(w.w * per.p) AS p, sum(w.w * per.r) AS r FROM w JOIN per ON per.id = w.id GROUP BY ALL),
        b AS (SELECT role, rep, 100 * CASE WHEN max(p) FILTER (k = 1) < max(r) FILTER (k = 1) THEN exp(1 - max(r) FILTER (k = 1) / max(p) FILTER (k = 1)) ELSE 1 END
            * exp(avg(ln(m / p))) AS bleu FROM c GROUP BY ALL)
        SELECT role, round(stddev_samp(bleu), 6) AS bleu_stderr FROM b GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    texts = F.struct(F.regexp_replace("text", r"^\S+\s*", "").alias("pred"), F.col("text").alias("ref"))
    out = ST.bootstrap(rows, ["role"], {"bleu": (ST.bleu, texts)}, ["id"], REPS)
    return out.withColumn("bleu_stderr", F.round("bleu_stderr", 6))
