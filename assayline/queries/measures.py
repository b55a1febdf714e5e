"""Aggregations over samples: accuracy, errors, F1, roll-ups, traces, costs."""

from pyspark.sql import functions as F

from assayline.operators import aggregate as A
from assayline.queries import query, table
from assayline.queries.joining import task_edges


def graded(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    grade = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No")
    return docs.withColumn("grade", grade)


@query(
    "h1_accuracy_by_task",
    """SELECT source, count(*) AS total, count(quality) AS graded, count(*) FILTER (quality = 1) AS correct,
       round(count(*) FILTER (quality = 1) / count(*), 4) AS accuracy
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""",
)
def _(spark, sf):
    return A.accuracy_by_task(graded(spark, sf), "source", "grade")


@query(
    "h2_means",
    """SELECT e.user_id, round(avg(value), 6) AS mean, -1 AS bypass, round(any_value(m), 6) AS mean_last FROM events e
       JOIN (SELECT user_id, CASE WHEN count(*) < 30 THEN -1.0 ELSE avg(value) END AS m FROM
         (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30)
         GROUP BY 1) l ON l.user_id = e.user_id GROUP BY 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    plain = events.groupBy("user_id").agg(
        F.round(A.agg_mean(F.col("value")), 6).alias("mean"), A.agg_bypass(F.col("value")).alias("bypass")
    )
    last = A.agg_mean_last(events, ["user_id"], "event_id", "value")
    return plain.join(last.withColumn("mean_last", F.round("mean_last", 6)), "user_id")


@query(
    "h3_median",
    """SELECT event_type, round(median(value), 6) AS median, round(median(value), 6) AS by_aggregate
       FROM events GROUP BY 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    plain = events.groupBy("event_type").agg(F.round(A.agg_median(F.col("value")), 6).alias("by_aggregate"))
    out = A.median(events, ["event_type"], "value")
    return out.withColumn("median", F.round("median", 6)).join(plain, "event_type")


@query(
    "h3_middle_element",
    """SELECT event_type, value AS median FROM (SELECT event_type, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE pos = n // 2""",
)
def _(spark, sf):
    return A.middle_element(table(spark, sf, "events"), ["event_type"], "event_id", "value")


@query(
    "h4_perplexities",
    """SELECT event_type, round(exp(-avg(-value / 100)), 6) AS perplexity,
       round(exp(-sum(-value) / sum(user_id + 1)), 6) AS weighted_perplexity,
       round(-(sum(-value) / sum(user_id + 1)) / ln(2), 6) AS bits_per_byte FROM events GROUP BY 1""",
)
def _(spark, sf):
    ll, size = -F.col("value"), F.col("user_id") + 1
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(A.perplexity(ll / 100), 6).alias("perplexity"),
        F.round(A.weighted_perplexity(ll, size), 6).alias("weighted_perplexity"),
        F.round(A.bits_per_byte(ll, size), 6).alias("bits_per_byte"),
    )


PAIRS = """p AS (SELECT CAST(label % 4 AS INT) AS gold,
    CAST(list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS INT) AS pred FROM embeddings),
  l AS (SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tp + fn) AS t, sum(tp + fp) AS pr FROM
    (SELECT gold AS label, CAST(gold = pred AS INT) AS tp, 0 AS fp, CAST(gold <> pred AS INT) AS fn FROM p
     UNION ALL SELECT pred, 0, CAST(gold <> pred AS INT), 0 FROM p) GROUP BY 1),
  f AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM l)"""


def pairs(spark, sf):
    from assayline.functions.scores import argmax

    return table(spark, sf, "embeddings").select(
        (F.col("label") % 4).cast("int").alias("gold"),
        argmax(F.slice("embedding", 1, 4)).alias("pred"),
    )


@query(
    "h5_f1",
    f"""WITH {PAIRS} SELECT 'binary' AS average, round(f, 6) AS f1 FROM f WHERE label = 1
        UNION ALL SELECT 'macro', round(avg(f), 6) FROM f
        UNION ALL SELECT 'micro', round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) FROM f
        UNION ALL SELECT 'weighted', round(sum(f * t) / sum(t), 6) FROM f
        UNION ALL SELECT 'selected', round(sum(f) / 2, 6) FROM f WHERE label IN (0, 2)
        UNION ALL SELECT 'three_class', round(sum(f) / 3, 6) FROM f WHERE label IN (0, 1, 2)""",
)
def _(spark, sf):
    rows = pairs(spark, sf)
    parts = {
        "binary": A.f1(rows, "gold", "pred"),
        "macro": A.f1(rows, "gold", "pred", "macro"),
        "micro": A.f1(rows, "gold", "pred", "micro"),
        "weighted": A.f1(rows, "gold", "pred", "weighted"),
        "selected": A.f1(rows, "gold", "pred", "macro", [0, 2]),
        "three_class": A.f1(rows, "gold", "pred", "macro", [0, 1, 2]),
    }
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("average"), F.round("f1", 6).alias("f1"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "h6_mcc",
    f"""WITH {PAIRS}, s AS (SELECT sum(tp) AS c, sum(t) AS s, sum(CAST(t AS DOUBLE) * pr) AS pt, sum(CAST(pr AS DOUBLE) * pr) AS pp,
          sum(CAST(t AS DOUBLE) * t) AS tt FROM l)
        SELECT round((c * s - pt) / sqrt((CAST(s AS DOUBLE) * s - pp) * (CAST(s AS DOUBLE) * s - tt)), 6) AS mcc FROM s""",
)
def _(spark, sf):
    out = A.mcc(pairs(spark, sf), "gold", "pred")
    return out.select(F.round("mcc", 6).alias("mcc"))


@query(
    "h7_brier",
    """WITH e AS (SELECT CAST(label AS INT) AS gold, list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM embeddings),
       p AS (SELECT gold, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
       SELECT round(avg(list_sum(list_transform(p, lambda x: x * x)) - 2 * p[gold + 1] + 1), 6) AS brier FROM p""",
)
def _(spark, sf):
    from assayline.functions.scores import softmax

    lls = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("label", lls.alias("lls"))
    return rows.agg(F.round(A.brier(softmax(F.col("lls")), F.col("label")), 6).alias("brier"))


@query(
    "h8_acc_all",
    """SELECT round(avg(ok), 6) AS acc, count(*) AS n_groups, round(stddev_samp(ok) / sqrt(count(*)), 6) AS stderr
       FROM (SELECT l_orderkey, CAST(bool_and(l_discount > 0.02) AS INT) AS ok FROM lineitem GROUP BY 1)""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("right", F.col("l_discount") > 0.02)
    out = A.acc_all(rows, ["l_orderkey"], "right")
    return out.select(F.round("acc", 6).alias("acc"), "n_groups", F.round("stderr", 6).alias("stderr"))


@query(
    "h9_group_em",
    """SELECT round(100 * avg(ok), 6) AS em FROM (SELECT l_orderkey,
       CAST(bool_and(l_linestatus = CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END) AS INT) AS ok FROM lineitem GROUP BY 1)""",
)
def _(spark, sf):
    pred = F.when(F.col("l_returnflag") == "N", "O").otherwise("F")
    rows = table(spark, sf, "lineitem").withColumn("pred", pred)
    return A.group_em(rows, "l_orderkey", "l_linestatus", "pred").select(F.round("em", 6).alias("em"))


@query(
    "h11_qa_suite",
    """WITH r AS (SELECT event_id, CAST(value > 80 AS INT) AS exact, least(value / 300, 1.0) AS f1, event_type <> 'error' AS has,
          event_type = 'error' AND user_id % 2 = 0 AS empty, (user_id * 37 + event_id * 11) % 1000 / 1000.0 AS na FROM events),
       w AS (SELECT sum(CASE WHEN has THEN exact WHEN empty THEN 0 ELSE -1 END) OVER o AS se,
               sum(CASE WHEN has THEN f1 WHEN empty THEN 0 ELSE -1 END) OVER o AS sf FROM r
             WINDOW o AS (ORDER BY na, event_id ROWS UNBOUNDED PRECEDING)),
       p AS (SELECT greatest(max(se), 0) AS pe, greatest(max(sf), 0) AS pf FROM w)
       SELECT count(*) AS total, round(100 * avg(exact), 6) AS exact, round(100 * avg(f1), 6) AS f1,
         round(100 * avg(exact) FILTER (has), 6) AS has_ans_exact, round(100 * avg(f1) FILTER (has), 6) AS has_ans_f1,
         round(100 * avg(exact) FILTER (NOT has), 6) AS no_ans_exact, round(100 * avg(f1) FILTER (NOT has), 6) AS no_ans_f1,
         round(100 * (count(*) FILTER (NOT has) + any_value(pe)) / count(*), 6) AS best_exact,
         round(100 * (count(*) FILTER (NOT has) + any_value(pf)) / count(*), 6) AS best_f1 FROM r, p""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        (F.col("value") > 80).cast("int").alias("exact"),
        F.least(F.col("value") / 300, F.lit(1.0)).alias("f1"),
        (F.col("event_type") != "error").alias("has"),
        ((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)).alias("empty"),
        ((F.col("user_id") * 37 + F.col("event_id") * 11) % 1000 / 1000.0).alias("na"),
    )
    out = A.qa_suite(rows, "event_id", "exact", "f1", "has", "empty", "na")
    return out.select("total", *[F.round(c, 6).alias(c) for c in out.columns if c != "total"])


@query(
    "h14_inst_accuracy",
    """SELECT round(avg(f), 6) AS inst_accuracy FROM (SELECT unnest(list_transform(embedding[1:5],
       lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS f FROM embeddings)""",
)
def _(spark, sf):
    flags = F.transform(F.slice("embedding", 1, 5), lambda x: x > 0)
    rows = table(spark, sf, "embeddings").select(flags.alias("flags"))
    out = A.inst_accuracy(rows, "flags")
    return out.select(F.round("inst_accuracy", 6).alias("inst_accuracy"))


@query(
    "h15_pooled_score",
    """WITH s AS (SELECT label, sum(v) / count(*) AS score FROM (SELECT label, CASE WHEN x > 0.1 THEN 1.0 ELSE 0.0 END AS v
         FROM (SELECT label, unnest(embedding[1:8]) AS x FROM embeddings)) GROUP BY 1)
       SELECT round((SELECT score FROM s WHERE label = 1) - (SELECT score FROM s WHERE label = 2), 6) AS diff""",
)
def _(spark, sf):
    scores = F.transform(F.slice("embedding", 1, 8), lambda x: F.when(x > 0.1, 1.0).otherwise(0.0))
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("task"), scores.alias("scores"))
    pooled = A.pooled_score(rows, ["task"], "scores")
    return A.subtask_diff(pooled, "task", "score", "1", "2").select(F.round("diff", 6).alias("diff"))


@query(
    "h16_mean_stderr",
    "SELECT event_type, round(stddev_samp(value) / sqrt(count(*)), 6) AS stderr FROM events GROUP BY 1",
)
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.round(A.mean_stderr(F.col("value")), 6).alias("stderr")
    )


SUBTASKS = """t AS (SELECT n_regionkey AS r, n_name AS task, avg(c_acctbal) AS value,
    stddev_samp(c_acctbal) / sqrt(count(*)) AS stderr, count(*) AS n
    FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"""


def subtasks(spark, sf):
    cust, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = cust.join(nation, cust.c_nationkey == nation.n_nationkey)
    return joined.groupBy("n_regionkey", F.col("n_name").alias("task")).agg(
        F.avg("c_acctbal").alias("value"),
        A.mean_stderr(F.col("c_acctbal")).alias("stderr"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "h18_pooled_stderr",
    f"""WITH {SUBTASKS} SELECT r AS n_regionkey,
        round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr FROM t GROUP BY 1""",
)
def _(spark, sf):
    return subtasks(spark, sf).groupBy("n_regionkey").agg(F.round(A.pooled_stderr(), 6).alias("stderr"))


@query(
    "h18_combined_stderr",
    f"""WITH RECURSIVE {SUBTASKS}, o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY task) AS k FROM t),
        c(r, k, v, n0, m) AS (SELECT r, k, stderr * stderr, CAST(n AS DOUBLE), value FROM o WHERE k = 1
          UNION ALL SELECT c.r, o.k, ((n0 - 1) * v + (o.n - 1) * o.stderr * o.stderr) / (n0 + o.n - 1)
            + n0 * o.n / ((n0 + o.n) * (n0 + o.n - 1)) * pow((m * n0 + o.value * o.n) / (n0 + o.n) - o.value, 2),
            n0, (m * n0 + o.value * o.n) / (n0 + o.n) FROM c JOIN o ON o.r = c.r AND o.k = c.k + 1)
        SELECT r AS n_regionkey, round(sqrt(arg_max(v, k)), 4) AS stderr FROM c GROUP BY 1""",
)
def _(spark, sf):
    out = A.combined_stderr(subtasks(spark, sf), ["n_regionkey"], "task", "stderr", "n", "value")
    return out.withColumn("stderr", F.round("stderr", 4))


@query(
    "h19_subtask_mean",
    f"""WITH {SUBTASKS} SELECT r AS n_regionkey, round(sum(value * n) / sum(n), 6) AS weighted, round(avg(value), 6) AS plain
        FROM t GROUP BY 1""",
)
def _(spark, sf):
    return subtasks(spark, sf).groupBy("n_regionkey").agg(
        F.round(A.subtask_mean("value", "n"), 6).alias("weighted"),
        F.round(A.subtask_mean("value", "n", False), 6).alias("plain"),
    )


@query(
    "h20_group_rollup",
    f"""WITH {SUBTASKS}, g AS (SELECT 'region ' || r_name AS "group", t.* FROM t JOIN region ON r_regionkey = r
          UNION ALL SELECT 'all', t.* FROM t)
        SELECT "group", 'acc' AS metric, 'none' AS filter,
          round(CASE WHEN "group" = 'all' THEN avg(value) ELSE sum(value * n) / sum(n) END, 6) AS value,
          round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr,
          CAST(sum(n) AS BIGINT) AS samples FROM g GROUP BY 1""",
)
def _(spark, sf):
    metrics = subtasks(spark, sf).select(
        F.concat(F.lit("nation "), "task").alias("task"),
        F.lit("acc").alias("metric"),
        F.lit("none").alias("filter"),
        "value",
        "stderr",
        F.col("n").alias("samples"),
    )
    edges = task_edges(spark, sf, with_customers=False)
    config = edges.select("group").distinct().withColumns(
        {"metric": F.lit("acc"), "filter": F.lit("none"), "weight_by_size": F.col("group") != "all"}
    )
    out = A.group_rollup(metrics, edges, config)
    return out.withColumns({c: F.round(c, 6) for c in ["value", "stderr"]})


@query(
    "h21_aggregate_metrics",
    """SELECT event_type AS task, 'value' AS metric, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS filter,
       round(avg(value), 6) AS value, round(stddev_samp(value) / sqrt(count(*)), 6) AS stderr, count(*) AS samples
       FROM events GROUP BY 1, 3""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("task"),
        F.lit("value").alias("metric"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("filter"),
        "value",
    )
    out = A.aggregate_metrics(rows)
    return out.withColumns({c: F.round(c, 6) for c in ["value", "stderr"]})


@query(
    "h22_direction",
    """SELECT p_brand, CASE WHEN bool_and(p_size > 1) = bool_or(p_size > 1) THEN bool_and(p_size > 1) END AS higher_is_better
       FROM part GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "part").withColumn("up", F.col("p_size") > 1)
    return A.direction(rows, ["p_brand"], "up")


TRACES = """t AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '<|im_start|>think' || chr(10) || text || chr(10) || '<|im_start|>answer' || chr(10) || 'Answer: ' || role
      WHEN conv_id % 3 = 1 THEN '<|im_start|>think' || chr(10) || text || chr(10) ELSE text || chr(10) || 'boxed' END AS resp,
      turn % 2 = 0 AS ok FROM conversations),
    s AS (SELECT *, string_split(string_split(resp, '<|im_start|>answer')[1], chr(10)) AS l FROM t),
    c AS (SELECT *, len(l) - 2 AS steps, array_to_string(l[2:len(l) - 1], chr(10)) AS think FROM s),
    w AS (SELECT *, len(list_filter(regexp_split_to_array(think, '\\s+'), lambda x: x <> '')) AS tw,
      len(list_filter(regexp_split_to_array(resp, '\\s+'), lambda x: x <> '')) AS rw,
      list_transform(l[2:len(l) - 1], lambda y: len(list_filter(regexp_split_to_array(y, '\\s+'), lambda x: x <> ''))) AS sw,
      CASE WHEN resp LIKE '%<|im_start|>answer%' THEN 2 ELSE 0 END AS aw FROM c)"""
EXTREMES = """min(list_min(sw)) AS min_step, max(list_max(sw)) AS max_step, min(tw) AS min_thinking, max(tw) AS max_thinking,
        min(aw) AS min_answer, max(aw) AS max_answer, min(rw) AS min_total, max(rw) AS max_total"""


def traces(spark, sf):
    kind = F.pmod("conv_id", F.lit(3))
    think = F.concat(F.lit("<|im_start|>think\n"), "text", F.lit("\n"))
    full = F.concat(think, F.lit("<|im_start|>answer\nAnswer: "), "role")
    resp = F.when(kind == 0, full).when(kind == 1, think).otherwise(F.concat("text", F.lit("\nboxed")))
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), resp.alias("resp"), (F.col("turn") % 2 == 0).alias("ok")
    )


@query(
    "h23_trace_stats",
    f"""WITH {TRACES} SELECT count(*) AS samples, round(avg(steps), 1) AS avg_steps, {EXTREMES},
        round(sum(tw) / sum(greatest(steps, 0)), 1) AS avg_step,
        round(avg(tw), 1) AS avg_thinking, round(avg(aw), 1) AS avg_answer, round(avg(rw), 1) AS avg_total,
        count(*) FILTER (resp NOT LIKE '%Answer:%' AND resp NOT LIKE '%\\boxed%') AS without_answer,
        count(*) FILTER (resp NOT LIKE '%<|im_start|>think%') AS without_thinking,
        count(*) FILTER (steps > 3) AS too_many_steps, count(*) FILTER (tw > 40) AS too_many_tokens,
        round(avg(CAST(ok AS INT)), 6) AS accuracy FROM w""",
)
def _(spark, sf):
    out = A.trace_stats(traces(spark, sf), "resp", "ok", allowed_steps=3, allowed_tokens=40)
    return out.withColumn("accuracy", F.round("accuracy", 6))


# one counted step per line, one answer section
COUNTED = """s AS (SELECT string_split(text, chr(10)) AS l, role, turn % 2 = 0 AS ok, text FROM conversations),
    r AS (SELECT len(l) AS steps, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS tw, ok,
      list_transform(l, lambda y: len(list_filter(regexp_split_to_array(y, '\\s+'), lambda x: x <> ''))) AS sw FROM s),
    q AS (SELECT *, tw + 3 * steps + 3 AS rw, 2 AS aw FROM r)"""


@query(
    "h23_counted_steps",
    f"""WITH {COUNTED} SELECT count(*) AS samples, round(avg(steps), 1) AS avg_steps, round(sum(tw) / sum(steps), 1) AS avg_step,
        {EXTREMES}, round(avg(tw), 1) AS avg_thinking, 2.0 AS avg_answer, round(avg(rw), 1) AS avg_total, 0 AS without_answer, 0 AS without_thinking,
        count(*) FILTER (steps > 3) AS too_many_steps, round(avg(CAST(ok AS INT)), 6) AS accuracy FROM q""",
)
def _(spark, sf):
    lines = F.split("text", "\n")
    step = lambda s, i: F.concat(F.lit("<|im_start|>"), (F.size(lines) - i).cast("string"), F.lit(" steps left\n"), s)
    resp = F.concat(F.array_join(F.transform(lines, step), "\n"), F.lit("\n<|im_start|>answer\nAnswer: "), "role")
    rows = table(spark, sf, "conversations").select(resp.alias("resp"), (F.col("turn") % 2 == 0).alias("ok"))
    out = A.trace_stats(rows, "resp", "ok", allowed_steps=3, counted=True)
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "h23_correctness_by_length",
    f"""WITH {TRACES.replace("SELECT conv_id, CASE", "SELECT conv_id * 1000 + turn AS idx, CASE", 1)}
        SELECT row_number() OVER (ORDER BY tw, idx) AS place, idx, tw AS thinking_words, ok FROM w""",
)
def _(spark, sf):
    return A.correctness_by_length(traces(spark, sf), "resp", "ok", "idx")


@query(
    "h23_sorted_lengths",
    f"""WITH {TRACES.replace("SELECT conv_id, CASE", "SELECT conv_id * 1000 + turn AS idx, CASE", 1)},
        e AS (SELECT 'thinking' AS kind, idx, 0 AS step, tw AS words FROM w UNION ALL SELECT 'answer', idx, 0, aw FROM w
          UNION ALL SELECT 'total', idx, 0, rw FROM w
          UNION ALL SELECT 'step', idx, unnest(range(1, len(sw) + 1)), unnest(sw) FROM w)
        SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY words, idx, step) AS place, idx, step, words FROM e""",
)
def _(spark, sf):
    return A.sorted_lengths(traces(spark, sf), "resp", "idx")


@query(
    "h24_sample_counts",
    "SELECT source, count(*) AS original, least(count(*), 30) AS effective FROM documents GROUP BY 1",
)
def _(spark, sf):
    return A.sample_counts(table(spark, sf, "documents"), ["source"], 30)


@query(
    "h25_task_hash",
    """WITH h AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, sha256(text) AS h FROM documents),
       c AS (SELECT lang, (pos - 1) // 16384 AS c, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM h GROUP BY 1, 2),
       d AS (SELECT lang, c // 16384 AS d, sha256(string_agg(h, '' ORDER BY c)) AS h FROM c GROUP BY 1, 2)
       SELECT lang, sha256(string_agg(h, '' ORDER BY d)) AS task_hash FROM d GROUP BY 1""",
)
def _(spark, sf):
    from assayline.operators.scale import numbered

    docs = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    placed = numbered(docs, ["lang"], "doc_id", "pos")
    return A.task_hash(placed, ["lang"], "pos", "h")


@query(
    "h26_token_cost",
    """SELECT source, CAST(sum(n_chars) AS BIGINT) AS tokens, round(sum(n_chars) / 1000 * 0.0008, 6) AS small,
       round(sum(n_chars) / 1000 * 0.06, 6) AS large FROM documents GROUP BY ROLLUP (source)""",
)
def _(spark, sf):
    out = A.token_cost(table(spark, sf, "documents"), "source", "n_chars", {"small": 0.0008, "large": 0.06})
    return out.withColumns({c: F.round(c, 6) for c in ["small", "large"]})


@query("h27_value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return A.value_counts(table(spark, sf, "documents"), "lang")
