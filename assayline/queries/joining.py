"""Key joins on the given tables."""

from pyspark.sql import functions as F

from assayline.operators import joins as J
from assayline.queries import query, table

QHASH = "substr(sha256(text), 1, 16)"


def questions(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.col("text").alias("question"), J.question_hash(F.col("text")).alias("qhash")
    )


@query("b4_question_hash", f"SELECT doc_id, {QHASH} AS qhash FROM documents")
def _(spark, sf):
    return questions(spark, sf).select("doc_id", "qhash")


ATTEMPTS = f"""SELECT {QHASH} AS qhash, max(quality) AS quality, max(toxic) AS toxic
    FROM documents JOIN labels USING (doc_id) GROUP BY 1"""


def attempts(spark, sf):
    joined = questions(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return joined.groupBy("qhash").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


@query(
    "e1_attach_attempts",
    f"SELECT d.doc_id, a.quality FROM documents d JOIN ({ATTEMPTS}) a ON a.qhash = {QHASH}",
)
def _(spark, sf):
    return J.attach_attempts(questions(spark, sf), attempts(spark, sf)).select("doc_id", "quality")


@query(
    "e2_attach_grade",
    f"""SELECT doc_id, CASE WHEN lang <> 'de' AND quality = 1 THEN true WHEN lang <> 'de' AND toxic = 1 THEN false END AS correct
        FROM documents d LEFT JOIN ({ATTEMPTS}) a ON a.qhash = {QHASH}""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("qhash", J.question_hash(F.col("text")))
    docs = docs.withColumn("solution", F.when(F.col("lang") != "de", F.col("source")))
    grade = F.when(F.col("quality") == 1, "Yes").when(F.col("toxic") == 1, "No").otherwise("?")
    grades = attempts(spark, sf).withColumn("grade", grade)
    return J.attach_grade(docs, grades, "correct").select("doc_id", "correct")


@query(
    "e3_attach_domain",
    """SELECT c_custkey, n_name AS domain FROM customer LEFT JOIN nation
       ON n_nationkey = c_nationkey AND n_regionkey <> 2""",
)
def _(spark, sf):
    cust = table(spark, sf, "customer")
    titles = table(spark, sf, "nation").where("n_regionkey <> 2")
    codes = cust.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    out = J.attach_domain(cust, codes, titles, "c_custkey", "n_nationkey", "n_name")
    return out.select("c_custkey", "domain")


@query(
    "e4_attach_length",
    """SELECT o_orderkey, n_lines FROM orders LEFT JOIN
       (SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    lengths = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines")
    )
    orders = table(spark, sf, "orders").select("o_orderkey")
    return J.attach_length(orders, lengths, "n_lines", "o_orderkey")


@query(
    "e5_exclude",
    """SELECT c_custkey, c_nationkey FROM customer
       WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000)""",
)
def _(spark, sf):
    held = table(spark, sf, "supplier").where("s_acctbal < 1000")
    held = held.select(F.col("s_nationkey").alias("c_nationkey"))
    return J.exclude(table(spark, sf, "customer"), held, "c_nationkey").select("c_custkey", "c_nationkey")


@query(
    "e6_keep_listed",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
       AND l_returnflag IN ('A', 'R')""",
)
def _(spark, sf):
    listed = table(spark, sf, "supplier").where("s_acctbal > 5000")
    listed = listed.select(F.col("s_suppkey").alias("l_suppkey"))
    lines = J.keep_listed(table(spark, sf, "lineitem"), ["A", "R"], "l_returnflag")
    return J.keep_listed(lines, listed, "l_suppkey").select("l_orderkey", "l_linenumber")


RUN = """SELECT event_type AS task, avg(v) AS value, stddev_samp(v) / sqrt(count(*)) AS stderr
    FROM (SELECT event_type, CASE WHEN value > {cut} THEN 1.0 ELSE 0.0 END AS v, user_id FROM events) GROUP BY 1"""


@query(
    "e7_compare_runs",
    f"""WITH r AS (SELECT task, a.value - b.value AS diff,
          (a.value - b.value) / sqrt(a.stderr * a.stderr + b.stderr * b.stderr) AS z
          FROM ({RUN.format(cut=100)}) a JOIN ({RUN.format(cut=110)}) b USING (task)),
        -- the normal tail by adding up its density in steps of 1/10000 up to 9
        g AS (SELECT i / 10000.0 AS lo, exp(-(i + 0.5) * (i + 0.5) / 2e8) / 10000.0 / sqrt(2 * pi()) AS mass
              FROM range(90000) t(i)),
        p AS (SELECT task, 2 * sum(mass * least(1.0, (lo + 0.0001 - abs(z)) * 10000.0)) AS p_value
              FROM r JOIN g ON lo + 0.0001 > abs(z) GROUP BY task)
        SELECT task, round(diff, 6) AS diff, round(z, 6) AS z, round(p_value, 4) AS p_value,
          abs(z) < 1.959964 AS same FROM r JOIN p USING (task)""",
)
def _(spark, sf):
    def run(cut):
        v = F.when(F.col("value") > cut, 1.0).otherwise(0.0)
        return table(spark, sf, "events").groupBy(F.col("event_type").alias("task")).agg(
            F.avg(v).alias("value"),
            (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias("stderr"),
        )

    out = J.compare_runs(run(100), run(110))
    rounded = [F.round(c, n).alias(c) for c, n in (("diff", 6), ("z", 6), ("p_value", 4))]
    return out.select("task", *rounded, "same")


EDGES = """SELECT 'all' AS "group", 'region ' || r_name AS child FROM region
    UNION ALL SELECT 'region ' || r_name, 'nation ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'nation ' || n_name, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def task_edges(spark, sf, with_customers=True):
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    top = region.select(F.lit("all").alias("group"), F.concat(F.lit("region "), "r_name").alias("child"))
    mid = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("region "), "r_name").alias("group"), F.concat(F.lit("nation "), "n_name").alias("child")
    )
    edges = top.unionByName(mid)
    if with_customers:
        cust = table(spark, sf, "customer")
        low = cust.join(nation, nation.n_nationkey == cust.c_nationkey).select(
            F.concat(F.lit("nation "), "n_name").alias("group"), F.col("c_name").alias("child")
        )
        edges = edges.unionByName(low)
    return edges


@query(
    "e8_leaf_tasks",
    f"""WITH RECURSIVE e AS ({EDGES}), t("group", task) AS (
          SELECT "group", child FROM e UNION ALL
          SELECT t."group", e.child FROM t JOIN e ON e."group" = t.task)
        SELECT DISTINCT "group", task FROM t WHERE task NOT IN (SELECT "group" FROM e)""",
)
def _(spark, sf):
    return J.leaf_tasks(task_edges(spark, sf))


@query(
    "e9_join_predictions",
    """SELECT lang AS task, d.doc_id AS "index", n_chars, quality
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("task"), F.col("doc_id").alias("index"), "n_chars"
    )
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("index"), "quality")
    predictions = labels.join(docs.select("task", "index"), "index")
    return J.join_predictions(docs, predictions)
