"""Deduplication, sampling, quotas and splits on the given tables."""

from pyspark.sql import functions as F

from assayline.operators import selection as S
from assayline.queries import query, table


def hashed(expr: str, seed: int) -> str:
    return f"sha256(concat_ws('|', CAST({expr} AS VARCHAR), '{seed}'))"


@query(
    "d1_dedup_first",
    """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
       FROM documents) WHERE rn = 1""",
)
def _(spark, sf):
    return S.dedup_first(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "source")


@query(
    "d2_sample_keep",
    f"""WITH k AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000),
        r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hashed('o_orderkey', 42)}, o_orderkey) AS rn FROM orders)
        SELECT o_orderkey FROM r WHERE rn <= greatest(1000 - (SELECT count(*) FROM k), 0)
        UNION ALL SELECT o_orderkey FROM k""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = S.sample_keep(orders, 1000, F.col("o_totalprice") > 400000, ["o_orderkey"])
    return out.select("o_orderkey")


@query(
    "d3_quota_sample",
    f"""WITH s AS (SELECT count(DISTINCT o_orderpriority) AS nt, count(DISTINCT topic) AS np FROM
          (SELECT o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS topic FROM orders)),
        q AS (SELECT ceil(500 / nt) AS qt, ceil(ceil(500 / nt) / np) AS qp FROM s),
        r AS (SELECT o_orderkey, o_orderpriority AS task,
            CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS topic,
            {hashed('o_orderkey', 42)} AS h FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY h) AS task_no,
            row_number() OVER (PARTITION BY topic ORDER BY h) AS topic_no FROM r),
        p AS (SELECT n.*, qt, CASE WHEN topic IS NOT NULL AND topic_no <= qp THEN 1 ELSE 0 END AS bt FROM n, q),
        a AS (SELECT *, sum(bt) OVER (ORDER BY h) AS picks FROM p),
        b AS (SELECT *, CASE WHEN (CASE WHEN task = '1-URGENT' THEN picks + task_no - 1 ELSE task_no - 1 END) < qt
            THEN 1 ELSE 0 END AS bk FROM a),
        c AS (SELECT *, bt + bk AS k, sum(bt + bk) OVER (ORDER BY h) AS total FROM b),
        e AS (SELECT min(h) AS stop FROM c WHERE k > 0 AND total = 500)
        SELECT o_orderkey, task, topic FROM (SELECT *, unnest(range(k)) FROM c, e
          WHERE k > 0 AND (stop IS NULL OR h <= stop))""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("task"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("topic"),
    )
    return S.quota_sample(orders, 500, "task", "topic", "1-URGENT", ["o_orderkey"])


@query(
    "d4_select_hard",
    """WITH n AS (SELECT p_partkey, p_type, p_size / 5.0 AS difficulty FROM part WHERE length(p_type) <= 30),
       c AS (SELECT p_type, count(*) AS subdomain_rows, min(p_partkey) AS f FROM n GROUP BY 1)
       SELECT p_partkey, p_type, subdomain_rows FROM n JOIN c USING (p_type) WHERE difficulty > 6.5
       ORDER BY subdomain_rows, f, p_partkey LIMIT 100""",
)
def _(spark, sf):
    part = table(spark, sf, "part").withColumn("difficulty", F.col("p_size") / 5.0)
    out = S.select_hard(part, 100, "p_type", "difficulty", "p_partkey")
    return out.select("p_partkey", "p_type", "subdomain_rows")


@query(
    "d5_drop_incomplete",
    """WITH f AS (SELECT user_id, CASE WHEN value > 20 THEN value END AS length,
          nullif(event_type, 'error') AS domain,
          row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
       SELECT c_custkey, length, domain FROM customer JOIN f ON user_id = c_custkey
       WHERE rn = 1 AND length IS NOT NULL AND domain IS NOT NULL""",
)
def _(spark, sf):
    feats = table(spark, sf, "events").select(
        F.col("user_id").alias("c_custkey"),
        "event_id",
        F.when(F.col("value") > 20, F.col("value")).alias("length"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("domain"),
    )
    cust = table(spark, sf, "customer").select("c_custkey")
    return S.drop_incomplete(cust, feats, "c_custkey", "event_id", ["length", "domain"])


@query(
    "d6_drop_patterns",
    r"""WITH q AS (SELECT doc_id, source, CASE
          WHEN doc_id % 7 = 0 THEN '[asy] ' || text WHEN doc_id % 7 = 1 THEN '![Image] ' || text
          WHEN doc_id % 7 = 2 THEN text || ' p' || CAST(doc_id AS VARCHAR) || '.'
          WHEN doc_id % 7 = 3 THEN '**' || source || '** ' || text
          WHEN doc_id % 7 = 4 THEN '**bold** ' || text ELSE text END AS question FROM documents)
       SELECT doc_id FROM q WHERE (question NOT LIKE '%[asy]%' AND question NOT LIKE '%![Image]%'
         AND NOT regexp_matches(question, 'p[1-9][0-9]{0,2}\.')
         AND NOT regexp_matches(question, '\*\*([^\s\]]*\d[^\s\]]*\*\*|[^\s\]]*\*\*[^\n]*\d)'))
         OR (question LIKE '%[asy]%' AND source LIKE '%src1%')""",
)
def _(spark, sf):
    kind, text = F.pmod(F.col("doc_id"), F.lit(7)), F.col("text")
    question = (
        F.when(kind == 0, F.concat(F.lit("[asy] "), text))
        .when(kind == 1, F.concat(F.lit("![Image] "), text))
        .when(kind == 2, F.concat(text, F.lit(" p"), F.col("doc_id").cast("string"), F.lit(".")))
        .when(kind == 3, F.concat(F.lit("**"), F.col("source"), F.lit("** "), text))
        .when(kind == 4, F.concat(F.lit("**bold** "), text))
        .otherwise(text)
    )
    docs = table(spark, sf, "documents").withColumn("question", question)
    return S.drop_patterns(docs, "question", "source", "src1").select("doc_id")


@query("d7_keep_hard", "SELECT doc_id FROM labels WHERE NOT (quality = 1 OR toxic = 1)")
def _(spark, sf):
    rows = table(spark, sf, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")
    )
    return S.keep_hard(rows, ["a", "b"]).select("doc_id")


@query(
    "d8_preselect",
    """SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id
       WHERE quality = 1 AND (source IN ('src1', 'src2') OR (source LIKE '%src1%' AND n_chars > 5600))""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = rows.withColumn("correct", F.col("quality") == 1)
    out = S.preselect(rows, "correct", "source", "n_chars", ["src1", "src2"], "src1")
    return out.select("doc_id")


WEIGHTS = """WITH a AS (SELECT c_nationkey AS domain, count(*) AS n FROM customer GROUP BY 1),
    b AS (SELECT s_nationkey AS domain, count(*) AS n FROM supplier GROUP BY 1),
    r AS (SELECT 0.5 * (SELECT sum(n) FROM b) / (SELECT sum(n) FROM a) AS ratio),
    m AS (SELECT coalesce(a.domain, b.domain) AS domain,
      CAST(floor(coalesce(a.n, 0) * ratio) AS BIGINT) + coalesce(b.n, 0) AS n
      FROM a FULL JOIN b ON a.domain = b.domain, r)
    SELECT domain, n, round(n / sum(n) OVER (), 6) AS weight FROM m WHERE n > 0"""


@query("d9_domain_weights", WEIGHTS)
def _(spark, sf):
    first = table(spark, sf, "customer").select(F.col("c_nationkey").alias("domain"))
    second = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("domain"))
    out = S.domain_weights(first, second, "domain")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "d10_length_weights",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN lang END AS lang, n_chars FROM documents),
        r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang
          ORDER BY n_chars DESC, {hashed('doc_id', 0)}) - 1 AS length_rank FROM d)
        SELECT doc_id, lang, length_rank, round(pow(2.0, -length_rank) /
          sum(pow(2.0, -length_rank)) OVER (PARTITION BY lang), 6) AS weight FROM r""",
)
def _(spark, sf):
    lang = F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang")
    docs = table(spark, sf, "documents").select("doc_id", lang, "n_chars")
    out = S.length_weights(docs, "lang", "n_chars", "doc_id")
    return out.select("doc_id", "lang", "length_rank", F.round("weight", 6).alias("weight"))


def diversity_sql(pool: str, chosen: str, weights: str, total: int, switch: int, seed: int = 42) -> str:
    """Tables d (id, domain, length), c (id) and w (domain, weight), and the draws replayed:
    ``one`` draws inside every domain, ``walk`` picks the domains, ``picked`` are the ids."""
    even = lambda text: f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / pow(2.0, 52)"
    places = "range(1, len(names) + 1)"
    return f"""d AS ({pool}), c AS ({chosen}), w AS ({weights}),
    p AS (SELECT domain, id, EXISTS (SELECT 1 FROM c WHERE c.id = d.id) AS chosen, count(*) OVER (PARTITION BY domain) AS size,
      row_number() OVER (PARTITION BY domain ORDER BY length DESC, {hashed('id', seed)}, id) AS pos FROM d),
    one AS (
      SELECT domain, size, 0 AS step, list(id ORDER BY pos) AS ids, list(chosen ORDER BY pos) AS seen, 0 AS fresh,
        any_value(id) AS id, false AS chosen FROM p WHERE pos <= {2 * total + 54} GROUP BY 1, 2
      UNION ALL
      SELECT domain, size, step + 1, ids[1:k] || list_slice(ids, k + 2, len(ids)), seen[1:k] || list_slice(seen, k + 2, len(seen)),
        fresh + CAST(NOT seen[k + 1] AS INT), ids[k + 1], seen[k + 1]
      FROM (SELECT *, least(CAST(floor(-log2(1 - {even(f"concat('{seed}|', domain, '|', step)")} *
          CASE WHEN size - step < 60 THEN 1 - pow(2.0, step - size) ELSE 1 END)) AS BIGINT), len(ids) - 1) AS k
        FROM one WHERE len(ids) > 0 AND fresh < {total})),
    f AS (SELECT domain, any_value(size) AS size, list(chosen ORDER BY step) AS flags FROM one WHERE step > 0 GROUP BY 1),
    a AS (SELECT list(f.domain ORDER BY f.domain NULLS FIRST) AS names, list(size ORDER BY f.domain NULLS FIRST) AS sizes,
      list(flags ORDER BY f.domain NULLS FIRST) AS flags, list(coalesce(weight, 0) ORDER BY f.domain NULLS FIRST) AS odds
      FROM f LEFT JOIN w ON w.domain IS NOT DISTINCT FROM f.domain),
    walk AS (
      SELECT 0 AS step, (SELECT count(DISTINCT id) FROM c) AS n, list_transform(names, lambda x: 0) AS taken FROM a
      UNION ALL
      SELECT step + 1, n + CAST(NOT flags[i][taken[i] + 1] AS INT), list_transform({places}, lambda j: taken[j] + CAST(j = i AS INT))
      FROM (SELECT *, list_filter({places}, lambda j: upto[j] > {even(f"concat('{seed}|', step)")} * upto[len(upto)])[1] AS i
        FROM (SELECT *, list_transform({places}, lambda j: list_sum(mix[1:j])) AS upto
          FROM (SELECT *, list_transform({places}, lambda j: CASE WHEN taken[j] >= sizes[j] THEN 0.0
                WHEN n < {switch} OR rest = 0 THEN 1.0 ELSE odds[j] END::DOUBLE) AS mix
            FROM (SELECT *, list_sum(list_transform({places}, lambda j: CASE WHEN taken[j] < sizes[j] THEN odds[j] ELSE 0 END)) AS rest,
                list_sum(list_transform({places}, lambda j: sizes[j] - taken[j])) AS left_over
              FROM walk, a) WHERE n < {total} AND left_over > 0)))),
    k AS (SELECT unnest(names) AS domain, unnest(taken) AS k FROM a, (SELECT taken FROM walk ORDER BY step DESC LIMIT 1)),
    picked AS (SELECT one.id FROM one JOIN k ON k.domain IS NOT DISTINCT FROM one.domain AND step BETWEEN 1 AND k.k UNION SELECT id FROM c)"""


MIXED = """SELECT domain, n / sum(n) OVER () AS weight FROM (
    SELECT domain, CAST(coalesce(floor(a * (0.5 * sum(b) OVER () / nullif(sum(a) OVER (), 0))), 0) AS BIGINT) + b AS n FROM (
      SELECT domain, CAST(sum(a) AS DOUBLE) AS a, sum(b) AS b FROM (
        SELECT domain, 1 AS a, 0 AS b FROM ({first}) UNION ALL SELECT domain, 0, 1 FROM ({second})) GROUP BY 1)) WHERE n > 0"""

GOOD_TOXIC = "SELECT doc_id AS id FROM labels WHERE quality = 1 AND toxic = 1"
SPARSE = "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE source END AS domain"


@query(
    "d11_diversity_sample",
    "WITH RECURSIVE "
    + diversity_sql(
        f"SELECT doc_id AS id, {SPARSE}, n_chars AS length FROM documents",
        GOOD_TOXIC,
        MIXED.format(
            first=f"SELECT {SPARSE} FROM documents JOIN ({GOOD_TOXIC}) ON id = doc_id",
            second=f"SELECT {SPARSE} FROM documents",
        ),
        100,
        70,
    )
    + " SELECT id AS doc_id FROM picked",
)
def _(spark, sf):
    domain = F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source")
    docs = table(spark, sf, "documents").select("doc_id", domain, "n_chars")
    labels = table(spark, sf, "labels").where("quality = 1 AND toxic = 1").select("doc_id")
    weights = S.domain_weights(docs.join(labels, "doc_id"), docs, "source")
    return S.diversity_sample(
        docs, labels, weights, "doc_id", "source", "n_chars", total=100, switch=70
    )


@query(
    "d12_split_eval",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hashed('o_orderkey', 7)}) AS rn FROM orders)
        SELECT o_orderkey, CASE WHEN rn <= 300 THEN 'eval' ELSE 'train' END AS split FROM r
        WHERE (rn <= 250) OR (rn > 300 AND rn <= 1200)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return S.split_eval(orders, 300, ["o_orderkey"], 7, max_train=900, max_eval=250)


@query(
    "d13_limit_docs",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
       WHERE rn <= ceil((SELECT count(*) FROM documents) * 0.33)""",
)
def _(spark, sf):
    return S.limit_docs(table(spark, sf, "documents").select("doc_id"), 0.33, "doc_id")


@query("d14_shard", "SELECT doc_id FROM documents WHERE doc_id % 8 = 3")
def _(spark, sf):
    return S.shard(table(spark, sf, "documents"), 3, 8, "doc_id").select("doc_id")


@query(
    "d15_fewshot_first",
    r"""WITH p AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark
          QUALIFY p < 4),
        x AS (SELECT b.item_id, p.text, p.p, row_number() OVER (PARTITION BY b.item_id ORDER BY p.p) AS shot
          FROM benchmark b JOIN p ON p.item_id <> b.item_id)
        SELECT item_id, string_agg('Q: ' || text || ' ' || CAST(length(text) AS VARCHAR), chr(10) || chr(10) ORDER BY shot)
          || chr(10) || chr(10) AS context FROM x WHERE shot <= 3 GROUP BY item_id""",
)
def _(spark, sf):
    pool = table(spark, sf, "benchmark").select(
        "item_id",
        F.concat(F.lit("Q: "), "text").alias("question"),
        F.length("text").cast("string").alias("answer"),
    )
    out = S.fewshot(
        table(spark, sf, "benchmark"), pool, 3, "item_id", "item_id", "question", "answer", "first"
    )
    return out.select("item_id", "context")


def _random_sql(k: int, seed: int = 1234) -> str:
    """``k`` + 1 different places of the pool per row, drawn and ordered by hashes."""
    n = k + 1
    h = lambda place, use: f"CAST('0x' || substr(md5(concat_ws('|', turn_id, {place}, '{use}{seed}')), 1, 15) AS BIGINT)"
    steps, done = [], []
    for i in range(n):
        j = f"(n - {n - i})"
        drawn = f"{h(j, 'draw')} % ({j} + 1)"
        pick = f"CASE WHEN {drawn} IN ({', '.join(done)}) THEN {j} ELSE {drawn} END" if done else drawn
        steps.append(f"s{i} AS (SELECT *, {pick} AS p{i} FROM {f's{i - 1}' if i else 'b'})")
        done.append(f"p{i}")
    return f"""WITH t AS (SELECT conv_id * 1000 + turn AS turn_id, text, role FROM conversations),
        q AS (SELECT *, row_number() OVER (ORDER BY turn_id) - 1 AS place FROM t),
        b AS (SELECT turn_id, (SELECT count(*) FROM t) AS n FROM t), {', '.join(steps)},
        u AS (SELECT turn_id, unnest([{', '.join(done)}]) AS place FROM s{n - 1}),
        x AS (SELECT u.turn_id, q.text, q.role, row_number() OVER (PARTITION BY u.turn_id ORDER BY {h('u.place', 'order').replace('turn_id', 'u.turn_id')}, u.place) AS shot
          FROM u JOIN q ON q.place = u.place AND q.turn_id <> u.turn_id)
        SELECT turn_id, string_agg('[user]' || text || '[assistant]' || role, '' ORDER BY shot) AS context
        FROM x WHERE shot <= {k} GROUP BY 1"""


@query("d15_fewshot_random", _random_sql(3))
def _(spark, sf):
    place = (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id")
    turns = table(spark, sf, "conversations").select(place, "text", "role")
    out = S.fewshot(turns.drop("role"), turns, 3, "turn_id", "turn_id", "text", "role", "random", chat=True)
    turns = F.transform("context", lambda t: F.concat(F.lit("["), t["role"], F.lit("]"), t["content"]))
    return out.select("turn_id", F.array_join(turns, "").alias("context"))


@query("d16_chunk", "SELECT doc_id, doc_id // 128 AS chunk_no FROM documents")
def _(spark, sf):
    return S.chunk(table(spark, sf, "documents"), 128, "doc_id").select("doc_id", "chunk_no")
