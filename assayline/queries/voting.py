"""Votes, best-of-n, coverage and search trees on the event stream.

Question = user, answer = event type, order = event id, weight = value.
"""

from pyspark.sql import functions as F

from assayline.functions.answers import answer_class, answer_forms
from assayline.operators import registry as R
from assayline.operators import trees
from assayline.operators import vote as V
from assayline.operators.scale import numbered
from assayline.queries import query, table
from assayline.session import materialize

Q = ["user_id"]


def events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")


@query(
    "j1_take_first",
    """SELECT user_id, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
)
def _(spark, sf):
    return V.take_first(events(spark, sf), Q, "event_id").select("user_id", "event_type")


@query(
    "j2_take_first_k",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos
       FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 5)
       QUALIFY pos <= 5""",
)
def _(spark, sf):
    rows = events(spark, sf)
    short = V.short_groups(rows, Q, 5).select("user_id")
    out = V.take_first_k(rows.join(short, "user_id", "left_anti"), Q, "event_id", 5)
    return out.select("user_id", "event_id", "pos")


MAJ = """SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes,
    min(event_id) AS f FROM {src} GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1"""


@query("j3_majority_vote", MAJ.format(src="events"))
def _(spark, sf):
    return V.majority_vote(events(spark, sf), Q, "event_id", "event_type")


FIRST8 = """(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8)"""


@query(
    "j4_apply_filters",
    f"""SELECT 'score-first' AS filter, user_id, event_type FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
        UNION ALL SELECT 'maj@8', user_id, event_type FROM ({MAJ.format(src=FIRST8)})""",
)
def _(spark, sf):
    chains = {
        "score-first": [lambda d: V.take_first(d, Q, "event_id")],
        "maj@8": [
            lambda d: V.take_first_k(d, Q, "event_id", 8, check=False),
            lambda d: V.majority_vote(d, Q, "event_id", "event_type"),
        ],
    }
    return V.apply_filters(events(spark, sf), chains).select("filter", "user_id", "event_type")


MAPPED8 = """(SELECT user_id, event_id, CASE letters WHEN 'CLI' THEN 'click' WHEN 'PUR' THEN 'buy'
    ELSE 'other' END AS event_type FROM (SELECT *, coalesce(nullif(trim(regexp_extract(upper(event_type),
    '^([A-Z]{3})', 1)), ''), '[invalid]') AS letters FROM """ + FIRST8 + """))"""


@query(
    "j4_named_filters",
    f"""SELECT 'regex-first' AS filter, user_id, coalesce(nullif(regexp_extract(event_type, '([a-m]+)', 1), ''),
          '[invalid]') AS event_type FROM events
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
        UNION ALL SELECT 'map-maj@8', user_id, event_type FROM ({MAJ.format(src=MAPPED8)})""",
)
def _(spark, sf):
    declared = [
        {
            "name": "regex-first",
            "filter": [
                {"function": "regex", "regex_pattern": "([a-m]+)"},
                {"function": "take_first"},
            ],
        },
        {
            "name": "map-maj@8",
            "filter": [
                {"function": "take_first_k", "k": 8, "check": False},
                {"function": "uppercase"},
                {"function": "regex", "regex_pattern": "^([A-Z]{3})"},
                {
                    "function": "map",
                    "mapping_dict": {"CLI": "click", "PUR": "buy"},
                    "default_value": "other",
                },
                {"function": "majority_vote"},
            ],
        },
    ]
    chains = R.filter_chains(declared, Q, "event_id", "event_type")
    return V.apply_filters(events(spark, sf), chains).select("filter", "user_id", "event_type")


@query(
    "j5_agg_steps",
    """WITH s AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CASE WHEN abs(x) > 0.2 THEN NULL
          ELSE abs(CAST(x AS DOUBLE)) END) AS a FROM embeddings),
        k AS (SELECT vec_id, a, list_filter(a, lambda x: x IS NOT NULL) AS v FROM s)
       SELECT vec_id,
         round(least(coalesce(list_min(v), 1.0), 1.0), 6) AS min1,
         round(CASE WHEN len(v) = len(a) THEN list_sum(a) / len(a) END, 6) AS mean1,
         round(CASE WHEN len(v) = len(a) THEN list_product(a) END, 9) AS prod1,
         round(coalesce(a[10], 0.0), 6) AS last1, round(list_sum(v) / len(v), 6) AS mean2 FROM k""",
)
def _(spark, sf):
    first = F.slice(F.col("embedding"), 1, 10)
    scores = F.transform(first, lambda x: F.when(F.abs(x) <= 0.2, F.abs(x.cast("double"))))
    rows = table(spark, sf, "embeddings").select("vec_id", scores.alias("a"))
    a = F.col("a")
    return rows.select(
        "vec_id",
        F.round(V.agg_steps(a, "min"), 6).alias("min1"),
        F.round(V.agg_steps(a, "mean"), 6).alias("mean1"),
        F.round(V.agg_steps(a, "prod"), 9).alias("prod1"),
        F.round(V.agg_steps(a, "last"), 6).alias("last1"),
        F.round(V.agg_steps(a, "mean", 2), 6).alias("mean2"),
    )


@query(
    "j6_best_of_n",
    """SELECT user_id, event_type, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
)
def _(spark, sf):
    return V.best_of_n(events(spark, sf), Q, "event_id", "event_type", "value")


VOTE = """WITH r AS (SELECT user_id, event_id, event_type, {w} AS w,
      sum({w}) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seen FROM events),
    o AS (SELECT user_id, event_type, run FROM r WHERE w > 0
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
    p AS (SELECT user_id, event_type, run FROM r WHERE seen > 1
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run DESC, event_id) = 1)
    SELECT o.user_id, CASE WHEN p.run > o.run THEN p.event_type ELSE o.event_type END AS event_type,
      CAST(round(CASE WHEN p.run > o.run THEN p.run ELSE o.run END, 4) AS DOUBLE) AS vote FROM o LEFT JOIN p ON p.user_id = o.user_id"""


@query("j7_weighted_vote", VOTE.format(w="CAST(value AS DECIMAL(18, 2))"))
def _(spark, sf):
    out = V.weighted_vote(events(spark, sf), Q, "event_id", "event_type", F.col("value"))
    return out.withColumn("vote", F.round("vote", 4))


@query("j7_plain_vote", VOTE.format(w="1.0"))
def _(spark, sf):
    return V.weighted_vote(events(spark, sf), Q, "event_id", "event_type")


# three spellings of one half and two of seven
SAID = """WITH said AS (SELECT user_id, event_id, CASE WHEN k < 3 THEN 'half' ELSE 'seven' END AS cls,
      CASE k WHEN 0 THEN '1/2' WHEN 1 THEN '\\frac{1}{2}' WHEN 2 THEN '0.5' WHEN 3 THEN '7' ELSE '7.0' END AS event_type
      FROM (SELECT *, CAST(floor(value) AS BIGINT) % 5 AS k FROM events)), r AS"""


@query(
    "j7_vote_classes",
    VOTE.format(w="1.0").replace("user_id, event_type ORDER", "user_id, cls ORDER")
    .replace("FROM events)", "FROM said)").replace("WITH r AS", SAID),
)
def _(spark, sf):
    k = F.floor("value") % 5
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("1/2", "\\frac{1}{2}", "0.5", "7", "7.0")]), (k + 1).cast("int"))
    rows = events(spark, sf).withColumn("event_type", spelled)
    return V.weighted_vote(rows, Q, "event_id", "event_type", same=answer_class)


# 'x=7' and '7' agree in one form, '7' and '7 cm' in the other, 'x=7' and '7 cm' in none: the class
# that opens first decides where the middle one goes
LINKED = """WITH said AS (SELECT user_id, event_id, value AS w, ['x=7', '7', '7 cm', '1/2', '0.5'][1 + CAST(floor(value) AS BIGINT) % 5] AS a FROM events),
    f AS (SELECT user_id, a, min(event_id) AS since FROM said GROUP BY 1, 2),
    eq(a, b) AS (VALUES ('x=7', '7'), ('7', 'x=7'), ('7', '7 cm'), ('7 cm', '7'), ('1/2', '0.5'), ('0.5', '1/2'),
      ('x=7', 'x=7'), ('7', '7'), ('7 cm', '7 cm'), ('1/2', '1/2'), ('0.5', '0.5')),
    reps AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g JOIN eq ON eq.b = g.a WHERE eq.a = f.a AND g.user_id = f.user_id AND g.since < f.since
        AND (f.a IN ('1/2', '0.5', '7') OR NOT EXISTS (SELECT 1 FROM f h JOIN eq e ON e.b = h.a WHERE e.a = g.a AND h.user_id = g.user_id AND h.since < g.since)))),
    m AS (SELECT s.*, reps.a AS cls FROM said s JOIN eq ON eq.a = s.a JOIN reps ON reps.user_id = s.user_id AND reps.a = eq.b AND reps.since <= s.event_id),
    """


@query(
    "j7_leader_classes",
    LINKED + VOTE.format(w="CAST(w AS DECIMAL(18, 2))").replace("WITH r", "r", 1).replace("FROM events)", "FROM m)")
    .replace("user_id, event_type ORDER", "user_id, cls ORDER").replace("event_type", "a"),
)
def _(spark, sf):
    texts = F.array(*[F.lit(x) for x in ("x=7", "7", "7 cm", "1/2", "0.5")])
    rows = events(spark, sf).withColumn("a", F.element_at(texts, (F.floor("value") % 5 + 1).cast("int")))
    out = V.weighted_vote(rows, Q, "event_id", "a", F.col("value"), forms=answer_forms())
    return out.withColumn("vote", F.round("vote", 4))


@query(
    "g20_cov_maj_at_n",
    "WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), "
    + ", ".join(
        f"v{n} AS (SELECT user_id, sum(n) AS have, max(CAST(event_type = 'click' AS INT)) AS cov, "
        f"arg_max(CAST(event_type = 'click' AS INT), n * 1000 - f) AS maj FROM (SELECT user_id, event_type, "
        f"count(*) AS n, min(pos) AS f FROM p WHERE pos <= {n} GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) = {n})"
        for n in (2, 4, 8)
    )
    + """ SELECT v2.user_id, v2.cov AS cov_2, v2.maj AS maj_2, v4.cov AS cov_4, v4.maj AS maj_4,
         v8.cov AS cov_8, v8.maj AS maj_8 FROM v2 LEFT JOIN v4 ON v4.user_id = v2.user_id
         LEFT JOIN v8 ON v8.user_id = v2.user_id""",
)
def _(spark, sf):
    rows = events(spark, sf).withColumn("truth", F.lit("click"))
    return V.cov_maj_at_n(rows, Q, "event_id", "event_type", "truth", (2, 4, 8))


# Search trees: a user's events in order fill a binary tree, node 1 is the root.
NODES = """nodes AS (SELECT user_id, i AS id, CASE WHEN i > 1 THEN i // 2 END AS parent_id,
      CAST(floor(log2(i)) AS INT) AS depth, value / 1000 AS score, 2 * i > n AS leaf,
      CAST(floor(value) AS BIGINT) AS num_step_tokens FROM (SELECT user_id, value,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
      count(*) OVER (PARTITION BY user_id) AS n FROM events))"""
PATHS = """paths(user_id, id, depth, leaf, step_scores, cum_tokens) AS (
      SELECT user_id, id, depth, leaf, CAST([] AS DOUBLE[]), num_step_tokens FROM nodes WHERE id = 1
      UNION ALL SELECT c.user_id, c.id, c.depth, c.leaf, list_append(p.step_scores, c.score),
      p.cum_tokens + c.num_step_tokens FROM paths p JOIN nodes c ON c.user_id = p.user_id AND c.parent_id = p.id)"""


def nodes(spark, sf):
    rows = events(spark, sf)
    sizes = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    i = F.col("id")
    placed = numbered(rows, Q, "event_id", "id").join(sizes, "user_id").select(
        "user_id",
        "id",
        F.when(i > 1, F.floor(i / 2)).alias("parent_id"),
        (F.length(F.bin(i)) - 1).alias("depth"),
        (F.col("value") / 1000).alias("score"),
        (2 * i > F.col("n")).alias("leaf"),
        F.floor("value").alias("num_step_tokens"),
    )
    return materialize(placed, "tree")


@query(
    "j8_allocate",
    # one frontier per user and depth; the fold over the best 16 nodes written as recursion
    f"""WITH RECURSIVE {NODES}, f AS (SELECT user_id, depth, id, exp(score) AS w,
          row_number() OVER (PARTITION BY user_id, depth ORDER BY score DESC, id DESC) AS rn,
          sum(exp(score)) OVER (PARTITION BY user_id, depth) AS total FROM nodes),
        t(user_id, depth, rn, id, num, rest, total) AS (
          SELECT user_id, depth, rn, id, CAST(least(16, ceil(16 * w / greatest(total, w) - 1e-9)) AS BIGINT),
            CAST(16 - least(16, ceil(16 * w / greatest(total, w) - 1e-9)) AS BIGINT), total - w FROM f WHERE rn = 1
          UNION ALL SELECT f.user_id, f.depth, f.rn, f.id,
            CAST(least(t.rest, ceil(t.rest * w / greatest(t.total, w) - 1e-9)) AS BIGINT),
            CAST(t.rest - least(t.rest, ceil(t.rest * w / greatest(t.total, w) - 1e-9)) AS BIGINT), t.total - w
          FROM t JOIN f ON f.user_id = t.user_id AND f.depth = t.depth AND f.rn = t.rn + 1 WHERE f.rn <= 16)
        SELECT f.user_id, f.depth, f.id, coalesce(t.num, 0) AS expand FROM f
        LEFT JOIN t ON t.user_id = f.user_id AND t.depth = f.depth AND t.id = f.id""",
)
def _(spark, sf):
    out = trees.allocate(nodes(spark, sf), ["user_id", "depth"], "id", "score", 16)
    return out.select("user_id", "depth", "id", "expand")


@query(
    "j9_frontier",
    f"""WITH RECURSIVE {NODES}, {PATHS}, g AS (SELECT user_id, depth,
          count(*) FILTER (leaf OR cum_tokens >= 400) AS leaving,
          count(*) FILTER (NOT (leaf OR cum_tokens >= 400)) AS "open" FROM paths GROUP BY 1, 2),
        s AS (SELECT *, CAST(16 - sum(leaving) OVER (PARTITION BY user_id ORDER BY depth) AS BIGINT) AS width_left FROM g)
        SELECT *, min(CAST(width_left > 0 AND "open" > 0 AS INT)) OVER (PARTITION BY user_id ORDER BY depth) = 1
          AS goes_on FROM s""",
)
def _(spark, sf):
    paths = trees.path_table(nodes(spark, sf), "user_id", "score", "num_step_tokens")
    return trees.frontier(paths, "user_id", 16, 400, "cum_tokens")


@query(
    "j10_path_scores",
    f"""WITH RECURSIVE {NODES}, {PATHS} SELECT user_id, id,
        array_to_string(list_transform(step_scores, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS path FROM paths WHERE leaf""",
)
def _(spark, sf):
    out = trees.path_scores(nodes(spark, sf), "user_id")
    micro = F.transform("step_scores", lambda x: F.round(x * 1000000).cast("long").cast("string"))
    return out.select("user_id", "id", F.array_join(micro, ",").alias("path"))


@query(
    "j11_token_totals",
    f"""WITH {NODES} SELECT user_id, CAST(sum(num_step_tokens) AS BIGINT) AS total_tokens
        FROM nodes GROUP BY ROLLUP (user_id)""",
)
def _(spark, sf):
    return trees.token_totals(nodes(spark, sf), "user_id", "num_step_tokens")
