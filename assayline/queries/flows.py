"""Whole flows on the given tables."""

from pyspark.sql import functions as F

from assayline.operators import reshape
from assayline.operators import vote as V
from assayline.plans import curation, evaluation
from assayline.queries import query, table, texts
from assayline.queries.cleaning import LANGS, _fold_sql
from assayline.queries.selection import MIXED, diversity_sql

RULES = curation.CurationRules(
    benchmark_sources=("en",),
    contest_part="de",
    diagram_source="en",
    min_length=500,
    sample_size=60,
    uniform_draws=40,
)


def questions(spark, sf):
    docs = texts(spark, sf)
    sources = [
        reshape.to_common(docs.where(F.col("lang") == lang), "text", "source", "prose", lang, "doc_id")
        for lang in LANGS
    ]
    return curation.collect_questions(sources, table(spark, sf, "benchmark"), "text", RULES)


def features(spark, sf):
    """Feature rows of the labelled questions; later duplicates win."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return docs.select(
        F.substring(F.sha2("text", 256), 1, 16).alias("qhash"),
        "doc_id",
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("domain"),
        F.col("n_chars").alias("length"),
        (F.col("quality") == 1).alias("correct"),
        (F.col("toxic") == 1).alias("weak_a"),
        (F.col("doc_id") % 5 == 0).alias("weak_b"),
    )


UNIQUE = f"""u AS (SELECT k.doc_id, k.source_rank, d.text, d.lang FROM ({_fold_sql()}) k JOIN documents d ON d.doc_id = k.doc_id
    QUALIFY row_number() OVER (PARTITION BY d.text ORDER BY k.source_rank, k.doc_id) = 1)"""


@query(
    "flow_collect_questions",
    f"""WITH {UNIQUE} SELECT substr(sha256(text), 1, 16) AS qhash, lang AS source_type, doc_id AS row_idx FROM u""",
)
def _(spark, sf):
    return questions(spark, sf).select("qhash", "source_type", "row_idx")


HARD = f"""{UNIQUE}, g AS (SELECT d.text, d.doc_id, d.source, n_chars, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id
          QUALIFY row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id DESC) = 1),
        h AS (SELECT substr(sha256(u.text), 1, 16) AS qhash, u.text, u.lang, g.source AS domain, n_chars AS length, quality = 1 AS correct
        FROM u JOIN g ON g.text = u.text
        WHERE g.doc_id % 11 <> 0 AND toxic <> 1 AND g.doc_id % 5 <> 0
          AND NOT regexp_matches(u.text, 'p[1-9][0-9]{{0,2}}\\.') AND u.text NOT LIKE '%[asy]%' AND u.text NOT LIKE '%![Image]%'
          AND NOT regexp_matches(u.text, '\\*\\*([^\\s\\]]*\\d[^\\s\\]]*\\*\\*|[^\\s\\]]*\\*\\*[^\\n]*\\d)'))"""


@query("flow_filter_questions", f"WITH {HARD} SELECT qhash, length, correct FROM h")
def _(spark, sf):
    hard = curation.filter_questions(questions(spark, sf), features(spark, sf), "doc_id", RULES)
    return hard.select("qhash", "length", "correct")


DRAWN = diversity_sql(
    "SELECT qhash AS id, domain, length FROM h",
    f"SELECT qhash AS id FROM h WHERE correct AND (lang = 'en' OR (lang LIKE '%de%' AND length > {RULES.min_length}))",
    MIXED.format(
        first="SELECT domain FROM h WHERE lang = 'en'", second="SELECT domain FROM h WHERE lang = 'de'"
    ),
    RULES.sample_size,
    RULES.uniform_draws,
)


@query(
    "flow_training_text",
    f"""WITH RECURSIVE {HARD}, {DRAWN},
        r AS (SELECT text, min(source) AS source, max(lang) AS last_lang, min(lang) AS attempt FROM documents GROUP BY 1)
        SELECT h.qhash, concat('<|im_start|>user{{n}}', h.text, '<|im_end|>{{n}}<|im_start|>assistant{{n}}<|im_start|>think{{n}}', r.source,
          '{{n}}', r.last_lang, '{{n}}<|im_start|>answer{{n}}Answer: ', r.attempt, '<|im_end|>{{n}}') AS text
        FROM h JOIN picked ON picked.id = h.qhash JOIN r ON r.text = h.text""".replace("{n}", "' || chr(10) || '"),
)
def _(spark, sf):
    hard = curation.filter_questions(questions(spark, sf), features(spark, sf), "doc_id", RULES)
    sample = curation.select_sample(hard, "en", "de", RULES)
    answers = table(spark, sf, "documents").select(
        F.substring(F.sha2("text", 256), 1, 16).alias("qhash"), "source", "lang"
    )
    answers = answers.groupBy("qhash").agg(
        F.array(F.min("source"), F.max("lang")).alias("thinking_trajectories"), F.min("lang").alias("attempt")
    )
    return curation.training_text(sample, answers)


SCORED = """s AS (SELECT CAST(user_id % 7 AS VARCHAR) AS task, user_id AS doc_id, filter, metric, value FROM (
    SELECT user_id, 'first' AS filter, event_type AS resp FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
    UNION ALL SELECT user_id, 'maj', event_type FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1) r,
    LATERAL (SELECT unnest(['acc', 'len']) AS metric, unnest([CAST(resp = 'click' AS DOUBLE), CAST(length(resp) AS DOUBLE)]) AS value)),
  m AS (SELECT task, metric, filter, avg(value) AS value, CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END AS stderr,
    count(*) AS samples FROM s GROUP BY 1, 2, 3)"""


@query(
    "flow_evaluate",
    f"""WITH {SCORED}, g AS (SELECT 'all' AS task, metric, filter, sum(value * samples) / sum(samples) AS value,
          CASE WHEN count(stderr) = count(*) THEN sqrt(sum((samples - 1) * stderr * stderr * samples) / (sum(samples) - count(*)) / sum(samples)) END AS stderr,
          CAST(sum(samples) AS BIGINT) AS samples FROM m GROUP BY 2, 3)
        SELECT task, metric, filter, round(value, 6) AS value, round(stderr, 6) AS stderr, samples FROM (SELECT * FROM m UNION ALL SELECT * FROM g)""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 7).cast("string").alias("task"),
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("resp"),
    )
    samples = events.select("task", "doc_id").distinct()
    keys = ["task", "doc_id"]
    chains = {
        "first": [lambda d: V.take_first(d, keys, "idx")],
        "maj": [lambda d: V.majority_vote(d, keys, "idx", "resp")],
    }
    scores = evaluation.score_responses(
        samples, events, chains, {"acc": F.col("resp") == "click", "len": F.length("resp")}
    )
    edges = samples.select(F.lit("all").alias("group"), F.col("task").alias("child")).distinct()
    pairs = scores.select("metric", "filter").distinct()
    config = pairs.withColumns({"group": F.lit("all"), "weight_by_size": F.lit(True)})
    out = evaluation.evaluate(scores, edges, config)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "stderr")})
