"""Sources, sinks, sets, reports, registries and incremental intake."""

from pyspark.sql import functions as F

from assayline.operators import registry as R
from assayline.operators import report, selection, sets
from assayline.queries import query, table
from assayline.session import scratch_path
from assayline.sources import readers, writers
from assayline.streaming import intake as I


@query("a1_read_qa", "SELECT source AS question, CAST(n_chars AS VARCHAR) AS answer FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "qa") + ".jsonl"
    table(spark, sf, "documents").select("source", "n_chars", "lang").write.json(path)
    return readers.read_qa(spark, path, "source", "n_chars")


@query("a2_read_split", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(spark, sf):
    out = readers.read_split(spark, f"{sf}/documents.parquet", spread=True)
    return out.select("doc_id", "lang", "source", "n_chars")


@query(
    "a2_dedup_from_files",
    # two sources of several sorted files each; the first of equal texts stays
    """WITH p AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_rank,
          row_number() OVER (PARTITION BY lang = 'en' ORDER BY doc_id) - 1 AS row_idx FROM documents)
       SELECT source_rank, row_idx, doc_id FROM p
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY source_rank, row_idx) = 1""",
)
def _(spark, sf):
    base, docs = scratch_path(spark, "ordered"), table(spark, sf, "documents").select("doc_id", "text", "lang")
    paths = [f"{base}/en", f"{base}/other"]
    for path, rows in zip(paths, (docs.where("lang = 'en'"), docs.where("lang <> 'en' OR lang IS NULL"))):
        rows.drop("lang").repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    rows = readers.read_ordered(spark, paths)
    out = selection.dedup_first(rows, "text", ["source_rank", "row_idx"])
    return out.select("source_rank", "row_idx", "doc_id")


@query("a3_read_subject_csv", "SELECT source AS subject, text AS question, lang AS answer FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    docs = table(spark, sf, "documents").select(F.col("source").alias("subject"), "text", "lang")
    docs.write.partitionBy("subject").option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_subject_csv(spark, path, ["question", "answer"])


@query(
    "a4_read_corpus",
    """SELECT CASE WHEN lang = 'en' THEN text || chr(10) || chr(10) || source ELSE text END AS text,
       CASE WHEN lang IN ('de', 'fr') THEN '{}' ELSE source END AS meta FROM documents""",
)
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    docs = table(spark, sf, "documents")
    texts = F.when(F.col("lang") == "en", F.array("text", "source"))
    line = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(texts.alias("text"), F.col("source").alias("meta"))))
        .when(F.col("lang") == "es", F.to_json(F.struct("text", F.col("source").alias("meta"))))
        .when(F.col("lang") == "fr", F.to_json(F.struct("text")))
        .otherwise(F.substring(F.to_json(F.struct("text")), F.lit(9), F.length(F.to_json(F.struct("text"))) - 9))
    )
    docs.select(line.alias("value")).write.text(path)
    return readers.read_corpus(spark, path).select("text", "meta")


def nation_files(spark, sf):
    """A folder of results: one JSON file per nation, however many suppliers it has."""
    path = scratch_path(spark, "keyed")
    rows = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("suppliers"), F.max("s_acctbal").alias("best")
    )
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return path


NATION = "s_nationkey long, suppliers long, best double"
NATION_SQL = "s_nationkey, count(*) AS suppliers, max(s_acctbal) AS best"


@query(
    "a5_read_keyed_json",
    # the file stem as key tells the results apart
    f"SELECT {NATION_SQL}, 1 AS results, true AS stem FROM supplier GROUP BY 1",
)
def _(spark, sf):
    out = readers.read_keyed_json(spark, nation_files(spark, sf), NATION)
    stem = ~F.contains("key", F.lit("/")) & ~F.endswith("key", F.lit(".json"))
    columns = [F.max(c).alias(c) for c in ("s_nationkey", "suppliers", "best")]
    per_key = out.groupBy("key").agg(*columns, F.count(F.lit(1)).alias("results"))
    return per_key.withColumn("stem", stem).drop("key")


@query("a6_combine_json", f"SELECT {NATION_SQL} FROM supplier GROUP BY 1")
def _(spark, sf):
    return readers.combine_json(spark, nation_files(spark, sf), NATION)


@query("a7_merge_shards", 'SELECT lang AS task, doc_id AS "index", source FROM documents')
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("lang").alias("task"), F.col("doc_id").alias("index"), "source"
    )
    base, paths = scratch_path(spark, "shards"), []
    for i, lang in enumerate(["de", "en", "es", "fr"]):
        paths.append(f"{base}/shard{i}")
        docs.where(F.col("task") == lang).write.json(paths[-1])
    return readers.merge_shards(
        spark, [*paths, f"{base}/shard9"], "task string, index long, source string"
    )


@query(
    "a8_latest_results",
    """SELECT event_type AS model, max(strftime(ts, '%Y-%m-%dT%H-%M-%S')) AS stamp,
       'results_' || max(strftime(ts, '%Y-%m-%dT%H-%M-%S')) || '.json' AS file FROM events GROUP BY 1""",
)
def _(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss")
    files = table(spark, sf, "events").select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("results_"), stamp, F.lit(".json")).alias("file"),
    )
    return readers.latest_results(files, "model", "file")


@query(
    "a9_write_results",
    """SELECT source, count(*) AS n, count(*) AS samples, min(doc_id) AS first, max(doc_id) AS last,
       CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "results")
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    writers.write_results(docs, docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), path)
    samples = spark.read.schema("doc_id long, source string, text string").json(f"{path}/samples")
    back = samples.groupBy("source").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("doc_id").alias("first"),
        F.max("doc_id").alias("last"),
        F.sum(F.length("text")).alias("characters"),
    )
    return spark.read.schema("source string, n long").json(f"{path}/summary").join(back, "source")


@query("a10_write_dataset", "SELECT doc_id, lang, text FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "dataset")
    writers.write_dataset(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.parquet(path)


# --- sets -------------------------------------------------------------------------


@query(
    "k1_union_sources",
    """SELECT doc_id AS id, text, 0 AS source_rank FROM documents
       UNION ALL SELECT item_id, text, 1 FROM benchmark
       UNION ALL SELECT conv_id, text, 2 FROM conversations""",
)
def _(spark, sf):
    parts = [("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")]
    dfs = [table(spark, sf, t).select(F.col(c).alias("id"), "text") for t, c in parts]
    return sets.union_sources(dfs)


@query("k2_minus", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    out = sets.minus(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return out.select("doc_id")


@query(
    "k3_common_tasks",
    """SELECT l_partkey AS task FROM lineitem GROUP BY 1
       HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("task"), "l_returnflag")
    return sets.common_tasks(rows, "task", "l_returnflag")


@query(
    "k4_sort_top",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sets.sort_top(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 50)


@query(
    "k5_match_names",
    "SELECT DISTINCT p_name FROM part WHERE p_name GLOB '*widget' OR p_name GLOB '[sS]*b?lt'",
)
def _(spark, sf):
    return sets.match_names(table(spark, sf, "part"), "p_name", ["*widget", "[sS]*b?lt"])


@query(
    "k6_head_rows",
    """SELECT doc_id, source FROM documents
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sets.head_rows(docs, ["source"], "doc_id", 3)


# --- reports ----------------------------------------------------------------------

METRIC_ROWS = """m AS (SELECT event_type AS task, metric, 'none' AS filter, 1 AS version, 0 AS shots,
      metric = 'acc' AS up, avg(v) AS value, stddev_samp(v) / sqrt(count(*)) AS stderr
      FROM (SELECT event_type, 'acc' AS metric, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS v FROM events
        UNION ALL SELECT event_type, 'cost', value FROM events) GROUP BY 1, 2)"""


def metric_rows(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("task"),
        F.inline(
            F.array(
                F.struct(F.lit("acc").alias("metric"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("v")),
                F.struct(F.lit("cost").alias("metric"), F.col("value").alias("v")),
            )
        ),
    )
    return rows.groupBy("task", "metric").agg(
        F.avg("v").alias("value"), (F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("stderr")
    )


@query(
    "j12_report_table",
    f"""WITH {METRIC_ROWS} SELECT task AS block, row_number() OVER w AS line,
        CASE WHEN row_number() OVER w = 1 THEN task ELSE '' END AS Tasks,
        CASE WHEN row_number() OVER w = 1 THEN CAST(version AS VARCHAR) ELSE '' END AS "Version",
        filter AS "Filter", CAST(shots AS VARCHAR) AS "n-shot", metric AS "Metric",
        CASE WHEN up THEN '↑' ELSE '↓' END AS direction, format('{{:.4f}}', value) AS "Value",
        '±' AS "±", format('{{:.4f}}', stderr) AS "Stderr" FROM m WINDOW w AS (PARTITION BY task ORDER BY metric, filter)""",
)
def _(spark, sf):
    rows = metric_rows(spark, sf).withColumns(
        {
            "version": F.lit(1),
            "filter": F.lit("none"),
            "shots": F.lit(0),
            "higher_is_better": F.col("metric") == "acc",
        }
    )
    return report.report_table(rows)


@query(
    "j12_split_metrics",
    f"""WITH {METRIC_ROWS} SELECT task, metric, filter, round(value, 6) AS value, round(stderr, 6) AS stderr FROM m""",
)
def _(spark, sf):
    key = F.concat("metric", F.lit(",none"))
    error = F.concat("metric", F.lit("_stderr,none"))
    entry = lambda k, v: F.struct(k.alias("key"), F.col(v).alias("value"))
    both = F.array(entry(key, "value"), entry(error, "stderr"))
    maps = metric_rows(spark, sf).groupBy("task").agg(
        F.map_from_entries(F.flatten(F.collect_list(both))).alias("metrics")
    )
    out = report.split_metrics(maps, "task", "metrics")
    return out.withColumns({c: F.round(c, 6) for c in ["value", "stderr"]})


@query(
    "j13_sample_report",
    """SELECT vec_id AS id, 'item ' || CAST(vec_id AS VARCHAR) AS data, length('item ' || CAST(vec_id AS VARCHAR)) AS input_len,
       CASE WHEN vec_id % 3 = 0 THEN 'multiple_choice' WHEN vec_id % 3 = 1 THEN 'generate_until' ELSE 'loglikelihood' END AS output_type,
       CASE WHEN vec_id % 3 = 0 THEN chr(65 + CAST(label AS INT) % 4) ELSE CAST(label % 4 AS VARCHAR) END AS label,
       CASE WHEN vec_id % 3 = 0 THEN 'A' || chr(10) || 'B' || chr(10) || 'C' || chr(10) || 'D' END AS choices,
       CASE WHEN vec_id % 3 = 0 THEN chr(64 + CAST(list_position(embedding[1:4], list_max(embedding[1:4])) AS INT))
         WHEN vec_id % 3 = 1 THEN 'resp ' || CAST(label AS VARCHAR) ELSE replace(printf('%.4f', CAST(embedding[1] AS DOUBLE)), '-0.0000', '0.0000') END AS raw_prediction,
       CASE WHEN vec_id % 3 = 1 THEN CAST(label AS VARCHAR) WHEN vec_id % 3 = 0 THEN array_to_string(
         list_transform(embedding[1:4], lambda x: replace(printf('%.4f', CAST(x AS DOUBLE)), '-0.0000', '0.0000')), ',') END AS filtered_prediction,
       label % 2 AS acc FROM embeddings""",
)
def _(spark, sf):
    kind = F.pmod("vec_id", F.lit(3))
    rows = table(spark, sf, "embeddings").select(
        F.when(kind == 0, "multiple_choice").when(kind == 1, "generate_until").otherwise("loglikelihood").alias("output_type"),
        F.col("vec_id").alias("doc_id"),
        F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("prompt"),
        (F.col("label") % 4).cast("string").alias("target"),
        F.array(*[F.lit(x) for x in "ABCD"]).alias("choices"),
        F.slice("embedding", 1, 4).alias("lls"),
        F.concat(F.lit("resp "), F.col("label").cast("string")).alias("resp"),
        F.col("label").cast("string").alias("filtered_resp"),
        (F.col("label") % 2).alias("acc"),
    )
    out = report.sample_report(rows, ["acc"])
    # likelihoods are compared with four decimals, since their texts end differently
    kind = F.col("output_type")

    def four(text):
        return F.replace(F.format_string("%.4f", text.cast("double")), F.lit("-0.0000"), F.lit("0.0000"))

    listed = F.array_join(F.transform(F.split("filtered_prediction", ","), four), ",")
    raw = F.when(kind == "loglikelihood", four(F.col("raw_prediction"))).otherwise(F.col("raw_prediction"))
    filtered = F.when(kind == "multiple_choice", listed).otherwise(F.col("filtered_prediction"))
    return out.withColumns({"raw_prediction": raw, "filtered_prediction": filtered})


@query(
    "j14_task_overview",
    """WITH s AS (SELECT source AS task, CASE WHEN lang IN ('en', 'de') THEN 'train' WHEN lang = 'fr' THEN 'validation'
          ELSE 'test' END AS split FROM documents)
       SELECT task, CASE WHEN bool_or(split = 'train') THEN '✓' ELSE ' ' END AS train,
         CASE WHEN bool_or(split = 'validation') THEN '✓' ELSE ' ' END AS validation,
         CASE WHEN bool_or(split = 'test') THEN '✓' ELSE ' ' END AS test,
         CASE WHEN count(*) FILTER (split = 'test') > 0 THEN count(*) FILTER (split = 'test')
           ELSE count(*) FILTER (split = 'validation') END AS docs, any_value(m) AS metrics
       FROM s JOIN (SELECT source AS t, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS m FROM documents GROUP BY 1)
         ON t = task GROUP BY task""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    split = F.when(F.col("lang").isin("en", "de"), "train").when(F.col("lang") == "fr", "validation").otherwise("test")
    rows = docs.select(F.col("source").alias("task"), split.alias("split"))
    metrics = docs.select(F.col("source").alias("task"), F.col("lang").alias("metric"))
    return report.task_overview(rows, "task", "split", metrics)


# --- extension points and intake ----------------------------------------------------


@query(
    "n1_metric_registry",
    """SELECT event_type, round(avg(CAST(value > 50 AS INT)), 6) AS over_fifty,
       round(exp(-avg(-value / 100)), 6) AS spread FROM events GROUP BY 1""",
)
def _(spark, sf):
    if "over_fifty" not in R.METRICS:
        R.register_metric("over_fifty")(lambda v: (v > 50).cast("int"))
        R.register_metric("spread", False, "loglikelihood", "perplexity")(lambda v: -v / 100)
    value = F.col("value")
    out = R.evaluate_metrics(
        table(spark, sf, "events"), ["event_type"], {"over_fifty": [value], "spread": [value]}
    )
    return out.withColumns({c: F.round(c, 6) for c in ["over_fifty", "spread"]})


@query(
    "n1_metric_errors",
    """SELECT event_type, round(avg(CAST(value > 20 AS INT)), 6) AS over_twenty,
       round(stddev_samp(CAST(value > 20 AS INT)) / sqrt(count(*)), 6) AS over_twenty_stderr,
       round(median(value), 6) AS middle, CAST(NULL AS DOUBLE) AS middle_stderr FROM events GROUP BY 1""",
)
def _(spark, sf):
    if "over_twenty" not in R.METRICS:
        R.register_metric("over_twenty")(lambda v: (v > 20).cast("int"))
        R.register_metric("middle", aggregation="median")(lambda v: v)
    value = F.col("value")
    scores = {"over_twenty": [value], "middle": [value]}
    out = R.evaluate_metrics(table(spark, sf, "events"), ["event_type"], scores, errors=True)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "event_type"})


@query(
    "n2_aggregation_registry",
    "SELECT l_returnflag, round(max(l_tax), 6) AS largest FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    if "largest" not in R.AGGREGATIONS:
        R.register_aggregation("largest")(F.max)
        R.register_metric("largest", aggregation="largest")(lambda v: F.round(v, 6))
    return R.evaluate_metrics(
        table(spark, sf, "lineitem"), ["l_returnflag"], {"largest": [F.col("l_tax")]}
    )


@query(
    "n3_filter_registry",
    "SELECT user_id, upper(event_type) AS event_type, value FROM events",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "value")
    return R.FILTERS["uppercase"](rows, ["user_id"], "event_id", "event_type")


@query(
    "n4_task_hooks",
    """SELECT d.doc_id, 'Q: ' || source || chr(10) || 'A:' AS prompt, lang AS target,
       CAST(quality = 1 AS INT) AS acc FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 0""",
)
def _(spark, sf):
    hooks = R.TaskHooks(
        "sources",
        doc_to_text=lambda df: F.concat(F.lit("Q: "), "source", F.lit("\nA:")),
        doc_to_target=lambda df: F.col("lang"),
        filters=[lambda df: df.where("toxic = 0")],
        process_results=lambda df: df.withColumn("acc", (F.col("quality") == 1).cast("int")),
    )
    out = hooks.results(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return out.select("doc_id", "prompt", "target", "acc")


@query("m1_new_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    out = I.new_rows(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return out.select("doc_id")


@query("m1_stream_intake", "SELECT DISTINCT text FROM documents")
def _(spark, sf):
    schema = table(spark, sf, "documents").schema
    # a pattern, so that a single file and a folder of part files are both streamed
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents[.]parquet")
    out, mark = scratch_path(spark, "intake"), scratch_path(spark, "intake-checkpoint")
    I.intake(stream, out, ["text"], mark).awaitTermination()
    return spark.read.parquet(out).select("text")
