"""Every stage on its own input against plain versions of its decision."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from assayline.llm import decontaminate, toxicity
from assayline.llm.common import read
from conftest import SF
from test_decontaminate import brute as plain_hits
from test_lines import brute as plain_lines
from test_simhash import plain_classes, plain_code


def test_stages(spark):
    docs = read(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "decontamination", "mixing"]
    stages = dict(corpus_pipeline.STAGES)

    calm = stages["toxicity"](spark, docs, SF)
    assert calm.columns == docs.columns
    scored = toxicity.score_documents(docs, read(spark, SF, "labels"))
    rejected = {r.doc_id for r in scored.where("predicted = 1").select("row.doc_id").collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in calm.collect()} == ids - rejected

    lined = stages["line_dedup"](spark, calm, SF)
    assert lined.columns == docs.columns
    got = lined.collect()
    want = plain_lines([(r.doc_id, r.text) for r in calm.collect()])
    assert sorted(((r.doc_id, r.text or "") for r in got), key=str) == sorted(
        ((i, t) for i, _, _, t in want), key=str
    )
    assert all(r.n_chars == len(r.text) for r in got)

    single = stages["simhash"](spark, lined, SF)
    assert single.columns == docs.columns
    classes = plain_classes({r.doc_id: plain_code(r.text) for r in got})
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(classes.values()))

    clean = stages["decontamination"](spark, single, SF)
    assert clean.columns == docs.columns
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    whole = {r.doc_id for r in single.collect() if not plain_hits(r.text, items)[1]}
    assert {r.doc_id for r in clean.collect()} == whole

    mixed = stages["mixing"](spark, clean, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(whole)
    assert all(0 <= r.taken <= 3 * r.size for r in mixed)

    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in run) == sorted((r.doc_id, r.taken) for r in mixed)


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string"
    rows = [
        (None, None, None, None, None, "r", "k"), (1, "", "en", "a", 0, "r", "k"),
        (1, "", "en", "a", 0, "r", "k"), (2, "w " * 50_000, "en", None, 100_000, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        out = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns, name
        kept = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert kept.count() == out.count() == (2 if frame is docs else 0)
    assert decontaminate.contamination(F.col("found")).keys() >= {"n_hit", "contaminated"}
