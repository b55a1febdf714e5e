"""Deduplication, filters, quotas, samples and splits."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.fixed_values import (
    BOLD_WITH_DIGIT,
    DIAGRAM_MARKER,
    HARD_DIFFICULTY,
    IMAGE_MARKER,
    LONG_TRACE,
    MAX_SUBDOMAIN_CHARS,
    PICTURE_NUMBER,
    SAMPLE_SIZE,
    UNIFORM_DRAWS,
)
from assayline.operators.scale import (
    broadcast_if_small,
    first_by,
    first_k,
    hash_ranked,
    hash_text,
    numbered,
    ranked,
    running,
)
from assayline.session import materialize


def dedup_first(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row per value of ``col`` in ``order`` (which must be unique).

    Only hashes and order columns are shuffled: rows that lose to an earlier copy
    are found first and then removed by their order columns, so a text with very
    many copies never meets in one task and unique texts do not move when the
    losers fit a broadcast.
    """
    slim = df.select(F.sha2(F.col(col).cast("string"), 256).alias("_h"), *order)
    place = F.struct(*order)
    firsts = (
        slim.groupBy("_h")
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    losers = (
        slim.join(firsts, F.equal_null(slim["_h"], firsts["_h"]))
        .where(place != F.col("_first"))
        .select(*order)
    )
    losers = materialize(losers, "copies")
    return df.join(broadcast_if_small(losers), list(order), "left_anti")


def sample_keep(
    df: DataFrame, n: int, keep: Column, id_cols: Sequence[str], seed: int = 42
) -> DataFrame:
    """Seeded sample of ``n`` rows in all: always-keep rows plus the first
    ``n - kept`` rows of the shuffled input (a kept row may come up twice)."""
    kept = df.where(keep)
    drawn = hash_ranked(df, [], id_cols, seed).where(
        F.col("pos") <= max(n - kept.count(), 0)
    )
    return drawn.drop("pos").unionByName(kept)


def quota_sample(
    df: DataFrame,
    n: int,
    task: str,
    topic: str,
    topic_task: str,
    id_cols: Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """Equal quota per task and, inside ``topic_task``, per topic, in shuffled order.

    A topic pick also uses up one place of ``topic_task``; a row picked both ways
    appears twice (``dedup_first`` removes it later). Stops once ``n`` rows are out.
    Null topics belong to no topic.
    """
    counts = df.agg(
        F.count_distinct(task).alias("tasks"), F.count_distinct(topic).alias("topics")
    ).first()
    per_task = math.ceil(n / max(counts["tasks"], 1))
    per_topic = math.ceil(per_task / max(counts["topics"], 1))

    # only rows within a quota of their own can be picked: as many as the sample asks
    slim = df.select(*id_cols, task, topic)
    by_task = hash_ranked(slim, [task], id_cols, seed, "_task_no", limit=per_task)
    by_topic = hash_ranked(
        slim.where(F.col(topic).isNotNull()), [topic], id_cols, seed, "_topic_no", limit=per_topic
    )
    near = by_task.drop(topic).join(by_topic.drop(topic), [*id_cols, task], "full")
    near = near.withColumns(
        {
            "_by_topic": F.col("_topic_no").isNotNull().cast("long"),
            "_h": hash_text(id_cols, seed),
        }
    )
    near = materialize(near, "quota")

    chunk = [F.substring("_h", 1, 4)]
    within = [F.col("_h"), *[F.col(c) for c in id_cols]]
    out = running(near, [], "", {"_topic_picks": F.col("_by_topic")}, chunk, within)
    used_before = F.col("_task_no") - 1 + F.when(
        F.col(task) == topic_task, F.col("_topic_picks")
    ).otherwise(0)
    by_quota = F.coalesce(used_before < per_task, F.lit(False)).cast("long")
    out = materialize(out.withColumn("_picks", F.col("_by_topic") + by_quota), "picks")
    out = running(out, [], "", {"_out": F.col("_picks")}, chunk, within)
    picked = out.where(F.col("_picks") > 0)
    stop = picked.where(F.col("_out") == n).agg(F.min("_h").alias("h")).first()["h"]
    if stop is not None:
        picked = picked.where(F.col("_h") <= stop)
    copies = F.explode(F.sequence(F.lit(1), F.col("_picks").cast("int")))
    picked = picked.select(*id_cols, copies.alias("_copy")).drop("_copy")
    return df.join(broadcast_if_small(picked), list(id_cols)).select(*df.columns)


def select_hard(
    df: DataFrame,
    n: int | None,
    subdomain: str,
    difficulty: str,
    row_idx: str,
    cut: float = HARD_DIFFICULTY,
) -> DataFrame:
    """Rows above ``cut``, rare subdomains first (ties by first appearance), up to n."""
    named = df.where(
        F.col(subdomain).isNotNull() & (F.length(subdomain) <= MAX_SUBDOMAIN_CHARS)
    )
    sizes = named.groupBy(subdomain).agg(
        F.count(F.lit(1)).alias("subdomain_rows"), F.min(row_idx).alias("_first")
    )
    hard = named.where(F.col(difficulty) > cut).join(sizes, subdomain)
    if n is not None:
        hard = hard.orderBy("subdomain_rows", "_first", row_idx).limit(n)
    return hard.drop("_first")


def drop_incomplete(
    df: DataFrame, feats: DataFrame, key: str, order: str, features: Sequence[str]
) -> DataFrame:
    """Attach features (last duplicate wins) and drop rows with any of them missing."""
    last = first_by(feats, [key], [F.col(order).desc()]).select(key, *features)
    return df.join(last.dropna(subset=list(features)), key, "inner")


def drop_patterns(
    df: DataFrame, question: str, source: str, kept_source: str
) -> DataFrame:
    """Drop questions with picture or odd markup; a diagram question whose source
    contains ``kept_source`` stays whatever else it contains."""
    q = F.col(question)
    odd = (
        q.contains(IMAGE_MARKER) | q.rlike(PICTURE_NUMBER) | q.rlike(BOLD_WITH_DIGIT)
    )
    diagram = q.contains(DIAGRAM_MARKER)
    return df.where(
        (~diagram & ~odd) | (diagram & F.col(source).contains(kept_source))
    )


def keep_hard(df: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """Rows no weak model got right; a missing verdict counts as not right."""
    right = F.lit(False)
    for name in verdicts:
        right = right | F.coalesce(F.col(name), F.lit(False))
    return df.where(~right)


def preselect(
    df: DataFrame,
    correct: str,
    source: str,
    length: str,
    benchmark_sources: Sequence[str],
    contest_part: str,
    min_length: int = LONG_TRACE,
) -> DataFrame:
    """Correct rows of the benchmark sources, and of contest sources when long."""
    whole = F.col(source).isin(list(benchmark_sources))
    long = F.col(source).contains(contest_part) & (F.col(length) > min_length)
    return df.where(F.col(correct) & (whole | long))


def domain_weights(first: DataFrame, second: DataFrame, domain: str) -> DataFrame:
    """Mix two domain histograms: the first scaled (truncating) to half the size of
    the second, added, normalized; domains that end at zero vanish."""
    both = first.select(domain, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(
        second.select(domain, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    counts = both.groupBy(domain).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    everything = Window.partitionBy(F.lit(0))  # one row per domain
    mixed = counts.withColumns(
        {"_sa": F.sum("_a").over(everything), "_sb": F.sum("_b").over(everything)}
    )
    ratio = F.try_divide(F.col("_sb") * 0.5, F.col("_sa"))
    scaled = F.coalesce(F.floor(F.col("_a") * ratio), F.lit(0))
    counted = mixed.select(domain, (scaled + F.col("_b")).alias("n")).where("n > 0")
    return counted.withColumn("weight", F.col("n") / F.sum("n").over(everything))


def length_weights(
    df: DataFrame, domain: str, length: str, id_col: str
) -> DataFrame:
    """Weight 2^-rank inside a domain, longest first (rank 0), summing to one.

    The weights of ranks 0..n-1 add up to 2 - 2^(1-n), so only the row count per
    domain is needed for the normalization.
    """
    mixed = df.withColumn("_h", hash_text([id_col], 0))
    order = [F.col(domain), F.col(length).desc(), F.col("_h"), F.col(id_col)]
    out = ranked(mixed, [domain], order, "_pos")
    sizes = df.groupBy(F.col(domain).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.col("_pos") - 1
    total = F.lit(2.0) - F.pow(F.lit(2.0), 1 - F.col("_n"))
    return (
        out.join(sizes, F.col(domain).eqNullSafe(F.col("_d")))
        .withColumns(
            {"length_rank": rank, "weight": F.pow(F.lit(2.0), -rank) / total}
        )
        .drop("_h", "_pos", "_d", "_n")
    )


def _even(*parts: object) -> float:
    """Number in [0, 1) from the MD5 of the parts, so that a draw can be replayed in SQL."""
    text = "|".join("" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def draw_order(pool: pd.DataFrame, seed: int, want: int) -> pd.DataFrame:
    """Order in which one domain gives out its rows: repeated 2^-rank draws."""
    left = pool.sort_values("length_rank")[["id", "chosen"]].values.tolist()
    domain = pool["domain"].iloc[0]
    domain = None if pd.isna(domain) else domain
    rows, fresh = [], 0
    size = int(pool["_n"].iloc[0])
    while left and fresh < want:
        remaining = size - len(rows)
        span = 1.0 - 2.0**-remaining if remaining < 60 else 1.0
        rank = int(-math.log2(1.0 - _even(seed, domain, len(rows)) * span))
        ident, chosen = left.pop(min(rank, len(left) - 1))
        fresh += not chosen
        rows.append((domain, len(rows), ident, bool(chosen), size))
    return pd.DataFrame(rows, columns=["domain", "draw_no", "id", "chosen", "size"])


def diversity_sample(
    df: DataFrame,
    chosen: DataFrame,
    weights: DataFrame,
    id_col: str,
    domain: str,
    length: str,
    total: int = SAMPLE_SIZE,
    switch: int = UNIFORM_DRAWS,
    seed: int = 42,
) -> DataFrame:
    """Ids selected so far plus draws until ``total``: domain uniform while fewer than
    ``switch`` are selected, then by ``weights``; inside the domain long traces first.

    Each domain's draw order is made on Spark from its longest rows only, found by a cut
    per domain before any row is sorted. A draw
    reaches at most 53 ranks past the rows already drawn (a double holds no smaller
    probability), so ``2 * total + 54`` ranks hold every possible draw. The driver
    sees the flags of those draws and picks domains, never the rows. Numbers come from
    hashes of seed, domain and draw. A null domain is a domain of its own.
    """
    spark = df.sparkSession
    marked = df.select(
        F.col(id_col).alias("id"),
        F.col(domain).cast("string").alias("domain"),
        F.col(length).alias("length"),
    ).join(
        chosen.select(F.col(id_col).alias("id")).distinct().withColumn("_c", F.lit(1)),
        "id",
        "left",
    )
    marked = marked.withColumn("chosen", F.col("_c").isNotNull()).drop("_c")
    picked = chosen.select(F.col(id_col).alias("id")).distinct()
    count = picked.count()
    reach = 2 * total + 54
    mixed = marked.withColumn("_h", hash_text(["id"], seed))
    order = [F.col("length").desc(), F.col("_h"), F.col("id")]
    by_length = F.coalesce(-F.col("length"), F.lit(float("inf")))
    pools = first_k(mixed, ["domain"], order, reach, "_pos", by_length)
    sizes = marked.groupBy(F.col("domain").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    pools = pools.join(sizes, F.col("domain").eqNullSafe(F.col("_d")))
    pools = pools.withColumn("length_rank", F.col("_pos") - 1)
    id_type = dict(marked.dtypes)["id"]
    orders = materialize(
        pools.select("id", "domain", "chosen", "length_rank", "_n")
        .groupBy("domain")
        .applyInPandas(
            lambda pool: draw_order(pool, seed, total),
            f"domain string, draw_no long, id {id_type}, chosen boolean, size long",
        ),
        "draws",
    )
    flags = {
        r["domain"]: (r["flags"], r["size"])
        for r in orders.groupBy("domain")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("draw_no", "chosen"))),
                lambda x: x["chosen"],
            ).alias("flags"),
            F.first("size").alias("size"),
        )
        .collect()
    }
    taken = _walk_domains(flags, weights, domain, count, total, switch, seed)
    limits = spark.createDataFrame(
        [(d, k) for d, k in taken.items() if k], "_d string, _k long"
    )
    same = F.col("domain").eqNullSafe(F.col("_d"))
    drawn = orders.join(F.broadcast(limits), same).where("draw_no < _k")
    return drawn.select("id").union(picked).distinct().withColumnRenamed("id", id_col)


def _walk_domains(
    flags: Mapping[str, tuple[list[bool], int]],
    weights: DataFrame,
    domain: str,
    count: int,
    total: int,
    switch: int,
    seed: int,
) -> dict[str, int]:
    """Number of draws per domain until ``total`` rows are selected."""
    rows = weights.select(F.col(domain).cast("string"), "weight").collect()
    odds = {d: w for d, w in map(tuple, rows) if d in flags and w > 0}
    open_all = sorted(flags, key=lambda d: (d is not None, d))
    taken, step = dict.fromkeys(flags, 0), 0
    while count < total and open_all:
        mix = [odds.get(d, 0.0) for d in open_all]
        if count < switch or not any(mix):
            mix = [1.0] * len(open_all)
        upto = list(itertools.accumulate(mix))
        at = bisect.bisect_right(upto, _even(seed, step) * upto[-1])
        name = open_all[at]
        seen, size = flags[name]
        count += not seen[taken[name]]
        taken[name] += 1
        step += 1
        if taken[name] >= size:
            open_all.remove(name)
    return taken


def split_eval(
    df: DataFrame,
    n_eval: int,
    id_cols: Sequence[str],
    seed: int = 42,
    max_train: int | None = None,
    max_eval: int | None = None,
) -> DataFrame:
    """Seeded split of exact size; ``split`` is eval or train, caps on both sides."""
    out = hash_ranked(df, [], id_cols, seed, "_pos")
    is_eval = F.col("_pos") <= n_eval
    keep = F.lit(True)
    if max_eval is not None:
        keep = keep & (~is_eval | (F.col("_pos") <= max_eval))
    if max_train is not None:
        keep = keep & (is_eval | (F.col("_pos") <= n_eval + max_train))
    return out.where(keep).withColumn(
        "split", F.when(is_eval, "eval").otherwise("train")
    ).drop("_pos")


TOP_ROWS = 10_000


def limit_docs(
    df: DataFrame,
    limit: float | None,
    row_idx: str,
    shuffle_by: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Evaluation limit: below one a share (rounded up), else a row count."""
    if limit is None:
        return df
    n = math.ceil(df.count() * limit) if limit < 1 else int(limit)
    if n <= TOP_ROWS:  # the same rows without numbering the table
        if shuffle_by:
            order = [hash_text(shuffle_by, seed), *[F.col(c) for c in shuffle_by]]
        else:
            order = [F.col(row_idx)]
        return df.orderBy(*order).limit(n)
    if shuffle_by:
        out = hash_ranked(df, [], shuffle_by, seed, "_pos")
    else:
        out = numbered(df, [], row_idx, "_pos")
    return out.where(F.col("_pos") <= n).drop("_pos")


def shard(df: DataFrame, i: int, n: int, row_idx: str) -> DataFrame:
    """Strided shard: positions i, i + n, ... of a dense 0-based ``row_idx``."""
    return df.where(F.pmod(F.col(row_idx), F.lit(n)) == i)


def chunk(df: DataFrame, size: int, row_idx: str) -> DataFrame:
    """Number of the fixed-size input shard of each row."""
    return df.withColumn("chunk_no", F.floor(F.col(row_idx) / size))


def write_chunks(df: DataFrame, size: int, row_idx: str, path: str) -> None:
    """One folder per shard, as JSON lines."""
    chunk(df, size, row_idx).write.partitionBy("chunk_no").json(path)


def _random_positions(
    ids: Sequence[str], count: int, pool_size: int, seed: int
) -> Column:
    """``count`` different positions below ``pool_size``, seeded per row."""
    first = pool_size - count

    def number(place: Column, use: str) -> Column:
        parts = [*[F.col(c).cast("string") for c in ids], place.cast("string")]
        text = F.md5(F.concat_ws("|", *parts, F.lit(f"{use}{seed}")))
        return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")

    draw = lambda j: F.pmod(number(j, "draw"), j + 1)
    chosen = F.aggregate(
        F.sequence(F.lit(first), F.lit(pool_size - 1)),
        F.array().cast("array<bigint>"),
        lambda acc, j: F.array_append(
            acc,
            F.when(F.array_contains(acc, draw(j)), j.cast("bigint")).otherwise(draw(j)),
        ),
    )
    by_hash = F.transform(
        chosen,
        lambda p: F.struct(
            number(p, "order").alias("h"),
            p.alias("p"),
        ),
    )
    return F.transform(F.array_sort(by_hash), lambda x: x["p"])


def fewshot_pairs(
    df: DataFrame,
    pool: DataFrame,
    k: int,
    id_col: str,
    row_idx: str,
    mode: str = "random",
    seed: int = 1234,
) -> DataFrame:
    """Rows ``(id, shot, example)`` of k examples per document, never itself.

    ``first``: the first k of the pool; ``random``: k different positions drawn per
    document and looked up by position, so no document meets the whole pool.
    """
    size = pool.count()
    want = min(k + 1, size)
    fields = [F.col(c).alias(c) for c in pool.columns]
    lookup = (
        numbered(pool, [], row_idx, "_p")
        .withColumn("_p", F.col("_p") - 1)
        .select("_p", F.struct(*fields).alias("example"))
    )
    if mode == "first":
        places = F.sequence(F.lit(0).cast("long"), F.lit(want - 1).cast("long"))
        lookup = lookup.where(F.col("_p") < want)
    else:
        places = _random_positions([id_col], want, size, seed)
    wanted = df.select(id_col, F.posexplode(places).alias("_slot", "_p"))
    found = wanted.join(broadcast_if_small(lookup), "_p").where(
        F.col(f"example.{id_col}") != F.col(id_col)
    )
    nth = Window.partitionBy(id_col).orderBy("_slot")  # at most k + 1 rows per id
    return (
        found.withColumn("shot", F.row_number().over(nth))
        .where(F.col("shot") <= k)
        .select(id_col, "shot", "example")
    )


def fewshot(
    df: DataFrame,
    pool: DataFrame,
    k: int,
    id_col: str,
    row_idx: str,
    question: str,
    answer: str,
    mode: str = "random",
    seed: int = 1234,
    chat: bool = False,
    between: str = " ",
    delimiter: str = "\n\n",
) -> DataFrame:
    """Few-shot context per document, as labelled text or as chat turns."""
    pairs = fewshot_pairs(df, pool, k, id_col, row_idx, mode, seed)
    shots = pairs.groupBy(id_col).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "shot",
                        F.col(f"example.{question}").alias("q"),
                        F.col(f"example.{answer}").alias("a"),
                    )
                )
            ),
            lambda s: F.struct(s["q"].alias("q"), s["a"].alias("a")),
        ).alias("_shots")
    )
    if chat:
        turns = F.flatten(
            F.transform(
                "_shots",
                lambda s: F.array(
                    F.struct(F.lit("user").alias("role"), s["q"].alias("content")),
                    F.struct(F.lit("assistant").alias("role"), s["a"].alias("content")),
                ),
            )
        )
        return df.join(shots, id_col, "left").select(*df.columns, turns.alias("context"))
    labelled = F.transform(
        "_shots",
        lambda s: F.when(s["a"] == "", s["q"]).otherwise(
            F.concat(s["q"], F.lit(between), s["a"], F.lit(delimiter))
        ),
    )
    text = F.array_join(labelled, "")
    joined = df.join(shots, id_col, "left")
    return joined.select(*df.columns, F.coalesce(text, F.lit("")).alias("context"))
