"""Schema mapping, row filters, prompt and training-text rendering, reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.functions.rewrite import apply_rules, detokenize, render, trim_space
from assayline.functions.text import word_count
from assayline.operators.scale import first_by, hash_text, numbered

LETTERS = V.UPPERCASE


def letter_at(i: Column) -> Column:
    """Capital letter for a 0-based position."""
    return F.char(i + 65)


# --- common schema and filters -------------------------------------------------


def to_common(
    df: DataFrame,
    question: str,
    solution: str | None,
    cot_type: str | Column,
    source: str | Column,
    row_idx: str,
) -> DataFrame:
    """Five-column schema plus the load position; other fields become ``metadata``."""
    rest = [c for c in df.columns if c not in (question, solution)]
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        F.col(question).cast("string").alias("question"),
        (F.col(solution) if solution else F.lit(None)).cast("string").alias("solution"),
        as_col(cot_type).alias("cot_type"),
        as_col(source).alias("source_type"),
        F.to_json(F.struct(*rest)).alias("metadata"),
        F.col(row_idx).cast("long").alias("row_idx"),
    )


def filter_source(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    null: Sequence[str] = (),
    not_null: Sequence[str] = (),
) -> DataFrame:
    """Row filters of a source: equal values, columns that must (not) be null."""
    cond = F.lit(True)
    for name, value in (equals or {}).items():
        cond = cond & (F.col(name) == value)
    for name in null:
        cond = cond & F.col(name).isNull()
    for name in not_null:
        cond = cond & F.col(name).isNotNull()
    return df.where(cond)


def map_category(col: Column, mapping: Mapping[str, str], default: str | None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def clean_question(
    col: Column, cut_at: str, phrases: Sequence[tuple[str, str]]
) -> Column:
    """Text before the first ``cut_at`` with phrases replaced in order."""
    head = F.substring_index(col, cut_at, 1)
    return apply_rules(head, [("text", a, b) for a, b in phrases])


def assemble_mcq(
    df: DataFrame,
    applies: Column,
    question: str,
    solution: str,
    wrong: Sequence[str],
    right: str,
    key: str,
    seed: int = 42,
) -> DataFrame:
    """Shuffle the options by a seeded hash, render the block and name the letter of
    the right one; rows outside ``applies`` stay as they are."""
    strip = lambda c: F.regexp_replace(F.col(c), r"^\n+|\n+$", "")
    options = F.array(
        *[
            F.struct(hash_text_at(key, seed, i).alias("h"), strip(c).alias("text"))
            for i, c in enumerate([*wrong, right])
        ]
    )
    mixed = df.withColumn("_opts", F.transform(F.array_sort(options), lambda x: x["text"]))
    opts = F.col("_opts")
    block = render(
        V.CHOICE_BLOCK,
        {"question": F.col(question), **{n: F.get(opts, F.lit(i)) for i, n in enumerate("abcd")}},
    )
    place = F.array_position(opts, strip(right)) - 1
    answer = F.concat(
        F.col(solution), F.lit("\n\nAnswer: "), letter_at(place)
    )
    return mixed.withColumns(
        {
            question: F.when(applies, block).otherwise(F.col(question)),
            solution: F.when(applies, answer).otherwise(F.col(solution)),
        }
    ).drop("_opts")


def hash_text_at(key: str, seed: int, place: int) -> Column:
    parts = [F.col(key).cast("string"), F.lit(str(place)), F.lit(str(seed))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def contest_rows(
    df: DataFrame, ident: str, question: str, solution: str, source: str, row_idx: str, last_year: int = 2022
) -> DataFrame:
    """Contest rows up to ``last_year`` (id starts with the year) in common form."""
    year = F.split(F.col(ident), "-")[0].cast("int")
    return to_common(df.where(year <= last_year), question, solution, "math", source, row_idx)


def first_present(df: DataFrame, cols: Sequence[str]) -> Column:
    """First non-null of those legacy columns that exist."""
    return F.coalesce(*[F.col(c) for c in cols if c in df.columns], F.lit(None))


def valid_choice_rows(df: DataFrame, answer: str, candidates: str) -> DataFrame:
    """Answer in 0..3 and not all options empty."""
    blank = F.forall(F.col(candidates), lambda c: c == "")
    return df.where(F.col(answer).isin(0, 1, 2, 3) & ~blank)


def nonempty_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(
        F.col(a).isNotNull() & (F.col(a) != "") & F.col(b).isNotNull() & (F.col(b) != "")
    )


def with_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(F.col(col).startswith(prefix))


def prune_long(df: DataFrame, limit: int, count: Column) -> DataFrame:
    """Rows with at most ``limit`` tokens; the caller supplies the count column."""
    return df.where(count <= limit)


def merge_duplicates(
    df: DataFrame, key: str, order: str, output: str
) -> tuple[DataFrame, DataFrame]:
    """First row per id, and all outputs of every id in input order as long rows
    ``(key, output_no, output)``, so an id with very many outputs stays spread."""
    firsts = first_by(df, [key], [F.col(order)]).drop(output)
    outputs = numbered(df.select(key, order, output), [key], order, "output_no")
    return firsts, outputs.select(key, "output_no", output)


# --- rendering -----------------------------------------------------------------


def render_sft(question: Column, trace: Column, attempt: Column) -> Column:
    """Chat text with think and answer sections."""
    marked = F.when(attempt.contains("Answer:"), attempt).otherwise(
        F.concat(F.lit(V.ANSWER_PREFIX), attempt)
    )
    return F.concat(
        F.lit(V.USER_TURN),
        question,
        F.lit(V.TURN_END + V.ASSISTANT_TURN + V.THINK_TURN),
        trim_space(F.array_join(trace, "\n")),
        F.lit(V.ANSWER_TURN),
        trim_space(marked),
        F.lit(V.TURN_END),
    )


def render_prm(df: DataFrame, fmt: str) -> DataFrame:
    """Step-reward examples: ``input``, ``output``, ``label`` in one of six formats.

    v1..v3 read input, output_prefix, output, label; v4 joins lists of outputs and
    labels; ``scores`` takes the scores as label; ``program`` reads prompt, solution.
    """
    c = F.col
    if fmt in ("v1", "v2", "v3"):
        head, fresh, lead, rest = V.STEP_REWARD_PARTS[fmt]
        start = c("output_prefix") == ""
        return df.withColumns(
            {
                "input": F.when(start, F.concat(F.lit(head), c("input"), F.lit(fresh))).otherwise(
                    F.concat(F.lit(head), c("input"), F.lit(rest), c("output_prefix"))
                ),
                "output": F.when(start, F.concat(F.lit(lead), c("output"))).otherwise(c("output")),
            }
        )
    if fmt == "v4":
        last = F.size("output") - 1
        pieces = F.transform("output", lambda s, i: F.when(i < last, F.concat(s, F.lit("\n\n"))).otherwise(s))
        prefix = F.coalesce(c("output_prefix"), F.lit("")) if "output_prefix" in df.columns else F.lit("")
        return df.withColumns(
            {
                "input": F.concat(F.lit(V.QUESTION_HEAD), c("input"), F.lit(V.SOLUTION_HEAD + "\n\n"), prefix),
                "output": F.array_join(pieces, V.LIST_SPLITTER),
                "label": F.array_join(F.transform("label", lambda x: x.cast("string")), V.LIST_SPLITTER),
            }
        )
    if fmt == "scores":
        return df.withColumn("label", c("scores"))
    if fmt == "program":
        return df.withColumns({"input": c("prompt"), "output": c("solution")})
    raise ValueError(f"unknown step-reward format: {fmt}")


def render_instruct(
    df: DataFrame, fmt: str, meta_prompts: Sequence[str] = ()
) -> DataFrame:
    """Instruction pairs ``input``/``output`` in one of seven formats.

    plain (instruction, input), meta (adds a meta prompt chosen by example_id),
    steps and steps_headed (input, output_prefix, output), solution (query, output),
    bare (query, output), program (question, starter_code, solutions).
    """
    c = F.col
    if fmt in ("plain", "meta"):
        with_input = V.INSTRUCT_WITH_INPUT if fmt == "plain" else V.META_WITH_INPUT
        no_input = V.INSTRUCT_NO_INPUT if fmt == "plain" else V.META_NO_INPUT
        fields = {"instruction": c("instruction"), "input": c("input")}
        if fmt == "meta":
            prompts = F.array(*[F.lit(p) for p in meta_prompts])
            place = F.pmod(c("example_id").cast("int"), F.lit(len(meta_prompts)))
            fields["meta_prompt"] = F.get(prompts, place)
        has_input = F.coalesce(c("input"), F.lit("")) != ""
        text = F.when(has_input, render(with_input, fields)).otherwise(render(no_input, fields))
        out = df.withColumn("_input", text)
        if fmt == "meta":
            out = out.withColumn("output", F.concat(F.lit("\n"), c("output")))
        return out.withColumn("input", c("_input")).drop("_input")
    if fmt in ("steps", "steps_headed"):
        return render_prm(df, "v1" if fmt == "steps" else "v2")
    if fmt == "solution":
        head = F.concat(F.lit(V.QUESTION_HEAD), c("query"), F.lit(V.SOLUTION_HEAD))
        return df.withColumns(
            {"input": head, "output": F.concat(F.lit("\n\n"), c("output")), "is_eos": F.lit(True)}
        )
    if fmt == "bare":
        return df.withColumns({"input": c("query"), "is_eos": F.lit(True)})
    if fmt == "program":
        return df.withColumns(
            {
                "input": F.concat(
                    F.lit(V.QUESTION_HEAD), trim_space(c("question")),
                    F.lit(V.STARTER_HEAD), trim_space(c("starter_code")), F.lit(V.STARTER_END),
                ),
                "output": F.concat(
                    F.lit(V.PROGRAM_START), trim_space(c("solutions")), F.lit(V.PROGRAM_END)
                ),
                "is_eos": F.lit(True),
            }
        )
    raise ValueError(f"unknown instruction format: {fmt}")


def preference(df: DataFrame, col: str) -> DataFrame:
    """Preference labels 1, 2, -1 become 0, 1, -1."""
    return df.withColumn(
        "choice", F.when(F.col(col) == 1, 0).when(F.col(col) == 2, 1).when(F.col(col) == -1, -1)
    )


def mean_choice(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("choice").alias("mean_choice"))


def to_reward_format(col: Column, fmt: str) -> Column:
    """Question followed by numbered steps, each closed by the step mark.

    Formats of the trace: ``reserved`` (reserved step tokens), ``steps`` (numbered
    step turns), ``steps_left`` (turns that count down). ``plain`` marks the ends of
    sentences and formulas in the solution instead.
    """
    start, end, splitter = V.TRACE_MARKS[fmt]
    from_question = F.substring(col, F.locate(start, col) + len(start), F.length(col))
    question = trim_space(F.substring_index(from_question, end, 1))
    parts = F.split(col, splitter)
    steps = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    count = F.size(parts) - 1

    def body(step: Column, i: Column) -> Column:
        text = step
        number = F.concat(F.lit(V.STEP_NUMBER), (i + 1).cast("string"), F.lit(": "))
        said = F.concat(number, F.lit(V.STEP_ANSWER))
        if fmt == "reserved":
            bare = F.replace(text, F.lit(V.RESERVED_END), F.lit(""))
            closed = F.replace(bare, F.lit(V.RESERVED_ANSWER), said)
            text = F.when(i == count - 1, closed).otherwise(text)
        elif fmt == "steps":
            closed = F.replace(text, F.lit(V.STEP_TURN_ANSWER), said)
            text = F.when(i == count - 1, closed).otherwise(text)
        else:
            text = F.replace(text, F.lit(V.NEXT_TURN), F.lit(""))
        return F.concat(number, trim_space(text), F.lit(V.STEP_MARK))

    joined = F.concat(question, F.array_join(F.transform(steps, body), " "))
    return F.when(count > 0, joined).otherwise(F.concat(question, F.lit(V.STEP_MARK)))


def mark_sentences(col: Column, solution_start: str) -> Column:
    """Step marks after sentences and formulas of the part behind ``solution_start``."""
    pieces = F.split(col, "\\Q" + solution_start + "\\E")
    solution = apply_rules(
        F.get(pieces, F.lit(1)),
        [("text", ".\n", ".\n" + V.STEP_MARK_PLAIN), ("text", "\\]", "\\]" + V.STEP_MARK_PLAIN),
         ("text", "$\n", "$\n" + V.STEP_MARK_PLAIN)],
    )
    return F.concat(pieces[0], F.lit(solution_start), solution, F.lit(V.STEP_MARK_PLAIN))


def render_prompt(df: DataFrame, template: str) -> Column:
    """Prompt column from a template whose places name columns of ``df``."""
    return render(template, {c: F.col(c) for c in df.columns})


def chat_prompt(system: Column, query: Column) -> Column:
    """System and user turn followed by the start of the assistant turn."""
    return F.concat(
        F.lit("<|im_start|>system\n"), system, F.lit(V.TURN_END + V.USER_TURN),
        query, F.lit(V.TURN_END + V.ASSISTANT_TURN),
    )


def budget_prompt(col: Column, mode: str | None, n: int | None = None) -> Column:
    """Question with a thinking budget suffix (steps, tokens, long, short or none)."""
    suffix = {
        None: "",
        "steps": V.BUDGET_STEPS,
        "tokens": V.BUDGET_TOKENS,
        "long": V.BUDGET_LONG,
        "short": V.BUDGET_SHORT,
    }[mode]
    return F.concat(col, F.lit(suffix.replace("{n}", str(n))))


def format_choices(options: Column, pattern: str = "{letter}: {text}") -> Column:
    """Lettered lines, one per option."""
    line = lambda x, i: render(pattern, {"letter": letter_at(i), "text": x})
    return F.array_join(F.transform(options, line), "\n")


def choice_letters(options: Column) -> Column:
    return F.transform(options, lambda x, i: letter_at(i))


def flatten_dialog(
    df: DataFrame, key: str, turn: str, role: str, text: str, asker: str, answerer: str
) -> DataFrame:
    """One ``Q: … A: …`` text per conversation; the last answer is withheld.

    A conversation is one prompt, so its turns are collected into one row.
    """
    turns = df.where(F.col(role).isin(asker, answerer)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(turn, role, text))).alias("_t")
    )
    size = F.size("_t")
    is_answer = lambda x: x[role] == answerer
    lines = F.transform(
        F.filter("_t", lambda x, i: ~(is_answer(x) & (i == size - 1))),
        lambda x: F.concat(F.when(is_answer(x), "A: ").otherwise("Q: "), x[text], F.lit("\n\n")),
    )
    return turns.select(key, F.concat(F.array_join(lines, ""), F.lit("A:")).alias("dialog"))


# --- nested data ---------------------------------------------------------------


def explode_qa(df: DataFrame, keep: Sequence[str], answer_type: str) -> DataFrame:
    """One row per answer of nested ``qas``: array of (question, answers), each answer
    with unanswerable, yes_no, free_form_answer, extractive_spans. The first rule that
    holds names the type; only ``answer_type`` is kept."""
    rows = df.select(*keep, F.explode("qas").alias("_q")).select(
        *keep, F.col("_q.question").alias("question"), F.explode("_q.answers").alias("_a")
    )
    free, spans = F.col("_a.free_form_answer"), F.col("_a.extractive_spans")
    cases = [
        (F.col("_a.unanswerable"), F.lit("unanswerable"), "unanswerable"),
        (F.col("_a.yes_no"), F.lit("yes"), "bool"),
        (F.coalesce(free, F.lit("")) != "", free, "free form answer"),
        (F.size(F.coalesce(spans, F.array())) > 0, F.array_join(spans, ", "), "extractive_spans"),
        (F.col("_a.yes_no") == F.lit(False), F.lit("no"), "bool"),
    ]
    answer, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, value, name in reversed(cases):
        hit = F.coalesce(cond, F.lit(False))
        answer = F.when(hit, value).otherwise(answer)
        kind = F.when(hit, F.lit(name)).otherwise(kind)
    return (
        rows.select(*keep, "question", answer.alias("answer"), kind.alias("answer_type"))
        .where(F.col("answer_type") == answer_type)
    )


def explode_answers(df: DataFrame, answers: str) -> DataFrame:
    """One row per answer, other columns repeated."""
    return df.withColumn(answers, F.explode(answers))


SHEET_SCHEMA = (
    "array<struct<prompt:string,subprompts:array<struct<"
    "questionpart_n:string,question:string,answer:string>>>>"
)


def explode_sheets(
    df: DataFrame, number: str, preamble: str, context: str, questions: str
) -> DataFrame:
    """One row per question of a sheet held as JSON text: the sheet and question text
    with and without context, the answer form and the map of answers."""
    sheets = df.withColumn("_q", F.from_json(questions, SHEET_SCHEMA))
    part = lambda p: F.concat(p["questionpart_n"], F.lit(" "), p["question"], F.lit("\n"))
    one = lambda q: F.concat(
        F.lit("\n"), q["prompt"], F.lit("\n"), F.array_join(F.transform(q["subprompts"], part), "")
    )
    sheets = sheets.withColumn("_all", F.array_join(F.transform("_q", one), ""))
    rows = sheets.select(
        number, preamble, context, "_all", F.posexplode("_q").alias("question_no", "_one")
    )
    keys = F.transform("_one.subprompts", lambda p: p["questionpart_n"])
    blank = F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit("")))

    def prompt(*sheet: Column) -> Column:
        body = F.concat_ws("\n", *sheet, F.col("_all"))
        return render(
            "{body}\n\nNow respond to the following questions:\n{own}\n\n"
            "Format your response as a json file with the keys as provided below:\n{form}\n",
            {"body": body, "own": one(F.col("_one")), "form": F.to_json(blank)},
        )

    return rows.select(
        number,
        "question_no",
        prompt(F.col(preamble), F.col(context)).alias("prompt"),
        prompt(F.col(preamble)).alias("nc_prompt"),
        F.map_from_arrays(
            keys, F.transform("_one.subprompts", lambda p: p["answer"])
        ).alias("answers"),
    )


def uniq_sorted(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def pack_segments(
    df: DataFrame, key: str, text: str, limit: int, separator: str = "\n\n", size=word_count
) -> DataFrame:
    """Consecutive paragraphs of a text packed into segments; a segment closes once
    its size exceeds ``limit``, an unfinished tail is dropped."""
    parts = F.split(text, "\\Q" + separator + "\\E")
    sized = df.select(
        key, F.transform(parts, lambda p: F.struct(p.alias("p"), size(p).alias("n"))).alias("_parts")
    )
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("n"))

    def step(st: Column, x: Column) -> Column:
        grown, total = F.array_append(st["open"], x["p"]), st["n"] + x["n"]
        full = total > limit
        return F.struct(
            F.when(full, F.array_append(st["done"], F.array_join(grown, separator)))
            .otherwise(st["done"])
            .alias("done"),
            F.when(full, empty).otherwise(grown).alias("open"),
            F.when(full, 0).otherwise(total).alias("n"),
        )

    packed = F.aggregate("_parts", start, step, lambda st: st["done"])
    return sized.select(key, F.posexplode(packed).alias("segment_no", "segment"))


def rolling_windows(
    df: DataFrame, key: str, tokens: str, max_len: int, ctx: int, prefix: str, disjoint: bool = False
) -> DataFrame:
    """Windows ``(window_no, context, predicted)`` that predict every token once.

    Tokens are read by position inside the window, so a long text is not copied per
    window. ``disjoint`` leaves only context that is not predicted in the window.
    """
    t = F.col(tokens)
    size, step = F.size(t), max_len - ctx + 1
    first = F.least(F.lit(max_len), size)
    count = F.when(size == 0, 0).otherwise(1 + F.ceil((size - first) / step)).cast("int")

    def span(a: Column, b: Column) -> Column:
        """Tokens a..b-1; position -1 stands for the prefix token."""
        read = lambda j: F.when(j < 0, F.lit(prefix)).otherwise(F.get(t, j))
        return F.when(b > a, F.transform(F.sequence(a, b - 1), read)).otherwise(
            F.array().cast("array<string>")
        )

    def window(k: Column) -> Column:
        end = F.when(k == 0, first).otherwise(F.least(size, first + k * step))
        begin = F.when(k == 0, 0).otherwise(first + (k - 1) * step)
        left = F.when(k == 0, -1).otherwise(end - max_len - 1)
        right = end - 1 - (end - begin - 1) if disjoint else end - 1
        return F.struct(span(left, right).alias("context"), span(begin, end).alias("predicted"))

    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    rows = df.select(key, F.posexplode(F.transform(numbers, window)).alias("window_no", "_w"))
    return rows.select(key, "window_no", "_w.context", "_w.predicted")


def format_release(df: DataFrame, domain: str, source: str) -> DataFrame:
    """Publishable rows: subdomain is the third part of the domain path; rows without
    problem, solution, path or difficulty are skipped."""
    third = F.get(F.split(domain, " -> "), F.lit(2))
    need = ["problem", "solution", domain, "difficulty"]
    return df.withColumns({"subdomain": third, "source": F.lit(source)}).dropna(
        subset=[*need, "subdomain"]
    )


def seeded_pair(df: DataFrame, a: str, b: str, seed: int = 0) -> DataFrame:
    """Two options in an order drawn from the text; label 1 when ``a`` came first."""
    first = F.substring(hash_text([a], seed), 1, 1).isin(list("02468ace"))
    return df.withColumns(
        {
            "scenario_1": F.when(first, F.col(a)).otherwise(F.col(b)),
            "scenario_2": F.when(first, F.col(b)).otherwise(F.col(a)),
            "label": first.cast("int"),
        }
    )


def capitalize(col: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def to_choices(
    df: DataFrame, query: Column, options: Sequence[str], gold: str, rules: str | None = None
) -> DataFrame:
    """Query, array of choices and integer gold from option columns."""
    tidy = (lambda c: detokenize(c, rules)) if rules else (lambda c: c)
    return df.withColumns(
        {
            "query": tidy(query),
            "choices": F.array(*[tidy(F.col(o)) for o in options]),
            "gold": F.col(gold).cast("int"),
        }
    )


def squeeze_spaces(col: Column) -> Column:
    return F.regexp_replace(col, " +", " ")


def lower_first(col: Column) -> Column:
    return F.concat(F.lower(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def prepare_pair(
    df: DataFrame, first: str, second: str, ends: str = ".,;", close: bool = False
) -> DataFrame:
    """Sentence pairs: drop empty sides, detokenize, cut final punctuation of the
    first, lower the first letter of the second (and close it with a full stop)."""
    kept = nonempty_pairs(df, first, second)
    a = trim_space(detokenize(F.col(first)))
    b = lower_first(trim_space(detokenize(F.col(second))))
    cut = F.regexp_replace(a, "[" + ends + "]$", "")
    if close:
        b = F.when(b.endswith("."), b).otherwise(F.concat(b, F.lit(".")))
    return kept.withColumns({first: cut, second: b})


def messages(user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(
        F.lit(role).alias("role"), text.alias("content")
    )
    return F.array(turn("user", user), turn("assistant", assistant))


def to_messages(df: DataFrame, fmt: str) -> DataFrame:
    """Benchmark rows as ``messages`` (user, assistant) plus gold ``answer``.

    Rows whose gold answer cannot be read are dropped. Formats: grade_school, math,
    sat, courseware, stem, multilingual, chinese, cloze, mathqa, mathqa_shots, formal.
    """
    from assayline.functions.answers import math_answers, normalize_extracted

    c = F.col
    none = F.lit("")
    question = trim_space(c("question")) if "question" in df.columns else None
    if fmt == "grade_school":
        calc = F.regexp_replace("cot", "<<[^<>]*>>", "")
        said = F.concat(calc, F.lit(V.BOXED_START), trim_space(c("answer")), F.lit(V.BOXED_END))
        chat, gold = messages(c("question"), said), F.replace(c("answer"), F.lit(","), none)
    elif fmt == "math":
        steps = F.regexp_replace("solution", r"(?<=\.) (?=[A-Z])", "\n")
        chat, gold = messages(c("problem"), steps), math_answers(c("problem"), c("solution"))
        gold = F.when(F.size(gold) > 0, gold)
    elif fmt == "sat":
        options = F.concat(F.lit("("), trim_space(c("options")))
        for letter in "BCDEFG":
            options = F.replace(options, F.lit(f" {letter}) "), F.lit(f" ({letter}) "))
        starts = F.when(trim_space(c("options")).startswith("A"), c("answer"))
        chat = messages(F.concat(question, F.lit(V.CHOICE_ASK), trim_space(options)), c("answer"))
        gold = starts
    elif fmt == "courseware":
        chat = messages(trim_space(c("problem")), trim_space(c("solution")))
        gold = c("answer")
    elif fmt == "stem":
        line = lambda x, i: F.concat(F.lit("("), letter_at(i), F.lit(") "), trim_space(x))
        listed = F.array_join(F.transform("options", line), ", ")
        chat, gold = messages(F.concat(question, F.lit(V.CHOICE_ASK), listed), c("answer")), c("answer")
    elif fmt == "multilingual":
        return df.withColumn("answer", F.replace(c("answer"), F.lit(","), none)).dropna(
            subset=["answer"]
        )
    elif fmt == "chinese":
        chat = messages(question, none)
        gold = F.replace(trim_space(c("golden")), F.lit(","), none)
    elif fmt == "cloze":
        parts = F.split(trim_space(c("answer")), ";")
        chat, gold = messages(question, none), F.transform(parts, normalize_extracted)
    elif fmt == "mathqa":
        tidy = lambda o: F.concat(
            F.substring(trim_space(o), 2, 1), F.lit(": "), trim_space(F.substring(trim_space(o), 4, 1 << 30))
        )
        quoted = F.transform("options", lambda o: F.concat(F.lit("'"), tidy(o), F.lit("'")))
        listed = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
        shaped = F.forall("options", lambda o: trim_space(o).rlike(r"^\([ABCD]\)"))
        chat = messages(F.concat(question, F.lit("\n"), listed), none)
        gold = F.when(shaped, c("label"))
    elif fmt == "mathqa_shots":
        listed = F.array_join(F.transform("options", trim_space), " ")
        stem = F.regexp_replace(question, r"\\+$", "")
        chat = messages(F.concat(stem, F.lit(V.SHOTS_ASK), listed), none)
        gold = c("label")
    elif fmt == "formal":
        text = render(
            V.FORMAL_TEXT,
            {
                "a": trim_space(c("informal_statement")),
                "b": trim_space(c("informal_proof")),
                "c": trim_space(c("formal_statement")),
            },
        )
        chat, gold = messages(text, none), F.lit(V.FORMAL_ANSWER)
    else:
        raise ValueError(f"unknown benchmark format: {fmt}")
    return df.withColumns({"messages": chat, "_gold": gold}).withColumn(
        "answer", c("_gold")
    ).drop("_gold").where(F.col("answer").isNotNull())
