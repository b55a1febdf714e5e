"""Schema mapping, filters and rendering on the given tables."""

from pyspark.sql import functions as F

from assayline.functions import rewrite as W
from assayline.functions.text import word_count, words
from assayline.operators import reshape as B
from assayline.queries import query, table
from assayline.queries.sqltext import word_list

NL = "chr(10)"


@query(
    "b1_to_common",
    """SELECT text AS question, source AS solution, 'prose' AS cot_type, 'set/' || lang AS source_type,
       '{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}' AS metadata,
       doc_id AS row_idx FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    source = F.concat(F.lit("set/"), "lang")
    return B.to_common(docs, "text", "source", "prose", source, "doc_id")


@query(
    "b2_filter_source",
    "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND quality IS NOT NULL",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return B.filter_source(rows, {"lang": "en"}, not_null=["quality"]).select("doc_id")


@query(
    "b3_map_category",
    """SELECT n_name, CASE n_name WHEN 'CANADA' THEN 'north' WHEN 'KENYA' THEN 'south' ELSE 'other' END AS category FROM nation""",
)
def _(spark, sf):
    mapped = B.map_category(F.col("n_name"), {"CANADA": "north", "KENYA": "south"}, "other")
    return table(spark, sf, "nation").select("n_name", mapped.alias("category"))


@query(
    "b5_clean_question",
    """SELECT doc_id, replace(replace(string_split(text, '. ')[1], 'the', 'THE'), ' and ', ' & ') AS question FROM documents""",
)
def _(spark, sf):
    cleaned = B.clean_question(F.col("text"), ". ", [("the", "THE"), (" and ", " & ")])
    return table(spark, sf, "documents").select("doc_id", cleaned.alias("question"))


def option_hash(i: int) -> str:
    return f"sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), '{i}', '42'))"


@query(
    "b6_assemble_mcq",
    f"""WITH o AS (SELECT p_partkey, p_brand, p_type, p_name, p_retailprice, p_size, list_transform(list_sort([
          {{'h': {option_hash(0)}, 't': p_brand}}, {{'h': {option_hash(1)}, 't': p_type}},
          {{'h': {option_hash(2)}, 't': CAST(p_size AS VARCHAR)}}, {{'h': {option_hash(3)}, 't': 'key ' || CAST(p_partkey AS VARCHAR)}}]),
          lambda x: x.t) AS c FROM part)
        SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name || {NL} || 'Answer Choices:' || {NL} || '(A) ' || c[1] || {NL} || '(B) ' || c[2]
          || {NL} || '(C) ' || c[3] || {NL} || '(D) ' || c[4] ELSE p_name END AS question,
          CASE WHEN p_size > 10 THEN 'because' || {NL} || {NL} || 'Answer: ' ||
            chr(64 + CAST(list_position(c, 'key ' || CAST(p_partkey AS VARCHAR)) AS INT)) ELSE 'because' END AS solution FROM o""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("question"),
        F.lit("because").alias("solution"),
        "p_size",
        F.concat(F.lit("\n"), "p_brand", F.lit("\n")).alias("w1"),
        F.col("p_type").alias("w2"),
        F.col("p_size").cast("string").alias("w3"),
        F.concat(F.lit("key "), F.col("p_partkey").cast("string")).alias("right"),
    )
    out = B.assemble_mcq(
        part, F.col("p_size") > 10, "question", "solution", ["w1", "w2", "w3"], "right", "p_partkey"
    )
    return out.select("p_partkey", "question", "solution")


CONTEST = "strftime(o_orderdate, '%Y') || '-' || CAST(o_orderkey AS VARCHAR)"


@query(
    "b7_contest_rows",
    f"""SELECT o_orderpriority AS question, CAST(o_totalprice AS VARCHAR) AS solution, 'math' AS cot_type, 'contest' AS source_type,
        '{{"id":"' || {CONTEST} || '","o_orderkey":' || CAST(o_orderkey AS VARCHAR) || '}}' AS metadata, o_orderkey AS row_idx
        FROM orders WHERE year(o_orderdate) <= 1995""",
)
def _(spark, sf):
    ident = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf, "orders").select(
        ident.alias("id"), "o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("string").alias("price")
    )
    return B.contest_rows(rows, "id", "o_orderpriority", "price", "contest", "o_orderkey", 1995)


@query(
    "b8_render_sft",
    f"""SELECT conv_id, turn, '<|im_start|>user{{n}}' || role || '<|im_end|>{{n}}<|im_start|>assistant{{n}}<|im_start|>think{{n}}'
        || trim(text || {NL} || role, ' ' || {NL}) || '{{n}}<|im_start|>answer{{n}}' ||
        CASE WHEN turn % 2 = 0 THEN 'Answer: ' || role ELSE 'The Answer: ' || role END || '<|im_end|>{{n}}' AS text
        FROM conversations""".replace("{n}", "' || chr(10) || '"),
)
def _(spark, sf):
    attempt = F.when(F.col("turn") % 2 == 0, F.concat(F.col("role"), F.lit(" "))).otherwise(
        F.concat(F.lit("The Answer: "), "role")
    )
    text = B.render_sft(F.col("role"), F.array("text", "role"), attempt)
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


def steps(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.col("role").alias("input"),
        F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")).alias("output_prefix"),
        F.col("text").alias("output"),
        (F.col("turn") % 3).alias("label"),
    )


def prm_sql(fmt, head, fresh, lead, rest):
    return f"""SELECT '{fmt}' AS fmt, conv_id, turn, CASE WHEN turn % 2 = 0 THEN {head} || role || {fresh} ELSE {head} || role || {rest} || role END AS input,
      CASE WHEN turn % 2 = 0 THEN {lead} || text ELSE text END AS output, CAST(turn % 3 AS VARCHAR) AS label FROM conversations"""


SOL = f"{NL} || {NL} || '# Solution'"
HEAD = f"'# Question' || {NL} || {NL}"
PRM = " UNION ALL ".join(
    [
        prm_sql("v1", "'Question: '", "''", f"{NL} || {NL} || 'Answer: '", f"{NL} || {NL} || 'Answer: '"),
        prm_sql("v2", HEAD, SOL, f"{NL} || {NL}", f"{SOL} || {NL} || {NL}"),
        prm_sql("v3", HEAD, f"{SOL} || {NL} || {NL}", "''", f"{SOL} || {NL} || {NL}"),
        f"""SELECT 'v4', conv_id, turn, {HEAD} || role || {SOL} || {NL} || {NL} || CASE WHEN turn % 2 = 0 THEN '' ELSE role END,
            text || {NL} || {NL} || ' ;;; ' || role, CAST(turn % 3 AS VARCHAR) || ' ;;; 1' FROM conversations""",
        "SELECT 'scores', conv_id, turn, role, text, CAST(turn / 4 AS VARCHAR) FROM conversations",
        "SELECT 'program', conv_id, turn, role || '?', text || '!', CAST(turn % 3 AS VARCHAR) FROM conversations",
    ]
)


@query("b9_render_prm", PRM)
def _(spark, sf):
    rows = steps(spark, sf)
    lists = rows.withColumns({"output": F.array("output", "input"), "label": F.array("label", F.lit(1).cast("long"))})
    program = rows.withColumns({"prompt": F.concat("input", F.lit("?")), "solution": F.concat("output", F.lit("!"))})
    inputs = {
        "v1": rows, "v2": rows, "v3": rows, "v4": lists,
        "scores": rows.withColumn("scores", F.col("turn") / 4), "program": program,
    }
    out = None
    for fmt, df in inputs.items():
        part = B.render_prm(df, fmt).select(
            F.lit(fmt).alias("fmt"), "conv_id", "turn", "input", "output", F.col("label").cast("string").alias("label")
        )
        out = part if out is None else out.unionByName(part)
    return out


INSTRUCT = {
    "plain": (
        f"""CASE WHEN turn % 2 = 0 THEN 'Below is an instruction that describes a task. Write a response that appropriately completes the request.'
          || {NL} || {NL} || '### Instruction:' || {NL} || text || {NL} || {NL} || '### Response:' || {NL}
          ELSE 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.'
          || {NL} || {NL} || '### Instruction:' || {NL} || text || {NL} || {NL} || '### Input:' || {NL} || role || {NL} || {NL} || '### Response:' || {NL} END""",
        "role",
    ),
    "meta": (
        f"""CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' ELSE 'Be exact.' END || {NL} || text || {NL} || {NL} ||
          CASE WHEN turn % 2 = 0 THEN '' ELSE role || {NL} || {NL} END || '### Dromedary'""",
        f"{NL} || role",
    ),
    "solution": (f"{HEAD} || text || {SOL}", f"{NL} || {NL} || role"),
    "bare": ("text", "role"),
    "program": (
        f"{HEAD} || trim(text, ' ' || {NL}) || {NL} || {NL} || '# Starter Code' || {NL} || {NL} || '```python' || {NL} || role || {NL} || '```' || {SOL}",
        f"{NL} || {NL} || '```python' || {NL} || 'pass' || {NL} || '```' || {NL}",
    ),
}


@query(
    "b10_render_instruct",
    " UNION ALL ".join(
        f"SELECT '{fmt}' AS fmt, conv_id, turn, {i} AS input, {o} AS output FROM conversations" for fmt, (i, o) in INSTRUCT.items()
    ),
)
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.col("conv_id").alias("example_id"),
        F.col("text").alias("instruction"),
        F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")).alias("input"),
        F.col("role").alias("output"),
        F.col("text").alias("query"),
        F.concat(F.col("text"), F.lit("\n ")).alias("question"),
        F.concat(F.lit(" "), F.col("role")).alias("starter_code"),
        F.lit("pass\n").alias("solutions"),
    )
    out = None
    for fmt in INSTRUCT:
        part = B.render_instruct(rows, fmt, ["Be brief.", "Be exact."])
        part = part.select(F.lit(fmt).alias("fmt"), "conv_id", "turn", "input", "output")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b11_preference",
    """SELECT round(avg(CASE WHEN quality = 1 AND toxic = 1 THEN -1 WHEN quality = 1 THEN 0 ELSE 1 END), 6) AS mean_choice FROM labels""",
)
def _(spark, sf):
    pref = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), -1).when(F.col("quality") == 1, 1).otherwise(2)
    rows = B.preference(table(spark, sf, "labels").withColumn("preference", pref), "preference")
    return B.mean_choice(rows).select(F.round("mean_choice", 6).alias("mean_choice"))


@query(
    "b12_to_reward_format",
    f"""SELECT conv_id, turn, role || 'Step 1: ' || trim(text, ' ' || {NL}) || ' ки' || {NL} || ' Step 2: ' || 'Step 2: The answer is: ' || role || ' ки' || {NL} AS steps,
        role || 'Step 1: ' || trim(text, ' ' || {NL}) || ' ки' || {NL} || ' Step 2: done ки' || {NL} AS steps_left,
        role || 'Step 1: ' || trim(text, ' ' || {NL}) || ' ки' || {NL} || ' Step 2: ' || 'Step 2: The answer is:  7 ки' || {NL} AS reserved
        FROM conversations""",
)
def _(spark, sf):
    chat = lambda *parts: F.concat(*[F.lit(p) if p not in ("role", "text") else F.col(p) for p in parts])
    numbered = chat(
        "<|im_start|>user\n", "role", "\nPut your answer on its own line after Answer:",
        "<|im_start|>step1\n", "text", "\n<|im_start|>step2\n<|im_start|>answer\nAnswer: ", "role",
    )
    counted = chat(
        "<|im_start|>user\n", "role", "\n\nThink for up to 2 steps.",
        "<|im_start|>2 steps left\n", "text", "\n<|im_start|><|im_start|>1 steps left\ndone",
    )
    reserved = chat(
        "user<|end_header_id|>\n\n", "role", " Put your answer on its own line after x",
        "\n<|reserved_special_token_0|>\n", "text", "\n<|reserved_special_token_1|>\nAnswer: 7<|eot_id|>",
    )
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        B.to_reward_format(numbered, "steps").alias("steps"),
        B.to_reward_format(counted, "steps_left").alias("steps_left"),
        B.to_reward_format(reserved, "reserved").alias("reserved"),
    )


@query(
    "b13_render_prompt",
    "SELECT conv_id, turn, 'Turn ' || CAST(turn AS VARCHAR) || ' {' || role || '}: ' || text AS prompt FROM conversations",
)
def _(spark, sf):
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", B.render_prompt(rows, "Turn {turn} {{{role}}}: {text}").alias("prompt"))


@query(
    "b14_budget_prompt",
    f"""SELECT item_id, text || {NL} || {NL} || 'Think for up to 8 steps.' AS steps, text || {NL} || {NL} || 'Think for up to 512 tokens.' AS tokens,
        text || {NL} || {NL} || 'Answer after a short amount of thinking. Do not spend excessive time double-checking your work.' AS short, text AS plain,
        text || {NL} || {NL} || 'Answer after a long amount of thinking. If you feel like you are finished early, spend the extra time trying to double-check your work until you are absolutely sure that you have the correct answer.' AS long
        FROM benchmark""",
)
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "benchmark").select(
        "item_id",
        B.budget_prompt(text, "steps", 8).alias("steps"),
        B.budget_prompt(text, "tokens", 512).alias("tokens"),
        B.budget_prompt(text, "short").alias("short"),
        B.budget_prompt(text, None).alias("plain"),
        B.budget_prompt(text, "long").alias("long"),
    )


@query(
    "b15_format_choices",
    f"""SELECT p_partkey, 'A: ' || p_brand || {NL} || 'B: ' || p_type || {NL} || 'C: ' || p_name AS block, 'A,B,C' AS letters FROM part""",
)
def _(spark, sf):
    options = F.array("p_brand", "p_type", "p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        B.format_choices(options).alias("block"),
        F.array_join(B.choice_letters(options), ",").alias("letters"),
    )


@query(
    "b16_flatten_dialog",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))
        SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'assistant' THEN 'A: ' ELSE 'Q: ' END || text || {NL} || {NL}, '' ORDER BY turn)
          FILTER (NOT (back = 1 AND role = 'assistant')), '') || 'A:' AS dialog FROM t GROUP BY 1""",
)
def _(spark, sf):
    return B.flatten_dialog(
        table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", "user", "assistant"
    )


@query(
    "b17_detokenize",
    """WITH d AS (SELECT doc_id, replace(replace(text, '.', ' .'), ',', ' ,') AS s FROM documents)
       SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(s, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'),
         ' ([''.,])', '\\1', 'g') AS general,
       replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(s, ' ''', ''''), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)),
         ' n''t', 'n''t'), '`` ', '"'), '''''', '"'), ' :', ':'), ' ;', ';'), ' !', '!'), ' ?', '?'), ' ,', ','), ' .', '.') AS dialog FROM d""",
)
def _(spark, sf):
    spaced = F.replace(F.replace("text", F.lit("."), F.lit(" .")), F.lit(","), F.lit(" ,"))
    return table(spark, sf, "documents").select(
        "doc_id", W.detokenize(spaced).alias("general"), W.detokenize(spaced, "dialog").alias("dialog")
    )


def _chain(col: str, steps: list[tuple[str, str]]) -> str:
    """Replacements one after the other; a first part in slashes is a pattern."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for what, by in steps:
        if what.startswith("/") and what.endswith("/"):
            col = f"regexp_replace({col}, {quoted(what[1:-1])}, {quoted(by)}, 'g')"
        else:
            col = f"replace({col}, {quoted(what)}, {quoted(by)})"
    return col


WIKI = [("s '", "s'"), ("//' [0-9]//", "/'[0-9]/")]
WIKI += [(f" @{c}@ ", c) for c in "-,."] + [(f" {c} ", f"{c} ") for c in ":;.!?,"]
WIKI += [(rf"/\{a}\s*([^\{b}]*?)\s*\{b}/", rf"{a}\1{b}") for a, b in ("()", "[]", "{}")]
WIKI += [(rf"/{q}\s*([^{q}]*?)\s*{q}/", rf"{q}\1{q}") for q in "\"'"]
WIKI += [(" ".join("=" * k), "=" * k) for k in (4, 3, 2)]
WIKI += [(" ° ", "°"), (" \n", "\n"), ("\n ", "\n"), (" N ", " 1 "), (" 's", "'s")]
SPACING = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
SPACING += [(r"/\s+([.,;:!?)])/", r"\1")]
SPACING += [(rf"/(\s+|^)\{a}\s+([^)]+)\s+\{b}/", rf"\1{a}\2{b}") for a, b in ("()", "[]")]
SPACING += [(rf"/(\s+|^){q}\s+([^{q}]+)\s+{q}/", rf"\1{q}\2{q}") for q in "\"'"]


@query(
    "b17_detokenize_marks",
    f"""WITH d AS (SELECT doc_id, replace(replace(replace(text, '.', ' . '), ',', ' , '), '-', ' @-@ ') AS w,
          replace(replace(text, '.', ' . '), ' a', ' &amp; &quot; a') AS p, source, lang FROM documents),
        e AS (SELECT doc_id, '= = = ' || source || ' = = = ' || {NL} || ' ' || w || ' ( ' || lang || ' ) " ' || source || ' " 5 @.@ 2 ° N 7 's : {{ ' || lang || ' }}' AS w,
          '( ' || lang || ' ) ' || p || ' [ ' || source || ' ] &lt;b&gt; it&#39;s ; " ' || lang || ' " !' AS p FROM d)
        SELECT doc_id, {_chain("w", WIKI)} AS wiki, {_chain("p", SPACING)} AS spacing FROM e""".replace("7 's", "7 ''s"),
)
def _(spark, sf):
    def swapped(*pairs):
        out = F.col("text")
        for what, by in pairs:
            out = F.replace(out, F.lit(what), F.lit(by))
        return out

    w = swapped((".", " . "), (",", " , "), ("-", " @-@ "))
    p = swapped((".", " . "), (" a", " &amp; &quot; a"))
    wiki = W.render(
        "= = = {source} = = = \n {w} ( {lang} ) \" {source} \" 5 @.@ 2 ° N 7 's : {{ {lang} }}",
        {"source": F.col("source"), "lang": F.col("lang"), "w": w},
    )
    page = W.render(
        "( {lang} ) {p} [ {source} ] &lt;b&gt; it&#39;s ; \" {lang} \" !",
        {"source": F.col("source"), "lang": F.col("lang"), "p": p},
    )
    return table(spark, sf, "documents").select(
        "doc_id", W.detokenize(wiki, "wiki").alias("wiki"), W.detokenize(page, "spacing").alias("spacing")
    )


@query(
    "b17_detokenize_brackets",
    """SELECT doc_id, replace(regexp_replace(replace(trim(s, ' ' || chr(10)), ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ') AS brackets
       FROM (SELECT doc_id, ' ' || source || ' [title]' || text || ' [' || lang || '] end' AS s FROM documents)""",
)
def _(spark, sf):
    text = F.concat(F.lit(" "), "source", F.lit(" [title]"), "text", F.lit(" ["), "lang", F.lit("] end"))
    return table(spark, sf, "documents").select("doc_id", W.detokenize(text, "brackets").alias("brackets"))


@query(
    "b18_explode_qa",
    """SELECT conv_id, turn, text AS question, CASE WHEN turn % 4 = 1 THEN 'yes' ELSE 'no' END AS answer, 'bool' AS answer_type
       FROM conversations WHERE turn % 4 = 1 OR (turn % 4 = 3 AND conv_id % 2 = 0)""",
)
def _(spark, sf):
    rest = F.col("turn") % 4
    spans = F.when((rest == 3) & (F.col("conv_id") % 2 == 1), F.array("role")).otherwise(F.array().cast("array<string>"))
    answer = F.struct(
        (rest == 0).alias("unanswerable"),
        F.when(rest == 1, True).when(rest == 3, False).alias("yes_no"),
        F.when(rest == 2, F.col("role")).otherwise("").alias("free_form_answer"),
        spans.alias("extractive_spans"),
    )
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array(F.struct(F.col("text").alias("question"), F.array(answer).alias("answers"))).alias("qas")
    )
    return B.explode_qa(rows, ["conv_id", "turn"], "bool")


@query(
    "b19_explode_answers",
    "SELECT doc_id, lang, unnest(string_split(source || ' ' || lang, ' ')) AS answers FROM documents",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.array("source", "lang").alias("answers"))
    return B.explode_answers(rows, "answers")


@query(
    "b20_explode_sheets",
    """WITH s AS (SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS pre, CAST(n AS INT) AS question_no, chr(10) AS nl,
          chr(10) || 'Part ' || n || chr(10) || 'x' || n || ' ' || s_name || chr(10) AS own,
          chr(10) || 'Part 0' || chr(10) || 'x0 ' || s_name || chr(10) || chr(10) || 'Part 1' || chr(10) || 'x1 ' || s_name || chr(10) AS every
          FROM supplier, (SELECT unnest([0, 1]) AS n)),
        e AS (SELECT *, nl || nl || 'Now respond to the following questions:' || nl || own || nl || nl ||
          'Format your response as a json file with the keys as provided below:' || nl || '{"x' || question_no || '":""}' || nl AS ask FROM s)
       SELECT s_suppkey, question_no, pre || nl || s_name || pre || nl || every || ask AS prompt, pre || nl || every || ask AS nc_prompt,
         'x' || question_no || '=' || s_name AS answers FROM e""",
)
def _(spark, sf):
    part = lambda i: F.struct(
        F.lit(f"Part {i}").alias("prompt"),
        F.array(
            F.struct(
                F.lit(f"x{i}").alias("questionpart_n"), F.col("s_name").alias("question"), F.col("s_name").alias("answer")
            )
        ).alias("subprompts"),
    )
    sheets = table(spark, sf, "supplier").select(
        "s_suppkey",
        "s_name",
        F.col("s_nationkey").cast("string").alias("preamble"),
        F.concat("s_name", F.col("s_nationkey").cast("string")).alias("context"),
        F.to_json(F.array(part(0), part(1))).alias("questions"),
    )
    out = B.explode_sheets(sheets, "s_suppkey", "preamble", "context", "questions")
    shown = F.concat_ws(",", F.transform(F.map_entries("answers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("s_suppkey", "question_no", "prompt", "nc_prompt", shown.alias("answers"))


@query(
    "b21_uniq_sorted",
    f"SELECT doc_id, array_to_string(list_sort(list_distinct({word_list('text')})), ' ') AS entities FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(B.uniq_sorted(words(F.col("text"))), " ").alias("entities")
    )


@query(
    "b22_merge_duplicates",
    """SELECT sha256(text) AS id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS output_no, source AS output,
       first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS first_doc FROM documents""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("id"), "doc_id", F.col("source").alias("output")
    )
    firsts, outputs = B.merge_duplicates(rows, "id", "doc_id", "output")
    return outputs.join(firsts.select("id", F.col("doc_id").alias("first_doc")), "id")


@query(
    "b23_valid_rows",
    """SELECT p_partkey FROM part WHERE p_size % 6 IN (0, 1, 2, 3) AND NOT (p_size % 7 = 0) AND p_name LIKE 'small%'""",
)
def _(spark, sf):
    blank = F.col("p_size") % 7 == 0
    options = F.array(*[F.when(blank, "").otherwise(F.col(c)) for c in ["p_name", "p_type"]])
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_name", (F.col("p_size") % 6).alias("answer"), options.alias("candidates")
    )
    out = B.valid_choice_rows(B.nonempty_pairs(rows, "p_name", "p_name"), "answer", "candidates")
    return B.with_prefix(out, "p_name", "small").select("p_partkey")


@query("b24_prune_long", f"SELECT doc_id FROM documents WHERE len({word_list('text')}) <= 300")
def _(spark, sf):
    return B.prune_long(table(spark, sf, "documents"), 300, word_count(F.col("text"))).select("doc_id")


@query(
    "b25_first_present",
    """SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'bad' END, source) AS answer
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, "good").alias("answer"),
        F.when(F.col("toxic") == 1, "bad").alias("orig_answer"),
        F.col("source").alias("orig_orig_answer"),
    )
    kept = B.first_present(rows, ["answer", "orig_answer", "absent", "orig_orig_answer"])
    return rows.select("doc_id", kept.alias("answer"))


@query(
    "b26_pack_segments",
    f"""WITH RECURSIVE p AS (SELECT doc_id, string_split(text, {NL}) AS l FROM documents),
        e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM p),
        n AS (SELECT doc_id, k, t, len({word_list('t')}) AS n FROM e),
        r(doc_id, k, seg, run) AS (SELECT doc_id, k, 0, n FROM n WHERE k = 1
          UNION ALL SELECT n.doc_id, n.k, CASE WHEN run > 60 THEN seg + 1 ELSE seg END, CASE WHEN run > 60 THEN n.n ELSE run + n.n END
          FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1),
        f AS (SELECT r.doc_id, seg, max(run) AS size, string_agg(t, {NL} ORDER BY r.k) AS segment FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k GROUP BY 1, 2)
        SELECT doc_id, seg AS segment_no, segment FROM f WHERE size > 60""",
)
def _(spark, sf):
    return B.pack_segments(table(spark, sf, "documents"), "doc_id", "text", 60, separator="\n")


@query(
    "b27_rolling_windows",
    f"""WITH w AS (SELECT doc_id, {word_list('text')} AS t FROM documents),
        k AS (SELECT doc_id, t, len(t) AS n, least(10, len(t)) AS f, unnest(range(0, 1 + CAST(ceil((len(t) - least(10, len(t))) / 8.0) AS INT))) AS k FROM w WHERE len(t) > 0),
        b AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE f + (k - 1) * 8 END AS s, CASE WHEN k = 0 THEN f ELSE least(n, f + k * 8) END AS e FROM k)
        SELECT doc_id, CAST(k AS INT) AS window_no, CASE WHEN k = 0 THEN trim('<s> ' || array_to_string(t[1:f - 1], ' ')) ELSE array_to_string(t[e - 10:e - 1], ' ') END AS context,
          array_to_string(t[s + 1:e], ' ') AS predicted FROM b""",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("tokens"))
    out = B.rolling_windows(rows, "doc_id", "tokens", 10, 3, "<s>")
    return out.select(
        "doc_id", "window_no", F.array_join("context", " ").alias("context"), F.array_join("predicted", " ").alias("predicted")
    )


@query(
    "b28_to_messages",
    """SELECT o_orderkey, 'grade_school' AS fmt, o_orderpriority AS ask, o_orderstatus || chr(10) || 'So the answer is $\\boxed{1,' || CAST(o_orderkey AS VARCHAR) || '}$.' AS said,
         '1' || CAST(o_orderkey AS VARCHAR) AS answer FROM orders
       UNION ALL SELECT o_orderkey, 'stem', o_orderpriority || chr(10) || 'What of the following is the right choice? Explain your answer.' || chr(10) || '(A) ' || o_orderstatus || ', (B) none', 'B', 'B' FROM orders
       UNION ALL SELECT o_orderkey, 'math', o_orderpriority, 'So.' || chr(10) || 'The answer is \\boxed{' || CAST(o_orderkey AS VARCHAR) || '}', CAST(o_orderkey AS VARCHAR)
         FROM orders WHERE o_orderkey % 2 = 0""",
)
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("question"),
        F.col("o_orderpriority").alias("problem"),
        F.concat("o_orderstatus", F.lit("<<1+1=2>>")).alias("cot"),
        F.concat(F.lit(" 1,"), key).alias("number"),
        F.array(F.concat("o_orderstatus", F.lit(" ")), F.lit("none")).alias("options"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("So. The answer is \\boxed{"), key, F.lit("}")))
        .otherwise("Unknown. No result")
        .alias("solution"),
    )
    school = B.to_messages(rows.withColumn("answer", F.trim("number")), "grade_school")
    stem = B.to_messages(rows.withColumn("answer", F.lit("B")), "stem")
    math = B.to_messages(rows, "math").withColumn("answer", F.array_join("answer", "|"))
    out = None
    for fmt, df in (("grade_school", school), ("stem", stem), ("math", math)):
        part = df.select(
            "o_orderkey",
            F.lit(fmt).alias("fmt"),
            F.col("messages")[0]["content"].alias("ask"),
            F.col("messages")[1]["content"].alias("said"),
            "answer",
        )
        out = part if out is None else out.unionByName(part)
    return out


ASK = "chr(10) || 'What of the following is the right choice? Explain your answer.' || chr(10)"
# first three lines of a text, each without outer blanks; null where there is none
THREE = "(SELECT doc_id, trim(l[1]) AS a, trim(l[2]) AS b, trim(l[3]) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(
    "b28_to_messages_forms",
    f"""WITH x AS {THREE},
        o AS (SELECT *, 'A) ' || b || ' B) ' || c AS sat, left(b, 1) || ') ' || b AS odd FROM x)
        SELECT doc_id, 'sat' AS fmt, a || {ASK} || '(' || replace(replace(s, ' B) ', ' (B) '), ' C) ', ' (C) ') AS ask, 'B' AS said, 'B' AS answer
          FROM (SELECT *, CASE WHEN a LIKE 'T%' THEN sat ELSE odd END AS s FROM o) WHERE s LIKE 'A%'
        UNION ALL SELECT doc_id, 'courseware', a, b, c FROM x WHERE c IS NOT NULL AND b IS NOT NULL
        UNION ALL SELECT doc_id, 'chinese', a, '', replace(b, ',', '') FROM x WHERE b IS NOT NULL
        UNION ALL SELECT doc_id, 'multilingual', NULL, NULL, replace(b, ',', '') FROM x WHERE b IS NOT NULL
        UNION ALL SELECT doc_id, 'cloze', a, '', CAST(length(a) AS VARCHAR) || '|' || CAST(length(b) AS VARCHAR) FROM x WHERE b IS NOT NULL
        UNION ALL SELECT doc_id, 'mathqa', a || chr(10) || '[''A: ' || b || chr(39) || ', ' || chr(39) || left(c, 1) || ': ' || c || chr(39) || ']', '', 'A' FROM x WHERE b IS NOT NULL AND left(c, 1) IN ('A', 'B', 'C', 'D')
        UNION ALL SELECT doc_id, 'mathqa_shots', a || chr(10) || '从以下选项中选择:    ' || '(A)' || b || ' (B)' || c, '', 'A' FROM x WHERE b IS NOT NULL AND c IS NOT NULL
        UNION ALL SELECT doc_id, 'formal', '(*### Problem' || chr(10) || chr(10) || a || chr(10) || chr(10) || '### Solution' || chr(10) || chr(10) || b || ' *)' || chr(10) || chr(10) || 'Formal:' || chr(10) || c,
          '', 'placeholder' FROM x WHERE b IS NOT NULL AND c IS NOT NULL""",
)
def _(spark, sf):
    lines = F.split("text", "\n")
    docs = table(spark, sf, "documents").select("doc_id", *[F.get(lines, F.lit(i)).alias(n) for i, n in enumerate("abc")])
    text = lambda *parts: F.concat(*[F.col(p) if p in "abc" else F.lit(p) for p in parts])
    odd = F.concat(F.left(F.btrim("b"), F.lit(1)), F.lit(") "), F.btrim("b"))
    size = lambda c, end: F.concat(F.length(F.btrim(c)).cast("string"), F.lit(end))
    lettered = F.concat(F.lit("("), F.left(F.btrim("c"), F.lit(1)), F.lit(") "), F.col("c"))
    known = F.col("b").isNotNull() & F.col("c").isNotNull()
    sides = {"question": F.col("a"), "problem": F.col("a"), "solution": F.col("b")}
    forms = {
        "sat": {"options": F.when(F.btrim("a").startswith("T"), text(" A) ", "b", " B) ", "c")).otherwise(odd), "answer": F.lit("B")},
        "courseware": {"answer": F.when(known, F.btrim("c"))},
        "chinese": {"golden": F.col("b")},
        "multilingual": {"answer": F.btrim("b"), "messages": F.lit(None).cast("array<struct<role:string,content:string>>")},
        "cloze": {"answer": F.concat(size("a", ".00"), F.lit(" ; "), size("b", ".0"))},
        "mathqa": {"options": F.array(text("(A)", "b"), lettered), "label": F.when(known, "A")},
        "mathqa_shots": {
            "question": text("a", "\\"),
            "options": F.array(text("(A)", "b"), text(" (B)", "c")),
            "label": F.when(known, "A"),
        },
        "formal": {n: F.col(c) for n, c in (("informal_statement", "a"), ("informal_proof", "b"), ("formal_statement", "c"))},
    }
    out = None
    for fmt, columns in forms.items():
        rows = B.to_messages(docs.where(known if fmt == "formal" else F.lit(True)).withColumns({**sides, **columns}), fmt)
        answer = F.array_join("answer", "|") if fmt == "cloze" else F.col("answer")
        said = [F.get("messages", F.lit(i))["content"].alias(n) for i, n in ((0, "ask"), (1, "said"))]
        part = rows.select("doc_id", F.lit(fmt).alias("fmt"), *said, answer.alias("answer"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b29_format_release",
    """SELECT p_partkey, p_brand AS subdomain, 'parts' AS source FROM part WHERE p_size % 3 <> 0""",
)
def _(spark, sf):
    path = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat_ws(" -> ", "p_type", "p_name", "p_brand"))
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("problem"),
        F.col("p_type").alias("solution"),
        path.alias("domain"),
        F.col("p_size").alias("difficulty"),
    )
    return B.format_release(rows, "domain", "parts").select("p_partkey", "subdomain", "source")


FIRST = "substr(sha256(concat_ws('|', p_name, '0')), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')"


@query(
    "b30_seeded_pair",
    f"""SELECT p_partkey, CASE WHEN {FIRST} THEN p_name ELSE p_type END AS scenario_1, CASE WHEN {FIRST} THEN p_type ELSE p_name END AS scenario_2,
        CAST({FIRST} AS INT) AS label FROM part""",
)
def _(spark, sf):
    out = B.seeded_pair(table(spark, sf, "part"), "p_name", "p_type")
    return out.select("p_partkey", "scenario_1", "scenario_2", "label")


@query(
    "b31_to_choices",
    """SELECT p_partkey, p_brand || ': ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS query, p_name || '|' || p_type AS choices,
       CAST(p_size AS INT) AS gold FROM part""",
)
def _(spark, sf):
    ask = F.concat("p_brand", F.lit(": "), B.capitalize(F.col("p_type")))
    out = B.to_choices(table(spark, sf, "part"), ask, ["p_name", "p_type"], "p_size", "brackets")
    return out.select("p_partkey", "query", F.array_join("choices", "|").alias("choices"), "gold")


@query(
    "b32_prepare_pair",
    """WITH p AS (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS a, role FROM conversations WHERE text <> '')
       SELECT conv_id, turn, regexp_replace(trim(regexp_replace(a, ' ([''.,])', '\\1', 'g')), '[.,;]$', '') AS first,
         'the ' || role || ' .' AS second FROM p""",
)
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("first"),
        F.concat(F.lit(" The "), "role", F.lit("  .")).alias("second"),
    )
    out = B.prepare_pair(rows, "first", "second")
    return out.select("conv_id", "turn", "first", B.squeeze_spaces(F.col("second")).alias("second"))
