"""Answer extraction and comparison on responses that Spark derives from the tables."""

from pyspark.sql import functions as F

from assayline.functions import answers as X
from assayline.functions.math_text import normalize_math
from assayline.queries import query, table
from assayline.queries.sqltext import word_list


def text(*parts):
    """Concatenate columns (names starting with ``@``) and literal texts."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts])


def orders(spark, sf, **cols):
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", *[c.alias(n) for n, c in cols.items()])


def case(col, *values):
    """Value by ``o_orderkey % n``."""
    rest, out = F.pmod(F.col(col), F.lit(len(values))), None
    for i, v in enumerate(values):
        out = F.when(rest == i, v) if out is None else out.when(rest == i, v)
    return out


@query(
    "f1_parse_verdict",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Yes' END AS strict,
       CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' END AS lenient FROM orders""",
)
def _(spark, sf):
    said = case(
        "o_orderkey",
        text("@o_orderpriority", "\nYes"),
        text("@o_orderpriority", "\n No. \nbecause ", "@o_orderpriority"),
        text("I say yes, not eyes: ", "@o_orderpriority"),
        text("Nothing here: ", "@o_orderpriority"),
    )
    rows = orders(spark, sf, said=F.regexp_replace(said, "NOT ", ""))
    return rows.select(
        "o_orderkey",
        X.parse_verdict(F.col("said")).alias("strict"),
        X.parse_verdict(F.col("said"), strict=False).alias("lenient"),
    )


@query(
    "f2_trailing_code",
    """SELECT o_orderkey, nullif(regexp_extract(CAST(o_orderkey AS VARCHAR), '(\\d{2})$', 1), '') AS code FROM orders""",
)
def _(spark, sf):
    rows = orders(spark, sf, said=text("Subject ", "@o_orderpriority", "\ncode ", "@o_orderkey"))
    return rows.select("o_orderkey", X.trailing_code(F.col("said")).alias("code"))


@query(
    "f3_after_marker",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ' end' WHEN 1 THEN text || chr(10) || 'last' ELSE text END AS answer FROM conversations""",
)
def _(spark, sf):
    said = case(
        "turn",
        text("<|im_start|>answer\nfirst", "<|im_start|>answer\n", "@role", " end"),
        text("x<|im_start|>final part\n", "@text", "\nlast"),
        text("@text"),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", X.after_marker(said).alias("answer"))


@query(
    "f4_last_boxed",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '\\frac{' || CAST(o_orderkey AS VARCHAR) || '}{2}' WHEN 1 THEN CAST(o_orderkey AS VARCHAR)
       WHEN 2 THEN '{a}' || o_orderstatus WHEN 3 THEN '7 ' END AS answer FROM orders""",
)
def _(spark, sf):
    said = case(
        "o_orderkey",
        text("first \\boxed{1}, then \\boxed{\\frac{", "@o_orderkey", "}{2}} done}"),
        text("\\fbox{", "@o_orderkey", "}"),
        text("\\boxed{{a}", "@o_orderstatus", "} "),
        text("so \\boxed 7 $ ", "@o_orderkey"),
        text("open \\boxed{", "@o_orderkey"),
    )
    return orders(spark, sf, said=said).select("o_orderkey", X.last_boxed(F.col("said")).alias("answer"))


@query(
    "f5_extract_answer",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '\\frac{1}{' || CAST(o_orderkey AS VARCHAR) || '}'
       WHEN 2 THEN 'x' || CAST(o_orderkey AS VARCHAR) WHEN 3 THEN CAST(o_orderkey AS VARCHAR) WHEN 4 THEN '-' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS answer FROM orders""",
)
def _(spark, sf):
    said = case(
        "o_orderkey",
        text("The final answer is $", "@o_orderkey", "$. I hope it is correct."),
        text("\\boxed{3} and \\boxed{1/", "@o_orderkey", "}"),
        text("The answer is: x ", "@o_orderkey", ".\nmore"),
        text("```output\n", "@o_orderkey", "\n```\ntail"),
        text("first 3 then -", "@o_orderkey", " items"),
        text("@o_orderstatus"),
    )
    return orders(spark, sf, said=said).select("o_orderkey", X.extract_answer(F.col("said")).alias("answer"))


@query(
    "f6_answer_line",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) || role END AS answer FROM conversations""",
)
def _(spark, sf):
    said = case("turn", text("thus ANSWER : ", "@text", "\n", "@role"), text("@text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.trim("text").alias("raw"), said.alias("said"))
    return rows.select("conv_id", "turn", X.answer_line(F.col("said")).alias("answer"))


@query(
    "f7_regex_filter",
    """SELECT doc_id, coalesce(trim(regexp_extract_all(text, '(\\w+)\\.', 1)[1]), '[invalid]') AS first_match,
       coalesce(trim(regexp_extract_all(text, '(\\w+)\\.', 1)[-1]), '[invalid]') AS last_match,
       CASE WHEN len(regexp_extract_all(text, 'zzq')) > 0 THEN 'zzq' ELSE '[invalid]' END AS none
       FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM documents)""",
)
def _(spark, sf):
    plain = F.regexp_replace("text", "[^ -~]", "x")
    rows = table(spark, sf, "documents").select("doc_id", plain.alias("text"))
    t = F.col("text")
    return rows.select(
        "doc_id",
        X.regex_filter(t, r"(\w+)\.").alias("first_match"),
        X.regex_filter(t, r"(\w+)\.", -1).alias("last_match"),
        X.regex_filter(t, "zzq").alias("none"),
    )


@query(
    "f8_choice_regex",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '(B)' WHEN 1 THEN '(C)' WHEN 2 THEN '(A)' ELSE '[invalid]' END AS letter FROM part""",
)
def _(spark, sf):
    said = case(
        "p_partkey",
        text("I choose (B) although ", "@p_name"),
        text("It must be ", "@p_name", "!"),
        text("Answer:  A"),
        text("no idea"),
    )
    rows = table(spark, sf, "part").select(
        "p_partkey", said.alias("said"), F.array("p_brand", "p_type", F.concat(F.lit(" "), "p_name")).alias("choices")
    )
    out = X.choice_regex(F.col("said"), r"(\([A-Z]\))", F.col("choices"), ignore_case=False)
    return rows.select("p_partkey", out.alias("letter"))


@query(
    "f9_map_regex",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'now' WHEN o_orderpriority LIKE '%HIGH%' THEN 'soon' ELSE '[invalid]' END AS value FROM orders""",
)
def _(spark, sf):
    mapped = X.map_regex(text("It is ", "@o_orderpriority", "!"), {"urgent": "now", "hi(?:gh)": "soon"}, ignore_case=True)
    return table(spark, sf, "orders").select("o_orderkey", mapped.alias("value"))


@query(
    "f10_number_filter",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '2345' WHEN 2 THEN '1000017' ELSE '[invalid]' END AS number FROM part""",
)
def _(spark, sf):
    said = case(
        "p_partkey",
        text("count: ", "@p_partkey"),
        text("Two thousand, three hundred and forty-five ", "@p_name"),
        text("about one million seventeen"),
        text("few ", "@p_name"),
    )
    rows = table(spark, sf, "part").select("p_partkey", said.alias("said"))
    return rows.select("p_partkey", X.number_filter(F.col("said"), r"\d+").alias("number"))


@query(
    "f11_word_order",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'bolt cold ' || p_type ELSE p_type || ' cold' END AS sorted FROM part""",
)
def _(spark, sf):
    ask = text("Sort. List: cold bolt ", "@p_type")
    said = case(
        "p_partkey",
        text("cold bolts, bolt cold and ", "@p_type"),
        text("cold ", "@p_type", " then cold"),
    )
    rows = table(spark, sf, "part").select("p_partkey", ask.alias("ask"), said.alias("said"))
    return rows.select("p_partkey", X.word_order(F.col("said"), X.listed_words(F.col("ask"))).alias("sorted"))


@query(
    "f12_map_values",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '?' END AS mapped,
       lower(o_orderpriority) AS low, upper(o_orderpriority) AS up, o_orderpriority AS trimmed FROM orders""",
)
def _(spark, sf):
    priority = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        X.map_values(F.col("o_orderstatus"), {"F": "done", "O": "open"}, "?").alias("mapped"),
        F.lower(priority).alias("low"),
        F.upper(priority).alias("up"),
        X.ltrim_space(F.concat(F.lit("\n "), priority)).alias("trimmed"),
    )


@query(
    "f13_normalize_math",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders)
       SELECT o_orderkey,
        CASE o_orderkey % 4 WHEN 0 THEN '\\frac{1}{2}' || k WHEN 1 THEN '\\frac{3}{4}' WHEN 2 THEN k || '0.5' ELSE '\\sqrt{3}' || k END AS competition,
        CASE o_orderkey % 4 WHEN 0 THEN '\\frac{1}{2}' || k WHEN 1 THEN '3/4' WHEN 2 THEN k || '.5' ELSE '\\sqrt{3}' || k END AS quantitative,
        CASE o_orderkey % 4 WHEN 0 THEN '\\frac12' || k WHEN 1 THEN 'x=3/4' WHEN 2 THEN k || '.5' ELSE '\\sqrt3' || k END AS grader,
        CASE o_orderkey % 4 WHEN 0 THEN '\\frac{1}{2}' || k WHEN 1 THEN 'x=3/4' WHEN 2 THEN k || '0.5' ELSE '\\sqrt{3' || k || '}' END AS extraction
       FROM o""",
)
def _(spark, sf):
    said = case(
        "o_orderkey",
        text("\\frac12", "@o_orderkey"),
        text("x=3/4"),
        text("@o_orderkey", " .5"),
        text("\\sqrt3", "@o_orderkey"),
    )
    rows = orders(spark, sf, said=said)
    kinds = ("competition", "quantitative", "grader", "extraction")
    return rows.select("o_orderkey", *[normalize_math(F.col("said"), k).alias(k) for k in kinds])


@query(
    "f14_answers_match",
    "SELECT o_orderkey, o_orderkey % 5 < 3 AS ok FROM orders",
)
def _(spark, sf):
    half = F.concat((F.col("o_orderkey") / 2).cast("string"))
    said = case(
        "o_orderkey",
        text("so \\boxed{$ 1,", "@o_orderkey", " $}."),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("/2")),
        text("ABC ", "@o_orderkey", "."),
        text("@o_orderkey", "9"),
        text("about ", "@o_orderkey"),
    )
    truth = case("o_orderkey", text("1", "@o_orderkey"), half, text("abc", "@o_orderkey"), text("@o_orderkey"), F.lit(""))
    rows = orders(spark, sf, said=said, truth=truth)
    return rows.select("o_orderkey", X.answers_match(F.col("said"), F.col("truth")).alias("ok"))


@query("f15_grade_tuple", "SELECT o_orderkey, o_orderkey % 5 < 3 AS ok FROM orders")
def _(spark, sf):
    said = case(
        "o_orderkey",
        text("( 1, ", "@o_orderkey", ")"),
        text("1,000 meters"),
        text("\\text{Red ", "@o_orderkey", "}"),
        text("[1,", "@o_orderkey", ")"),
        text("@o_orderkey", " or 7"),
    )
    truth = case(
        "o_orderkey",
        text("(1,", "@o_orderkey", ")"),
        text("1000"),
        text("red ", "@o_orderkey"),
        text("(1,", "@o_orderkey", ")"),
        text("@o_orderkey"),
    )
    rows = orders(spark, sf, said=said, truth=truth)
    return rows.select("o_orderkey", X.grade_tuple(F.col("said"), F.col("truth")).alias("ok"))


@query(
    "f16_phrase_answer",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey % 2 = 0 AS e FROM orders)
       SELECT o_orderkey, CASE WHEN e THEN '1' || k ELSE '[invalid]' END AS grade_school, CASE WHEN e THEN k END AS grade_school_gold,
         CASE WHEN e THEN 'x ' || k ELSE '[invalid]' END AS step_reward, CASE WHEN e THEN k ELSE '[invalidanswer]' END AS final_sentence,
         CASE WHEN e THEN 'B' ELSE 'placeholder' END AS letter, CASE WHEN e THEN 'km ' || k ELSE '[invalid]' END AS courseware,
         CASE WHEN e THEN k ELSE 'placeholder' END AS chinese_cloze, CASE WHEN e THEN k ELSE k END AS chinese_number,
         CASE WHEN e THEN k ELSE '[invalid]' END AS tree FROM o""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders")
    either = lambda *parts: case("o_orderkey", text(*parts), text("nothing ", "@o_orderkey"))
    said = {
        "grade_school": either("The answer is: 1,", "@o_orderkey", " apples"),
        "grade_school_gold": either("steps\n#### ", "@o_orderkey"),
        "step_reward": either("The answer is: x ", "@o_orderkey", " ки\n"),
        "final_sentence": either("Final Answer: The final answer is ", "@o_orderkey", ". "),
        "letter": either("The final answer is (B) Problem: the final answer is (C)"),
        "courseware": either("The final answer is km ", "@o_orderkey", ". I hope it is correct."),
        "chinese_cloze": either("所以答案是 $", "@o_orderkey", "$\n问题 2"),
        "chinese_number": either("答案是：", "@o_orderkey", "个。"),
        "tree": either("step\nAnswer: ", "@o_orderkey", "<|im_end|>\n"),
    }
    wide = rows.select("o_orderkey", *[c.alias(n) for n, c in said.items()])
    return wide.select("o_orderkey", *[X.phrase_answer(F.col(n), n).alias(n) for n in said])


@query(
    "f16_phrases_in_texts",
    """WITH t AS (SELECT doc_id, n_chars, replace(text, chr(10), ' ') AS line, text FROM documents),
         s AS (SELECT doc_id, line || ' ' || n_chars || '.5 or -' || doc_id || ' Q: ' || n_chars AS shots,
           'The answer is: ' || line || chr(10) || chr(10) || 'rest' AS para,
           trim(regexp_replace(text, '^\\s+', '')) AS body FROM t)
       SELECT doc_id, regexp_extract_all(split_part(shots, 'Q: ', 1), '-?\\d+\\.?\\d*')[-1] AS grade_school_shots,
         coalesce(nullif(trim(replace(regexp_extract(para, 'The answer is:(.+)\\n\\n', 1), ',', '')), ''), '[invalid]') AS paragraph,
         regexp_replace(split_part(body, chr(10), 1), '\\s+$', '') AS chinese_choice,
         regexp_replace(body, '\\s+$', '') AS formal FROM s""",
)
def _(spark, sf):
    line = F.translate("text", "\n", " ")
    said = {
        "grade_school_shots": F.concat(line, F.lit(" "), "n_chars", F.lit(".5 or -"), "doc_id", F.lit(" Q: "), "n_chars"),
        "paragraph": F.concat(F.lit("The answer is: "), line, F.lit("\n\nrest")),
        "chinese_choice": F.concat(F.lit("所以答案是"), "text", F.lit("\n问题 3")),
        "formal": F.concat("text", F.lit("\nInformal: other words")),
    }
    wide = table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in said.items()])
    return wide.select("doc_id", *[X.phrase_answer(F.col(n), n).alias(n) for n in said])


@query(
    "f17_between",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS inner_text, role || ' tail' AS rest, text AS bare FROM conversations""",
)
def _(spark, sf):
    said = case("turn", text("<a> ", "@role", " </a> tail"), text("<a> ", "@role", " tail"))
    token = text("@text", "<|reserved_special_token_1|>")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        X.between(said, "<a>", "</a>").alias("inner_text"),
        X.between(F.replace(said, F.lit(" </a>"), F.lit("")), "<a>").alias("rest"),
        X.strip_tokens(token).alias("bare"),
    )


@query(
    "f18_numbers_in",
    """SELECT o_orderkey, '12,345|6e3|345|' || CAST(o_orderkey AS VARCHAR) || '|3|0.25' AS numbers FROM orders""",
)
def _(spark, sf):
    said = text("a 12,345 b ", "@o_orderkey", " c 6e3 d 0.25")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(X.numbers_in(said), "|").alias("numbers"))


@query(
    "f19_score_map",
    """SELECT o_orderkey, 'Joy=' || CAST(o_orderkey % 10 AS VARCHAR) || '.0,Fear=4.0' AS scores FROM orders""",
)
def _(spark, sf):
    said = text("Joy: 99\nFear: 4 Joy: ", "@o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.regexp_replace(said, r"(\d)*(\d)$", "$2").alias("said"))
    entries = F.transform(F.map_entries(X.score_map(F.col("said"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("o_orderkey", F.array_join(entries, ",").alias("scores"))


@query(
    "f20_keyed_answers",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'a'': ' || o_orderstatus || '''' END AS a,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS b FROM orders""",
)
def _(spark, sf):
    said = case(
        "o_orderkey",
        text("Sure {'a': '", "@o_orderstatus", "', 'b': '", "@o_orderkey", "'"),
        text("'a': ", "@o_orderstatus", "', and so on"),
    )
    rows = orders(spark, sf, said=said)
    found = X.keyed_answers(F.col("said"), F.array(F.lit("a"), F.lit("b")))
    return rows.select("o_orderkey", found["a"].alias("a"), found["b"].alias("b"))


def qa_sql(col: str, articles: str) -> str:
    bare = f"regexp_replace(lower({col}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter({word_list(bare)}, lambda x: x NOT IN ({articles})), ' ')"


EN, FR = "'a', 'an', 'the'", "'un', 'une', 'des', 'le', 'la', 'les'"


@query(
    "f21_normalize_qa",
    f"SELECT doc_id, {qa_sql('text', EN)} AS en, {qa_sql('text', FR)} AS fr FROM documents",
)
def _(spark, sf):
    text_col = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", X.normalize_qa(text_col).alias("en"), X.normalize_qa(text_col, "fr").alias("fr")
    )
