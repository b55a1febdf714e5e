"""Answer extraction from completions and answer comparison."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline import fixed_values as V
from assayline.functions.math_text import normalize_math, strip_grouping_commas
from assayline.functions.rewrite import let, trim_space
from assayline.functions.text import words

STRINGS = T.ArrayType(T.StringType())


def last_of(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


# --- verdicts and markers --------------------------------------------------------


def parse_verdict(col: Column, strict: bool = True) -> Column:
    """Yes/No of a grader completion: the last line, exactly (strict); or the last
    line that is one once trimmed, else the first of the words yes, no found."""
    lines = F.split(col, "\n")
    if strict:
        return F.when(last_of(lines).isin("Yes", "No"), last_of(lines))
    bare = F.transform(lines, lambda x: trim_space(F.btrim(trim_space(x), F.lit("."))))
    said = last_of(F.filter(bare, lambda x: x.isin("Yes", "No")))
    low = F.lower(col)
    return F.coalesce(
        said,
        F.when(low.rlike(r"\byes\b"), F.lit("Yes")).when(low.rlike(r"\bno\b"), F.lit("No")),
    )


def trailing_code(col: Column) -> Column:
    """Two-digit code at the very end, else null."""
    return F.nullif(F.regexp_extract(col, r"(\d{2})\z", 1), F.lit(""))


def after_marker(col: Column, markers: Sequence[str] = tuple(V.ANSWER_MARKERS)) -> Column:
    """Text after the last answer marker; after the generic marker the first line,
    which names the section, is dropped."""
    named, generic = markers
    rest = F.substring_index(col, generic, -1)
    rest = F.regexp_replace(rest, r"(?s)^[^\n]*\n", "")
    return (
        F.when(col.contains(named), F.substring_index(col, named, -1))
        .when(col.contains(generic), rest)
        .otherwise(col)
    )


# --- boxes ----------------------------------------------------------------------


def _balanced(text: str, start: int) -> int:
    """Position of the brace that closes the first one opened from ``start``, or -1."""
    depth = 0
    for i in range(start, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i
    return -1


def _last_box(text: str | None) -> str | None:
    if text is None:
        return None
    if "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$")[0]
    start = text.rfind("\\boxed")
    if start < 0:
        start = text.rfind("\\fbox")
    end = _balanced(text, start) if start >= 0 else -1
    if end < 0:
        return None
    return text[text.index("{", start) + 1 : end]


def _all_boxes(text: str | None) -> list[str] | None:
    if text is None:
        return None
    found = []
    for piece in text.split("boxed{")[1:]:
        end = _balanced("{" + piece, 0) - 1
        if end >= 0:
            percent = piece[end + 1 : end + 2] == "%"
            found.append(piece[: end + 1] if percent else piece[:end])
    return found


@F.pandas_udf(T.StringType())
def last_boxed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Content of the last box with balanced braces; null when there is none."""
    for batch in texts:
        yield batch.map(_last_box)


@F.pandas_udf(STRINGS)
def all_boxed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(_all_boxes)


def normalize_extracted(col: Column) -> Column:
    return normalize_math(col, "extraction")


def _tidy(ans: Column) -> Column:
    line = F.substring_index(trim_space(ans), "\n", 1)
    line = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "^:+", ""), r"\.+$", ""), "/+$", "")
    return normalize_extracted(line)


def extract_answers(col: Column) -> Column:
    """All answers of a completion: final-answer phrase, else boxes, else the text
    after the last "he answer is", else program output, else the last number."""
    first_phrase = F.substring(
        col, F.locate("final answer is $", col) + len("final answer is $"), F.length(col)
    )
    sentence = F.array(trim_space(F.substring_index(first_phrase, "$. I hope", 1)))
    said = F.array(trim_space(F.substring_index(col, "he answer is", -1)))
    output = trim_space(F.substring_index(F.substring_index(col, "```output", -1), "```", 1))
    numbers = F.regexp_extract_all(
        F.replace(col, F.lit(","), F.lit("")), F.lit(r"-?\d*\.?\d+"), F.lit(0)
    )
    number = F.when(F.size(numbers) > 0, F.array(last_of(numbers))).otherwise(
        F.array().cast("array<string>")
    )
    raw = (
        F.when(col.contains("final answer is $") & col.contains("$. I hope"), sentence)
        .when(col.contains("boxed"), all_boxed(col))
        .when(col.contains("he answer is"), said)
        .when(col.contains("```output") & (output != ""), F.array(output))
        .otherwise(number)
    )
    return raw


def extract_answer(col: Column, exhaust: bool = False) -> Column:
    """Normalized answers (``exhaust``), or the last of them ("" when none)."""
    tidy = F.transform(extract_answers(col), _tidy)
    return tidy if exhaust else F.coalesce(last_of(tidy), F.lit(""))


def math_answers(question: Column, reasoning: Column) -> Column:
    """Gold answers of a solution, split where the question asks for a list."""
    listed = question.contains("separated by commas")
    both = r"\\text\{\s*and\s*\}"

    def parts(a: Column) -> Column:
        by_comma = F.transform(F.split(a, ","), trim_space)
        by_and = F.transform(F.split(a, both), trim_space)
        return (
            F.when(listed & ~a.rlike(r"[()\[\]]"), by_comma)
            .when(a.rlike(both), by_and)
            .otherwise(F.array(trim_space(a)))
        )

    return F.flatten(F.transform(extract_answer(reasoning, True), parts))


# --- regex filters ----------------------------------------------------------------


def _nth(arr: Column, n: int) -> Column:
    return F.try_element_at(arr, F.lit(n + 1 if n >= 0 else n))


def answer_line(col: Column) -> Column:
    """Text after ``Answer:`` up to the end, line breaks included; null when absent."""
    return last_of(F.regexp_extract_all(col, F.lit(V.ANSWER_LINE), F.lit(1)))


def find_match(col: Column, pattern: str, group_select: int = 0) -> Column:
    """n-th match (negative from the end), first non-empty group, trimmed; or null."""
    groups = re.compile(pattern).groups
    numbers = [0] if groups == 0 else range(1, groups + 1)
    found = [
        _nth(F.regexp_extract_all(col, F.lit(pattern), F.lit(g)), group_select) for g in numbers
    ]
    if len(found) > 1:
        found = [F.nullif(f, F.lit("")) for f in found]
    return trim_space(F.coalesce(*found))


def regex_filter(
    col: Column, pattern: str, group_select: int = 0, fallback: str = V.INVALID
) -> Column:
    return F.coalesce(find_match(col, pattern, group_select), F.lit(fallback))


def _ignore(col: Column, ignore_case: bool, ignore_punct: bool, regexes: Sequence[str]) -> Column:
    out = col
    for r in regexes:
        out = F.regexp_replace(out, r, "")
    if ignore_case:
        out = F.lower(out)
    if ignore_punct:
        out = F.regexp_replace(out, r"\p{P}+", "")
    return out


def quoted(col: Column) -> Column:
    """Pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), col, F.lit("\\E"))


def choice_regex(
    col: Column,
    pattern: str,
    choices: Column,
    group_select: int = 0,
    fallback: str = V.INVALID,
    ignore_case: bool = False,
    ignore_punct: bool = False,
    regexes: Sequence[str] = (),
) -> Column:
    """Letter of a multiple-choice response, as ``(A)``: the pattern, else an option
    text found in the response, else a letter after a colon."""
    tidy = lambda c: _ignore(c, ignore_case, ignore_punct, regexes)
    options = F.transform(choices, lambda c: tidy(trim_space(c)))
    either = F.array_join(F.transform(options, quoted), "|")
    hit = _nth(F.regexp_extract_all(tidy(col), either, F.lit(0)), group_select)
    # an option text given twice stands for its last place
    from_end = F.array_position(F.reverse(options), trim_space(hit))
    place = F.size(options) - from_end
    as_letter = lambda i: F.concat(F.lit("("), F.char(i + 65), F.lit(")"))
    by_text = F.when(from_end > 0, as_letter(place)).otherwise(F.nullif(hit, F.lit("")))
    top = F.char(F.size(options) + 64)
    colon = F.concat(F.lit(r":\s*([A-"), top, F.lit("])"))
    by_colon = _nth(F.regexp_extract_all(col, colon, F.lit(1)), group_select)
    return F.coalesce(
        F.nullif(find_match(col, pattern, group_select), F.lit("")),
        by_text,
        F.concat(F.lit("("), by_colon, F.lit(")")),
        F.lit(fallback),
    )


def map_regex(
    col: Column,
    patterns: Mapping[str, str],
    group_select: int = 0,
    fallback: str = V.INVALID,
    ignore_case: bool = False,
    ignore_punct: bool = False,
) -> Column:
    """Value of the first pattern that holds in the selected match of any pattern."""
    whole = find_match(_ignore(col, ignore_case, ignore_punct, ()), "|".join(patterns), group_select)
    value = F.lit(None).cast("string")
    for pattern, name in reversed(list(patterns.items())):
        value = F.when(whole.rlike(pattern), F.lit(name)).otherwise(value)
    return F.coalesce(value, F.lit(fallback))


_UNITS = {w: i for i, w in enumerate(V.NUMBER_UNITS)}
_TENS = {w: 10 * (i + 2) for i, w in enumerate(V.NUMBER_TENS)}
_WORDS = [*_UNITS, *_TENS, "hundred", *V.NUMBER_SCALES]
_RUN = re.compile(
    r"(?:{0})(?:(?:[^\S\r\n]|,|-|and|&)+(?:{0}))*".format(
        "|".join(sorted(_WORDS, key=len, reverse=True))
    )
)


def _words_to_number(text: str | None) -> str | None:
    run = _RUN.search(text.lower()) if text else None
    if run is None:
        return None
    total = part = 0
    for word in re.findall("[a-z]+", run.group()):
        if word in V.NUMBER_SCALES:
            total, part = total + max(part, 1) * V.NUMBER_SCALES[word], 0
        elif word == "hundred":
            part = max(part, 1) * 100
        elif word != "and":
            part += _UNITS.get(word, _TENS.get(word, 0))
    return str(total + part)


@F.pandas_udf(T.StringType())
def number_words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """First number written in English words, as digits; null when there is none."""
    for batch in texts:
        yield batch.map(_words_to_number)


def number_filter(col: Column, pattern: str, group_select: int = 0, fallback: str = V.INVALID) -> Column:
    """Number by pattern, else from number words, else the fallback."""
    digits = F.nullif(find_match(col, pattern, group_select), F.lit(""))
    return F.coalesce(digits, number_words(col), F.lit(fallback))


def word_order(col: Column, listed: Column) -> Column:
    """Listed words in response order; of repeated mentions the last counts."""
    bounded = F.transform(listed, lambda w: F.concat(F.lit(r"\b"), quoted(w), F.lit(r"\b")))
    found = F.regexp_extract_all(col, F.array_join(bounded, "|"), F.lit(0))
    return F.array_join(F.reverse(F.array_distinct(F.reverse(found))), " ")


def listed_words(col: Column) -> Column:
    """Words of the question after ``List:``."""
    return words(F.substring_index(F.substring_index(col, "List:", 2), "List:", -1))


def map_values(col: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), col)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def ltrim_space(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+", "")


# --- comparison --------------------------------------------------------------------


def simple_answer(col: Column) -> Column:
    boxed = last_of(F.regexp_extract_all(col, F.lit(V.BOXED_FLAT), F.lit(1)))
    bare = F.translate(F.coalesce(boxed, trim_space(col), F.lit("")), ",$ ", "")
    return F.lower(F.regexp_replace(trim_space(bare), r"\.+$", ""))


def answer_number(col: Column) -> Column:
    shape = r"^(-?\d+)\s*/\s*(\d+)$"
    top = F.regexp_extract(col, shape, 1).try_cast("double")
    low = F.regexp_extract(col, shape, 2).try_cast("double")
    return F.when(col.rlike(shape), F.try_divide(top, low)).otherwise(col.try_cast("double"))


def answers_match(pred: Column, ref: Column) -> Column:
    """Equal after light cleaning, or equal numbers within 1e-6."""

    def same(pair: Column) -> Column:
        p, r = pair["p"], pair["r"]
        near = F.abs(answer_number(p) - answer_number(r)) < 1e-6
        return (r != "") & ((p == r) | F.coalesce(near, F.lit(False)))

    return let(F.struct(simple_answer(pred).alias("p"), simple_answer(ref).alias("r")), same)


def tuple_parts(col: Column) -> Column:
    """Elements of a tuple or interval, else the text itself."""

    def parts(flat: Column) -> Column:
        inner = F.substring(flat, F.lit(2), F.greatest(F.length(flat) - 2, F.lit(0)))
        is_tuple = flat.rlike(r"^[()\[\]].+[()\[\]]$") & ~inner.rlike(r"[()\[\]]")
        empty = F.array().cast("array<string>")
        listed = F.transform(F.split(inner, ","), trim_space)
        return F.when(flat == "", empty).when(is_tuple, listed).otherwise(F.array(flat))

    return let(strip_grouping_commas(col), parts)


def grade_tuple(given: Column, truth: Column) -> Column:
    """Normalized equality, else equal fractions element by element in the same
    brackets. Symbolic equality is not tried."""
    text = lambda c: trim_space(F.regexp_replace(trim_space(c), r"^\\text\{(.+?)\}$", "$1"))
    no = F.lit(False)
    same = normalize_math(text(given), "competition") == normalize_math(text(truth), "competition")
    frac = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"

    def by_text(x: Column) -> Column:
        end = lambda c: F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
        both = F.struct(
            tuple_parts(x["g"]).alias("g"), tuple_parts(x["t"]).alias("t"),
            (end(x["g"]) == end(x["t"])).alias("ends"),
        )
        return F.coalesce(x["g"] == x["t"], no) | ((x["g"] != "") & let(both, by_part))

    def by_part(x: Column) -> Column:
        pairs = F.zip_with(x["g"], x["t"], lambda a, b: a.rlike(frac) & b.rlike(frac) & (a == b))
        sizes = (F.size(x["t"]) > 0) & (F.size(x["g"]) == F.size(x["t"]))
        return ((F.size(x["t"]) == 1) | x["ends"]) & sizes & F.forall(pairs, lambda p: F.coalesce(p, no))

    forms = F.struct(
        normalize_math(given, "grader").alias("g"), normalize_math(truth, "grader").alias("t")
    )
    return F.coalesce(same, no) | F.coalesce(let(forms, by_text), no)


def answer_class(answer: Column) -> Column:
    """One text for all answers graded as equal: the grader's form of the competition form.

    A class has to be a key, so the two forms are taken one after the other instead of
    either of them agreeing.
    """
    bare = trim_space(F.regexp_replace(trim_space(answer), r"^\\text\{(.+?)\}$", "$1"))
    return normalize_math(normalize_math(bare, "competition"), "grader")


def answer_forms() -> list[Callable[[Column], Column]]:
    """The two normal forms of the grader: answers that agree in either are equal."""
    bare = lambda a: trim_space(F.regexp_replace(trim_space(a), r"^\\text\{(.+?)\}$", "$1"))
    return [lambda a: normalize_math(bare(a), "competition"), lambda a: normalize_math(a, "grader")]


# --- phrases -----------------------------------------------------------------------


def _phrase(col: Column, pattern: str, fallback: str | None = V.INVALID, drop_commas: bool = True) -> Column:
    hit = trim_space(F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")))
    hit = F.replace(hit, F.lit(","), F.lit("")) if drop_commas else hit
    return F.coalesce(hit, F.lit(fallback)) if fallback else hit


def phrase_answer(col: Column, benchmark: str) -> Column:
    """Answer named by the phrase a benchmark asks for."""
    before = lambda mark: F.substring_index(col, mark, 1)
    if benchmark == "grade_school":
        return _phrase(col, r"The answer is: (\-?[0-9\.\,]+)")
    if benchmark == "grade_school_gold":
        return _phrase(col, r"#### (\-?[0-9\.\,]+)", None)
    if benchmark == "grade_school_shots":
        numbers = F.regexp_extract_all(before("Q: "), F.lit(r"-?\d+\.?\d*"), F.lit(0))
        return F.coalesce(last_of(numbers), F.lit(V.INVALID))
    if benchmark == "step_reward":
        return _phrase(col, "(?d)The answer is:(.+) ки")
    if benchmark == "paragraph":
        return _phrase(col, "(?d)The answer is:(.+)\n\n")
    if benchmark == "tree":
        bare = F.btrim(col, F.lit("<|reserved_special_token_2|>"))
        hit = _phrase(bare, r"(?d)Answer:(.+)\n?\z", drop_commas=False)
        return F.substring_index(hit, "<|im_end|>", 1)
    if benchmark == "final_sentence":
        whole = F.concat(col, F.lit("I hope it is correct."))
        pattern = r"(?d)Final Answer: The final answer is(.*?). I hope it is correct."
        hit = trim_space(F.regexp_extract(whole, pattern, 1))
        return F.when(whole.rlike(pattern), hit).otherwise(F.lit(V.INVALID_FINAL))
    if benchmark == "letter":
        low = F.lower(before("Problem:"))
        hit = F.regexp_extract(low, r"the final answer is \(?([abcd])\)?", 1)
        return F.coalesce(F.upper(F.nullif(hit, F.lit(""))), F.lit(V.PLACEHOLDER))
    if benchmark == "courseware":
        pattern = r"(?d)final answer is (.*)\. I hope it is correct."
        text = before("Problem:")
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(
            F.lit(V.INVALID)
        )
    if benchmark in ("chinese_cloze", "chinese_choice"):
        text = before("问题 ")
        rest = F.substring(text, F.locate("答案是", text) + 3, F.length(text))
        line = trim_space(F.substring_index(trim_space(rest), "\n", 1))
        line = F.btrim(line, F.lit("$")) if benchmark == "chinese_cloze" else line
        return F.when(text.contains("答案是"), line).otherwise(F.lit(V.PLACEHOLDER))
    if benchmark == "chinese_number":
        text = before("问题：")
        rest = F.substring(text, F.locate("答案是", text) + 3, F.length(text))
        line = F.substring_index(trim_space(rest), "\n", 1)
        numbers = F.regexp_extract_all(line, F.lit(r"-?\d+\.?\d*"), F.lit(0))
        hit = F.coalesce(last_of(numbers), F.lit(V.INVALID))
        return F.when(text.contains("答案是"), hit).otherwise(extract_answer(text))
    if benchmark == "formal":
        return trim_space(before("Informal:"))
    raise ValueError(f"unknown benchmark phrase: {benchmark}")


def between(col: Column, start: str, end: str | None = None) -> Column:
    """Trimmed text between two markers; null when the end marker is missing."""
    begin = F.locate(start, col) + len(start)
    if end is None:
        return trim_space(F.substring(col, begin, F.length(col)))
    stop = F.locate(end, col)
    inner = F.substring(col, begin, F.greatest(stop - begin, F.lit(0)))
    return F.when(stop > 0, trim_space(inner))


def strip_tokens(col: Column, tokens: Sequence[str] = tuple(V.SPECIAL_TOKENS)) -> Column:
    out = F.coalesce(col, F.lit(""))
    for token in tokens:
        out = F.replace(out, F.lit(token), F.lit(""))
    return out


def numbers_in(col: Column) -> Column:
    """Numbers in a text: grouped, then scientific, then plain ones."""
    kinds = [V.NUMBER_GROUPED, V.NUMBER_SCIENTIFIC, V.NUMBER_PLAIN]
    return F.concat(*[F.regexp_extract_all(col, F.lit(p), F.lit(0)) for p in kinds])


def score_map(col: Column) -> Column:
    """``key: number`` pairs as a map; a repeated key keeps its last number."""
    pattern = r"(?U)(\w+):\s+(\d+)"
    keys = F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(col, F.lit(pattern), F.lit(2))
    names = F.array_distinct(keys)
    from_end = lambda k: F.size(keys) - F.array_position(F.reverse(keys), k)
    last = F.transform(names, lambda k: F.get(values, from_end(k).cast("int")).cast("double"))
    return F.map_from_arrays(names, last)


def keyed_answers(col: Column, keys: Column) -> Column:
    """Answer per key of a dict-like completion, by pattern when it does not parse."""
    body = F.substring(col, F.locate("{", col), F.length(col))
    body = F.when(col.endswith("}"), body).otherwise(F.concat(body, F.lit("}")))
    parsed = F.when(col.contains("{"), F.from_json(body, "map<string,string>"))

    def by_pattern(k: Column) -> Column:
        single = F.concat(quoted(k), F.lit("': ([^']+)'[,}]"))
        double = F.concat(quoted(k), F.lit('": ([^"]+)"[,}]'))
        hits = [F.get(F.regexp_extract_all(col, p, F.lit(0)), F.lit(0)) for p in (single, double)]
        cut = [F.substring(h, 1, F.greatest(F.length(h) - 1, F.lit(0))) for h in hits]
        return F.coalesce(*cut, F.lit(""))

    found = F.transform(
        keys,
        lambda k: F.when(parsed.isNull(), by_pattern(k)).otherwise(
            F.coalesce(F.try_element_at(parsed, k), F.lit(""))
        ),
    )
    return F.map_from_arrays(keys, found)


def normalize_qa(col: Column, lang: str = "en") -> Column:
    """Lower case without punctuation and articles, single spaces."""
    bare = F.translate(F.lower(col), V.PUNCTUATION, "")
    articles = "|".join(V.ARTICLES[lang])
    cut = F.regexp_replace(bare, rf"(?U)\b({articles})\b", " ")
    return F.trim(F.regexp_replace(cut, V.WHITESPACE, " "))
