"""Math answer normalizers: rule tables folded over a text, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.functions.rewrite import apply_rules, let, trim_space

INTEGER = r"(0|-?[1-9]\d*)"


def braces_for_fracs(col: Column) -> Column:
    r"""``\frac12`` and ``\frac1{2}`` to ``\frac{1}{2}``; a cut-off fraction leaves the
    text as it was."""

    def repair(c: Column) -> Column:
        fixed = F.regexp_replace(c, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
        fixed = F.regexp_replace(fixed, r"\\frac([^{])\{", r"\\frac{$1}{")
        return F.when(c.rlike(r"\\frac[^{\\]?(?:\\frac|$)"), c).otherwise(fixed)

    return let(col, repair)


def slash_to_frac(col: Column, side: str = INTEGER) -> Column:
    """A text that is just ``a/b`` becomes a fraction."""
    return F.regexp_replace(col, f"^{side}/{side}$", r"\\frac{$1}{$2}")


def braces_for_sqrt(col: Column) -> Column:
    return F.regexp_replace(col, r"\\sqrt([^{])", r"\\sqrt{$1}")


def _competition(col: Column) -> Column:
    out = apply_rules(col, V.MATH_COMPETITION)
    out = F.substring_index(out, "\\text{ ", 1)
    out = apply_rules(out, V.MATH_COMPETITION_REST)
    out = F.regexp_replace(out, r"^\.", "0.")
    out = F.regexp_replace(out, r"^[^=]{0,2}=([^=]*)$", "$1")
    out = F.replace(braces_for_sqrt(out), F.lit(" "), F.lit(""))
    out = braces_for_fracs(out)
    out = F.regexp_replace(out, r"^0\.5$", r"\\frac{1}{2}")
    return slash_to_frac(out)


def _quantitative(col: Column) -> Column:
    out = apply_rules(F.substring_index(col, "=", -1), V.MATH_QUANTITATIVE)
    out = apply_rules(out, [("text", word, "") for word in V.MATH_REMOVED])
    out = apply_rules(out, V.MATH_QUANTITATIVE_TEX)

    def ungrouped(c: Column) -> Column:
        bare = F.replace(c, F.lit(","), F.lit(""))
        return F.when(bare.rlike(r"^\d+$"), bare).otherwise(c)

    return let(out, ungrouped)


def strip_grouping_commas(col: Column) -> Column:
    """Commas between groups of three digits, but not list commas."""
    return F.regexp_replace(col, r"(?<=\d),(?=\d{3}(?:\D|$))", "")


def is_int_text(col: Column) -> Column:
    return let(
        strip_grouping_commas(col).try_cast("double"),
        lambda x: F.coalesce(F.abs(x - F.round(x)) <= 1e-7, F.lit(False)),
    )


def _grader(col: Column) -> Column:
    out = apply_rules(col, V.MATH_GRADER)
    for unit in V.MATH_UNITS:
        out = F.regexp_replace(out, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    out = F.regexp_replace(out, r"\^ *\\circ", "")
    out = F.regexp_replace(out, r"^\{(.*)\}$", "$1")
    out = F.regexp_replace(out, r",\\! *", "")

    def whole(c: Column) -> Column:
        as_int = lambda x: F.when(
            (F.abs(x - F.round(x)) <= 1e-7) & (F.abs(x) < 1e15), F.round(x).try_cast("long")
        )
        return F.coalesce(let(c.try_cast("double"), as_int).cast("string"), c)

    def without_tex(c: Column) -> Column:
        return F.when(c.contains("\\"), apply_rules(c, V.MATH_GRADER_TEX)).otherwise(c)

    def integer(c: Column) -> Column:
        value = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
        small = F.coalesce(F.abs(value) < 1e15, F.lit(False))
        return F.when(is_int_text(c) & small, value.try_cast("long").cast("string")).otherwise(c)

    out = let(let(out, whole), without_tex)
    out = F.regexp_replace(out, "- *", "-")
    out = F.regexp_replace(out, "([0-9]) +([0-9])", r"$1+$2")
    return let(F.lower(F.regexp_replace(out, "[ {}]", "")), integer)


def _extraction(col: Column) -> Column:
    out = apply_rules(col, V.MATH_EXTRACTION)

    def without_unit(c: Column) -> Column:
        bare = trim_space(F.regexp_replace(c, r"\\text\{.*?\}$", ""))
        return let(bare, lambda b: F.when(b != "", b).otherwise(c))

    def infinity(c: Column) -> Column:
        short = F.replace(c, F.lit("inf"), F.lit("\\infty"))
        return F.when(c.contains("\\infty"), c).otherwise(short)

    def imaginary(c: Column) -> Column:
        return F.when(c.contains("j") & ~c.contains("i"), F.translate(c, "j", "i")).otherwise(c)

    out = apply_rules(let(out, without_unit), V.MATH_EXTRACTION_REST)
    out = apply_rules(let(out, infinity), V.MATH_EXTRACTION_LAST)
    out = let(out, imaginary)
    out = F.regexp_replace(out, r"(\d+)\.0+([^\d])", "$1$2")
    out = F.regexp_replace(out, r"(\d+)\.0+$", "$1")
    out = F.regexp_replace(out, r"^\.", "0.")
    for name in ("sqrt", "tan"):
        out = F.regexp_replace(out, rf"\\{name}(-?[0-9.a-zA-Z]+)", rf"\\{name}{{$1}}")
        out = F.regexp_replace(out, rf"\\{name}\s+(\w+)$", rf"\\{name}{{$1}}")
    out = braces_for_fracs(F.replace(out, F.lit(" "), F.lit("")))
    out = slash_to_frac(out, r"(0|-?[1-9]\d*|[^/]*sqrt[^/]*)")
    return F.regexp_replace(out, r"(\\|,|\.)+$", "")


RULES = {
    "competition": _competition,
    "exam": _competition,
    "quantitative": _quantitative,
    "grader": _grader,
    "extraction": _extraction,
}


def normalize_math(col: Column, rules: str = "competition") -> Column:
    """Normal form of a math answer under one of the five rule lists."""
    return RULES[rules](col)
