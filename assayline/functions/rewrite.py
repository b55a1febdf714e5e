"""Rule-table text rewriting and template rendering."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline.fixed_values import DETOKENIZE


def apply_rules(col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Fold a rule table over a text: plain replacement, regex or trim steps."""
    out = col
    for kind, what, by in rules:
        if kind == "text":
            out = F.replace(out, F.lit(what), F.lit(by))
        elif kind == "regex":
            out = F.regexp_replace(out, what, by)
        elif kind == "trim":
            out = trim_space(out)
        else:
            raise ValueError(f"unknown rule kind: {kind}")
    return out


def detokenize(col: Column, rules: str = "general") -> Column:
    return apply_rules(col, DETOKENIZE[rules])


def let(col: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(col)`` with ``col`` evaluated once, however often ``fn`` uses it.

    Steps like "keep if unchanged, else rewrite" mention their input several times; in
    a long chain the plain expression would grow exponentially.
    """
    return F.get(F.transform(F.array(col), fn), F.lit(0))


def trim_space(col: Column) -> Column:
    """Strip all white space at both ends, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """Column for a text template with ``{field}`` places; ``{{`` is a brace."""
    parts = []
    for piece in re.findall(r"\{\{|\}\}|\{\w+\}|[^{}]+", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            parts.append(fields[piece[1:-1]].cast("string"))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")
