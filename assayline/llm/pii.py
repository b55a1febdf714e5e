"""Personal data: generators propose overlapping spans, boosted trees select among them.

The base patterns always stand. Loose generators propose further spans (spelled-out
mail signs, numbers in odd groups); trees over format and context score them, and a
threshold for each kind, calibrated on a held-out fold, decides. As the base patterns stand
anyway, the trees learn only from candidates that no base span overlaps: the base spans of all
documents, rewritten in place into forms the patterns do not know, are the positives; plain numbers and words are the negatives. Other candidates are unlabelled
and left out.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.boosting import TASKS, Boosted, tally
from assayline.session import materialize

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Characters kept around a rewritten span.
AROUND = 60
#: Examples a Python worker sends at a time, and steps of a score among which a threshold is sought.
SLICE = 2048
STEPS = 1 << 16

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}"
)
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")
CONTEXT = re.compile(
    r"(mail|contact|kontakt|write)|(tel|phone|call|fon|fax|mobile)|(card|visa|credit|karte|pay)"
    r"|(\bip\b|host|server|addr)|(token|key|password|secret|hash)",
    re.IGNORECASE,
)
FEATURES = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        start = at
        while found and start > done and text[start - 1] in _LOCAL:
            start -= 1
        if found and start < at:
            out.append((start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind: the fixed patterns."""
    out = []
    if not text:
        return out
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """Spans of the loose generators, one for each kind a span may be."""
    out = []
    if not text:
        return out
    if "@" in text or "at)" in text or "at]" in text or " dot " in text:
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            if m[0].count(".") == 3:
                out.append((m.start(), 1, m.end()))
            if n >= 13:
                out.append((m.start(), 2, m.end()))
            if n <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def describe(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Format and context features of each span."""
    rows = []
    for start, kind, end in spans:
        s, left = text[start:end], text[max(0, start - 30) : start]
        digits = [c for c in s if c.isdigit()]
        groups = re.split(r"[^0-9]+", s.strip("+() "))
        hits = [0.0] * 5
        for m in CONTEXT.finditer(left):
            hits[m.lastindex - 1] = 1.0
        rows.append(
            [
                *[float(kind == k) for k in range(4)],
                len(s),
                len(digits),
                len(groups),
                max(map(len, groups)),
                min(map(len, groups)),
                s.count("."),
                s.count("-"),
                s.count(" "),
                s.count("("),
                float(s[0] == "+"),
                float("@" in s),
                float(max((int(g[:4] or 0) for g in groups if g[:4].isascii()), default=0)),
                float(luhn("".join(d for d in digits if d.isascii())) and len(digits) >= 13),
                s.count("[") + s.count("]"),
                s.count("/"),
                float("dot" in s),
                float(re.search(r"[0-9A-Za-z]\. ", s) is not None),
                float(next((int(d) for d in digits if d.isascii()), -1)),
                float(len(groups[0])),
                float(len(groups[-1])),
                zlib.crc32(left[-1:].encode("utf-8", "replace")) % 16 if left else -1,
                float(left[-1:].isspace() or not left),
                float(text[end : end + 1].isspace() or end == len(text)),
                *hits,
            ]
        )
    return np.array(rows, float).reshape(len(spans), FEATURES)


class Cover:
    """Disjoint intervals in order, for quick overlap checks of spans (start, kind, end)."""

    def __init__(self, spans: Iterable[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: tuple[int, int, int]) -> bool:
        at = bisect_right(self.ends, span[0])
        return at < len(self.starts) and self.starts[at] < span[2]

    def add(self, span: tuple[int, int, int]) -> None:
        """Add a span that meets none."""
        at = bisect_right(self.ends, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[2])


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the sorted ``spans`` that overlap no other one."""
    out, reach = [], -1
    for n, span in enumerate(spans):
        later = n + 1 < len(spans) and spans[n + 1][0] < span[2]
        if span[0] >= reach and not later:
            out.append(span)
        reach = max(reach, span[2])
    return out


def altered(kind: int, span: str, rng: random.Random) -> str:
    """A base span written without the marks its pattern looks for."""
    digits = re.findall("[0-9]+", span)
    if kind == 0:
        local, domain = span.rsplit("@", 1)
        signs = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" @ ", "."))
        at, dot = rng.choice(signs)
        if rng.random() < 0.5:  # masked, so that digits and depth do not tell
            bare = [re.sub("[0-9]", "", part) for part in (local, domain)]
            local, domain = (b if re.search("[A-Za-z]", b) and ".." not in b else x for b, x in zip(bare, (local, domain)))
        if rng.random() < 0.5:
            domain = ".".join(domain.split(".")[-2:])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return rng.choice((". ", " .")).join(digits)
    if kind == 2:
        number = "".join(digits)
        if rng.random() < 0.5:  # a shorter number with its own check digit
            number = next(n for n in (f"{number[:12]}{d}" for d in range(10)) if luhn(n))
            sep = rng.choice(("", " ", "-"))
        else:
            sep = rng.choice((".", "/", "  "))
        return sep.join(number[at : at + 4] for at in range(0, len(number), 4))
    local = digits[1:]
    if sum(map(len, local)) < 7 or len(local) < 2:
        number = "".join(digits)[-10:]
        local = [number[:3], number[3:6], number[6:]]
    tail = "-".join(local[1:])
    forms = (f"({local[0]}) {tail}", f"{local[0]}-{tail}", f"{local[0]}/{tail}", ".".join(local), " ".join(local))
    return rng.choice(("", "", "00" + digits[0] + " " if len(digits) > 1 else "")) + rng.choice(forms)


def _like_card(digits: str) -> bool:
    """May be a card number that is too short for the pattern: nobody can call it plain."""
    return len(digits) >= 12 and digits[0] in "23456" and luhn(digits)


def plain(kind: int, rng: random.Random) -> str:
    """A number, or for mails a run of words, that is no personal data."""
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        word = lambda: "".join(rng.choice("aeinorstl") for _ in range(rng.randint(2, 9)))
        if rng.random() < 0.3:
            return f"{word()} at {some(2)}.{some(2)}{rng.choice(('. ', ' ', '. ' + word() + '. '))}{word()}"
        return f"{word()} at {word()}{rng.choice(('', some(2)))}{rng.choice(('. ', '. ', ' . '))}{word()}"
    year, month, day = rng.randint(1800, 2099), rng.randint(1, 12), rng.randint(1, 31)
    if kind == 1:
        return f"{rng.randint(1, 99)}.{rng.randint(256, 9999)}.{rng.randint(0, 999)}.{rng.randint(0, 9)}"
    forms = (
        some(rng.randint(7, 19)),
        some(rng.choice((13, 16))),
        f"{year}-{month:02}-{day:02}",
        f"{day:02}.{month:02}.{year}",
        f"{month:02}/{day:02}/{year}",
        f"{year}-{year + rng.randint(1, 50)}",
        rng.choice((".", " ")).join([str(rng.randint(1, 999)), *[some(3) for _ in range(rng.randint(2, 5))]]),
        f"{rng.randint(0, 9999)}.{some(rng.randint(6, 12))}",
    )
    number = rng.choice(forms)
    if _like_card("".join(re.findall("[0-9]", number))):
        number = number[:-1] + str((int(number[-1]) + 1) % 10)
    return number


def _is_plain(text: str, span: tuple[int, int, int]) -> bool:
    """A natural candidate that is no personal data by its look: words without a spelled or
    written sign, or bare digits without check digit, in a context that names no kind."""
    s = text[span[0] : span[2]]
    if CONTEXT.search(text[max(0, span[0] - 30) : span[0]]):
        return False
    if span[1] == 0:
        return not re.search(r"[@()\[\]]|\bdot\b", s) and ". " in s
    return s.isdigit() and not _like_card(s)


def examples(text: str) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Slices of features and labels of candidates that no base span overlaps.

    Every base span apart from others is rewritten twice, and for each rewriting something
    plain is put at another place of the text; draws depend on the text alone.
    """
    base = base_spans(text)
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))

    def placed(start: int, new: str, end: int, kind: int, label: int) -> tuple[np.ndarray, list[int]]:
        # a sign apart from the span, without which words are not looked at
        left = text[max(0, start - AROUND) : start]
        right = text[end : end + AROUND] + " @" * (kind == 0)
        around, at = left + new + right, (len(left), kind, len(left) + len(new))
        fixed, own = Cover(base_spans(around)), Cover([at])
        found = [c for c in candidates(around) if own.meets(c) and not fixed.meets(c)]
        return describe(around, found), [int(label and c[1] == kind) for c in found]

    for start, kind, end in apart(base):
        for _ in range(2):
            yield placed(start, altered(kind, text[start:end], rng), end, kind, 1)
            spaces = [at for at in (rng.randrange(len(text)) for _ in range(8)) if text[at].isspace()]
            for at in [a for a in spaces if not CONTEXT.search(text[max(0, a - 30) : a])][:2]:
                what = rng.choice((kind, 2))
                yield placed(at + 1, plain(what, rng), at, what, 0)
    held = Cover(base)
    usual = [c for c in candidates(text) if not held.meets(c) and _is_plain(text, c)]
    for at in range(0, len(usual), SLICE):
        part = usual[at : at + SLICE]
        yield describe(text, part), [0] * len(part)


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored examples (x, y, held, n) of all texts: features as int16 bytes, label, whether
    the text is in the fold not trained on, and how often the example stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["x", "y", "held"]
        for batch in batches:
            x, y, held = [], [], []
            for value, fold in zip(batch.column(0), batch.column(1)):
                text = value.as_py()
                for found, good in examples(text) if text else ():
                    x += [row.tobytes() for row in found.clip(-32768, 32767).astype("<i2")]
                    y += good
                    held += [fold.as_py()] * len(good)
                    if len(y) >= SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32()), pa.array(held, pa.bool_())], names)
                        x, y, held = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int32()), pa.array(held, pa.bool_())], names)

    fold = F.pmod(F.xxhash64(text_col, F.lit(13)), F.lit(3)) == 0
    found = docs.select(F.col(text_col), fold).mapInArrow(run, "x binary, y int, held boolean")
    merged = found.groupBy("x", "y", "held").agg(F.count(F.lit(1)).alias("n"))
    tasks = min(TASKS, docs.sparkSession.sparkContext.defaultParallelism)
    return materialize(merged.repartition(tasks), "examples", ["held"])


def train(
    docs: DataFrame, text_col: str = "text", precision: float = PRECISION
) -> tuple[Boosted | None, list[float]]:
    """Trees and a threshold for each kind, from the candidates of all texts.

    A text's candidates are all in the fold not trained on, or none. The threshold is the lowest score above which, on the fold not trained on, the share of
    positives is at least ``precision``, in ``STEPS`` steps; infinite for a kind without such a score.
    """
    rows = labelled(docs, text_col)
    taught, tested = rows.where("NOT held"), rows.where("held")
    never = [float("inf")] * len(KINDS)
    if taught.agg(F.count_distinct("y")).first()[0] < 2:
        return None, never
    model = Boosted().fit_rows(taught)

    def scored(x, y, n):
        step = np.floor(model.score(x) * STEPS).astype(np.int64)
        for k in range(len(KINDS)):
            own = (x[:, k] == 1) & (2 * step >= STEPS)
            yield step[own] * len(KINDS) + k, n[own], (n * y)[own]

    cells = tally(tested, (STEPS + 1) * len(KINDS), scored, ("n", "ones")).groupBy("k")
    cells = cells.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy(F.desc("k")).toArrow()
    cell, n, ones = (cells.column(c).to_numpy() for c in ("k", "n", "ones"))
    limits = []
    for k in range(len(KINDS)):
        own = cell % len(KINDS) == k
        exact = ones[own].cumsum() / n[own].cumsum()
        good = np.flatnonzero((exact >= precision) & (ones[own] > 0))
        limits.append(float(cell[own][good[-1]] // len(KINDS) / STEPS) if len(good) else float("inf"))
    return model, limits


def spans(text: Column, spark, model: Boosted | None, limits: list[float]) -> Column:
    """Struct (base, all) of arrays (start, kind, end), both by start, then kind."""
    sent = spark.sparkContext.broadcast((model, limits))
    one = "array<struct<start: int, kind: int, end: int>>"

    @F.arrow_udf(f"base {one}, every {one}")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees, least = sent.value
        fields = ("start", "kind", "end")
        kind = pa.list_(pa.struct([(f, pa.int32()) for f in fields]))
        for batch in batches:
            base, every, todo = [], [], []
            for n, value in enumerate(batch):
                text = value.as_py()
                fixed = base_spans(text)
                base.append(fixed)
                every.append(list(fixed))
                if trees is not None:
                    held = Cover(fixed)
                    more = [c for c in candidates(text) if not held.meets(c)]
                    if more:
                        todo.append((n, more, describe(text, more)))
            if todo:
                scores = trees.score(np.concatenate([t[2] for t in todo]))
                at = 0
                for n, more, _ in todo:
                    ranked = sorted(zip(-scores[at : at + len(more)], more))
                    at += len(more)
                    taken, held = [], Cover()
                    for minus, span in ranked:
                        if -minus >= least[span[1]] and not held.meets(span):
                            taken.append(span)
                            held.add(span)
                    every[n] = sorted(every[n] + taken)
            rows = [
                pa.array([[dict(zip(fields, s)) for s in r] for r in part], kind)
                for part in (base, every)
            ]
            yield pa.StructArray.from_arrays(rows, ["base", "every"])

    return find(text)


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(found, line), ",")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit
) -> DataFrame:
    """(row, found) with found.base and found.every: spans of each whole text.

    Offsets are code points, end exclusive. Null and empty texts have no spans. Base spans
    of different kinds may overlap and all stand; an added span overlaps no other span.
    Repeated rows and null ids are treated like any row. No rows: no rows.
    """
    model, limits = train(docs, text_col, **fit)
    rows = docs.select(F.struct("*").alias("row"))
    found = spans(F.col(f"row.`{text_col}`"), docs.sparkSession, model, limits)
    return rows.withColumn("found", found)


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def digest(found: Column) -> dict[str, Column]:
    """Counts of base spans, their hash, and all spans as text."""
    out = {
        f"n_{k}": F.size(F.filter(found["base"], _of_kind(i))).cast("long")
        for i, k in enumerate(KINDS)
    }
    return out | {
        "base_sha256": F.sha2(_listed(found["base"]), 256),
        "spans": _listed(found["every"]),
    }


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """Input columns, with every span found replaced by its kind in square brackets."""
    rows = find_personal_data(docs, id_col, text_col, **fit)

    @F.arrow_udf("string")
    def cover(text: pa.Array, every: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text.to_pylist(), every.to_pylist()):
            parts, done = [], 0
            for s in found or []:
                if s["start"] >= done:
                    parts += [t[done : s["start"]], f"[{KINDS[s['kind']]}]"]
                    done = s["end"]
                elif s["end"] > done:
                    done = s["end"]
            out.append("".join([*parts, t[done:]]) if parts else t)
        return pa.array(out, pa.string())

    text = cover(F.col(f"row.`{text_col}`"), F.col("found.every"))
    return rows.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
