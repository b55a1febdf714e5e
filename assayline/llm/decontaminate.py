"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton of all normalised items holds every substring of every item; training
words are streamed through it and the longest match ending at each word is tracked. A
match of at least ``window`` words is made of whole windows; an item shorter than that is
a window in full. Items come in groups of bounded size, one automaton for each group, so
a large benchmark makes more passes over a batch and not one larger broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import materialize
from assayline.operators.scale import broadcast_if_small

#: Upper to lower case; other ASCII characters except digits and letters to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
GROUP_BYTES = 4 << 20
GROUPS_AT_ONCE = 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Generalised automaton over word numbers; state 0 is the empty string."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        own: dict[int, list[int]] = {}
        coded = []
        for i, (_, words) in enumerate(items):
            codes = [self.words.setdefault(w, len(self.words)) for w in words]
            coded.append(codes)
            state = 0
            for c in codes:
                state = self._extend(state, c)
            if 0 < len(codes) < window:
                own.setdefault(state, []).append(i)
        self.shortest = min((min(len(c), window) for c in coded if c), default=window)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: short items that end a match: own ones if the match is the longest of its state
        self.own, self.above = own, {}
        #: the state whose strings reach exactly ``window`` words
        self.base = [0] * len(self.link)
        for s in order:
            up = self.link[s]
            shorts = self.above.get(up, ()) + tuple(own.get(up, ()))
            if shorts:
                self.above[s] = shorts
            if self.length[s] >= window:
                self.base[s] = s if self.length[up] < window else self.base[up]
        self.holders: dict[int, list[int]] = {}
        self.size = [len(c) for c in coded]
        for i, codes in enumerate(coded):
            for _, state, n in self.matches(codes):
                if n >= window:
                    held = self.holders.setdefault(self.base[state], [])
                    if not held or held[-1] != i:
                        held.append(i)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """State for the strings of ``q`` that end an extension of ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def matches(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, length) of the longest match that ends at each word."""
        state = n = 0
        nxt, link, length = self.next, self.link, self.length
        for at, c in enumerate(codes):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            else:
                n = 0
            yield at, state, n

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans (start, end) covered by windows, not merged, and the items hit."""
        known = self.words.get
        codes = np.array([known(w, -1) for w in words], np.int64)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.shortest:
                continue  # a window lies wholly inside a run of item words
            for at, state, n in self.matches(codes[start:end].tolist()):
                here = start + at + 1
                if n >= self.window:
                    spans.append((here - n, here))
                    items.update(self.holders[self.base[state]])
                if state in self.own and n == self.length[state]:
                    spans.append((here - n, here))
                    items.update(self.own[state])
                for i in self.above.get(state, ()):
                    spans.append((here - self.size[i], here))
                    items.add(i)
        return spans, items


Group = tuple[str, Broadcast]


def grouped_items(
    items: DataFrame, id_col: str, text_col: str, group_bytes: int
) -> tuple[DataFrame, int]:
    """Distinct (name, text) rows with the number of their ``part``, and how many parts there
    are: parts are dealt by a hash of the row, for about ``group_bytes`` of text in each."""
    named = items.select(F.struct(id_col, text_col).alias("row")).select(
        F.col(f"row.`{id_col}`").cast("string").alias("name"), F.col(f"row.`{text_col}`").alias("text")
    )
    named = named.where("text <> ''").distinct()
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // group_bytes)
    rows = named.withColumn("part", F.pmod(F.xxhash64("name", "text", F.lit("part")), F.lit(max(parts, 1))))
    if parts > 1:  # sorted, so that a pass reads little more than its own parts
        rows = materialize(rows.repartitionByRange("part").sortWithinPartitions("part"), "items")
    return rows, parts


def sent_groups(rows: DataFrame, parts: range) -> list[Group]:
    """The items of some parts as (key, broadcast), one for each part that has any."""
    held: dict[int, list[tuple[str | None, str]]] = {}
    for row in rows.where(F.col("part").between(parts.start, parts.stop - 1)).collect():
        held.setdefault(row["part"], []).append((row["name"], row["text"]))
    send = rows.sparkSession.sparkContext.broadcast
    return [(uuid.uuid4().hex, send(held[part])) for part in sorted(held)]


#: Automata of this worker by group key; those of groups no longer asked for are let go.
_BUILT: dict[str, SuffixAutomaton] = {}


def automata_of(groups: list[Group], window: int) -> list[SuffixAutomaton]:
    """One automaton per group, built once in a worker and used by all its tasks."""
    keys = {f"{key}:{window}": sent for key, sent in groups}
    for old in _BUILT.keys() - keys.keys():
        del _BUILT[old]
    for key in keys.keys() - _BUILT.keys():
        items = [(name, words_of(text)) for name, text in keys[key].value]
        _BUILT[key] = SuffixAutomaton(items, window)
    return [_BUILT[key] for key in keys]


SPANS = "array<struct<first: int, last: int>>"
RESULT = f"n_words long, hits {SPANS}, items array<string>"


def item_hits(text: Column, groups: list[Group], window: int) -> Column:
    """Struct (n_words, hits, items): merged word spans that windows cover, items found."""

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = automata_of(groups, window)
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ("items", pa.list_(pa.string())),
            ]
        )
        for batch in batches:
            rows = []
            for value in batch:
                words = words_of(value.as_py())
                spans, names = [], set()
                for automaton in automata:
                    found, hit = automaton.scan(words)
                    spans += found
                    names.update(automaton.names[i] for i in hit)
                listed = sorted(names - {None}) + [None] * (None in names)
                rows.append((len(words), merged(spans), listed))
            yield pa.array(
                [{"n_words": n, "hits": h, "items": i} for n, h, i in rows], kind
            )

    return scan(text)


def joined_hits(found: Column, more: Column) -> Column:
    """``found`` with the hits and items of further passes over the same text."""

    @F.arrow_udf(SPANS)
    def spans(parts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        rows = [merged([(s["first"], s["last"]) for s in p or []]) for p in parts.to_pylist()]
        return pa.array(rows, kind)

    hits = F.concat(found["hits"], F.flatten(F.transform(more, lambda f: f["hits"])))
    items = F.concat(found["items"], F.flatten(F.transform(more, lambda f: f["items"])))
    both = F.struct(
        found["n_words"].alias("n_words"),
        spans(hits).alias("hits"),
        F.array_sort(F.array_distinct(items)).alias("items"),
    )
    return F.when(more.isNull(), found).otherwise(both)


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [{"first": a, "last": b} for a, b in out]


def scan_documents(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    group_bytes: int = GROUP_BYTES,
    groups_at_once: int = GROUPS_AT_ONCE,
) -> DataFrame:
    """(row, found): the input row as a struct, and its words, hit spans and items.

    Items are dealt to groups of about ``group_bytes`` of text; a longer item is not divided.
    The driver sends ``groups_at_once`` of them at a time and frees them once their pass is
    stored; those of the first pass stay, as its rows are not stored here. Every further pass
    gives one row for each different text it hits, looked up by a 128-bit hash of the text.

    Null and empty texts have no words and no hits, nor do items without words match
    anything. Items that share an id count as one, and so do all with a null id: they mark
    words like any item and stand as one null, last, in ``found.items``.
    Spans are word numbers, end exclusive, merged. Very long texts are scanned in one
    pass; only runs of item words are walked. No rows: no rows, no items: no hits.
    """
    bench, parts = grouped_items(items, item_id, item_text, group_bytes)
    passes = [range(at, at + groups_at_once) for at in range(0, max(parts, 1), groups_at_once)]
    packed = docs.select(F.struct("*").alias("row"))
    text = F.col(f"row.`{text_col}`")
    rows = packed.withColumn("found", item_hits(text, sent_groups(bench, passes[0]), window))
    if len(passes) == 1:
        return rows
    key = {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit("text"), text)}
    more = None
    for some in passes[1:]:
        groups = sent_groups(bench, some)
        hit = packed.select(*[c.alias(k) for k, c in key.items()], item_hits(text, groups, window).alias("f"))
        hit = hit.where(F.size("f.hits") > 0).groupBy(*key).agg(F.first("f").alias("f"))
        hit = materialize(hit, "pass-hits")
        for _, sent in groups:  # the pass is stored, so nothing asks for them again
            sent.destroy()
        more = hit if more is None else more.union(hit)
    # one entry a pass for each text
    more = more.groupBy(*key).agg(F.collect_list("f").alias("more"))
    more = broadcast_if_small(materialize(more, "further-hits"))
    both = rows.withColumns(key).join(more, list(key), "left")
    return both.select("row", joined_hits(F.col("found"), F.col("more")).alias("found"))


def contamination(found: Column) -> dict[str, Column]:
    """Digest columns of a ``found`` struct; a null item counts, but has no name to hash."""
    hits = F.aggregate(
        found["hits"], F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"]
    )
    return {
        "n_words": found["n_words"],
        "n_hit": hits,
        "n_items": F.size(found["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(found["items"], ","), 256),
        "contaminated": hits > 0,
    }


def _cut(text: str, hits: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    clean, at, bounds = raw.translate(WORD_BYTES), 0, []
    wanted = {n for h in hits for n in (h[0], h[1] - 1)}
    place = {}
    for n, word in enumerate(clean.split()):
        at = clean.index(word, at)
        if n in wanted:
            place[n] = (at, at + len(word))
        at += len(word)
    bounds = [(place[a][0], place[b - 1][1]) for a, b in hits]
    out, done = [], 0
    for a, b in bounds:
        out.append(raw[done:a])
        done = b
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def strip_spans(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    min_words: int = 1,
    max_coverage: float = 1.0,
    **scan,
) -> DataFrame:
    """Input columns, with hit spans of at least ``min_words`` words cut from the text;
    rows with more than ``max_coverage`` of their words hit are removed whole. Here, items
    with a null id cut nothing."""
    named = items.where(F.col(f"`{scan.get('item_id', 'item_id')}`").isNotNull())
    rows = scan_documents(docs, named, text_col, **scan)
    spans = F.filter("found.hits", lambda h: h["last"] - h["first"] >= min_words)

    @F.arrow_udf("string")
    def cut(text: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(text.to_pylist(), hits.to_pylist()):
            out.append(_cut(t, [(x["first"], x["last"]) for x in h]) if t and h else t)
        return pa.array(out, pa.string())

    facts = contamination(F.col("found"))
    share = facts["n_hit"] / F.greatest(facts["n_words"], F.lit(1))
    rows = rows.where(share <= max_coverage).withColumn("hits", spans)
    text = F.when(F.size("hits") > 0, cut(F.col(f"row.`{text_col}`"), F.col("hits"))).otherwise(
        F.col(f"row.`{text_col}`")
    )
    return rows.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")
