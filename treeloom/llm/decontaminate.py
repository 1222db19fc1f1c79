"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are brought to one form: lower case, ASCII punctuation and white space to single blanks. An item
of m characters may differ by k = floor(RATE * m) edits. It is cut into k + 1 pieces, one of which must stand in the
text unchanged; an automaton of all pieces finds these hits, and from each the rest of the item is aligned to both
sides by Myers' bit-parallel distance, stopped as soon as the budget is spent. Items are a stated query set against
all documents: they go out in blocks of ITEMS, every block over all texts.

Defined results: a null or empty text has no leak, items of fewer than 1 / RATE characters in that form match only
unchanged, empty items never; of several places the one with fewest edits, then the first, is told; repeated items and
rows are told each; an empty table of either kind gives an empty result; other columns are kept, but leaks() replaces
one named _leaks.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import arrow, fields, free, read

#: Edits allowed for each character. On sf0.1 rates of 0.08, 0.10 and 0.12 find items in the same 247 documents, in 6,
#: 24 and 132 s: pieces get shorter and stand in more and more places.
RATE = 0.08
#: Items of one pass over the documents; an item is a few hundred bytes.
ITEMS = 20_000
_BLANKS = bytes(b if chr(b) not in string.punctuation + string.whitespace else 32 for b in range(256))
LEAKS = "array<struct<item_id: bigint, distance: int, start: int, stop: int>>"


def normal(text: str | None) -> str:
    """The form in which texts are compared: each byte of the UTF-8 is one character."""
    return b" ".join((text or "").lower().encode().translate(_BLANKS).split()).decode("latin-1")


def budget(m: int, rate: float = RATE) -> int:
    return int(rate * m)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(place, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def extend(pattern: str, own: dict[str, int], text: str, k: int) -> tuple[int, int] | None:
    """Least edits, at most k, that turn pattern into a prefix of text, and the prefix's length; None if more.

    Myers' recurrence with the text's start fixed: the top row grows by one with each column.
    """
    m = len(pattern)
    if m <= k and not text:
        return m, 0
    if not m:
        return 0, 0
    ones = (1 << m) - 1
    last = 1 << m - 1
    pv, mv, score = ones, 0, m
    best, at = (m, 0) if m <= k else (k + 1, 0)
    for j, c in enumerate(text[: m + k], 1):
        eq = own.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1 | 1) & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
        if score < best:
            best, at = score, j
        if j & 15 == 0:
            # the column's least value, read off the vertical differences at every eighth row
            value = low = j
            for shift in range(0, m, 8):
                up, down = pv >> shift & 255, mv >> shift & 255
                low = min(low, value - down.bit_count())
                value += up.bit_count() - down.bit_count()
                low = min(low, value)
            if low > k:
                break
    return (best, at) if best <= k else None


class Items:
    """An automaton over the pieces of a block of items."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        of: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            form = normal(text)
            if not form:
                continue
            k = budget(len(form), rate)
            cut = []
            for place, piece in pieces(form, k):
                left, right = form[:place][::-1], form[place + len(piece) :]
                of.setdefault(piece, []).append((len(self.items), len(cut)))
                cut.append((place, piece, left, masks(left), right, masks(right)))
            self.items.append((item_id, form, k, cut))
        for piece, uses in of.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if of:
            self.automaton.make_automaton()
        self.empty = not of

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, stop) for each item found, places in the normal form."""
        form = normal(text)
        found: dict[int, tuple[int, int, int]] = {}
        if self.empty or not form:
            return []
        covered: dict[int, int] = {}
        for end, (n, uses) in self.automaton.iter(form):
            begin = end + 1 - n
            for i, c in uses:
                item_id, whole, k, cut = self.items[i]
                place, _, left, left_masks, right, right_masks = cut[c]
                if i in found and (found[i][0] == 0 or covered.get(i, -1) == begin - place):
                    continue
                if whole.startswith(form[begin - place : begin - place + len(whole)], 0) and begin >= place and len(form) >= begin - place + len(whole):
                    found[i] = (0, begin - place, begin - place + len(whole))
                    continue
                after = extend(right, right_masks, form[end + 1 : end + 1 + len(right) + k], k)
                if after is None:
                    continue
                room = k - after[0]
                before = extend(left, left_masks, form[max(0, begin - len(left) - room) : begin][::-1], room)
                if before is None:
                    continue
                covered[i] = begin - place
                got = (after[0] + before[0], begin - before[1], end + 1 + after[1])
                if i not in found or got < found[i]:
                    found[i] = got
        return sorted((self.items[i][0], d, a, b) for i, (d, a, b) in found.items())


_BUILT: dict[int, Items] = {}


def _with_leaks(batches: Iterator[pa.RecordBatch], rows, rate: float, name: str) -> Iterator[pa.RecordBatch]:
    """rows is a broadcast of (item_id, text); its automaton is built once in each worker."""
    key = hash((tuple(rows.value), rate))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(rows.value, rate)
    own = _BUILT[key]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    names = ("item_id", "distance", "start", "stop")
    for batch in batches:
        leaks = [[dict(zip(names, x)) for x in own.leaks(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, kind)], [*batch.schema.names, name])


def blocks(items: DataFrame, most: int = ITEMS) -> list[list[tuple[int, str]]]:
    """The items in lists of at most `most`, read in order of item_id."""
    out: list[list] = [[]]
    for r in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if len(out[-1]) == most:
            out.append([])
        out[-1].append((r.item_id, r.text))
    return out


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, name: str = "_leaks") -> DataFrame:
    """docs with a column of the items found in each text."""
    out = docs.drop(name)
    for k, rows in enumerate(blocks(items)):
        told = name if not k else free(out, f"{name}_more")
        sent = docs.sparkSession.sparkContext.broadcast(rows)  # at most ITEMS of them
        out = arrow(out, lambda b, sent=sent, told=told: _with_leaks(b, sent, rate, told), f"{fields(out)}, {told} {LEAKS}")
        if k:
            out = out.withColumn(name, F.concat(name, told)).drop(told)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item is found."""
    name = free(docs, "_leaks")
    return leaks(docs, items, rate, name).where(F.size(name) == 0).drop(name)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """A row for each document and item found in it."""
    got = leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return got.where(F.size("_leaks") > 0).select("doc_id", F.explode("_leaks").alias("x")).select("doc_id", "x.*")


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE: dict[str, str] = {}
