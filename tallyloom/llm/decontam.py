"""Benchmark decontamination by pigeonhole edit matching.

An item may appear in a document with up to ``rate`` of its length in edits; one of fewer than ``short_chars`` characters only as it is,
with no letter or digit beside it. Its text is halved again and again, the budget with it, until
the budget is spent: ``budget + 1`` pieces, one of which must appear as it is, and so that each half on the way up keeps to its share
of the budget. An Aho-Corasick automaton finds the pieces; from a hit the halves that contain it are verified from the smallest to the
whole item with Myers' bit-parallel distance, so chance hits end after a few characters.

Case and kind of white space don't count: texts are compared in lower case with each white space character as a space. Places are code
points of the text as it is.

The items are a stated query set. They go to the executors in blocks of at most ``block_chars`` characters, whatever their number; each
block is held against all documents.

Defined cases: a null text has no matches; null items and blank ones have none either; equal items are each reported; null ids are kept; repeated rows are reported once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import F, T, batch_of, field
from .textblock import BLANKS

RATE, SHORT_CHARS, BLOCK_CHARS = 0.1, 30, 4_000_000


def fold(text: str) -> str:
    """Lower case, every white space character a space; as many code points as before."""
    out = text.replace("İ", "i").lower()  # the one capital whose lower case is two characters
    for c in BLANKS[:-1]:
        out = out.replace(c, " ")
    return out


class Part:
    """A stretch of an item with its share of the edits; a leaf has none to spend."""

    __slots__ = ("at", "budget", "masks", "size", "text", "up")

    def __init__(self, text: str, at: int, budget: int, up: Part | None):
        self.text, self.at, self.budget, self.up, self.size = text, at, budget, up, len(text)
        self.masks = _masks(text)

    def leaves(self):
        if not self.budget:
            yield self
            return
        left = (self.budget - 1) // 2
        cut = self.size * (left + 1) // (self.budget + 1)
        yield from Part(self.text[:cut], self.at, left, self).leaves()
        yield from Part(self.text[cut:], self.at + cut, self.budget - 1 - left, self).leaves()


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def closest(masks: dict[str, int], size: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edits, if at most ``most``, that make the pattern a stretch of ``text``; and the first end of such a stretch."""
    ones = (1 << size) - 1
    top = 1 << (size - 1)
    up, down, now = ones, 0, size
    best, end = min(size, most + 1), 0  # the empty stretch, if all may go
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & ones, up & x
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus, minus = plus << 1 & ones, minus << 1 & ones  # free start: no edit comes in from above
        eq |= down
        up, down = minus | ~(eq | plus) & ones, plus & eq
        if now < best:
            best, end = now, i + 1
            if not now:
                break
    return (best, end) if best <= most else None


class Index:
    """Automaton over the leaves of a block of items."""

    def __init__(self, items: list[tuple], rate: float, short_chars: int = SHORT_CHARS):
        import ahocorasick

        self.items = items
        by: dict[str, list[tuple[int, Part]]] = {}
        self.roots = []
        for i, (_, text) in enumerate(items):
            root = Part(text, 0, int(len(text) * rate) if len(text) >= short_chars else 0, None)
            self.roots.append((root, _masks(text[::-1]), len(text) < short_chars))
            for leaf in root.leaves():
                by.setdefault(leaf.text, []).append((i, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: str):
        """(item number, start, end, edits) of stretches of the folded text; of overlapping ones of an item the first found."""
        seen: dict[int, list[tuple[int, int, int]]] = {}  # start, end, and the furthest end so far
        tried: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(text):
            at = last + 1 - size
            for i, leaf in where:
                if _covered(seen.get(i, ()), at):
                    continue
                part = leaf.up
                while part is not None and part.up is not None:
                    a = at - (leaf.at - part.at) - part.budget
                    if closest(part.masks, part.size, text[max(0, a) : a + part.size + 2 * part.budget], part.budget) is None:
                        break
                    part = part.up
                else:
                    root, back, short = self.roots[i]
                    begin = at - leaf.at
                    if short and (text[begin - 1 : begin].isalnum() or text[begin + root.size : begin + root.size + 1].isalnum()):
                        continue
                    if (i, begin) in tried:
                        continue
                    tried.add((i, begin))
                    low = max(0, begin - root.budget)
                    window = text[low : begin + root.size + root.budget]
                    hit = closest(root.masks, root.size, window, root.budget)
                    if hit is None:
                        continue
                    edits, end = hit
                    start = end - closest(back, root.size, window[:end][::-1], edits)[1]
                    mine = seen.setdefault(i, [])
                    mine.append((low + start, low + end, max(low + end, mine[-1][2] if mine else 0)))
                    yield i, low + start, low + end, edits


def _covered(stretches, at: int) -> bool:
    for a, e, furthest in reversed(stretches):
        if furthest <= at:
            return False
        if a <= at < e:
            return True
    return False


#: Automata that this worker built last: a worker runs many tasks of a block.
_BUILT: dict[bytes, Index] = {}


def _index(items: list[tuple], rate: float, short_chars: int) -> Index:
    key = hashlib.blake2b(repr((items, rate, short_chars)).encode("utf-8", "surrogatepass")).digest()
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Index(items, rate, short_chars)
    return _BUILT[key]


def _blocks(benchmark: DataFrame, block_chars: int):
    """The folded items in blocks; a block's characters are counted before it reaches the driver."""
    text = F.col("text").cast("string")
    items = benchmark.select("item_id", text.alias("text")).filter(F.length(text) > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(n)) == k).toArrow() if n > 1 else items.toArrow()
        folded = [(i, fold(t).strip(" ")) for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]
        if folded := [x for x in folded if x[1]]:
            yield folded


def leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, short_chars: int = SHORT_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits for every place of a document that holds an item."""
    schema = T.StructType([field(docs, "doc_id", T.LongType()), field(benchmark, "item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, block_chars):
        out = out.unionByName(rows.mapInArrow(_finder(items, rate, short_chars, schema), schema))
    return out


def _finder(items: list[tuple], rate: float, short_chars: int, schema: T.StructType):
    def find(batches):
        index = _index(items, rate, short_chars)
        for b in batches:
            got = [(d, items[i][0], *place) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for i, *place in index.matches(fold(t.as_py()))]
            if got:
                yield batch_of(schema, list(map(list, zip(*got))))

    return find


def clean(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, short_chars: int = SHORT_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, all their columns as they were."""
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_keeper(items, rate, short_chars, at), docs.schema)
    return docs


def _keeper(items: list[tuple], rate: float, short_chars: int, at: int):
    def keep(batches):
        index = _index(items, rate, short_chars)
        for b in batches:
            yield b.filter(pa.array(np.array([t is None or next(index.matches(fold(t)), None) is None for t in b.column(at).to_pylist()], bool)))

    return keep
