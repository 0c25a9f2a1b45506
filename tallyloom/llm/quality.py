"""Quality rules as a short-circuit cascade.

``measure`` estimates on a sample what each rule costs and how much it rejects; ``cascade`` runs the rules by rejection per cost,
each on what the ones before have let through. The order changes the cost, never the verdict: a document is kept if no rule fails it.

Defined cases: a null or empty text has no words, so the rule on length fails it; a null ``doc_id`` is kept as null; repeated rows
are judged once each; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import F, T, batch_of, field, texts_in_blocks
from .textblock import BLANKS, Block

# Fixed values.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
SAMPLE_ROWS = 512
#: No script with two cases lies beyond.
CASED = 0x1F000


def once(figure: Callable[[Block], np.ndarray]) -> Callable[[Block], np.ndarray]:
    """A figure of each text that a block computes once, however many rules ask for it."""

    def got(b: Block) -> np.ndarray:
        if figure.__name__ not in b.known:
            b.known[figure.__name__] = figure(b)
        return b.known[figure.__name__]

    return got


@once
def word_chars(b: Block) -> np.ndarray:
    """Code points in words."""
    a, e = b.words
    return np.bincount(b.word_text, weights=e - a, minlength=b.n).astype(np.int64)


@once
def symbols(b: Block) -> np.ndarray:
    c = b.chars
    marks = np.zeros(128, bool)
    marks[[ord(x) for x in SYMBOLS]] = True
    return b.per_text(np.flatnonzero(marks[np.minimum(c, 127)] & (c < 127)))


@once
def dup_lines(b: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    out = np.zeros(b.n, np.int64)
    for i, t in enumerate(b.texts):
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        out[i] = len(lines) - len(set(lines))
    return out


@once
def lines(b: Block) -> np.ndarray:
    return np.array([t.count("\n") + 1 for t in b.texts], np.int64)


@once
def repeat_words(b: Block) -> np.ndarray:
    """Words in windows of three words that the text has twice or more."""
    first, h = b.windows(3)
    if not len(first):
        return np.zeros(b.n, np.int64)
    text = b.word_text[first]
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(b.hashes), bool)
    for i in range(3):
        covered[first[order[twice]] + i] = True
    return np.bincount(b.word_text[covered], minlength=b.n)


@once
def letters(b: Block) -> np.ndarray:
    """Letters with a case, and those in upper case."""
    global _CASE
    if _CASE is None:
        chars = map(chr, range(CASED))
        _CASE = np.array([(x.upper() != x.lower()) + (x.isupper()) for x in chars], np.int8)
    kind = np.where(b.chars < CASED, _CASE[np.minimum(b.chars, CASED - 1)], 0)
    return np.array([b.per_text(np.flatnonzero(kind > 0)), b.per_text(np.flatnonzero(kind == 2))])


_CASE: np.ndarray | None = None


@dataclass(frozen=True)
class Rule:
    """``fails``: for each text of a block, whether it goes."""

    name: str
    fails: Callable[[Block], np.ndarray]


def _shouting(b: Block) -> np.ndarray:
    cased, upper = letters(b)
    return (cased >= 20) & (2 * upper > cased)


def _word_length(b: Block) -> np.ndarray:
    chars = word_chars(b)
    return (chars < 2 * b.n_words) | (chars > 15 * b.n_words)


RULES = (
    Rule("few_words", lambda b: b.n_words < LEAST_WORDS),
    Rule("repeated_words", lambda b: 100 * repeat_words(b) > MOST_REPEATED * b.n_words),
    Rule("word_length", _word_length),
    Rule("symbols", lambda b: 4 * symbols(b) > b.n_words),
    Rule("repeated_lines", lambda b: 2 * dup_lines(b) > lines(b)),
    Rule("shouting", _shouting),
)


#: The rules that make up ``base_failed``.
BASE = ("few_words", "repeated_words")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on about ``rows`` documents sampled from all partitions; the texts stay on the executors.

    What all rules share, finding the words, is done before the clock starts.
    """
    n = docs.count()
    if not n:
        return [(r.name, 0.0, 0.0) for r in rules]

    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("n", T.LongType()), T.StructField("out", T.LongType()), T.StructField("s", T.DoubleType())])

    def timed(batches):
        for f in batches:
            texts = f.column(0).to_pylist()
            for a, z in texts_in_blocks(texts):
                parsed = Block(texts[a:z])
                everything = np.flatnonzero(parsed.n_words >= 0)
                for r in rules:
                    b = parsed.take(everything)
                    began = time.perf_counter()
                    out = r.fails(b)
                    yield batch_of(schema, ([r.name], [z - a], [int(out.sum())], [time.perf_counter() - began]))

    some = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=min(1.0, rows / n), seed=seed)
    found = {x["rule"]: x for x in some.mapInArrow(timed, schema).groupBy("rule").agg(F.sum("n").alias("n"), F.sum("out").alias("out"), F.sum("s").alias("s")).collect()}
    return [(r.name, found[r.name]["s"] / found[r.name]["n"], found[r.name]["out"] / found[r.name]["n"]) if r.name in found else (r.name, 0.0, 0.0) for r in rules]


def ordered(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejection per cost, the best first."""
    gain = {name: share / max(cost, 1e-9) for name, cost, share in measured}
    return tuple(sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name)))


def verdicts(block: Block, rules: tuple[Rule, ...]) -> np.ndarray:
    """The number of the rule that rejects each text, -1 where none does; a rule sees only what is left."""
    by, left = np.full(block.n, -1), np.arange(block.n)
    for k, r in enumerate(rules):
        if not len(left):
            break
        out = r.fails(block)
        if out.any():
            by[left[out]] = k
            left, block = left[~out], block.take(np.flatnonzero(~out))
    return by


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every document."""
    # The contract's figures are due for every document, so the base rules are answered; the others go in order over what they leave.
    more = tuple(r for r in ordered(rules, measure(docs, rules)) if r.name not in BASE)
    schema = T.StructType([field(docs, "doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def judge(batches):
        for f in batches:
            texts = f.column(1).to_pylist()
            for a, z in texts_in_blocks(texts):
                b = Block(texts[a:z])
                n, rep = b.n_words, repeat_words(b)
                failed = (n < LEAST_WORDS) | (100 * rep > MOST_REPEATED * n)
                chars, marks, dup = word_chars(b), symbols(b), dup_lines(b)
                kept, rest = ~failed, np.flatnonzero(~failed)
                kept[rest] = verdicts(b.take(rest), more) < 0
                yield batch_of(schema, (f.column(0).slice(a, z - a), n, chars, marks, dup, rep, failed, kept))

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, all their columns as they were."""
    rules, at = ordered(rules, measure(docs, rules)), docs.columns.index("text")

    def chosen(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            mask = np.concatenate([verdicts(Block(texts[a:z]), rules) < 0 for a, z in texts_in_blocks(texts)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(chosen, docs.schema)
