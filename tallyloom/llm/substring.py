"""Substring dedup by content-defined chunking.

A gear hash rolls over the last 16 code points; where it falls under a bar, a chunk ends. The cut depends on those characters alone, so a
passage is cut alike wherever it stands, and an insertion changes the chunks around it only. Chunks are deduplicated by digest; those that
several documents hold form runs, and a run is reported if the passage behind it may have ``LEAST_WORDS`` words: the run and the chunks
at its two ends, into which the passage may reach, count. So no repeat of that length is left out by where it happens to be cut; one a few
words shorter may be reported.

Equal digests of 64 bits and equal lengths count as equal chunks; with runs of several chunks an accident of hashing reports nothing.

Defined cases: a null or empty text has no chunks; a null ``doc_id`` is kept; a repeated row repeats all of its text; a passage that only
one document repeats inside itself isn't reported; an empty table gives no rows; other columns are ignored. Places are code points, the end
exclusive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from .common import F, T, batch_of, field, stage, texts_in_blocks
from .textblock import Block, mix

#: Mean, least and most code points of a chunk; shorter ones are passed over, and runs reach across them.
MEAN, LEAST, MOST, WINDOW = 24, 8, 256, 16
LEAST_WORDS, LEAST_CHARS = 50, 16


def gear(chars: np.ndarray) -> np.ndarray:
    """The rolling hash after each character: 16 bits, each step shifting the older characters out by one bit."""
    h = (mix(chars.astype(np.uint64) + np.uint64(7)) >> np.uint64(40)).astype(np.uint16)
    width = 1
    while width < WINDOW:  # doubling: the hash of a window from those of its two halves
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint16(width) if width < len(h) else 0
        h, width = h + older, 2 * width
    return h


def chunks(b: Block, mean: int = MEAN) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in ``b.chars`` of all chunks of at least ``LEAST`` code points, in order."""
    low = b.starts[:-1]
    h = gear(b.chars)
    cut = np.flatnonzero(h < 65536 // mean) + 1
    # Near its start a text's hash would hold the text before.
    of = np.searchsorted(low, cut, "right") - 1
    cut = cut[(cut >= low[of] + WINDOW) & (cut < b.starts[of + 1])]
    ends = b.starts[1:] - 1
    edges = np.unique(np.concatenate([cut, low, ends]))
    a, e = edges[:-1], edges[1:]
    inside = ~np.isin(a, ends) | np.isin(a, low)
    a, e = a[inside & (e > a)], e[inside & (e > a)]
    if (e - a > 4 * mean).any():
        whole = e - a <= 4 * mean
        pieces = [p for x, y in zip(a[~whole].tolist(), e[~whole].tolist()) for p in _split(h, x, y)]
        a, e = np.sort(np.concatenate([a[whole], [x for x, _ in pieces]])), np.sort(np.concatenate([e[whole], [y for _, y in pieces]]))
    a, e = _gather(a, e)
    long = e - a >= LEAST
    return a[long], e[long]


def _gather(a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join short chunks that follow each other, up to a quarter of ``MOST``; where a hash under the bar repeats, all chunks are short."""
    short = e - a < LEAST
    joins = np.concatenate([[False], short[1:] & short[:-1] & (a[1:] == e[:-1])])
    if not joins.any():
        return a, e
    keep = np.ones(len(a), bool)
    e = e.copy()
    head = -2
    for i in np.flatnonzero(joins).tolist():
        if head < 0 or not joins[i - 1]:
            head = i - 1
        if e[i] - a[head] <= MOST // 4:
            e[head], keep[i] = e[i], False
        else:
            head = i
    return a[keep], e[keep]


def _split(h: np.ndarray, a: int, e: int) -> list[tuple[int, int]]:
    """Cut a long stretch without an end where its least hash repeats, a quarter of ``MOST`` apart or more: a word or line said again and
    again is cut at one phase everywhere. One that repeats nothing is cut only beyond ``MOST``."""
    out, todo = [], [(a, e)]
    while todo:
        a, e = todo.pop()
        inner = h[a + LEAST : e - LEAST]
        least = np.flatnonzero(inner == inner.min()) + a + LEAST + 1 if len(inner) else inner
        if e - a <= MOST // 4 or e - a <= MOST and len(least) < 2:
            out.append((a, e))
            continue
        cuts = []
        for p in least.tolist():
            if not cuts or p - cuts[-1] >= MOST // 4:
                cuts.append(p)
        if len(least) > 1:
            out += zip([a, *cuts], [*cuts, e], strict=True)
        else:
            todo += zip([a, *cuts], [*cuts, e], strict=True)
    return out


def chunked(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id and, in step, digest, start, end, and the words from the chunk before to the chunk after: low, high."""
    lists = [T.StructField(n, T.ArrayType(k)) for n, k in (("digest", T.LongType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("low", T.IntegerType()), ("high", T.IntegerType()))]
    schema = T.StructType([T.StructField("row", T.LongType()), field(docs, "doc_id", T.LongType()), *lists])

    def cut(batches):
        row = TaskContext.get().partitionId() << 36
        for f in batches:
            texts = f.column(1).to_pylist()
            for x, z in texts_in_blocks(texts):
                b = Block(texts[x:z])
                a, e = chunks(b)
                of = np.searchsorted(b.starts, a, "right") - 1
                before, after = np.where(np.concatenate([[False], of[1:] == of[:-1]]), np.roll(a, 1), b.starts[of]), np.where(np.concatenate([of[1:] == of[:-1], [False]]), np.roll(e, -1), b.starts[of + 1] - 1)
                if not len(a):
                    before = after = a
                at = np.searchsorted(of, np.arange(b.n + 1)).astype(np.int32)
                # A word counts where it starts; the one that the chunk before cuts counts too.
                words = b.words[0]
                low, high = np.searchsorted(words, before, "right") - 1, np.searchsorted(words, after)
                make = lambda v, t: pa.ListArray.from_arrays(pa.array(at), pa.array(v, t))
                yield batch_of(schema, (np.arange(row, row + b.n), f.column(0).slice(x, z - x), make(b.span_hashes(a, e).view(np.int64), pa.int64()), make(a - b.starts[of], pa.int32()), make(e - b.starts[of], pa.int32()), make(low - b.word_starts[of], pa.int32()), make(high - b.word_starts[of], pa.int32())))
                row += b.n

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def repeats(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, end, chunks, kept: each run of chunks that other documents hold too, in parts where ``kept`` changes.

    ``kept``: the document is the first that holds the chunks of the part, so each chunk's first copy stays where the others are cut. How
    long a run is is judged before it is parted.
    """
    rows = stage(chunked(docs), "chunks")
    each = rows.select("row", F.posexplode(F.arrays_zip("digest", "start", "end", "low", "high")).alias("at", "c")).select("row", "at", "c.digest", "c.start", "c.end", "c.low", "c.high")
    size = F.xxhash64("digest", F.col("end") - F.col("start"))
    # Written first: a join of two plain exchanges is one that Spark splits where a chunk that many documents hold makes a partition large.
    shared = stage(each.select("row", size.alias("key")).groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first < last").drop("last"), "shared")
    hit = each.select("row", size.alias("key"), "at", "start", "end", "low", "high").join(shared, "key").drop("key")
    order = Window.partitionBy("row").orderBy("at")
    kept = F.col("first") == F.col("row")
    apart = hit.withColumns({"new": (F.col("at") - F.lag("at", 1, -2).over(order) > 1).cast("int"), "kept": kept, "turn": (kept != F.lag(kept, 1).over(order)).cast("int")})
    apart = apart.withColumns({"run": F.sum("new").over(order), "part": F.sum(F.greatest("new", F.coalesce("turn", F.lit(1)))).over(order)})
    parts = apart.groupBy("row", "run", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("chunks"), F.first("kept").alias("kept"))
    whole = Window.partitionBy("row", "run")
    long = (F.max("high").over(whole) - F.min("low").over(whole) >= least_words) & (F.max("end").over(whole) - F.min("start").over(whole) >= LEAST_CHARS)
    runs = parts.withColumn("long", long).filter("long")
    return runs.join(rows.select("row", "doc_id"), "row").select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "chunks", "kept")
