"""Sharding by sampled splitters, under the law of equal bytes.

1. The key is a hash of the text, then one of the row, so equal texts lie side by side and a large group of them can still be split.
2. A sample in which each row counts by its size gives splitters at equal steps of bytes; they cut the keys into ranges.
3. The bytes of each range are summed exactly. A range that is overfull is subdivided by splitters sampled inside it, until none
   is over its allowance, or a range is one row or has no splitter that parts it.
4. Ranges in key order fill the shards; a shard ends where its share of the bytes does.
5. The slot is the rows of the shard's earlier ranges plus the row's rank in its range, so no task sorts more than one range.

The driver holds splitters and range sums: about ``ranges`` of them, ``ranges`` growing with the rows by ``range_rows``.

Defined cases: a null text has no bytes (size 1) and the checksum of nothing; a null ``doc_id`` is kept; repeated rows each get a
slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window

from .common import F, T, batch_of, stage

SHARDS, RANGES, RANGE_ROWS, PER_RANGE = 16, 2048, 200_000, 16


def _sized(docs: DataFrame) -> DataFrame:
    """Slim rows: what the result needs, and the two halves of the key."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("key2"))


def _sample(rows: DataFrame, share: F.Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the rows that a draw in proportion to their size takes, and how often it takes them; sorted."""
    u = F.pmod(F.xxhash64("key2", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    # A row takes its expected number of draws, rounded up or down at random.
    drawn = rows.withColumn("w", F.floor(F.col("size") * share + u)).filter("w > 0").select("key", "key2", "w").toArrow()
    k, k2, w = (drawn.column(i).to_numpy() for i in range(3))
    order = np.lexsort((k2, k))
    return k[order], k2[order], w[order]


def _quantiles(k: np.ndarray, k2: np.ndarray, w: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Up to ``n - 1`` keys that cut the sample into equal weights."""
    if n < 2 or not len(k):
        return []
    sums = np.cumsum(w)
    at = np.searchsorted(sums, sums[-1] * np.arange(1, n) / n)
    return sorted({(int(k[i]), int(k2[i])) for i in at})


def _range_of(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``rng``: how many of the sorted ``cuts`` are at or below the row's key."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "rng"), T.StructField("rng", T.LongType())])
    names = [f.name for f in schema.fields[:-1]]
    c, c2 = np.array([x for x, _ in cuts], np.int64), np.array([x for _, x in cuts], np.int64)
    firsts = np.unique(c)

    def find(batches):
        for b in batches:
            k, k2 = b.column(names.index("key")).to_numpy(), b.column(names.index("key2")).to_numpy()
            low, high = np.searchsorted(c, k, "left"), np.searchsorted(c, k, "right")
            out = low.copy()
            at = np.searchsorted(firsts, k)
            tied = (high > low) & (at < len(firsts))
            for i in np.flatnonzero(tied):  # the key is also a cut's: the second half decides
                out[i] = low[i] + np.searchsorted(c2[low[i] : high[i]], k2[i], "right")
            yield batch_of(schema, [*(b.column(i) for i in range(len(names))), pa.array(out, pa.int64())])

    return rows.select(names).mapInArrow(find, schema)


def shard(docs: DataFrame, *, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, rng for every document; shards have nearly equal bytes."""
    rows = stage(_sized(docs), "sized")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    ranges = max(ranges, -(-n // range_rows))
    allowance = max(1, 2 * total // ranges)
    cuts = _quantiles(*_sample(rows, F.lit(ranges * PER_RANGE / max(1, total))), ranges)
    placed = rows
    while True:
        placed = _range_of(rows, cuts)
        sums = placed.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toArrow()
        rng, size, count = (sums.column(i).to_numpy() for i in range(3))
        over = (size > allowance) & (count > 1)
        if not over.any():
            break
        # Sample inside the overfull ranges alone, each in proportion to its own bytes.
        pieces = {int(r): int(-(-s * 2 // allowance)) for r, s in zip(rng[over], size[over])}
        within = placed.filter(F.col("rng").isin(list(pieces)))
        drawn = _sample(within, F.lit(4 * PER_RANGE / allowance))
        at = np.array([_below(cuts, x) for x in zip(drawn[0].tolist(), drawn[1].tolist())], np.int64)
        new = {c for r, parts in pieces.items() for c in _quantiles(*(x[at == r] for x in drawn), parts)}
        if not new - set(cuts):
            break
        cuts = sorted({*cuts, *new})
    order = np.argsort(rng)
    rng, size, count = rng[order], size[order], count[order]
    # A range goes where the middle of its bytes lies.
    to = np.minimum(shards - 1, ((np.cumsum(size) - size / 2) * shards / max(1, total)).astype(np.int64)) if n else rng
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    for s in np.unique(to):
        first[to == s] -= first[to == s][0]
    where = docs.sparkSession.createDataFrame(pa.table({"rng": rng, "shard": to.astype(np.int32), "before": first}))
    # Splitters and sums: some ten bytes for ``range_rows`` rows of input.
    joined = placed.join(F.broadcast(where) if len(rng) < 200_000 else where, "rng")
    rank = F.row_number().over(Window.partitionBy("rng").orderBy("key", "key2"))
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "rng")


def _below(cuts: list[tuple[int, int]], x: tuple[int, int]) -> int:
    import bisect

    return bisect.bisect_right(cuts, x)
