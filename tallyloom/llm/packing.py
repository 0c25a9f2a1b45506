"""Best-fit packing with bounds that certify it.

1. Every document becomes pieces of at most ``capacity`` tokens. A full piece is a sequence of its own.
2. The other pieces are dealt at random to partitions of about ``group_rows`` pieces. Each partition runs best-fit decreasing
   and compares its number of bins with the largest lower bound that dual feasible functions give for its sizes. A partition that
   meets its bound is certified: no packing of its pieces needs fewer bins.
3. What can still improve is exchanged: of a partition with a gap, the pieces in bins that are not full; of a certified one, the
   pieces of its emptiest bin. They are dealt anew to fewer partitions and packed again, until a round saves no bin
   or all that is left is one partition.

Each task holds one group of ``group_rows`` slim rows, whatever the corpus; only counts reach the driver.

Defined cases: a null or empty text is one piece with the closing id alone; a null ``doc_id`` is kept; repeated rows are packed
once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import F, T, batch_of, field, parts_for, stage
from .encode import default_file, encoder

CAPACITY, EOS, GROUP_ROWS = 1024, 2, 4096


def pieces(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ``deal``, a number that is unique to the piece's row."""
    path = path or default_file()
    fields = [field(docs, "doc_id", T.LongType()), *(T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("deal", T.LongType())))]
    schema = T.StructType(fields)

    def cut(batches):
        ids_of, row = encoder(path), TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(eos)).astype("<u4")
                n = len(ids)
                at, to = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    for col, v in zip(out, (doc, k, at, to - at, zlib.crc32(ids[at:to].tobytes()), row), strict=True):
                        col.append(v)
                    row += 1
                    at, to = to, to + capacity
            yield batch_of(schema, out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins from three families of dual feasible functions, in whole numbers."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    # Sizes over capacity - e count as a whole bin, those under e as none.
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    for e in range(1, capacity // 2 + 1):
        whole, middle = int(count[-1] - count[capacity - e + 1]), int(total[capacity - e + 1] - total[e])
        best = max(best, whole + -(-middle // capacity))
    # Rounding down to k-ths, but for sizes that are exact (k+1)-ths.
    for k in range(1, 65):
        scaled = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((n * scaled).sum()) // (k * capacity)))
    # Counting how many of size e fit: the large ones give what is left beside them.
    for e in range(1, capacity // 2 + 1):
        per = capacity // e
        twice = np.where(2 * x > capacity, 2 * (per - (capacity - x) // e), np.where(2 * x == capacity, per, 2 * (x // e)))
        best = max(best, -(-int((n * twice).sum()) // (2 * per)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each size, and the room left in each bin."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, room, by_room, open_ = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], [[] for _ in range(capacity + 1)], 0
    for i in order:
        s = int(sizes[i])
        fits = open_ >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                open_ ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i], room[b] = b, capacity - left, left - s
        if left > s:
            by_room[left - s].append(b)
            open_ |= 1 << (left - s)
    return bins, offsets, np.array(room, np.int64)


def _round(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """One round: rows with their sequence, whether they stay there, and on one row of each bin whether the partition is certified."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in (("sequence_id", T.LongType()), ("offset", T.LongType()), ("stays", T.BooleanType()), ("certified", T.BooleanType()), ("first", T.BooleanType())))])

    kept = rows.columns

    def pack(key: tuple, g: pa.Table) -> pa.Table:
        sizes = g.column("length").to_numpy()
        bins, offsets, room = best_fit(sizes, capacity)
        proved = len(room) <= lower_bound(sizes, capacity)
        stays = room == 0
        if proved:
            stays[:] = True
            stays[int(np.argmax(room))] = room.max() == 0
        ids = (turn << 54) + (key[0].as_py() << 22) + bins
        more = {"sequence_id": ids, "offset": offsets, "stays": stays[bins], "certified": np.full(len(bins), proved), "first": offsets == 0}
        return pa.table({n: g.column(n) for n in kept} | {n: pa.array(v) for n, v in more.items()})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(pack, schema)


def pack(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, eos: int = EOS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pack all documents; a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    ``certified``: the piece's partition met its lower bound when the piece got its place (a full piece always has).
    """
    cut = stage(pieces(docs, path=path, capacity=capacity, eos=eos), "pieces")
    whole = cut.filter(F.col("length") == capacity).select(*cut.columns, (-1 - F.col("deal")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    out, rest = [whole], cut.filter(F.col("length") < capacity)
    n, before, last = rest.count(), None, None
    for turn in itertools.count(1):
        if not n:
            break
        parts = parts_for(n, group_rows)
        now = stage(_round(rest, parts, turn, capacity), f"packed{turn}")
        bins, moving, moving_bins = now.agg(F.count_if("first"), F.count_if(~F.col("stays")), F.count_if(F.col("first") & ~F.col("stays"))).first()
        if before is not None and bins >= before:  # the exchange saved nothing: the bins from before hold
            break
        if last is not None:
            out.append(last.filter("stays"))
        last, before, n = now, moving_bins, moving
        rest = now.filter("not stays").select(cut.columns)
        if parts == 1:
            break
    if last is not None:
        out.append(last)
    joined = out[0]
    for x in out[1:]:
        joined = joined.unionByName(x.select(joined.columns))
    return joined.drop("deal")
