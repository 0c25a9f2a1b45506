"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of the multisets of five-word shingles.

1. *Signatures.* Each shingle carries Poisson processes over its weight, one for each dyadic range of weights ([0,1), [1,2), [2,4), ...),
   seeded by the shingle alone. A point has a time, a register and a place on the weight axis, and counts if the place lies under the
   shingle's weight in the document. A register keeps its earliest point. Two documents agree in a register with the probability of
   their weighted Jaccard similarity, and points later than what every register already has are never drawn.
2. *Bands.* ``BANDS`` bands of ``ROWS`` registers; documents that agree in a band share a bucket. Equal word sequences are one node.
3. *Links.* In each bucket all nodes are held, by exact multiset overlap, against one hub, the node that meets most others; linked nodes
   form components. Two nodes of a bucket in different components can be similar only if they share a shingle that their hub lacks, or if
   one is smaller than the hub and both share enough with it (a pair of any sizes may do the former); such pairs are held too, whatever their number. Copies of one text differ from it by edits of their own, so
   a group of copies costs links in proportion to its size, and no link between components is left out.

At a similarity of 0.8 a pair shares no band with probability 7e-6.

Defined cases: a null or empty text has no words and is a class of its own; a text of one to four words has one shingle, all of it; a null
``doc_id`` is kept, and a class whose documents all have none has a null ``class_id``; repeated rows fall into one class; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from .common import F, T, batch_of, field, stage, texts_in_blocks
from .graph import components
from .textblock import Block, mix

SHINGLE, BANDS, ROWS = 5, 30, 5
#: Similarity of at least 4/5, in whole numbers.
SIMILAR, OF = 4, 5
#: The bitmap of nodes whose multisets are needed has 2 ** this many bits at most.
MARK_BITS = 27
_STEP, _GOLD = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)


def shingles(b: Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: text, hash, how often; sorted by text and hash. A text of fewer than ``k`` words is one shingle."""
    first, h = b.windows(k)
    text = b.word_text[first]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < k))
    if len(short):
        own = [_digest(b, i) for i in short]
        text, h = np.concatenate([text, short]), np.concatenate([h, np.array(own, np.uint64)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.zeros(0, np.int64)
    return text[new], h[new], np.diff(np.append(new, len(h)))


def _digest(b: Block, i: int) -> int:
    words = b.hashes[b.word_starts[i] : b.word_starts[i + 1]]
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def signatures(text: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """``n`` x ``m`` registers; rows of texts without shingles stay at the largest number."""
    # A process for each dyadic range of weights that the weight reaches into.
    tops = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64)
    reach = np.repeat(np.arange(len(h)), tops + 1)
    level = np.arange(len(reach)) - np.repeat(np.cumsum(tops + 1) - tops - 1, tops + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    wide = np.maximum(low, 1)
    seed = mix(h[reach] + level.astype(np.uint64) * _STEP)
    of, weight = text[reach], w[reach]
    total = np.bincount(text, weights=w, minlength=n)
    out, todo = np.full(n * m, np.inf), total > 0
    until = np.where(todo, (np.log(m) + 3) / np.maximum(total, 1), 0)
    while todo.any():
        at = np.flatnonzero(todo[of])
        t, k = np.zeros(len(at)), 0
        while len(at):
            # Several draws at once where many are due; added up one by one, so that a point's time is the same number in every document.
            due = int(np.median((until[of[at]] - t) * m * wide[at]))
            c = max(1, min(due, 64, 400_000 // len(at)))
            with np.errstate(over="ignore"):
                r = mix(seed[at][:, None] + np.arange(k + 1, k + c + 1, dtype=np.uint64)[None, :] * _GOLD)
            gaps = -np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / (m * wide[at])[:, None]
            times = np.cumsum(np.hstack([t[:, None], gaps]), axis=1)[:, 1:]
            on = times <= until[of[at]][:, None]
            i, j = np.nonzero(on)
            own, draw = at[i], r[i, j]
            cell = low[own] + ((mix(draw) >> np.uint64(32)).astype(np.int64) * wide[own] >> 32) * (level[own] > 0)
            hit = cell < weight[own]
            reg = ((draw & np.uint64(0xFFFFFF)).astype(np.int64) * m) >> 24
            np.minimum.at(out, of[own[hit]] * m + reg[hit], times[i, j][hit])
            at, t, k = at[on[:, -1]], times[on[:, -1], -1], k + c
        todo &= np.isinf(out.reshape(n, m)).any(axis=1)
        until = until * 2
    return out.view(np.uint64).reshape(n, m)


def bands(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    n, m = registers.shape
    with np.errstate(over="ignore"):
        key = np.arange(1, m // rows + 1, dtype=np.uint64)[None, :] * _STEP + np.zeros((n, 1), np.uint64)
        for i in range(rows):
            key = mix(key * _GOLD + registers[:, i::rows][:, : m // rows])
    return key.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _nodes(b: Block) -> np.ndarray:
    return np.array([_digest(b, i) if b.n_words[i] else 0 for i in range(b.n)], np.uint64).view(np.int64)


def sketch(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """row (unique), doc_id, node (of its word sequence; null without words), n (weight), bands."""
    schema = T.StructType([T.StructField("row", T.LongType()), field(docs, "doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def draw(batches):
        row = TaskContext.get().partitionId() << 36
        for f in batches:
            texts = f.column(1).to_pylist()
            for a, z in texts_in_blocks(texts):
                b = Block(texts[a:z])
                text, h, w = shingles(b)
                keys = bands(signatures(text, h, w, b.n, n_bands * rows), rows)
                keys = keys[b.n_words > 0]
                sizes = np.where(b.n_words > 0, n_bands, 0)
                node = pa.array(_nodes(b), mask=b.n_words == 0)
                yield batch_of(schema, (np.arange(row, row + b.n), f.column(0).slice(a, z - a), node, np.bincount(text, weights=w, minlength=b.n).astype(np.int32), _lists(keys.ravel(), np.concatenate([[0], np.cumsum(sizes)]))))
                row += b.n

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(draw, schema)


def marked(nodes: DataFrame, most: int = MARK_BITS) -> np.ndarray:
    """A bitmap over the low bits of the ``nodes``' numbers, 16 bits for each node, 2 ** ``most`` (16 MB) in all at most.

    What it doesn't mark is no such node; what it marks may be one. So it only spares work, the less the fuller it is.
    """
    n = nodes.count()
    width = min(most, max(10, (16 * n).bit_length()))
    word = F.shiftrightunsigned("node", 6).bitwiseAND(F.lit((1 << (width - 6)) - 1))
    rows = nodes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node & 63L as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _is_marked(nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    word = (nodes.view(np.uint64) >> np.uint64(6)) & np.uint64(len(bits) - 1)
    return (bits[word.astype(np.int64)] >> (nodes & 63)) & 1 == 1


def bags(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """node, bag of the nodes that ``bits`` marks: the multiset of a word sequence as 64-bit numbers, one for each shingle and each time that
    it occurs."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("bag", T.ArrayType(T.LongType()))])

    def fill(batches):
        for f in batches:
            texts = f.column(0).to_pylist()
            for a, z in texts_in_blocks(texts):
                b = Block(texts[a:z])
                wanted = np.flatnonzero((b.n_words > 0) & _is_marked(_nodes(b), bits))
                if not len(wanted):
                    continue
                b = b.take(wanted)
                text, h, w = shingles(b)
                each = np.repeat(np.arange(len(h)), w)
                time = np.arange(len(each)) - np.repeat(np.cumsum(w) - w, w)
                with np.errstate(over="ignore"):
                    e = mix(h[each] + time.astype(np.uint64) * _STEP).view(np.int64)
                at = np.searchsorted(text[each], np.arange(b.n + 1))
                nodes = _nodes(b)
                once = np.sort(np.unique(nodes, return_index=True)[1])
                values = np.concatenate([e[at[i] : at[i + 1]] for i in once])
                yield batch_of(schema, (nodes[once], _lists(values, np.concatenate([[0], np.cumsum(at[once + 1] - at[once])]))))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(fill, schema).groupBy("node").agg(F.first("bag").alias("bag"))


def _near(n: str, k: str) -> F.Column:
    """Sizes that allow the similarity."""
    return OF * F.least(n, k) >= SIMILAR * F.greatest(n, k)


def _held(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """Of the pairs ``a``, ``b`` those whose multisets overlap enough."""
    x = pairs.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a")
    y = x.join(bag.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return y.filter((SIMILAR + OF) * common >= SIMILAR * (F.size("x") + F.size("y"))).select("a", "b")


def _open(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows of the buckets that hold several components, with their component."""
    own = buckets.withColumn("comp", F.col("node")) if comps is None else buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = own.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c < d").select("key")
    return stage(own.join(several, "key"), "open")


class _Found:
    """The pairs held so far, the links among them, and the components that these make."""

    def __init__(self, bag: DataFrame):
        self.bag, self.tried, self.edges, self.comps = bag, None, None, None

    def hold(self, pairs: DataFrame) -> bool:
        """Hold new pairs against each other; whether one is a link."""
        new = stage(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        self.tried = new if self.tried is None else self.tried.unionByName(new)
        linked = stage(_held(new, self.bag), "linked")
        if linked.isEmpty():
            return False
        # Components of components: earlier links count as the stars that they made.
        stars = linked if self.comps is None else linked.unionByName(self.comps.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
        self.comps = components(stars)
        return True

    def stars(self, met: DataFrame) -> None:
        """Hold each node of a bucket against the bucket's hub."""
        self.hold(met.filter((F.col("node") != F.col("hub")) & _near("n", "hub_n")).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())

    def across(self, left: DataFrame) -> None:
        """Hold the pairs of different components in a bucket that can be similar.

        Of such a pair one, x, is not similar to the hub h; let all that x and the other, y, share be in h. Then each shares at least as much
        with h as with the other. If y is no smaller than h, x would be as similar to h as to y. So either they share something that h lacks:
        nodes of every size meet by what they hold beyond their hub. Or one is smaller than h, and what each shares with h is enough for the
        pair.
        """
        pairs = left.select("node", "hub", "n", "hub_n", "comp").distinct().join(self.bag, "node").withColumnRenamed("bag", "x")
        pairs = pairs.join(self.bag.select(F.col("node").alias("hub"), F.col("bag").alias("y")), "hub").withColumn("more", F.array_except("x", "y"))
        own = stage(pairs.select("node", "hub", "n", "hub_n", "comp", (F.size("x") - F.size("more")).alias("common"), "more"), "beyond")
        # A pair's overlap is at most what both share with h and what they share beyond: so much of the latter must be shared (``need``, for the
        # smallest partner). Of ``m`` things in one order, rarest first, a pair that shares ``need`` shares one of the first ``m - need + 1``.
        # Two nodes no smaller than the hub have a partner of the hub's size at least; where one is smaller, the partner may be any near size.
        def needed(partner: F.Column) -> F.Column:
            return F.greatest(F.lit(1), F.ceil((F.col("n") + partner) * SIMILAR / (SIMILAR + OF)) - F.col("common"))

        smallest = F.ceil(F.col("n") * SIMILAR / OF)
        sets = own.withColumns({"m": F.size("more"), "need": needed(smallest), "need_big": needed(F.greatest("hub_n", smallest))}).filter("m >= need")
        beyond = sets.select("node", "hub", "n", "hub_n", "comp", "common", "m", "need", "need_big", F.explode(F.transform("more", lambda e: F.xxhash64("hub", e))).alias("key"))
        several = stage(beyond.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count("*").alias("held")).filter("c < d").select("key", "held"), "several")
        own_set = Window.partitionBy("node", "hub")
        # What only one component holds is shared by no pair and comes first in the order.
        apart = beyond.join(several, "key").withColumn("place", F.col("m") - F.count("*").over(own_set) + F.row_number().over(own_set.orderBy("held", "key")))
        apart = stage(apart.filter("place <= m - need + 1").select("node", "n", "comp", "common", "m", "key", (F.col("n") < F.col("hub_n")).alias("low"), (F.col("place") <= F.col("m") - F.col("need_big") + 1).alias("first")), "apart")
        most = F.least("x.common", "y.common") + F.least("x.m", "y.m")
        fit = _near("x.n", "y.n") & ((SIMILAR + OF) * most >= SIMILAR * (F.col("x.n") + F.col("y.n")))
        big = apart.filter("not low and first")
        big = big.alias("x").join(big.alias("y"), "key").filter("x.node > y.node and x.comp <> y.comp").filter(fit)
        low = apart.filter("low").alias("x").join(apart.alias("y"), "key").filter("(x.node > y.node or not y.low) and x.comp <> y.comp").filter(fit)
        rows = left.join(own.select("node", "hub", "common"), ["node", "hub"]).filter((SIMILAR + OF) * OF * F.col("common") >= SIMILAR * (SIMILAR + OF) * F.col("n"))
        enough = (SIMILAR + OF) * F.least("x.common", "y.common") >= SIMILAR * (F.col("x.n") + F.col("y.n"))
        small = rows.filter("n < hub_n").alias("x").join(rows.alias("y"), "key").filter("x.node <> y.node and x.comp <> y.comp").filter(enough)
        pairs = [f.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")) for f in (big, low, small)]
        self.hold(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct())


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Components (node, comp) of ``nodes`` (node, n, bands); None where nothing is linked."""
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    # Aggregates are written before they are joined: a join of two plain exchanges is one that Spark splits where a bucket is large.
    shared = stage(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    # What shares a bucket with another node, from here on; ``meets``: how many nodes a node shares buckets with, each time counted.
    pairs = stage(keyed.join(shared, "key"), "shared")
    met = pairs.drop("size").join(pairs.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets")), "node")
    # The hub is the node that meets most others: what a group was copied from meets its copies most.
    first = -(F.col("meets") + (F.pmod("node", F.lit(1 << 30)) + 1) / float(1 << 31))
    met = stage(met, "counted")
    hubs = stage(met.groupBy("key").agg(F.min_by("node", first).alias("hub"), F.min_by("n", first).alias("hub_n")), "hubs")
    met = stage(met.drop("meets").join(hubs, "key"), "met")
    # Multisets only of what meets another node: the others' are neither made nor shuffled.
    meeting = stage(met.select("node").distinct(), "meeting")
    found = _Found(stage(bags(docs, marked(meeting)).join(meeting, "node", "left_semi"), "bags"))
    found.stars(met)
    found.across(_open(met, found.comps))
    return found.comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_rows, keep, row for every document.

    ``class_id``: the least ``doc_id`` of the documents that hang together by links of similarity 0.8 or more; ``keep``: the one of the class
    that stays, its first row.
    """
    rows = stage(sketch(docs), "sketch")
    merged = rows.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    nodes = stage(merged, "nodes")
    comps = links(nodes.select("node", "n", "bands"), docs)
    nodes = nodes.drop("n", "bands")
    nodes = nodes.withColumn("comp", F.col("node")) if comps is None else nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = nodes.groupBy("comp").agg(F.min("row").alias("kept"), F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_rows"))
    of_node = stage(nodes.select("node", "comp").join(classes, "comp").drop("comp"), "classes")
    out = rows.select("row", "doc_id", "node").join(of_node, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"), F.coalesce(F.col("row") == F.col("kept"), F.lit(True)).alias("keep"), "row")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, all columns as they were.

    ``docs`` is read twice and must give its rows in the same partitions and order each time, as a table does.
    """
    key = "_row" + "".join(docs.columns)
    keyed = docs.withColumn(key, F.monotonically_increasing_id())
    gone = stage(near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).filter("not keep").select(F.col("doc_id").alias(key)), "gone")
    return keyed.join(gone, key, "left_anti").drop(key)
