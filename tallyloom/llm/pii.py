"""Personal data: fixed patterns for four kinds, and identifiers that bootstrapped contexts discover.

1. The base entities (email, ip, card, phone) are the seeds.
2. Seeds induce lexical patterns: the word, and the two words, to their left. Other tokens with a digit and ``LEAST_SIGNS``
   letters and digits are candidates, instances of the patterns to their left.
3. Spark scores the graph of patterns and instances: a pattern's confidence is the mean score of its mentions, an instance's score is the
   confidence of its best pattern; seeds keep 1. ``ROUNDS`` rounds.
4. Patterns of high confidence that ``SUPPORT`` distinct seeds or instances trusted in the round before carry make candidates beside them spans of kind ``context``.

All counts are over the whole corpus; they combine before the shuffle, so a common context is no hot spot.

Defined cases: a null or empty text has no spans; a null ``doc_id`` is kept; repeated rows are scanned once each; an empty table gives no
rows; other columns are ignored (``redact`` passes them on). Places are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import F, T, batch_of, field, stage

KINDS = ("email", "ip", "card", "phone", "context")
# The base patterns. Guards and possessive repeats keep each linear on long runs; they change no match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LEAST_SIGNS, SUPPORT, CONFIDENCE, ROUNDS = 4, 5, 0.6, 3
#: Patterns that a closure carries to the executors at most (8 bytes each); beyond, they are joined.
CARRIED = 1_000_000
_TOKEN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*")
_LEFT = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                end = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def contexts(text: str, starts: list[int]) -> dict[int, list[int]]:
    """The patterns to the left of each place (the last word, the last two), however far off; a word ends where another place begins.

    Each stretch between two places is read once, from its end, until it has given two whole words.
    """
    out, words, low = {}, [], 0
    for start in sorted(set(starts)):
        reach = 64
        while True:
            at = max(low, start - reach)
            new = _LEFT.findall(text, at, start)
            if at == low or len(new) > 2:
                break
            reach *= 4
        words, low = ([*words, *new] if at == low else new)[-2:], start
        lower = [w.lower() for w in words]
        out[start] = [_hash(*lower[i:]) for i in range(len(lower) - 1, -1, -1)]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit and ``LEAST_SIGNS`` letters and digits that no base span touches, without the punctuation around them."""
    out, taken, k = [], sorted((a, e) for _, a, e in base), 0
    for m in _TOKEN.finditer(text):
        a, e = m.span()
        while a < e and not text[a].isalnum():
            a += 1
        while e > a and not text[e - 1].isalnum():
            e -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < e or sum(map(str.isalnum, text[a:e])) < LEAST_SIGNS:
            continue
        out.append((a, e))
    return out


def _mentions(text: str) -> list[tuple[int, int, int, list[int]]]:
    """Base spans and candidates with the patterns to their left."""
    base = base_spans(text)
    own = base + [(4, a, e) for a, e in candidates(text, base)]
    left = contexts(text, [a for _, a, _ in own])
    return [(k, a, e, left[a]) for k, a, e in own]


MENTION = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("instance", T.LongType()), T.StructField("patterns", T.ArrayType(T.LongType()))])


def mentions(docs: DataFrame) -> DataFrame:
    """row, doc_id, mentions: base spans and candidates of each text with the patterns to their left."""
    schema = T.StructType([T.StructField("row", T.LongType()), field(docs, "doc_id", T.LongType()), T.StructField("mentions", T.ArrayType(MENTION))])

    def scan(batches):
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for text in b.column(1):
                t = text.as_py() or ""
                out.append([{"start": a, "end": e, "kind": k, "instance": _hash(t[a:e]), "patterns": left} for k, a, e, left in _mentions(t)])
            yield batch_of(schema, (list(range(row, row + len(out))), b.column(0), out))
            row += len(out)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def trusted(found: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence: the patterns that may discover."""
    each = found.select(F.explode("mentions").alias("m")).select("m.instance", (F.col("m.kind") < 4).alias("seed"), F.explode("m.patterns").alias("pattern"))
    edges = each.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = stage(edges, "edges")
    score = None
    for _ in range(rounds):
        own = F.col("seed").cast("double")
        known = edges.withColumn("s", own) if score is None else edges.join(score, "instance", "left").withColumn("s", F.greatest(own, F.coalesce("score", F.lit(0.0))))
        sure = stage(known.groupBy("pattern").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("confidence"), F.count_if(F.col("s") > 0).alias("carried")).filter(F.col("carried") >= support).drop("carried"), "patterns")
        score = edges.filter("not seed").join(sure.filter(F.col("confidence") >= confidence), "pattern").groupBy("instance").agg(F.max("confidence").alias("score"))
    return sure.filter(F.col("confidence") >= confidence)


def annotate(docs: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, found: array of (kind, start, end) by kind and start, for every document."""
    rows = stage(mentions(docs), "mentions")
    sure = stage(trusted(rows, support=support, confidence=confidence, rounds=rounds), "trusted")
    unseen = rows.select("row", F.explode("mentions").alias("m")).filter("m.kind = 4").select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    more = unseen.join(sure.select("pattern"), "pattern", "left_semi").select("row", "start", "end").distinct()
    more = more.groupBy("row").agg(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end")).alias("more"))
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"] < 4), span)
    out = rows.select("row", "doc_id", base.alias("base")).join(more, "row", "left")
    return out.select("row", "doc_id", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))).alias("found"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context and n_all (spans of every kind) for every document."""
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return annotate(docs).select("doc_id", *(of(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(joined(F.filter("found", lambda x: x["kind"] < 4)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), of(4).alias("n_context"), F.size("found").cast("long").alias("n_all"))


def hidden(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the stretch they cover, by the first one's kind."""
    out, at, merged = [], 0, []
    for a, e, k in sorted((a, e, k) for k, a, e in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e, k])
    for a, e, k in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, carried: int = CARRIED) -> DataFrame:
    """All documents with every span replaced by its kind, ``n_chars`` (if there) brought up to date; other columns as they were."""
    sure = stage(trusted(stage(mentions(docs), "mentions"), support=support, confidence=confidence, rounds=rounds), "trusted")
    if sure.count() <= carried:
        known = np.sort(np.array(sure.select("pattern").toArrow().column(0).to_pylist(), np.int64))
        return _rewrite(docs, lambda t: _with_known(t, known))
    return _joined(docs, sure)


def _with_known(text: str, known: np.ndarray) -> list[tuple[int, int, int]]:
    has = lambda p: (i := int(np.searchsorted(known, p))) < len(known) and int(known[i]) == p
    return [(k, a, e) for k, a, e, left in _mentions(text) if k < 4 or any(map(has, left))]


def _rewrite(docs: DataFrame, spans_of) -> DataFrame:
    schema = docs.schema
    at = schema.names.index("text")

    def write(batches):
        for b in batches:
            columns = [b.column(i) for i in range(len(schema))]
            texts = columns[at].to_pylist()
            new = [t if not t or not (s := spans_of(t)) else hidden(t, s) for t in texts]
            columns[at] = new
            if "n_chars" in schema.names:
                n = schema.names.index("n_chars")
                columns[n] = [old if t == was else len(t) for old, t, was in zip(columns[n].to_pylist(), new, texts)]
            yield batch_of(schema, columns)

    return docs.mapInArrow(write, schema)


def _joined(docs: DataFrame, sure: DataFrame) -> DataFrame:
    """The same where the patterns are too many to carry: discovered places reach their texts by a join."""
    key = "_row" + "".join(docs.columns)
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "texts")
    seen = mentions(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.explode("mentions").alias("m")).filter("m.kind = 4")
    hits = seen.select(key, "m.start", "m.end", F.explode("m.patterns").alias("pattern")).join(sure.select("pattern"), "pattern", "left_semi")
    found = "_spots" + key
    spots = hits.groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias(found))
    both = rows.join(spots, key, "left")
    schema, at = docs.schema, docs.columns.index("text")

    def write(batches):
        for b in batches:
            columns = [b.column(b.schema.names.index(n)) for n in schema.names]
            texts, more = columns[at].to_pylist(), b.column(b.schema.names.index(found)).to_pylist()
            new = [t and hidden(t, base_spans(t) + [(4, x["start"], x["end"]) for x in m or ()]) for t, m in zip(texts, more)]
            columns[at] = new
            if "n_chars" in schema.names:
                n = schema.names.index("n_chars")
                columns[n] = [old if t == was else len(t) for old, t, was in zip(columns[n].to_pylist(), new, texts)]
            yield batch_of(schema, columns)

    return both.mapInArrow(write, schema)
