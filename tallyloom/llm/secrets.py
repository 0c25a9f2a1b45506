"""Secret scan with a battery of randomness tests; DataFrame functions only.

Base spans come from three fixed patterns. The method then tests other token-like runs: the narrowest encoding whose alphabet holds
the run is inferred, and under the hypothesis that its characters are drawn uniformly and independently from that alphabet

* chi-squared: the counts of the alphabet's characters are even;
* runs: the number of runs above and below the alphabet's middle is as expected;
* serial correlation: neighbouring characters are uncorrelated.

A run that no encoding holds, as ``name=value`` or a path, is tested in parts of ``SHORTEST`` characters or more: cut at '=' (which only
ends an encoding), and where that part still mixes '/' or '+' with '_' or '-', at the former, and what is left over at the latter.

The least of the three p-values times three is the run's p-value. Runs of similar length form a class, since short ones have little
power; in each class Benjamini and Hochberg's step-up over all runs of the corpus decides which are not random, so that at most
``FDR`` of the runs dismissed were random. What isn't dismissed is a span of kind ``random``.

Matches are found without Python: the pieces between matches (``split``) and the matches themselves give the places.

Defined cases: a null or empty text has no spans; a null ``doc_id`` is kept; repeated rows are scanned once each; an empty table gives
no rows; other columns are ignored. Places are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window

from .common import F, stage

# Patterns and least lengths of the base spans, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

#: A run that the battery tests: long enough for the tests to tell, with a letter. Digits alone are a number: even of hexadecimal keys of
#: 20 digits only one in 12,000 has no letter, while one in 34 base62 keys has no digit, so a digit isn't asked for.
SHORTEST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
#: Parts of a run that fits no encoding: between '=', of base64url, of base64; padding counts at the run's end.
PARTS = tuple(rf"(?<![A-Za-z{c}])(?=[{c}]*+[A-Za-z])[A-Za-z{c}]{{{SHORTEST},}}+(?:=++\z)?" for c in ("0-9+/_-", "0-9_-", "0-9+/"))
SPAN, BLOCK = "struct<start:int,k:int,end:int,m:string>", 128
FAR = 2**31 - 1
FDR, BINS, CLASSES = 0.05, 400, (24, 32, 48, 64)
#: Encodings from narrow to wide: pattern of the whole run, alphabet in its order.
ENCODINGS = (
    ("hex", "[0-9a-f]+", "0123456789abcdef"),
    ("hex", "[0-9A-F]+", "0123456789ABCDEF"),
    ("base32", "[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "[0-9A-Z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "[0-9A-Za-z]+", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "[0-9A-Za-z_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "[0-9A-Za-z+/]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def let(value: F.Column, use) -> F.Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _grown(values: F.Column, start: F.Column, op) -> F.Column:
    """What ``op`` has made of ``start`` and the values before each; each step copies the array, so for short ones."""
    state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, state, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def before(values: F.Column, start: int, op) -> F.Column:
    """For each of the whole numbers what the associative ``op`` makes of those before it; ``start`` is its neutral element.

    Goes by blocks of ``BLOCK`` and the blocks' own results, so that a million values cost no copies of long arrays.
    """
    block = lambda vs, i: F.transform(F.sequence(i * BLOCK, F.least(F.size(vs), (i + 1) * BLOCK) - 1), lambda j: F.get(vs, j))
    blocks = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda i: block(vs, i))
    whole = lambda bs: _grown(F.transform(bs, lambda b: F.aggregate(b, F.lit(start), op)), F.lit(start), op)
    each = lambda bs: F.flatten(F.zip_with(bs, whole(bs), lambda b, at: _grown(b, at, op)))
    return let(values, lambda vs: F.when(F.size(vs) == 0, F.array().cast("array<int>")).otherwise(let(blocks(vs), each)))


def found(text: F.Column, pattern: str, kind: str) -> F.Column:
    """All matches, leftmost and not overlapping: array of (start, kind_no, end, match). The pattern matches no empty string."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    paired = lambda ms: F.zip_with(F.slice(gaps, 1, F.size(ms)), ms, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"), F.length(m).alias("n")))
    placed = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("k"), (at + x["gap"] + x["n"]).alias("end"), x["m"].alias("m"))
    spans = lambda ps: F.zip_with(ps, before(F.transform(ps, lambda x: x["gap"] + x["n"]), 0, lambda u, v: u + v), placed)
    return let(whole, lambda ms: F.when(F.size(ms) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(let(paired(ms), spans)))


def normal_tail(z: F.Column) -> F.Column:
    """P(N > z), by the rational approximation whose error is under 7.5e-8."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def battery(m: F.Column, alphabet: F.Column) -> F.Column:
    """The p-value of a run of characters of ``alphabet``: three times the least of the three tests'.

    The counts come from a few passes over the run as a string, the sum of neighbours' products from one over its characters.
    """
    return let(F.rtrim(m, F.lit("=")), lambda body: let(_counted(body, alphabet), _p_value))


def _counted(body: F.Column, alphabet: F.Column) -> F.Column:
    """n, size, squares (of the characters' counts), ones (characters of the alphabet's upper half), runs, cov."""
    n, size = F.length(body), F.length(alphabet)
    taken = lambda text, part: F.length(text) - F.length(F.replace(text, part, F.lit("")))
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.pow(taken(body, c).cast("double"), F.lit(2.0)))
    low = F.ceil(size / 2).cast("int")
    halves = F.call_function("translate", body, alphabet, F.concat(F.repeat(F.lit("0"), low), F.repeat(F.lit("1"), size - low)))
    sides = let(halves, lambda h: F.struct(taken(h, F.lit("1")).alias("ones"), ((taken(h, F.lit("01")) + taken(h, F.lit("10"))) / 2 + 1).alias("runs")))
    middle = (size - 1) / 2
    codes = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c) - 1 - middle)
    beside = lambda c: F.zip_with(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), F.slice(c, 2, F.greatest(n - 1, F.lit(0))), lambda v, w: v * w)
    cov = let(codes, lambda c: F.aggregate(beside(c), F.lit(0.0), lambda acc, v: acc + v))
    return F.struct(n.cast("double").alias("n"), size.cast("double").alias("size"), squares.alias("squares"), sides.alias("sides"), cov.alias("cov"))


def _p_value(s: F.Column) -> F.Column:
    n, size, ones, runs = s["n"], s["size"], s["sides"]["ones"].cast("double"), s["sides"]["runs"]
    chi, free = s["squares"] * size / n - n, size - 1
    # The cube root of chi-squared over its freedom is nearly normal.
    p_chi = normal_tail((F.pow(F.greatest(chi, F.lit(1e-9)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    both = 2 * ones * (n - ones)
    mean, var = both / n + 1, both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(var > 0, 2 * normal_tail(F.abs((runs - mean) / F.sqrt(var)))).otherwise(0.0)
    p_serial = 2 * normal_tail(F.abs(s["cov"] / F.sqrt(n - 1)) / ((size * size - 1) / 12))
    return F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)))


def _alphabet(m: F.Column) -> F.Column:
    out = None
    for _, pattern, letters in ENCODINGS:
        fits = m.rlike(rf"^(?:{pattern})\z")
        out = F.when(fits, letters) if out is None else out.when(fits, letters)
    return out


def _parts(runs: F.Column) -> F.Column:
    """The runs (start, k, end, m), each that fits no encoding in parts that do."""
    unfit = lambda c: F.filter(c, lambda x: _alphabet(x["m"]).isNull())
    fit = lambda c: F.filter(c, lambda x: _alphabet(x["m"]).isNotNull())

    def cut(c: F.Column, pattern: str) -> F.Column:
        moved = lambda x, y: F.struct((x["start"] + y["start"]).alias("start"), y["k"].alias("k"), (x["start"] + y["end"]).alias("end"), y["m"].alias("m"))
        return F.flatten(F.transform(c, lambda x: F.transform(found(x["m"], pattern, "random"), lambda y: moved(x, y))))

    def left_over(mixed: F.Column) -> F.Column:
        """Parts of base64url, and those of base64 that touch none of them."""
        url = cut(mixed, PARTS[1])
        return let(url, lambda u: F.concat(u, apart(cut(mixed, PARTS[2]), u)))

    split = lambda mixed: let(cut(mixed, PARTS[0]), lambda between: F.concat(fit(between), let(unfit(between), left_over)))
    return let(unfit(runs), lambda mixed: F.when(F.size(mixed) == 0, runs).otherwise(F.concat(fit(runs), split(mixed))))


def apart(spans: F.Column, others: F.Column) -> F.Column:
    """The spans that touch none of the others: in the order of starts, none before reaches beyond a span's start, none after begins
    before its end."""
    marked = lambda c, own: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["k"].alias("k"), x["m"].alias("m")))
    everything = F.array_sort(F.concat(marked(others, False), marked(spans, True)))  # others first where they begin at one place
    ends = lambda xs: F.transform(xs, lambda x: F.when(x["own"], 0).otherwise(x["end"]))
    begins = lambda xs: F.transform(F.reverse(xs), lambda x: F.when(x["own"], FAR).otherwise(x["start"]))
    bounds = lambda xs: F.zip_with(before(ends(xs), 0, lambda u, v: F.greatest(u, v)), F.reverse(before(begins(xs), FAR, lambda u, v: F.least(u, v))), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    clear = lambda x, at: F.when(x["own"] & (x["start"] >= at["low"]) & (x["end"] <= at["high"]), F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["m"].alias("m")))
    out = let(everything, lambda xs: F.filter(F.zip_with(xs, bounds(xs), clear), lambda x: x.isNotNull()))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(out)


def _length_class(n: F.Column) -> F.Column:
    return sum((n >= x).cast("int") for x in CLASSES)


def scan(docs: DataFrame, *, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_tested for every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.filter(found(F.col("t"), ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST["assign"]).alias("a"),
        # A run under the least length never starts a longer match later, so the bound may stand in the pattern.
        found(F.col("t"), rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}+", "access").alias("c"),
        found(F.col("t"), rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}+", "hex").alias("h"),
        found(F.col("t"), CANDIDATE, "random").alias("r"),
    )
    base = F.concat("a", "c", "h")
    raw = raw.withColumn("r", _parts(F.col("r")))
    free = let(base, lambda b: apart(F.col("r"), b))
    tested = F.transform(F.filter(F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), _alphabet(x["m"]).alias("abc"))), lambda x: x["abc"].isNotNull()),
                         lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _length_class(x["end"] - x["start"]).alias("cls"), F.least(F.lit(BINS), F.floor(F.lit(-20.0) * F.log10(F.greatest(battery(x["m"], x["abc"]), F.lit(1e-20))))).cast("int").alias("bin")))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    rows = stage(raw.withColumn("base", base).select("doc_id", plain("base").alias("base"), tested.alias("tested")), "secrets")
    cuts = thresholds(rows.select(F.explode("tested").alias("x")).select("x.cls", "x.bin"), fdr)
    limit = lambda cls: F.coalesce(*(F.when(cls == c, b) for c, b in sorted(cuts.items())), F.lit(BINS + 1))
    random = F.transform(F.filter("tested", lambda x: x["bin"] < limit(x["cls"])), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("k"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *(of(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", random)).alias("spans"), F.size(random).cast("long").alias("n_random"), F.size("tested").cast("long").alias("n_tested"))


def thresholds(tested: DataFrame, fdr: float) -> dict[int, int]:
    """For each class of lengths the least bin of p-values that the step-up dismisses; at most a row for each class reaches the driver.

    Bin b holds p-values from 10 ** -((b + 1) / 20) to 10 ** -(b / 20); a bin is dismissed as a whole, judged by its largest.
    """
    per = tested.groupBy("cls", "bin").count()
    down = Window.partitionBy("cls").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.select("cls", "bin", F.sum("count").over(down).alias("rank"), F.sum("count").over(Window.partitionBy("cls")).alias("m"))
    out = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 20) <= F.lit(fdr) * F.col("rank") / F.col("m")).groupBy("cls").agg(F.min("bin").alias("bin"))
    return {x["cls"]: x["bin"] for x in out.collect()}
