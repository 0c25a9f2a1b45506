"""URL filters: hand-written host and path rules first, mined association rules for the rest.

Spark's FP-growth finds the token combinations of labelled URLs (where many tokens come together, a growth of the same patterns bounded in
length); a rule ``tokens -> block`` stays if its support and its confidence
reach the floors, if no kept rule with fewer of its tokens is at least as sure, and if it beats the share of blocked URLs.
Matching goes by an inverted index: each rule is filed under its rarest token, so a URL meets only the rules filed under its own.

Labels come from the caller. ``judge`` has none but the verdicts of the hand-written rules, and these pick pages by host and path: a token
of picked pages alone says nothing of the rest. So undecided pages are mined too, as not blocked, and a rule is sure only if nearly all
pages with its tokens, undecided ones counted, are blocked by hand. Its support stays a share of the decided pages.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule, has no tokens and is allowed; ties between
rules of one length go to the first listed; repeated rows are judged once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window

from .common import F, stage

# Verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SUPPORT, CONFIDENCE, LONGEST, ITEM, WIDE = 0.002, 0.9, 4, "=block", 14


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rules(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = (F.when(fits, h + p), F.when(fits, v)) if rule is None else (rule.when(fits, h + p), verdict.when(fits, v))
    return rule, verdict


def tokens(host: F.Column, path: F.Column, url: F.Column) -> F.Column:
    """Distinct tokens of a URL: scheme, each ending of the host, its labels, path segments with digits as one, names in the query."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    part = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    words = F.filter(F.split(F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), "-"), "-"), lambda x: x != "")
    made = F.concat(F.array(F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1))), ends, F.transform(words, lambda x: F.concat(F.lit("word:"), x)), F.transform(part, lambda x: F.concat(F.lit("path:"), x)), F.transform(query, lambda x: F.concat(F.lit("query:"), x)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST, wide: int = WIDE) -> DataFrame:
    """Rules from ``tokens`` and ``verdict``, where all but ``block`` count against a rule: rule_id, needs (array), confidence, support. Empty where nothing is labelled.

    Tokens too rare for any rule are left out of the baskets. FP-growth lists every frequent combination, 2 ** w of them for w tokens that
    come together, so baskets of more than ``wide`` tokens go to ``grow``, which finds the same rules and stops at ``longest``.
    """
    spark = labelled.sparkSession
    n, blocked = labelled.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    if not blocked:
        return spark.createDataFrame([], "rule_id long, needs array<string>, confidence double, support double")
    least = max(1, math.ceil(support * n - 1e-9))
    rows = stage(labelled.select(F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"), "tokens", F.monotonically_increasing_id().alias("row")), "labelled")
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.count_if("blocked").alias("with_block")).filter(F.col("with_block") >= least).select("token")
    baskets = stage(each.join(frequent, "token").groupBy("row").agg(F.first("blocked").alias("blocked"), F.sort_array(F.collect_set("token")).alias("items")), "baskets")
    widest = baskets.agg(F.max(F.size("items"))).first()[0] or 0
    found = _by_fp_growth(baskets, least, longest) if widest <= wide else grow(baskets, n, least, longest)
    sure = found.withColumn("confidence", F.col("with_block") / F.col("held")).filter((F.col("confidence") >= confidence) & (F.col("confidence") > blocked / n))
    rules = stage(sure.select(F.xxhash64("needs").alias("rule_id"), "needs", "confidence", (F.col("with_block") / n).alias("support")), "rules")
    # A rule goes if a rule with fewer of its tokens is as sure: each rule looks up the subsets it has.
    subsets = rules.select("rule_id", "confidence", F.size("needs").alias("k"), F.explode(_subsets(F.col("needs"), longest)).alias("sub"))
    smaller = rules.select(F.col("rule_id").alias("sub"), F.col("confidence").alias("sure"), F.size("needs").alias("m"))
    beaten = subsets.join(smaller, "sub").filter("m < k and sure >= confidence").select("rule_id").distinct()
    return rules.join(beaten, "rule_id", "left_anti")


def _by_fp_growth(baskets: DataFrame, least: int, longest: int) -> DataFrame:
    """needs, held (baskets with all of them), with_block (blocked ones among these): combinations that ``least`` blocked baskets hold."""
    from pyspark.ml.fpm import FPGrowth

    n = baskets.count()
    if not n:
        return baskets.sparkSession.createDataFrame([], "needs array<string>, held long, with_block long")
    made = baskets.select(F.when(F.col("blocked"), F.array_append("items", F.lit(ITEM))).otherwise(F.col("items")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(made).freqItemsets
    sets = stage(sets.filter(F.size("items") <= longest + 1).select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    needs = sets.filter(F.array_contains("items", ITEM) & (F.size("items") > 1)).select(F.array_remove("items", ITEM).alias("needs"), F.col("freq").alias("with_block"))
    return needs.join(sets.select(F.col("items").alias("needs"), F.col("freq").alias("held")), "needs")


def grow(baskets: DataFrame, n: int, least: int, longest: int) -> DataFrame:
    """The same without combinations that hold just where a smaller one does: such a one is as sure as the smaller, so its rule would go,
    and so would every larger one's.

    Pattern growth with FP-growth's conditional bases as rows: a combination's base is the rest of each basket behind its last token. Equal
    baskets are one row with counts; a round adds one token, and ``longest`` rounds bound the work by the baskets' width to that power.
    """
    spark = baskets.sparkSession
    level = stage(baskets.groupBy("items").agg(F.count("*").alias("held"), F.count_if("blocked").alias("with_block")).withColumns({"needs": F.array().cast("array<string>"), "at": F.lit(0)}), "grown0")
    smaller = spark.createDataFrame([([], n)], "sub array<string>, sub_held long")
    out = None
    for k in range(1, longest + 1):
        behind = level.select("items", "held", "with_block", "needs", "at", F.posexplode(F.slice("items", F.col("at") + 1, F.size("items"))).alias("step", "token"))
        longer = stage(behind.select("items", "held", "with_block", F.array_append("needs", F.col("token")).alias("needs"), (F.col("at") + F.col("step") + 1).alias("at")), f"longer{k}")
        sums = longer.groupBy("needs").agg(F.sum("held").alias("held"), F.sum("with_block").alias("with_block")).filter(F.col("with_block") >= least)
        without = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter("needs", lambda _, j: j != i))
        subs = sums.select("needs", "held", "with_block", F.explode(without).alias("sub")).join(smaller, "sub").filter("sub_held > held")
        kept = stage(subs.groupBy("needs", "held", "with_block").count().filter(F.col("count") == k).drop("count"), f"kept{k}")
        out = kept if out is None else out.unionByName(kept)
        if kept.isEmpty():
            break
        smaller = kept.select(F.col("needs").alias("sub"), F.col("held").alias("sub_held"))
        level = longer.join(kept.select("needs"), "needs", "left_semi")
    return out


def _subsets(needs: F.Column, longest: int) -> F.Column:
    """Hashes of all proper subsets that are not empty; there are at most 2 ** ``longest`` of them."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(needs)).cast("int") - 1)
    pick = lambda m: F.xxhash64(F.filter(needs, lambda x, i: F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2)) == 1))
    return F.transform(masks, pick)


def judge(pages: DataFrame, *, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined: the surest mined rule behind a verdict, its tokens joined; else null."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = stage(rows.withColumns({"rule": rule, "verdict": verdict, "tokens": tokens(F.col("host"), F.col("path"), F.col("url"))}), "urls")
    n, decided = rows.agg(F.count("*"), F.count("verdict")).first()
    mined = stage(mine(rows, support=support * decided / max(n, 1), confidence=confidence, longest=longest), "mined")
    rest = rows.filter("verdict is null")
    # The index: each rule under the rarest of its tokens among the labelled URLs' counts.
    token = mined.select("rule_id", "needs", "confidence", F.explode("needs").alias("token"))
    seen = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    place = Window.partitionBy("rule_id").orderBy("count", "token")
    index = token.join(seen, "token").withColumn("at", F.row_number().over(place)).filter("at = 1").select("token", "rule_id", "needs", "confidence")
    met = rest.select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = met.groupBy("row").agg(F.max_by("needs", F.struct("confidence", -F.size("needs"), "rule_id")).alias("needs"))
    out = rows.join(best, "row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("needs").isNotNull(), "block"), F.lit("allow")).alias("verdict"), F.array_join("needs", " ").alias("mined"))
