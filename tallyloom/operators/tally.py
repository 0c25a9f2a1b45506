"""Aggregates over judged commits: totals, series, authors, capabilities, failures, many repositories.

Input: one row per commit with ``records`` (array of kind, change, name, summary) and ``error``. Records of a failed commit don't count,
the commit itself does. Each aggregate is one shuffle on its key with partial sums before it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import month_of, short, week_of
from ..schema import CHANGES, KINDS, LOSSES


def cap_delta(change: Column) -> Column:
    """A gain counts one, a loss minus one."""
    return F.when(change.isin(*LOSSES), -1).otherwise(1)


def _count(kind: str) -> Column:
    """The commit's own count of a kind; capabilities net of losses."""
    own = F.filter("records", lambda r: r["kind"] == kind)
    if kind == "cap":
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda n, r: n + cap_delta(r["change"]))
    return F.size(own).cast("bigint")


def counted(results: DataFrame) -> DataFrame:
    """Results with the commit's counts: cap, fix, tend, and week. No explosion of records is needed for any series."""
    ok = F.col("error").isNull()
    return results.withColumns({k: F.when(ok, F.coalesce(_count(k), F.lit(0))).otherwise(0).cast("bigint") for k in KINDS} | {"week": week_of(F.col("ts"))})


def _sums() -> list[Column]:
    return [F.sum(k).cast("bigint").alias(k) for k in KINDS]


def totals(results: DataFrame) -> DataFrame:
    """One row: net cap, fix, tend, and how many capabilities of each change."""
    ok = F.col("error").isNull()
    of = lambda c: F.sum(F.when(ok, F.size(F.filter("records", lambda r: (r["kind"] == "cap") & (r["change"] == c)))).otherwise(0))
    sums = [F.coalesce(F.sum(k), F.lit(0)).cast("bigint").alias(k) for k in KINDS]
    return counted(results).agg(*sums, *(F.coalesce(of(c), F.lit(0)).cast("bigint").alias(f"cap_{c}") for c in CHANGES))


def weekly(results: DataFrame) -> DataFrame:
    """A row for each week with a commit, records or not."""
    return counted(results).groupBy("week").agg(*_sums())


def monthly(weeks: DataFrame) -> DataFrame:
    return weeks.groupBy(month_of(F.col("week")).alias("month")).agg(*_sums())


def authors(results: DataFrame) -> DataFrame:
    """A row for each author; ``first_seq`` breaks ties when sorted by ``cap + fix + tend`` downwards."""
    return counted(results).groupBy("author").agg(*_sums(), F.min("seq").alias("first_seq"))


def top_authors(results: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` busiest authors with their place, and how many more there are."""
    all_ = authors(results).withColumn("total", F.col("cap") + F.col("fix") + F.col("tend"))
    top = all_.orderBy(F.desc("total"), "first_seq").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("total"), "first_seq")).alias("place")  # over n rows
    more = all_.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return top.select("author", *KINDS, "total", place).join(F.broadcast(more))


def caps(results: DataFrame) -> DataFrame:
    """Capabilities in commit order: seq, name, change, sha (short), author, date."""
    each = results.filter("error is null").select("seq", "sha", "author", "date_iso", F.posexplode("records").alias("ord", "r")).filter("r.kind = 'cap'")
    return each.select("seq", "ord", F.col("r.name").alias("name"), F.col("r.change").alias("change"), short(F.col("sha")).alias("sha"), "author", F.col("date_iso").alias("date"))


def newest_caps(results: DataFrame, n: int = 15) -> DataFrame:
    return caps(results).orderBy(F.desc("seq"), F.desc("ord")).limit(n)


def caps_by_change(results: DataFrame) -> DataFrame:
    return caps(results).groupBy("change").agg(F.count("*").alias("n"))


def failed(results: DataFrame) -> DataFrame:
    return results.filter("error is not null").select("seq", short(F.col("sha")).alias("sha"), "error")


def completeness(results: DataFrame) -> DataFrame:
    """commits, judged, failed, complete; ``judged + failed = commits``."""
    bad = F.count_if(F.col("error").isNotNull())
    return results.agg(F.count("*").alias("commits"), (F.count("*") - bad).alias("judged"), bad.alias("failed"), (bad == 0).alias("complete"))


def by_repo(results: DataFrame) -> DataFrame:
    """A row for each repository: counts, sums, complete."""
    bad = F.count_if(F.col("error").isNotNull())
    return counted(results).groupBy("repo").agg(F.count("*").alias("commits"), *_sums(), (bad == 0).alias("complete"))


def across_repos(repos: DataFrame) -> DataFrame:
    """Totals over repositories; complete only if each is."""
    return repos.agg(F.count("*").alias("repos"), F.sum("commits").alias("commits"), *_sums(), F.every("complete").alias("complete"))


def scale(rows: DataFrame, kinds=KINDS) -> DataFrame:
    """The largest value of each column, one at least, beside each row; the maxima are one row."""
    top = rows.agg(*(F.greatest(F.lit(1), F.max(k)).alias(f"top_{k}") for k in kinds))
    return rows.join(F.broadcast(top))


def one_per_kind(records: Column) -> Column:
    """The first record of each kind, in their order: what one commit may carry."""
    return F.filter(records, lambda r, i: ~F.exists(F.slice(records, F.lit(1), i), lambda x: x["kind"] == r["kind"]))


def report(results: DataFrame, repo: str, mode: str, model: str, since: str) -> DataFrame:
    """The report as one row of nested arrays; its series are bounded by weeks, authors and capabilities of the window."""
    w = weekly(results).agg(F.sort_array(F.collect_list(F.struct("week", *KINDS))).alias("weeks"))
    a = authors(results).agg(F.sort_array(F.collect_list(F.struct((-(F.col("cap") + F.col("fix") + F.col("tend"))).alias("k"), "first_seq", "author", *KINDS))).alias("a"))
    c = caps(results).agg(F.sort_array(F.collect_list(F.struct("seq", "ord", "name", "change", "sha", "author", "date"))).alias("caps"))
    f = failed(results).agg(F.sort_array(F.collect_list(F.struct("seq", "sha", "error"))).alias("failed"))
    day = results.agg(F.min_by("date_iso", "seq").alias("first"), F.max_by("date_iso", "seq").alias("last"))
    row = totals(results).join(completeness(results).withColumnRenamed("failed", "n_failed")).join(w).join(a).join(c).join(f).join(day)
    pick = lambda col, names: F.transform(col, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    return row.select(
        F.lit(repo).alias("repo"), F.lit(mode).alias("mode"), F.lit(model).alias("model"), "complete", "commits", "judged",
        F.struct(F.lit(since).alias("since"), "first", "last").alias("window"),
        F.struct(*KINDS, F.struct(*(F.col(f"cap_{c}").alias(c) for c in CHANGES)).alias("cap_changes")).alias("totals"),
        "weeks", pick("a", ("author", *KINDS)).alias("authors"), pick("caps", ("name", "change", "sha", "author", "date")).alias("caps"), pick("failed", ("sha", "error")).alias("failed"),
    )


def envelope(report_row: DataFrame, command: str) -> DataFrame:
    """The report as the JSON document ``{ok, command, data}``."""
    return report_row.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(command).alias("command"), F.struct("*").alias("data"))).alias("json"))


def failure(code: str, message: str, command: str) -> str:
    """What a failed command answers: ``{ok: false, command, error: {code, message}}``."""
    return json.dumps({"ok": False, "command": command, "error": {"code": code, "message": message}})


def counters(results: DataFrame) -> DataFrame:
    """One row: calls, input_tokens, output_tokens, redactions, cached (commits), answered_by (the first commit's model that has one).

    ``results``: seq, calls, input_tokens, output_tokens, redactions, cached (flag), model.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return results.agg(*map(total, ("calls", "input_tokens", "output_tokens", "redactions")), F.count_if("cached").alias("cached"), F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("answered_by"))


def write_reports(rows: DataFrame, folder: str) -> None:
    """One JSON document for each row (``name`` of its file, ``json``), as text files that a reader of ``folder`` finds by name."""
    rows.select("name", F.col("json").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(folder)
