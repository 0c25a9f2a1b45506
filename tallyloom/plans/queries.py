"""The query registry of the history engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import tally
from . import derived
from .derived import COMMITS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is what DuckDB runs on the same tables."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


SUMS = "sum(cap)::BIGINT AS cap, sum(fix)::BIGINT AS fix, sum(tend)::BIGINT AS tend"
_OF = ", ".join(f"count(*) FILTER (error IS NULL AND kind = 'cap' AND change = '{c}') AS cap_{c}" for c in ("new", "deepened", "regressed", "removed"))

registered("tally_totals", f"WITH {COMMITS_SQL} SELECT {SUMS}, {_OF} FROM counted")(lambda s, d: tally.totals(derived.commits(s, d)))
registered("tally_weekly", f"WITH {COMMITS_SQL} SELECT week, {SUMS} FROM counted GROUP BY week")(lambda s, d: tally.weekly(derived.commits(s, d)))
registered("tally_monthly", f"WITH {COMMITS_SQL} SELECT substr(week, 1, 7) AS month, {SUMS} FROM counted GROUP BY 1")(lambda s, d: tally.monthly(tally.weekly(derived.commits(s, d))))
registered("tally_authors", f"WITH {COMMITS_SQL} SELECT author, {SUMS}, min(seq) AS first_seq FROM counted GROUP BY author")(lambda s, d: tally.authors(derived.commits(s, d)))
registered("tally_authors_top10", f"""WITH {COMMITS_SQL}, a AS (SELECT author, {SUMS}, min(seq) AS first_seq FROM counted GROUP BY author)
SELECT author, cap, fix, tend, cap + fix + tend AS total, row_number() OVER (ORDER BY cap + fix + tend DESC, first_seq)::INT AS place, (SELECT greatest(count(*) - 10, 0) FROM a) AS more
FROM a QUALIFY place <= 10""")(lambda s, d: tally.top_authors(derived.commits(s, d)))
registered("caps_by_change", f"WITH {COMMITS_SQL} SELECT change, count(*) AS n FROM counted WHERE kind = 'cap' AND error IS NULL GROUP BY change")(lambda s, d: tally.caps_by_change(derived.commits(s, d)))
registered("caps_list", f"WITH {COMMITS_SQL} SELECT seq, 0 AS ord, name, change, substr(sha, 1, 7) AS sha, author, date_iso AS date FROM counted WHERE kind = 'cap' AND error IS NULL")(lambda s, d: tally.caps(derived.commits(s, d)))
registered("caps_newest", f"WITH {COMMITS_SQL} SELECT seq, 0 AS ord, name, change, substr(sha, 1, 7) AS sha, author, date_iso AS date FROM counted WHERE kind = 'cap' AND error IS NULL ORDER BY seq DESC LIMIT 15")(lambda s, d: tally.newest_caps(derived.commits(s, d)))
registered("failed_list", f"WITH {COMMITS_SQL} SELECT seq, substr(sha, 1, 7) AS sha, error FROM counted WHERE error IS NOT NULL")(lambda s, d: tally.failed(derived.commits(s, d)))
registered("complete_flag", f"WITH {COMMITS_SQL} SELECT count(*) AS commits, count(*) FILTER (error IS NULL) AS judged, count(error) AS failed, count(error) = 0 AS complete FROM counted")(lambda s, d: tally.completeness(derived.commits(s, d)))
registered("analyze_many_repos", f"WITH {COMMITS_SQL} SELECT repo, count(*) AS commits, {SUMS}, count(error) = 0 AS complete FROM counted GROUP BY repo")(lambda s, d: tally.by_repo(derived.commits(s, d)))
registered("analyze_many_totals", f"WITH {COMMITS_SQL}, r AS (SELECT repo, count(*) AS commits, {SUMS}, count(error) = 0 AS complete FROM counted GROUP BY repo) SELECT count(*) AS repos, sum(commits)::BIGINT AS commits, {SUMS}, bool_and(complete) AS complete FROM r")(lambda s, d: tally.across_repos(tally.by_repo(derived.commits(s, d))))

_EIGHTHS = "(['', '▏', '▎', '▍', '▌', '▋', '▊', '▉'])"


def _bar_sql(k: str, width: int = 12) -> str:
    e = f"greatest(1, floor(least({k}, top_{k})::DOUBLE / top_{k} * {width} * 8 + 0.5)::INT)"
    return f"CASE WHEN {k} > 0 THEN repeat('█', ({e} // 8)::INT) || {_EIGHTHS}[{e} % 8 + 1] ELSE '' END AS {k}_bar"


def _bars(rows: DataFrame, label: str) -> DataFrame:
    return tally.scale(rows).select(label, *(text.bar(F.col(k), F.col(f"top_{k}"), 12).alias(f"{k}_bar") for k in ("cap", "fix", "tend")))


_TOPS = "greatest(1, max(cap) OVER ()) AS top_cap, greatest(1, max(fix) OVER ()) AS top_fix, greatest(1, max(tend) OVER ()) AS top_tend"
registered("week_bars", f"WITH {COMMITS_SQL}, w AS (SELECT week, {SUMS} FROM counted GROUP BY week), t AS (SELECT *, {_TOPS} FROM w) SELECT week, {_bar_sql('cap')}, {_bar_sql('fix')}, {_bar_sql('tend')} FROM t")(lambda s, d: _bars(tally.weekly(derived.commits(s, d)), "week"))
registered("month_bars", f"WITH {COMMITS_SQL}, w AS (SELECT substr(week, 1, 7) AS month, {SUMS} FROM counted GROUP BY 1), t AS (SELECT *, {_TOPS} FROM w) SELECT month, {_bar_sql('cap')}, {_bar_sql('fix')}, {_bar_sql('tend')} FROM t")(lambda s, d: _bars(tally.monthly(tally.weekly(derived.commits(s, d))), "month"))


@registered("since_window", """WITH w AS (SELECT * FROM (VALUES ('90d', INTERVAL 90 DAYS), ('2w', INTERVAL 14 DAYS), ('6m', INTERVAL 6 MONTHS), ('1y', INTERVAL 1 YEAR)) AS v(win, back))
SELECT win, count(*) AS n FROM orders, w WHERE o_orderdate >= TIMESTAMP '2001-08-02 00:00:00' - back GROUP BY win""")
def since_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inside each window; the bounds are literals, so each filter reaches the scan."""
    out = None
    for win in ("90d", "2w", "6m", "1y"):
        # One literal per window: folded before the scan.
        start = spark.range(1).select(text.since(F.lit(win), F.lit("2001-08-02 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("t")).first()["t"]
        part = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")).agg(F.count("*").alias("n")).select(F.lit(win).alias("win"), "n")
        out = part if out is None else out.unionByName(part)
    return out
