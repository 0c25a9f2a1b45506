"""Queries over paths, diffs, deltas and names, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths, text
from ..operators import delta, diffparse, naming
from . import derived
from .derived import FILES_SQL, LINES_SQL
from .queries import registered


def _in(x: str, names) -> str:
    return f"{x} IN (" + ", ".join(f"'{n}'" for n in names) + ")"


def _under(names) -> str:
    return "list_has_any(dirs, [" + ", ".join(f"'{n}'" for n in names) + "])"


def _re(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _starts(names) -> str:
    return "(" + " OR ".join(f"starts_with(b, '{n}')" for n in names) + ")"


def _ends(names) -> str:
    return "(" + " OR ".join(f"ends_with(b, '{n}')" for n in names) + ")"


PARTS_SQL = """parts AS (SELECT *, lower(string_split(path, '/')[-1]) AS b, string_split(lower(path), '/')[:-2] AS dirs, regexp_extract(lower(string_split(path, '/')[-1]), '^.+(\\.[^.]*)$', 1) AS e, path NOT LIKE '%/%' AS top FROM src)"""


def class_sql(kind: str) -> str:
    """The classification for one kind of repository as a CASE over path, b, dirs, e, top."""
    P = paths
    doc_named = f"({_in('b', P.DOC_NAMES)} OR ({_re('b', P.DOC_STEM)} AND (e = '' OR {_in('e', P.PROSE)})))"
    root = _under(P.PROMPT_DIRS)
    scope = {"content": "true", "mixed": _under(P.CONTENT_ROOTS)}.get(kind, "false")
    words = "string_split_regex(regexp_replace(b, '\\.mdx?$', ''), '[-_. ]+')"
    when = [
        (f"{_under(P.GENERATED_DIRS)} OR {_ends(P.GENERATED_ENDINGS)} OR {_re('b', P.GENERATED_NAME)}", "generated_vendored"),
        (_in("b", P.LOCKFILES), "lockfile"),
        (f"{_in('b', P.MANIFESTS)} OR {_re('b', P.MANIFEST_NAME)}", "dependency_manifest"),
        (f"{_under(P.CI_DIRS)} OR {_in('b', P.CI_NAMES + P.HOUSEKEEPING)} OR {_starts(P.CI_STARTS)} OR {'false' if kind == 'prompts' else _under(P.AGENT_DIRS)}", "ci_build"),
        (f"{_under(P.TEST_DIRS)} OR {_re('b', P.TEST_NAME)}", "test"),
        (_under(P.ARCHIVE_DIRS), "archived"),
        (_under(P.DRAFT_DIRS), "draft"),
        (doc_named, "docs"),
    ]
    if kind == "prompts":
        when.append((f"e IN ('.md', '.mdx') AND (({_in('b', P.AGENT_FILES)} AND (top OR list_contains(dirs, '.claude') OR {root})) OR (top AND NOT list_has_any({words}, [" + ", ".join(f"'{w}'" for w in P.ROOT_DOC_WORDS) + "])))", "source"))
    if kind != "content":
        when.append((f"{_under(P.DOC_DIRS + P.EXAMPLE_DIRS)} OR (top AND {_in('e', P.PROSE)})", "docs"))
    beyond = {"code": "true", "mixed": f"NOT {_under(P.CONTENT_ROOTS)}", "prompts": f"NOT {root}", "content": "false"}[kind]
    when.append((f"{_in('e', P.PROSE)} AND {beyond}", "docs"))
    if kind == "prompts":
        when.append((f"{_in('e', P.PROMPT_ENDINGS)} AND {root}", "source"))
    when += [
        (_in("e", P.ASSETS), "asset"),
        (f"{_re('b', P.DEPLOY_MODULE)} AND NOT {_re('b', P.BUILD_MODULE)}", "app_config"),
        (_in("e", P.SOURCES), "source"),
        (f"({_in('e', P.CONFIGS)} OR b = '.env.example' OR {_in('b', P.DEPLOY_MANIFESTS)}) AND {scope} AND NOT {_in('b', P.DEPLOY_MANIFESTS)} AND NOT {_under(P.CONFIG_DIRS)} AND NOT {_re('b', P.CONFIG_NAME)}", "content"),
        (f"{_in('e', P.CONFIGS)} OR b = '.env.example' OR {_in('b', P.DEPLOY_MANIFESTS)}", "app_config"),
        (f"{scope} AND ({_in('e', P.PROSE)} OR {_in('e', P.DATA)})", "content"),
        (_re("b", P.TOOL_DOTFILE), "ci_build"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in when) + " ELSE 'app_config' END"


def _classes(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        each = derived.files(spark, sf_dir).select("path", paths.classify(F.col("path"), kind).alias("cls"))
        return each.groupBy("path", "cls").agg(F.count("*").alias("n"))

    return run


for _kind in ("code", "prompts", "content", "mixed"):
    registered(f"path_classify_{_kind}", f"WITH {FILES_SQL}, src AS (SELECT path, count(*) AS n FROM files GROUP BY path), {PARTS_SQL} SELECT path, n, {class_sql(_kind)} AS cls FROM parts")(_classes(_kind))


@registered("path_ext_base", f"WITH {FILES_SQL}, src AS (SELECT DISTINCT path FROM files), {PARTS_SQL} SELECT path, b AS base, e AS ext, dirs FROM parts")
def path_ext_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return derived.files(spark, sf_dir).select("path", paths.base(p).alias("base"), paths.ext(p).alias("ext"), paths.folders(p).alias("dirs")).distinct()


@registered("snapshot_paths", f"WITH {FILES_SQL} SELECT path, count(*) AS n FROM files WHERE regexp_matches(path, '(?i)(^|/)releases/v?[0-9]+(\\.[0-9]+)*([-.][0-9a-z.]+)?/') GROUP BY path")
def snapshot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.files(spark, sf_dir).filter(paths.is_snapshot(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@registered("test_paths", f"WITH {FILES_SQL} SELECT path, regexp_matches(path, '(?i){paths.TEST_PATH}') AS is_test, count(*) AS n FROM files GROUP BY path")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.files(spark, sf_dir).groupBy("path", paths.is_test_path(F.col("path")).alias("is_test")).agg(F.count("*").alias("n"))


@registered("path_words", f"""WITH {FILES_SQL}, p AS (SELECT DISTINCT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM files),
w AS (SELECT path, parts, CASE WHEN regexp_replace(parts[-1], '\\.[A-Za-z0-9]+$', '') = '' THEN parts[-1] ELSE regexp_replace(parts[-1], '\\.[A-Za-z0-9]+$', '') END AS stem FROM p),
v AS (SELECT *, [lower(trim(regexp_replace(regexp_replace(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[-_.\\s]+', ' ', 'g'))) for x in list_concat([stem, parts[-1]], list_reverse(parts[:-2]))] AS ws FROM w),
u AS (SELECT *, list_filter(ws[3:], lambda x: x <> '' AND NOT regexp_matches(x, '{paths.GENERIC_DIR}'))[1] AS dir FROM v)
SELECT path, coalesce(nullif(CASE WHEN {_in('lower(stem)', paths.GENERIC_STEMS)} OR ws[1] = '' THEN coalesce(dir, ws[1]) ELSE ws[1] END, ''), nullif(ws[2], ''), 'capability') AS words FROM u""")
def path_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.files(spark, sf_dir).select("path", paths.path_words(F.col("path")).alias("words")).distinct()


@registered("repo_kind", f"""WITH {FILES_SQL}, src AS (SELECT DISTINCT sha % 4 AS repo, path FROM files WHERE NOT regexp_matches(path, '(?i)(^|/)releases/v?[0-9]+(\\.[0-9]+)*([-.][0-9a-z.]+)?/')), {PARTS_SQL},
k AS (SELECT *, {class_sql('mixed')} AS cls, {_in('e', paths.PROSE + paths.TABULAR)} AND NOT ({_in('b', paths.DOC_NAMES)} OR ({_re('b', paths.DOC_STEM)} AND (e = '' OR {_in('e', paths.PROSE)}))) AND NOT {_under(paths.DOC_DIRS)} AS shaped, {_in('e', paths.SOURCES)} AS src FROM parts),
a AS (SELECT repo, count(*) FILTER (b = 'skill.md') AS skills, count(*) FILTER (regexp_matches(path, '(?i)(^|/)patterns/[^/]+/system.md$')) AS patterns, count(*) FILTER (NOT {_in('cls', paths.PLUMBING)}) AS n, count(*) FILTER (shaped AND NOT {_in('cls', paths.PLUMBING)}) AS c, count(*) FILTER (src AND NOT {_in('cls', paths.PLUMBING)}) AS s FROM k GROUP BY repo)
SELECT 'repo-' || repo AS repo, CASE WHEN skills >= 3 OR patterns >= 10 THEN 'prompts' WHEN c / n >= 0.6 AND s / n < 0.2 THEN 'content' WHEN s / n >= 0.4 THEN 'code' ELSE 'mixed' END AS kind FROM a""")
def repo_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.views import repo_kinds

    f = derived.files(spark, sf_dir)
    return repo_kinds(f.select(F.concat(F.lit("repo-"), (F.col("sha") % 4).cast("string")).alias("repo"), "path"))


@registered("diff_sections", "SELECT doc_id AS sha, 0 AS sec_no, 'docs/' || doc_id || '.md' AS old_path, 'docs/' || doc_id || '.md' AS new_path, doc_id % 5 = 0 AS new_file, false AS deleted_file, false AS binary, false AS truncated FROM documents")
def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffparse.sections(derived.diffs(spark, sf_dir)).select("sha", "sec_no", "old_path", "new_path", "new_file", "deleted_file", "binary", "truncated")


@registered("diff_hunk_counts", f"WITH {LINES_SQL} SELECT sha, 1 AS old_start, 1 AS new_start, 'part ' || lang AS context, count(*) FILTER (tag <> '+')::INT AS old_lines, count(*) FILTER (tag <> '-')::INT AS new_lines FROM lines GROUP BY sha, lang")
def diff_hunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = diffparse.hunks(diffparse.sections(derived.diffs(spark, sf_dir)))
    n = lambda *tags: F.size(diffparse.side(F.col("body"), tags))
    return h.select("sha", "old_start", "new_start", "context", n(" ", "-").alias("old_lines"), n(" ", "+").alias("new_lines"))


@registered("diff_line_tags", f"WITH {LINES_SQL} SELECT sha, tag, count(*) AS n FROM lines GROUP BY sha, tag")
def diff_line_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffparse.lines(diffparse.hunks(diffparse.sections(derived.diffs(spark, sf_dir)))).groupBy("sha", "tag").agg(F.count("*").alias("n"))


@registered("diff_line_numbers", f"""WITH {LINES_SQL} SELECT sha, line_no::INT AS line_no, tag, text,
CASE WHEN tag <> '+' THEN (1 + coalesce(sum(CASE WHEN tag <> '+' THEN 1 ELSE 0 END) OVER w, 0))::INT END AS old_line, CASE WHEN tag <> '-' THEN (1 + coalesce(sum(CASE WHEN tag <> '-' THEN 1 ELSE 0 END) OVER w, 0))::INT END AS new_line
FROM lines WINDOW w AS (PARTITION BY sha ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def diff_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffparse.lines(diffparse.hunks(diffparse.sections(derived.diffs(spark, sf_dir)))).select("sha", "line_no", "tag", "text", "old_line", "new_line")


@registered("whitespace_only", f"""WITH {LINES_SQL}, s AS (SELECT sha, line_no, tag, regexp_replace(text, '[\\s\\p{{Z}}\\x{{FEFF}}]+', '', 'g') AS bare FROM lines)
SELECT sha, coalesce(string_agg(bare, chr(10) ORDER BY line_no) FILTER (tag = '-' AND bare <> ''), '') <> coalesce(string_agg(bare, chr(10) ORDER BY line_no) FILTER (tag = '+' AND bare <> ''), '') AS survives FROM s GROUP BY sha""")
def whitespace_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = diffparse.hunks(diffparse.sections(derived.diffs(spark, sf_dir)))
    return h.select("sha", diffparse.survives_whitespace(F.col("body")).alias("survives"))


_ENTRIES = """e AS (SELECT l_orderkey AS sha, CASE WHEN l_linestatus = 'O' THEN 'after' ELSE 'before' END AS side, (['route', 'command', 'ui handler', 'export'])[l_linenumber % 4 + 1] AS kind, 'n' || (l_partkey % 7) AS name, 'f' || (l_suppkey % 5) AS file,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 2 = 1)"""


#: Rows of ``lineitem`` in a partition of ``entries``, as long as they make no more partitions than Spark writes without sorting (200 unless set):
#: beyond, the tasks that write the shuffle would hold their whole part of the file. From there on partitions grow with the rows.
PARTITION_ROWS = 250_000


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary entries on both sides of a commit, from ``lineitem``; dealt by commit, and what follows by commit and more needs no other shuffle."""
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Only the footers are read for the count. Bytes say less: repeated rows take a third of the space.
    most = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    parts = max(1, min(most, max(spark.sparkContext.defaultParallelism, -(-li.count() // PARTITION_ROWS))))
    order = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    # The words are made after the sort, so it holds numbers. Nulls come last, as in the SQL.
    placed = li.select(F.col("l_orderkey").alias("sha"), *order).repartition(parts, "sha").withColumn("ord", F.row_number().over(Window.partitionBy("sha").orderBy(*map(F.asc_nulls_last, order))))
    kind = F.element_at(F.array(*map(F.lit, delta.KIND_ORDER)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return placed.select("sha", F.when(F.col("l_linestatus") == "O", "after").otherwise("before").alias("side"), kind.alias("kind"), F.concat(F.lit("n"), (F.col("l_partkey") % 7).cast("string")).alias("name"), F.concat(F.lit("f"), (F.col("l_suppkey") % 5).cast("string")).alias("file"), "ord")


_ENTRIES = _ENTRIES.replace(" WHERE l_orderkey % 2 = 0 OR l_orderkey % 2 = 1", "")


@registered("boundary_delta_multiset", f"""WITH {_ENTRIES}, c AS (SELECT *, count(*) FILTER (side = 'after') OVER k AS a, count(*) FILTER (side = 'before') OVER k AS b, row_number() OVER (PARTITION BY sha, kind, name, side ORDER BY ord DESC) AS r FROM e WINDOW k AS (PARTITION BY sha, kind, name))
SELECT sha, kind, name, file, ord::INT AS ord, CASE side WHEN 'after' THEN 'added' ELSE 'removed' END AS dir FROM c WHERE r <= CASE side WHEN 'after' THEN a - b ELSE b - a END""")
def boundary_delta_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.surplus(entries(spark, sf_dir), ["sha", "kind", "name"]).select("sha", "kind", "name", "file", "ord", "dir")


@registered("boundary_delta_rendered", f"""WITH {_ENTRIES}, c AS (SELECT *, count(*) FILTER (side = 'after') OVER k AS a, count(*) FILTER (side = 'before') OVER k AS b, row_number() OVER (PARTITION BY sha, kind, name, side ORDER BY ord DESC) AS r FROM e WINDOW k AS (PARTITION BY sha, kind, name))
SELECT sha, CASE side WHEN 'after' THEN 'added ' ELSE 'removed ' END || kind || ' ' || name || ' in ' || file || CASE WHEN kind = 'export' THEN ', export, ' || CASE WHEN ord % 2 = 0 THEN 'public entry point' ELSE 'module export' END ELSE '' END AS line FROM c WHERE r <= CASE side WHEN 'after' THEN a - b ELSE b - a END""")
def boundary_delta_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = delta.surplus(entries(spark, sf_dir), ["sha", "kind", "name"])
    return delta.rendered(d.withColumns({"detail": F.lit(None).cast("string"), "public_entry": F.col("ord") % 2 == 0})).select("sha", "line")


@registered("symbol_delta_cancel", f"""WITH {_ENTRIES}, c AS (SELECT *, CASE side WHEN 'after' THEN 'added' ELSE 'removed' END AS dir, count(*) FILTER (side = 'after') OVER k AS a, count(*) FILTER (side = 'before') OVER k AS b, row_number() OVER (PARTITION BY sha, kind, name, side ORDER BY ord) AS r FROM e WINDOW k AS (PARTITION BY sha, kind, name))
SELECT sha, kind, name, file, ord::INT AS ord, dir FROM c WHERE r > least(a, b)""")
def symbol_delta_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return delta.cancelled(e.withColumn("dir", F.when(F.col("side") == "after", "added").otherwise("removed")).drop("side"), ["sha", "kind", "name"]).select("sha", "kind", "name", "file", "ord", "dir")


@registered("dedup_boundaries", """WITH b AS (SELECT 'f' || (l_orderkey % 50) AS file, (['route', 'cli', 'ui', 'export'])[l_linenumber % 4 + 1] AS kind, 'n' || (l_partkey % 7) AS name, (l_suppkey % 9)::INT AS line, CASE WHEN l_linenumber % 4 = 3 THEN 'd' || (l_partkey % 2) END AS detail, l_linenumber % 4 AS ko FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN kind = 'export' THEN 'e/' || file || '/' || name || '/' || coalesce(detail, '') ELSE 'o/' || file || '/' || line || '/' || name END ORDER BY file, line, ko, name, detail) AS r FROM b)
SELECT file, kind, name, line, detail FROM r WHERE r = 1""")
def dedup_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    b = li.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string")).alias("file"), F.element_at(F.array(*map(F.lit, ("route", "cli", "ui", "export"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("kind"), F.concat(F.lit("n"), (F.col("l_partkey") % 7).cast("string")).alias("name"), (F.col("l_suppkey") % 9).cast("int").alias("line"), F.when(F.col("l_linenumber") % 4 == 3, F.concat(F.lit("d"), (F.col("l_partkey") % 2).cast("string"))).alias("detail"))
    return delta.deduplicated(b)


@registered("name_cap", f"""WITH {_ENTRIES}, d AS (SELECT *, CASE side WHEN 'after' THEN 'added' ELSE 'removed' END AS dir, ord % 2 = 0 AS pub FROM e), ch AS (SELECT DISTINCT sha, (['new', 'deepened', 'regressed', 'removed'])[sha % 4 + 1] AS change FROM e),
p AS (SELECT d.*, d.dir = CASE WHEN change IN ('new', 'deepened') THEN 'added' ELSE 'removed' END AS want FROM d JOIN ch USING (sha) WHERE kind <> 'export' OR pub), q AS (SELECT *, bool_or(want) OVER (PARTITION BY sha) AS anyw FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY list_position(['route', 'command', 'ui handler', 'export'], kind), ord) AS k, count(*) OVER (PARTITION BY sha) - 1 AS more FROM q WHERE want OR NOT anyw)
SELECT sha, CASE kind WHEN 'command' THEN name || ' command' WHEN 'ui handler' THEN name || ' handler' WHEN 'export' THEN 'export ' || name ELSE name END || CASE WHEN more > 0 THEN ' and ' || more || ' more' ELSE '' END AS name FROM r WHERE k = 1""")
def name_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).withColumns({"dir": F.when(F.col("side") == "after", "added").otherwise("removed"), "public_entry": F.col("ord") % 2 == 0})
    changes = e.select("sha", F.element_at(F.array(*map(F.lit, ("new", "deepened", "regressed", "removed"))), (F.col("sha") % 4 + 1).cast("int")).alias("change")).distinct()
    return naming.from_entries(changes, e)


@registered("truncate_head_tail", """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 131) || ' … ' || right(text, 66) END AS cut, left(text, 50) AS head FROM documents""")
def truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.truncated(F.col("text"), 200, both_ends=True).alias("cut"), text.truncated(F.col("text"), 50).alias("head"))


@registered("cut_diff", """SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text WHEN strpos(left(text, 2000), chr(10)) = 0 THEN '' ELSE left(text, 2001 - strpos(reverse(left(text, 2000)), chr(10))) END AS cut FROM documents""")
def cut_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.cut_diff(F.col("text"), 2000).alias("cut"))
