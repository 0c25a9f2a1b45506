"""Queries over facts and the policy, with the SQL that gives the same rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import paths
from ..operators import facts, policy, views
from . import analyze, derived
from .derived import FILES_SQL
from .history_queries import PARTS_SQL, _in, class_sql
from .queries import registered

POLICY = str(Path(__file__).with_name("policy.json"))
SNAP = "(?i)(^|/)releases/v?[0-9]+(\\.[0-9]+)*([-.][0-9a-z.]+)?/"


def file_views(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Views of the derived files in a mixed repository; old paths and similarity come with the rows, there is no diff."""
    f = views.classified(derived.files(spark, sf_dir), by="sha" if dealt else None)
    f = f.withColumn("git", F.upper(F.substring("status", 1, 1)))
    none = F.lit(None).cast("array<string>")
    return f.withColumn("view_status", views.view_status(F.col("git"), F.col("cls"), F.col("src_cls"), none, none))


_PROD = lambda x: _in(x, paths.PRODUCT)
VIEWS_SQL = f"""{FILES_SQL}, names AS (SELECT DISTINCT path FROM (SELECT path FROM files UNION ALL SELECT old_path FROM files WHERE old_path IS NOT NULL)), src AS (SELECT path FROM names), {PARTS_SQL},
classed AS (SELECT path, {class_sql('mixed')} AS cls FROM parts),
v0 AS (SELECT f.*, upper(substr(status, 1, 1)) AS git, c.cls, o.cls AS src_cls FROM files f JOIN classed c USING (path) LEFT JOIN classed o ON o.path = f.old_path WHERE NOT regexp_matches(f.path, '{SNAP}')),
v1 AS (SELECT *, CASE WHEN git IN ('R', 'C') AND NOT {_PROD('src_cls')} AND {_PROD('cls')} THEN CASE WHEN src_cls = 'draft' THEN 'published' ELSE 'added' END WHEN git IN ('R', 'C') AND {_PROD('src_cls')} AND NOT {_PROD('cls')} THEN CASE WHEN cls = 'archived' THEN 'archived' ELSE 'deleted' END ELSE status END AS view_status,
  cls = 'content' AS is_item, coalesce(src_cls = 'content', false) AS src_is_item, {_PROD('cls')} AS prod, coalesce({_PROD('src_cls')}, false) AS src_prod FROM v0),
v AS (SELECT *, git = 'C' AND coalesce(similarity, 0) < 100 AND NOT EXISTS (SELECT 1 FROM v1 g WHERE g.sha = v1.sha AND g.git = 'D' AND g.path = v1.old_path) AS copied FROM v1)"""
FACTS_SQL = f"""{VIEWS_SQL}, a AS (SELECT sha, count(*) FILTER (prod) AS product_files, count(*) FILTER (prod) > 0 AND bool_and(NOT prod OR cls = 'asset') AS asset_only,
  count(*) FILTER (prod AND cls = 'source' AND (view_status IN ('added', 'published') OR copied)) AS source_files_added,
  count(*) FILTER (is_item AND (view_status IN ('added', 'published') OR copied)) AS items_added, count(*) FILTER (view_status IN ('deleted', 'archived') AND CASE WHEN git = 'D' THEN is_item ELSE src_is_item END) AS items_removed,
  count(*) FILTER (prod) > 0 AND bool_and(NOT prod OR (cls IN ('content', 'asset') AND (view_status = 'modified' OR (view_status = 'renamed' AND coalesce(similarity, 100) < 100)))) AS content_edit,
  bool_or(cls IN ('dependency_manifest', 'lockfile')) AS dependency_changed, bool_or(cls = 'ci_build') AS tooling_changed, bool_or(cls = 'docs') AS docs_changed, bool_or(cls = 'test') AS tests_changed,
  count(*) FILTER (prod) > 0 AND bool_and(NOT prod OR (git IN ('R', 'C') AND coalesce(similarity, 0) = 100 AND src_prod)) AS moved,
  CASE WHEN count(*) FILTER (git IN ('A', 'C')) < 4000 THEN false END AS copy_detection_skipped,
  count(*) FILTER (view_status = 'deleted' AND CASE WHEN git = 'D' THEN prod ELSE src_prod END) AS product_files_deleted,
  coalesce(sum(added) FILTER (prod), 0) AS plus, coalesce(sum(removed) FILTER (prod), 0) AS minus,
  bool_or(prod AND cls <> 'asset' AND (git = 'M' OR (git IN ('R', 'C') AND coalesce(similarity, 100) < 100 AND src_prod)) AND removed >= 1) AS e1, bool_or(prod AND cls <> 'asset' AND (git = 'M' OR (git IN ('R', 'C') AND coalesce(similarity, 100) < 100 AND src_prod)) AND added >= 1) AS e2,
  bool_or(cls = 'test') AS t1, bool_and(cls <> 'test' OR git = 'A') AS t2, bool_or(prod AND cls = 'asset') AND bool_or(prod AND cls <> 'asset') AS assets_changed, count(*) FILTER (prod) > 0 AND bool_and(NOT prod OR cls = 'app_config') AS config_only FROM v GROUP BY sha),
f AS (SELECT *, CASE WHEN product_files = 0 THEN NULL WHEN e1 THEN 'changes_existing_lines' WHEN e2 THEN 'additions_in_existing' ELSE 'new_files_only' END AS edit_shape, CASE WHEN NOT t1 THEN 'none' WHEN t2 THEN 'new_test_files_only' ELSE 'existing_tests_changed' END AS tests_shape,
  content_edit AND items_added = 0 AND items_removed = 0 AS content_only_edit, moved AND items_added = 0 AND items_removed = 0 AS move_or_copy_only, minus >= 15 AND minus >= 2 * plus AS deletion_dominant FROM a)"""

COUNTS = ("product_files", "source_files_added", "items_added", "items_removed", "product_files_deleted")
FLAGS = ("asset_only", "content_only_edit", "dependency_changed", "tooling_changed", "docs_changed", "tests_changed", "move_or_copy_only", "copy_detection_skipped", "deletion_dominant", "assets_changed", "config_only")
registered("facts_counts", f"WITH {FACTS_SQL} SELECT sha, {', '.join(COUNTS)} FROM f")(lambda s, d: facts.facts(file_views(s, d)).select("sha", *COUNTS))
registered("facts_flags", f"WITH {FACTS_SQL} SELECT sha, {', '.join(FLAGS)} FROM f")(lambda s, d: facts.facts(file_views(s, d)).select("sha", *FLAGS))
registered("edit_shape", f"WITH {FACTS_SQL} SELECT edit_shape, count(*) AS n FROM f GROUP BY 1")(lambda s, d: facts.facts(file_views(s, d)).groupBy("edit_shape").agg(F.count("*").alias("n")))
registered("tests_shape", f"WITH {FACTS_SQL} SELECT tests_shape, count(*) AS n FROM f GROUP BY 1")(lambda s, d: facts.facts(file_views(s, d)).groupBy("tests_shape").agg(F.count("*").alias("n")))
registered("deletion_dominant", f"WITH {FACTS_SQL} SELECT sha, deletion_dominant FROM f")(lambda s, d: facts.facts(file_views(s, d)).select("sha", "deletion_dominant"))
registered("file_view_status", f"WITH {VIEWS_SQL} SELECT sha, path, git, cls, src_cls, view_status, is_item, src_is_item, count(*) AS n FROM v GROUP BY ALL")(
    lambda s, d: file_views(s, d).groupBy("sha", "path", "git", "cls", "src_cls", "view_status", "is_item", "src_is_item").agg(F.count("*").alias("n")))


PHRASE_SQL = """CASE view_status WHEN 'renamed' THEN 'renamed from ' || old_path || CASE WHEN similarity < 100 THEN ' with changes' ELSE '' END || ' to ' || path WHEN 'copied' THEN 'copied from ' || old_path || CASE WHEN similarity < 100 THEN ' with changes' ELSE '' END || ' to ' || path
WHEN 'published' THEN CASE WHEN old_path IS NULL THEN 'published from a draft ' || path ELSE 'published from a draft ' || old_path || ' to ' || path END WHEN 'archived' THEN 'archived ' || old_path || ' to ' || path WHEN 'added' THEN CASE WHEN old_path IS NULL THEN 'added ' || path ELSE 'added ' || path || ' (moved in from ' || old_path || ')' END
WHEN 'deleted' THEN CASE WHEN old_path IS NULL THEN 'deleted ' || path ELSE 'deleted ' || old_path || ' (moved out to ' || path || ')' END ELSE 'modified ' || path END"""


@registered("status_phrases", f"WITH {VIEWS_SQL} SELECT {PHRASE_SQL} AS phrase, count(*) AS n FROM v GROUP BY 1")
def status_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = file_views(spark, sf_dir, dealt=False)
    return v.groupBy(views.status_phrase(F.col("view_status"), F.col("path"), F.col("old_path"), F.col("similarity")).alias("phrase")).agg(F.count("*").alias("n"))


@registered("files_numstat_zip", """WITH r AS (SELECT l_orderkey AS sha, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS file_no, 'p' || l_partkey AS path, (['added', 'modified', 'deleted', 'renamed', 'copied', 'type changed'])[l_suppkey % 6 + 1] AS status, l_linenumber % 5 = 0 AS bin, trunc(l_quantity)::INT AS q FROM lineitem)
SELECT sha, file_no, path, status, CASE WHEN bin THEN 0 ELSE q END AS added, CASE WHEN bin THEN 0 ELSE q + 1 END AS removed FROM r""")
def files_numstat_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    letter = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R090", "C100", "T"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    r = li.select(F.col("l_orderkey").alias("sha"), F.row_number().over(order).alias("file_no"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), letter.alias("letter"), (F.col("l_linenumber") % 5 == 0).alias("bin"), F.col("l_quantity").cast("int").alias("q"))
    n = lambda c: F.when(F.col("bin"), "-").otherwise(c.cast("string"))
    return views.numstat_zip(r.select("sha", "file_no", "path", "letter"), r.select("sha", "file_no", n(F.col("q")).alias("added"), n(F.col("q") + 1).alias("removed")))


@registered("product_diff_size", """WITH s AS (SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS k, doc_id % 50 AS missing, doc_id % 3 = 0 AS inc FROM documents), g AS (SELECT *, n + floor(missing * CASE WHEN k > 0 THEN n / k ELSE 40 END + 0.5) AS guess FROM s)
SELECT doc_id, CASE WHEN inc THEN CASE WHEN guess <= 24000 AND CASE WHEN guess > 0 THEN least(n, 6000) / guess ELSE 0 END >= 0.25 THEN 'large' ELSE 'huge' END WHEN guess <= 6000 THEN 'fits' WHEN guess <= 24000 THEN 'large' ELSE 'huge' END AS size FROM g""")
def product_diff_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", facts.diff_size(F.length("text"), F.col("doc_id") % 50, F.size(F.split("text", "\n")), F.col("doc_id") % 3 == 0).alias("size"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and recorded answers: probabilities from ``lineitem``, some unasked, some out of range."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.max(F.round(F.col("l_discount") * 10, 1)).alias("d"), F.max(F.round(F.col("l_tax") * 12, 2)).alias("t"), F.max("l_linenumber").alias("m"), F.min("l_suppkey").alias("s"))
    a = lambda kind, **x: F.struct(F.lit(kind).alias("type"), *(x.get(n, F.lit(None).cast(k)).cast(k).alias(n) for n, k in (("noul", "double"), ("choice", "string"), ("score", "double"), ("confidence", "double"), ("probabilities", "map<string,double>"))))
    share = F.create_map(F.lit("new"), F.col("t"), F.lit("deeper"), F.round(F.lit(0.96) - F.col("t"), 2))
    best = F.when(F.col("t") >= 0.48, "new").otherwise("deeper")
    pairs = F.array(
        F.struct(F.lit("repairs").alias("k"), a("noul", noul=F.when(F.col("m") % 5 == 0, F.lit(1.5)).otherwise(F.col("d"))).alias("v")),
        F.struct(F.lit("gain").alias("k"), a("choice", choice=best, confidence=F.lit(0.5), probabilities=share).alias("v")),
        F.struct(F.lit("reach").alias("k"), a("score", score=(F.col("s") % 4).cast("double"), confidence=F.lit(0.5)).alias("v")),
        F.when(F.col("s") % 3 != 0, F.struct(F.lit("noticed").alias("k"), a("noul", noul=F.round(1 - F.col("d"), 1)).alias("v"))),
    )
    return li.select(F.col("l_orderkey").alias("sha"), F.map_from_entries(F.array_compact(pairs)).alias("answers"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts.facts(file_views(spark, sf_dir)).withColumn("snapshot_only", F.when(F.col("sha") % 11 != 0, False))
    return policy.decide(policy.Policy.load(POLICY), f.join(judged(spark, sf_dir), "sha"))


_ANSWERS = f"""{FACTS_SQL}, q AS (SELECT l_orderkey AS sha, max(round(l_discount * 10, 1)) AS d, max(round(l_tax * 12, 2)) AS t, max(l_linenumber) AS m, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
j AS (SELECT f.*, t, round(0.96 - t, 2) AS deeper, s, CASE WHEN m % 5 = 0 THEN NULL ELSE d END AS rep, CASE WHEN s % 3 <> 0 THEN round(1 - d, 1) END AS noticed, CASE WHEN t >= 0.48 THEN 'new' ELSE 'deeper' END AS best, greatest(t, CASE WHEN t >= 0.48 THEN t ELSE round(0.96 - t, 2) END) AS ignore, CASE WHEN t >= 0.48 THEN t ELSE round(0.96 - t, 2) END AS strength FROM f JOIN q USING (sha)),
st AS (SELECT *, CASE WHEN rep IS NULL THEN 'unasked' WHEN greatest(rep, 1 - rep) + 1e-12 < 0.6 THEN 'uncertain' WHEN rep >= 1 - rep THEN 'yes' ELSE 'no' END AS repairs, CASE WHEN noticed IS NULL THEN 'unasked' WHEN greatest(noticed, 1 - noticed) + 1e-12 < 0.7 THEN 'uncertain' WHEN noticed >= 1 - noticed THEN 'yes' ELSE 'no' END AS seen, strength + 1e-12 >= 0.5 AS chosen FROM j),
capd AS (SELECT *, CASE WHEN product_files <= 0 THEN ['none', 'no_product', 'deterministic'] WHEN product_files_deleted >= 1 AND source_files_added <= 0 AND s % 4 <= 1 THEN ['removed', 'all_gone', 'judgment'] WHEN t >= 0.4 - 1e-9 AND deeper >= 0.4 - 1e-9 THEN ['escalate', 'torn', 'escalation']
  WHEN chosen AND best = 'new' AND seen <> 'no' THEN ['new', 'new', 'judgment'] WHEN coalesce(edit_shape IN ('changes_existing_lines', 'additions_in_existing'), false) AND 0.6 * deeper + 0.3 * coalesce(noticed, 0) + 0.1 * least(1, greatest(0, (s % 4) / 3)) >= 0.5 - 1e-9 THEN ['deepened', 'deeper', 'judgment'] ELSE ['none', NULL, 'default'] END AS cap,
  CASE WHEN product_files <= 0 THEN ['no', 'no_product', 'deterministic'] WHEN repairs = 'yes' THEN ['yes', 'repair', 'judgment'] ELSE ['no', NULL, 'default'] END AS fix,
  CASE WHEN dependency_changed OR tooling_changed OR docs_changed OR tests_changed THEN ['yes', 'plumbing', 'deterministic'] WHEN repairs = 'uncertain' THEN ['yes', 'unsure', 'judgment'] ELSE ['no', NULL, 'default'] END AS tend FROM st)"""
_FLAT = ", ".join(f"{d}[{i}] AS {d}_{n}" for d in ("cap", "fix", "tend") for i, n in ((1, "outcome"), (2, "rule"), (3, "by")))
registered("policy_outcomes", f"WITH {_ANSWERS} SELECT sha, {_FLAT} FROM capd")(lambda s, d: decided(s, d).select("sha", *(F.col(f"{x}.{n}").alias(f"{x}_{n}") for x in ("cap", "fix", "tend") for n in ("outcome", "rule", "by"))))
registered("policy_records", f"WITH {_ANSWERS} SELECT cap[1] AS cap, fix[1] AS fix, tend[1] AS tend, (cap[1] IN ('new', 'deepened', 'regressed', 'removed'))::INT + (fix[1] = 'yes')::INT + (tend[1] = 'yes')::INT AS n_records, count(*) AS n FROM capd GROUP BY ALL")(
    lambda s, d: decided(s, d).select(F.col("cap.outcome").alias("cap"), F.col("fix.outcome").alias("fix"), F.col("tend.outcome").alias("tend"), F.size(policy.records(F.col("cap.outcome"), F.col("fix.outcome"), F.col("tend.outcome"), F.lit("x"))).alias("n_records")).groupBy("cap", "fix", "tend", "n_records").agg(F.count("*").alias("n")))


@registered("policy_stage_gate", f"WITH {_ANSWERS} SELECT sha, product_files >= 1 AND NOT coalesce(false, false) AS survey, chosen AS confirm FROM capd")
def policy_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy.Policy.load(POLICY)
    f = facts.facts(file_views(spark, sf_dir)).withColumn("snapshot_only", F.when(F.col("sha") % 11 != 0, False)).join(judged(spark, sf_dir), "sha")
    return f.select("sha", policy.gate(p, "survey", f).alias("survey"), policy.gate(p, "confirm", f).alias("confirm"))


@registered("noul_state", f"WITH {_ANSWERS} SELECT sha, repairs, seen AS noticed, CASE WHEN chosen THEN 'answered' ELSE 'uncertain' END AS gain, 'answered' AS reach FROM st")
def noul_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy.Policy.load(POLICY)
    f = facts.facts(file_views(spark, sf_dir)).select("sha").join(judged(spark, sf_dir), "sha")
    return f.select("sha", *(policy.state(p, q, F.col("answers")).alias(q) for q in ("repairs", "noticed", "gain", "reach")))


@registered("policy_weighted", f"WITH {_ANSWERS} SELECT sha, round(0.6 * deeper + 0.3 * coalesce(noticed, 0) + 0.1 * least(1, greatest(0, (s % 4) / 3)), 6) AS total FROM st")
def policy_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy.Policy.load(POLICY)
    f = facts.facts(file_views(spark, sf_dir)).select("sha").join(judged(spark, sf_dir), "sha")
    terms = next(r for r in p.policy["cap"] if r["id"] == "deeper")["weighted"]["terms"]
    total = sum((t["weight"] * policy.term_value(p, t, F.col("answers")) for t in terms), F.lit(0.0))
    return f.select("sha", F.round(total, 6).alias("total"))


#: Files of a commit, {i} their place: path, letter, lines of the one hunk behind its head, boundary added and removed (as text), public exports
#: added and removed, symbols removed, tables, product, whether an entry point shows, whether the file may hold more, why it is unread.
KINDS_OF_FILES = (
    ("src/m{i}.py", "M", "@@ -1,4 +1,4 @@\n import x\n-@app.get('/a{i}')\n+@app.get('/b{i}')\n def go():\n     return 1\n", ("route GET /b{i}",), ("route GET /a{i}",), 0, 0, 1, 0, True, True, False, ""),
    ("src/w{i}.py", "M", "@@ -1,3 +1,3 @@\n import x\n-x = 1\n+x  =  1\n y = 2\n", (), (), 0, 0, 0, 0, True, False, False, ""),
    ("src/t{i}.ts", "A", '@@ -0,0 +1,2 @@\n+export function f{i}() {}\n+app.get("/t{i}", go);\n', ("export f{i}, function, module export", "route GET /t{i}"), (), 0, 0, 0, 0, True, True, False, ""),
    ("pkg/g{i}.go", "D", "@@ -1,2 +0,0 @@\n-package g\n-func Stop{i}() {}\n", (), ("export Stop{i}, function, public entry point",), 0, 1, 1, 0, True, True, False, ""),
    ("db/migrations/s{i}.sql", "A", "@@ -0,0 +1,2 @@\n+CREATE TABLE t{i} (\n+ id int);\n", (), (), 0, 0, 0, 1, True, False, False, "db/migrations/s{i}.sql (no parser for its ending)"),
    ("README{i}.md", "M", "@@ -1 +1 @@\n-old\n+new\n", (), (), 0, 0, 0, 0, False, False, False, ""),
    ("src/n{i}.py", "M", "@@ -10,5 +10,5 @@\n a\n-b{i} = 1\n+c{i} = 2\n d\n e\n f\n", (), (), 0, 0, 0, 0, True, False, True, ""),
    ("p{i}/package.json", "M", '@@ -1,3 +1,3 @@\n "bin": {\n-"old{i}": "x"\n+"new{i}": "x"\n }\n', ("command new{i}",), ("command old{i}",), 0, 0, 1, 0, False, False, False, ""),
)
PER_COMMIT = 3


def _made(n: int) -> list:
    """Path, letter, section, lines added and removed of each kind at each place."""
    out = []
    for path, letter, hunk, *_ in KINDS_OF_FILES:
        for i in range(n):
            p, h = path.replace("{i}", str(i)), hunk.replace("{i}", str(i))
            head = f"diff --git a/{p} b/{p}\n" + {"A": "new file mode 100644\n", "D": "deleted file mode 100644\n"}.get(letter, "") + f"--- a/{p}\n+++ b/{p}\n"
            body = h.split("\n")[1:]
            out.append((p, letter, head + h, sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body)))
    return out


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records from ``orders``: three files each, their kinds from the order's and the customer's number."""
    made = _made(PER_COMMIT)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("c"))
    place = [((F.col("sha") + i * F.col("c")) % len(KINDS_OF_FILES)).cast("int") * PER_COMMIT + i + 1 for i in range(PER_COMMIT)]
    pick = lambda j, at: F.element_at(F.array(*(F.lit(m[j]) for m in made)), at)
    files = F.array(*(F.struct(F.lit(i).alias("file_no"), pick(1, at).alias("letter"), pick(0, at).alias("path"), pick(3, at).alias("added"), pick(4, at).alias("removed")) for i, at in enumerate(place)))
    return o.select("sha", (F.col("sha") % 3).cast("int").alias("parents"), files.alias("files"), F.concat(*(pick(2, at) for at in place)).alias("diff"))


def _of_kind(j: int, text=str) -> str:
    return "([" + ", ".join(text(k[j]) for k in KINDS_OF_FILES) + "])[k + 1]"


_TEXTS = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]::VARCHAR[]"
_PATH = _of_kind(0, lambda x: f"'{x}'")


def _lines(d: str, j: int) -> str:
    """A file's lines of the delta: its name stands before an export's detail."""
    return f"list_transform({_of_kind(j, _TEXTS)}, lambda x: replace('{d} ' || regexp_replace(x, '^([^,]*)(.*)$', '\\1 in ' || {_PATH} || '\\2'), '{{i}}', i::VARCHAR))"


ROW_SQL = f"""WITH f AS (SELECT o_orderkey AS sha, i, ((o_orderkey + i * o_custkey) % {len(KINDS_OF_FILES)})::INT AS k FROM orders, (VALUES (0), (1), (2)) AS p(i)),
e AS (SELECT *, {_of_kind(9)} AS prod, {_of_kind(10)} AS holds, {_of_kind(11)} AS unknown, replace({_of_kind(12, lambda x: f"'{x}'")}, '{{i}}', i::VARCHAR) AS unread, {_lines('added', 3)} AS plus, {_lines('removed', 4)} AS minus FROM f),
a AS (SELECT sha, count(*) FILTER (prod) AS product_files, count(*) FILTER (k = 3) AS product_files_deleted, count(*) FILTER (prod) > 0 AND bool_and(NOT prod OR k = 1) AS whitespace_only, sum({_of_kind(8)})::BIGINT AS tables_created,
  bool_and(unread = '') AS boundary_extracted, sum(len(list_filter(plus, lambda x: NOT starts_with(x, 'added export'))))::BIGINT AS user_boundaries_added, sum(len(list_filter(minus, lambda x: NOT starts_with(x, 'removed export'))))::BIGINT AS user_boundaries_removed,
  sum({_of_kind(5)})::BIGINT AS public_exports_added, sum({_of_kind(6)})::BIGINT AS public_exports_removed, sum({_of_kind(7)})::BIGINT AS named_symbols_removed, bool_or(prod AND holds) AS holds, bool_or(unknown) AS unknown,
  flatten(list(plus ORDER BY i)) AS plus, flatten(list(minus ORDER BY i)) AS minus, coalesce(string_agg(unread, '; ' ORDER BY i) FILTER (unread <> ''), '') AS why FROM e GROUP BY sha)
SELECT sha, ['root', 'single', 'merge'][sha % 3 + 1] AS parent_kind, product_files, product_files_deleted, whitespace_only, tables_created, boundary_extracted, user_boundaries_added, user_boundaries_removed, public_exports_added, public_exports_removed,
  named_symbols_removed, CASE WHEN holds THEN true WHEN boundary_extracted AND NOT unknown THEN false END AS user_surface_touched, 'fits' AS product_diff_size, false AS diff_empty, false AS secret_shape_remaining, false AS added_paths_mirror_existing,
  CASE WHEN len(plus) + len(minus) = 0 AND why = '' THEN 'none' ELSE array_to_string(list_concat(plus, minus, CASE WHEN why = '' THEN [] ELSE ['not extracted: ' || why] END), chr(10)) END AS boundary_delta FROM a"""
ROW = ("parent_kind", "product_files", "product_files_deleted", "whitespace_only", "tables_created", "boundary_extracted", "user_boundaries_added", "user_boundaries_removed", "public_exports_added", "public_exports_removed", "named_symbols_removed", "user_surface_touched", "product_diff_size", "diff_empty", "secret_shape_remaining", "added_paths_mirror_existing")


@registered("facts_row", ROW_SQL)
def facts_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of facts from raw records, through file views, sections, boundaries, symbols and state texts."""
    return analyze.commit_facts(raw_records(spark, sf_dir), "code").select("sha", *ROW, F.col("state")["boundary_delta"].alias("boundary_delta"))
