"""Queries over source lines, manifests and lists: inputs dealt by arithmetic, so the SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import replies, state, symbols, tally
from ..sources import files
from . import derived
from .derived import COMMITS_SQL, FILES_SQL
from .queries import registered

#: path, line, what it declares.
LINES = (
    ("a.ts", "export function go() {", "fn go"), ("a.ts", "const k = async (x) => 1;", "fn k"), ("b.tsx", "export default class View {", "class View"), ("m.py", "async def run(x):", "fn run"), ("m.py", "class Job:", "class Job"),
    ("g.go", "func (s *Srv) Stop() {}", "fn Srv.Stop"), ("g.go", "type Box struct {", "class Box"), ("l.rs", "pub fn open() {}", "fn open"), ("l.rs", "pub enum Kind {", "class Kind"), ("r.sh", "start() {", "fn start"),
    ("c.yaml", "name: x", "key name"), ("t.toml", "[tool.x]", "key tool.x"), ("q.sql", "create table users (", "table users"), ("q.sql", "drop table users", "table users dropped"), ("q.sql", "alter table t add column age int", "column t.age"),
    ("a.ts", "x = process.env.API_URL", "env API_URL"), ("s.css", "@media (min-width:  9px) {", "@media (min-width: 9px)"), ("a.ts", 'flag("--dry-run")', "flag --dry-run"), ("README.md", "class Job:", ""), ("a.ts", "  function inner() {", ""),
)


def dealt(spark: SparkSession, sf_dir: str, *lists: tuple) -> DataFrame:
    """l_orderkey, l_linenumber and an element of each list, by part."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    pick = lambda x: F.element_at(F.array(*map(F.lit, x)), (F.col("l_partkey") % len(x) + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", *(pick(x).alias(f"c{i}") for i, x in enumerate(lists)))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@registered("line_symbols", f"SELECT s AS symbol, count(*) AS n FROM (SELECT ({_list([x[2] for x in LINES])})[l_partkey % {len(LINES)} + 1] AS s FROM lineitem) WHERE s <> '' GROUP BY s")
def line_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(spark, sf_dir, [x[0] for x in LINES], [x[1] for x in LINES])
    s = d.select(F.explode(symbols.line_symbols(F.col("c0"), F.col("c1"), F.lit(False), F.lit(-1))).alias("s"))
    return s.groupBy(F.concat("s.kind", F.lit(" "), "s.name", F.when(F.col("s.drop"), " dropped").otherwise("")).alias("symbol")).agg(F.count("*").alias("n"))


TITLES = (('it("adds", f)', "adds"), ("test.skip('drops', f)", "drops"), ("def test_more(self):", "test_more"), ("func TestAll(t *testing.T) {", "TestAll"), ("let x = 1", ""))


@registered("test_titles", f"""WITH t AS (SELECT l_orderkey AS sha, ({_list([x[1] for x in TITLES])})[l_partkey % {len(TITLES)} + 1] AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS o FROM lineitem), f AS (SELECT sha, t, min(o) AS o FROM t WHERE t <> '' GROUP BY sha, t)
SELECT sha, coalesce(string_agg(t, ',' ORDER BY o), '') AS titles FROM (SELECT DISTINCT sha FROM t) LEFT JOIN f USING (sha) GROUP BY sha""")
def test_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    line = F.element_at(F.array(*(F.lit(x[0]) for x in TITLES)), (F.col("l_partkey") % len(TITLES) + 1).cast("int"))
    return symbols.test_titles(li.select(F.col("l_orderkey").alias("sha"), F.row_number().over(order).alias("ord"), line.alias("text"))).select("sha", F.array_join("titles", ",").alias("titles"))


MANIFESTS = (("package.json", '{\n"bin": {\n"a": "x",\n"b": "y"\n}}', "a,b"), ("package.json", '{"bin": "z"}', "bin z"), ("pyproject.toml", "[project.scripts]\nrun = 1\n[x]\nno = 1", "run"), ("Cargo.toml", '[[bin]]\nname = "c"', "c"), ("go.mod", "bin = 1", ""))


@registered("manifest_commands", f"SELECT ({_list([x[0] for x in MANIFESTS])})[l_partkey % 5 + 1] AS path, ({_list([x[2] for x in MANIFESTS])})[l_partkey % 5 + 1] AS commands, count(*) AS n FROM lineitem GROUP BY ALL")
def manifest_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(spark, sf_dir, [x[0] for x in MANIFESTS], [x[1] for x in MANIFESTS])
    return d.groupBy(F.col("c0").alias("path"), F.array_join(symbols.manifest_commands(F.col("c0"), F.col("c1")), ",").alias("commands")).agg(F.count("*").alias("n"))


_LANG = "CASE " + " ".join(f"WHEN ends_with(path, '{e}') THEN '{v}'" for e, v in files.LANGUAGES.items()) + " END"
_SKIP = ", ".join(f"'{d}'" for d in files.SKIPPED_DIRS)


@registered("source_scope", f"""WITH {FILES_SQL}, p AS (SELECT path, {_LANG} AS language, string_split(path, '/')[:-2] AS dirs, count(*) AS n FROM files GROUP BY path)
SELECT path, language, language IS NOT NULL AND NOT list_has_any(dirs, [{_SKIP}]) AND NOT regexp_matches(path, '{files.SKIPPED_NAMES}') AND NOT (language = 'go' AND list_contains(dirs, 'internal')) AS in_scope, n FROM p""")
def source_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    each = derived.files(spark, sf_dir).select("path", files.language_of(p).alias("language"), files.in_scope(p).alias("in_scope"))
    return each.groupBy("path", "language", "in_scope").agg(F.count("*").alias("n"))


@registered("plausible_sources", "SELECT doc_id, length(text) <= 1000000 AND NOT (length(text) > 20000 AND length(text) / len(string_split(text, chr(10))) > 400) AS ok FROM documents")
def plausible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", files.plausible(F.col("text")).alias("ok"))


@registered("cache_misses", f"WITH {COMMITS_SQL} SELECT sha FROM commits WHERE error IS NOT NULL OR seq % 3 <> 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits to judge again: a third is cached under the key, failures never are."""
    c = derived.commits(spark, sf_dir)
    cache = c.filter("error is null and seq % 3 = 0").select("sha", F.to_json("records").alias("body"), F.lit("k").alias("cache_key"))
    return replies.misses(c, cache, "k").select("sha")


@registered("cache_with_broken_entries", f"WITH {COMMITS_SQL} SELECT CASE WHEN error IS NULL AND seq % 3 = 0 THEN 'cached' ELSE 'missed' END AS how, count(*) AS n FROM commits GROUP BY 1")
def cache_with_broken_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit is either cached or missed, also where its entry is broken; what is cached stays when broken entries go."""
    c = derived.commits(spark, sf_dir)
    cache = c.filter("error is null").select("sha", F.when(F.col("seq") % 3 == 0, F.to_json("records")).otherwise("[broken").alias("body"), F.lit("k").alias("cache_key"))
    kept = replies.without_broken(cache, "k")
    both = replies.cached(c.select("sha"), kept, "k").select(F.lit("cached").alias("how")).unionByName(replies.misses(c.select("sha"), cache, "k").select(F.lit("missed").alias("how")))
    return both.groupBy("how").agg(F.count("*").alias("n"))


@registered("run_counters", f"WITH {COMMITS_SQL} SELECT sum(seq % 4)::BIGINT AS calls, sum(seq % 100)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, sum(seq % 2)::BIGINT AS redactions, count(*) FILTER (seq % 3 = 0) AS cached, 'm' || min(seq) FILTER (seq % 5 = 4) AS answered_by FROM commits")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    c = derived.commits(spark, sf_dir).select("seq", (seq % 4).alias("calls"), (seq % 100).alias("input_tokens"), F.lit(0).alias("output_tokens"), (seq % 2).alias("redactions"), (seq % 3 == 0).alias("cached"), F.when(seq % 5 == 4, F.concat(F.lit("m"), seq.cast("string"))).alias("model"))
    return tally.counters(c)


@registered("cached_records", f"WITH {COMMITS_SQL} SELECT count(*) AS commits, (sum(CASE WHEN kind IS NULL THEN 0 WHEN seq % 7 = 0 AND kind IN ('cap', 'fix') THEN 2 ELSE 1 END))::BIGINT AS records FROM commits WHERE error IS NULL AND seq % 3 = 0")
def cached_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived.commits(spark, sf_dir)
    cache = c.filter("error is null").select("sha", F.when(F.col("seq") % 3 == 0, F.to_json("records")).otherwise("[broken").alias("body"), F.lit("k").alias("cache_key"))
    return replies.cached(c.select("sha"), cache, "k").agg(F.count("*").alias("commits"), F.sum(F.size("records")).alias("records"))


def _files_sql() -> str:
    from ..functions import paths
    from .fact_queries import PHRASE_SQL, VIEWS_SQL

    product = ", ".join(f"'{c}'" for c in paths.PRODUCT)
    return f"""WITH {VIEWS_SQL}, l AS (SELECT sha, {PHRASE_SQL} || ' [' || cls || ']' AS line, cls, cls NOT IN ({product}) AS other FROM v),
t AS (SELECT sha, list_sort(list({{'other': other, 'line': line, 'cls': cls}})) AS r FROM l GROUP BY sha),
u AS (SELECT sha, list_transform(r, lambda x: x.line) AS every, list_transform(list_filter(r, lambda x: NOT x.other), lambda x: x.line) AS own, list_filter(r, lambda x: x.other) AS rest FROM t)
SELECT sha, length(array_to_string(every, chr(10))) <= {FILES_CAP} AS whole, array_to_string(list_sort(CASE WHEN length(array_to_string(every, chr(10))) <= {FILES_CAP} THEN every ELSE list_append(own, 'and ' || len(rest) || ' non-product file(s) left out') END), chr(10)) AS lines FROM u"""


#: Half of the commits are over it.
FILES_CAP = 160


@registered("files_state_text", _files_sql())
def files_state_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each commit's files field, with a cap that many commits pass; sorted, as the files of the table have no order, and
    without the list of classes, which goes by that order."""
    from .fact_queries import file_views

    v = file_views(spark, sf_dir).withColumn("file_no", F.monotonically_increasing_id())
    whole = F.length("everything") <= FILES_CAP
    every = state.files_text(v, 1 << 30).withColumnRenamed("files", "everything")
    text = state.files_text(v, FILES_CAP).join(every, "sha")
    lines = F.sort_array(F.transform(F.split("files", "\n"), lambda x: F.regexp_replace(x, r"(left out): .*", "$1")))
    return text.select("sha", whole.alias("whole"), F.array_join(lines, "\n").alias("lines"))


@registered("report_document", f"""WITH {COMMITS_SQL}, w AS (SELECT week, sum(cap)::BIGINT AS cap, sum(fix)::BIGINT AS fix, sum(tend)::BIGINT AS tend FROM counted GROUP BY week), a AS (SELECT author, sum(cap)::BIGINT AS cap, sum(fix)::BIGINT AS fix, sum(tend)::BIGINT AS tend, min(seq) AS s FROM counted GROUP BY author)
SELECT count(*) AS commits, count(error) = 0 AS complete, sum(cap)::BIGINT AS cap, (SELECT string_agg(week || ' ' || cap || ' ' || fix || ' ' || tend, ',' ORDER BY week) FROM w) AS weeks, (SELECT string_agg(author || ' ' || cap || ' ' || fix || ' ' || tend, ',' ORDER BY cap + fix + tend DESC, s) FROM a) AS authors,
  md5(string_agg(name || ' ' || change || ' ' || substr(sha, 1, 7) || ' ' || author || ' ' || date_iso, ',' ORDER BY seq) FILTER (kind = 'cap' AND error IS NULL)) AS caps, md5(string_agg(substr(sha, 1, 7) || ' ' || error, ',' ORDER BY seq) FILTER (error IS NOT NULL)) AS failed FROM counted""")
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's parts as text, capabilities and failures as its digest."""
    r = tally.report(derived.commits(spark, sf_dir), "repo", "judge", "model", "90d")
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *(x[n].cast("string") for n in names))), ",")
    sums = ("cap", "fix", "tend")
    return r.select("commits", "complete", F.col("totals.cap").alias("cap"), text("weeks", "week", *sums).alias("weeks"), text("authors", "author", *sums).alias("authors"), F.md5(text("caps", "name", "change", "sha", "author", "date")).alias("caps"), F.md5(text("failed", "sha", "error")).alias("failed"))
