"""Commit-shaped inputs derived from the test tables, each with the SQL that makes the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Paths that touch every classification rule several times.
PATHS = (
    "dist/a.js", "src/vendor/x.go", "web/app.min.js", "types/index.d.ts", "api/user.pb.go", "src/schema.generated.ts", "proto/x_pb2.py", "lib/a.gen.go",
    "bun.lock", "Cargo.lock", "go.sum", "sub/poetry.lock", "package.json", "setup.py", "requirements-dev.txt", "app/build.gradle.kts", "My.csproj", "go.mod",
    ".github/workflows/ci.yml", "Makefile", "Dockerfile.dev", "tsconfig.base.json", ".gitignore", "sub/.gitkeep", ".claude/settings.json", ".cursor/rules.md", "vite.config.ts",
    "src/a.test.ts", "tests/x.py", "pkg/a_test.go", "test_main.py", "conftest.py", "e2e/login.spec.js", "archive/x.ts", "deprecated/old.py", "a/attic/z.go", "drafts/p.md", "content/_drafts/q.md", "x/drafts/r.txt",
    "README.md", "LICENSE", "CHANGELOG.txt", "docs/x.md", "docs/conf.py", "examples/go.ts", "SECURITY.md", "NOTES", "history.ts", "isa.html",
    "skills/x/SKILL.md", "CLAUDE.md", "patterns/sum/system.md", "commands/go.md", "Prompt-Ideas.md", "INSTALL_GUIDE.md", "packs/p.yaml", "agents/AGENTS.md", "tips/one.md",
    "logo.svg", "img/Photo.JPEG", "fonts/a.woff2", "media/v.mp4", "bunker.config.ts", "wrangler.js", "tailwind.config.js", "next.config.mjs",
    "src/a.ts", "cmd/main.go", "lib/Foo.kt", "app/views/home.html", "db/migrations/001_init.sql", "scripts/run.sh", "src/pages/changelog.astro",
    "config/app.yaml", "data/items.json", ".env.example", "vercel.json", "settings.toml", "content/post.md", "posts/2024/a.mdx", "wordlists/en.txt", "datasets/x.csv", "blog/feature-flags.json", "content/data.jsonl", "blog/manifest.yaml",
    ".foorc", ".toolignore", ".htaccess", "prisma/schema.prisma", ".env", "releases/1.2.0/x.ts", "releases/v2/y/z.md", "releases/latest/x.ts", "a/releases/1.0-rc.1/b.go", "releases/3",
    "src/XMLHttpRequest_utils.ts", "packages/invoice-export/src/index.ts", "src/main.py", "lib/index.js", "src/parseConfigFile.ts", "tools/src/app.rb",
)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged commits from ``events``: at most two records each, some failed, some with none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t.isin("purchase", "signup"), "cap").when(t == "error", "fix").when(t == "view", "tend")
    change = F.when(t == "purchase", F.when(i % 10 == 0, "regressed").otherwise("new")).when(t == "signup", F.when(i % 15 == 0, "removed").otherwise("deepened"))
    name = F.concat(F.lit("feature "), (i % 13).cast("string"))
    one = F.struct(kind.alias("kind"), change.alias("change"), F.when(kind == "cap", name).alias("name"), F.concat(F.lit("did "), t).alias("summary"))
    two = F.struct(F.lit("tend").alias("kind"), F.lit(None).cast("string").alias("change"), F.lit(None).cast("string").alias("name"), F.lit("kept up").alias("summary"))
    both = F.filter(F.array(one, F.when((i % 7 == 0) & kind.isin("cap", "fix"), two)), lambda r: r["kind"].isNotNull())
    bad = i % 97 == 0
    return e.select(
        F.concat(F.lit("repo-"), (F.col("user_id") % 4).cast("string")).alias("repo"), i.alias("seq"), F.concat(F.md5(i.cast("string")), F.substring(F.md5(i.cast("string")), 1, 8)).alias("sha"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("author"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_iso"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(bad, F.array().cast("array<struct<kind:string,change:string,name:string,summary:string>>")).otherwise(both).alias("records"), F.when(bad, "judge timeout").alias("error"),
    )


COMMITS_SQL = """
commits AS (
  SELECT 'repo-' || (user_id % 4) AS repo, event_id AS seq, md5(event_id::VARCHAR) || substr(md5(event_id::VARCHAR), 1, 8) AS sha, 'user-' || user_id AS author,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date_iso, ts, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CASE WHEN event_id % 97 = 0 THEN 'judge timeout' END AS error,
    CASE event_type WHEN 'purchase' THEN 'cap' WHEN 'signup' THEN 'cap' WHEN 'error' THEN 'fix' WHEN 'view' THEN 'tend' END AS kind,
    CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN 'regressed' ELSE 'new' END WHEN 'signup' THEN CASE WHEN event_id % 15 = 0 THEN 'removed' ELSE 'deepened' END END AS change,
    'feature ' || (event_id % 13) AS name, event_type FROM events),
counted AS (
  SELECT *, CASE WHEN error IS NULL AND kind = 'cap' THEN CASE WHEN change IN ('regressed', 'removed') THEN -1 ELSE 1 END ELSE 0 END AS cap,
    CASE WHEN error IS NULL AND kind = 'fix' THEN 1 ELSE 0 END AS fix, CASE WHEN error IS NULL AND (kind = 'tend' OR (seq % 7 = 0 AND kind IN ('cap', 'fix'))) THEN 1 ELSE 0 END AS tend FROM commits)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files from ``lineitem``: the order is the commit, the path comes from the part."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("l_partkey") % len(PATHS) + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("added", "modified", "deleted", "renamed", "copied"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    old = F.when(status.isin("renamed", "copied"), F.element_at(F.array(*map(F.lit, PATHS)), ((F.col("l_partkey") + F.col("l_suppkey")) % len(PATHS) + 1).cast("int")))
    return li.select(
        F.col("l_orderkey").alias("sha"), path.alias("path"), old.alias("old_path"), status.alias("status"), F.when(status.isin("renamed", "copied"), F.when(F.col("l_linenumber") % 2 == 0, 100).otherwise(80)).alias("similarity"),
        F.col("l_quantity").cast("int").alias("added"), (F.col("l_extendedprice").cast("bigint") % 40).cast("int").alias("removed"),
    )


_PATH_LIST = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
FILES_SQL = f"""
files AS (
  SELECT l_orderkey AS sha, ({_PATH_LIST})[l_partkey % {len(PATHS)} + 1] AS path, (['added', 'modified', 'deleted', 'renamed', 'copied'])[l_suppkey % 5 + 1] AS status,
    CASE WHEN l_suppkey % 5 IN (3, 4) THEN ({_PATH_LIST})[(l_partkey + l_suppkey) % {len(PATHS)} + 1] END AS old_path, CASE WHEN l_suppkey % 5 IN (3, 4) THEN CASE WHEN l_linenumber % 2 = 0 THEN 100 ELSE 80 END END AS similarity,
    trunc(l_quantity)::INT AS added, (trunc(l_extendedprice)::BIGINT % 40)::INT AS removed FROM lineitem)
"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unified diff for each document: line n is context, removed or added by ``n % 3``; every fifth document is a new file."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    new = F.col("doc_id") % 5 == 0
    tagged = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(new, "+").otherwise(F.element_at(F.array(F.lit(" "), F.lit("-"), F.lit("+")), i % 3 + 1)), x))
    count = lambda tags: F.size(F.filter(tagged, lambda x: F.substring(x, 1, 1).isin(*tags))).cast("string")
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.when(new, "\nnew file mode 100644\n").otherwise("\n"), F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,"), count((" ", "-")), F.lit(" +1,"), count((" ", "+")), F.lit(" @@ part "), F.col("lang"), F.lit("\n"))
    return d.select(F.col("doc_id").alias("sha"), F.concat(head, F.array_join(tagged, "\n"), F.lit("\n")).alias("diff"))


LINES_SQL = """
raw AS (SELECT doc_id AS sha, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
lines AS (SELECT sha, lang, i + 1 AS line_no, text, CASE WHEN sha % 5 = 0 THEN '+' ELSE ([' ', '-', '+'])[i % 3 + 1] END AS tag FROM raw)
"""
