import collections
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import paths, redact, text
from tallyloom.operators import delta, diffparse, facts, naming, policy, replies, tally, views
from tallyloom.plans import fact_queries, render
from tallyloom.schema import RECORD


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path, kind, want", [
    ("dist/a.ts", "code", "generated_vendored"), ("x/bun.lock", None, "lockfile"), ("requirements-dev.txt", None, "dependency_manifest"), (".claude/x.json", "code", "ci_build"), (".claude/CLAUDE.md", "prompts", "source"),
    ("src/a.test.ts", None, "test"), ("archive/README.md", None, "archived"), ("drafts/a.md", "content", "draft"), ("src/changelog.astro", None, "source"), ("LICENSE-MIT", None, "docs"), ("docs/a.py", "content", "source"), ("posts/a.md", "mixed", "content"),
    ("posts/a.md", "code", "docs"), ("skills/x/a.md", "prompts", "source"), ("tips.md", "prompts", "source"), ("x/tips.md", "prompts", "docs"), ("My_Guide.md", "prompts", "docs"), ("bunker.config.ts", None, "app_config"), ("next.config.mjs", None, "source"),
    ("data/x.csv", "content", "content"), ("config/x.csv", "content", "app_config"), (".env", None, "app_config"), (".foorc", None, "ci_build"), ("vercel.json", "content", "app_config"), ("a/logo.SVG", None, "asset"),
])
def test_classify(spark, path, kind, want):
    assert one(spark, paths.classify(F.col("p"), kind), p=path) == want


def test_classify_reads_the_head_and_skill_folders(spark):
    df = spark.createDataFrame([("posts/a.md", ["---", "draft: true", "---"], None), ("src/a.ts", ["// Code generated by x"], None), ("mine/deep/a.md", None, ["mine"])], "p string, h array<string>, s array<string>")
    got = [r["c"] for r in df.select(paths.classify(F.col("p"), F.when(F.col("s").isNotNull(), "prompts").otherwise("mixed"), F.col("h"), F.col("s")).alias("c")).collect()]
    assert got == ["draft", "generated_vendored", "source"]


def test_text_functions(spark):
    assert one(spark, paths.ext(F.col("p")), p=".env") == "" and one(spark, paths.ext(F.col("p")), p="a/B.Tar.GZ") == ".gz"
    assert one(spark, text.week_of(text.instant(F.col("d"))), d="2026-01-05T00:30:00+02:00") == "2025-12-29"
    assert one(spark, text.week_of(text.instant(F.col("d"))), d="nonsense") == "undated"
    assert one(spark, text.git_since(F.col("w")), w="6m") == "6 months ago" and one(spark, text.git_since(F.col("w")), w="yesterday") == "yesterday"
    for n in range(0, 30):
        assert one(spark, text.bar(F.col("n"), F.col("t"), 12), n=n, t=29) == render.bar(n, 29, 12)
    assert one(spark, text.github_target(F.col("t")), t="https://www.github.com/a/b.git/")["url"] == "https://github.com/a/b.git"
    assert one(spark, text.github_target(F.col("t")), t="github.com/a/..") is None
    assert one(spark, text.truncated(F.col("t"), 10, both_ends=True), t="abcdefghijklmnop") == "abcd … nop"
    assert one(spark, text.cut_for_judge(F.col("t"), 8), t="ab\ncd\nef\ngh\n") == "ab\ncd\n[diff truncated by tallyloom at 2 lines; 2 lines omitted]\n"
    assert one(spark, text.report_name(F.col("n"), F.col("l")), n=7, l="a b/" + "x" * 90) == "007-" + "x" * 80 + ".json"


def test_tally_counts_zero_rows_losses_and_failures(spark):
    rec = lambda k, c=None: (k, c, "n", "s")
    rows = [("r", 0, "a" * 40, "amy", "2026-01-01T00:00:00Z", [rec("cap", "new"), rec("tend")], None), ("r", 1, "b" * 40, "bob", "2026-01-08T00:00:00Z", [rec("cap", "removed")], None), ("q", 2, "c" * 40, "cy", "2026-01-08T00:00:00Z", [], None), ("q", 3, "d" * 40, "amy", "x", [rec("fix")], "timeout")]
    df = spark.createDataFrame(rows, f"repo string, seq bigint, sha string, author string, date_iso string, records array<{RECORD}>, error string").withColumn("ts", text.instant(F.col("date_iso")))
    assert tally.totals(df).first().asDict() == {"cap": 0, "fix": 0, "tend": 1, "cap_new": 1, "cap_deepened": 0, "cap_regressed": 0, "cap_removed": 1}
    assert {r["week"]: (r["cap"], r["tend"]) for r in tally.weekly(df).collect()} == {"2025-12-29": (1, 1), "2026-01-05": (-1, 0), "undated": (0, 0)}
    assert [(r["author"], r["total"]) for r in sorted(tally.top_authors(df, 2).collect(), key=lambda r: r["place"])] == [("amy", 2), ("cy", 0)]
    rep = tally.report(df, "r", "judge", "m", "90d")
    doc = rep.first().asDict(recursive=True)
    assert doc["complete"] is False and doc["judged"] + len(doc["failed"]) == doc["commits"] == 4
    assert [a["author"] for a in doc["authors"]] == ["amy", "cy", "bob"]
    assert '"ok":true' in tally.envelope(rep, "analyze").first()["json"]
    said = render.as_text(render.lines(doc))
    assert "incomplete: 1 commits" in said and "by author" in said and "− n" in said
    assert "<h1>r</h1>" in render.page(doc) and render.as_svg(render.lines(doc)).startswith("<svg") and "<pre>" in render.as_html(render.lines(doc))
    assert tally.totals(df.limit(0)).first()["cap"] == 0


def test_shared_cells():
    assert render.shared({"cap": 5, "fix": 5, "tend": 6}, 16) == [("cap", 5), ("fix", 5), ("tend", 6)]
    assert dict(render.shared({"cap": 100, "fix": 1, "tend": 1}, 3)) == {"cap": 1, "fix": 1, "tend": 1}
    assert render.shared({"cap": 0, "fix": -2, "tend": 0}, 4) == []
    assert render.escaped("a\x1b[31m\n") == "a\\x1b[31m\n"


DIFF = """diff --git a/old name.py b/new name.py
similarity index 90%
rename from old name.py
rename to new name.py
--- a/old name.py
+++ b/new name.py
@@ -1,3 +1,4 @@ def f():
 a
-b
+B
+c

@@ -10 +11 @@
-x
+ x
\\ No newline at end of file
diff --git a/pic.png b/pic.png
new file mode 100644
Binary files /dev/null and b/pic.png differ
diff --cc both.txt
index 1,2..3
@@@ -1,2 -1,2 +1,3 @@@
  one
++two
[diff truncated by tallyloom at 30 lines; 5 lines omitted]
"""


def test_diff_edges(spark):
    d = spark.createDataFrame([("s", DIFF), ("e", "")], "sha string, diff string")
    secs = diffparse.sections(d).orderBy("sec_no").collect()
    assert [(s["old_path"], s["new_path"], s["similarity"], s["rename_from"], s["new_file"], s["binary"], s["truncated"]) for s in secs] == [
        ("old name.py", "new name.py", 90, "old name.py", False, False, False), ("pic.png", "pic.png", None, None, True, True, False), ("both.txt", "both.txt", None, None, False, False, True)]
    hunks = diffparse.hunks(diffparse.sections(d))
    got = diffparse.lines(hunks).filter("sec_no = 0").orderBy("hunk_no", "line_no").collect()
    assert [(r["tag"], r["text"], r["old_line"], r["new_line"]) for r in got] == [(" ", "a", 1, 1), ("-", "b", 2, None), ("+", "B", None, 2), ("+", "c", None, 3), (" ", "", 3, 4), ("-", "x", 10, None), ("+", " x", None, 11), ("\\", " No newline at end of file", None, None)]
    assert [r["s"] for r in hunks.filter("sec_no = 0").orderBy("hunk_no").select(diffparse.survives_whitespace(F.col("body")).alias("s")).collect()] == [True, False]
    heads = diffparse.heads(hunks).filter("sec_no = 0").first()
    assert heads["before_head"] == ["a", "b", ""] and heads["after_head"] == ["a", "B", "c", ""]


def test_views_from_a_diff(spark):
    files = spark.createDataFrame([("s", 0, "new name.py", "renamed", 2, 1), ("s", 1, "pic.png", "added", 0, 0), ("s", 2, "releases/1.0/x.ts", "added", 1, 0), ("s", 3, "gone.ts", "deleted", 0, 9)], "sha string, file_no int, path string, status string, added int, removed int")
    secs = diffparse.sections(spark.createDataFrame([("s", DIFF)], "sha string, diff string"))
    v = {r["path"]: r for r in views.file_views(files, secs, diffparse.heads(diffparse.hunks(secs))).collect()}
    assert set(v) == {"new name.py", "pic.png", "gone.ts"}
    assert (v["new name.py"]["git"], v["new name.py"]["old_path"], v["new name.py"]["view_status"], v["new name.py"]["visible"]) == ("R", "old name.py", "renamed", True)
    assert v["pic.png"]["cls"] == "asset" and v["gone.ts"]["visible"] is False
    f = facts.facts(views.file_views(files, secs, None)).first()
    assert (f["product_files"], f["product_files_deleted"], f["edit_shape"], f["assets_changed"]) == (3, 1, "changes_existing_lines", True)


def test_multisets_against_counters(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), rng.choice(["before", "after"]), rng.choice("kl"), rng.choice("mn"), f"f{i}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "sha string, side string, kind string, name string, file string, ord int")
    got = delta.surplus(df, ["sha", "kind", "name"]).collect()
    for key in {(r[0], r[2], r[3]) for r in rows}:
        side = {s: [r[5] for r in rows if (r[0], r[2], r[3]) == key and r[1] == s] for s in ("before", "after")}
        more = len(side["after"]) - len(side["before"])
        want = side["after"][len(side["after"]) - more :] if more > 0 else side["before"][len(side["before"]) + more :] if more else []
        assert sorted(r["ord"] for r in got if (r["sha"], r["kind"], r["name"]) == key) == want
    c = delta.cancelled(df.withColumn("dir", F.when(F.col("side") == "after", "added").otherwise("removed")), ["sha", "kind", "name"]).collect()
    assert {r["ord"] for r in c} == {r["ord"] for r in got}  # dropping the first pairs leaves the last surplus


def test_declared_symbols(spark):
    rows = [("s", "f", "fn", "a", "plus", False, 0), ("s", "f", "fn", "a", "context", False, 1), ("s", "f", "fn", "b", "plus", False, 2), ("s", "f", "table", "t", "plus", True, 3), ("s", "f", "fn", "c", "minus", False, 4)]
    got = {(r["name"], r["dir"]) for r in delta.declared(spark.createDataFrame(rows, "sha string, file string, kind string, name string, side string, drop boolean, ord int")).collect()}
    assert got == {("b", "added"), ("t", "removed"), ("c", "removed")}


def test_names(spark):
    e = spark.createDataFrame([("a", "added", "export", "f", True, 0), ("a", "added", "command", "bin go", False, 1), ("b", "removed", "export", "g", False, 0)], "sha string, dir string, kind string, name string, public_entry boolean, ord int")
    ch = spark.createDataFrame([("a", "new"), ("b", "removed"), ("c", "new")], "sha string, change string")
    f = spark.createDataFrame([("b", "src/invoice-export/index.ts", True, 5, 1), ("b", "src/a.test.ts", True, 50, 1)], "sha string, path string, product boolean, added int, removed int")
    assert {r["sha"]: r["name"] for r in naming.named(ch, e, f).collect()} == {"a": "go command and 1 more", "b": "invoice export", "c": "capability"}


def _policy(rules, **more):
    q = [{"id": "n", "kind": "noul", "reads": [], "threshold": {"value": 0.7}}, {"id": "c", "kind": "choice", "options": {"x": "", "y": ""}, "no_match": "y", "reads": [], "threshold": {"value": 0.6}}, {"id": "s", "kind": "score", "criteria": [1, 2, 3], "reads": [], "threshold": {"value": 0.5}}]
    return policy.Policy([{"id": "d", "outcomes": ["yes", "no"], "default": "no"}], [{"id": "st", "questions": q}], {"d": rules}, **more)


def _decide(spark, rules, facts_="null as f, 3 as k", **answers):
    a = {"n": None, "c": None, "s": None} | answers
    parts = []
    for q, (kind, fields) in {"n": ("noul", "noul"), "c": ("choice", "choice"), "s": ("score", "score")}.items():
        if a[q] is not None:
            v = a[q]
            parts.append(f"'{q}', named_struct('type','{kind}','noul',{v if q == 'n' else 'null'},'choice',{repr(v[0]) if q == 'c' else 'null'},'score',{v[0] if q == 's' else 'null'},'confidence',{v[1] if q != 'n' else 'null'},'probabilities',{'map(' + repr(v[0]) + ',' + str(v[1]) + ')' if q == 'c' else 'null'})")
    row = spark.sql(f"select {facts_}, cast(map({','.join(parts)}) as map<string,{policy.ANSWER}>) as answers")
    return policy.decide(_policy(rules), row).first()["d"]


@pytest.mark.parametrize("condition, answers, fires", [
    ({"fact": "f", "eq": 1}, {}, False), ({"not": {"fact": "f", "eq": 1}}, {}, True), ({"fact": "k", "eq": "3"}, {}, False), ({"fact": "k", "in": [1, 3]}, {}, True), ({"fact": "k", "gte": 3, "lte": 3}, {}, True), ({"fact": "f", "present": False}, {}, True), ({"fact": "zz", "gte": 0}, {}, False),
    ({"all": []}, {}, True), ({"any": []}, {}, False), ({"q": "n", "is": "unasked"}, {}, True), ({"q": "n", "is": "unasked"}, {"n": 1.2}, True), ({"q": "n", "is": "yes"}, {"n": 0.7}, True), ({"q": "n", "is": "uncertain"}, {"n": 0.5}, True), ({"q": "n", "is": "no"}, {"n": 0.1}, True),
    ({"q": "c", "choice": "x"}, {"c": ("x", 0.6)}, True), ({"q": "c", "choice": "x"}, {"c": ("x", 0.5)}, False), ({"q": "c", "option": "x", "p_gte": 0.4}, {"c": ("x", 0.5)}, True), ({"q": "s", "score_gte": 1}, {"s": (1.0, 0.9)}, True), ({"q": "s", "score_gte": 1}, {"s": (1.0, 0.1)}, False), ({"q": "zz", "is": "unasked"}, {}, True),
])
def test_conditions(spark, condition, answers, fires):
    assert (_decide(spark, [{"id": "r", "if": condition, "then": "yes"}], **answers)["outcome"] == "yes") is fires


def test_rules_in_order_weights_and_provenance(spark):
    w = {"id": "w", "weighted": {"terms": [{"q": "n", "weight": 0.5}, {"q": "c", "option": "x", "weight": 0.5}, {"q": "s", "weight": 1}], "gte": 0.9}, "then": "escalate"}
    assert _decide(spark, [w], n=0.8, c=("x", 0.5), s=(1.0, 0.9))["by"] == "escalation"
    assert _decide(spark, [w], n=0.8, c=("x", 0.5))["by"] == "default"
    assert _decide(spark, [{"id": "a", "if": {"fact": "k", "gte": 9}, "then": "yes"}, {"id": "b", "if": {"fact": "k", "gte": 1}, "then": "yes"}])["rule"] == "b"
    with pytest.raises(ValueError):
        _policy([], thresholds={"n": 2})


def test_replies_asked_by_stage_and_never_made_up(spark):
    p = policy.Policy.load(fact_queries.POLICY)
    rows = spark.sql(f"select 'a' sha, 'f' files, 'd' product_diff, 'b' boundary_delta, 1 product_files, false snapshot_only, cast(map() as map<string,{policy.ANSWER}>) answers, cast(null as string) error union all select 'b','f2','d2','b2',1,false,cast(map() as map<string,{policy.ANSWER}>),null union all select 'c','f','d','b',0,false,cast(map() as map<string,{policy.ANSWER}>),null")
    said = lambda **x: "named_struct(" + ",".join(f"'{k}',{x.get(k, 'null')}" for k in ("type", "noul", "choice", "score", "confidence", "probabilities")) + ")"
    answers = f"map('repairs',{said(type=repr('noul'), noul='0.9D')},'gain',{said(type=repr('choice'), choice=repr('none'), confidence='0.9D')},'reach',{said(type=repr('score'), score='1D', confidence='0.9D')})"
    state = spark.sql("select 'b' boundary_delta, 'f' files, 'd' product_diff").select(replies.request_key("survey", F.struct("boundary_delta", "files", "product_diff")).alias("request_key"))
    recorded = state.select("request_key", F.expr(answers).cast(f"map<string,{policy.ANSWER}>").alias("answers"), F.lit("m").alias("model"), F.lit(5).cast("bigint").alias("input_tokens"), F.lit(1).cast("bigint").alias("output_tokens"))
    got = {r["sha"]: r for r in replies.ask(p, rows, recorded, {}).collect()}
    assert got["a"]["error"] is None and got["a"]["calls"] == 1 and got["a"]["answers"]["repairs"]["noul"] == 0.9
    assert got["b"]["error"] == "no recorded reply for stage survey" and got["c"]["calls"] == 0


def test_cache(spark, tmp_path):
    results = spark.createDataFrame([("a", [("fix", None, None, "s")], None), ("b", [], "bad")], f"sha string, records array<{RECORD}>, error string")
    replies.to_cache(results, f"{tmp_path}/c", "k1")
    spark.createDataFrame([("z", "not json", "k1")], "sha string, body string, cache_key string").write.mode("append").partitionBy("cache_key").parquet(f"{tmp_path}/c")
    cache, commits = spark.read.parquet(f"{tmp_path}/c"), spark.createDataFrame([("a",), ("b",), ("z",)], "sha string")
    assert [r["sha"] for r in replies.cached(commits, cache, "k1").collect()] == ["a"]
    assert replies.misses(commits, cache, "k2").count() == 3


TOKEN = "gh" + "p_" + "a1B2c3D4e5" * 4


@pytest.mark.parametrize("given, want, n", [
    (f"x {TOKEN} y", "x [REDACTED] y", 1), ("bypass = hunter2", "bypass = hunter2", 0), ("db_password=hunter2 x!", "db_password=[REDACTED]", 1), ('password: "a \\" b" end', 'password: "[REDACTED]" end', 1), ("pwd == x", "pwd == x", 0),
    ("https://u:secretpw@host", "https://u:[REDACTED]@host", 1), ("api_key = 'abcdefghijkl'", "api_key = '[REDACTED]'", 1), ("authHeader = buildHeader(abcdefgh)", "authHeader = buildHeader(abcdefgh)", 0), ("TOKEN=abcdefghijk1", "TOKEN=[REDACTED]", 1),
    ("-----BEGIN RSA PRIVATE" + " KEY-----\nabc", "[REDACTED]", 1), ("pass: a, user: b", "pass: [REDACTED], user: b", 1),
])
def test_redaction(spark, given, want, n):
    df = spark.createDataFrame([(given,)], "t string")
    r = redact.redact(df, "t").first()
    assert (r["t"], r["redactions"]) == (want, n)
    again = redact.redact(redact.redact(df, "t").drop("redactions"), "t").first()
    assert again["t"] == want


def test_second_pass_leaves_no_shape(spark):
    bare = "aB3" * 12
    df = spark.createDataFrame([(f"x {TOKEN} {bare} {'0a' * 20} k",), (None,)], "t string")
    rows = [r["t"] for r in redact.redact_values(df, "t").collect()]
    assert rows == [f"x [REDACTED] [REDACTED] {'0a' * 20} k", None]
    assert df.select(redact.has_shape(F.col("t")).alias("s")).first()["s"] is True


def test_password_values_of_each_form_and_long_ones(spark):
    m = "[REDACTED]"
    long = "password=" + "a b, c; " * 100_000 + "\nnext"
    cases = [
        ("passphrase='x' compass='y'", f"passphrase='{m}' compass='y'", 1), ("my_pwd: two words, user: bob", f"my_pwd: {m}, user: bob", 1), ("password == x", "password == x", 0),
        ('{\\"password\\":\\"a\\\\\\"b\\"}', f'{{\\"password\\":\\"{m}\\"}}', 1), ("pass=`a'b\"`", f"pass=`{m}`", 1), ("password=\"\" pwd=''", "password=\"\" pwd=''", 0),
        (f"password={m}, pwd=x", f"password={m}, pwd={m}", 1), ("PASSWORD='a\\'b'\nk", f"PASSWORD='{m}'\nk", 1), (long, f"password={m}\nnext", 1), ("password" + " " * 200_000 + "=x", "password" + " " * 200_000 + f"={m}", 1), (None, None, 0),
    ]
    df = spark.createDataFrame([(i, t, 7) for i, (t, _, _) in enumerate(cases)], "i int, t string, gates int")
    out = {r["i"]: r for r in redact.redact(df, "t").collect()}
    assert [(out[i]["t"], out[i]["redactions"]) for i in range(len(cases))] == [(w, n) for _, w, n in cases]
    assert redact.redact_values(df, "t").columns == df.columns
