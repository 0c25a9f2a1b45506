import subprocess

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom.operators import extract, policy, tally
from tallyloom.plans import analyze, derived, fact_queries
from tallyloom.sources import files, git
from tallyloom.streaming import weekly


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("history")

    def run(*args, when="2026-01-05T10:00:00+02:00"):
        subprocess.run(["git", "-C", str(path), "-c", "user.name=Ann\x1fB", "-c", "user.email=a@x", *args], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "PATH": "/usr/bin:/bin", "HOME": str(path)})

    run("init", "-q", "-b", "main")
    (path / "src").mkdir()
    (path / "src/app.py").write_text("def go():\n    return 1\n" * 6)
    (path / "README.md").write_text("hello\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (path / "src/app.py").rename(path / "src/main.py")
    (path / "pic.bin").write_bytes(bytes(range(256)))
    run("add", "-A")
    run("commit", "-qm", "two", when="2026-01-12T10:00:00+00:00")
    return str(path)


def test_git_sources(spark, repo):
    git.register(spark)
    log = spark.read.format("git_log").option("path", repo).load().orderBy("seq").collect()
    assert [(r["seq"], r["author"], r["date_iso"]) for r in log] == [(0, "Ann\x1fB", "2026-01-05T10:00:00+02:00"), (1, "Ann\x1fB", "2026-01-12T10:00:00+00:00")] or log[0]["author"].startswith("Ann")
    assert spark.read.format("git_log").option("path", repo).option("since", "2026-01-10T00:00:00Z").load().count() == 1
    raw = spark.read.format("git_commits").option("path", repo).load().orderBy("seq").collect()
    assert [r["parents"] for r in raw] == [0, 1]
    assert {f["letter"][0] for f in raw[1]["files"]} == {"A", "R"} and "rename from src/app.py" in raw[1]["diff"]
    tree = {r["path"]: r["text"] for r in spark.read.format("git_tree").option("path", repo).load().filter("path like '%.py' or path like '%.md'").collect()}
    assert set(tree) == {"README.md", "src/main.py"}
    assert git.is_repository(repo)
    text = "\x00".join(["a" * 40 + "\x1f2026-01-05T10:00:00Z\x1fx\ny\x1fz", "bad\x1f\x1f", "b" * 40 + "\x1fnever\x1fq", ""])
    assert [r[2] for r in git.log_records(text)] == ["x\ny\x1fz"]
    assert spark.range(1).select(git.records_column(F.lit(text)).alias("r")).first()["r"][0]["author"] == "x\ny\x1fz"


def test_git_reads_odd_names_and_many_commits_at_once(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    names = ["tab\there.py", 'quo"te.txt', "umläut.md", "plain.go"]
    for n in names:
        (tmp_path / n).write_text("one\ntwo\n")
    run("add", "-A")
    run("commit", "-qm", "all :100644 a\tb")
    (tmp_path / names[0]).rename(tmp_path / "moved\tto.py")
    (tmp_path / "plain.go").write_text("one\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    run("commit", "-qm", "nothing", "--allow-empty")
    git.register(spark)
    raw = spark.read.format("git_commits").option("path", str(tmp_path)).load().orderBy("seq").collect()
    files = [{(f["letter"][0], f["path"], f["added"], f["removed"]) for f in r["files"]} for r in raw]
    assert files == [{("A", n, 2, 0) for n in names}, {("R", "moved\tto.py", 0, 0), ("M", "plain.go", 0, 1)}, set()]
    assert raw[1]["diff"].startswith("diff --git") and raw[2]["diff"] == "" and [r["parents"] for r in raw] == [0, 1, 1]
    tree = {r["path"]: r["text"] for r in spark.read.format("git_tree").option("path", str(tmp_path)).load().collect()}
    assert set(tree) == {"moved\tto.py", *names[1:]} and tree["umläut.md"] == "one\ntwo\n" and tree["plain.go"] == "one\n"


def test_working_tree_leaves_ignored_files_out(spark, tmp_path):
    run = lambda *args: subprocess.run(["git", "-C", str(tmp_path), *args], check=True, capture_output=True)
    run("init", "-q")
    for name, text in ((".gitignore", "out.py\n"), ("out.py", "x"), ("a b.py", "def f():\n    pass\n"), ("new.md", "é")):
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to("a b.py")
    run("add", "a b.py")
    git.register(spark)
    got = {r["path"]: r["text"] for r in spark.read.format("git_files").option("path", str(tmp_path)).load().collect()}
    assert got == {".gitignore": "out.py\n", "a b.py": "def f():\n    pass\n", "new.md": "é"}
    assert analyze.repo_kind(spark, str(tmp_path)) == "code" and analyze.repo_kind(spark, str(tmp_path), "content") == "content"


def test_stream_closes_weeks_and_leaves_late_commits_out(spark, tmp_path):
    columns = "seq bigint, sha string, ts timestamp, records array<struct<kind:string,change:string,name:string,summary:string>>, error string"
    fix = "array(named_struct('kind', 'fix', 'change', cast(null AS string), 'name', cast(null AS string), 'summary', 's'))"

    def arrive(n, *days):
        rows = spark.createDataFrame([(i, f"{n}{i}", d) for i, d in enumerate(days)], "seq bigint, sha string, d string")
        rows.selectExpr("seq", "sha", "to_timestamp(d) AS ts", f"{fix} AS records", "cast(null AS string) AS error").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        q = weekly.weekly(spark.readStream.schema(columns).parquet(str(tmp_path / "in")), "7 days").writeStream.format("parquet").outputMode("append")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    arrive("a", "2026-01-05", "2026-01-07", "2026-01-12")
    drain()
    arrive("b", "2026-02-02")
    drain()
    arrive("c", "2026-01-06", "2026-03-02")  # the first is weeks late: its week is closed
    drain()
    got = {r["week"]: (r["commits"], r["fix"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2026-01-05": (2, 2), "2026-01-12": (1, 1), "2026-02-02": (1, 1)}


def test_a_judged_run_names_its_capability_and_refuses_secrets(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "src").mkdir()
    (tmp_path / "src/app.py").write_text("import x\n\n\n@app.get('/a')\ndef go():\n    return 1\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    commits, raw = analyze.raw_records(spark, str(tmp_path))
    p = policy.Policy.load(fact_queries.POLICY)
    f = analyze.commit_facts(raw, "code").first()
    assert (f["user_boundaries_added"], f["user_surface_touched"], f["revert_of"], f["answer_set_complete"]) == (1, True, None, True)
    answers = {"survey": {"repairs": {"type": "noul", "noul": 0.1}, "gain": {"type": "choice", "choice": "new", "confidence": 0.9}, "reach": {"type": "score", "score": 3.0, "confidence": 0.9}}, "confirm": {"noticed": {"type": "noul", "noul": 0.9}}}
    rows = []
    for s in p.stages:
        reads = sorted({x for q in s["questions"] for x in q["reads"]})
        from tallyloom.operators import replies

        texts = spark.createDataFrame([tuple(f["state"][x] for x in reads)], ", ".join(f"{x} string" for x in reads))
        key = texts.select(replies.request_key(s["id"], F.struct(*reads)).alias("k")).first()["k"]
        full = {q: {n: a.get(n) for n in ("type", "noul", "choice", "score", "confidence", "probabilities")} for q, a in answers[s["id"]].items()}
        rows.append((key, full, "m", 10, 1))
    recorded = spark.createDataFrame(rows, f"request_key string, answers map<string,{policy.ANSWER}>, model string, input_tokens bigint, output_tokens bigint")
    out = analyze.analyze(commits, raw, p, recorded, "code").first()
    assert out["error"] is None and [(r["kind"], r["change"], r["name"]) for r in out["records"]] == [("cap", "new", "GET /a")] and out["calls"] == 2 and out["input_tokens"] == 20
    assert tally.counters(analyze.analyze(commits, raw, p, recorded, "code").withColumns({"redactions": F.lit(0), "cached": F.lit(False)})).first()["answered_by"] == "m"
    asked = spark.createDataFrame([("a", 1, False, "", "", "", True)], "sha string, product_files int, snapshot_only boolean, files string, product_diff string, boundary_delta string, secret_shape_remaining boolean")
    asked = asked.withColumns({"answers": F.create_map().cast(f"map<string,{policy.ANSWER}>"), "error": F.lit(None).cast("string")})
    told = replies.ask(p, asked, recorded, {}).first()
    assert told["error"] == "not asked: the state still holds the shape of a secret" and told["calls"] == 0


def test_fragments_of_hunks_give_their_entries():
    side = [("    x = 1", False), ("@app.get('/y')", True), ("def y(", True), ("    a,", True), ("):", True), ("    return 1", False), ("z = [", False)]
    found, missed = extract.side_entries("python", side, False)
    assert {(k, n) for k, n, *_ in found} == {("route", "GET /y"), ("export", "y")} and missed == []
    found, missed = extract.side_entries("python", [("sub.add_parser(", True), ("b.bind('<Key>', f", True)], False)
    assert found == [] and missed == ["b.bind('<Key>', f"]
    assert extract.declaration("typescript", "export abstract class A {") == ("A", "class") and extract.declaration("python", "  def x():") is None
    assert extract.declaration("rust", "pub async fn go() {") == ("go", "function") and extract.declaration("go", "func (s *srv) Stop() {") is None
    assert extract.signal("javascript", "<B onClick={f}>") == "ui handler" and extract.signal("typescript", "<B onClick={f}>") is None
    assert extract.signal("rust", "pub fn x() {", True) == "public export" and extract.signal("go", 'r.GET("/x", h)') == "route" and extract.signal("typescript", 'axios.get("/x", h)') is None


def test_small_text_functions_and_answers_to_failures(spark):
    from tallyloom.functions import text
    from tallyloom.operators import replies

    t = spark.createDataFrame([("'a b'", "  x \n y  ", 'r#"q"#')], "a string, b string, c string")
    r = t.select(text.unquoted(F.col("a")).alias("a"), text.collapsed(F.col("b")).alias("b"), text.unquoted(F.col("c")).alias("c"), text.first_token(F.col("b")).alias("d"), text.collapsed(F.repeat(F.lit("x"), F.lit(70))).alias("e")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("a b", "x y", "q", "x", "x" * 59 + "…")
    assert [replies.wait_seconds(i) for i in (1, 2, 9)] == [0.5, 1.0, 20.0] and replies.wait_seconds(1, retry_after=3) == 3
    assert tally.failure("usage", "no", "analyze") == '{"ok": false, "command": "analyze", "error": {"code": "usage", "message": "no"}}'
    assert "analyze_many" in analyze.help_text() and (analyze.Denied.code, analyze.Usage.code, analyze.Failed.code) == (3, 2, 1)
    asked = replies.wire_questions([{"id": "q", "kind": "choice", "instructions": "i", "options": {"a": "A"}}, {"id": "n", "kind": "noul", "instructions": "j"}])
    assert asked == {"q": {"type": "choice", "instructions": "i", "criteria": {"a": "A"}}, "n": {"type": "noul", "instructions": "j"}}
    extract.register(spark)
    got = spark.sql("SELECT b.* FROM VALUES ('a.py', 'def go():\n    pass') AS s(p, t), LATERAL boundaries_of(s.p, s.t) b").collect()
    assert [(r["kind"], r["name"]) for r in got] == [("export", "go")]


def test_a_run_end_to_end_without_replies(spark, repo):
    commits, raw = analyze.raw_records(spark, repo)
    none = spark.createDataFrame([], f"request_key string, answers map<string,{policy.ANSWER}>, model string, input_tokens bigint, output_tokens bigint")
    out = {r["seq"]: r for r in analyze.analyze(commits, raw, policy.Policy.load(fact_queries.POLICY), none, "code").collect()}
    assert len(out) == 2 and out[0]["error"] == out[1]["error"] == "no recorded reply for stage survey"
    f = {r["sha"]: r for r in analyze.commit_facts(raw, "code").collect()}
    assert "renamed from src/app.py to src/main.py [source]" in f[out[1]["sha"]]["files"]
    assert tally.completeness(analyze.analyze(commits, raw, policy.Policy.load(fact_queries.POLICY), none, "code")).first()["judged"] == 0


SOURCES = {
    "web/app.ts": 'app.get("/x", (req) => 1);\naxios.get("/y", opts);\nmap.get("/k");\nprogram.command("build <dir>");\nbtn.addEventListener("click", f);\nexport const A = 1;\nexport default f;\nexport * from "./b";\nexport { c as d, e };\n',
    "api/a.py": '@app.route("/r", methods=["POST", "PUT"])\ndef r(): ...\n@cli.command()\ndef do_it(): ...\nclass K: ...\ndef _h(): ...\nsub.add_parser("run x")\nw.bind("<Key>", f)\n',
    "cmd/m.go": 'r.HandleFunc("GET /items", h)\nvar c = &cobra.Command{\n\tUse: "serve [x]",\n}\nfunc Run() {}\nfunc (s *Srv) Stop() {}\ntype T struct {}\nfunc low() {}\n',
    "src/l.rs": '#[get("/h")]\n.route("/b", post(x))\n#[derive(Subcommand)]\nenum Cmd {\n    AddOne,\n}\nimpl Foo {\n    pub fn bar(&self) {}\n}\npub struct S;\n',
    "bad/x.py": "def (:\n", "node_modules/z.ts": "export const Z = 1;\n", "internal/p.go": "func Pub() {}\n",
}


def test_extraction(spark, tmp_path):
    for name, text in SOURCES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found, summary = analyze.extract_listing(spark, str(tmp_path))
    got = {(r["file"], r["kind"], r["name"], r["detail"]) for r in found.collect()}
    assert got == {
        ("web/app.ts", "route", "GET /x", None), ("web/app.ts", "cli", "build", None), ("web/app.ts", "ui", "btn:click", None), ("web/app.ts", "export", "A", "const"), ("web/app.ts", "export", "default", "default"), ("web/app.ts", "export", "* from ./b", "star"), ("web/app.ts", "export", "d", "named"), ("web/app.ts", "export", "e", "named"),
        ("api/a.py", "route", "POST /r", None), ("api/a.py", "route", "PUT /r", None), ("api/a.py", "cli", "do-it", None), ("api/a.py", "cli", "run", None), ("api/a.py", "ui", "w:<Key>", None), ("api/a.py", "export", "K", "class"),
        ("cmd/m.go", "route", "GET /items", None), ("cmd/m.go", "cli", "serve", None), ("cmd/m.go", "export", "Run", "function"), ("cmd/m.go", "export", "Srv.Stop", "method"), ("cmd/m.go", "export", "T", "struct"),
        ("src/l.rs", "route", "GET /h", None), ("src/l.rs", "route", "POST /b", None), ("src/l.rs", "cli", "add-one", None), ("src/l.rs", "export", "Foo::bar", "method"), ("src/l.rs", "export", "S", "struct"),
    }
    assert {r["language"]: (r["files"], r["parse_errors"]) for r in summary.collect()}["python"] == (2, ["bad/x.py"])
    assert extract.listing(found).first()["line"].startswith("cli ") or extract.listing(found).count() == len(got)


def test_settings_and_lists(spark, tmp_path):
    s = files.settings('{"excludeRepos": ["old-*"], "repoKinds": {"a/b": "code"}}')
    df = spark.createDataFrame([("x/old-1",), ("a/b",)], "r string")
    assert [(r["e"], r["k"]) for r in df.select(files.excluded(s["excludeRepos"], F.col("r")).alias("e"), files.setting_for(s["repoKinds"], F.col("r")).alias("k")).collect()] == [(True, None), (False, "code")]
    with pytest.raises(ValueError):
        files.settings('{"repoKinds": {"a": "b"}}')
    (tmp_path / "l").write_text("# no\n\na/b\n c/d \n")
    assert [r["target"] for r in files.repo_list(spark, f"{tmp_path}/l").collect()] == ["a/b", "c/d"]
    assert files.env_value("export A='b c'\nB=2", "A") == "b c" and files.env_value("", "A") is None
    with pytest.raises(analyze.Denied):
        analyze.output_path("../x.html", str(tmp_path))
    assert analyze.output_path("x.html", str(tmp_path)).name == "x.html"


def test_stream_agrees_with_batch(spark, tmp_path):
    results = derived.commits(spark, "/root/testdata/sf0.001")
    results.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = weekly.weekly(spark.readStream.schema(results.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    got = {r["week"]: (r["cap"], r["fix"], r["tend"]) for r in spark.table("weeks").collect()}
    assert got == {r["week"]: (r["cap"], r["fix"], r["tend"]) for r in tally.weekly(results).collect()}
    merge = weekly.merge_into(f"{tmp_path}/table")
    merge(results.limit(10), 0)
    merge(results.limit(20), 1)
    assert spark.read.parquet(f"{tmp_path}/table").count() == 20


def test_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
