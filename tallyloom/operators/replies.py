"""Recorded replies: parsing and checking records and answers, asking by stage, labels, and the cache of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import CHANGES, KINDS, RECORD
from . import policy
from .tally import one_per_kind

# The form of a labelled line.
LABEL = r"^- \[([a-z]+)(?::([a-z]+))?\] ?(.*)\z"


def record_problem(r: Column) -> Column:
    """What is wrong with a record, null if nothing: kinds, changes, and a name only for capabilities."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return (
        F.when(~F.coalesce(r["kind"].isin(*KINDS), F.lit(False)), "kind must be cap, fix or tend").when(blank(r["summary"]), "a summary is missing")
        .when((r["kind"] == "cap") & ~F.coalesce(r["change"].isin(*CHANGES), F.lit(False)), "a cap needs a change").when((r["kind"] == "cap") & blank(r["name"]), "a cap needs a name")
        .when((r["kind"] != "cap") & r["change"].isNotNull(), "only a cap has a change")
    )


def parsed(reply: Column, key: str = "records") -> Column:
    """struct(records, error) of a model's reply: a fence around the JSON goes, each record is checked, one record of a kind stays."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```\z", "")
    rows = F.from_json(bare, f"struct<{key}:array<{RECORD}>>")[key]
    problems = F.filter(F.transform(rows, lambda r, i: F.concat(F.lit("record "), i.cast("string"), F.lit(": "), record_problem(r))), lambda p: p.isNotNull())
    error = F.when(rows.isNull(), "no JSON").otherwise(F.try_element_at(problems, F.lit(1)))
    return F.struct(F.when(error.isNull(), one_per_kind(rows)).otherwise(F.array().cast(f"array<{RECORD}>")).alias("records"), error.alias("error"))


def label(line: Column) -> Column:
    """struct(kind, change, text, problem) of a labelled line; null for other lines."""
    kind, change, text = (F.regexp_extract(line, LABEL, i) for i in (1, 2, 3))
    problem = F.when(~kind.isin(*KINDS), "unknown kind").when((kind == "cap") & ~change.isin(*CHANGES), "a cap needs a change").when((kind != "cap") & (change != ""), "only a cap has a change").when(F.trim(text) == "", "no text")
    good = problem.isNull()
    return F.when(line.rlike(LABEL), F.struct(F.when(good, kind).alias("kind"), F.when(good & (change != ""), change).alias("change"), F.when(good, F.trim(text)).alias("text"), problem.alias("problem")))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """line, kind, change, text, problem of a text file of labelled lines."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "l"))
    return rows.select((F.col("line") + 1).alias("line"), label(F.rtrim(F.col("l"))).alias("e")).filter("e is not null").select("line", "e.*")


def answer_problem(a: Column, kind: str, options: list[str] | None = None, levels: int | None = None) -> Column:
    """What is wrong with an answer, null if nothing."""
    share = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    wrong = F.when(a.isNull(), "missing").when(F.coalesce(a["type"] != kind, F.lit(True)), "wrong type")
    if kind == "noul":
        return wrong.when(~share(a["noul"]), "no probability")
    wrong = wrong.when(~share(a["confidence"]), "no confidence").when(F.exists(F.map_values(F.coalesce(a["probabilities"], F.create_map().cast("map<string,double>"))), lambda p: ~share(p)), "no probability")
    if kind == "choice":
        return wrong.when(~F.coalesce(a["choice"].isin(*(options or [])), F.lit(False)), "unknown option")
    return wrong.when(~F.coalesce(a["score"].between(0, (levels or 1) - 1), F.lit(False)), "score out of range")


def request_key(stage: str, state: Column) -> Column:
    """The digest of what is asked: the stage and the fields it reads."""
    return F.sha2(F.concat_ws("\x00", F.lit(stage), F.to_json(state)), 256)


def wire_questions(questions: list[dict]) -> dict[str, dict]:
    """A stage's questions as a judge is asked them: type, instructions and what to choose from or score by."""
    choices = {"choice": "options", "score": "criteria", "noul": "criteria"}
    made = {q["id"]: {"type": q["kind"], "instructions": q.get("instructions", ""), "criteria": q.get(choices[q["kind"]])} for q in questions}
    return {k: {n: v for n, v in q.items() if v is not None} for k, q in made.items()}


def wait_seconds(attempt: int, base: float = 0.5, most: float = 20.0, retry_after: float | None = None, share: float = 1.0) -> float:
    """How long to wait before retry ``attempt`` (from 1): what the server asked for, else doubling from ``base``; ``most`` at most.

    ``share`` (0 to 1, a random number) scatters many callers over the wait.
    """
    asked = retry_after if retry_after is not None and retry_after >= 0 else base * 2 ** (attempt - 1)
    return min(most, asked) * share


def ask(p: policy.Policy, rows: DataFrame, recorded: DataFrame, fields: dict[str, int]) -> DataFrame:
    """``rows`` (facts, state fields, ``answers``, ``error``) after all stages, asked in order where their gate holds.

    ``recorded``: request_key, answers (map), model, input_tokens, output_tokens. A missing reply or a bad answer is the commit's error;
    nothing is made up. One join a stage, and only rows whose gate holds take part, so what is settled by facts costs no request.
    """
    if "calls" not in rows.columns:
        rows = rows.withColumns({"calls": F.lit(0), "model": F.lit(None).cast("string"), "input_tokens": F.lit(0).cast("bigint"), "output_tokens": F.lit(0).cast("bigint")})
    secret = F.coalesce("secret_shape_remaining", F.lit(False)) if "secret_shape_remaining" in rows.columns else F.lit(False)
    for s in p.stages:
        reads = sorted({f for q in s["questions"] for f in q["reads"]})
        state = F.struct(*(F.substring(F.col(f), 1, fields.get(f, 2400)).alias(f) for f in reads))
        on = F.col("error").isNull() & policy.gate(p, s["id"], rows)
        # What isn't asked gets a key of its own that no reply has, so that it spreads over all partitions of the join.
        asked = rows.withColumns({"_on": on, "_k": F.when(on, request_key(s["id"], state)).otherwise(F.concat(F.lit("-"), F.col("sha").cast("string")))})
        got = recorded.select(F.col("request_key").alias("_k"), F.col("answers").alias("_a"), F.col("model").alias("_m"), F.col("input_tokens").alias("_i"), F.col("output_tokens").alias("_o"))
        joined = asked.join(got, "_k", "left")
        bad = F.lit(None).cast("string")
        for q in reversed(s["questions"]):
            said = answer_problem(F.try_element_at(F.col("_a"), F.lit(q["id"])), q["kind"], list(q.get("options", ())), len(q.get("criteria", ())))
            bad = F.when(said.isNotNull(), F.concat(F.lit(f"{q['id']}: "), said)).otherwise(bad)
        asked_it = F.col("_on")
        error = F.when(asked_it & secret, "not asked: the state still holds the shape of a secret").when(asked_it & F.col("_a").isNull(), F.lit(f"no recorded reply for stage {s['id']}")).when(asked_it, bad)
        keys = [q["id"] for q in s["questions"]]
        fresh = F.map_filter(F.coalesce("_a", F.create_map().cast(f"map<string,{policy.ANSWER}>")), lambda k, v: k.isin(*keys))
        rows = joined.withColumns({
            "error": F.coalesce("error", error), "answers": F.when(asked_it & error.isNull(), F.map_concat("answers", fresh)).otherwise(F.col("answers")), "calls": F.col("calls") + (asked_it & ~secret).cast("int"),
            "model": F.coalesce("model", F.when(~secret, F.col("_m"))), "input_tokens": F.col("input_tokens") + F.when(secret, 0).otherwise(F.coalesce("_i", F.lit(0))), "output_tokens": F.col("output_tokens") + F.when(secret, 0).otherwise(F.coalesce("_o", F.lit(0))),
        }).drop("_on", "_k", "_a", "_m", "_i", "_o")
    return rows


def entries(cache: DataFrame, key: str) -> DataFrame:
    """sha, records of what is cached under ``key``; an entry that is no list of records is no entry."""
    return cache.filter(F.col("cache_key") == key).select("sha", F.from_json("body", f"array<{RECORD}>").alias("records")).filter("records is not null")


def misses(commits: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Commits without a cached result under ``key``; those whose entry is broken are among them."""
    return commits.join(entries(cache, key).select("sha"), "sha", "left_anti")


def cached(commits: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Commits with their cached records."""
    return commits.join(entries(cache, key).dropDuplicates(["sha"]), "sha")


def without_broken(cache: DataFrame, key: str) -> DataFrame:
    """The cache without the broken entries of ``key``; what is to be written where these shall be gone."""
    broken = (F.col("cache_key") == key) & F.from_json("body", f"array<{RECORD}>").isNull()
    return cache.filter(~F.coalesce(broken, F.lit(False)))


def to_cache(results: DataFrame, path: str, key: str) -> None:
    """Append the results without an error under ``key``; a failed write leaves nothing behind."""
    results.filter("error is null").select("sha", F.to_json("records").alias("body"), F.lit(key).alias("cache_key")).write.mode("append").partitionBy("cache_key").parquet(path)
