"""The words of the URL rules as their contract lists them, on hosts and paths that each rule alone decides."""

import re

from tallyloom.llm import urls

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
CASES = (
    ("http://shop.com/en/1", "com/en/", "block"), ("http://a.example.com/en/71", "example.com/en/7", "allow"), ("http://example.com/en/6", "com/en/", "block"),
    ("http://net/de/", "net/de/", "allow"), ("http://spam.net/de/8", "net/de/", "allow"), ("http://a.example.net/de/7", "net/de/", "allow"),
    ("http://example.net/de/8", "example.net/de/8", "block"), ("http://b.Example.NET/de/85?q", "example.net/de/8", "block"), ("http://x.org/es/#f", "org/es/", "block"),
)


def test_each_rule_has_the_word_of_the_contract():
    assert [f"{v} {h}{p}" for v, h, p in urls.RULES] == CONTRACT.split(", ")


def test_the_verdict_is_that_of_the_longest_rule(spark):
    out = urls.judge(spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(CASES)], "page_id long, url string")).collect()
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in out) == [(i, rule, word) for i, (_, rule, word) in enumerate(CASES)]


def test_mined_rules_still_block_what_no_rule_decides(spark):
    """As many blocked pages of one host, and one of its pages that no rule fits."""
    made = [f"http://spam.org/es/{i}" for i in range(40)] + [f"http://good{i}.net/de/{i}" for i in range(40)] + [f"http://h{i}.org/fr/{i}" for i in range(180)] + ["http://spam.org/fr/1"]
    out = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")).collect()
    assert [re.sub("^.*//", "", made[r["page_id"]]) for r in out if r["rule"] is None and r["verdict"] == "block"] == ["spam.org/fr/1"]
    assert {r["verdict"] for r in out if r["rule"] == "net/de/"} == {"allow"}
