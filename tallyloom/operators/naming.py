"""Names of capabilities, by what a commit changed at its boundary or else by its most changed product path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import is_test_path, path_words
from .delta import KIND_ORDER


def entry_name(kind: Column, name: Column) -> Column:
    return F.when(kind == "command", F.concat(F.regexp_replace(name, "^bin ", ""), F.lit(" command"))).when(kind == "ui handler", F.concat(F.regexp_replace(name, ":", " "), F.lit(" handler"))).when(kind == "export", F.concat(F.lit("export "), name)).otherwise(name)


def from_entries(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """sha, name from ``changes`` (sha, change) and ``entries`` (sha, dir, kind, name, public_entry, ord).

    Gains are named for what was added, losses for what went; where there is none of those, for any. Module exports don't count.
    """
    want = F.when(F.col("change").isin("new", "deepened"), "added").otherwise("removed")
    pool = changes.join(entries.filter((F.col("kind") != "export") | F.col("public_entry")), "sha").withColumn("_want", F.col("dir") == want)
    by = Window.partitionBy("sha")
    pool = pool.withColumn("_any", F.max("_want").over(by)).filter("_want or not _any")
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    top = pool.groupBy("sha").agg(F.min_by(F.struct("kind", "name"), F.struct(rank.alias("r"), F.col("ord"))).alias("t"), (F.count("*") - 1).alias("more"))
    named = entry_name(F.col("t.kind"), F.col("t.name"))
    return top.select("sha", F.when(F.col("more") > 0, F.concat(named, F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(named).alias("name"))


def from_paths(files: DataFrame) -> DataFrame:
    """sha, name from ``files`` (sha, path, product, added, removed): the most changed product path in words, a test only where nothing else is."""
    by = Window.partitionBy("sha")
    f = files.withColumn("_p", F.max("product").over(by)).filter("product or not _p").withColumn("_test", is_test_path(F.col("path")))
    f = f.withColumn("_all", F.min("_test").over(by)).filter("_all or not _test")
    top = f.groupBy("sha").agg(F.min_by("path", F.struct((-(F.col("added") + F.col("removed"))).alias("n"), F.col("path"))).alias("path"))
    return top.select("sha", path_words(F.col("path")).alias("name"))


def named(changes: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """sha, name for every row of ``changes``."""
    e, p = from_entries(changes, entries), from_paths(files).withColumnRenamed("name", "path_name")
    return changes.join(e, "sha", "left").join(p, "sha", "left").select("sha", F.coalesce("name", "path_name", F.lit("capability")).alias("name"))
