"""The typed row of facts of a commit, in one aggregation by commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths

# Limits behind facts.
CREATED_LIMIT, DELETION_LINES, DELETION_RATIO = 4000, 15, 2
SCHEMA_DIRS = ("migrations", "migration", "migrate")
TABLE = r"(?i)\bcreate\s+(?:virtual\s+)?table\b"
DIFF_CAP = 6000


def _n(c: Column) -> Column:
    return F.count_if(c)


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def _every(of: Column, c: Column) -> Column:
    """At least one, and ``c`` for all of them."""
    return F.coalesce(F.bool_or(of) & F.bool_and(~of | c), F.lit(False))


def facts(views: DataFrame) -> DataFrame:
    """One row for each commit of ``file_views``, every fact that follows from the views alone."""
    c = F.col
    product = c("cls").isin(*paths.PRODUCT)
    src_product = F.coalesce(c("src_cls").isin(*paths.PRODUCT), F.lit(False))
    # Over the partitions that the aggregation by commit needs anyway, so the views are made once.
    v = views.withColumn("_gone", F.collect_set(F.when(c("git") == "D", c("path"))).over(Window.partitionBy("sha")))
    copied = (c("git") == "C") & (F.coalesce("similarity", F.lit(0)) < 100) & ~F.coalesce(F.array_contains("_gone", c("old_path")), F.lit(False))
    arrived = c("view_status").isin("added", "published") | copied
    item_in, item_out = c("is_item") & arrived, c("view_status").isin("deleted", "archived") & F.when(c("git") == "D", c("is_item")).otherwise(c("src_is_item"))
    edited = (c("view_status") == "modified") | ((c("view_status") == "renamed") & (F.coalesce("similarity", F.lit(100)) < 100))
    existed = product & (c("cls") != "asset") & ((c("git") == "M") | (c("git").isin("R", "C") & (F.coalesce("similarity", F.lit(100)) < 100) & src_product))
    created = _n(c("git").isin("A", "C"))
    test = c("cls") == "test"
    a = v.groupBy("sha").agg(
        _n(product).alias("product_files"),
        _every(product, c("cls") == "asset").alias("asset_only"),
        _n(product & (c("cls") == "source") & arrived).alias("source_files_added"),
        _n(item_in).alias("items_added"), _n(item_out).alias("items_removed"),
        _every(product, c("cls").isin("content", "asset") & edited).alias("_content_edit"),
        _any(c("cls").isin("dependency_manifest", "lockfile")).alias("dependency_changed"), _any(c("cls") == "ci_build").alias("tooling_changed"),
        _any(c("cls") == "docs").alias("docs_changed"), _any(test).alias("tests_changed"),
        _every(product, c("git").isin("R", "C") & F.coalesce(c("similarity") == 100, F.lit(False)) & src_product).alias("_moved"),
        F.when(created < CREATED_LIMIT, False).alias("copy_detection_skipped"),
        _n((c("view_status") == "deleted") & F.when(c("git") == "D", product).otherwise(src_product)).alias("product_files_deleted"),
        F.coalesce(F.sum(F.when(product, c("added"))), F.lit(0)).alias("_plus"), F.coalesce(F.sum(F.when(product, c("removed"))), F.lit(0)).alias("_minus"),
        F.when(_n(product) == 0, None).when(_any(existed & (c("removed") >= 1)), "changes_existing_lines").when(_any(existed & (c("added") >= 1)), "additions_in_existing").otherwise("new_files_only").alias("edit_shape"),
        F.when(~_any(test), "none").when(_every(test, c("git") == "A"), "new_test_files_only").otherwise("existing_tests_changed").alias("tests_shape"),
        (_any(product & (c("cls") == "asset")) & _any(product & (c("cls") != "asset"))).alias("assets_changed"),
        _every(product, c("cls") == "app_config").alias("config_only"),
        (_any(product & (c("cls") == "app_config")) | _any((c("is_item") | c("src_is_item")) & (c("view_status").isin("added", "published", "deleted", "archived") | copied))).alias("_surface"),
    )
    still = (c("items_added") == 0) & (c("items_removed") == 0)
    return a.withColumns({
        "content_only_edit": c("_content_edit") & still, "move_or_copy_only": c("_moved") & still,
        "deletion_dominant": (c("_minus") >= DELETION_LINES) & (c("_minus") >= DELETION_RATIO * c("_plus")),
    }).drop("_content_edit", "_moved", "_plus", "_minus")


def record_facts(raw: DataFrame) -> DataFrame:
    """sha, parent_kind, snapshot_only from (sha, parents, paths array)."""
    kind = F.when(F.col("parents") <= 0, "root").when(F.col("parents") == 1, "single").otherwise("merge")
    snap = (F.size("paths") > 0) & F.forall("paths", lambda p: paths.is_snapshot(p))
    return raw.select("sha", kind.alias("parent_kind"), snap.alias("snapshot_only"))


def tables_created(path: Column, added: Column) -> Column:
    """CREATE TABLE statements on the added lines of a schema file."""
    on = (paths.ext(path) == ".sql") | paths.under(path, SCHEMA_DIRS)
    return F.when(on, F.aggregate(added, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(TABLE)))).otherwise(0)


def surface(touched: Column, entry: Column, extracted: Column, unknown: Column) -> Column:
    """Whether users can notice: yes, no, or unknown where a file isn't shown whole."""
    return F.when(touched | entry, True).when(extracted & (unknown == 0), False)


def diff_size(shown: Column, missing_lines: Column, n_lines: Column, incomplete: Column, cap: int = DIFF_CAP) -> Column:
    """fits, large or huge: the built product diff against its cap, what is missing estimated by its mean line."""
    mean = F.when(n_lines > 0, shown / n_lines).otherwise(40.0)
    guess = shown + F.floor(missing_lines * mean + 0.5)
    share = F.when(guess > 0, F.least(shown, F.lit(cap)) / guess).otherwise(0.0)
    return F.when(incomplete, F.when((guess <= 4 * cap) & (share >= 0.25), "large").otherwise("huge")).when(guess <= cap, "fits").when(guess <= 4 * cap, "large").otherwise("huge")


def mirrors(views: DataFrame) -> DataFrame:
    """sha, added_paths_mirror_existing: at least half of the added product paths equal a path known before but for case, or lie under a
    folder that spells a known folder another way."""
    product = F.col("cls").isin(*paths.PRODUCT)
    before = F.when(F.col("git") == "A", F.array().cast("array<string>")).when(F.col("old_path").isNotNull(), F.when(F.col("git") == "C", F.array("old_path", "path")).otherwise(F.array("old_path"))).when(F.col("git").isin("D", "M"), F.array("path"))
    known = views.select("sha", F.explode(F.coalesce(before, F.array().cast("array<string>"))).alias("p")).distinct()
    above = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(p, "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split(p, "/"), F.lit(1), i), "/"))
    inside = lambda p: F.when(p.contains("/"), above(p)).otherwise(F.array().cast("array<string>"))
    folders = known.select("sha", F.explode(inside(F.col("p"))).alias("d")).groupBy("sha", F.lower("d").alias("low")).agg(F.collect_set("d").alias("spelled"))
    new = views.filter(product & (F.col("git") == "A")).select("sha", "file_no", "path")
    same = new.join(known.select("sha", F.lower("p").alias("low")).distinct(), (new["sha"] == known["sha"]) & (F.lower(new["path"]) == F.col("low")), "left_semi").select("sha", "file_no")
    near = new.select("sha", "file_no", F.explode(inside(F.col("path"))).alias("d")).withColumn("low", F.lower("d")).join(folders, ["sha", "low"]).filter(~F.array_contains("spelled", F.col("d"))).select("sha", "file_no")
    hit = same.unionByName(near).distinct().withColumn("hit", F.lit(1))
    return new.join(hit, ["sha", "file_no"], "left").groupBy("sha").agg((F.count("hit") * 2 >= F.count("*")).alias("added_paths_mirror_existing"))
