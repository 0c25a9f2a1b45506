"""Token counts by an exact length histogram.

Documents are counted by encoded length. Suffix sums over the lengths then answer, for every context limit, how many documents are
longer, how many tokens remain if each document is cut there, and which length any quantile of the documents has.

The sums run in two steps so that no task sees all lengths: over blocks of ``block`` lengths, then inside each block.

Defined cases: a null or empty text has length 0; ``doc_id`` plays no part, so repeated rows count once each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window

from .common import F, T, batch_of, stage
from .encode import default_file, encoder

BLOCK = 1024


def lengths(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """``length`` and ``n``: how many texts of a batch have it."""
    path = path or default_file()
    schema = T.StructType([T.StructField("length", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        ids_of = encoder(path)
        for b in batches:
            seen: dict[int, int] = {}
            for text in b.column(0):
                t = text.as_py()
                n = len(ids_of(t)) if t else 0
                seen[n] = seen.get(n, 0) + 1
            yield batch_of(schema, (list(seen), list(seen.values())))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, schema)


def histogram(docs: DataFrame, *, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each length that occurs.

    length, n_docs, n_tokens; docs_longer and tokens_longer of documents over it; docs_upto; truncated_tokens: the tokens left if
    every document is cut at ``length``; total_docs, total_tokens.
    """
    counts = stage(lengths(docs, path=path).groupBy("length").agg(F.sum("n").alias("n_docs")), "lengths")
    counts = counts.withColumn("n_tokens", F.col("n_docs") * F.col("length")).withColumn("block", F.floor(F.col("length") / block))
    per = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = per.select("block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("ad"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("at"), F.sum("bd").over(ever).alias("total_docs"), F.sum("bt").over(ever).alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(after, "block").withColumn("docs_longer", F.col("ad") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("tokens_longer", F.col("at") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return out.select("length", "n_docs", "n_tokens", "docs_longer", "tokens_longer", (F.col("total_docs") - F.col("docs_longer")).alias("docs_upto"), (F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"), "total_docs", "total_tokens")


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length that at least ``q`` of the documents don't exceed."""
    return hist.filter(F.col("docs_upto") >= F.lit(q) * F.col("total_docs")).agg(F.min("length").alias("length"))


def truncated_total(hist: DataFrame, limit: int) -> DataFrame:
    """The tokens left if every document is cut at ``limit``, whether or not a document has that length."""
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens"))
