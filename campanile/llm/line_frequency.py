"""Boilerplate lines by their frequency among the pages of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campanile.llm.common import WORD
from campanile.session import cut

#: Up to this many flagged lines (32 bytes each and some overhead) are sent to every task; more are joined by host.
BROADCAST_LINES = 100_000
#: Parts a host's pages are dealt to in that join.
SALTS = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    return F.transform(F.filter(lines_of(text), lambda x: x.rlike(WORD.pattern)), F.md5)


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 2, few_pages: int = 4, few_ratio: float = 0.5) -> DataFrame:
    """Rows (host, line_key, n_pages, host_pages): lines on at least `min_pages` pages of a host and more than `max_ratio` of all its pages.

    Equal texts of a host are one page, so copies of a whole document make none of its lines boilerplate. A line on fewer than `few_pages` pages must be on more than
    `few_ratio` of the host's: on a small host two near copies do not take each other's text. A page counts a line once. Lines are compared exactly, by their MD5;
    lines without a word are left alone. A null host counts as the empty name, a null text as the empty one; no rows give none.
    Copies are folded and counts combined in each task before a shuffle, so neither a large host nor a text with many copies nor a frequent line meets in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    pages = df.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.md5(body).alias("page"), F.array_distinct(_keys(body)).alias("line_keys"))
    # both counts read the distinct pages, of which only hashes are kept
    pages = cut(pages.dropDuplicates(["host", "page"]))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = pages.select("host", F.explode("line_keys").alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n_pages"))
    often = counts.where(F.col("n_pages") >= min_pages).join(totals, "host").where(F.col("n_pages") > max_ratio * F.col("host_pages"))
    return often.where((F.col("n_pages") >= few_pages) | (F.col("n_pages") > few_ratio * F.col("host_pages")))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.05, min_pages: int = 2, into: str = "n_dropped_lines", few_pages: int = 4, few_ratio: float = 0.5) -> DataFrame:
    """The rows of `df` with boilerplate lines (see `boilerplate`) taken out of `text`, and how many in the column `into` (which replaces one of that name).

    Null texts stay null, and a page all of whose lines go keeps its row with an empty text. Repeated rows are cleaned alike. Texts of any length are taken whole; an
    empty table gives an empty one. A host has at most (lines a page) / max_ratio flagged lines, so its list is bounded; the lists go to all tasks if they are few in
    all, else they are joined by host, the pages of a host being dealt to many parts.
    """
    df = df.drop(into)
    lists = cut(boilerplate(df, host, text, max_ratio, min_pages, few_pages, few_ratio).groupBy("host").agg(F.collect_list("line_key").alias("__drop")))
    size = lists.agg(F.sum(F.size("__drop"))).first()[0] or 0
    name = F.coalesce(F.col(host).cast("string"), F.lit(""))
    if size <= BROADCAST_LINES:
        joined = df.withColumn("__host", name).join(F.broadcast(lists.withColumnRenamed("host", "__host")), "__host", "left")
    else:
        salted = lists.withColumnRenamed("host", "__host").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("__host", name).withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")
    hits = F.array_intersect(_keys(F.col(text)), F.col("__drop"))
    kept = F.filter(lines_of(F.col(text)), lambda x: ~F.array_contains(F.col("__hits"), F.md5(x)))
    out = joined.withColumn("__hits", F.when(F.col("__drop").isNotNull(), hits)).withColumn("__kept", F.when(F.size("__hits") > 0, kept))
    cleaned = F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col(text))
    dropped = F.when(F.col("__kept").isNotNull(), F.size(lines_of(F.col(text))) - F.size("__kept")).otherwise(0)
    return out.select(*[cleaned.alias(c) if c == text else F.col(c) for c in df.columns], dropped.alias(into))
