"""Line dedup by site-relative frequency.

For each site the pages that contain a line are divided by the site's pages; a line above the ratio is boilerplate
of that site and is dropped from all its pages. DataFrame functions only.

Pages of a line are counted with partial aggregation over (site, line digest), so neither a hot site nor a hot line
is gathered in one task, and only digests are shuffled. What is left per site is short: a site has at most (mean
distinct lines a page) / ratio boilerplate lines. That table is written, then joined to the pages on the site;
Spark broadcasts it if it is small, and otherwise splits a hot site's pages (AQE skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import materialise

#: A line on one page in twenty is boilerplate with room to spare; two pages that agree may be one copy of another.
RATIO = 0.04
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    """128-bit digest of a line without blanks, tabs and carriage returns at its ends."""
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r"))))


def boilerplate_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO,
                      min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, digest, pages, host_pages) of the lines that are on more than ``ratio`` of their host's pages.

    A page counts once for a line however often it has it, and each row is a page. Lines on fewer than
    ``min_pages`` pages are never boilerplate, and blank lines never are. A null host counts as the host ''.
    """
    pages = docs.select(F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text_col}`").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    empty = F.unhex(F.md5(F.lit("")))
    counts = (pages.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _digest))).alias("digest"))
              .where(F.col("digest") != empty)
              .groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages))
    return counts.join(totals, "host").where(F.col("pages") > F.lit(float(ratio)) * F.col("host_pages")).select(
        "host", "digest", "pages", "host_pages")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and n_lines, n_dropped (columns of these names are replaced).

    All rows and other columns stay. A text without boilerplate stays byte for byte; one that has nothing else
    becomes empty. Null texts stay null (no lines), an empty text has one (blank) line. Kept lines keep their order
    and their own white space. Repeated rows are pages of their own.
    """
    by_host = materialise(boilerplate_lines(docs, text_col, host_col, ratio, min_pages)
                          .groupBy("host").agg(F.collect_list("digest").alias("_ld_digests")))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text, lines = F.col(f"`{text_col}`"), F.col("_ld_lines")
    marked = (docs.select(*[F.col(f"`{c}`") for c in columns])
              .withColumn("_ld_host", F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")))
              .join(by_host.withColumnRenamed("host", "_ld_host"), "_ld_host", "left")
              .withColumn("_ld_lines", _lines(text))
              .withColumn("_ld_kept", F.when(F.col("_ld_digests").isNotNull(), F.filter(
                  lines, lambda line: ~F.array_contains(F.col("_ld_digests"), _digest(line))))))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(text.isNull(), 0).when(F.col("_ld_kept").isNull(), F.size(lines)).otherwise(F.size("_ld_kept")).cast("long")
    cleaned = F.when(n_kept == n_lines, text).otherwise(F.array_join("_ld_kept", "\n"))
    return marked.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns],
                         n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
