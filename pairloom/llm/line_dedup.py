"""Line dedup by site-relative frequency.

A line is boilerplate on a site when the share of the site's pages that hold
it exceeds a ratio. Lines are counted once a page; a page that a site repeats
counts each time. The boilerplate lines of a site are few: a page has L lines
on average, so at most L / ratio lines can exceed the ratio. They travel as
one array for each site, and each text is filtered where it is.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh, keep

#: A line on more than this share of a site's pages is dropped.
RATIO = 0.02
#: A line must be on this many pages of the site; it spares the lines of small sites.
MIN_PAGES = 5
#: Boilerplate lines, 16 bytes each, are sent to every task up to this size.
SENT_BYTES = 8 << 20


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def trimmed(line: Column) -> Column:
    """What lines are compared by: without white space at both ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_key(line: Column) -> Column:
    """128 bits of a line."""
    line = trimmed(line)
    return F.struct(F.xxhash64(F.lit(1), line).alias("a"), F.xxhash64(F.lit(2), line).alias("b"))


def site(key: str | Column) -> Column:
    """The column that names a page's site."""
    return F.col(key) if isinstance(key, str) else key


def boilerplate(pages: DataFrame, text_col: str, site_col: str | Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_site, _lines``: for each site that has any, the keys of its boilerplate lines."""
    inked = F.filter(lines(F.col(text_col)), lambda x: F.length(trimmed(x)) > 0)
    held = pages.select(site(site_col).alias("_site"), F.explode(F.array_distinct(F.transform(inked, line_key))).alias("_line"))
    counts = held.groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages)
    totals = pages.groupBy(site(site_col).alias("_whose")).agg(F.count(F.lit(1)).alias("_total"))
    often = counts.join(totals, F.col("_site").eqNullSafe(F.col("_whose"))).where(F.col("_pages") > F.col("_total") * F.lit(ratio))
    return often.groupBy("_site").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))


def drop_boilerplate(pages: DataFrame, text_col: str = "text", site_col: str | Column = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages with their columns; ``text`` has lost its boilerplate lines; ``n_lines`` and ``n_dropped`` are added.

    A site is a column or, as where it is the host of an address (see
    ``url_filter.host``), an expression. Lines are split at ``\\n``; blank
    lines are never boilerplate and stay. A null text stays null, with no
    lines dropped (an empty text has one blank line). A null site is a site of
    its own. Repeated pages and null ids are treated like others; an empty
    table stays empty. The added columns replace columns of the same names;
    any other name may occur. Whole texts are read, however long.
    """
    known = keep(boilerplate(pages, text_col, site_col, ratio, min_pages), "boilerplate")
    # Sent to every task while it is small, so that texts stay where they are; beyond that Spark joins by site.
    size = known.agg(F.sum(16 * F.size("_lines") + 64)).first()[0] or 0
    own, often, before, after = (fresh(c, pages.columns) for c in ("_site", "_lines", "_before", "_after"))
    known = known.select(F.col("_site").alias(own), F.col("_lines").alias(often))
    if size <= SENT_BYTES:
        known = F.broadcast(known)
    joined = pages.withColumn(before, site(site_col)).join(known, F.col(before).eqNullSafe(F.col(own)), "left")
    joined = joined.withColumn(before, lines(F.col(text_col)))
    left = F.filter(before, lambda x: ~F.coalesce(F.array_contains(often, line_key(x)), F.lit(False)))
    kept = joined.withColumn(after, F.when(F.col(often).isNull(), F.col(before)).otherwise(left))
    texts = F.when(F.col(text_col).isNotNull(), F.array_join(after, "\n"))
    added = {text_col: texts, "n_lines": F.size(before).cast("long"), "n_dropped": (F.size(before) - F.size(after)).cast("long")}
    others = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    return kept.select(*others, *[v.alias(k) for k, v in added.items()])
