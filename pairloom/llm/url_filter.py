"""URL filters as a temporal list join.

A list is a log of dated entries: from a day on, a host, site or address
prefix is listed, or no longer is. The entries of a key become validity
intervals, and each capture is matched, as of the time it was fetched, with
the interval of each of its keys that was open then. An interval that no
removal ends is open for ever.

A key may be that of a third of all captures (a top-level domain is). The
captures of such a key are dealt over blocks, and the key's intervals go to
each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures of a listed key that make a block.
CAPTURES_A_BLOCK = 1_000_000


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a final dot; null if the address has none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(F.length(found) > 0, F.regexp_replace(F.lower(found), r"\.$", ""))


def path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys(url: Column) -> Column:
    """All list keys that cover an address: its host and the host's parents, and its host with each leading part of the path.

    As many as the host has labels and the path has parts.
    """
    labels = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path(url), "/"), lambda x: F.length(x) > 0)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host(url).isNull(), F.array().cast("array<string>")).when(F.size(parts) == 0, parents).otherwise(F.concat(parents, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, since, until``: when each key was listed; ``until`` is the first day it no longer was, or null.

    Of several entries of one day the removal counts. Entries that repeat the
    state a key is in change nothing; entries without key or day are ignored.
    """
    entries = entries.where("key is not null and day is not null")
    daily = entries.groupBy("list", "key", "day").agg(F.max((F.col("action") != "add").cast("int")).alias("off"))
    order = Window.partitionBy("list", "key").orderBy("day")
    turns = daily.withColumn("was", F.lag("off").over(order)).where(F.coalesce(F.col("was"), F.lit(1)) != F.col("off"))
    return turns.withColumn("until", F.lead("day").over(order)).where("off = 0").select("list", "key", F.col("day").alias("since"), "until")


def matches(captures: DataFrame, entries: DataFrame, ids: list[str], url_col: str, time_col: str, block_rows: int = CAPTURES_A_BLOCK) -> DataFrame:
    """``*ids, list, key, since, until``: the listed keys of every capture that were active when it was fetched."""
    seen = captures.select(*ids, F.to_date(time_col).alias("day"), F.explode(F.array_distinct(keys(F.col(url_col)))).alias("key")).where("day is not null")
    listed = intervals(entries)
    # One hub at most for block_rows keys of captures: 80,000 for ten billion captures of eight keys, so it is sent to every task.
    hubs = seen.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")).where("_blocks > 1")
    hubs = F.broadcast(hubs.join(listed.select("key").distinct(), "key", "left_semi"))
    blocks = F.coalesce("_blocks", F.lit(1))
    spread = listed.join(hubs, "key", "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    dealt = seen.join(hubs, "key", "left").withColumn("_block", F.pmod(F.xxhash64(*ids), blocks).cast("int")).drop("_blocks")
    found = dealt.join(spread, ["key", "_block"])
    return found.where((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))).select(*ids, "list", "key", "since", "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", block_rows: int = CAPTURES_A_BLOCK) -> DataFrame:
    """One row per capture: ``id, url, fetched, allowed, n_matches, lists``.

    ``lists`` names the lists that covered it, sorted and joined by commas
    (empty if none). An address without host, a null address or a null time
    matches nothing and is allowed. Rows that repeat id, address and time are
    reported one by one and share their matches; captures are told apart by
    128 bits of hash of the three. Addresses are read whole, however long.
    Other columns are not read; an empty table gives no rows.
    """
    name = {"_a": F.xxhash64(F.lit(1), F.col(id_col), F.col(url_col), F.col(time_col)), "_b": F.xxhash64(F.lit(2), F.col(time_col), F.col(url_col), F.col(id_col))}
    rows = captures.select(*[c.alias(k) for k, c in name.items()], F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    found = matches(rows.select("_a", "_b", "url", "fetched").dropDuplicates(["_a", "_b"]), entries, ["_a", "_b"], "url", "fetched", block_rows)
    per_row = found.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    joined = rows.join(per_row, ["_a", "_b"], "left")
    return joined.select("id", "url", "fetched", F.col("n_matches").isNull().alias("allowed"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("lists", F.lit("")).alias("lists"))
