"""Chat formatting with cumulative-snapshot collapse.

A logger that writes a conversation after every turn leaves its beginnings
behind as conversations of their own. A rolling hash names each prefix of
turns; a conversation whose own hash is that of another's proper prefix is
dropped by an anti-join, and what remains is rendered.

The rolling hash is a running sum of hashes of (position, role, text), so it
is found from sums over chunks of turns and a running sum inside a chunk: a
conversation of any length is spread over tasks, and is rendered in parts of
bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

#: Turns of a chunk of a running sum, and of a rendered part.
CHUNK = 256
#: Rows of 256 turn numbers beyond which these are spread over smaller chunks.
CROWDED = 4096
#: Bits of one lane of the rolling hash: a sum over a chunk, of up to 2**22 rows, fits a long.
LANE_BITS = 40
LANES = ("h1", "h2", "h3")
TEMPLATE = ("<|", "|>\n", "\n")


def lane(k: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), *cols), F.lit(1 << LANE_BITS))


def running(df: DataFrame, key: str, chunk: str, order: list[Column], sums: dict[str, Column], bits: int = 62) -> DataFrame:
    """Running sums per key in two levels, modulo 2 ** ``bits``: over chunks, then inside each; needs ``order`` to refine ``chunk``.

    Sums over chunks are decimal ones, so they hold however many chunks there are.
    """
    whole = F.lit(1 << bits)
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = df.groupBy(key, chunk).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    so_far = {k: F.pmod(F.sum(F.col(f"_t_{k}").cast("decimal(38,0)")).over(before), whole.cast("decimal(38,0)")).cast("long") for k in sums}
    per_chunk = per_chunk.select(F.col(key).alias("_ck"), F.col(chunk).alias("_cc"), *[F.coalesce(v, F.lit(0)).alias(f"_b_{k}") for k, v in so_far.items()])
    within = df.withColumns({f"_w_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    joined = within.join(per_chunk, F.col(key).eqNullSafe(F.col("_ck")) & F.col(chunk).eqNullSafe(F.col("_cc")))
    return joined.select(*df.columns, *[F.pmod(F.col(f"_b_{k}") + F.pmod(F.col(f"_w_{k}"), whole), whole).alias(k) for k in sums])


def turns(chats: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``conv_id, place, role, text`` and the rolling hash up to each turn; places count from 1.

    Turns are ordered by ``turn`` (null first), then role and text; rows that
    repeat all four columns are one turn. A chunk is 256 turn numbers. Where
    an id has more than ``crowded`` rows with these (a logger that uses an id
    again, or rows without an id or a number), its chunks are single numbers,
    by role and the first bits of the hash that orders them.
    """
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    stretch = F.floor(F.col("turn") / CHUNK)
    busy = chats.groupBy(F.col("conv_id").alias("_k"), stretch.alias("_s")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded)
    rows = rows.join(busy, F.col("conv_id").eqNullSafe(F.col("_k")) & stretch.eqNullSafe(F.col("_s")), "left")
    split = F.col("_n").isNotNull()
    # a struct of what the order begins with
    parts = {"a": stretch, "b": F.when(split, F.col("turn")), "c": F.when(split, F.col("role")), "d": F.when(split, F.shiftright(F.xxhash64("text"), 54))}
    rows = rows.withColumn("_chunk", F.struct(*[v.alias(k) for k, v in parts.items()])).drop("_k", "_s", "_n")
    order = [F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("text")]
    placed = running(rows, "conv_id", "_chunk", order, {"place": F.lit(1).cast("long")})
    lanes = {name: lane(k, F.col("place"), F.col("role"), F.col("text")) for k, name in enumerate(LANES)}
    return running(placed.withColumn("_part", F.floor((F.col("place") - 1) / CHUNK)), "conv_id", "_part", [F.col("place")], lanes, LANE_BITS)


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no beginning of a longer one; of equal ones the smallest id stays."""
    last = rolled.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    whole = rolled.join(last.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("n_turns")))
    named = whole.groupBy("n_turns", *LANES).agg(F.min("conv_id").alias("conv_id"))
    longer = rolled.join(last.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") < F.col("n_turns")))
    prefixes = longer.select(F.col("place").alias("n_turns"), *LANES).distinct()
    return named.join(prefixes, ["n_turns", *LANES], "left_anti").select("conv_id", "n_turns")


def render(chats: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, text``: the maximal conversations, rendered.

    Part k holds turns 256 k + 1 and on; the parts of a conversation, one
    after the other, are its text. A null role or text is empty; turns with a
    null conversation id are one conversation; other columns are not read; an
    empty table gives no rows. Texts are rendered whole, however long.
    """
    rolled = keep(turns(chats), "turns")  # read four times below
    kept = maximal(rolled).withColumnRenamed("conv_id", "_kept")
    left, middle, right = (F.lit(x) for x in TEMPLATE)
    shown = F.concat(left, F.col("role"), middle, F.col("text"), right)
    rows = rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept"))).select("conv_id", "n_turns", F.col("_part").alias("part"), F.struct("place", shown.alias("shown")).alias("piece"))
    grouped = rows.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list("piece")).alias("pieces"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join(F.transform("pieces", lambda x: x["shown"]), "").alias("text"))
