"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are permuted by a hash of their id and laid out in
blocks of about equal word counts. A source is drawn whole as often as its
target holds it whole; of one more pass it gives its first blocks, so many
that the words meet the target, the last of them in part. That is the
source's exact quota of block draws.

The quotas are dealt to the output shards by a binary tree: at each node the
left half receives half of all draws, and how many of them are from which
source is a multivariate-hypergeometric draw. Shards, as many as the words
call for, then take disjoint runs of each source's permuted draws, and shuffle
what they have taken.

All of it is DataFrame and SQL functions; random numbers are hashes of fixed
seeds, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh, keep

#: Weights of the sources in the order of their names, repeated (by contract).
WEIGHTS = (5, 2, 1)
#: Words to take, as a percentage of all words.
SHARE = 150
#: Passes over a source at most.
MOST = 2
BLOCK_WORDS = 65_536
BLOCK_DOCS = 4096
#: A prefix sum over a source's blocks is made of sums over this many blocks.
BLOCKS_A_GROUP = 1024
#: Words of a shard, about; shards are a power of two, and this many at least.
SHARD_WORDS, FEWEST_SHARDS = 1 << 22, 16
#: A task of the mixed documents holds one shard, or more where there are more shards than this.
MOST_TASKS = 1 << 18
#: Levels of the tree that are one plan; after them its nodes are written and dealt over tasks.
LEVELS_A_TABLE = 8
#: Larger than any number of draws of a source (140,000 GB of words), which is checked, and prime, so that multiples of it permute them.
STRIDE = 2_147_483_647
HASH_BITS = 60


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_bits(*cols: Column) -> Column:
    """60 bits of md5 over the columns, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def uniform(*cols: Column) -> Column:
    return (hash_bits(*cols) + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))


def place(seed: int, id_col: str, text_col: str) -> Column:
    """A document's place in its source's permutation; a null id is placed by its text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return hash_bits(F.lit(str(seed)), key)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``doc_id, source, size, at, copies``: rows that repeat an id, source and size are one unit."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), place(seed, id_col, text_col).alias("at"))
    return rows.groupBy("doc_id", "source", "size", "at").agg(F.count(F.lit(1)).alias("copies"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per source: ``src`` (its number), ``source, source_size, target, blocks, passes, rest``.

    Sources in code point order, null last, have the weights in turn.
    Targets share ``share`` percent of all words; one that comes to more than
    ``most`` times its source's size stops there and the others share what is
    over, by weight. In the order of size by weight those that stop come
    first, so one running sum finds them all; the level of the first that does
    not stop is the highest of those.
    """
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # Windows over one row for each source.
    named = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(named))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "_all": F.sum("source_size").over(every),
            "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "_full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        }
    )
    level = (F.col("_all") * share / 100.0 - F.col("_full") * most) / F.col("_weights")
    per = per.withColumn("_stops", F.col("source_size") * most <= level * F.col("weight"))
    per = per.withColumn("_level", F.max(F.when(~F.col("_stops"), level)).over(every))
    cap = (F.col("source_size") * most).cast("double")
    per = per.withColumn("target", F.when(F.col("_stops") | F.col("_level").isNull(), cap).otherwise(F.least(cap, F.col("_level") * F.col("weight"))))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return per.select(
        "src",
        "source",
        "source_size",
        "target",
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words), F.ceil(F.col("docs") / block_docs)).cast("long").alias("blocks"),
        passes.alias("passes"),
        (F.col("target") - passes * F.col("source_size")).alias("rest"),
    )


def blocked(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``src, doc_id, at, size, copies, words, block, passes, rest``: documents in blocks, runs of their source's permutation."""
    figures = per_source.select("src", F.col("source").alias("_source"), "blocks", "passes", "rest")
    found = rows.join(figures, F.col("source").eqNullSafe(F.col("_source")))
    block = F.least(F.floor(F.col("at").cast("double") / float(1 << HASH_BITS) * F.col("blocks")).cast("long"), F.col("blocks") - 1)
    return found.select("src", "doc_id", "at", "size", "copies", (F.col("size") * F.col("copies")).alias("words"), block.alias("block"), "passes", "rest")


def ends(blocks: DataFrame) -> DataFrame:
    """``src, last_block, room``: the block in which the extra pass ends and the words that it may still take there.

    A prefix sum over a source's blocks in two levels, so that no window
    holds all blocks of a large source.
    """
    per_block = blocks.groupBy("src", "block").agg(F.sum("words").alias("words"), F.first("rest").alias("rest")).withColumn("group", F.floor(F.col("block") / BLOCKS_A_GROUP))
    groups = per_block.groupBy("src", "group").agg(F.sum("words").alias("_words"))
    before = Window.partitionBy("src").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("src", "group", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("src", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_block.join(groups, ["src", "group"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    end = placed.where((F.col("_start") <= F.col("rest")) & (F.col("_start") + F.col("words") > F.col("rest")))
    return end.select("src", F.col("block").alias("last_block"), (F.col("rest") - F.col("_start")).alias("room"))


def fill(blocks: DataFrame, last: DataFrame) -> DataFrame:
    """``src, at, size, n`` taken from each source's last block, ``n`` of the copies of a row.

    In permuted order, each copy that still fits; then one more of the
    smallest of the others if that brings the words nearer to the target.

    It is one block for each source, so the array of its documents is small.
    """
    there = blocks.join(last, "src").where("block = last_block and words > 0")
    lists = there.groupBy("src", "room").agg(F.sort_array(F.collect_list(F.struct("at", "size", "copies"))).alias("items"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("counts"))

    def step(acc: Column, x: Column) -> Column:
        return let(F.greatest(F.lit(0), F.least(x["copies"], F.floor(acc["room"] / x["size"]))).cast("long"), lambda k: F.struct((acc["room"] - k * x["size"]).alias("room"), F.concat(acc["counts"], F.array(k)).alias("counts")))

    def finish(acc: Column) -> Column:
        counted = F.zip_with("items", acc["counts"], lambda x, k: F.struct(x["size"].alias("size"), x["at"].alias("at"), (x["copies"] > k).alias("more"), k.alias("n")))
        nearer = F.filter(counted, lambda x: x["more"] & (x["size"] < 2 * acc["room"]))
        one = F.array_min(F.transform(nearer, lambda x: F.struct(x["size"].alias("size"), x["at"].alias("at"))))
        added = F.transform(counted, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), (x["n"] + F.coalesce((x["at"] == one["at"]) & (x["size"] == one["size"]), F.lit(False)).cast("long")).alias("n")))
        return F.filter(added, lambda x: x["n"] > 0)

    taken = F.explode(let(F.aggregate("items", start, step), finish)).alias("x")
    return lists.select("src", taken).select("src", "x.at", "x.size", "x.n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, less the eight factors too many."""

    def series(n: Column) -> Column:
        factors = n + 1
        for k in range(2, 9):
            factors = factors * (n + k)
        x = n + 9
        return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) - F.log(factors)

    return let(n, series)


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``good + bad`` are good, for a uniform number ``u``.

    Probabilities are added up outwards from the mode, by the ratio of
    neighbours, until they exceed u; the steps are of the order of the
    standard deviation.
    """

    def extend(a: Column, names: list[str], **more: Column) -> Column:
        return F.struct(*[a[k].alias(k) for k in names], *[v.alias(k) for k, v in more.items()])

    def log_choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    def bounds(a: Column) -> Column:
        g, b, n = a["g"], a["b"], a["n"]
        return let(extend(a, ["g", "b", "n", "u"], low=F.greatest(F.lit(0.0), n - b), high=F.least(g, n), middle=F.floor((g + 1) * (n + 1) / (g + b + 2)).cast("double")), mode)

    def mode(a: Column) -> Column:
        return let(extend(a, ["g", "b", "n", "u", "low", "high"], mode=F.least(a["high"], F.greatest(a["low"], a["middle"]))), top)

    def top(a: Column) -> Column:
        g, b, n, m = a["g"], a["b"], a["n"], a["mode"]
        chance = F.exp(log_choose(g, m) + log_choose(b, n - m) - log_choose(g + b, n))
        spread = F.sqrt(n * (g / (g + b)) * (b / (g + b)) * (1 - n / (g + b)) + 1)
        reach = F.least(F.greatest(m - a["low"], a["high"] - m), F.ceil(spread * 12) + 8).cast("int")
        return let(extend(a, ["g", "b", "n", "u", "low", "high", "mode"], top=chance, reach=reach), walk)

    def walk(a: Column) -> Column:
        start = F.struct(a["mode"].alias("pick"), (a["u"] < a["top"]).alias("done"), a["top"].alias("sum"), a["top"].alias("up"), a["top"].alias("down"))

        def step(acc: Column, i: Column) -> Column:
            x, y = a["mode"] + i, a["mode"] - i
            up = F.when(x <= a["high"], acc["up"] * (a["g"] - x + 1) * (a["n"] - x + 1) / (x * (a["b"] - a["n"] + x))).otherwise(F.lit(0.0))
            down = F.when(y >= a["low"], acc["down"] * (y + 1) * (a["b"] - a["n"] + y + 1) / ((a["g"] - y) * (a["n"] - y))).otherwise(F.lit(0.0))

            def choose(v: Column) -> Column:
                over = (a["u"] < acc["sum"] + v["up"]) & (v["up"] > 0)
                under = (a["u"] < acc["sum"] + v["up"] + v["down"]) & (v["down"] > 0)
                return F.struct(F.when(over, x).when(under, y).otherwise(acc["pick"]).alias("pick"), (over | under).alias("done"), (acc["sum"] + v["up"] + v["down"]).alias("sum"), v["up"].alias("up"), v["down"].alias("down"))

            return F.when(acc["done"], acc).otherwise(let(F.struct(up.alias("up"), down.alias("down")), choose))

        steps = F.when(a["reach"] >= 1, F.sequence(F.lit(1), F.greatest(a["reach"], F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step)["pick"]

    given = F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), drawn.cast("double").alias("n"), u.alias("u"))
    return F.when((good == 0) | (drawn == 0), F.lit(0.0)).when(bad == 0, drawn.cast("double")).otherwise(let(given, bounds)).cast("long")


def splitting_tree(quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """``src, shard, first, draws``: how the ``draws`` of each source are dealt to ``shards`` (a power of two).

    A node is a row that holds the draws of every source and, as ``first``,
    how many went to nodes left of it, so a level of the tree is one
    projection and the sources' number is its width.
    """
    have = F.sort_array(F.collect_list(F.struct("src", F.lit(0).cast("long").alias("first"), "draws")))
    node = quota.groupBy().agg(have.alias("have")).select(F.lit(1).alias("level"), F.lit(0).alias("node"), "have")
    total = F.aggregate("have", F.lit(0).cast("long"), lambda acc, x: acc + x["draws"])
    start = F.struct(total.alias("left"), F.floor((total + F.col("node") % 2) / 2).cast("long").alias("room"), F.array().cast("array<bigint>").alias("took"))

    def step(acc: Column, x: Column) -> Column:
        u = uniform(F.concat(F.lit(f"{seed}:"), F.col("level").cast("string")), F.col("node").cast("string"), F.size(acc["took"]).cast("string"))
        k = hypergeometric(x["draws"], acc["left"] - x["draws"], acc["room"], u)
        return let(k, lambda k: F.struct((acc["left"] - x["draws"]).alias("left"), (acc["room"] - k).alias("room"), F.concat(acc["took"], F.array(k)).alias("took")))

    # one expression serves all levels
    took = F.aggregate("have", start, step)["took"]
    left = F.zip_with("have", "took", lambda x, k: F.struct(x["src"].alias("src"), x["first"].alias("first"), k.alias("draws")))
    right = F.zip_with("have", "took", lambda x, k: F.struct(x["src"].alias("src"), (x["first"] + k).alias("first"), (x["draws"] - k).alias("draws")))
    halves = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("have")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("have")))).alias("h")
    for depth in range(1, shards.bit_length()):
        node = node.withColumn("took", took).select("level", halves).select((F.col("level") * 2).alias("level"), "h.node", "h.have")
        if depth % LEVELS_A_TABLE == 0:
            node = keep(node.repartition("node"), "nodes")
    return node.select(F.col("node").alias("shard"), F.explode("have").alias("h")).select("h.src", "shard", "h.first", "h.draws")


class Mix:
    """The plan of one mix; its tables hold no texts, and each is written once.

    ``rows`` has a row per document, ``per_source`` one per source, ``draws``
    one per drawn block (``src, block, pass, shard``), ``last`` the documents
    taken from the blocks in which an extra pass ends.

    Sources may be null (one more source, last in order); a null text has no
    words; texts are counted whole, however long. Rows that repeat an id,
    source and size are copies, which go to the shards together but are taken
    one by one where an extra pass ends. Documents of equal place in the
    permutation go by size. A null id is placed by a hash of its text. Columns
    besides the three named are only carried, whatever their names. An empty
    table gives an empty mix, and a source without words a target of 0.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, block_words: int = BLOCK_WORDS):
        self.docs, self.names, self.seed = docs, (id_col, text_col, source_col), seed
        self.rows = keep(sized(docs, id_col, text_col, source_col, seed), "sizes")
        self.per_source = keep(targets(self.rows, weights, share, block_words=block_words), "targets")
        if shards is None:
            mixed, shards = self.per_source.agg(F.sum("target")).first()[0] or 0, FEWEST_SHARDS
            while shards * SHARD_WORDS < mixed:
                shards *= 2
        self.shards = shards
        self.blocks = blocked(self.rows, self.per_source)
        last = keep(ends(self.blocks), "ends")
        self.last = keep(fill(self.blocks, last), "last")
        # a pass that ends inside a block draws that block too
        quota = self.per_source.join(last, "src", "left").withColumn("draws", F.col("passes") * F.col("blocks") + F.coalesce(F.col("last_block") + 1, F.lit(0)))
        self.quota = keep(quota.select("src", "blocks", "passes", "last_block", "draws"), "quota")
        self.draws = keep(self._deal(), "draws")

    def _deal(self) -> DataFrame:
        tree = splitting_tree(self.quota.select("src", "draws"), self.shards, self.seed).where("draws > 0")
        # a source's draws are spread over tasks by shard before each becomes a row
        taken = tree.repartition("src", "shard").select("src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1)).alias("place"))
        # multiples of a prime permute the source's draws
        placed = F.when(F.col("draws") < STRIDE, F.pmod(F.col("place") * STRIDE, F.col("draws"))).otherwise(F.raise_error(F.lit("a source has more draws than can be permuted: raise block_words")))
        taken = taken.join(self.quota, "src").withColumn("draw", placed)
        return taken.select("src", "shard", F.pmod("draw", "blocks").alias("block"), F.floor(F.col("draw") / F.col("blocks")).alias("pass"), (F.col("draw") == F.col("passes") * F.col("blocks") + F.col("last_block")).alias("ends"))

    def drawn(self) -> DataFrame:
        """``src, at, size, pass, shard, n``: for each draw of a document's block, how many of its copies are taken."""
        met = self.blocks.select("src", "at", "size", "copies", "block").join(self.draws, ["src", "block"]).drop("block")
        whole = met.where(~F.coalesce("ends", F.lit(False))).drop("ends").withColumnRenamed("copies", "n")
        partly = met.where("ends").drop("ends", "copies").join(self.last, ["src", "at", "size"])
        return whole.unionByName(partly.select(whole.columns))

    def _draws_of_rows(self) -> DataFrame:
        """``src, at, size, drawn``: the draws of each document, in order of pass; one for each pass at most."""
        return self.drawn().groupBy("src", "at", "size").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "n"))).alias("drawn"))

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken, shards`` for every row of the input.

        ``shards`` are the numbers of the shards that take the row, in order
        of pass, joined by commas.
        """
        figures = self.per_source.select("src", F.col("source").alias("_source"), "source_size", "target")
        rows = self.rows.join(figures, F.col("source").eqNullSafe(F.col("_source"))).join(self._draws_of_rows(), ["src", "at", "size"], "left")
        each = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        mine = F.coalesce(F.filter("drawn", lambda d: d["n"] >= F.col("_copy")), F.array().cast("array<struct<pass:bigint,shard:int,n:bigint>>"))
        each = each.withColumn("_mine", mine)
        shards = F.array_join(F.transform("_mine", lambda d: d["shard"].cast("string")), ",")
        return each.select("doc_id", "size", "source_size", "target", (F.size("_mine") * F.col("size")).cast("long").alias("taken"), shards.alias("shards"))

    def documents(self) -> DataFrame:
        """The mixed documents with all their columns, a partition for each shard, each shard shuffled.

        Copies (rows that repeat an id, source and size) are numbered to tell
        how many of them a draw takes, so they meet in one task.
        """
        id_col, text_col, source_col = self.names
        columns = self.docs.columns
        where, words_, named, none, drawn, copy, draw = (fresh(c, columns) for c in ("_place", "_words", "_named", "_none", "_drawn", "_copy", "_draw"))
        # a source and whether it is null, as keys of the join and of the window: texts are shuffled once for both
        source = {named: lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")), none: lambda c: F.col(c).isNull()}
        times = self._draws_of_rows().join(self.per_source.select("src", *[f("source").alias(n) for n, f in source.items()]), "src")
        times = times.select(F.col("at").alias(where), F.col("size").alias(words_), named, none, F.col("drawn").alias(drawn))
        full = self.docs.withColumns({where: place(self.seed, id_col, text_col), words_: words(F.col(text_col))} | {n: f(source_col) for n, f in source.items()})
        keys = [where, words_, named, none]
        numbered = full.join(times, keys).withColumn(copy, F.row_number().over(Window.partitionBy(*keys).orderBy(where)))
        shown = numbered.withColumn(draw, F.explode(F.filter(drawn, lambda d: d["n"] >= F.col(copy))))
        tasks = min(self.shards, MOST_TASKS)
        shard = F.col(draw)["shard"]
        dealt = shown.repartitionById(tasks, F.pmod(shard, F.lit(tasks)).cast("int"))
        return dealt.sortWithinPartitions(shard, F.xxhash64(F.lit(self.seed), where, F.col(draw)["pass"])).select(*[F.col(f"`{c}`") for c in columns])
