"""Neighbours, overlaps and distances of drugs and conditions, as joins of long tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .joins import top_per_group
from ..sources.catalog import numbered
from ..sources.shared import keep


#: Drugs of one value are joined in blocks of about this many.
DRUGS_A_BLOCK = 256

#: Where neighbours are only counted: drugs that a task asks for, train drugs of a task, a bit each, drugs whose
#: bits are counted at once, and the members from which a value is held as bits and not as places.
DRUGS_A_CHUNK, BITS_A_BLOCK, DRUGS_A_SLICE, DENSE = 4096, 65_536, 64, 512

#: Rows that a task tells apart, about.
ROWS_A_PART = 1_000_000

#: Queries that one pass sends to all tasks, at most, and those of one dense comparison.
QUERIES_A_PASS, QUERIES_A_SLICE = 16_384, 1024


def neighbours(edges: DataFrame, train: DataFrame, drug: str = "drug", value: str = "value") -> DataFrame:
    """``drug, neighbour``: train drugs that share a value with a drug, itself left out.

    The drugs of a frequent value are dealt over blocks by a hash, and its
    train drugs go to each of its blocks, so that no task holds all pairs of it.
    """
    left = edges.where(F.col(value).isNotNull()).select(drug, value).distinct()
    hubs = left.groupBy(value).agg(F.ceil(F.count(F.lit(1)) / DRUGS_A_BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    dealt = left.join(hubs, value, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    right = dealt.join(train.select(drug), drug, "left_semi").select(F.col(drug).alias("neighbour"), value, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    dealt = dealt.select(drug, value, F.pmod(F.xxhash64(drug), F.col("_blocks")).cast("int").alias("_block"))
    return dealt.join(right, [value, "_block"]).where(F.col(drug) != F.col("neighbour")).select(drug, "neighbour").distinct()


def bits_of(places: list[np.ndarray], block: int) -> np.ndarray:
    """A row of ``block`` bits for each list of places."""
    out = np.zeros((len(places), block // 64), dtype=np.uint64)
    for row, at in zip(out, places, strict=True):
        np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def _count_near(asked: pa.Table, held: pa.Table, block: int, dense: int) -> pa.Table:
    """For a chunk of drugs and a block of train drugs: neighbours of each drug (null condition), and those flagged for each condition."""
    flag = pc.is_valid(held.column("condition"))
    sides = []
    for part in (held.filter(pc.invert(flag)), held.filter(flag)):
        ends = pa.concat_arrays(part.column("places").chunks) if part.num_rows else pa.array([], pa.list_(pa.int32()))
        places = [np.asarray(x, dtype=np.int64) for x in np.split(ends.flatten().to_numpy(), ends.value_lengths().to_numpy(zero_copy_only=False).cumsum()[:-1])] if len(ends) else []
        many = [k for k, x in enumerate(places) if len(x) >= dense]
        sides.append((part, places, dict(zip(many, bits_of([places[k] for k in many], block), strict=True))))
    (values, of_value, value_bits), (flags, of_flag, flag_bits) = sides
    lists = pa.concat_arrays(asked.column("values").chunks)
    code = pc.fill_null(pc.index_in(lists.flatten(), pa.array(values.column("value").combine_chunks())), -1).to_numpy()
    first = np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False).cumsum()])
    own = pc.fill_null(asked.column("own"), -1).to_numpy()
    found = []
    for start in range(0, asked.num_rows, DRUGS_A_SLICE):
        stop = min(start + DRUGS_A_SLICE, asked.num_rows)
        near = np.zeros((stop - start, block // 64), dtype=np.uint64)
        for row, drug in zip(near, range(start, stop), strict=True):
            for k in code[first[drug] : first[drug + 1]]:
                if k in value_bits:
                    row |= value_bits[k]
                elif k >= 0:
                    np.bitwise_or.at(row, of_value[k] >> 6, np.uint64(1) << (of_value[k] & 63).astype(np.uint64))
            if own[drug] >= 0:  # no drug is its own neighbour
                row[own[drug] >> 6] &= ~(np.uint64(1) << np.uint64(own[drug] & 63))
        found.append((start, -1, np.bitwise_count(near).sum(axis=1, dtype=np.int64)))
        for k, at in enumerate(of_flag):
            if k in flag_bits:
                n = np.bitwise_count(near & flag_bits[k]).sum(axis=1, dtype=np.int64)
            else:
                n = ((near[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).sum(axis=1, dtype=np.int64)
            found.append((start, k, n))
    at = [np.flatnonzero(n) for _, _, n in found]
    drugs = np.concatenate([start + x for (start, _, _), x in zip(found, at, strict=True)])
    kinds = np.concatenate([np.full(len(x), k) for (_, k, _), x in zip(found, at, strict=True)])
    counts = np.concatenate([n[x] for (_, _, n), x in zip(found, at, strict=True)])
    condition = flags.column("condition").combine_chunks().take(pa.array(kinds, mask=kinds < 0))
    return pa.table({"drug": asked.column("drug").combine_chunks().take(pa.array(drugs)), "condition": condition, "n": pa.array(counts)})


def neighbour_counts(pairs: DataFrame, edges: DataFrame, train: DataFrame, flagged: DataFrame, drug: str = "drug", value: str = "value") -> DataFrame:
    """``drug, condition, n``: how many of ``neighbours`` a drug of ``pairs`` has (``condition`` null), and how many flagged for each condition.

    No pair of drugs becomes a row. Train drugs are numbered and stand for
    bits, in blocks; a value and a condition are the places of their train
    drugs in a block. A task meets a chunk of drugs with a block: a drug's
    neighbours are the union of its values' bits, and counts are those of
    set bits. So work is a 64th of the pairs of drugs, and memory that of a
    block, of a chunk, and of the conditions.
    """
    own = edges.where(F.col(value).isNotNull() & F.col(drug).isNotNull()).select(F.col(drug).alias("drug"), F.col(value).alias("value")).distinct()
    own = keep(own, "edges")
    known = keep(numbered(own.join(train.select(F.col(drug).alias("drug")), "drug", "left_semi").select("drug").distinct(), ["drug"]), "train")
    placed = known.select("drug", F.floor(F.col("row_index") / BITS_A_BLOCK).cast("int").alias("_block"), (F.col("row_index") % BITS_A_BLOCK).cast("int").alias("_place"))
    wanted = own.join(pairs.select("drug").distinct(), "drug", "left_semi").groupBy("drug").agg(F.collect_list("value").alias("values"))
    wanted = keep(wanted.join(placed, "drug", "left"), "wanted")
    blocks, chunks = -(-known.count() // BITS_A_BLOCK), -(-wanted.count() // DRUGS_A_CHUNK)
    chunk = F.pmod(F.xxhash64("drug"), F.lit(max(1, chunks))).cast("int").alias("_chunk")
    spread = wanted.select("drug", "values", "_block", "_place", chunk, F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("_to"))
    spread = spread.select("_chunk", F.col("_to").alias("_block"), "drug", "values", F.when(F.col("_block") == F.col("_to"), F.col("_place")).alias("own"))
    kinds = dict(value=own.schema["value"].dataType, condition=flagged.schema["condition"].dataType)
    marks = flagged.select(F.col("drug"), "condition").where("condition is not null").distinct().join(pairs.select("condition").distinct(), "condition", "left_semi")
    held = [rows.join(placed, "drug").groupBy("_block", of).agg(F.collect_list("_place").alias("places")).select("_block", *[F.col(c) if c == of else F.lit(None).cast(kinds[c]).alias(c) for c in kinds], "places") for rows, of in ((own, "value"), (marks, "condition"))]
    held = held[0].unionByName(held[1]).select(F.explode(F.sequence(F.lit(0), F.lit(max(1, chunks) - 1))).alias("_chunk"), "_block", *kinds, "places")
    cells = max(1, blocks * chunks)
    left, right = (rows.repartition(cells, "_chunk", "_block").groupBy("_chunk", "_block") for rows in (spread, held))
    kind = {"drug": wanted.schema["drug"].dataType, **kinds}
    block, dense = BITS_A_BLOCK, DENSE
    counted = left.cogroup(right).applyInArrow(lambda asked, there: _count_near(asked, there, block, dense), f"drug {kind['drug'].simpleString()}, condition {kind['condition'].simpleString()}, n long")
    return keep(counted.groupBy("drug", "condition").agg(F.sum("n").alias("n")), "near")


def transported_rate(pairs: DataFrame, near: DataFrame, rates: DataFrame, k: float = 10.0) -> DataFrame:
    """Share of a drug's neighbours flagged for the condition, shrunk to the condition's rate by ``k`` pseudo-neighbours.

    ``pairs`` drug, condition; ``near`` as ``neighbour_counts`` gives it of
    these pairs; ``rates`` condition, p_c.
    """
    counts = near.where("condition is null").select("drug", F.col("n").alias("n_neighbours"))
    hits = near.where("condition is not null").withColumnRenamed("n", "n_flagged")
    out = pairs.join(counts, "drug", "left").join(hits, ["drug", "condition"], "left").join(rates, "condition", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_neighbours", "n_flagged")})
    rate = (F.col("n_flagged") + k * F.col("p_c")) / (F.col("n_neighbours") + k)
    return out.withColumns({"rate": rate, "excess": rate - F.col("p_c")})


def shrunk_rates(transported: DataFrame, strengths: tuple[float, ...] = (5.0, 10.0, 20.0)) -> DataFrame:
    """``rate_k`` and ``excess_k`` for several numbers of pseudo-neighbours, from one count."""
    out = transported
    for k in strengths:
        rate = (F.col("n_flagged") + k * F.col("p_c")) / (F.col("n_neighbours") + k)
        out = out.withColumns({f"rate_{k:g}": rate, f"excess_{k:g}": rate - F.col("p_c")})
    return out


def neighbour_coverage(transported: DataFrame) -> DataFrame:
    """Shares of pairs whose drug has neighbours, 1 or 3 at least, and the share of drugs without any."""
    n = F.col("n_neighbours")
    alone = transported.groupBy("drug").agg(F.max("n_neighbours").alias("n")).agg(F.avg((F.col("n") == 0).cast("double"))).scalar()
    return transported.agg(F.avg((n >= 1).cast("double")).alias("share_1"), F.avg((n >= 3).cast("double")).alias("share_3")).withColumn("drugs_without", alone)


def gene_idf(condition_genes: DataFrame) -> DataFrame:
    """``gene, df, idf``: log of conditions over those that have the gene."""
    every = condition_genes.agg(F.count_distinct("condition")).scalar()
    per = condition_genes.groupBy("gene").agg(F.count_distinct("condition").alias("df"))
    return per.withColumn("idf", F.log(every / F.greatest(F.col("df"), F.lit(1))))


def overlap(pairs: DataFrame, drug_values: DataFrame, condition_values: DataFrame, value: str, weight: str | tuple[str, ...] | None = None) -> DataFrame:
    """Shared values of each pair with their Jaccard index (0 without any value), and the sum and maximum of each weight.

    One weight is reported as ``sum_weight`` and ``max_weight``, several under their own names.

    Value counts join by side; shared values are counted only for the pairs
    asked for, so no drug-by-condition matrix is formed.
    """
    left = drug_values.select("drug", value).where(F.col(value).isNotNull()).distinct()
    right = condition_values.where(F.col(value).isNotNull())
    sizes = left.groupBy("drug").agg(F.count(F.lit(1)).alias("n_left")), right.groupBy("condition").agg(F.count_distinct(value).alias("n_right"))
    wanted = pairs.select("drug", "condition").distinct()
    weights = {"weight": weight} if isinstance(weight, str) else {w: w for w in weight or ()}
    sums = [F.count_distinct(value).alias("n_shared"), *[f(w).alias(f"{kind}_{name}") for name, w in weights.items() for kind, f in (("sum", F.sum), ("max", F.max))]]
    shared = wanted.join(left, "drug").join(right, ["condition", value]).groupBy("drug", "condition").agg(*sums)
    out = pairs.join(shared, ["drug", "condition"], "left").join(sizes[0], "drug", "left").join(sizes[1], "condition", "left")
    filled = ["n_shared", "n_left", "n_right", *[f"{kind}_{name}" for name in weights for kind in ("sum", "max")]]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in filled})
    union = F.col("n_left") + F.col("n_right") - F.col("n_shared")
    return out.withColumn("jaccard", F.when(union > 0, F.col("n_shared") / union).otherwise(0.0))


def pathway_overlap(pairs: DataFrame, drug_genes: DataFrame, condition_genes: DataFrame, gene_pathways: DataFrame, m: int = 50) -> DataFrame:
    """Overlap of pathways, on the condition's side those of its ``m`` strongest genes."""
    strongest = top_per_group(condition_genes, "condition", m, F.desc("score"), F.col("gene"))
    of_drugs = drug_genes.join(gene_pathways, "gene").select("drug", "pathway").distinct()
    of_conditions = strongest.join(gene_pathways, "gene").select("condition", "pathway").distinct()
    return overlap(pairs, of_drugs, of_conditions, "pathway")


def pathways(genes: DataFrame, gene: str = "gene", records: str = "pathways") -> DataFrame:
    """``gene, pathway`` of nested pathway records, by id or else by name."""
    each = genes.select(gene, F.explode(records).alias("x"))
    names = [f"x.{c}" for c in ("pathwayId", "id", "pathway") if c in each.schema["x"].dataType.names]
    return each.select(gene, F.coalesce(*names).alias("pathway")).where("pathway is not null").distinct()


def rungs(drugs: DataFrame, train: DataFrame, levels: dict[str, DataFrame], annotated: DataFrame) -> DataFrame:
    """``drug, rung``: D0, D1, ... by the first level on which the drug shares a value with a train drug; then annotated or not.

    Each level is a table ``drug, value``.
    """
    out = drugs.select("drug").distinct()
    for name, table in levels.items():
        seen = table.join(train.select("drug"), "drug", "left_semi").select("value").where("value is not null").distinct()
        close = table.join(seen, "value", "left_semi").select("drug").distinct().withColumn(f"_{name}", F.lit(True))
        out = out.join(close, "drug", "left")
    out = out.join(annotated.select("drug").distinct().withColumn("_annotated", F.lit(True)), "drug", "left")
    ladder = reduce(lambda c, k: c.when(F.col(k[1]), f"D{k[0]}"), enumerate([f"_{n}" for n in levels] + ["_annotated"]), F)
    return out.select("drug", ladder.otherwise(f"D{len(levels) + 1}").alias("rung"))


def widened(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Conditions of a set, and those that share an ontology term with one of them.

    Rows are told apart in tasks of a bounded number of rows, dealt by
    condition and set: the terms' rows are counted before they are formed.
    """
    terms = keep(members.join(mapping, "condition").select("set_id", "ontology_id").distinct(), "terms")
    many = [rows.groupBy("ontology_id").agg(F.count(F.lit(1)).cast("double").alias(n)) for rows, n in ((terms, "_sets"), (mapping, "_conditions"))]
    n = members.count() + int(many[0].join(many[1], "ontology_id").agg(F.sum(F.col("_sets") * F.col("_conditions"))).first()[0] or 0)
    every = members.select("set_id", "condition").unionByName(terms.join(mapping, "ontology_id").select("set_id", "condition"))
    return every.repartition(-(-n // ROWS_A_PART) or 1, "set_id", "condition").distinct()


def affinity(pairs: DataFrame, panel: DataFrame, syndromes: DataFrame) -> DataFrame:
    """Strongest affinity of the drug among the off-targets of the condition, and whether there is any."""
    best = panel.join(syndromes, "off_target").groupBy("drug", "condition").agg(F.max("affinity").alias("affinity"))
    return pairs.join(best, ["drug", "condition"], "left").withColumn("has_affinity", F.col("affinity").isNotNull())


def measured_or_imputed(measured: DataFrame, imputed: DataFrame, keys: list[str]) -> DataFrame:
    both = measured.withColumnRenamed("affinity", "_m").join(imputed.withColumnRenamed("affinity", "_i"), keys, "full")
    return both.select(*keys, F.coalesce("_m", "_i").alias("affinity"), F.col("_m").isNotNull().alias("is_measured"))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node of each connected component, by star contraction.

    In each round every node hands its larger neighbours to its smallest one
    (large star), and then its smaller ones (small star), so that components
    shrink to stars round their smallest nodes, long chains by more than half
    a round. Edges run from the larger node to the smaller, each once.
    """
    u, v = F.col("u"), F.col("v")
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = keep(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    alone = now.where("u = v").select("u")
    now = now.where("u <> v")
    while not is_star_forest(now):
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(u.alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now = keep(small.where("u <> v").distinct(), "edges")
    rows = now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component"))).unionByName(alone.select(u.alias("node"), u.alias("component")))
    return rows.groupBy("node").agg(F.min("component").alias("component"))


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every edge ``u, v`` leads from a node with no other edge to a centre, which leads nowhere."""
    per = edges.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
    inner = per.join(per.select(F.col("v").alias("u")), "u", "left_semi")
    return per.where("n > 1").unionByName(inner).isEmpty()


def packed(bits: pa.Array, words: int) -> np.ndarray:
    """A row of 64-bit words for each list of set positions."""
    sizes = np.diff(bits.offsets.to_numpy())
    out = np.zeros((len(bits), words * 64), dtype=bool)
    out[np.repeat(np.arange(len(bits)), sizes), bits.flatten().to_numpy()] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _nearest(queries: Broadcast, words: int, rows_a_slice: int):
    """Best similarity of each query to the rows of a task, slice by slice; ``queries`` are ids and their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bits = queries.value
        own = packed(bits, words)
        n = np.bitwise_count(own).sum(axis=1, dtype=np.int64)
        distinct = pc.unique(ids)
        code = pc.index_in(ids, distinct).to_numpy()
        best = np.zeros(len(ids))
        for batch in batches:
            there = pc.fill_null(pc.index_in(batch.column("id"), distinct), -1).to_numpy()
            for at in range(0, batch.num_rows, rows_a_slice):
                part = batch.slice(at, rows_a_slice)
                x = packed(part.column("bits"), words)
                m = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                # sets of n and m bits are alike by min / max at most
                near = np.clip(n, m.min(), m.max())
                open_ = np.flatnonzero(np.minimum(n, near) > best * np.maximum(np.maximum(n, near), 1))
                for first in range(0, len(open_), QUERIES_A_SLICE):
                    q = open_[first : first + QUERIES_A_SLICE]
                    both = np.zeros((len(m), len(q)), dtype=np.int64)
                    for w in range(words):
                        both += np.bitwise_count(x[:, w, None] & own[None, q, w])
                    alike = both / np.maximum(m[:, None] + n[q] - both, 1)
                    alike[there[at : at + len(m), None] == code[q]] = 0.0
                    best[q] = np.maximum(best[q], alike.max(axis=0))
        found = best > 0
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(found)), pa.array(best[found])], names=["id", "best"])

    return run


def tanimoto(queries: DataFrame, reference: DataFrame, key: str = "bits", queries_a_pass: int = QUERIES_A_PASS) -> DataFrame:
    """``id, best``: the highest Tanimoto similarity of each query's bits to the rows of a reference set of other ids.

    Bits are arrays of set positions from 0, packed to words in the tasks.
    Queries are a stated set: they go to all tasks in passes of bounded size,
    and in each pass every row meets them where it lies, so nothing is
    shuffled but a number for each query and task, and no task holds a bit.
    Bits counted before are an upper bound that passes most slices by.
    A query without bits, or without another row, is like none: 0. Ids that
    repeat have the best of their rows; rows without an id or bits go.
    """
    spark, kind = queries.sparkSession, queries.schema["id"].dataType.simpleString()
    ask, rows = (d.where(F.col("id").isNotNull() & F.col(key).isNotNull()).select("id", F.array_distinct(F.array_compact(key)).cast("array<int>").alias("bits")) for d in (queries, reference))
    widths = [d.agg(F.max(F.array_max("bits"))).first()[0] or 0 for d in (ask, rows)]
    words = max(widths) // 64 + 1
    rows_a_slice = max(1, min(256, (1 << 24) // (words * 64)))
    parts, held = [], []
    step = max(1, min(queries_a_pass, (1 << 27) // (words * 64)))

    def scan() -> None:
        ids = pa.array([r.id for r in held], to_arrow_type(queries.schema["id"].dataType))
        bits = pa.array([r.bits for r in held], pa.list_(pa.int32()))
        sent = spark.sparkContext.broadcast((ids, bits))
        parts.append(keep(rows.mapInArrow(_nearest(sent, words, rows_a_slice), f"id {kind}, best double").groupBy("id").agg(F.max("best").alias("best")), "nearest"))
        held.clear()

    for row in ask.toLocalIterator():
        held.append(row)
        if len(held) == step:
            scan()
    if held:
        scan()
    asked = queries.select("id")
    if not parts:
        return asked.withColumn("best", F.lit(0.0))
    best = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.max("best").alias("best"))
    return asked.join(best, "id", "left").select("id", F.coalesce("best", F.lit(0.0)).alias("best"))


def in_domain(similar: DataFrame, least: float = 0.4) -> DataFrame:
    """Whether a query is as similar to the reference set as a model may be trusted with."""
    return similar.withColumn("in_domain", F.col("best") >= least)


def wide_panel(panel: DataFrame, targets: list[str], key: str = "drug", target: str = "off_target", value: str = "affinity") -> DataFrame:
    """A column for each off-target: the strongest affinity of the drug."""
    return panel.groupBy(key).pivot(target, targets).agg(F.max(value))
