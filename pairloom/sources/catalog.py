"""A registry of the tables in a folder, pages of a table, and edits by row index."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import exists, strings_csv
from .shared import fresh, keep

KINDS = {"csv": ",", "tsv": "\t", "parquet": None}
MOST_ROWS_A_PAGE = 500
LARGE = 100_000


def tables(spark: SparkSession, folder: str, read_only: tuple[str, ...] = ("derived",)) -> list[dict]:
    """Name, path, kind, rows and flags of every CSV, TSV and Parquet table below a folder.

    ``a/b.csv`` is named ``a__b``. Files are listed by Hadoop's file system, so
    a folder may be in any store; rows are counted by Spark.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(root).getPath().toString().rstrip("/") + "/"
    found, folders = [], [root]
    while folders:
        for status in fs.listStatus(folders.pop()):
            path = status.getPath().toString()
            kind = path.rpartition(".")[2].lower()
            if kind in KINDS:
                name = path.removeprefix(base).rpartition(".")[0].replace("/", "__")
                found.append({"name": name, "path": path, "kind": kind, "read_only": any(x in path for x in read_only)})
            elif status.isDirectory():
                folders.append(status.getPath())
    counts = [read(spark, t["path"]).agg(F.lit(t["path"]).alias("path"), F.count(F.lit(1)).alias("n")) for t in found]
    rows = {r.path: r.n for r in reduce(DataFrame.union, counts).collect()} if counts else {}  # a row for each table
    for t in found:
        t["rows"] = rows[t["path"]]
        t["is_large"] = t["rows"] > LARGE
    return sorted(found, key=lambda t: t["name"])


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rpartition(".")[2].lower()
    return spark.read.parquet(path) if kind == "parquet" else strings_csv(spark, path, sep=KINDS[kind])


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings, with empty strings for nulls."""
    df = read(spark, path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def cached(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings that stays in memory, spilling to disk, until ``forget`` or ``replace``."""
    return load(spark, path).persist()


def forget(spark: SparkSession, path: str) -> None:
    """Drop what is cached of a table, as after it has changed."""
    if exists(spark, path):
        load(spark, path).unpersist()
    spark.catalog.refreshByPath(path)


def numbered(df: DataFrame, order: list) -> DataFrame:
    """``row_index`` from 0 in the given order (names or sort columns).

    Rows are range-sorted and written once with their place inside their
    partition, so that both the counts and the rows see the same partitions;
    a row's index is its place and the number of rows in the partitions before.
    """
    at = fresh("_at", df.columns)
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(before, F.shiftright(at, 33) == F.col("_part")).withColumn("row_index", F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, "_part", "_before")


def prefix_sums(df: DataFrame, key: str, order: str, values: dict[str, str]) -> DataFrame:
    """Sums of ``values`` (new name: column) over the rows before each one, by key in the given order.

    Rows are range-sorted by key and order; sums inside a partition and over
    the partitions before add up, so a key of any size is spread over tasks.
    """
    placed = keep(df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_part", F.spark_partition_id()), "sorted")
    inside = Window.partitionBy("_part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a key
    parts = placed.groupBy(key, "_part").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    parts = parts.select(key, "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    rows = placed.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(parts, [key, "_part"])
    return rows.select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in values])


def tiles(df: DataFrame, order: list, n: int, name: str = "tile") -> DataFrame:
    """Tiles 1 to ``n`` of near-equal size in the given order, the larger ones first."""
    indexed = numbered(df, order)
    every = df.agg(F.count(F.lit(1))).scalar()
    i, q, more = F.col("row_index"), F.floor(every / n), every % n
    tile = F.when(i < more * (q + 1), F.floor(i / (q + 1))).otherwise(more + F.floor((i - more * (q + 1)) / F.greatest(q, F.lit(1))))
    return indexed.withColumn(name, (tile + 1).cast("int")).drop("row_index")


def page(df: DataFrame, offset: int, limit: int, index: str = "row_index") -> DataFrame:
    """Rows ``offset`` and on, ``limit`` of them."""
    if offset < 0 or not 1 <= limit <= MOST_ROWS_A_PAGE:
        raise ValueError(f"offset must be 0 or more and limit 1 to {MOST_ROWS_A_PAGE}")
    return df.where(F.col(index).between(offset, offset + limit - 1))


def edited(df: DataFrame, edits: DataFrame, adds: DataFrame | None = None, index: str = "row_index") -> DataFrame:
    """The table after cell edits ``row_index, column, value`` (the last by ``seq`` wins) and appended rows.

    Columns that the table lacks are ignored; an index out of range is an error.
    """
    names = [c for c in df.columns if c != index]
    rows = df.agg(F.count(F.lit(1))).first()[0]
    if not edits.where((F.col(index) < 0) | (F.col(index) >= rows)).isEmpty():
        raise ValueError("an edit is out of range")
    last = edits.where(F.col("column").isin(names)).groupBy(index, "column").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy(index).pivot("column", names).agg(F.first("value"))
    wide = wide.select(index, *[F.col(c).alias(f"_e_{c}") for c in names])
    out = df.join(wide, index, "left").select(index, *[F.coalesce(f"_e_{c}", c).alias(c) for c in names])
    if adds is None:
        return out
    new = numbered(adds.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in adds.columns else F.lit("").alias(c) for c in names]), names)
    return out.unionByName(new.withColumn(index, F.col(index) + rows))


def replace(df: DataFrame, path: str) -> None:
    """Write beside the table, then move the old one aside and the new one into place.

    Both moves are renames; should the second fail, the old table is moved
    back. Between them the path is missing for a moment, as file systems have
    no exchange of two folders: readers that may run then should try again.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    mark = uuid.uuid4().hex
    target, beside, aside = hadoop.Path(path), hadoop.Path(f"{path}.{mark}"), hadoop.Path(f"{path}.{mark}.old")
    df.write.parquet(beside.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = exists(spark, path)
    if held and not fs.rename(target, aside):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(beside, target):
        if held:
            fs.rename(aside, target)
        raise OSError(f"the new table could not be moved to {path}")
    if held:
        fs.delete(aside, True)
    forget(spark, path)


def search(df: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Rows that hold a text, whatever its case; the text is no pattern."""
    return df.where(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column).limit(limit)
