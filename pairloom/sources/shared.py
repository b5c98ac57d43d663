"""Tables that cut lineage, kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def keep(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with options of the Parquet writer, and return a reader of that table.

    Unlike a cached block, the table survives the loss of any executor. Later
    jobs neither recompute its lineage nor hold it in memory, and plan with
    the size of its files: estimates that a checkpoint would carry on double
    with every join of an iteration.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *taken: list[str]) -> str:
    """A column name like ``name`` that no table with the columns ``taken`` has, whatever their case."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name += "_"
    return name
