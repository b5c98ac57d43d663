"""An append-only notebook of experiments: entries are checked, committed as a whole, and never changed.

A correction is a new entry that names the one it supersedes. The notebook is
a folder of commits; each appears in one step and is named by its key, so a
commit that is tried again adds nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.catalog import numbered
from ..sources.files import exists
from ..sources.versions import publish

ENTRY = "id string, event string, ts timestamp, agent string, kind string, title string, body string, label string, metrics map<string,double>, findings string, supersedes string, failed boolean, used_test_set boolean"
# Labels that an experiment may be registered for.
LABELS = ("y_faers_signal", "y_semmeddb_causes", "y_semmeddb_treats", "y_any_harm", "faers_prr", "other")


def reason(labels: tuple[str, ...] = LABELS) -> Column:
    """Why an entry is refused; null for a good one."""
    event = F.col("event")
    empty = F.col("metrics").isNull() | (F.size("metrics") == 0)
    return (
        F.when(F.col("id").isNull() | (F.trim("id") == ""), "no id")
        .when((event == "register") & ~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "unknown label")
        .when((event == "complete") & empty, "no metrics")
        .when((event == "complete") & (F.trim(F.coalesce("findings", F.lit(""))) == ""), "no findings")
        .when(~F.coalesce(event.isin("register", "complete", "note"), F.lit(False)), "unknown event")
    )


def refused(entries: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Entries that break a rule, with the ``reason``."""
    return entries.withColumn("reason", reason(labels)).where("reason is not null")


def commit(entries: DataFrame, path: str, key: str, labels: tuple[str, ...] = LABELS) -> bool:
    """Append all entries or none; False if a commit of this key is there already.

    One entry that breaks a rule refuses the whole commit. Entries without a
    time get the time of the commit. Columns that are missing are null.
    """
    spark = entries.sparkSession
    target = f"{path}/commit={hashlib.sha256(key.encode()).hexdigest()[:32]}"
    if exists(spark, target):
        return False
    there = set(entries.columns)
    shape = spark.createDataFrame([], ENTRY).schema
    rows = entries.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in shape])
    bad = refused(rows, labels).select("id", "reason").limit(5).collect()  # an example or five
    if bad:
        raise ValueError("refused: " + ", ".join(f"{r.id}: {r.reason}" for r in bad))
    beside = f"{path}/.{uuid.uuid4().hex}"  # readers pass over names that begin with a dot
    rows.withColumn("ts", F.coalesce("ts", F.current_timestamp())).write.parquet(beside)
    return publish(spark, beside, target)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of every commit; none without a notebook."""
    if not exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("basePath", path).parquet(path).drop("commit")


def current(entries: DataFrame) -> DataFrame:
    """Entries but those that another entry supersedes. An outcome of an experiment is superseded by naming its id; its own later outcome stays."""
    gone = entries.where(F.col("supersedes").isNotNull() & (F.col("supersedes") != F.col("id"))).select(F.col("supersedes").alias("id")).distinct()
    return entries.join(gone, "id", "left_anti")


def notes(entries: DataFrame, kind: str | None = None) -> DataFrame:
    found = entries.where("event = 'note'")
    return found if kind is None else found.where(F.col("kind") == kind)


def leaderboard(entries: DataFrame, metric: str = "validate_average_precision", label: str | None = None) -> DataFrame:
    """``rank, id, agent, title, label, metric, used_test_set`` of the outcomes that are not failed and have the metric, best first."""
    begun = entries.where("event = 'register'").select("id", "agent", "title", "label")
    done = entries.where((F.col("event") == "complete") & ~F.coalesce("failed", F.lit(False)))
    scored = done.select("id", F.try_element_at("metrics", F.lit(metric)).alias("metric"), "used_test_set", "ts").where("metric is not null").join(begun, "id", "left")
    if label is not None:
        scored = scored.where(F.col("label") == label)
    ranked = numbered(scored, [F.col("metric").desc(), F.col("id"), F.col("ts")])
    return ranked.select((F.col("row_index") + 1).alias("rank"), "id", "agent", "title", "label", "metric", "used_test_set")


def reports(metrics: str = "metrics", word: str = "validate") -> Column:
    """Whether any metric of an outcome is one of the validation set."""
    return F.coalesce(F.exists(F.map_keys(metrics), lambda k: F.contains(k, F.lit(word))), F.lit(False))


def evaluations(entries: DataFrame, by: str | None = None) -> DataFrame:
    """``id, ts, evaluation``: outcomes that report a validation metric, with their running number (of each ``by``).

    A high number means that the validation set has been asked often, and that
    small differences are noise. An agent's outcomes are those of the
    experiments that it registered.
    """
    done = entries.where(F.col("event") == "complete").where(reports()).select("id", "ts")
    if by is None:
        return numbered(done, ["ts", "id"]).select("id", "ts", (F.col("row_index") + 1).alias("evaluation"))
    begun = entries.where("event = 'register'").groupBy("id").agg(F.max_by(by, "ts").alias(by))
    own = Window.partitionBy(by).orderBy("ts", "id")  # the outcomes of one agent
    return done.join(begun, "id").withColumn("evaluation", F.row_number().over(own).cast("long"))
