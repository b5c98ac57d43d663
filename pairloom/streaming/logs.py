"""Append-only event logs, batch and streaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.catalog import numbered
from ..sources.versions import publish, read_text, remove, spark_files

EVENT = "id string, event string, ts string, label string, metric double, supersedes string, failed boolean"


def current(events: DataFrame) -> DataFrame:
    """Events that no later event supersedes."""
    gone = events.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    return events.join(gone, "id", "left_anti")


def latest(events: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last event of each key."""
    values = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(order, tie)).alias("_last"))
    return last.select(key, "_last.*")


def leaderboard(events: DataFrame, label: str) -> DataFrame:
    """Completed, not failed runs of a label, best metric first, with their rank."""
    begun = events.where((F.col("event") == "register") & (F.col("label") == label)).select("id", "label")
    done = events.where((F.col("event") == "complete") & ~F.coalesce("failed", F.lit(False))).select("id", "metric")
    ranked = numbered(begun.join(done, "id"), [F.col("metric").desc_nulls_last(), F.col("id")])
    return ranked.withColumn("rank", (F.col("row_index") + 1).cast("int")).drop("row_index")


class Scorer:
    """Scores new candidates of a folder of Parquet files once each, in bounded micro-batches, until it is stopped.

    Which pairs are done is the stream's own keyed state, kept by its
    checkpoint: no batch reads what earlier ones wrote. A batch is committed
    under its number in one step, so one that is replayed after a failure adds
    nothing twice. Candidates without the ``required`` column go. A failure
    ends the run and is shown by ``status``; the next ``start`` takes the batch
    up again. A batch is a folder of its own or, with ``one_file``, one file of
    a flat table, for small batches. Without an event time the state grows with the pairs; with one,
    pairs are told apart within ``delay``.
    """

    def __init__(self, spark: SparkSession, source: str, schema: str, keys: list[str], score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_batch: int = 1, required: str | None = None, time: str | None = None, delay: str = "1 hour", one_file: bool = False):
        self.spark, self.source, self.schema, self.keys, self.score = spark, source, schema, keys, score
        self.out, self.checkpoint, self.files_a_batch, self.required, self.time, self.delay = out, checkpoint, files_a_batch, required, time, delay
        self.one_file = one_file
        self.query: StreamingQuery | None = None
        self.batches, self.last_error = 0, None

    def candidates(self) -> DataFrame:
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_a_batch).parquet(self.source)
        if self.required:
            stream = stream.where(F.col(self.required).isNotNull())
        return distinct_stream(stream, self.keys, self.time, self.delay)

    def _add(self, batch: DataFrame, number: int) -> None:
        run = json.loads(read_text(self.spark, f"{self.checkpoint}/metadata"))["id"]  # the same after a restart
        beside = f"{self.out}/.{uuid.uuid4().hex}"
        scored = self.score(batch)
        if self.one_file:
            scored.repartition(1).write.parquet(beside)
            [part] = spark_files(self.spark, beside)
            publish(self.spark, part, f"{self.out}/{run}-{number}.parquet")
            remove(self.spark, beside)
        else:
            scored.write.parquet(beside)
            publish(self.spark, beside, f"{self.out}/run={run}/batch={number}")
        self.batches += 1

    def start(self, interval: str | None = None) -> dict:
        """Begin, or go on; every ``interval`` if there is one, else until all that is there is scored. A run that is on goes on."""
        if self.query is None or not self.query.isActive:
            self.last_error = None
            trigger = {"processingTime": interval} if interval else {"availableNow": True}
            self.query = self.candidates().writeStream.foreachBatch(self._add).option("checkpointLocation", self.checkpoint).trigger(**trigger).start()
        return self.status()

    def wait(self, seconds: float | None = None) -> dict:
        """Until the run ends, or for so many seconds."""
        try:
            self.query.awaitTermination(seconds) if seconds else self.query.awaitTermination()
        except StreamingQueryException as e:
            self.last_error = str(e).splitlines()[0]
        return self.status()

    def stop(self) -> dict:
        if self.query is not None:
            self.query.stop()
        return self.status()

    def status(self) -> dict:
        """``running, batches, scored, last_error``; ``scored`` are the keys in the state."""
        q = self.query
        error = q.exception() if q is not None else None
        progress = q.lastProgress if q is not None else None
        held = sum(op.numRowsTotal for op in progress.stateOperators) if progress else 0
        return {"running": q is not None and q.isActive, "batches": self.batches, "scored": held, "last_error": str(error).splitlines()[0] if error else self.last_error}

    def results(self) -> DataFrame:
        return self.spark.read.parquet(self.out).drop("run", "batch")  # of the folders, where there are any


def score_stream(spark: SparkSession, source: str, schema: str, keys: list[str], score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Score what a folder of Parquet files holds now, and end; ``out`` is a flat table with a file for each batch."""
    scorer = Scorer(spark, source, schema, keys, score, out, checkpoint, one_file=True)
    scorer.start()
    return scorer.query


def distinct_stream(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once; with an event time the state is bounded by a watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def run_stages(stages: list[tuple[str, Callable[[], None]]], record: Callable[[dict], None]) -> list[dict]:
    """Run stages in order, recording each one's outcome; a failure ends the run."""
    import time

    runs = []
    for name, stage in stages:
        began = time.time()
        try:
            stage()
            status, error = "ok", None
        except NotImplementedError:
            status, error = "not_implemented", None
        except Exception as e:  # the outcome of any failure is recorded
            status, error = "failed", str(e)[:500]
        runs.append({"stage": name, "status": status, "error": error, "elapsed": time.time() - began})
        record(runs[-1])
        if status == "failed":
            break
    return runs
