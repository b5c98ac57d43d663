"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words and their first letters, which catch inflected
and compound forms. Terms are hashed to buckets; the buckets that tell labels
apart beyond chance, all tests taken together, are the features. A factorization machine gives
each of them a weight and a vector, and each pair of them the product of their
vectors, so that an insult counts differently next to the mention of a group
than alone, which a sum of weights cannot express.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import HashingTF, UnivariateFeatureSelector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import keep

#: Labelled documents that the model is fitted on, at most about; the sample is drawn by id over all labels.
SAMPLE_DOCS = 20_000
#: Parts in which the sample is kept: its size is bounded, so their number is fixed.
SAMPLE_PARTS = 12
BUCKETS = 1 << 18
#: Chance that any bucket at all is chosen without bearing on the label (chi-squared tests with Bonferroni's bound).
ERROR = 0.05
#: Letters of the shorter forms of a word.
STEMS = (4, 5)
FACTORS, ROUNDS, STEP, PENALTY, SEED = 4, 60, 0.1, 1e-4, 42
HELD_OUT_OF = 5


def terms(text: Column) -> Column:
    """Distinct terms of a text: words of letters in lower case, and the first letters of longer ones, marked."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("-"))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from; a row without an id has no label and is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """``text, label`` of labelled rows that are not held out: all of them or, beyond ``most``, as many by a hash of the id.

    One label an id: toxic where any row says so. Of rows that repeat an id one text is taken.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max((F.col(label_col) > 0).cast("double")).alias("label"))
    share = min(1.0, most / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample's ids are bounded by ``most``
    return texts.join(F.broadcast(drawn), "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))


def fit(train: DataFrame, error: float = ERROR) -> PipelineModel | float:
    """The model of a table ``_id, label, text``; without labels of both kinds, or a bucket that tells them apart, the labels' mean (0 for none)."""
    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="terms", outputCol="hashed")
    hashed = hashing.transform(train.select("_id", "label", terms(F.col("text")).alias("terms"))).select("_id", "label", "hashed")
    hashed = keep(hashed.repartition(SAMPLE_PARTS, "_id").sortWithinPartitions("_id"), "labelled", compression="zstd")
    kinds = {row.label: row["count"] for row in hashed.groupBy("label").count().collect()}
    mean = sum(label * n for label, n in kinds.items()) / max(1, sum(kinds.values()))
    if len(kinds) < 2:
        return mean
    selector = UnivariateFeatureSelector(featuresCol="hashed", labelCol="label", outputCol="features", selectionMode="fwe")
    selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(error)
    machine = FMClassifier(featuresCol="features", labelCol="label", factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=PENALTY, solver="adamW", seed=SEED, tol=0.0)
    chosen = selector.fit(hashed)
    if not chosen.selectedFeatures:
        return mean
    return PipelineModel([hashing, chosen, machine.fit(chosen.transform(hashed))])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_DOCS, error: float = ERROR) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The score depends on the text alone, whole; a null or empty text has the
    score of no terms. Labels with a null id or a null label, and ids without
    a document, teach nothing. Repeated rows and null ids are scored like any
    others. Without labels of both kinds, or any term that tells them apart,
    every score is the labels' mean, 0 without any. Other columns are not read.
    """
    model = fit(sample(docs, labels, id_col, text_col, label_col, most), error)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), terms(F.col(text_col)).alias("terms"))
    if isinstance(model, PipelineModel):
        scored = model.transform(narrow).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = narrow.withColumn("score", F.lit(float(model)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
