"""Readers and writers of the formats that evidence arrives in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import whole


def strings_csv(spark: SparkSession, path, columns: list[str] | None = None, sep: str = ",", comment: str | None = None) -> DataFrame:
    """A CSV or TSV with every column a string; lines that start with ``comment`` are skipped."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def tolerant_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As many rows of a CSV as fit the schema; none if there is no file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(schema).csv(path)


def whole_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is a whole number, cast; none if the column is missing."""
    if column not in df.columns:
        return df.limit(0)
    return df.withColumn(column, whole(F.col(column))).where(F.col(column).isNotNull())


def text_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column has text, trimmed; none if the column is missing."""
    if column not in df.columns:
        return df.limit(0)
    return df.withColumn(column, F.trim(F.col(column).cast("string"))).where(F.col(column) != "")


def records(spark: SparkSession, path, schema: StructType | str) -> DataFrame:
    """JSON lines; a line that is no JSON is skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema, in its order and types; a value that does not fit and a column that is missing are null, others go."""
    there = {c.lower(): c for c in df.columns}
    pick = lambda f: F.col(f"`{there[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in there else F.lit(None).cast(f.dataType)
    return df.select(*[pick(f).alias(f.name) for f in schema])


def write(df: DataFrame, path: str, kind: str, schema: StructType | None = None) -> None:
    """Write a table as ``parquet``, ``csv`` (with a header), ``tsv`` or ``json``, in a schema if one is given."""
    writer = (conform(df, schema) if schema else df).write.mode("overwrite")
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if kind == "csv" else "\t").option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(kind).save(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_checked(rows: DataFrame, path: str, catalogs: dict[str, DataFrame], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Append the rows whose keys are in the catalogs and whose values are allowed; returns the others with the reason."""
    reason = F.lit(None).cast("string")
    for column, values in allowed.items():
        reason = F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), F.lit(f"bad {column}")).otherwise(reason)
    checked = rows.withColumn("reason", reason)
    for column, catalog in catalogs.items():
        known = catalog.select(F.col(column)).distinct().withColumn("_known", F.lit(True))
        checked = checked.join(known, column, "left").withColumn("reason", F.when(F.col("_known").isNull(), F.lit(f"unknown {column}")).otherwise(F.col("reason"))).drop("_known")
    checked.where("reason is null").select(*rows.columns).write.mode("append").option("header", True).csv(path)
    return checked.where("reason is not null")


def blocks(spark: SparkSession, path, separator: str) -> DataFrame:
    """``block``: text files cut at a line that is the separator (an empty one for ``""``), whatever their line ends.

    A file is read as one row and cut by an expression, since a separator that
    a reader is given may be of one form only and would also cut inside lines.
    """
    whole = F.regexp_replace("value", "\\r\\n?", "\n")
    cut = r"\n(?:[ \t]*\n)+" if not separator else rf"(?:\A|\n){separator}[ \t]*(?=\n|\z)"
    each = spark.read.text(path, wholetext=True).select(F.explode(F.split(whole, cut)).alias("block"))
    return each.select(F.regexp_replace("block", r"\A\s*\n|\s+\z", "").alias("block")).where("trim(block) <> ''")


def field_values(block: Column, name: str) -> Column:
    """All values of ``name: value`` lines of a block."""
    return F.regexp_extract_all(block, F.lit(rf"(?m)^{name}: *(.*)$"), F.lit(1))


def obo_terms(spark: SparkSession, path, keep_obsolete: bool = True, scopes: tuple[str, ...] | None = None) -> DataFrame:
    """Terms of an OBO file: ``term_id, name, parents, synonyms, xrefs, is_obsolete, replaced_by``.

    Synonyms of all scopes, or of those named.
    """
    block = F.col("block")
    terms = blocks(spark, path, "").where(block.startswith("[Term]"))
    first = lambda name: F.get(field_values(block, name), F.lit(0))
    bare = lambda values: F.transform(values, lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"\s*!.*$", ""), r"\s*\{.*\}\s*$", "")))
    scoped = field_values(block, "synonym")
    if scopes:
        scoped = F.filter(scoped, lambda v: F.regexp_extract(v, r'^"[^"]*" ([A-Z]+)', 1).isin(*scopes))
    out = terms.select(
        first("id").alias("term_id"),
        first("name").alias("name"),
        bare(field_values(block, "is_a")).alias("parents"),
        F.transform(scoped, lambda v: F.regexp_extract(v, r'^"([^"]*)"', 1)).alias("synonyms"),
        F.transform(field_values(block, "xref"), lambda v: F.regexp_extract(v, r"^(\S+)", 1)).alias("xrefs"),
        F.coalesce(first("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
        first("replaced_by").alias("replaced_by"),
    ).where("term_id is not null")
    return out if keep_obsolete else out.where("not is_obsolete")


def flat_records(spark: SparkSession, path) -> DataFrame:
    """``entry, field, lines`` of a flat file with 12-character field names, continued lines and ``///`` between records."""
    block = blocks(spark, path, "///").withColumn("entry", F.regexp_extract("block", r"(?m)^ENTRY {1,11}(\S+)", 1))
    line = block.select("entry", F.posexplode(F.split("block", "\n")).alias("at", "line"))
    named = line.withColumns({"name": F.nullif(F.trim(F.substring("line", 1, 12)), F.lit("")), "value": F.trim(F.expr("substring(line, 13)"))})
    pieces = named.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("at", "name", "value"))).alias("x"))
    start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<field:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = F.coalesce(x["name"], acc["now"])
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(F.struct(now.alias("field"), x["value"].alias("value")))).alias("out"))

    each = pieces.select("entry", F.posexplode(F.aggregate("x", start, step)["out"]).alias("i", "y")).where("y.field is not null")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("i", "y.value"))), lambda x: x["value"])
    return each.groupBy("entry", "y.field").agg(lines.alias("lines"))


def scan(spark: SparkSession, paths: list[str], columns: dict[str, str], column: str, values: list) -> DataFrame:
    """Parquet files as one table: chosen columns, renamed, of the rows whose ``column`` has one of the values."""
    df = spark.read.parquet(*paths).where(F.col(column).isin(values))
    return df.select(*[F.col(k).alias(v) for k, v in columns.items()]).distinct()
