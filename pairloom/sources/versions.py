"""Tables in versions: a commit appears in one step, and readers never find a table missing.

``publish`` moves a finished folder or file to a name that must be free; of two
writers that want the same name one fails. A version is a folder of Parquet
files and a manifest of its number that names it. The highest manifest is the
current version, so a commit is the appearance of one small file, and a reader
that has begun on an older version finds its files still there.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class Conflict(RuntimeError):
    """Another writer was first."""


def _paths(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename ``source`` to ``target`` in one step; False, and ``source`` removed, if the target is there already."""
    old, fs = _paths(spark, source)
    new, _ = _paths(spark, target)
    fs.mkdirs(new.getParent())
    names = spark._jvm.org.apache.hadoop.fs
    context = names.FileContext.getFileContext(fs.makeQualified(old).toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(names.Options.Rename, 1)
    options[0] = names.Options.Rename.NONE  # never over something
    try:
        context.rename(fs.makeQualified(old), fs.makeQualified(new), options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(old, True)
        return False


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _paths(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _paths(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _paths(spark, path)
    fs.delete(where, True)


def spark_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder that Spark has written."""
    where, fs = _paths(spark, folder)
    return [s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")]


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions, oldest first."""
    where, fs = _paths(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def commit(df: DataFrame, root: str, expected: int | None = None) -> int:
    """Write a table as the next version and return its number, from 1.

    ``expected`` is the version that the writer has read (0 for none): if
    another one is current by then, nothing is committed and ``Conflict`` is
    raised. Without it the writer that comes later has the later version.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    manifest = f"{root}/{MANIFESTS}/.{folder}"
    _, fs = _paths(spark, root)
    text = json.dumps({"folder": folder, "schema": df.schema.jsonValue()})
    while True:
        last = max(numbers(spark, root), default=0)
        if expected is None or expected == last:
            fs.mkdirs(_paths(spark, f"{root}/{MANIFESTS}")[0])
            write_text(spark, manifest, text)
            if publish(spark, manifest, f"{root}/{MANIFESTS}/{last + 1}.json"):
                return last + 1
        if expected is not None:
            remove(spark, f"{root}/{folder}")
            raise Conflict(f"{root} is no longer at version {expected}")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version, or the one of a number; an error if there is none."""
    from pyspark.sql.types import StructType

    known = numbers(spark, root)
    version = version if version is not None else max(known, default=0)
    if version not in known:
        raise AnalysisException(f"{root} has no version {version}")
    manifest = json.loads(read_text(spark, f"{root}/{MANIFESTS}/{version}.json"))
    return spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{root}/{manifest['folder']}")


def forget_old(spark: SparkSession, root: str, last: int = 2) -> list[int]:
    """Remove all but the ``last`` versions, for when no reader is left on them; returns the numbers removed."""
    gone = numbers(spark, root)[:-last] if last else []
    for n in gone:
        name = f"{root}/{MANIFESTS}/{n}.json"
        folder = json.loads(read_text(spark, name))["folder"]
        remove(spark, name)
        remove(spark, f"{root}/{folder}")
    return gone
