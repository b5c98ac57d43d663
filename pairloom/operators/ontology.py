"""Is-a graphs held as edges ``child, parent``."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

#: After so many levels what is known becomes one table, for short plans.
LEVELS_A_TABLE = 16


def closure(edges: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``term, ancestor, distance``: all ancestors, the term itself left out, with the shortest distance.

    Parents that are no terms are ignored. Each round extends the newest
    pairs by one edge and drops those already known, so that diamonds don't
    multiply and cycles end. Rounds go on until there is no new pair.
    """
    edges = edges.select(F.col("child"), F.col("parent")).where("child is not null and parent is not null and child <> parent").distinct()
    if terms is not None:
        edges = edges.join(terms.select(F.col("term").alias("parent")), "parent", "left_semi").join(terms.select(F.col("term").alias("child")), "child", "left_semi")
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
    known = newest = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    for level in count(2):
        longer = newest.join(up, "ancestor").select("term", F.col("_next").alias("ancestor")).where("term <> ancestor").distinct()
        newest = keep(longer.join(known, ["term", "ancestor"], "left_anti").withColumn("distance", F.lit(level)))
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
        if level % LEVELS_A_TABLE == 0:
            known = keep(known)
    return known


def descendants(closed: DataFrame) -> DataFrame:
    return closed.select(F.col("ancestor").alias("term"), F.col("term").alias("descendant"), "distance")


def depth(closed: DataFrame, terms: DataFrame, root) -> DataFrame:
    """``term, depth``: shortest way to the root; null if there is none."""
    below = closed.where(F.col("ancestor") == F.lit(root)).select("term", F.col("distance").alias("depth"))
    return terms.join(below, "term", "left").select("term", F.when(F.col("term") == F.lit(root), 0).otherwise(F.col("depth")).alias("depth"))


def specific(annotated: DataFrame, edges: DataFrame, value: str = "gene") -> DataFrame:
    """Annotations of a term that none of its children has."""
    of_children = edges.join(annotated.withColumnRenamed("term", "child"), "child").select(F.col("parent").alias("term"), value)
    return annotated.join(of_children, ["term", value], "left_anti")


def information_content(annotated: DataFrame, root, value: str = "gene") -> DataFrame:
    """``term, n, information_content``: -ln of the share of the root's annotations, at least 0; empty without a root."""
    counts = annotated.groupBy("term").agg(F.count_distinct(value).alias("n"))
    top = counts.where(F.col("term") == F.lit(root)).select(F.col("n").alias("_root")).agg(F.max("_root")).scalar()
    scored = counts.withColumn("_root", top).where("_root is not null")
    return scored.select("term", "n", F.greatest(F.lit(0.0), -F.log(F.col("n") / F.col("_root"))).alias("information_content"))


def generality(counts: DataFrame, priority: str = "priority") -> DataFrame:
    """``term, n_descendants`` from several sources; the source of lowest priority number wins."""
    return counts.groupBy("term").agg(F.min_by("n_descendants", priority).alias("n_descendants"))


def not_too_general(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Rows whose term has at most ``limit`` descendants; an unknown number passes."""
    return rows.where(F.col("n_descendants").isNull() | (F.col("n_descendants") <= limit))


def term_xrefs(terms: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """``id, source, code`` of the cross references of each term."""
    from ..functions.text import colon_id, xref

    each = terms.select(colon_id(F.col(id_col)).alias("id"), F.explode(list_col).alias("_x")).select("id", xref(F.col("_x")).alias("_x"))
    return each.where("_x is not null").select("id", "_x.source", "_x.code").distinct()


def merged_terms(first: DataFrame, sssom: DataFrame) -> DataFrame:
    """Terms of the first source, and of the mapping file those that it lacks."""
    more = sssom.select(F.col("subject_id").alias("id"), F.col("subject_label").alias("name")).distinct().join(first, "id", "left_anti")
    return first.select("id", "name").unionByName(more)


def exact_xrefs(sssom: DataFrame) -> DataFrame:
    return sssom.where(F.col("predicate_id") == "skos:exactMatch").select("subject_id", "object_id").distinct()


def tree_rows(records: DataFrame, id_col: str, children: str, levels: int) -> DataFrame:
    """``root, id, depth`` of records whose children are nested arrays, down to ``levels``."""
    now = records.select(F.col(id_col).alias("root"), F.col(id_col).alias("id"), F.lit(0).alias("depth"), F.col(children).alias("_below"))
    out = now.select("root", "id", "depth")
    for level in range(1, levels + 1):
        field = now.schema["_below"].dataType.elementType.names if now.schema["_below"].dataType.typeName() == "array" else []
        if id_col not in field:
            break
        opened = now.select("root", F.explode("_below").alias("x"))
        now = opened.select("root", F.col(f"x.{id_col}").alias("id"), F.lit(level).alias("depth"), (F.col(f"x.{children}") if children in field else F.lit(None).cast("string")).alias("_below"))
        out = out.unionByName(now.select("root", "id", "depth"))
    return out


def json_tree(records: DataFrame, seed: str, tree: str, fields: str, children: str = "children", level: str | None = "level") -> DataFrame:
    """Nodes of trees in JSON texts, of any depth: ``seed``, the named fields and ``level``.

    ``fields`` is a schema like ``id string, name string``. A tree's top is
    always listed; below it, nodes without children of their own are not, as
    they are no ancestors of what the tree was asked for. A node's level is
    what it says of itself in the field ``level``, else its depth, the top
    being at 1. A text that is no JSON object has no nodes. Each round opens
    one level and writes what is open, until nothing is; the text of a branch
    is read once for each level above its end.
    """
    own = f", {level} int" if level else ""
    inner = f"struct<{fields}{own}, {children} array<string>, _bad string>"  # a child's text stays text
    whole = {"columnNameOfCorruptRecord": "_bad"}
    now = records.select(F.col(seed).alias(seed), F.from_json(tree, inner, whole).alias("_node")).where("_node is not null and _node._bad is null")
    names = [c.strip().split()[0] for c in fields.split(",")]
    out = None
    for depth in count(1):
        now = keep(now.select(seed, "_node"), "level")
        if depth > 1 and now.isEmpty():
            return out
        at = F.coalesce(F.col(f"_node.{level}"), F.lit(depth)) if level else F.lit(depth)
        rows = now.select(seed, *[F.col(f"_node.{n}").alias(n) for n in names], at.alias("level"))
        out = rows if out is None else out.unionByName(rows)
        if depth % LEVELS_A_TABLE == 0:
            out = keep(out, "tree")
        opened = now.select(seed, F.explode(f"_node.{children}").alias("_text"))
        now = opened.select(seed, F.from_json("_text", inner, whole).alias("_node")).where(F.size(f"_node.{children}") > 0)


def term_context(terms: DataFrame, ancestors: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalars of each term, and its ancestors as a long table.

    ``ancestors`` are ``term, ancestor, ancestor_name, distance`` with the term
    itself at 0, which is no ancestor. The scalars are the columns of
    ``terms``, ``n_ancestors`` and ``depth`` (the largest distance), null for a
    term without ancestors, and ``n_synonyms``, null for one without.
    """
    above = ancestors.where("distance > 0")
    of_term = above.groupBy("term").agg(F.count(F.lit(1)).alias("n_ancestors"), F.max("distance").alias("depth"))
    named = synonyms.groupBy("term").agg(F.count(F.lit(1)).alias("n_synonyms"))
    return terms.join(of_term, "term", "left").join(named, "term", "left"), above.select("term", "ancestor", "ancestor_name", "distance")
