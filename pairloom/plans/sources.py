"""Queries that write the given tables in some format, or put them into a stream or version, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import mapping as M
from ..operators import network as N
from ..operators import ontology as O
from ..sources import catalog, files, versions
from ..sources.shared import keep, shared_dir
from ..streaming import logs
from . import base as B

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ', "' || p_brand || '"' AS name, CASE WHEN p_size % 6 > 0 THEN p_type END AS kind FROM part""")
def string_csv(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a CSV as strings, with quotes and commas inside values."""
    part, path = B.table(spark, d, "part"), place(spark, "csv")
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    files.write(part.select(F.col("p_partkey").alias("id"), name.alias("name"), "p_size", F.when(F.col("p_size") % 6 > 0, F.col("p_type")).alias("kind")), path, "csv")
    return files.strings_csv(spark, path, ["id", "name", "kind"])


@query("SELECT 'k' || p_partkey AS id, p_name AS name FROM part WHERE p_size % 9 > 0")
def commented_tsv(spark: SparkSession, d: str) -> DataFrame:
    """A TSV some of whose lines are comments; each file has a note and a header first."""
    part, path = B.table(spark, d, "part"), place(spark, "tsv")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.concat(F.when(F.col("p_size") % 9 == 0, "#").otherwise("k"), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name")
    part.select(F.concat(F.when(first, F.lit("# a note\nid\tname\n")).otherwise(""), line)).write.text(path)
    return files.strings_csv(spark, path, sep="\t", comment="#")


@query("SELECT p_size AS n, p_name AS name, p_partkey AS id, trim(p_type) AS label FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 4 > 0 AND p_size % 5 > 0")
def tolerant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that fit the schema, then rows with a whole id and a label."""
    part, path = B.table(spark, d, "part"), place(spark, "tolerant")
    key = F.col("p_partkey")
    rows = part.select(
        F.when(key % 7 == 0, "bad").otherwise(F.col("p_size").cast("string")).alias("n"),
        F.col("p_name").alias("name"),
        F.when(key % 4 == 0, "none").otherwise(F.concat(key.cast("string"), F.lit(".0"))).alias("id"),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit(" "), "p_type")).otherwise(" ").alias("label"),
    )
    files.write(rows, path, "csv")
    found = files.tolerant_csv(spark, path, spark.createDataFrame([], "n int, name string, id string, label string").schema)
    return files.text_rows(files.whole_rows(found, "id"), "label")


@query("SELECT DISTINCT p_name AS name, p_type AS kind FROM part WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#12')")
def projected_scan(spark: SparkSession, d: str) -> DataFrame:
    return files.scan(spark, [f"{d}/part.parquet"], {"p_name": "name", "p_type": "kind"}, "p_brand", ["Brand#1", "Brand#7", "Brand#12"])


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of two writers, among lines that are no JSON."""
    customer, supplier, path = B.table(spark, d, "customer"), B.table(spark, d, "supplier"), place(spark, "lines")
    files.append_records(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), path)
    files.append_records(supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), path)
    customer.where("c_custkey % 5 = 0").select(F.concat(F.lit('{"id": '), F.col("c_custkey").cast("string"))).write.mode("append").text(path)
    return files.records(spark, path, "id long, name string, balance double")


@query("""SELECT 'C' || c_custkey AS term_id, c_name AS name, 'N' || c_nationkey AS parents, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS synonyms, c_custkey % 8 = 0 AS is_obsolete, CASE WHEN c_custkey % 8 = 0 THEN 'C1' END AS replaced_by FROM customer""")
def obo_text(spark: SparkSession, d: str) -> DataFrame:
    """Terms of an OBO text with comments, modifiers, scopes and terms of other kinds."""
    customer, path, key = B.table(spark, d, "customer"), place(spark, "obo"), F.col("c_custkey").cast("string")
    gone = F.when(F.col("c_custkey") % 8 == 0, F.lit("\nis_obsolete: true\nreplaced_by: C1")).otherwise("")
    named = F.concat(F.lit('\nsynonym: "'), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, '" EXACT []').otherwise('" BROAD []'))
    term = F.concat(F.lit("[Term]\nid: C"), key, F.lit("\nname: "), "c_name", F.lit("\nis_a: N"), F.col("c_nationkey").cast("string"), F.lit(' {source="x"} ! a nation'), named, gone, F.lit("\n\n[Typedef]\nid: part_of\n"))
    customer.select(term).write.text(path)
    out = files.obo_terms(spark, path, scopes=("EXACT",))
    return out.select("term_id", "name", F.array_join("parents", "|").alias("parents"), F.array_join("synonyms", "|").alias("synonyms"), "is_obsolete", "replaced_by")


@query("""SELECT 'D' || s_suppkey AS entry, 'ENTRY' AS field, 'D' || s_suppkey || '        Drug' AS lines FROM supplier UNION ALL SELECT 'D' || s_suppkey, 'NAME', s_name || ';|second' FROM supplier
    UNION ALL SELECT 'D' || s_suppkey, 'TARGET', 'n' || s_nationkey FROM supplier WHERE s_nationkey % 4 > 0""")
def flat_text(spark: SparkSession, d: str) -> DataFrame:
    """Fields of flat records, with lines that go on."""
    supplier, path, key = B.table(spark, d, "supplier"), place(spark, "flat"), F.col("s_suppkey").cast("string")
    target = F.when(F.col("s_nationkey") % 4 > 0, F.concat(F.lit("\nTARGET      n"), F.col("s_nationkey").cast("string"))).otherwise("")
    supplier.select(F.concat(F.lit("ENTRY       D"), key, F.lit("        Drug\nNAME        "), "s_name", F.lit(";\n            second"), target, F.lit("\n///"))).write.text(path)
    return files.flat_records(spark, path).select("entry", "field", F.array_join("lines", "|").alias("lines"))


@query("""SELECT CASE WHEN user_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'unknown drug' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'bad vote' ELSE 'accepted' END AS outcome, count(*) AS n FROM events GROUP BY 1""")
def checked_votes(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a checked append takes and refuses, by reason."""
    rows, path = B.table(spark, d, "events").select(F.col("user_id").alias("drug"), F.col("event_type").alias("vote")), place(spark, "votes")
    refused = files.append_checked(rows, path, {"drug": B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"))}, {"vote": ("click", "view", "purchase")})
    taken = files.strings_csv(spark, path).select(F.lit("accepted").alias("outcome"))
    return taken.unionByName(refused.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'customer' AS name, 'csv' AS kind, false AS read_only, (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer) > 100000 AS is_large UNION ALL SELECT 'derived__part', 'parquet', true, (SELECT count(*) FROM part), (SELECT count(*) FROM part) > 100000
    UNION ALL SELECT 'raw__supplier', 'tsv', false, (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier) > 100000""")
def table_registry(spark: SparkSession, d: str) -> DataFrame:
    """What a folder of tables in several formats and levels holds."""
    root = place(spark, "tables")
    for name, kind in (("customer", "csv"), ("raw/supplier", "tsv"), ("derived/part", "parquet")):
        files.write(B.table(spark, d, name.rpartition("/")[2]).coalesce(1), f"{root}/{name}.{kind}", kind)
    return spark.createDataFrame(catalog.tables(spark, root), "name string, path string, kind string, read_only boolean, rows long, is_large boolean").drop("path")


@query("""SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_size END AS size, version FROM part, (VALUES (2)) v(version) UNION ALL SELECT p_partkey, p_name, p_size, 1 FROM part""")
def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """The current version of a table, and the one before it."""
    root = place(spark, "versions")
    part = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    first = versions.commit(part, root)
    versions.commit(versions.read(spark, root).withColumn("size", F.when(F.col("size") % 4 == 0, -1).otherwise(F.col("size"))), root, expected=first)
    return versions.read(spark, root, first).withColumn("version", F.lit(1)).unionByName(versions.read(spark, root).withColumn("version", F.lit(2)))


@query("SELECT DISTINCT user_id, event_type, user_id * 10 + length(event_type) AS score FROM events WHERE event_type <> 'error'")
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a stream of files, each scored once by a scorer that keeps its own state."""
    source, out, checkpoint = (place(spark, name) for name in ("arrived", "scores", "state"))
    events = B.table(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_type") != "error", F.col("props")).alias("relation"))
    events.repartition(3, "user_id").write.parquet(source)
    score = lambda df: df.select("user_id", "event_type", (F.col("user_id") * 10 + F.length("event_type")).alias("score"))
    scorer = logs.Scorer(spark, source, "user_id long, event_type string, relation string", ["user_id", "event_type"], score, out, checkpoint, files_a_batch=2, required="relation")
    scorer.start()
    if error := scorer.wait()["last_error"]:
        raise RuntimeError(error)
    return scorer.results()


@query("""WITH x AS (SELECT p_partkey AS id, lower(p_name || '-(+/-)-.alpha.' || p_type) AS a, lower(p_brand) AS b FROM part)
    SELECT id, regexp_replace(regexp_replace(a, '[.]alpha[.]', 'alpha', 'g'), '[(][+]/-[)]|[^a-z0-9]', '', 'g') AS name, array_to_string(list_sort(list_distinct([regexp_replace(regexp_replace(a, '[.]alpha[.]', 'alpha', 'g'), '[(][+]/-[)]|[^a-z0-9]', '', 'g'), regexp_replace(b, '[^a-z0-9]', '', 'g')])), '|') AS keys FROM x""")
def drug_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("-(+/-)-.alpha."), "p_type")
    keys = X.name_keys(F.concat(raw, F.lit(" (USP); "), "p_brand", F.lit(" (JAN/INN);(TN)")))
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.drug_name(raw).alias("name"), F.array_join(keys, "|").alias("keys"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '#0000000') ORDER BY c_name LIMIT 20")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 hits of a search, whatever the case; a text with marks of a pattern is taken literally."""
    return catalog.search(B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "name", "#0000000")


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size % 4 > 0 THEN len(string_split(p_name, ' ')) ELSE 0 END AS INT) AS n_words FROM part")
def list_sizes(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.size(F.when(F.col("p_size") % 4 > 0, F.split("p_name", " "))), F.lit(0)).alias("n_words"))


@query("SELECT DISTINCT p_name AS gene, CASE WHEN p_size % 3 > 0 THEN 'R' || p_size WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS pathway FROM part WHERE p_size % 3 > 0 OR p_size % 2 = 0 OR p_size % 5 > 0")
def gene_pathway_records(spark: SparkSession, d: str) -> DataFrame:
    """Pathways of nested records, by the first of three names that a record has."""
    size = F.col("p_size")
    record = F.struct(F.when(size % 3 > 0, F.concat(F.lit("R"), size.cast("string"))).alias("pathwayId"), F.when(size % 2 == 0, F.col("p_type")).alias("id"), F.when(size % 5 > 0, F.col("p_brand")).alias("pathway"))
    return N.pathways(B.table(spark, d, "part").select(F.col("p_name").alias("gene"), F.array(record).alias("pathways")))


@query("SELECT p_brand AS condition, p_name AS symbol, max(p_retailprice) AS max_score, count(DISTINCT p_partkey) AS n_ids FROM part GROUP BY 1, 2")
def evidence_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    part = B.table(spark, d, "part")
    return M.to_symbols(part.select(F.col("p_brand").alias("condition"), F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("max_score")), part.select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("symbol")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN p_size END AS key, s_name AS name FROM part LEFT JOIN supplier ON CASE WHEN p_size % 5 > 0 THEN p_size END = CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey END")
def null_keys(spark: SparkSession, d: str) -> DataFrame:
    """A join whose null keys on either side meet nothing, and whose left rows all stay."""
    left = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).cast("long").alias("key"))
    right = B.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 5 > 0, F.col("s_suppkey")).alias("key"), F.col("s_name").alias("name"))
    return left.join(right, "key", "left").select("id", F.col("key").cast("int").alias("key"), "name")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderpriority DESC, CASE WHEN o_orderkey % 6 > 0 THEN o_totalprice END NULLS LAST, o_orderkey) - 1 AS place FROM orders")
def sorted_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of rows sorted by three keys, missing prices last."""
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", F.when(F.col("o_orderkey") % 6 > 0, F.col("o_totalprice")).alias("price"))
    return catalog.numbered(orders, [F.desc("o_orderpriority"), F.asc_nulls_last("price"), F.asc("id")]).select("id", F.col("row_index").alias("place"))


@query("""WITH m AS (SELECT l_suppkey AS drug, l_partkey % 7 AS target, max(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), i AS (SELECT l_suppkey AS drug, l_partkey % 7 AS target, min(l_quantity) AS a FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
    SELECT drug, target, coalesce(m.a, i.a) AS affinity, m.a IS NOT NULL AS is_measured FROM m FULL JOIN i USING (drug, target)""")
def measured_or_imputed(spark: SparkSession, d: str) -> DataFrame:
    """Affinities measured, or else imputed: returned lines stand for measurements."""
    line = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("drug"), (F.col("l_partkey") % 7).alias("target"), "l_quantity", (F.col("l_returnflag") == "R").alias("back"))
    measured = line.where("back").groupBy("drug", "target").agg(F.max("l_quantity").alias("affinity"))
    return N.measured_or_imputed(measured, line.where("not back").groupBy("drug", "target").agg(F.min("l_quantity").alias("affinity")), ["drug", "target"])


@query("""SELECT c_custkey AS seed, 'N' || c_nationkey AS id, n_name AS name, 1 AS level FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'R' || n_regionkey, r_name, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 2 END FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def ancestor_trees(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each customer's tree: nation, region below it, and below that the customer, who is no ancestor."""
    customer, nation, region = (B.table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("id")
    leaf = F.struct(name("C", "c_custkey"), F.col("c_name").alias("name"))
    middle = F.struct(name("R", "n_regionkey"), F.col("r_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, 9).alias("level"), F.array(leaf).alias("children"))
    tree = F.to_json(F.struct(name("N", "c_nationkey"), F.col("n_name").alias("name"), F.array(middle).alias("children")))
    return O.json_tree(keep(rows.select(F.col("c_custkey").alias("seed"), tree.alias("tree")), "trees"), "seed", "tree", "id string, name string")
