"""The driver tables in the roles of files, lines, entities, edges, findings and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, path, package, language, size_bytes, line_count, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))).alias("path"),
        F.col("source").alias("package"),
        F.col("lang").alias("language"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        paths.line_count(F.col("text")).alias("line_count"),
        "text",
    )


def lines(files_: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with line feeds made alike; the part after a last feed is a line, too."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    return files_.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst, relation): parts of which one follows the other in an order. The next number's parts are looked
    up in the order's sorted lines: one scan and one shuffle instead of a join of the table with itself."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    relation = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("inherits")
    found = li.select(F.col("l_partkey").alias("src"), relation.alias("relation"), F.collect_set("l_partkey").over(after).alias("next"))
    return found.select("src", F.explode("next").alias("dst"), "relation").filter("src <> dst").distinct()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as entities: id, name, file, package, span, type (a fifth are files, and so on)."""
    kinds = F.array(*[F.lit(x) for x in ("file", "class", "function", "method", "function")])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("package"), F.col("p_size").cast("long").alias("span"), kinds[(F.col("p_partkey") % 5).cast("int")].alias("type")
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child): region, nation, customer, order as nested things."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    link = lambda p, pc, k, kc: F.struct(F.concat(F.lit(p), pc.cast("string")).alias("parent"), F.concat(F.lit(k), kc.cast("string")).alias("child"))
    parts = [
        n.select(link("r", F.col("n_regionkey"), "n", F.col("n_nationkey")).alias("x")),
        c.select(link("n", F.col("c_nationkey"), "c", F.col("c_custkey")).alias("x")),
        o.select(link("c", F.col("o_custkey"), "o", F.col("o_orderkey")).alias("x")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).select("x.parent", "x.child")


#: The same roles in the oracle's SQL, as parts of a WITH clause.
SQL = {
    "files": """files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, source AS package, lang AS language,
        strlen(text) AS size_bytes, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS line_count, text FROM documents)""",
    "lines": """lines AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents) t, LATERAL (SELECT unnest(range(1, len(t.l) + 1)) AS i))""",
    "edges": """edges AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE a.l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'inherits' END AS relation
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)""",
    "entities": """entities AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS package, CAST(p_size AS BIGINT) AS span,
        (['file', 'class', 'function', 'method', 'function'])[p_partkey % 5 + 1] AS type FROM part)""",
    "tree": """tree AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
