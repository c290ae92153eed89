"""Entity tables made from the driver's tables, for queries and tests without a repository.

Parts stand for symbols, consecutive parts of an order for calls, orders for commits, order lines
for changed files, events for issues, documents and conversations for evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    folder = F.when(F.col("p_type") == "PROMO", "tests/").otherwise(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/")))
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method")
    name = F.concat(F.when(F.col("p_size") % 5 == 0, "_").otherwise(""), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    mark = F.when(F.col("p_size") % 7 == 0, "@cached ").otherwise("")
    return read(spark, sf_dir, "part").select(
        F.lit(1).alias("repo_id"),
        F.col("p_partkey").alias("id"),
        F.concat(folder, brand, F.lit(".py")).alias("file_path"),
        kind.alias("kind"),
        name.alias("name"),
        F.when(kind == "method", F.concat(F.initcap(brand), F.lit("."), name)).otherwise(name).alias("qualified_name"),
        (F.col("p_size") * 10).alias("start_line"),
        F.concat(F.lit("def "), name, F.lit("(self, "), F.lower("p_type"), F.lit(": int) -> "), brand).alias("signature"),
        F.concat(mark, F.lit("def "), name).alias("code"),
    )


SYMBOLS_SQL = """symbols AS (
SELECT 1 AS repo_id, p_partkey AS id,
  CASE WHEN p_type = 'PROMO' THEN 'tests/' ELSE 'src/' || lower(p_type) || '/' END || lower(replace(p_brand, '#', '')) || '.py' AS file_path,
  CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind,
  CASE WHEN p_size % 5 = 0 THEN '_' ELSE '' END || replace(p_name, ' ', '_') AS name,
  CASE WHEN p_size % 3 = 2 THEN upper(left(replace(p_brand, '#', ''), 1)) || substr(lower(replace(p_brand, '#', '')), 2) || '.' ELSE '' END
    || CASE WHEN p_size % 5 = 0 THEN '_' ELSE '' END || replace(p_name, ' ', '_') AS qualified_name,
  p_size * 10 AS start_line,
  CASE WHEN p_size % 7 = 0 THEN '@cached ' ELSE '' END || 'def ' || CASE WHEN p_size % 5 = 0 THEN '_' ELSE '' END || replace(p_name, ' ', '_') AS code
FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order; confidence also as the integer `tenths`, whose sums are exact."""
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    raw = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    tenths = F.when(F.col("l_quantity") >= 48, 10).when(F.col("l_quantity") >= 46, 9).otherwise(5)
    pairs = raw.withColumn("dst", F.lead("l_partkey").over(in_order)).where("l_quantity >= 45 and dst is not null and l_partkey <> dst")
    kind = F.when(F.col("l_returnflag") == "R", "inherit").otherwise("call").alias("edge_type")
    best = pairs.select(F.col("l_partkey").alias("src"), "dst", kind, tenths.alias("t")).groupBy("src", "dst", "edge_type").agg(F.max("t").alias("tenths"))
    return best.select(F.lit(1).alias("repo_id"), "src", "dst", "edge_type", "tenths", (F.col("tenths") / 10).alias("confidence"))


EDGES_SQL = """raw_edges AS (
SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
  CASE WHEN l_returnflag = 'R' THEN 'inherit' ELSE 'call' END AS edge_type,
  CASE WHEN l_quantity >= 48 THEN 10 WHEN l_quantity >= 46 THEN 9 ELSE 5 END AS t, l_quantity AS q FROM lineitem),
edges AS (SELECT 1 AS repo_id, src, dst, edge_type, max(t) AS tenths, max(t) / 10 AS confidence FROM raw_edges
  WHERE q >= 45 AND dst IS NOT NULL AND src <> dst GROUP BY src, dst, edge_type)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.lit(1).alias("repo_id"), F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("authored_at"), F.when(F.col("o_orderkey") % 10 == 0, 2).otherwise(1).alias("n_parents"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.lower("o_orderpriority")).alias("message"))


COMMITS_SQL = """commits AS (SELECT 1 AS repo_id, o_orderkey AS sha, o_custkey AS author, o_orderdate AS authored_at,
  CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS n_parents, 'Order ' || o_orderkey || ' ' || lower(o_orderpriority) AS message FROM orders)"""


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    paths = symbols(spark, sf_dir).select("id", F.col("file_path").alias("path"))
    return lines.join(paths, lines["l_partkey"] == paths["id"]).groupBy(F.col("l_orderkey").alias("sha"), "path").agg(F.sum("l_quantity").cast("long").alias("insertions")).withColumn("repo_id", F.lit(1))


COMMIT_FILES_SQL = """commit_files AS (SELECT l_orderkey AS sha, file_path AS path, CAST(sum(l_quantity) AS BIGINT) AS insertions, 1 AS repo_id
  FROM lineitem JOIN symbols ON l_partkey = id GROUP BY l_orderkey, file_path)"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(F.lit(1).alias("repo_id"), F.col("event_id").alias("number"), kind.isin("purchase", "signup").alias("is_pull_request"), F.when(kind.isin("error", "view"), "open").otherwise("closed").alias("state"), F.col("user_id").alias("author"), F.col("ts").alias("created_at"), kind.alias("title"))


ISSUES_SQL = """issues AS (SELECT 1 AS repo_id, event_id AS number, event_type IN ('purchase', 'signup') AS is_pull_request,
  CASE WHEN event_type IN ('error', 'view') THEN 'open' ELSE 'closed' END AS state, user_id AS author, ts AS created_at, event_type AS title FROM events)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    category = F.when(F.col("toxic") == 1, "security").when(F.col("quality") == 0, "logic").otherwise("style")
    severity = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "high").when(F.col("toxic") + 1 - F.col("quality") > 0, "medium").otherwise("low")
    status = F.when(F.col("doc_id") % 11 == 0, "ticketed").when(F.col("doc_id") % 7 == 0, "dismissed").otherwise("new")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.lit(1).alias("repo_id"), F.col("doc_id").alias("id"), F.concat(F.lit("src/"), F.col("source"), F.lit(".py")).alias("file_path"), (F.col("n_chars") % 500 + 1).alias("start_line"), category.alias("category"), severity.alias("severity"), F.concat(F.lit("Finding "), F.col("doc_id").cast("string")).alias("title"), status.alias("status"))


FINDINGS_SQL = """findings AS (SELECT 1 AS repo_id, doc_id AS id, 'src/' || source || '.py' AS file_path, n_chars % 500 + 1 AS start_line,
  CASE WHEN toxic = 1 THEN 'security' WHEN quality = 0 THEN 'logic' ELSE 'style' END AS category,
  CASE WHEN toxic = 1 AND quality = 0 THEN 'high' WHEN toxic + 1 - quality > 0 THEN 'medium' ELSE 'low' END AS severity,
  'Finding ' || doc_id AS title, CASE WHEN doc_id % 11 = 0 THEN 'ticketed' WHEN doc_id % 7 = 0 THEN 'dismissed' ELSE 'new' END AS status
  FROM labels JOIN documents USING (doc_id))"""


def with_tables(*tables: str) -> str:
    """A WITH clause of these entity tables; what they need comes first."""
    return "WITH " + ",\n".join(tables)
