"""The driver's tables in the engine's terms, and the same as SQL.

Texts are documents, their lines pages; benchmark passages are queries; regions, nations and customers are section
trees; conversations are documents whose turns are pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.operators import ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its files make fewer tasks than there are; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.logical_pages(docs(spark, sf_dir), 5)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of three levels with paths, parents, spans, and an order."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    leaf = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    page = (F.col("c_custkey") % 60).cast("int")
    customers = leaf.select("r_name", "n_name", F.col("c_name").alias("title"), page.alias("start_page"), (page + (F.col("c_custkey") % 3).cast("int")).alias("end_page"), F.lit(3).alias("level"), F.array("r_name", "n_name", "c_name").alias("path"))
    spans = customers.groupBy("r_name", "n_name").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    nations = spans.select("r_name", "n_name", F.col("n_name").alias("title"), "start_page", "end_page", F.lit(2).alias("level"), F.array("r_name", "n_name").alias("path"))
    regions = nations.groupBy("r_name").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    regions = regions.select("r_name", F.lit(None).cast("string").alias("n_name"), F.col("r_name").alias("title"), "start_page", "end_page", F.lit(1).alias("level"), F.array("r_name").alias("path"))
    every = regions.unionByName(nations).unionByName(customers)
    ident = lambda path: F.array_join(path, "/")
    return every.select(F.col("r_name").alias("document_id"), ident(F.col("path")).alias("node_id"), F.when(F.col("level") > 1, ident(F.slice("path", 1, F.size("path") - 1))).alias("parent_id"), "title", "level", "path", "start_page", "end_page")


LINES_SQL = """
raw AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
held AS (SELECT document_id, k, regexp_replace(raw, '\\s+$', '') AS content FROM raw WHERE trim(regexp_replace(raw, '\\s+$', '')) <> ''),
lines AS (SELECT document_id, ((row_number() OVER (PARTITION BY document_id ORDER BY k) - 1) // 5)::INT AS page_index, ((row_number() OVER (PARTITION BY document_id ORDER BY k) - 1) % 5)::INT AS reading_index, content FROM held)"""

PAGES_SQL = LINES_SQL + """,
pages AS (SELECT document_id, page_index, string_agg(trim(content), chr(10) ORDER BY reading_index) AS text FROM lines GROUP BY 1, 2)"""

NODES_SQL = """
customers AS (SELECT r_name, n_name, c_name AS title, (c_custkey % 60)::INT AS start_page, (c_custkey % 60 + c_custkey % 3)::INT AS end_page, 3 AS level, [r_name, n_name, c_name] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nations AS (SELECT r_name, n_name, n_name AS title, min(start_page) AS start_page, max(end_page) AS end_page, 2 AS level, [r_name, n_name] AS path FROM customers GROUP BY 1, 2),
regions AS (SELECT r_name, NULL AS n_name, r_name AS title, min(start_page) AS start_page, max(end_page) AS end_page, 1 AS level, [r_name] AS path FROM nations GROUP BY 1),
nodes AS (SELECT r_name AS document_id, array_to_string(path, '/') AS node_id, CASE WHEN level > 1 THEN array_to_string(path[:-2], '/') END AS parent_id, title, level, path, start_page, end_page FROM (SELECT * FROM regions UNION ALL SELECT * FROM nations UNION ALL SELECT * FROM customers))"""
