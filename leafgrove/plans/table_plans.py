"""Queries over compaction, stores, the event log, and plain relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.operators import compaction
from leafgrove.plans.inputs import NODES_SQL, nodes, table
from leafgrove.sources import store
from leafgrove.streaming import events as log

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _summaries(own):
    return own.where("level = 3 and start_page % 4 = 0").select("document_id", "node_id", F.concat(F.lit("About "), F.col("title")).alias("summary"))


_SCORED_SQL = f"""{NODES_SQL},
scored AS (SELECT n.*, end_page - start_page + 1 AS width, level = 3 AND start_page % 4 = 0 AS has_summary, level < 3 AS has_children FROM nodes n)"""


@_add("importance_score", f"WITH {_SCORED_SQL} SELECT node_id, width + 4.0::DOUBLE * has_summary::INT + 3.0 * has_children::INT + 1.0 / level AS importance FROM scored")
def _(spark, d):
    own = nodes(spark, d)
    return compaction.importance(own, _summaries(own)).select("node_id", "importance")


@_add("compact_mild", f"""
WITH {_SCORED_SQL}, c AS (SELECT *, has_summary OR has_children OR width > 1 AS high, count(*) OVER p AS n, row_number() OVER (PARTITION BY document_id, parent_id ORDER BY start_page, end_page, level, array_to_string(path, chr(31)), node_id) AS k FROM scored WHERE parent_id IS NOT NULL WINDOW p AS (PARTITION BY document_id, parent_id)),
f AS (SELECT *, CASE WHEN n > 40 AND NOT high AND NOT coalesce(lag(high) OVER (PARTITION BY document_id, parent_id ORDER BY k), true) THEN 0 ELSE 1 END AS fresh FROM c WHERE n <= 80)
SELECT node_id, (sum(fresh) OVER (PARTITION BY document_id, parent_id ORDER BY k))::INT - 1 AS segment FROM f""")
def _(spark, d):
    own = nodes(spark, d)
    return compaction.segments(compaction.importance(own, _summaries(own)), 40).select("node_id", "segment")


@_add("compact_tree")
def _(spark, d):
    own = nodes(spark, d)
    return compaction.compacted(own, _summaries(own), 10).select("document_id", "serving_node_id", "title", "start_page", "end_page", F.array_join("canonical_node_ids", ",").alias("canonical_node_ids"))


@_add("serving_map")
def _(spark, d):
    own = nodes(spark, d)
    serving = compaction.compacted(own, _summaries(own), 10)
    return compaction.expand(serving.select("document_id", "serving_node_id", F.col("segment").alias("ord")), serving)


# A region's span covers those of all its sections, so no section adds a page: the widest told ones follow, in document order.
_SOURCES_SQL = f"""{NODES_SQL},
chosen AS (SELECT document_id, node_id, title, level, row_number() OVER (PARTITION BY document_id, least(level, 2) ORDER BY start_page, end_page, level, path, node_id) AS k FROM nodes WHERE level < 3),
first AS (SELECT document_id, node_id, title, CASE WHEN level = 1 THEN 0 ELSE k END::INT AS place, NULL AS summary FROM chosen WHERE level = 1 OR k <= 7),
held AS (SELECT document_id, count(*) AS n FROM first GROUP BY 1),
told AS (SELECT document_id, node_id, title, 'About ' || title AS summary, row_number() OVER (PARTITION BY document_id ORDER BY start_page - end_page, start_page, end_page, level, path, node_id) AS k FROM nodes WHERE level = 3 AND start_page % 4 = 0),
sources AS (FROM first UNION ALL SELECT document_id, node_id, title, (n + k - 1)::INT, summary FROM told JOIN held USING (document_id) WHERE n + k <= 8)"""


@_add("description_sources", f"WITH {_SOURCES_SQL} SELECT document_id, place, node_id FROM sources")
def _(spark, d):
    own = nodes(spark, d)
    return compaction.description_sources(own, _summaries(own))


@_add("descriptions", f"""
WITH {_SOURCES_SQL}, t AS (SELECT document_id, title, min(place) AS place FROM sources GROUP BY 1, 2), j AS (SELECT document_id, string_agg(title, ', ' ORDER BY place) AS titles FROM t GROUP BY 1), f AS (SELECT document_id, arg_min(summary, place) AS summary FROM sources WHERE summary IS NOT NULL GROUP BY 1)
SELECT document_id, concat_ws(' ', 'Sections include ' || titles || '.', summary || '.') AS description FROM j LEFT JOIN f USING (document_id)""")
def _(spark, d):
    own = nodes(spark, d)
    return compaction.descriptions(compaction.description_sources(own, _summaries(own)), own, _summaries(own))


@_add("upsert_latest", "SELECT o_custkey AS document_id, max(o_orderkey) AS version FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"))
    return store.upsert(o.where("version % 2 = 0"), o.where("version % 2 = 1"), ["document_id"], "version")


@_add("catalog_merge", "SELECT coalesce(c_custkey, s_suppkey) AS document_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS tree, c_mktsegment AS corpus FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def _(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("tree"), F.col("c_mktsegment").alias("corpus"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("tree"))
    return store.merge_catalog(old, new)


@_add("export_documents", f"WITH {NODES_SQL} SELECT node_id AS id, CASE WHEN level = 3 AND start_page % 4 = 0 THEN 'About ' || title ELSE title END AS page_content FROM nodes")
def _(spark, d):
    own = nodes(spark, d)
    return store.export_documents(own, _summaries(own)).select("id", "page_content")


def _log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("occurred_at"), "value", "props")


@_add("event_dedupe", "SELECT event_type AS name, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")
def _(spark, d):
    own = _log(spark, d)
    return log.dedupe(own.unionByName(own)).groupBy("name").agg(F.count("*").alias("n"))


@_add("event_counts_by_hour", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS name, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return log.counts(_log(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "name", "n")


@_add("event_last_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    return table(spark, d, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("k = 1").select("user_id", "event_id")


@_add("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id::VARCHAR AS document_id, n, count(*)::BIGINT AS sessions FROM (SELECT user_id, k, count(*)::BIGINT AS n FROM s GROUP BY 1, 2) GROUP BY 1, 2""")
def _(spark, d):
    return log.sessions(_log(spark, d), "document_id").groupBy("document_id", "n").agg(F.count("*").alias("sessions"))


# Relational coverage beyond the retrieval operators.
_add("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")(
    lambda spark, d: table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
)
_add("rel_rollup", "SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(n_name, 'all') AS nation, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)")(
    lambda spark, d: table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n")
)
_add("rel_cube_distinct", "SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_size::VARCHAR, 'all') AS size, count(DISTINCT p_type)::BIGINT AS types FROM part GROUP BY CUBE (p_brand, p_size)")(
    lambda spark, d: table(spark, d, "part").cube("p_brand", "p_size").agg(F.count_distinct("p_type").alias("types")).select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce(F.col("p_size").cast("string"), F.lit("all")).alias("size"), "types")
)
_add("rel_pivot", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}')::BIGINT AS n_{e}" for e in ("click", "view", "purchase")) + " FROM events GROUP BY 1")(
    lambda spark, d: table(spark, d, "events").groupBy("user_id").agg(*(F.count(F.when(F.col("event_type") == e, 1)).alias(f"n_{e}") for e in ("click", "view", "purchase")))
)
_add("rel_semi_anti", "SELECT 'with' AS kind, count(*)::BIGINT AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")(
    lambda spark, d: table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.lit("with").alias("kind"), F.count("*").alias("n")).union(table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.lit("without"), F.count("*")))
)
_add("rel_window_rank", "SELECT o_orderkey, rank() OVER w::BIGINT AS r, dense_rank() OVER w::BIGINT AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::BIGINT AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.rank().over(w := W.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).cast("long").alias("q"))
)
_add("rel_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3")(
    lambda spark, d: table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey")).subtract(spark.range(3, 4).selectExpr("cast(id as int) as k"))
)
_add("rel_asof_join", "SELECT l.o_orderkey, max(e.event_id) AS event_id FROM orders l ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) e ON l.o_custkey = e.user_id AND l.o_orderkey >= e.event_id GROUP BY 1")(
    lambda spark, d: table(spark, d, "orders").join(table(spark, d, "events"), (F.col("o_custkey") == F.col("user_id")) & (F.col("o_orderkey") >= F.col("event_id"))).groupBy("o_orderkey").agg(F.max("event_id").alias("event_id"))
)
_add("rel_json_props", "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys")))
_add("rel_decimal_dates", "SELECT year(o_orderdate)::BIGINT AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, max(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01'))::BIGINT AS age FROM orders GROUP BY 1")(
    lambda spark, d: table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max(F.date_diff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))).cast("long").alias("age"))
)
