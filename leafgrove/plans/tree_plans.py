"""Queries over section trees, outlines, spans and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrove.functions import text as T
from leafgrove.operators import ingest, search, tree
from leafgrove.plans.inputs import NODES_SQL, PAGES_SQL, lines, nodes, table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _outline(spark, d):
    """Outline entries: an order's lines are a document's entries; levels and pages repeat, jump and go back."""
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") % 2 == 0, "pypdf").otherwise("pymupdf").alias("source"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("ord"), (F.col("l_quantity") % 4).cast("int").alias("level"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).otherwise("").alias("title"), F.when(F.col("l_discount") > 0.01, (F.col("l_partkey") % 30).cast("int")).alias("page_index"))


_OUTLINE_SQL = """o AS (SELECT l_orderkey AS document_id, CASE WHEN l_linenumber % 2 = 0 THEN 'pypdf' ELSE 'pymupdf' END AS source, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey * 100 + l_quantity::BIGINT AS ord, (l_quantity % 4)::INT AS level, CASE WHEN l_tax > 0.02 THEN l_returnflag ELSE '' END AS title, CASE WHEN l_discount > 0.01 THEN (l_partkey % 30)::INT END AS page_index FROM lineitem)"""
_QUALITY_SQL = f"""{_OUTLINE_SQL},
f AS (SELECT *, last_value(page_index IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(level) OVER w AS up, row_number() OVER w AS k FROM o WINDOW w AS (PARTITION BY document_id, source ORDER BY ord)),
q AS (SELECT document_id, source, count(*)::BIGINT AS entry_count, sum((page_index IS NULL)::INT)::BIGINT AS null_destination_count, sum((trim(title) = '')::INT)::BIGINT AS empty_title_count,
 sum(coalesce((page_index < before)::INT, 0))::BIGINT AS non_monotonic_count, sum((level < 1)::INT + CASE WHEN k = 1 THEN (level <> 1)::INT ELSE (level > up + 1)::INT END)::BIGINT AS invalid_level_count, greatest(0, max(level))::BIGINT AS max_depth FROM f GROUP BY 1, 2),
s AS (SELECT *, 100 * entry_count - 40 * null_destination_count - 25 * empty_title_count - 30 * non_monotonic_count - 50 * invalid_level_count - 5 * greatest(0, max_depth - 12) AS score FROM q)"""


@_add("outline_quality", f"WITH {_QUALITY_SQL} SELECT * FROM s")
def _(spark, d):
    return tree.outline_quality(_outline(spark, d))


@_add("outline_select", f"WITH {_QUALITY_SQL} SELECT document_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, null_destination_count, CASE source WHEN 'pymupdf' THEN 0 ELSE 1 END) AS k FROM s) WHERE k = 1")
def _(spark, d):
    return tree.select_outline(tree.outline_quality(_outline(spark, d))).select("document_id", "source", "score")


@_add("outline_normalize", "SELECT l_orderkey AS document_id, l_linenumber AS ord, CASE WHEN l_linenumber - 2 > 0 THEN l_linenumber - 3 ELSE -1 END AS page_index FROM lineitem")
def _(spark, d):
    return tree.normalize_outline(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") - 2).alias("page"))).select("document_id", "ord", F.coalesce("page_index", F.lit(-1)).alias("page_index"))


@_add("outline_lead_spans", f"""
WITH {_OUTLINE_SQL}, f AS (SELECT *, lead(page_index) OVER (PARTITION BY document_id ORDER BY page_index, level, title, ord) AS nx FROM o WHERE page_index IS NOT NULL)
SELECT document_id, ord, least(page_index, 24)::INT AS start_page, greatest(least(page_index, 24), least(coalesce(nx, 24), 24))::INT AS end_page FROM f""")
def _(spark, d):
    own = _outline(spark, d)
    counts = own.select("document_id").distinct().withColumn("page_count", F.lit(25))
    return tree.lead_spans(own, counts).select("document_id", "ord", "start_page", "end_page")


@_add("outline_path_stack", f"""
WITH RECURSIVE {_OUTLINE_SQL}, e AS (SELECT document_id, ord, greatest(level, 1) AS level, 't' || ord AS title, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS k FROM o),
r AS (SELECT document_id, ord, k, [title] AS path FROM e WHERE k = 1 UNION ALL SELECT e.document_id, e.ord, e.k, list_append(r.path[1:least(len(r.path), e.level - 1)], e.title) FROM r JOIN e ON e.document_id = r.document_id AND e.k = r.k + 1)
SELECT document_id, ord, array_to_string(path, '/') AS path FROM r""")
def _(spark, d):
    own = _outline(spark, d).select("document_id", "ord", F.greatest("level", F.lit(1)).alias("level"), F.concat(F.lit("t"), F.col("ord").cast("string")).alias("title"))
    return tree.with_paths(own).select("document_id", "ord", F.array_join("path", "/").alias("path"))


@_add("tree_nodes", f"WITH {NODES_SQL} SELECT document_id, node_id, parent_id, title, level, start_page, end_page FROM nodes")
def _(spark, d):
    return nodes(spark, d).drop("path")


@_add("node_ids_sha", f"""WITH {NODES_SQL} SELECT node_id, sha256(document_id || '|' || array_to_string(list_transform(path, lambda p: {T.sql_key('p')}), '|') || '|' || level || '|' || start_page || '|0|0|' || start_page) AS sha FROM nodes""")
def _(spark, d):
    zero = F.lit(0)
    return nodes(spark, d).select("node_id", T.node_id(F.col("document_id"), F.col("path"), F.col("level"), F.col("start_page"), zero, zero, F.col("start_page")).alias("sha"))


@_add("tree_parent_asof", f"""
WITH {NODES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY level, node_id) AS ord FROM nodes)
SELECT a.node_id, arg_max(b.node_id, b.ord) AS parent_id FROM n a LEFT JOIN n b ON a.document_id = b.document_id AND b.path = a.path[:-2] AND b.ord < a.ord AND len(a.path) > 1 GROUP BY a.node_id""")
def _(spark, d):
    from pyspark.sql import Window as W

    own = nodes(spark, d).withColumn("ord", F.row_number().over(W.partitionBy("document_id").orderBy("level", "node_id")))
    return tree.parents_by_path(own).select("node_id", "parent_id")


@_add("tree_children_ordered", f"WITH {NODES_SQL} SELECT document_id, parent_id, string_agg(node_id, ',' ORDER BY start_page, end_page, level, path, node_id) AS child_ids FROM nodes WHERE parent_id IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return tree.children(nodes(spark, d)).select("document_id", "parent_id", F.array_join("child_ids", ",").alias("child_ids"))


@_add("tree_leaves", f"WITH {NODES_SQL} SELECT document_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.document_id = n.document_id AND c.parent_id = n.node_id)")
def _(spark, d):
    return tree.leaves(nodes(spark, d)).select("document_id", "node_id")


@_add("tree_roots", f"WITH {NODES_SQL} SELECT document_id, node_id FROM nodes WHERE parent_id IS NULL")
def _(spark, d):
    return tree.roots(nodes(spark, d)).select("document_id", "node_id")


@_add("tree_top_level", f"WITH {NODES_SQL} SELECT document_id, node_id FROM nodes WHERE level = 2")
def _(spark, d):
    return tree.top_level(nodes(spark, d)).select("document_id", "node_id")


def _twins(spark, d):
    """The nodes, and in every region a second section of its first nation's path."""
    own = nodes(spark, d)
    twin = own.where("level = 2").groupBy("document_id").agg(F.min_by(F.struct("parent_id", "title", "level", "path", "start_page", "end_page"), "node_id").alias("t"))
    return own.unionByName(twin.select("document_id", F.concat("document_id", F.lit("/twin")).alias("node_id"), "t.parent_id", "t.title", "t.level", "t.path", "t.start_page", "t.end_page"))


_TWINS_SQL = NODES_SQL + """,
twins AS (SELECT document_id, node_id, parent_id, path FROM nodes UNION ALL SELECT document_id, document_id || '/twin', min(parent_id), arg_min(path, node_id) FROM nodes WHERE level = 2 GROUP BY 1)"""


@_add("tree_subtree_closure", f"WITH {_TWINS_SQL} SELECT a.document_id, a.node_id AS ancestor_id, n.node_id FROM twins a JOIN twins n ON n.document_id = a.document_id AND (n.node_id = a.node_id OR (len(n.path) > len(a.path) AND n.path[1:len(a.path)] = a.path))")
def _(spark, d):
    return tree.closure(_twins(spark, d)).select("document_id", "ancestor_id", "node_id")


@_add("tree_closure_recursive", f"""WITH RECURSIVE {_TWINS_SQL}, r AS (SELECT document_id, node_id AS ancestor_id, node_id FROM twins UNION ALL SELECT r.document_id, r.ancestor_id, n.node_id FROM r JOIN twins n ON n.document_id = r.document_id AND n.parent_id = r.node_id) SELECT * FROM r""")
def _(spark, d):
    return tree.closure_by_parent(_twins(spark, d))


def _entries(spark, d):
    """Outlines of nations by their customers; of two regions' nations only, so that other documents have none."""
    own = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey < 4")
    return own.select(F.col("n_name").alias("document_id"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 3 + 1).cast("int").alias("level"), F.concat(F.lit("T"), (F.col("c_custkey") % 7).cast("string")).alias("title"), (F.col("c_custkey") % 40).cast("int").alias("page_index"))


_ENTRIES_SQL = """e AS (SELECT n_name AS document_id, c_custkey AS ord, (c_custkey % 3 + 1)::INT AS level, 'T' || c_custkey % 7 AS title, (c_custkey % 40)::INT AS page_index FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4)"""
#: Paths, ids and parents of entries x (document_id, k, level, title, start_page, end_page).
_BUILT_SQL = f"""r AS (SELECT document_id, k, level, title, start_page, end_page, [title] AS path FROM x WHERE k = 1 UNION ALL SELECT x.document_id, x.k, x.level, x.title, x.start_page, x.end_page, list_append(r.path[1:least(len(r.path), x.level - 1)], x.title) FROM r JOIN x ON x.document_id = r.document_id AND x.k = r.k + 1),
i AS (SELECT *, sha256(document_id || '|' || array_to_string(list_transform(path, lambda p: {T.sql_key('p')}), '|') || '|' || level || '|' || start_page || '|0|1|' || start_page) AS node_id FROM r),
built AS (SELECT a.document_id, a.k, any_value(a.node_id) AS node_id, arg_max(b.node_id, b.k) AS parent_id, any_value(array_to_string(a.path, '/')) AS path, any_value(a.start_page) AS start_page, any_value(a.end_page) AS end_page FROM i a LEFT JOIN i b ON a.document_id = b.document_id AND len(a.path) > 1 AND b.path = a.path[1:len(a.path) - 1] AND b.k < a.k GROUP BY 1, 2)"""


def _built(df):
    return df.select("document_id", F.col("ord").cast("long").alias("ord"), "node_id", "parent_id", F.array_join("path", "/").alias("path"), "start_page", "end_page")


@_add("tree_from_outline", f"""
WITH RECURSIVE {_ENTRIES_SQL}, f AS (SELECT *, row_number() OVER w AS k, lead(page_index) OVER w AS nx FROM e WINDOW w AS (PARTITION BY document_id ORDER BY page_index, level, title, ord)),
x AS (SELECT document_id, k, level, title, least(page_index, 29)::INT AS start_page, greatest(least(page_index, 29), least(coalesce(nx, 29), 29))::INT AS end_page FROM f UNION ALL SELECT n_name, 1, 1, 'Document Root', 0, 29 FROM nation WHERE n_name NOT IN (SELECT document_id FROM e)), {_BUILT_SQL}
SELECT document_id, k::BIGINT AS ord, node_id, parent_id, path, start_page, end_page FROM built""")
def _(spark, d):
    counts = table(spark, d, "nation").select(F.col("n_name").alias("document_id"), F.lit(30).alias("page_count"))
    return _built(tree.from_outline(_entries(spark, d), counts))


def _responses(spark, d):
    return _entries(spark, d).select("document_id", "ord", "level", "title", F.col("page_index").alias("start_page"), (F.col("page_index") + 3).alias("end_page"))


@_add("tree_from_responses", f"""
WITH RECURSIVE {_ENTRIES_SQL}, x AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS k, ord, level, title, least(page_index, 29)::INT AS start_page, least(page_index + 3, 29)::INT AS end_page FROM e), {_BUILT_SQL}
SELECT b.document_id, ord::BIGINT AS ord, node_id, parent_id, path, b.start_page, b.end_page FROM built b JOIN x USING (document_id, k)""")
def _(spark, d):
    counts = table(spark, d, "nation").select(F.col("n_name").alias("document_id"), F.lit(30).alias("page_count"))
    return _built(tree.from_responses(_responses(spark, d), counts))


@_add("tree_chunk_merge", f"""
WITH RECURSIVE n AS (SELECT n_name AS document_id, (n_nationkey * 3 % 41)::INT AS page_count FROM nation WHERE n_nationkey * 3 % 41 > 0),
c AS (SELECT document_id, page_count, (s // 8)::INT AS chunk, s::INT AS s, least(s + 9, page_count - 1)::INT AS e FROM (SELECT *, unnest(range(0, page_count, 8)) AS s FROM n) WHERE s = 0 OR s + 1 < page_count - 1),
x AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk, part) AS k, part AS level, CASE part WHEN 1 THEN 'Part ' || chunk ELSE 'P' || s || ',P' || e END AS title, s AS start_page, e AS end_page FROM c, (VALUES (1), (2)) v(part)), {_BUILT_SQL}
SELECT document_id, k::BIGINT - 1 AS ord, node_id, parent_id, path, start_page, end_page FROM built""")
def _(spark, d):
    counts = table(spark, d, "nation").select(F.col("n_name").alias("document_id"), (F.col("n_nationkey") * 3 % 41).cast("int").alias("page_count")).where("page_count > 0")
    pages = counts.select("document_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_index")).withColumn("text", F.concat(F.lit("P"), F.col("page_index").cast("string")))
    node = lambda level, title: F.struct(F.lit(level).alias("level"), title.alias("title"), "start_page", "end_page")
    ends = F.concat_ws(",", F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1))
    ask_chunk = lambda df: df.withColumn("nodes", F.array(node(1, F.concat(F.lit("Part "), F.col("chunk").cast("string"))), node(2, ends)))
    ask_merge = lambda df: df.withColumn("nodes", F.flatten(F.transform("chunks", lambda c: c["nodes"])))
    return _built(tree.synthesize_chunked(pages, counts, ask_chunk, ask_merge))


@_add("tree_summaries", f"""
WITH {NODES_SQL}, leafs AS (SELECT document_id, node_id, parent_id, CASE WHEN start_page % 2 = 0 THEN title ELSE 'm:' || '2' END AS summary, CASE WHEN start_page % 2 = 0 THEN 'passthrough' ELSE 'model' END AS summary_method, start_page FROM nodes WHERE level = 3),
mid AS (SELECT n.document_id, n.node_id, n.parent_id, 'm:' || sum(1 + len(l.summary) - len(replace(l.summary, ' ', ''))) AS summary, 'model' AS summary_method, n.start_page FROM nodes n JOIN leafs l ON l.document_id = n.document_id AND l.parent_id = n.node_id WHERE n.level = 2 GROUP BY ALL),
top AS (SELECT n.document_id, n.node_id, n.parent_id, 'm:' || count(*) AS summary, 'model' AS summary_method, n.start_page FROM nodes n JOIN mid m ON m.document_id = n.document_id AND m.parent_id = n.node_id WHERE n.level = 1 GROUP BY ALL)
SELECT document_id, node_id, summary, summary_method FROM (FROM leafs UNION ALL FROM mid UNION ALL FROM top)""")
def _(spark, d):
    own = nodes(spark, d)
    texts = own.where("level = 3").select("document_id", "node_id", F.when(F.col("start_page") % 2 == 0, F.lit("")).otherwise("two words").alias("text"))
    model = lambda df: df.withColumn("summary", F.concat(F.lit("m:"), T.word_count(F.col("text")).cast("string")))
    return tree.summarize(own, texts, model, 2)


@_add("tree_preorder", f"WITH {NODES_SQL}, w AS (SELECT a.document_id, a.node_id, list((b.start_page, b.end_page, b.title, b.node_id) ORDER BY b.level) AS walk FROM nodes a JOIN nodes b ON a.document_id = b.document_id AND (a.node_id = b.node_id OR starts_with(a.node_id, b.node_id || '/')) GROUP BY 1, 2) SELECT document_id, node_id, row_number() OVER (PARTITION BY document_id ORDER BY walk)::BIGINT - 1 AS preorder FROM w")
def _(spark, d):
    return tree.preorder(nodes(spark, d)).select("document_id", "node_id", F.col("preorder").cast("long").alias("preorder"))


@_add("large_leaves", f"WITH {NODES_SQL} SELECT node_id FROM nodes WHERE level = 3 AND end_page - start_page + 1 > 2")
def _(spark, d):
    return tree.needs_decomposition(nodes(spark, d), 2).select("node_id")


@_add("unassigned_gaps", """
WITH c AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page FROM lineitem WHERE l_quantity > 20),
n AS (SELECT o_orderkey AS document_id, unnest(range(0, 9)) AS page FROM orders),
f AS (SELECT n.document_id, n.page, n.page - row_number() OVER (PARTITION BY n.document_id ORDER BY n.page) AS island FROM n ANTI JOIN c USING (document_id, page)),
e AS (SELECT document_id, min(page) AS lo, max(page) AS hi FROM c GROUP BY 1)
SELECT f.document_id, min(page)::INT AS start_page, max(page)::INT AS end_page, CASE WHEN any_value(lo) IS NULL THEN 'no_verified_nodes' WHEN max(page) < any_value(lo) THEN 'before_first_heading' WHEN min(page) > any_value(hi) THEN 'after_last_heading' ELSE 'between_verified_nodes' END AS reason
FROM f LEFT JOIN e USING (document_id) GROUP BY f.document_id, island""")
def _(spark, d):
    own = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("start_page"), F.col("l_linenumber").alias("end_page"))
    return tree.gaps(own, table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(9).alias("page_count")))


@_add("chunk_boundaries", """
WITH n AS (SELECT o_orderkey AS document_id, (o_orderkey % 40)::INT AS page_count FROM orders), c AS (SELECT document_id, page_count, unnest(range(0, page_count, 8)) AS s FROM n WHERE page_count > 0)
SELECT document_id, (s // 8)::INT AS chunk, s::INT AS start_page, least(s + 9, page_count - 1)::INT AS end_page FROM c WHERE s = 0 OR s - 8 + 9 < page_count - 1""")
def _(spark, d):
    return tree.chunks(table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 40).cast("int").alias("page_count")))


@_add("span_text_join", f"WITH {PAGES_SQL} SELECT a.document_id, sha256(string_agg(text, chr(10) ORDER BY page_index)) AS text_sha FROM (SELECT document_id, max(page_index) AS hi FROM pages GROUP BY 1) a JOIN pages p ON p.document_id = a.document_id AND page_index BETWEEN a.hi // 3 AND a.hi - a.hi // 4 GROUP BY 1")
def _(spark, d):
    pages = ingest.text_pages(lines(spark, d))
    hi = pages.groupBy("document_id").agg(F.max("page_index").alias("hi"))
    spans = hi.select("document_id", F.floor(F.col("hi") / 3).cast("int").alias("start_page"), (F.col("hi") - F.floor(F.col("hi") / 4)).cast("int").alias("end_page"))
    return tree.span_text(spans, pages, []).select("document_id", F.sha2("text", 256).alias("text_sha"))


@_add("content_span_text", f"WITH {PAGES_SQL}, a AS (SELECT document_id, max(page_index) AS hi FROM pages GROUP BY 1) SELECT a.document_id, string_agg(CASE WHEN page_index = 0 AND hi = 0 THEN substr(text, 6, greatest(0, least(30, length(text)) - least(5, length(text)))) WHEN page_index = 0 THEN substr(text, least(5, length(text)) + 1) WHEN page_index = hi THEN substr(text, 1, least(30, length(text))) ELSE text END, chr(10) ORDER BY page_index) AS text FROM a JOIN pages p USING (document_id) GROUP BY 1")
def _(spark, d):
    pages = ingest.text_pages(lines(spark, d))
    spans = pages.groupBy("document_id").agg(F.max("page_index").alias("end_page")).select("document_id", F.lit(0).alias("start_page"), F.lit(5).alias("start_offset"), "end_page", F.lit(30).alias("end_offset"))
    return tree.content_text(spans, pages, [])


@_add("span_merge", """SELECT l_orderkey AS document_id, min((l_linenumber, l_partkey % 50, l_linenumber + 1, l_suppkey))[1] AS start_page, min((l_linenumber, l_partkey % 50, l_linenumber + 1, l_suppkey))[2] AS start_offset, max((l_linenumber, l_partkey % 50, l_linenumber + 1, l_suppkey))[3] AS end_page, max((l_linenumber, l_partkey % 50, l_linenumber + 1, l_suppkey))[4] AS end_offset FROM lineitem GROUP BY 1""")
def _(spark, d):
    spans = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("start_page"), (F.col("l_partkey") % 50).alias("start_offset"), (F.col("l_linenumber") + 1).alias("end_page"), F.col("l_suppkey").alias("end_offset"))
    return search.merge_spans(spans, ["document_id"])


@_add("span_overlap_join", f"""WITH {NODES_SQL} SELECT DISTINCT u.document_id, u.node_id FROM nodes u JOIN nodes s ON s.document_id = u.document_id AND s.level = 3 AND s.title LIKE '%7' AND NOT (u.end_page < s.start_page OR s.end_page < u.start_page)""")
def _(spark, d):
    own = nodes(spark, d)
    units = own.withColumn("unit_id", F.col("node_id"))
    return search.overlapping(units, own.where("level = 3 and title like '%7'")).select("document_id", "node_id")


@_add("parent_span_trim", f"""WITH {NODES_SQL} SELECT n.node_id, coalesce((SELECT min(c.start_page) FROM nodes c WHERE c.document_id = n.document_id AND c.parent_id = n.node_id) - 1, n.end_page)::INT AS own_end FROM nodes n""")
def _(spark, d):
    return tree.trim_parent_spans(nodes(spark, d)).select("node_id", "own_end")


@_add("anchor_match", f"""WITH {NODES_SQL} SELECT n.node_id, a.page AS page_index FROM nodes n JOIN (SELECT lower(c_name) AS t, (c_custkey % 60)::INT AS page FROM customer UNION ALL SELECT lower(n_name), 7 FROM nation) a ON lower(n.title) = a.t AND a.page BETWEEN n.start_page AND n.end_page""")
def _(spark, d):
    own = nodes(spark, d)
    names = table(spark, d, "customer").select(F.lower("c_name").alias("title"), (F.col("c_custkey") % 60).cast("int").alias("page_index")).unionByName(table(spark, d, "nation").select(F.lower("n_name").alias("title"), F.lit(7).alias("page_index")))
    anchors = own.select("document_id").distinct().crossJoin(F.broadcast(names)).withColumn("offset", F.lit(0))
    return tree.match_anchors(own, anchors).select("node_id", "page_index")
