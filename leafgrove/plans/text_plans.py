"""Queries over text functions, lines and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrove.functions import text as T
from leafgrove.operators import ingest, search
from leafgrove.plans.inputs import LINES_SQL, PAGES_SQL, docs, lines, queries, spread, table

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


@_add("text_normalize", f"SELECT doc_id, {T.sql_normalize('text')} AS normalized, {T.sql_key('text')} AS text_key FROM documents")
def _(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.normalize(F.col("text")).alias("normalized"), T.key_of(F.col("text")).alias("text_key"))


@_add("text_tokens", f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t[1:20], ' ') AS first_tokens FROM (SELECT doc_id, {T.sql_tokens('text')} AS t FROM documents)")
def _(spark, d):
    own = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 20), " ").alias("first_tokens"))


@_add("casefold_punct_key", f"SELECT item_id, coalesce(nullif({T.sql_collapse('translate(' + T.sql_fold('text') + chr(44) + chr(39) + T._P + chr(39) + chr(44) + chr(39) + chr(39) + ')')}, ''), '__empty__') AS k FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.punct_key(F.col("text")).alias("k"))


@_add("token_overlap", f"""
SELECT b.item_id, d.doc_id, CASE WHEN len(q) > 0 AND len(t) > 0 THEN len(list_filter(q, lambda x: list_contains(t, x)))::DOUBLE / len(q) ELSE 0 END AS overlap
FROM (SELECT item_id, {T.sql_tokens('text')} AS q FROM benchmark) b JOIN (SELECT doc_id, {T.sql_tokens('text')} AS t FROM documents) d ON true""")
def _(spark, d):
    # An empty token that counts for nothing lets every passage meet every document.
    all_of = lambda tokens: F.concat(tokens, F.array(F.lit("")))
    q = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("q"))
    q = q.select("item_id", F.greatest(F.size("q"), F.lit(1)).alias("size"), F.explode(all_of(F.col("q"))).alias("token"))
    q = q.groupBy("item_id", "size", "token").agg(F.sum(F.when(F.col("token") != "", 1).otherwise(0)).alias("times"))
    t = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.array_distinct(all_of(T.tokens(F.col("text"))))).alias("token"))
    small = q.limit(search.BROADCAST_QUERIES + 1).count() <= search.BROADCAST_QUERIES
    return t.join(F.broadcast(q) if small else q, "token").groupBy("item_id", "doc_id").agg((F.sum("times") / F.max("size")).alias("overlap"))


@_add("text_scalars", f"""
SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
 CASE WHEN right(url, 1) IN ('.', '!', '?') THEN url ELSE url || '.' END AS sentence,
 CASE WHEN {T.sql_collapse('html')} = '' THEN 0 ELSE len(string_split({T.sql_collapse('html')}, ' ')) END::BIGINT AS words,
 CASE WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(md|markdown)$') THEN 'markdown' END AS kind,
 CASE WHEN page_id % 2 = 0 THEN (page_id + 1)::VARCHAR ELSE (page_id + 1)::VARCHAR || '-' || (page_id + 3)::VARCHAR END AS label,
 substr(sha256('unit-' || page_id || '|' || url), 1, 24) AS request_id, least(2.0::DOUBLE, 0.25 * power(2.0, page_id % 6)) AS backoff FROM pages""")
def _(spark, d):
    p, end = F.col("page_id"), F.when(F.col("page_id") % 2 == 0, F.col("page_id")).otherwise(F.col("page_id") + 2)
    return table(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.sentence(F.col("url")).alias("sentence"), T.word_count(F.col("html")).alias("words"), T.source_kind(F.col("url")).alias("kind"), T.page_label(p, end).alias("label"), T.request_id(F.concat(F.lit("unit-"), p.cast("string")), F.col("url")).alias("request_id"), T.backoff_seconds(p % 6 + 1).alias("backoff"))


@_add("markdown_flags", """
SELECT doc_id, regexp_matches(text, '\\|.*\\|.*\\n\\s*\\|[\\s:]*-+[\\s:|-]*\\|') AS has_table, contains(text, '![') AS has_image,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^(#{1,6})[ \\t]+(.+?)(?:[ \\t]+#+[ \\t]*)?$')))::BIGINT AS headings,
 len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(\\*(\\s*\\*){2,}|-(\\s*-){2,}|_(\\s*_){2,})\\s*$')))::BIGINT AS breaks FROM documents""")
def _(spark, d):
    parts = F.split("text", "\n")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.has_table(F.col("text")).alias("has_table"), T.has_image(F.col("text")).alias("has_image"), F.size(F.filter(parts, lambda x: T.heading(x)[0] > 0)).cast("long").alias("headings"), F.size(F.filter(parts, T.thematic_break)).cast("long").alias("breaks"))


@_add("html_anchor_extract", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, strpos(html, '<h1>')::BIGINT - 1 AS offset_at, 1 AS level FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), (F.instr("html", "<h1>") - 1).cast("long").alias("offset_at"), F.lit(1).alias("level"))


@_add("doc_fingerprint", "SELECT sha256(text) AS document_id, doc_id::VARCHAR AS source_path, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS file_size_bytes FROM documents")
def _(spark, d):
    files = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("content"), F.col("doc_id").cast("string").alias("path"))
    return ingest.fingerprints(files)


@_add("logical_pages", f"WITH {LINES_SQL} SELECT document_id, page_index, reading_index, content FROM lines")
def _(spark, d):
    return lines(spark, d).select("document_id", "page_index", "reading_index", "content")


@_add("logical_pages_parsed", f"WITH {LINES_SQL} SELECT document_id, page_index, reading_index, content FROM lines")
def _(spark, d):
    return ingest.markdown_lines(docs(spark, d), 5).select("document_id", "page_index", "reading_index", "content")


@_add("text_lines_offsets", f"""
WITH {LINES_SQL}, o AS (SELECT *, coalesce(sum(length(trim(content)) + 1) OVER (PARTITION BY document_id, page_index ORDER BY reading_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM lines)
SELECT document_id, page_index, reading_index, s AS start_offset, s + length(trim(content)) AS end_offset, {T.sql_key('trim(content)')} AS normalized_text FROM o""")
def _(spark, d):
    own = lines(spark, d).withColumn("content", F.trim("content"))
    out = ingest.text_lines(own)
    return out.select("document_id", "page_index", "reading_index", F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), "normalized_text")


@_add("line_occurrence", f"""
WITH {LINES_SQL} SELECT document_id, page_index, reading_index, row_number() OVER (PARTITION BY document_id, page_index, {T.sql_key('trim(content)')} ORDER BY reading_index)::BIGINT - 1 AS occurrence_index FROM lines""")
def _(spark, d):
    return ingest.text_lines(lines(spark, d)).select("document_id", "page_index", "reading_index", F.col("occurrence_index").cast("long").alias("occurrence_index"))


@_add("text_pages", f"WITH {PAGES_SQL} SELECT document_id, page_index, sha256(text) AS text_sha256, length(text)::BIGINT AS text_length FROM pages")
def _(spark, d):
    return ingest.text_pages(lines(spark, d)).select("document_id", "page_index", "text_sha256", F.col("text_length").cast("long").alias("text_length"))


@_add("line_geometry", f"""
WITH {LINES_SQL} SELECT document_id, page_index, reading_index, reading_index * 14.0::DOUBLE AS top_y, length(content) * 7.0::DOUBLE AS width, 12.0::DOUBLE AS font_size,
 greatest(792.0::DOUBLE, 14.0 * count(*) OVER (PARTITION BY document_id, page_index) + 36.0) AS page_height FROM lines""")
def _(spark, d):
    return ingest.geometry(lines(spark, d)).select("document_id", "page_index", "reading_index", "top_y", "width", "font_size", "page_height")


@_add("trust_histogram", """
WITH b AS (SELECT l_orderkey AS document_id, l_linenumber AS page_index, CASE l_returnflag WHEN 'N' THEN 'native' WHEN 'R' THEN 'external_ocr' ELSE 'visual_vlm' END AS track, l_linestatus, 1 - l_discount * 5 AS confidence FROM lineitem),
t AS (SELECT document_id, CASE WHEN track = 'native' THEN CASE WHEN l_linestatus = 'O' THEN 'native_exact' ELSE 'native_layout_backed' END WHEN track = 'external_ocr' THEN CASE WHEN confidence >= 0.9 THEN 'external_ocr_high' WHEN confidence >= 0.75 THEN 'external_ocr_medium' ELSE 'external_ocr_low' END ELSE 'visual_interpretive' END AS tier FROM b),
c AS (SELECT document_id, tier, count(*) AS n FROM t GROUP BY 1, 2)
SELECT document_id, string_agg(tier || ':' || n, ',' ORDER BY tier) AS tiers, arg_max(tier, (n, tier)) AS dominant_tier FROM c GROUP BY 1""")
def _(spark, d):
    track = F.when(F.col("l_returnflag") == "N", "native").when(F.col("l_returnflag") == "R", "external_ocr").otherwise("visual_vlm")
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("page_index"), track.alias("source_track"), F.when(F.col("l_linestatus") == "O", "authoritative").otherwise("layout").alias("authoritativeness"), (1 - F.col("l_discount") * 5).alias("confidence"))
    tiers = F.array_join(F.transform(F.array_sort(F.map_entries("tiers")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return ingest.page_trust(blocks).select("document_id", tiers.alias("tiers"), "dominant_tier")


@_add("artifact_refs", "SELECT n_nationkey, 'pg://tree/run-' || n_nationkey || '/' || replace(n_name, ' ', '+') || '/pages/text.json' AS ref, replace(n_name, ' ', '+') AS quoted, n_name AS document_id, 'pages/text.json' AS path FROM nation")
def _(spark, d):
    own = table(spark, d, "nation").withColumn("ref", T.artifact_ref(F.lit("tree"), F.concat(F.lit("run-"), F.col("n_nationkey").cast("string")), F.col("n_name"), F.lit("pages/text.json")))
    parsed = T.parse_ref(F.col("ref"))
    return own.select("n_nationkey", "ref", F.url_encode("n_name").alias("quoted"), parsed["document_id"].alias("document_id"), parsed["path"].alias("path"))


@_add("query_words", f"SELECT item_id AS query_id, {T.sql_normalize('text')} AS normalized_query FROM benchmark")
def _(spark, d):
    return queries(spark, d).select("query_id", T.normalize(F.col("query")).alias("normalized_query"))
