"""Queries over units: planning, filters, widening, ranking, selection of documents, answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.functions import text as T
from leafgrove.operators import ingest, planning, qa, search, selection, tree, treesearch
from leafgrove.plans.inputs import NODES_SQL, PAGES_SQL, docs, lines, nodes, queries, table

QUERIES, ORACLE_SQL = {}, {}
#: Hits of a query that excerpts are taken from, as Engine.ask.
HITS = 10


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _units(spark, d):
    """Page units of all documents."""
    return search.page_units(ingest.text_pages(lines(spark, d)))


_UNITS_SQL = PAGES_SQL + """,
units AS (SELECT document_id, 'page-text-' || lpad(page_index::VARCHAR, 6, '0') AS unit_id, 'page_text' AS unit_type, 'text' AS modality, page_index AS start_page, page_index AS end_page, 'Page ' || (page_index + 1) AS title, text FROM pages)"""


def _turns(spark, d):
    """Conversations as documents: a turn is a page, its role the type of its unit."""
    kind = F.when(F.col("role") == "user", "page_text").when(F.col("turn") % 3 == 0, "table").otherwise("visual")
    t = table(spark, d, "conversations")
    return t.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text")).select(F.col("conv_id").alias("document_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"), kind.alias("unit_type"), F.when(kind == "page_text", "text").otherwise(kind).alias("modality"), F.col("turn").cast("int").alias("start_page"), F.col("turn").cast("int").alias("end_page"), F.lit(None).cast("string").alias("title"), "text", F.col("turn").alias("ord"))


_TURNS_SQL = """turns AS (SELECT conv_id AS document_id, conv_id || '-' || turn AS unit_id, CASE WHEN min(role) = 'user' THEN 'page_text' WHEN turn % 3 = 0 THEN 'table' ELSE 'visual' END AS unit_type, turn::INT AS start_page, turn::INT AS end_page, min(text) AS text FROM conversations GROUP BY conv_id, turn)"""


@_add("page_units", f"WITH {_UNITS_SQL} SELECT document_id, unit_id, title, start_page, length(text)::BIGINT AS n FROM units")
def _(spark, d):
    return _units(spark, d).select("document_id", "unit_id", "title", "start_page", F.length("text").cast("long").alias("n"))


@_add("corpus_union", f"""WITH {NODES_SQL}, leafs AS (SELECT * FROM nodes WHERE level = 3)
SELECT document_id, 'node-text-' || node_id AS unit_id, 'node_text' AS unit_type, 0 AS family FROM nodes UNION ALL SELECT document_id, 'node-summary-' || node_id, 'node_summary', 1 FROM leafs WHERE start_page % 2 = 0
UNION ALL SELECT document_id, 'unassigned-span-' || lpad((row_number() OVER (PARTITION BY document_id ORDER BY start_page) - 1)::VARCHAR, 4, '0'), 'unassigned_span', 2 FROM (SELECT r_name AS document_id, 100 + r_regionkey AS start_page FROM region)""")
def _(spark, d):
    own = nodes(spark, d)
    summaries = own.where("level = 3 and start_page % 2 = 0").select("document_id", "node_id", F.col("title").alias("summary"), F.array("title").alias("keywords"))
    gaps = table(spark, d, "region").select(F.col("r_name").alias("document_id"), (F.lit(100) + F.col("r_regionkey")).cast("int").alias("start_page"), (F.lit(100) + F.col("r_regionkey")).cast("int").alias("end_page"))
    texts = gaps.select("document_id", "start_page", F.lit("t").alias("text"))
    return search.union_units(search.node_units(own), search.summary_units(own, summaries), search.gap_units(gaps, texts)).select("document_id", "unit_id", "unit_type", "family")


@_add("corpus_stats", f"""
WITH {_TURNS_SQL}, m AS (SELECT *, CASE unit_type WHEN 'page_text' THEN 'text' ELSE unit_type END AS modality FROM turns), c AS (SELECT document_id, unit_type, count(*) AS n FROM m GROUP BY 1, 2), o AS (SELECT document_id, modality, count(*) AS n FROM m GROUP BY 1, 2),
s AS (SELECT document_id, count(*)::BIGINT AS unit_count, max(end_page)::INT AS last_page FROM turns GROUP BY 1)
SELECT s.*, (SELECT string_agg(unit_type || ':' || n, ',' ORDER BY unit_type) FROM c WHERE c.document_id = s.document_id) AS by_type, (SELECT string_agg(modality || ':' || n, ',' ORDER BY modality) FROM o WHERE o.document_id = s.document_id) AS by_modality FROM s""")
def _(spark, d):
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias(c)
    return search.corpus_stats(_turns(spark, d)).select("document_id", "unit_count", "last_page", shown("by_type"), shown("by_modality"))


@_add("token_postings", f"WITH t AS (SELECT item_id, unnest(list_distinct({T.sql_tokens('text')})) AS token FROM benchmark) SELECT token, count(*)::BIGINT AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM t GROUP BY 1")
def _(spark, d):
    units = queries(spark, d).select(F.lit("b").alias("document_id"), F.col("query_id").alias("unit_id"), F.lit("").alias("title"), F.col("query").alias("text"))
    index = search.inverted_index(units)
    return index.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("unit_id")), ",").alias("ids"))


@_add("plan_fallback", f"""
WITH q AS (SELECT item_id AS query_id, text || CASE item_id % 6 WHEN 0 THEN ' Overview' WHEN 1 THEN ' which figure?' WHEN 2 THEN ' tabular data' WHEN 3 THEN ' Appendix B' WHEN 4 THEN ' the last page' ELSE '' END AS query FROM benchmark),
n AS (SELECT query_id, {T.sql_normalize('query')} AS nq FROM q), t AS (SELECT *, string_split(nq, ' ') AS w FROM n),
f AS (SELECT query_id, nq, list_has_any(w, {search.VISUAL}) AS v, list_has_any(w, {search.TABLE}) AS tb, list_has_any(w, {search.STRUCTURE}) AS st, contains(nq, 'summarize') OR contains(nq, 'summarise') OR contains(nq, 'overview') OR contains(nq, 'what is this document about') AS su FROM t)
SELECT query_id, CASE WHEN su THEN 'document_summary' WHEN v THEN 'visual' WHEN tb THEN 'table' WHEN st THEN 'section' ELSE 'topic' END AS intent, concat_ws(',', CASE WHEN v THEN 'visual' END, CASE WHEN tb THEN 'table' END) AS modality_filters, contains(nq, 'last page') AS wants_last_page FROM f""")
def _(spark, d):
    end = F.when(F.col("query_id") % 6 == 0, " Overview").when(F.col("query_id") % 6 == 1, " which figure?").when(F.col("query_id") % 6 == 2, " tabular data").when(F.col("query_id") % 6 == 3, " Appendix B").when(F.col("query_id") % 6 == 4, " the last page").otherwise("")
    own = queries(spark, d).withColumn("query", F.concat("query", end))
    return search.plan(own).select("query_id", "intent", F.array_join("modality_filters", ",").alias("modality_filters"), "wants_last_page")


@_add("filter_units", f"WITH {_TURNS_SQL} SELECT document_id, unit_id, row_number() OVER (PARTITION BY document_id ORDER BY start_page, end_page, unit_id)::BIGINT AS ord FROM turns WHERE start_page <= 4 AND end_page >= 1 AND unit_type IN ('page_text', 'table')")
def _(spark, d):
    own = search.filter_units(_turns(spark, d), (1, 4), ["page_text", "table"], ["text", "table"])
    return own.select("document_id", "unit_id", F.row_number().over(W.partitionBy("document_id").orderBy(*search.unit_order())).cast("long").alias("ord"))


@_add("last_page_filter", f"WITH {_TURNS_SQL} SELECT document_id, unit_id FROM turns t WHERE start_page = (SELECT max(end_page) FROM turns x WHERE x.document_id = t.document_id)")
def _(spark, d):
    own = _turns(spark, d)
    return own.join(search.last_pages(own), "document_id").where("start_page <= last_page and end_page >= last_page").select("document_id", "unit_id")


_RUNG_SQL = """CASE WHEN (ps IS NULL OR on_page) AND (m = '' OR m = CASE unit_type WHEN 'page_text' THEN 'text' ELSE unit_type END) AND (ut = '' OR ut = unit_type) THEN 0
 WHEN wv THEN CASE WHEN ps IS NULL THEN CASE WHEN unit_type = 'visual' THEN 3 END WHEN unit_type = 'visual' AND on_page THEN 1 WHEN unit_type IN ('page_text', 'table') AND on_page THEN 2 END
 WHEN wt THEN CASE WHEN unit_type = 'table' AND on_page THEN 4 WHEN unit_type IN ('page_text', 'table') AND on_page THEN 5 WHEN unit_type = 'table' THEN 6 END
 WHEN on_page THEN 7 WHEN ut = unit_type THEN 8 ELSE 9 END"""


@_add("widen_ladder", f"""
WITH {_TURNS_SQL}, plans(query_id, wv, wt, ps, pe, m, ut) AS (VALUES (1, true, false, 1, 1, 'visual', ''), (2, false, true, 2, 2, 'table', ''), (3, false, false, 9, 9, '', ''), (4, false, true, NULL, NULL, 'table', ''), (5, true, false, NULL, NULL, 'visual', ''), (6, false, false, 9, 9, '', 'table')),
p AS (SELECT *, ps IS NOT NULL AND start_page <= pe AND end_page >= ps AS on_page FROM turns, plans), r AS (SELECT *, {_RUNG_SQL} AS rung FROM p)
SELECT query_id, document_id, unit_id, rung, (['', {', '.join(f"'{x}'" for x in search.REASONS)}])[rung + 1] AS reason FROM (SELECT *, min(rung) OVER (PARTITION BY query_id, document_id) AS least FROM r WHERE rung IS NOT NULL) WHERE rung = least""")
def _(spark, d):
    plan = lambda k, visual, table_, page, kind, types=(): F.struct(F.lit(k).alias("query_id"), F.lit(visual).alias("wants_visual"), F.lit(table_).alias("wants_table"), F.lit(page).cast("int").alias("page_start"), F.lit(page).cast("int").alias("page_end"), F.array(*map(F.lit, kind)).cast("array<string>").alias("modality_filters"), F.array(*map(F.lit, types)).cast("array<string>").alias("unit_types"))
    plans = F.array(plan(1, True, False, 1, ["visual"]), plan(2, False, True, 2, ["table"]), plan(3, False, False, 9, []), plan(4, False, True, None, ["table"]), plan(5, True, False, None, ["visual"]), plan(6, False, False, 9, [], ["table"]))
    own = _turns(spark, d)
    requests = own.select("document_id").distinct().select("document_id", F.explode(plans).alias("p")).select("document_id", "p.*")
    return search.widened(own, requests).select("query_id", "document_id", "unit_id", "rung", F.coalesce("widening_reason", F.lit("")).alias("reason"))


#: Requests of every conversation: query, and what its keyword plan holds (visual, table, last page).
_ASKED = [(1, "What does the figure on the last page show?", True, False, True), (2, "Tabular data of the river, and stone", False, True, False), (3, "the section about it and you", False, False, False), (4, "THE last page", False, False, True), (5, "an overview of it", False, False, False)]
_REQUESTS_SQL = f"""{_TURNS_SQL}, q(query_id, query, wv, wt, at_end, m, ut, intent) AS (VALUES {', '.join(f"({k}, '{q}', {v}, {t}, {p}, '{'visual' if v else 'table' if t else ''}', '', '{'document_summary' if 'overview' in q else 'visual' if v else 'table' if t else 'section' if 'section' in q else 'topic'}')" for k, q, v, t, p in _ASKED)}),
ends AS (SELECT document_id, max(end_page) AS lp FROM turns GROUP BY 1), joined AS (SELECT q.*, t.*, CASE WHEN at_end THEN lp END AS ps, CASE WHEN at_end THEN lp END AS pe FROM turns t JOIN ends USING (document_id), q),
p AS (SELECT *, ps IS NOT NULL AND start_page <= pe AND end_page >= ps AS on_page FROM joined), r AS (SELECT *, {_RUNG_SQL} AS rung FROM p),
kept AS (SELECT * FROM r WHERE rung IS NOT NULL QUALIFY rung = min(rung) OVER (PARTITION BY query_id, document_id)),
scored AS (SELECT *, 2.0::DOUBLE * len(list_intersect(list_distinct({T.sql_tokens('text')}), list_distinct({T.sql_tokens('query')}))) AS score FROM kept),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, start_page, unit_id)::BIGINT AS rank FROM scored QUALIFY rank <= 5)"""


def _requests(spark, d):
    asked = F.array(*(F.struct(F.lit(k).alias("query_id"), F.lit(q).alias("query")) for k, q, *_ in _ASKED))
    return _turns(spark, d).select("document_id").distinct().select("document_id", F.explode(asked).alias("a")).select("document_id", "a.*")


@_add("search_orchestrated", f"WITH {_REQUESTS_SQL} SELECT query_id, document_id, unit_id, score, rank, (['', {', '.join(f"'{x}'" for x in search.REASONS)}])[rung + 1] AS reason FROM hits")
def _(spark, d):
    own = search.orchestrate(_turns(spark, d), _requests(spark, d), 5)
    return own.select("query_id", "document_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"), F.coalesce("widening_reason", F.lit("")).alias("reason"))


@_add("qa_answers", f"""
WITH {_REQUESTS_SQL}, lined AS (SELECT query_id, document_id, unit_id, trim(x) AS line, k, len(list_intersect(list_distinct({T.sql_tokens('x')}), list_distinct({T.sql_tokens('query')}))) AS n FROM (SELECT *, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM hits) WHERE trim(x) <> ''),
ex AS (SELECT query_id, document_id, unit_id, substr(line, 1, 280) AS excerpt FROM lined QUALIFY row_number() OVER (PARTITION BY query_id, document_id, unit_id ORDER BY n DESC, k) = 1),
h AS (SELECT hits.*, excerpt, unit_type IN ('page_text', 'table') AS auth FROM hits LEFT JOIN ex USING (query_id, document_id, unit_id)),
pref AS (SELECT *, CASE WHEN wt THEN unit_type = 'table' ELSE unit_type = 'page_text' END AS one FROM (SELECT * FROM h QUALIFY auth OR NOT bool_or(auth) OVER (PARTITION BY query_id, document_id))),
g AS (SELECT *, coalesce(nullif({T.sql_normalize("coalesce(excerpt, '')")}, ''), unit_id) AS key FROM pref QUALIFY one OR NOT bool_or(one) OVER (PARTITION BY query_id, document_id)),
grounded AS (SELECT query_id, document_id, least(3, count(DISTINCT key)) AS n FROM g GROUP BY 1, 2),
a AS (SELECT query_id, document_id, any_value(intent) AS intent, any_value(wv) AS wv, count(*) AS n_hits, bool_or(score > 0) AS lexical, bool_or(auth) AS auth, bool_or(unit_type = 'visual') AS visual FROM h GROUP BY 1, 2),
every AS (SELECT document_id, q.query_id, q.intent FROM ends, q),
summaries AS (SELECT document_id, bool_or(unit_type = 'page_text' AND coalesce(text, '') <> '') AS speaks FROM turns GROUP BY 1)
SELECT e.query_id, e.document_id, e.intent, CASE WHEN e.intent = 'document_summary' THEN CASE WHEN speaks THEN 'document_summary_fallback' ELSE 'document_summary_unavailable' END
 WHEN coalesce(n_hits, 0) = 0 THEN 'no_hits' WHEN e.intent IN ('topic', 'section', 'quote') AND NOT lexical THEN 'low_evidence'
 WHEN e.intent = 'visual' THEN CASE WHEN visual THEN 'visual_interpretation_unavailable' ELSE 'visual_no_hits' END
 WHEN NOT auth THEN 'interpretive_fallback' WHEN n = 1 THEN 'authoritative_text' ELSE 'grounded_multi_excerpt' END AS answer_mode
FROM every e LEFT JOIN a USING (query_id, document_id) LEFT JOIN grounded USING (query_id, document_id) LEFT JOIN summaries USING (document_id)""")
def _(spark, d):
    return qa.answers(_turns(spark, d), _requests(spark, d), k=5).select("query_id", "document_id", "intent", "answer_mode")


_RANK_SQL = f"""b AS (SELECT doc_id, unnest(list_distinct({T.sql_tokens('text')})) AS token FROM documents), q AS (SELECT item_id AS query_id, unnest(list_distinct({T.sql_tokens('text')})) AS token FROM benchmark),
hits AS (SELECT query_id, doc_id, 2.0::DOUBLE * count(*) AS score FROM b JOIN q USING (token) GROUP BY 1, 2)"""


def _ranked(spark, d):
    return docs(spark, d).select("document_id", F.col("document_id").alias("unit_id"), F.col("document_id").alias("cand_ord"), F.lit(None).cast("string").alias("title"), "text")


@_add("rank_keyword", f"WITH {_RANK_SQL} SELECT query_id, doc_id AS document_id, score FROM hits")
def _(spark, d):
    return search.rank(_ranked(spark, d), queries(spark, d)).select("query_id", "document_id", "score")


@_add("rank_topk_batch", f"WITH {_RANK_SQL} SELECT query_id, doc_id AS document_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM hits) WHERE rank <= 3")
def _(spark, d):
    return search.rank(_ranked(spark, d), queries(spark, d), 3).select("query_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


@_add("rank_model_scores", "WITH s AS (SELECT o_orderkey, o_custkey % 10 AS q, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS s FROM orders) SELECT o_orderkey AS unit_id, q AS query_id, coalesce(s, 0.0::DOUBLE) AS score FROM s")
def _(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 10).alias("query_id"), F.col("o_totalprice").alias("score"))
    return search.with_model_scores(own.drop("score"), own.where("unit_id % 3 = 0")).select("unit_id", "query_id", "score")


@_add("full_text_units", f"WITH {_UNITS_SQL} SELECT document_id, unit_id FROM units WHERE list_has_all({T.sql_tokens('title || chr(32) || text')}, ['the', 'and', 'of'])")
def _(spark, d):
    return search.full_text(_units(spark, d), "The and, of!").select("document_id", "unit_id")


@_add("first_occurrence_dedupe", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS k FROM documents) WHERE k = 1")
def _(spark, d):
    return search.dedupe(table(spark, d, "documents"), ["source", "lang"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@_add("qa_excerpt", f"""
WITH {_RANK_SQL}, top AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= {HITS}), p AS (SELECT item_id AS query_id, {T.sql_tokens('text')} AS q FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
s AS (SELECT query_id, doc_id, trim(line) AS line, k, len(list_intersect(list_distinct(q), list_distinct({T.sql_tokens('line')}))) AS n FROM l JOIN top USING (doc_id) JOIN p USING (query_id) WHERE trim(line) <> '')
SELECT query_id, doc_id AS document_id, substr(line, 1, 280) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, k) AS r FROM s) WHERE r = 1""")
def _(spark, d):
    found = search.rank(_ranked(spark, d), queries(spark, d), HITS).select("query_id", "document_id")
    hits = found.join(docs(spark, d), "document_id").join(F.broadcast(queries(spark, d)), "query_id")
    # Texts without a line have no excerpt; asked of the text, as the optimizer would compute an excerpt again to filter by it.
    return search.excerpts(hits.where(F.translate("text", " \n", "") != "")).select("query_id", "document_id", "excerpt")


def _records(spark, d):
    own = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    return own.select(F.col("doc_id").alias("document_id"), F.concat_ws(" ", F.lit("Doc"), F.col("source"), F.col("lang")).alias("display_name"), "lang", "source", "n_chars", "quality", (F.col("toxic") == 1).alias("toxic"))


_RECORDS_SQL = "r AS (SELECT d.doc_id AS document_id, 'Doc ' || source || ' ' || lang AS display_name, lang, source, n_chars, quality, toxic = 1 AS toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))"
_META = {
    "meta_eq": ([selection.Clause("lang", "eq", "de"), selection.Clause("toxic", "eq", False)], "lang = 'de' AND toxic = false"),
    "meta_in": ([selection.Clause("source", "in", ["src1", "src2", 3])], "source IN ('src1', 'src2')"),
    "meta_contains": ([selection.Clause("source", "contains", "RC1")], "contains(lower(source), 'rc1')"),
    "meta_range": ([selection.Clause("n_chars", "gte", 900), selection.Clause("n_chars", "lte", 3000.5), selection.Clause("lang", "gte", 1)], "n_chars >= 900 AND n_chars <= 3000.5 AND false"),
    "meta_number_is_not_bool": ([selection.Clause("quality", "eq", True)], "false"),
    "meta_between": ([selection.Clause("n_chars", "gte", 900), selection.Clause("n_chars", "lte", 3000.5)], "n_chars >= 900 AND n_chars <= 3000.5"),
}
for _name, (_clauses, _where) in _META.items():
    _add(_name, f"WITH {_RECORDS_SQL} SELECT document_id FROM r WHERE {_where}")(lambda spark, d, c=_clauses: selection.filter_metadata(_records(spark, d), c).select("document_id"))


@_add("meta_candidates", f"""
WITH {_RECORDS_SQL}, f AS (SELECT * FROM r WHERE lang = 'en' AND n_chars >= 500 ORDER BY lower(display_name), document_id LIMIT 60), b AS (SELECT document_id, {T.sql_normalize("display_name || ' ' || lang || ' ' || n_chars")} AS body FROM f)
SELECT document_id, 2.0 + len(list_intersect(['doc', 'en', 'src7'], list_distinct(string_split(body, ' '))))::DOUBLE / 3 + CASE WHEN contains(body, 'doc en src7') THEN 1.0 ELSE 0.0 END AS score FROM b""")
def _(spark, d):
    return selection.metadata_candidates(_records(spark, d), [selection.Clause("lang", "eq", "en"), selection.Clause("n_chars", "gte", 500)], "Doc EN src7", 60).select("document_id", "score")


_PROXY_SQL = """x AS (SELECT p_partkey AS document_id, p_name AS display_name, p_type AS description, p_brand || ' ' || p_type AS summary, p_brand || ' size ' || p_size AS keywords FROM part)"""
_FIELDS = {"display_name": 1.0, "description": 2.0, "summary": 1.5, "keywords": 1.0}
_OV = {c: f"len(list_filter(q, lambda t: list_contains(string_split({T.sql_normalize(c)}, ' '), t)))::DOUBLE / len(q)" for c in _FIELDS}


def _proxies(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("display_name"), F.col("p_type").alias("description"), F.concat_ws(" ", "p_brand", "p_type").alias("summary"), F.split(F.concat(F.col("p_brand"), F.lit(" size "), F.col("p_size").cast("string")), " ").alias("keywords"))


def _part_queries(spark, d):
    """Every distinct type and brand, under the least key that has it, and the insides of every distinct word of a type, under lesser ids."""
    part = table(spark, d, "part")
    own = part.groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.concat_ws(" ", "p_type", "p_brand", "p_brand").alias("query"))
    first = F.split("p_type", " ")[0]
    return own.unionByName(part.groupBy(first.alias("word")).agg((-1 - F.min("p_partkey")).alias("query_id")).select("query_id", F.substring("word", 2, 3).alias("query")))


@_add("prefilter_lexical", f"""
WITH {_PROXY_SQL}, qq AS (SELECT p_partkey AS query_id, {T.sql_normalize("p_type || ' ' || p_brand || ' ' || p_brand")} AS nq, {T.sql_tokens("p_type || ' ' || p_brand || ' ' || p_brand")} AS q FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_type, p_brand) UNION ALL SELECT -1 - min(p_partkey), substr(lower(p_type), 2, 3), [substr(lower(p_type), 2, 3)] FROM (SELECT p_partkey, string_split(p_type, ' ')[1] AS p_type FROM part) GROUP BY p_type),
s AS (SELECT query_id, document_id, {' + '.join(f'{w}::DOUBLE * ({_OV[c]})' for c, w in _FIELDS.items())} + CASE WHEN contains({' || chr(32) || '.join(T.sql_normalize(c) for c in _FIELDS)}, nq) THEN 0.5 ELSE 0.0 END AS score FROM x, qq)
SELECT query_id, document_id, round(score, 9) AS score FROM s WHERE score > 0""")
def _(spark, d):
    return selection.lexical_prefilter(_proxies(spark, d), _part_queries(spark, d)).select("query_id", "document_id", F.round("score", 9).alias("score"))


@_add("desc_select", f"""
WITH {_PROXY_SQL}, b AS (SELECT document_id, {T.sql_normalize("display_name || ' ' || description")} AS body FROM x), q AS (SELECT ['large', 'brushed', 'large', 'tin'] AS q)
SELECT document_id, len(list_filter(q, lambda t: list_contains(string_split(body, ' '), t)))::DOUBLE / 4 + CASE WHEN contains(body, 'large brushed large tin') THEN 1.0 ELSE 0.0 END AS score FROM b, q""")
def _(spark, d):
    return selection.description_scores(_proxies(spark, d), "LARGE brushed, large tin").select("document_id", "score")


@_add("preference_select", f"""
WITH s AS (SELECT p_partkey AS preference_id, p_name || ' ' || p_type AS text, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS scope, p_partkey % 3 AS priority FROM part),
t AS (SELECT *, {T.sql_normalize('text')} AS n FROM s), o AS (SELECT *, len(list_filter(['brushed', 'tin', 'tin'], lambda x: list_contains(string_split(n, ' '), x)))::DOUBLE / 3 + CASE WHEN contains(n, 'brushed tin tin') THEN 0.5 ELSE 0.0 END AS score FROM t)
SELECT preference_id, row_number() OVER (ORDER BY score DESC, priority DESC, scope, preference_id)::BIGINT AS place, score FROM o WHERE score > 0 QUALIFY place <= 40""")
def _(spark, d):
    scope = F.when(F.col("p_partkey") % 4 == 0, "global").when(F.col("p_partkey") % 4 == 1, "user").when(F.col("p_partkey") % 4 == 2, "tenant").otherwise("domain_rule")
    own = table(spark, d, "part").select(F.col("p_partkey").alias("preference_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), scope.alias("scope"), (F.col("p_partkey") % 3).alias("priority"))
    best = selection.select_preferences(own, "Brushed tin, TIN!", 40)
    return best.select("preference_id", F.row_number().over(W.orderBy(*selection.preference_order())).cast("long").alias("place"), "score")


@_add("description_shards", f"SELECT document_id, ((row_number() OVER (ORDER BY lower(display_name), document_id) - 1) // 25)::BIGINT AS shard FROM (SELECT p_partkey AS document_id, p_name AS display_name FROM part)")
def _(spark, d):
    return selection.shards(_proxies(spark, d)).select("document_id", "shard")


@_add("like_escape", "SELECT item_id, replace(replace(replace(text || '50%_a\\b', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS pattern FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", selection.like_escaped(F.concat("text", F.lit("50%_a\\b"))).alias("pattern"))


@_add("unknown_node_ids", f"WITH {NODES_SQL}, c AS (SELECT r_name AS document_id, unnest([r_name, r_name || '/none', 'zz', r_name || '/none']) AS node_id FROM region) SELECT document_id, array_to_string(list_sort(list_distinct(list(node_id))), ',') AS unknown FROM c ANTI JOIN nodes USING (document_id, node_id) GROUP BY 1")
def _(spark, d):
    claimed = table(spark, d, "region").select(F.col("r_name").alias("document_id"), F.array("r_name", F.concat("r_name", F.lit("/none")), F.lit("zz"), F.concat("r_name", F.lit("/none"))).alias("ids"))
    return search.unknown_ids(claimed, nodes(spark, d), ["document_id"]).select("document_id", F.array_join("unknown", ",").alias("unknown"))


@_add("best_candidates", "SELECT document_id, s AS score, r AS reason FROM (SELECT o_custkey AS document_id, max((round(o_totalprice, -3), o_orderpriority)) AS m, m[1] AS s, m[2] AS r FROM orders GROUP BY 1)")
def _(spark, d):
    return selection.merge_candidates(table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.round("o_totalprice", -3).alias("score"), F.col("o_orderpriority").alias("reason")))


@_add("frontier_scores", f"""
WITH {NODES_SQL}, q AS (SELECT ['asia', 'nation', '1'] AS q), t AS (SELECT node_id, string_split({T.sql_normalize('title')}, ' ') AS t, string_split({T.sql_normalize("array_to_string(path, ' ')")}, ' ') AS k FROM nodes)
SELECT node_id, 2.0::DOUBLE * (len(list_filter(q, lambda x: list_contains(t, x)))::DOUBLE / 3) + 1.0 * (len(list_filter(q, lambda x: list_contains(k, x)))::DOUBLE / 3) AS score FROM t, q""")
def _(spark, d):
    own = nodes(spark, d).withColumn("summary", F.lit("")).withColumn("keywords", F.col("path"))
    return own.select("node_id", treesearch.frontier_score(F.array(*map(F.lit, ("asia", "nation", "1")))).alias("score"))


def _walk_sql(name: str, own: str) -> str:
    """One step of the walk: the frontier of each pair, capped, scored, and the nodes that it picks."""
    ov = lambda x: f"len(list_filter(q, lambda x: list_contains({T.sql_tokens(x)}, x)))::DOUBLE / len(q)"
    return f"""{name}_f AS (SELECT f.*, row_number() OVER (PARTITION BY query_id, document_id ORDER BY start_page, end_page, level, path, node_id) AS place FROM ({own}) f),
{name}_s AS (SELECT *, 2.0::DOUBLE * ({ov('title')}) + 1.0 * ({ov("array_to_string(path, ' ')")}) AS score FROM {name}_f WHERE place <= 8),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, place) AS k, max(score) OVER (PARTITION BY query_id, document_id) AS best, count(*) OVER (PARTITION BY query_id, document_id) AS n FROM {name}_s),
{name} AS (SELECT * FROM {name}_k WHERE CASE WHEN best > 0 THEN k <= 2 AND score >= greatest(0.2, best * 0.5) ELSE n = 1 END)"""


_CHILDREN_SQL = "SELECT p.query_id, p.q, n.* FROM {} p JOIN nodes n ON n.document_id = p.document_id AND n.parent_id = p.node_id"


@_add("tree_search_batch", f"""
WITH {NODES_SQL}, asked AS (SELECT n_nationkey AS query_id, {T.sql_tokens('n_name')} AS q FROM nation),
{_walk_sql('one', 'SELECT query_id, q, nodes.* FROM nodes, asked WHERE parent_id IS NULL')},
{_walk_sql('two', _CHILDREN_SQL.format('one'))},
{_walk_sql('three', _CHILDREN_SQL.format('two'))}
SELECT query_id, document_id, node_id, score, 'leaf' AS signal FROM three""")
def _(spark, d):
    own = nodes(spark, d).withColumn("summary", F.lit("")).withColumn("keywords", F.col("path"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    found = treesearch.search(own, asked)
    return found.candidates.select("query_id", "document_id", "node_id", "score", "signal")


@_add("qa_grounding", f"""
WITH {_TURNS_SQL}, h AS (SELECT *, (length(text) % 17)::DOUBLE AS score, CASE WHEN unit_type = 'page_text' THEN 0 WHEN unit_type = 'table' THEN 1 ELSE 3 END AS cls FROM turns),
e AS (SELECT *, bool_or(unit_type = 'page_text') OVER (PARTITION BY document_id) AS p, bool_or(unit_type = 'table') OVER (PARTITION BY document_id) AS t FROM h),
c AS (SELECT * FROM e WHERE CASE WHEN p THEN unit_type = 'page_text' WHEN t THEN unit_type = 'table' ELSE true END),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY cls, score DESC, start_page, unit_id) AS o, coalesce(nullif({T.sql_normalize('text')}, ''), unit_id) AS g FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id, g ORDER BY o) AS first FROM k)
SELECT document_id, unit_id, row_number() OVER (PARTITION BY document_id ORDER BY o)::BIGINT AS place FROM f WHERE first = 1 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY o) <= 3""")
def _(spark, d):
    hits = _turns(spark, d).withColumn("query_id", F.lit(1)).withColumn("score", (F.length("text") % 17).cast("double")).withColumn("excerpt", F.col("text")).withColumn("cand_ord", F.struct("start_page", "unit_id"))
    return qa.grounding(hits).select("document_id", "unit_id", F.col("place").cast("long").alias("place"))


def _scripted():
    """A client whose answers are rules of the payload, in place of a model."""
    import json

    def client(operation, payload):
        p = json.loads(payload)
        if operation == "query_planning":
            if "figure" in p["query"]:
                return "no JSON"
            return json.dumps({"intent": "table" if "river" in p["query"] else "page", "page_start": 1, "page_end": 0, "modality_filters": ["table"] if "river" in p["query"] else []})
        if operation == "retrieval_ranking":
            return json.dumps({"scores": [{"unit_id": c["unit_id"], "score": len(c["text"]) % 10 / 10} for c in p["candidates"]] + [{"unit_id": "unknown", "score": 1.0}]})
        return json.dumps({"selected": [{"document_id": str(x["document_id"]), "score": 0.5, "reason": "named"} for x in p["documents"] if p["query"] in x["description"]] + [{"document_id": "none", "score": 1.0, "reason": ""}]})

    return client


@_add("model_plans", f"""WITH {_REQUESTS_SQL}, every AS (SELECT document_id, lp, q.* FROM ends, q)
SELECT query_id, document_id, CASE WHEN wv THEN intent WHEN wt THEN 'table' ELSE 'page' END AS intent, CASE WHEN wv THEN lp ELSE 1 END::INT AS page_start, CASE WHEN wv THEN lp ELSE 1 END::INT AS page_end, CASE WHEN wv THEN 'visual' WHEN wt THEN 'table' ELSE '' END AS modality_filters FROM every""")
def _(spark, d):
    return planning.plans(_turns(spark, d), _requests(spark, d), _scripted).select("query_id", "document_id", "intent", "page_start", "page_end", F.array_join("modality_filters", ",").alias("modality_filters"))


@_add("model_ranks", f"""WITH {_TURNS_SQL} SELECT document_id, unit_id, (length(text[1:500]) % 10)::DOUBLE / 10 AS score, row_number() OVER (PARTITION BY document_id ORDER BY length(text[1:500]) % 10 DESC, start_page, end_page, unit_id)::BIGINT AS rank FROM turns QUALIFY rank <= 3""")
def _(spark, d):
    own = _turns(spark, d).withColumns({"query_id": F.lit(1), "query": F.lit("any")})
    return planning.rank_by_model(own, _scripted, 3).select("document_id", "unit_id", "score", F.col("rank").cast("long").alias("rank"))


@_add("model_descriptions", f"WITH {_PROXY_SQL} SELECT q.id AS query_id, document_id::VARCHAR AS document_id, 0.5::DOUBLE AS score FROM x JOIN (VALUES (1, 'BRUSHED'), (2, 'TIN')) q(id, query) ON contains(description, query)")
def _(spark, d):
    asked = spark.createDataFrame([(1, "BRUSHED"), (2, "TIN")], "query_id int, query string")
    return planning.select_by_description(_proxies(spark, d), asked, _scripted).select("query_id", "document_id", "score")


@_add("usage_totals", "SELECT o_custkey AS k, sum(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 7 + 1 END)::BIGINT AS prompt_tokens, sum(CASE WHEN o_orderkey % 2 > 0 THEN 2 END)::BIGINT AS completion_tokens, NULL::BIGINT AS total_tokens FROM orders GROUP BY 1")
def _(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey") % 7 + 1).cast("long").alias("prompt_tokens"), F.when(F.col("o_orderkey") % 2 > 0, 2).cast("long").alias("completion_tokens"), F.lit(None).cast("long").alias("total_tokens"))
    return planning.usage_totals(calls, ["k"])


@_add("image_data_urls", "SELECT item_id, 'data:image/png;base64,' || to_base64(encode(text)) AS url FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", planning.data_url(F.lit("image/png"), F.encode("text", "UTF-8")).alias("url"))
