"""Retrieval units, planning, filtering, widening, ranking: all queries over all documents in one plan.

units: document_id, unit_id, unit_type, modality, start_page, end_page, title, text, keywords, node_id, authoritative,
interpretive. queries: query_id, query, and the plan's columns. The query side is the small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.functions import text as T

#: Words and phrases of the keyword planner.
VISUAL = ["image", "photo", "figure", "diagram", "chart", "illustration"]
TABLE = ["table", "tabular"]
STRUCTURE = ["section", "chapter", "appendix", "heading"]
SUMMARY = ["summarize", "summarise", "overview", "what is this document about"]
TEXT_TYPES = ["page_text", "table", "unassigned_span"]
VISUAL_TYPES = ["visual", "unresolved_visual"]
#: The names of the rungs of widening, in their order.
REASONS = ["same_page_visual", "same_page_text_for_visual_query", "all_visual_units", "same_page_tables", "same_page_text_for_table_query", "all_table_units", "same_page_units", "matching_unit_types", "full_corpus_fallback"]
#: The query side is broadcast up to so many rows, else shuffled on tokens.
BROADCAST_QUERIES = 100_000
#: Units of a task in which pairs of units and queries are added up.
DEALT = 1_000


def page_units(pages: DataFrame) -> DataFrame:
    """A unit for each page with text."""
    number = F.format_string("page-text-%06d", "page_index")
    return pages.where(T.collapse(F.col("text")) != "").select("document_id", number.alias("unit_id"), F.lit("page_text").alias("unit_type"), F.lit("text").alias("modality"), F.col("page_index").alias("start_page"), F.col("page_index").alias("end_page"), F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string")).alias("title"), "text")


def table_units(tables: DataFrame) -> DataFrame:
    """A unit for each table: its Markdown, else its rows, cells by ` | `."""
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    return tables.select("document_id", F.concat(F.lit("table-"), F.col("block_id")).alias("unit_id"), F.lit("table").alias("unit_type"), F.lit("table").alias("modality"), F.col("page_index").alias("start_page"), F.col("page_index").alias("end_page"), F.lit(None).cast("string").alias("title"), F.coalesce("markdown", rows).alias("text"))


def visual_units(visuals: DataFrame, attachments: DataFrame) -> DataFrame:
    """Units of visual blocks; attached descriptions override text and keywords."""
    own = visuals.join(attachments.select("document_id", F.col("region_id").alias("block_id"), F.col("description").alias("d"), F.col("keywords").alias("k")), ["document_id", "block_id"], "left")
    kind = F.when(F.col("resolved"), "visual").otherwise("unresolved_visual")
    return own.select("document_id", F.concat(F.lit("visual-"), F.col("block_id")).alias("unit_id"), kind.alias("unit_type"), F.lit("visual").alias("modality"), F.col("page_index").alias("start_page"), F.col("page_index").alias("end_page"), F.col("caption").alias("title"), F.coalesce("d", "text").alias("text"), F.coalesce("k", F.array().cast("array<string>")).alias("keywords"), F.col("d").isNotNull().alias("interpretive"))


def node_units(nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A unit for each node; its text from owned spans (null without them), its keywords the distinct parts of its path."""
    own = nodes if texts is None else nodes.join(texts.select("document_id", "node_id", "text"), ["document_id", "node_id"], "left")
    text = F.lit(None).cast("string") if texts is None else F.col("text")
    return own.select("document_id", F.concat(F.lit("node-text-"), F.col("node_id")).alias("unit_id"), F.lit("node_text").alias("unit_type"), F.lit("text").alias("modality"), "start_page", "end_page", "title", text.alias("text"), F.array_distinct("path").alias("keywords"), "node_id")


def summary_units(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """A unit for each summary with a node."""
    own = nodes.join(summaries.select("document_id", "node_id", "summary", "keywords"), ["document_id", "node_id"])
    return own.select("document_id", F.concat(F.lit("node-summary-"), F.col("node_id")).alias("unit_id"), F.lit("node_summary").alias("unit_type"), F.lit("text").alias("modality"), "start_page", "end_page", "title", F.col("summary").alias("text"), "keywords", "node_id")


def gap_units(gaps: DataFrame, texts: DataFrame) -> DataFrame:
    """A unit for each run of pages that no node covers."""
    k = F.row_number().over(W.partitionBy("document_id").orderBy("start_page")) - 1
    own = gaps.join(texts, ["document_id", "start_page"], "left")
    return own.select("document_id", F.format_string("unassigned-span-%04d", k).alias("unit_id"), F.lit("unassigned_span").alias("unit_type"), F.lit("text").alias("modality"), "start_page", "end_page", F.lit(None).cast("string").alias("title"), "text")


def union_units(*families: DataFrame) -> DataFrame:
    """All families by name, with the order of the families as corpus order."""
    out = None
    for k, family in enumerate(families):
        family = family.withColumn("family", F.lit(k))
        out = family if out is None else out.unionByName(family, allowMissingColumns=True)
    return out


def corpus_stats(units: DataFrame) -> DataFrame:
    """Numbers of units by type and by modality, as maps with sorted keys."""
    sizes = units.groupBy("document_id").agg(F.count("*").alias("unit_count"), F.max("end_page").alias("last_page"))
    for key in ("unit_type", "modality"):
        counts = units.groupBy("document_id", key).agg(F.count("*").alias("n")).groupBy("document_id")
        sizes = sizes.join(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(f"by_{key.removeprefix('unit_')}")), "document_id")
    return sizes


def corpus_checksum(units: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of each document's units that does not depend on their order."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    return units.groupBy("document_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("checksum"))


def plan(queries: DataFrame) -> DataFrame:
    """Keyword plan of each query (query_id, query)."""
    normal = T.normalize(F.col("query"))
    words = F.split("normalized_query", " ")
    has = lambda own: F.arrays_overlap(words, F.array(*map(F.lit, own)))
    summary = F.lit(False)
    for phrase in SUMMARY:
        summary = summary | F.contains(F.col("normalized_query"), F.lit(phrase))
    out = queries.withColumn("normalized_query", normal).withColumns({"wants_visual": has(VISUAL), "wants_table": has(TABLE), "wants_structure": has(STRUCTURE), "wants_summary": summary, "wants_last_page": F.contains(F.col("normalized_query"), F.lit("last page"))})
    intent = F.when(F.col("wants_summary"), "document_summary").when(F.col("wants_visual"), "visual").when(F.col("wants_table"), "table").when(F.col("wants_structure"), "section").otherwise("topic")
    return out.withColumn("intent", intent).withColumn("modality_filters", F.array_compact(F.array(F.when(F.col("wants_visual"), "visual"), F.when(F.col("wants_table"), "table"))))


def last_pages(units: DataFrame) -> DataFrame:
    return units.groupBy("document_id").agg(F.max("end_page").alias("last_page"))


def intersects(a: str, b: str) -> Column:
    return ~((F.col(f"{a}end_page") < F.col(f"{b}start_page")) | (F.col(f"{b}end_page") < F.col(f"{a}start_page")))


def filter_units(units: DataFrame, page: tuple[int, int] | None = None, types: list[str] = (), modalities: list[str] = ()) -> DataFrame:
    """Units of a page span, types and modalities (empty: any); each predicate reaches the scan."""
    if page:
        units = units.where((F.col("start_page") <= page[1]) & (F.col("end_page") >= page[0]))
    if types:
        units = units.where(F.col("unit_type").isin(*types))
    return units.where(F.col("modality").isin(*modalities)) if modalities else units


def unit_order() -> list[Column]:
    return [F.col("start_page"), F.col("end_page"), F.lower(F.coalesce("title", F.lit(""))), F.col("unit_id")]


def widened(units: DataFrame, plans: DataFrame) -> DataFrame:
    """Candidates of each request: units of its document that pass the plan, else those of the first rung that has any.

    plans: query_id, document_id, wants_visual, wants_table, page_start, page_end (null: no page filter),
    modality_filters, and perhaps unit_types (empty: any). Rung 0 is the filter itself; the others are the fall-backs in
    their order, with the reason that names them. Units meet the requests of their document only; one pass computes each
    unit's rung, and a window keeps the least of each request.
    """
    return _least_rung(_met(units, plans))


def _met(units: DataFrame, plans: DataFrame) -> DataFrame:
    """Each unit with the plans of its document's requests."""
    if "unit_types" not in plans.columns:
        plans = plans.withColumn("unit_types", F.array().cast("array<string>"))
    return units.join(plans, "document_id")


def _least_rung(rows: DataFrame) -> DataFrame:
    paged, typed = F.col("page_start").isNotNull(), F.size("unit_types") > 0
    on_page = paged & (F.col("start_page") <= F.col("page_end")) & (F.col("end_page") >= F.col("page_start"))
    of_type = typed & F.array_contains("unit_types", F.col("unit_type"))
    fits = (~paged | on_page) & ((F.size("modality_filters") == 0) | F.array_contains("modality_filters", F.col("modality"))) & (~typed | of_type)
    visual, texts, table = F.col("unit_type").isin(*VISUAL_TYPES), F.col("unit_type").isin(*TEXT_TYPES), F.col("unit_type") == "table"
    rung = (
        F.when(fits, 0)
        .when(F.col("wants_visual"), F.when(paged, F.when(visual & on_page, 1).when(texts & on_page, 2)).otherwise(F.when(visual, 3)))
        .when(F.col("wants_table"), F.when(table & on_page, 4).when(texts & on_page, 5).when(table, 6))
        .when(on_page, 7)
        .when(of_type, 8)
        .otherwise(9)
    )
    rows = rows.withColumn("rung", rung).where("rung is not null")
    rows = rows.withColumn("least", F.min("rung").over(W.partitionBy("query_id", "document_id"))).where("rung = least").drop("least")
    return rows.withColumn("widening_reason", F.get(F.array(*map(F.lit, REASONS)), F.col("rung") - 1))


def request_plans(units: DataFrame, requests: DataFrame) -> DataFrame:
    """Plans of requests (query_id, document_id, query): the keyword plan, and the last page of the document where it is asked for."""
    plans = plan(requests)
    last = last_pages(units.join(requests.select("document_id").distinct(), "document_id", "left_semi"))
    page = F.when(F.col("wants_last_page"), F.coalesce("last_page", F.lit(0)))
    return plans.join(last, "document_id", "left").withColumns({"page_start": page, "page_end": page, "unit_types": F.array().cast("array<string>")}).drop("last_page")


def orchestrate(units: DataFrame, requests: DataFrame, k: int = 10, plans: DataFrame | None = None) -> DataFrame:
    """The whole search of each request: plan, filter, widen, rank, first k.

    units carry a corpus order in `ord`. Candidates of the filter are ranked in unit order, widened ones in corpus order
    where scores tie; hits without a shared token stay. plans: those of a model, instead of the keyword plan.

    A unit is cut into tokens once, before it meets its requests, and a query likewise (query_tokens).
    """
    plans = request_plans(units, requests) if plans is None else plans
    met = _met(units.withColumn("_own", F.array_distinct(_unit_tokens())), plans.withColumn("query_tokens", F.array_distinct(T.tokens(F.col("query")))))
    found = _least_rung(met.withColumn("matched_terms", F.array_sort(F.array_intersect("_own", "query_tokens"))).drop("_own"))
    found = found.withColumn("score", F.size("matched_terms") * 2.0)
    tie = [F.when(F.col("rung") == 0, x) for x in unit_order()[:3]]
    order = W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), *tie, F.when(F.col("rung") == 0, F.col("unit_id")), "ord", "unit_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def inverted_index(units: DataFrame) -> DataFrame:
    """token -> units, from title, text and keywords; one row for each token and unit."""
    parts = F.concat_ws(" ", "title", "text", *(["keywords"] if "keywords" in units.columns else []))
    return units.select("document_id", "unit_id", F.explode(F.array_distinct(T.tokens(parts))).alias("token"))


def rank(units: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """Units of each query by 2 x distinct shared tokens of title and text; candidate order breaks ties.

    units carry a total order in cand_ord. The tokens of both sides are joined, so pairs without a shared token never
    meet; where a query has fewer than k hits, units without one follow in candidate order.

    Units are dealt out by id, so many to a task, and pairs are added up where their unit lies: what a task holds grows
    with the number of queries only.
    """
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.count() // DEALT)
    body = units.repartition(tasks, "document_id", "unit_id").select("document_id", "unit_id", "cand_ord", F.explode(F.array_distinct(_unit_tokens())).alias("token"))
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    small = asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    hits = body.join(F.broadcast(asked) if small else asked, "token").groupBy("query_id", "document_id", "unit_id", "cand_ord").agg((F.count("*") * 2.0).alias("score"))
    if k is None:
        return hits
    best = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "cand_ord"))).where(F.col("rank") <= k)
    # Fill up: of the first k units in candidate order at most k hits can be in the way, so 2k units are enough.
    first = units.orderBy("cand_ord").limit(2 * k).select("document_id", "unit_id", "cand_ord")
    extra = queries.select("query_id").join(F.broadcast(first)).withColumn("score", F.lit(0.0))
    # A unit that is a hit, too, counts once, by its score.
    both = best.drop("rank").unionByName(extra).groupBy("query_id", "document_id", "unit_id", "cand_ord").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "cand_ord"))).where(F.col("rank") <= k)


def _unit_tokens() -> Column:
    return T.tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))


def with_terms(hits: DataFrame) -> DataFrame:
    """hits (title, text, query) with matched_terms: the distinct tokens that a unit shares with its query, in order."""
    return hits.withColumn("matched_terms", F.array_sort(F.array_intersect(_unit_tokens(), T.tokens(F.col("query")))))


def with_model_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with a model's relevance; missing ones are 0."""
    return candidates.join(scores.select("query_id", "unit_id", F.col("score").alias("llm_relevance")), ["query_id", "unit_id"], "left").withColumn("score", F.coalesce("llm_relevance", F.lit(0.0))).drop("llm_relevance")


def unknown_ids(claimed: DataFrame, known: DataFrame, key: list[str], id_col: str = "node_id") -> DataFrame:
    """Ids that a model has named (an array ids for each key) and that are not known: sorted, once each; keys without any stay out."""
    named = claimed.select(*key, F.explode("ids").alias(id_col)).distinct()
    return named.join(known.select(*key, id_col).distinct(), [*key, id_col], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_set(id_col)).alias("unknown"))


def ordered_union(*lists: str) -> Column:
    """Items of array columns in the order of their first occurrence."""
    return F.array_distinct(F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists)))


def full_text(units: DataFrame, query: str) -> DataFrame:
    """Units that hold every token of the query."""
    own = T.tokens(F.concat_ws(" ", "title", "text"))
    return units.where(F.size(F.array_except(T.tokens(F.lit(query)), own)) == 0)


def dedupe(units: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first of each key in order."""
    return units.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def merge_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """From the least start to the end of the greatest span (content spans as page and offset)."""
    whole = F.struct("start_page", "start_offset", "end_page", "end_offset")
    out = spans.groupBy(*key).agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
    return out.select(*key, "a.start_page", "a.start_offset", "b.end_page", "b.end_offset")


def overlapping(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Units whose pages meet a selected span of their document; pages are the join key, so no range join."""
    pages = spans.select("document_id", F.explode(F.sequence("start_page", "end_page")).alias("page")).distinct()
    own = units.select("document_id", "unit_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return units.join(own.join(pages, ["document_id", "page"]).select("document_id", "unit_id").distinct(), ["document_id", "unit_id"], "left_semi")


def excerpts(hits: DataFrame, chars: int = 280) -> DataFrame:
    """The first line of each hit (query, text, and perhaps query_tokens, its distinct tokens) that shares most tokens with the query."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    asked = F.col("query_tokens") if "query_tokens" in hits.columns else F.array_distinct(T.tokens(F.col("query")))
    best = lambda own: F.array_max(F.transform(lines, lambda x, i: F.struct(F.size(F.array_intersect(T.tokens(x), own)).alias("n"), (-i).alias("i"), x.alias("line"))))["line"]
    # Bound by an outer step, else the query would be cut into tokens again for each line.
    return hits.withColumn("excerpt", F.left(F.transform(F.array(asked), best)[0], F.lit(chars)))
