"""Grounded answers over ranked hits (query_id, document_id, unit_id, unit_type, title, text, excerpt, score, cand_ord, pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.functions import text as T
from leafgrove.operators import search

TEXTS = ["node_text", "page_text", "unassigned_span"]
#: Characters of a text that a summary of its document holds.
SAID = 220
LEXICAL = ["keyword_overlap", "title_overlap", "phrase_match", "keyword_match"]


def has_lexical_evidence(breakdown: Column) -> Column:
    """Whether any lexical part of a score map is above 0."""
    return F.exists(F.map_entries(breakdown), lambda e: e["key"].isin(*LEXICAL) & (e["value"] > 0))


def grounding(hits: DataFrame, prefer_tables: bool = False, limit: int = 3) -> DataFrame:
    """Hits to ground the answer of each pair on: texts before tables (or the other way), by score, none twice."""
    return placed(hits, F.lit(prefer_tables), F.lit(True)).where(F.col("place") <= limit)


def placed(hits: DataFrame, prefer_tables: Column, usable: Column) -> DataFrame:
    """All hits, with the place of those usable ones that an answer may be grounded on (null: none)."""
    kind = F.col("unit_type")
    table, text = kind == "table", kind.isin(*TEXTS)
    rank = F.when(F.when(prefer_tables, table).otherwise(text), 0).when(F.when(prefer_tables, text).otherwise(table), 1).when(kind == "node_summary", 2).otherwise(3)
    like_text = text | (kind == "node_summary")
    first, second = F.when(prefer_tables, table).otherwise(like_text), F.when(prefer_tables, like_text).otherwise(table)
    pair = W.partitionBy("query_id", "document_id")
    rows = hits.withColumn("_usable", usable)
    rows = rows.withColumn("_a", F.max(F.col("_usable") & first).over(pair)).withColumn("_b", F.max(F.col("_usable") & second).over(pair))
    rows = rows.withColumn("_usable", F.coalesce(F.col("_usable") & F.when(F.col("_a"), first).when(F.col("_b"), second).otherwise(F.lit(True)), F.lit(False)))
    key = F.coalesce(F.nullif(T.normalize(F.col("excerpt")), F.lit("")), F.nullif(T.normalize(F.col("title")), F.lit("")), F.col("unit_id"))
    rows = rows.withColumn("_o", F.row_number().over(pair.orderBy(F.desc("_usable"), rank, F.desc("score"), "cand_ord"))).withColumn("_key", key)
    rows = rows.withColumn("_first", F.col("_usable") & (F.row_number().over(W.partitionBy("query_id", "document_id", "_usable", "_key").orderBy("_o")) == 1))
    place = F.when(F.col("_first"), F.sum(F.col("_first").cast("int")).over(pair.orderBy("_o").rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    return rows.withColumn("place", place).drop("_usable", "_a", "_b", "_o", "_key", "_first")


def _said() -> Column:
    return T.sentence(F.trim(F.coalesce("excerpt", "title")))


def _citation() -> Column:
    return F.struct("unit_id", T.page_label(F.col("start_page"), F.col("end_page")).alias("page_label"), F.col("excerpt").alias("quote"))


def compose(grounded: DataFrame) -> DataFrame:
    """Answer text of each pair: the excerpts as sentences, in order."""
    parts = grounded.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("place", _said().alias("s")))).alias("p"))
    return parts.select("query_id", "document_id", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("answer"))


def citations(grounded: DataFrame) -> DataFrame:
    return grounded.select("query_id", "document_id", "place", _citation().alias("citation"))


def document_summary(units: DataFrame, max_sections: int = 4, max_texts: int = 2) -> DataFrame:
    """What a document is about: its first titles, and its first summaries or else texts."""
    order = F.struct("start_page", "end_page", "title", "unit_id")
    rows = units.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "unit_type", "title", F.left("text", F.lit(SAID)).alias("text")))).alias("u"))
    titles = F.slice(F.array_distinct(F.filter(F.transform(F.filter("u", lambda x: x["unit_type"] == "node_text"), lambda x: x["title"]), lambda t: t.isNotNull())), 1, max_sections)
    of = lambda kind: F.slice(F.array_distinct(F.filter(F.transform(F.filter("u", lambda x: x["unit_type"] == kind), lambda x: x["text"]), lambda t: t.isNotNull())), 1, max_texts)
    body = F.when(F.size(of("node_summary")) > 0, of("node_summary")).otherwise(of("page_text"))
    text = F.concat_ws(" ", F.when(F.size(titles) > 0, F.concat(F.lit("Sections include "), F.array_join(titles, ", "), F.lit("."))), F.array_join(F.transform(body, T.sentence), " "))
    return rows.select("document_id", F.nullif(text, F.lit("")).alias("summary"))


def answer_mode(pairs: DataFrame) -> DataFrame:
    """Mode of each pair from: intent, n_hits, any_lexical, n_authoritative, n_grounded, has_visual, cached_visual, has_description, has_summary."""
    summary = F.when(F.col("has_description"), "document_summary_description").when(F.col("has_summary"), "document_summary_fallback").otherwise("document_summary_unavailable")
    visual = F.when(~F.col("has_visual"), "visual_no_hits").when(F.col("cached_visual"), "cached_visual_attachment").otherwise("visual_interpretation_unavailable")
    text = F.when(F.col("n_authoritative") == 0, "interpretive_fallback").when(F.col("n_grounded") == 1, "authoritative_text").otherwise("grounded_multi_excerpt")
    weak = F.col("intent").isin("topic", "section", "quote") & ~F.col("any_lexical")
    mode = F.when(F.col("intent") == "document_summary", summary).when(F.col("n_hits") == 0, "no_hits").when(weak, "low_evidence").when(F.col("intent") == "visual", visual).otherwise(text)
    return pairs.withColumn("answer_mode", mode)


def answers(units: DataFrame, requests: DataFrame, descriptions: DataFrame | None = None, k: int = 10, limit: int = 3, plans: DataFrame | None = None) -> DataFrame:
    """One row for each request (query_id, document_id, query): intent, answer_mode, answer and citations.

    A summary is answered by the document's description (descriptions: document_id, description), else by what its units
    say; a request without hits or without lexical evidence gets a row without answer; a visual one the cached
    interpretation of a visual hit. All others are grounded on the first excerpts of authoritative hits, else of any.
    """
    plans = search.request_plans(units, requests) if plans is None else plans
    hits = search.excerpts(search.orchestrate(units, requests, k, plans))
    kind = F.col("unit_type")
    told = F.coalesce(F.col("authoritative"), F.lit(True)) if "authoritative" in units.columns else F.lit(True)
    cached = (F.col("interpretive") & F.col("text").isNotNull()) if "interpretive" in units.columns else F.lit(False)
    hits = hits.withColumns({"is_told": kind.isin(*TEXTS, "table") & told, "is_visual": kind.isin(*search.VISUAL_TYPES), "cand_ord": F.col("rank")})
    hits = hits.withColumn("is_cached", F.col("is_visual") & F.coalesce(cached, F.lit(False)))
    pair = ["query_id", "document_id"]
    hits = hits.withColumn("any_told", F.max("is_told").over(W.partitionBy(*pair)))
    hits = placed(hits, F.col("wants_table"), (F.col("is_told") | ~F.col("any_told")) & F.col("wants_table").isNotNull())
    part = F.struct("place", _said().alias("s"), _citation().alias("citation"))
    # One pass over the hits: what is counted and what is said come from the same rows, so they are searched once.
    found = hits.groupBy(*pair).agg(F.count("*").alias("n_hits"), F.max(F.col("score") > 0).alias("any_lexical"), F.sum(F.col("is_told").cast("int")).alias("n_authoritative"), F.max("is_visual").alias("has_visual"), F.max("is_cached").alias("cached_visual"), F.min_by("text", F.when(F.col("is_cached"), F.col("rank"))).alias("cached_text"), F.array_sort(F.collect_list(F.when(F.col("place") <= limit, part))).alias("g"))
    found = found.withColumns({"n_grounded": F.size("g"), "answer": F.array_join(F.transform("g", lambda x: x["s"]), " "), "citations": F.transform("g", lambda x: F.struct(x["place"].alias("place"), x["citation"].alias("citation")))}).drop("g")
    rows = plans.select(*pair, "intent").join(found, pair, "left").join(document_summary(units), "document_id", "left")
    described = F.lit(None).cast("string")
    if descriptions is not None:
        rows, described = rows.join(descriptions.select("document_id", "description"), "document_id", "left"), F.col("description")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumns({"n_hits": F.coalesce("n_hits", F.lit(0)), "n_authoritative": F.coalesce("n_authoritative", F.lit(0)), "n_grounded": F.coalesce("n_grounded", F.lit(0)), "any_lexical": no("any_lexical"), "has_visual": no("has_visual"), "cached_visual": no("cached_visual"), "has_description": described.isNotNull(), "has_summary": F.col("summary").isNotNull()})
    rows = answer_mode(rows)
    mode = F.col("answer_mode")
    answer = F.when(mode == "document_summary_description", described).when(mode == "document_summary_fallback", F.col("summary")).when(mode == "cached_visual_attachment", F.col("cached_text")).when(mode.isin("authoritative_text", "grounded_multi_excerpt", "interpretive_fallback"), F.col("answer"))
    cites = F.when(mode.isin("authoritative_text", "grounded_multi_excerpt", "interpretive_fallback"), F.col("citations"))
    return rows.select(*pair, "intent", mode, answer.alias("answer"), cites.alias("citations"))
