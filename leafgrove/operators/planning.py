"""Plans, ranks and selections by a language model: one request a row, through the gateway.

make_client() gives a client on each executor, client(operation, payload JSON) -> answer JSON. What a model names and is
not known is left out; a request that fails keeps what the deterministic operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgrove.operators import gateway, search, selection

Client = Callable[[], Callable[[str, str], str]]

#: The intents of a plan.
INTENTS = ["document_summary", "visual", "table", "section", "topic", "quote", "page"]


def _asked(rows: DataFrame, operation: str, make_client: Client, required: list[str], schema: str, *payload: str) -> DataFrame:
    """rows with a (the parsed answer, null where the request failed); rows carry a request_id of their own."""
    answers = gateway.invoke(gateway.requests(rows, operation, "request_id", gateway.INSTRUCTIONS[operation], *payload), make_client, required)
    found = answers.select("request_id", F.when(F.col("failure").isNull(), F.from_json("answer", schema)).alias("a"))
    return rows.join(found, "request_id", "left")


def plans(units: DataFrame, requests: DataFrame, make_client: Client) -> DataFrame:
    """Plans of requests (query_id, document_id, query) by a model; failed ones are the keyword plan.

    A last page of 0 counts as none given, so that the first page ends the filter.
    """
    base = search.request_plans(units, requests).withColumn("request_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("document_id").cast("string")))
    schema = "intent string, page_start int, page_end int, modality_filters array<string>, unit_types array<string>, title_like_phrases array<string>"
    rows = _asked(base, "query_planning", make_client, ["intent"], schema, "query")
    ok = F.col("a").isNotNull() & F.col("a.intent").isin(*INTENTS)
    of = lambda c, old: F.when(ok, c).otherwise(F.col(old)).alias(old)
    none = F.array().cast("array<string>")
    kinds = F.coalesce("a.modality_filters", none)
    return rows.select(
        "query_id", "document_id", "query", "normalized_query", "wants_structure", "wants_summary", "wants_last_page",
        of(F.col("a.intent"), "intent"), of(F.array_contains(kinds, "visual") | (F.col("a.intent") == "visual"), "wants_visual"), of(F.array_contains(kinds, "table") | (F.col("a.intent") == "table"), "wants_table"),
        of(kinds, "modality_filters"), of(F.coalesce("a.unit_types", none), "unit_types"), of(F.coalesce("a.page_start", "page_start"), "page_start"),
        of(F.coalesce(F.nullif(F.col("a.page_end"), F.lit(0)), F.col("a.page_start"), F.col("page_end")), "page_end"), F.when(ok, F.coalesce("a.title_like_phrases", none)).otherwise(none).alias("title_like_phrases"),
    )


def model_scores(candidates: DataFrame, make_client: Client) -> DataFrame:
    """query_id, document_id, unit_id, score of candidates (those, query, title, text) by a model: one call a request."""
    listed = candidates.groupBy("query_id", "document_id").agg(F.min("query").alias("query"), F.array_sort(F.collect_list(F.struct("unit_id", "title", F.left("text", F.lit(500)).alias("text")))).alias("candidates"))
    listed = listed.withColumn("request_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("document_id").cast("string")))
    rows = _asked(listed, "retrieval_ranking", make_client, ["scores"], "scores array<struct<unit_id: string, score: double>>", "query", "candidates")
    given = rows.select("query_id", "document_id", F.explode("a.scores").alias("s")).select("query_id", "document_id", "s.unit_id", "s.score")
    return given.join(candidates.select("query_id", "document_id", "unit_id").distinct(), ["query_id", "document_id", "unit_id"], "left_semi").groupBy("query_id", "document_id", "unit_id").agg(F.max("score").alias("score"))


def rank_by_model(candidates: DataFrame, make_client: Client, k: int = 10) -> DataFrame:
    """The first k candidates of each request by a model's relevance; what it leaves out counts 0, ties keep unit order."""
    from pyspark.sql import Window as W

    rows = candidates.drop("score").join(model_scores(candidates, make_client), ["query_id", "document_id", "unit_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), *search.unit_order())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def metadata_clauses(queries: DataFrame, fields: list[str], make_client: Client) -> DataFrame:
    """query_id, field, operator, value (as text) of queries (query_id, query) by a model; unknown fields and operators are left out."""
    rows = queries.withColumn("request_id", F.col("query_id").cast("string")).withColumn("fields", F.array(*map(F.lit, fields)))
    said = _asked(rows, "metadata_selection", make_client, ["clauses"], "clauses array<struct<field: string, operator: string, value: string>>", "query", "fields")
    return said.select("query_id", F.explode("a.clauses").alias("c")).select("query_id", "c.*").where(F.col("field").isin(*fields) & F.col("operator").isin(*sorted(selection.OPERATORS)))


def select_by_description(descriptions: DataFrame, queries: DataFrame, make_client: Client, size: int = selection.SHARD) -> DataFrame:
    """query_id, document_id, score, reason: a model picks from shards of descriptions (document_id, display_name, description).

    Each query is asked once a shard, which is what the selection is; the best answer for a document stays.
    """
    cards = F.array_sort(F.collect_list(F.struct("document_id", "display_name", "description")))
    listed = selection.shards(descriptions, size).groupBy("shard").agg(cards.alias("documents"))
    every = queries.agg(F.collect_list(F.struct("query_id", "query")).alias("q"))
    if queries.count() > search.BROADCAST_QUERIES:
        raise ValueError("too many queries to ask about every shard")
    rows = listed.join(F.broadcast(every)).select("shard", "documents", F.explode("q").alias("q")).select("shard", "documents", "q.*")
    rows = rows.withColumn("request_id", F.concat_ws("|", F.col("query_id").cast("string"), F.col("shard").cast("string")))
    said = _asked(rows, "description_selection", make_client, ["selected"], "selected array<struct<document_id: string, score: double, reason: string>>", "query", "documents")
    named = said.select("query_id", F.explode("a.selected").alias("s"), "documents").where(F.exists("documents", lambda x: x["document_id"].cast("string") == F.col("s.document_id")))
    return named.groupBy("query_id", F.col("s.document_id").alias("document_id")).agg(F.max(F.struct("s.score", "s.reason")).alias("b")).select("query_id", "document_id", "b.score", "b.reason")


def usage_totals(calls: DataFrame, key: list[str]) -> DataFrame:
    """Token counts of calls added up; a count that no call has stays null."""
    return calls.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")))


def data_url(media_type: Column, content: Column) -> Column:
    """An image as a data URL, in one line."""
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))
