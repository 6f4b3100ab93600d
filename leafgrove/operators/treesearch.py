"""Tree-guided search: all (query, document) pairs walk down their trees in the same few rounds.

nodes: document_id, node_id, parent_id, title, summary, keywords, level, path, start_page, end_page. A pair's frontier
starts at the roots; each round scores it, picks at most two nodes, and moves on to their children until a signal stops
the pair. Lineage is cut each round by checkpoint(), in the folder all executors share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.functions import text as T
from leafgrove.operators import selection, tree
from leafgrove.sources.store import checkpointed

MAX_DEPTH, MAX_FRONTIER, MAX_SELECTED, PER_STEP = 4, 8, 3, 2
LEAST_SCORE, LEAST_SHARE, SUFFICIENT = 0.2, 0.5, 0.5


@dataclass
class Found:
    """candidates: query_id, document_id, node_id, score, signal, step. trace: a row for each node picked. final: the last signal of each pair."""

    candidates: DataFrame
    trace: DataFrame
    final: DataFrame


def frontier_score(query_tokens: Column, phrases: list[str] = (), page: tuple[int, int] | None = None) -> Column:
    """2 x overlap with the title + 1.5 x with the summary + 1 x with the keywords, and boni for title phrases and pages."""
    part = lambda x: T.overlap(T.tokens(x), query_tokens)
    score = 2.0 * part(F.col("title")) + 1.5 * part(F.coalesce("summary", F.lit(""))) + 1.0 * part(F.array_join("keywords", " "))
    for phrase in phrases:
        whole, title = T.normalize(F.lit(phrase)), T.normalize(F.col("title"))
        score = score + F.when(whole == title, 3.0).when(F.contains(title, whole), 1.5).otherwise(0.0)
    if page:
        same = (F.col("start_page") == page[0]) & (F.col("end_page") == page[1])
        score = score + F.when(same, 1.0).when((F.col("start_page") <= page[1]) & (F.col("end_page") >= page[0]), 0.5).otherwise(0.0)
    return score


def sufficient(evidence: DataFrame, queries: DataFrame, phrases: list[str] = (), page: tuple[int, int] | None = None) -> DataFrame:
    """query_id, document_id, node_id of nodes whose direct units (node_id, title, text) are evidence enough.

    With a page filter any unit is; else one that holds a quoted phrase, has a title like one, or overlaps the query by
    half or more. Only units that share a token with a query are looked at, but for phrases, which all queries share.
    """
    if page:
        return evidence.select("document_id", "node_id").distinct().join(F.broadcast(queries.select("query_id")))
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    words = evidence.select("document_id", "node_id", "unit_id", F.explode(F.array_distinct(T.tokens(body))).alias("token"))
    asked = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    sizes = asked.groupBy("query_id").agg(F.sum("times").alias("size"))
    hits = words.join(asked, "token").groupBy("query_id", "document_id", "node_id", "unit_id").agg(F.sum("times").alias("n")).join(sizes, "query_id")
    out = hits.where(F.col("n") >= SUFFICIENT * F.col("size")).select("query_id", "document_id", "node_id").distinct()
    if phrases:
        quoted = reduce(lambda a, b: a | b, (F.contains(T.normalize(body), T.normalize(F.lit(p))) for p in phrases))
        told = evidence.where(quoted).select("document_id", "node_id").distinct().join(F.broadcast(queries.select("query_id")))
        out = out.unionByName(told.select(*out.columns)).distinct()
    return out


def preference_bonuses(nodes: DataFrame, queries: DataFrame, snippets: DataFrame, limit: int = 4) -> DataFrame:
    """query_id, document_id, node_id, bonus: the greatest that one of the query's own snippets (preference_id, text, scope, priority) gives.

    A snippet counts for a query, and for a node, only if they share a token, so both are joins on tokens.
    """
    own = snippets.select("preference_id", "text", "scope", "priority", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    asked = queries.select("query_id", "query", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    met = own.join(asked, "token").select("query_id", "query", "preference_id", "text", "scope", "priority").distinct()
    whole = T.normalize(F.col("query"))
    score = T.overlap(T.tokens(F.col("text")), T.tokens(F.col("query"))) + F.when(F.contains(T.normalize(F.col("text")), whole), 0.5).otherwise(0.0)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*selection.preference_order()))
    chosen = met.withColumn("score", score).withColumn("place", place).where(F.col("place") <= limit).select("query_id", F.col("text").alias("snippet"))
    body = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), F.array_join("keywords", " "))
    known = nodes.select("document_id", "node_id", body.alias("body"))
    words = known.withColumn("token", F.explode(F.array_distinct(T.tokens(F.col("body")))))
    pairs = words.join(chosen.withColumn("token", F.explode(F.array_distinct(T.tokens(F.col("snippet"))))), "token").select("query_id", "document_id", "node_id", "body", "snippet").distinct()
    return pairs.groupBy("query_id", "document_id", "node_id").agg(F.max(selection.preference_bonus(F.col("body"), F.col("snippet"))).alias("bonus"))


def search_preferred(nodes: DataFrame, queries: DataFrame, snippets: DataFrame, **settings) -> Found:
    """search() with preferences; pairs that it leaves without a node are walked again without them."""
    first = search(nodes, queries, bonus=checkpointed(preference_bonuses(nodes, queries, snippets)), **settings)
    pair = ["query_id", "document_id"]
    held = checkpointed(first.candidates)
    base = search(nodes, queries, **settings)
    again = base.candidates.join(held.select(*pair).distinct(), pair, "left_anti")
    final = first.final.join(again.select(*pair).distinct(), pair, "left_anti").unionByName(base.final.join(again.select(*pair).distinct(), pair, "left_semi"))
    return Found(held.unionByName(again), first.trace.unionByName(base.trace.join(again.select(*pair).distinct(), pair, "left_semi")), final)


def search(nodes: DataFrame, queries: DataFrame, evidence: DataFrame | None = None, score=frontier_score, max_depth: int = MAX_DEPTH, max_frontier: int = MAX_FRONTIER, max_selected: int = MAX_SELECTED, bonus: DataFrame | None = None) -> Found:
    """Walk all pairs. bonus (query_id, document_id, node_id, bonus) adds to nodes' scores, as preferences do."""
    asked = queries.select("query_id", T.tokens(F.col("query")).alias("_q"))
    kids = nodes.select("document_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("has_child", F.lit(True))
    known = nodes.join(kids, ["document_id", "node_id"], "left").withColumn("ord", tree.document_order())
    frontier = tree.roots(nodes).select("document_id", "node_id").crossJoin(F.broadcast(asked.select("query_id")))
    frontier = checkpointed(frontier.withColumn("held", F.lit(0)))
    picked, ends = [], []
    pair = ["query_id", "document_id"]
    for step in range(max_depth):
        rows = frontier.join(known, ["document_id", "node_id"]).join(F.broadcast(asked), "query_id")
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy(*pair).orderBy("ord"))).where(F.col("place") <= max_frontier).withColumn("score", score(F.col("_q")))
        if bonus is not None:
            rows = rows.join(bonus, [*pair, "node_id"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))
        by_pair = W.partitionBy(*pair)
        rows = rows.withColumns({"best": F.max("score").over(by_pair), "n": F.count("*").over(by_pair), "k": F.row_number().over(by_pair.orderBy(F.desc("score"), "place"))})
        chosen = F.when(F.col("best") > 0, (F.col("k") <= PER_STEP) & (F.col("score") >= F.greatest(F.lit(LEAST_SCORE), F.col("best") * LEAST_SHARE))).otherwise(F.col("n") == 1)
        rows = rows.withColumn("chosen", chosen)
        if evidence is not None:
            rows = rows.join(sufficient(evidence, queries).withColumn("enough", F.lit(True)), [*pair, "node_id"], "left")
        else:
            rows = rows.withColumn("enough", F.lit(None).cast("boolean"))
        signal = F.when(F.col("has_child").isNull(), "leaf").when(F.lit(step + 1 >= max_depth), "max_depth").when(F.col("enough"), "evidence_sufficient")
        rows = checkpointed(rows.withColumn("signal", signal).select(*pair, "node_id", "place", "k", "score", "chosen", "signal", "held"))
        went = rows.where("chosen")
        terminal = went.where("signal is not null").withColumn("t", F.row_number().over(by_pair.orderBy("k"))).where(F.col("held") + F.col("t") <= max_selected)
        picked.append(went.withColumn("step", F.lit(step)))
        took = terminal.withColumn("step", F.lit(step))
        counts = rows.groupBy(*pair).agg(F.max("held").alias("held"), F.max("chosen").alias("any"), F.max(F.col("chosen") & F.col("signal").isNull()).alias("goes_on")).join(terminal.groupBy(*pair).agg(F.count("*").alias("new"), F.max(F.struct(F.when(F.col("signal") == "max_depth", 4).when(F.col("signal") == "evidence_sufficient", 3).otherwise(2).alias("p"), "signal")).alias("top")), pair, "left")
        counts = checkpointed(counts.withColumn("held", F.col("held") + F.coalesce("new", F.lit(0))))
        stop = ~F.col("any") | ~F.col("goes_on") | (F.col("held") >= max_selected)
        final = F.when(~F.col("any"), F.when(F.lit(step == 0), "fallback_to_flat").otherwise("no_positive_frontier")).otherwise(F.coalesce(F.col("top.signal"), F.lit("leaf")))
        ends.append((took, counts.where(stop).select(*pair, final.alias("signal"), F.lit(step).alias("step"))))
        on = went.where("signal is null").join(counts.where(~stop).select(*pair, F.col("held").alias("now")), pair)
        frontier = on.select(*pair, F.col("node_id").alias("parent_id"), F.col("now").alias("held")).join(nodes.select("document_id", "parent_id", "node_id"), ["document_id", "parent_id"]).select("document_id", "node_id", "query_id", "held")
        frontier = checkpointed(frontier)
        if frontier.isEmpty():
            break
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    candidates = union([t for t, _ in ends]).select(*pair, "node_id", "score", "signal", "step").join(nodes.select("document_id", "node_id", "start_page", "end_page"), ["document_id", "node_id"])
    trace = union(picked).select(*pair, "step", "node_id", "k", "score", "signal")
    return Found(candidates, trace, union([e for _, e in ends]))


def narrowed_units(found: Found, units: DataFrame, contextual: tuple[str, ...] = ("page_text", "table", "visual", "unresolved_visual", "unassigned_span")) -> DataFrame:
    """Units to rank for each pair: direct units of its candidates and contextual ones whose pages meet theirs; all units where the walk fell back."""
    direct = units.where("node_id is not null").join(found.candidates.select("query_id", "document_id", "node_id").distinct(), ["document_id", "node_id"])
    pages = found.candidates.select("query_id", "document_id", F.explode(F.sequence("start_page", "end_page")).alias("page")).distinct()
    own = units.where(F.col("unit_type").isin(*contextual)).withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    near = own.join(pages, ["document_id", "page"]).drop("page")
    flat = units.join(found.final.where("signal = 'fallback_to_flat'").select("query_id", "document_id"), "document_id")
    every = direct.unionByName(near, allowMissingColumns=True).unionByName(flat, allowMissingColumns=True)
    return every.dropDuplicates(["query_id", "document_id", "unit_id"])
