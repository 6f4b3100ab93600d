"""Compaction of wide trees and descriptions of documents: the two sequential rules, in pandas per parent or document.

Parents have few children next to the table's size, so grouping by (document, parent) spreads the work; nothing else is
sequential.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.operators import tree


def importance(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """nodes with width, has_summary, has_children and importance: width + 4 for a summary + 3 for children + 1 / level."""
    kids = nodes.select("document_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("has_children", F.lit(True))
    told = summaries.select("document_id", "node_id").distinct().withColumn("has_summary", F.lit(True))
    rows = nodes.join(kids, ["document_id", "node_id"], "left").join(told, ["document_id", "node_id"], "left").fillna(False, ["has_children", "has_summary"])
    width = F.col("end_page") - F.col("start_page") + 1
    return rows.withColumn("width", width).withColumn("importance", width + 4.0 * F.col("has_summary").cast("int") + 3.0 * F.col("has_children").cast("int") + 1.0 / F.greatest(F.col("level"), F.lit(1)))


def high_signal() -> Column:
    return F.col("has_summary") | F.col("has_children") | (F.col("width") > 1)


def cut_runs(high: list[bool]) -> list[list[int]]:
    """Runs between high-signal children become one segment each; without a high-signal child all stay apart."""
    if not any(high):
        return [[k] for k in range(len(high))]
    out: list[list[int]] = []
    for k, h in enumerate(high):
        if not h and out and not high[out[-1][-1]]:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def merge_cheapest(scores: list[float], most: int) -> list[list[int]]:
    """Neighbours with the least mean score are merged, leftmost first, until `most` segments are left."""
    n = len(scores)
    end, total, before = list(range(1, n + 1)), list(scores), list(range(-1, n - 1))
    alive = [True] * n
    stamp = [0] * n
    heap = [((scores[k] + scores[k + 1]) / 2, k, 0, 0) for k in range(n - 1)]
    heapq.heapify(heap)
    left = n
    while left > most and heap:
        _, k, own, next_stamp = heapq.heappop(heap)
        if not alive[k] or stamp[k] != own:
            continue
        m = end[k]
        if m >= n or stamp[m] != next_stamp:
            continue
        total[k], end[k], alive[m], stamp[k] = total[k] + total[m], end[m], False, stamp[k] + 1
        left -= 1
        if end[k] < n:
            before[end[k]] = k
            r = end[k]
            heapq.heappush(heap, ((total[k] + total[r]) / (end[r] - k), k, stamp[k], stamp[r]))
        if before[k] >= 0:
            b = before[k]
            heapq.heappush(heap, ((total[b] + total[k]) / (end[k] - b), b, stamp[b], stamp[k]))
    return [list(range(k, end[k])) for k in range(n) if alive[k]]


def segments(scored: DataFrame, most: int) -> DataFrame:
    """document_id, parent_id, node_id, segment, merged for each child: as they are up to `most`, runs up to twice as many, else merged to `most`."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start_page", "end_page", "level", "path_text", "node_id"], kind="stable").reset_index(drop=True)
        n = len(group)
        parts = [[k] for k in range(n)] if n <= most else cut_runs(group.high.tolist()) if n <= 2 * most else merge_cheapest(group.importance.tolist(), most)
        high = group.high.tolist()
        merged = [len(p) > 1 or (most < n <= 2 * most and any(high) and not high[p[0]]) for p in parts]
        place = {k: s for s, p in enumerate(parts) for k in p}
        return pd.DataFrame({"document_id": group.document_id, "parent_id": group.parent_id, "node_id": group.node_id, "segment": [place[k] for k in range(n)], "merged": [merged[place[k]] for k in range(n)]})

    rows = scored.where("parent_id is not null").withColumn("high", high_signal()).withColumn("path_text", F.array_join("path", "\x1f"))
    own = ["document_id", "parent_id", "node_id", "start_page", "end_page", "level", "path_text", "importance", "high"]
    kind = scored.schema["document_id"].dataType.simpleString()
    return rows.select(own).groupBy("document_id", "parent_id").applyInPandas(cut, f"document_id {kind}, parent_id string, node_id string, segment int, merged boolean")


def serving_nodes(scored: DataFrame, cut: DataFrame, summaries: DataFrame) -> DataFrame:
    """Nodes of the compacted tree with the canonical nodes they stand for: a merged segment is `parent::compact::NN`, titled after its first node."""
    rows = cut.join(scored.select("document_id", "node_id", "title", "start_page", "end_page", "level", "path"), ["document_id", "node_id"]).join(summaries.select("document_id", "node_id", "summary"), ["document_id", "node_id"], "left")
    order = F.struct(*(F.col(c) for c in ("start_page", "end_page", "level", "path", "node_id")))
    parts = rows.groupBy("document_id", "parent_id", "segment").agg(F.max("merged").alias("merged"), F.array_sort(F.collect_list(F.struct(order.alias("o"), "title", "summary"))).alias("n"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    ids = F.transform("n", lambda x: x["o"]["node_id"])
    ident = F.when(F.col("merged"), F.format_string("%s::compact::%02d", "parent_id", "segment")).otherwise(ids[0])
    title = F.when(F.size("n") > 1, F.concat(F.col("n")[0]["title"], F.lit(" (+"), (F.size("n") - 1).cast("string"), F.lit(")"))).otherwise(F.col("n")[0]["title"])
    texts = F.slice(F.array_distinct(F.filter(F.transform("n", lambda x: x["summary"]), lambda x: x.isNotNull())), 1, 3)
    return parts.select("document_id", "parent_id", "segment", ident.alias("serving_node_id"), title.alias("title"), "start_page", "end_page", F.array_join(texts, " ").alias("summary"), ids.alias("canonical_node_ids"))


def expand(serving_ids: DataFrame, serving: DataFrame) -> DataFrame:
    """Canonical ids of serving ids (document_id, ord, serving_node_id), first occurrences in order."""
    rows = serving_ids.join(serving.select("document_id", "serving_node_id", F.posexplode("canonical_node_ids").alias("p", "node_id")), ["document_id", "serving_node_id"])
    return rows.groupBy("document_id", "node_id").agg(F.min(F.struct("ord", "p")).alias("o")).select("document_id", "node_id", F.col("o.ord").alias("ord"), F.col("o.p").alias("place"))


def source_candidates(nodes: DataFrame, summaries: DataFrame, most: int = 8) -> DataFrame:
    """What description_sources chooses from: the root and the first level with their place, and told nodes without one.

    Told nodes of one span add the same pages, so no more than the first `most` of each span of a document can be chosen,
    in document order; nor can more than the first `most` of the first level. All others stay out here.
    """
    told = summaries.select("document_id", "node_id").distinct().withColumn("told", F.lit(True))
    rows = nodes.join(told, ["document_id", "node_id"], "left").withColumn("path_text", F.array_join("path", "\x1f"))
    rows = rows.withColumn("depth", F.size(F.split("path_text", "\x1f"))).withColumn("head", F.substring_index("path_text", "\x1f", 1))
    rows = rows.select("document_id", "node_id", "start_page", "end_page", "level", "path_text", "told", "depth", "head")
    heads = rows.groupBy("document_id", "head").agg(F.sum((F.col("depth") == 1).cast("int")).alias("n"), F.max(F.col("depth") > 1).alias("above"))
    tops = heads.groupBy("document_id").agg(F.sum("n").alias("n_top"), F.max(F.when((F.col("n") == 1) & F.col("above"), F.col("head"))).alias("root"))
    rows = rows.join(tops.select("document_id", "n_top", F.when(F.col("n_top") == 1, F.col("root")).alias("root")), "document_id")
    order = ["start_page", "end_page", "level", "path_text", "node_id"]
    under = F.when(F.col("depth") == 1, 0).when((F.col("depth") == 2) & (F.col("head") == F.col("root")), 1)
    group = F.when(F.col("root").isNotNull(), under).when(F.when(F.col("n_top") > 0, F.col("depth") == 1).otherwise(F.col("level") == 1), 1)
    upto = lambda df, by: df.withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)
    first = upto(rows.withColumn("g", group).where("g is not null"), W.partitionBy("document_id").orderBy("g", *order))
    first = first.select("document_id", *order, (F.col("k") - 1).alias("place"))
    rest = rows.where("told").join(first.select("document_id", "node_id"), ["document_id", "node_id"], "left_anti")
    rest = upto(rest, W.partitionBy("document_id", "start_page", "end_page").orderBy(*order[2:]))
    return first.unionByName(rest.select("document_id", *order, F.lit(None).cast("int").alias("place")))


def description_sources(nodes: DataFrame, summaries: DataFrame, most: int = 8) -> DataFrame:
    """document_id, place, node_id: a unique root and the first level in document order, then by greatest number of pages not yet covered."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "start_page", "end_page", "level", "path_text", "node_id"], kind="stable")
        chosen = group.node_id[group.place.notna()].tolist()
        low = min(group.start_page.min(), group.end_page.min())
        start, after = (group.start_page - low).to_numpy(), (group.end_page + 1 - low).to_numpy()
        free = np.ones(max(start.max(), after.max()), dtype=np.int64)
        for k in range(len(chosen)):
            free[start[k] : after[k]] = 0
        left = np.arange(len(chosen), len(group))
        while len(left) and len(chosen) < most:
            pages = np.concatenate([[0], np.cumsum(free)])
            best = left[np.lexsort((left, start[left] - after[left], -np.maximum(0, pages[after[left]] - pages[start[left]])))[0]]
            chosen.append(group.node_id.iloc[best])
            free[start[best] : after[best]] = 0
            left = left[left != best]
        return pd.DataFrame({"document_id": group.document_id.iloc[0], "place": range(len(chosen)), "node_id": chosen})

    kind = nodes.schema["document_id"].dataType.simpleString()
    return source_candidates(nodes, summaries, most).groupBy("document_id").applyInPandas(choose, f"document_id {kind}, place int, node_id string")


def descriptions(sources: DataFrame, nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Text of each document: its sections, then its first summary as a sentence."""
    from leafgrove.functions import text as T

    rows = sources.join(nodes.select("document_id", "node_id", "title"), ["document_id", "node_id"]).join(summaries.select("document_id", "node_id", "summary"), ["document_id", "node_id"], "left")
    own = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "title", "summary"))).alias("s"))
    titles = F.array_distinct(F.transform("s", lambda x: x["title"]))
    first = F.get(F.filter(F.transform("s", lambda x: x["summary"]), lambda x: x.isNotNull()), F.lit(0))
    return own.select("document_id", F.concat_ws(" ", F.concat(F.lit("Sections include "), F.array_join(titles, ", "), F.lit(".")), T.sentence(first)).alias("description"))


def compacted(nodes: DataFrame, summaries: DataFrame, most: int) -> DataFrame:
    scored = importance(nodes, summaries)
    return serving_nodes(scored, segments(scored, most), summaries)


def postorder(nodes: DataFrame) -> list[Column]:
    return [F.desc("level"), tree.document_order()]
