"""Section trees: outlines, paths, parents, spans, gaps, closures. Spans are 0-based inclusive pages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from leafgrove.functions import text as T
from leafgrove.sources.store import checkpointed


def document_order(prefix: str = "") -> Column:
    """Order of nodes: start page, end page, level, path, id."""
    return F.struct(*(F.col(prefix + c) for c in ("start_page", "end_page", "level", "path", "node_id")))


def outline_quality(entries: DataFrame) -> DataFrame:
    """Counts and score of each outline (document_id, source), entries by ord."""
    order = W.partitionBy("document_id", "source").orderBy("ord")
    before = F.last("page_index", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = entries.withColumns({
        "null_page": F.col("page_index").isNull(), "no_title": F.coalesce(F.trim("title"), F.lit("")) == "", "back": F.coalesce(F.col("page_index") < before, F.lit(False)),
        "bad_level": (F.col("level") < 1).cast("int") + F.when(F.row_number().over(order) == 1, F.col("level") != 1).otherwise(F.col("level") > F.lag("level").over(order) + 1).cast("int"),
    })
    total = lambda c: F.sum(F.col(c).cast("long"))
    out = rows.groupBy("document_id", "source").agg(F.count("*").alias("entry_count"), total("null_page").alias("null_destination_count"), total("no_title").alias("empty_title_count"), total("back").alias("non_monotonic_count"), total("bad_level").alias("invalid_level_count"), F.greatest(F.lit(0), F.max("level")).cast("long").alias("max_depth"))
    score = 100 * F.col("entry_count") - 40 * F.col("null_destination_count") - 25 * F.col("empty_title_count") - 30 * F.col("non_monotonic_count") - 50 * F.col("invalid_level_count") - 5 * F.greatest(F.lit(0), F.col("max_depth") - 12)
    return out.withColumn("score", score)


def select_outline(quality: DataFrame) -> DataFrame:
    """The best outline of each document: by score, fewer null destinations, then source."""
    rank = F.when(F.col("source") == "pymupdf", 0).when(F.col("source") == "pypdf", 1).otherwise(2)
    order = W.partitionBy("document_id").orderBy(F.desc("score"), "null_destination_count", rank)
    return quality.where("entry_count > 0").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def normalize_outline(entries: DataFrame) -> DataFrame:
    """1-based pages to 0-based; 0 and below to null."""
    return entries.withColumn("page_index", F.when(F.col("page") > 0, F.col("page") - 1))


def with_paths(entries: DataFrame) -> DataFrame:
    """Entries (document_id, ord, level, title) with their path: the titles of the open sections by level.

    One pass over each document's entries in order, which holds the open sections only.
    """
    columns = ["document_id", "ord", *[c for c in entries.columns if c not in ("document_id", "ord")]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = object(), []
        for batch in batches:
            paths = []
            for document, level, title in zip(*(batch.column(c).to_pylist() for c in ("document_id", "level", "title")), strict=True):
                if document != at:
                    at, stack = document, []
                stack = [*stack[: len(stack) if level is None else max(0, level - 1)], title]
                paths.append(stack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], [*columns, "path"])

    ordered = entries.select(columns).repartition("document_id").sortWithinPartitions(*columns)
    return ordered.mapInArrow(walk, StructType([*ordered.schema.fields, StructField("path", ArrayType(StringType()))]))


def lead_spans(entries: DataFrame, page_counts: DataFrame) -> DataFrame:
    """start_page, end_page of entries: up to the start of the next one, inclusive; the last up to the last page. Entries without a page are left out."""
    order = W.partitionBy("document_id").orderBy("page_index", "level", "title", "ord")
    rows = entries.where("page_index is not null").join(page_counts, "document_id")
    start = F.least(F.col("page_index"), F.col("page_count") - 1)
    return rows.withColumn("next", F.lead("page_index").over(order)).withColumn("start_page", start).withColumn("end_page", F.greatest(start, F.least(F.coalesce("next", F.col("page_count") - 1), F.col("page_count") - 1))).drop("next")


def parents_by_path(nodes: DataFrame) -> DataFrame:
    """Parent of each node (document_id, node_id, path, ord): the latest earlier node whose path is its own less the last part.

    Entries of one path, level and page share an id; each has the parent of its own place. Nodes and those that may be
    above them are put in one order for each path, so none meets all that share its path.
    """
    own = nodes.drop("parent_id").withColumn("_own", F.lit(True)).withColumn("_key", F.when(F.size("path") > 1, F.slice("path", 1, F.size("path") - 1)))
    up = nodes.select("document_id", "ord", F.lit(False).alias("_own"), F.col("path").alias("_key"), F.col("node_id").alias("_up"))
    rows = own.where("_key is not null").unionByName(up, allowMissingColumns=True)
    before = W.partitionBy("document_id", "_key").orderBy("ord", F.desc("_own")).rowsBetween(W.unboundedPreceding, W.currentRow)
    below = rows.withColumn("parent_id", F.last("_up", ignorenulls=True).over(before)).where("_own")
    top = own.where("_key is null").withColumn("parent_id", F.lit(None).cast(nodes.schema["node_id"].dataType))
    return below.select(top.columns).unionByName(top).drop("_own", "_key")


def children(nodes: DataFrame) -> DataFrame:
    """Children of each parent as an array, in document order."""
    kids = nodes.where("parent_id is not null").groupBy("document_id", "parent_id").agg(F.array_sort(F.collect_list(document_order())).alias("k"))
    return kids.select("document_id", "parent_id", F.transform("k", lambda x: x["node_id"]).alias("child_ids"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select("document_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), ["document_id", "node_id"], "left_anti")


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes without parent; in a document that has none, those of the least level."""
    by_doc = W.partitionBy("document_id")
    marked = nodes.withColumn("any_root", F.max(F.col("parent_id").isNull()).over(by_doc)).withColumn("least", F.min("level").over(by_doc))
    return marked.where(F.when(F.col("any_root"), F.col("parent_id").isNull()).otherwise(F.col("level") == F.col("least"))).drop("any_root", "least")


def top_level(nodes: DataFrame) -> DataFrame:
    """Children of a unique root, else paths of depth 1, else level 1, else all."""
    by_doc = W.partitionBy("document_id")
    depth = F.size("path")
    rows = nodes.withColumns({"n1": F.sum((depth == 1).cast("int")).over(by_doc), "deep": F.sum((depth > 1).cast("int")).over(by_doc), "l1": F.sum((F.col("level") == 1).cast("int")).over(by_doc), "root": F.max(F.when(depth == 1, F.col("path")[0])).over(by_doc)})
    under = F.sum(((depth > 1) & (F.col("path")[0] == F.col("root"))).cast("int")).over(by_doc)
    rows = rows.withColumn("under", under)
    chosen = F.when((F.col("n1") == 1) & (F.col("under") > 0), (depth == 2) & (F.col("path")[0] == F.col("root"))).when(F.col("n1") > 0, depth == 1).when(F.col("l1") > 0, F.col("level") == 1).otherwise(F.lit(True))
    return rows.where(chosen).drop("n1", "deep", "l1", "root", "under")


def gaps(nodes: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Runs of pages that no node covers, with the reason.

    A document's spans are walked in order between two marks of its own, one in front, which holds the number of pages,
    and one behind its last page; what lies between the pages covered so far and the next span is a run.
    """
    page = page_counts.schema["page_count"].dataType
    span = lambda kind, lo, hi, n: F.struct(F.lit(kind).alias("kind"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), n.cast("long").alias("n"))
    none, n = F.lit(None), F.col("page_count")
    marks = page_counts.where("page_count > 0").select("document_id", F.explode(F.array(span(0, none, none, n), span(1, n, n, none))).alias("s"))
    own = nodes.where("start_page is not null and end_page is not null").select("document_id", span(2, F.least("start_page", "end_page"), F.greatest("start_page", "end_page"), none).alias("s"))
    order = W.partitionBy("document_id").orderBy("lo", "kind")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = marks.unionByName(own).select("document_id", "s.*").withColumns({"before": before, "n": F.max("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "more": F.lead("kind").over(order).isNotNull()})
    rows = rows.withColumn("start", F.greatest(F.lit(0), F.coalesce("before", F.lit(-1)) + 1)).withColumn("end", F.least("lo", "n") - 1).where("kind > 0 and n is not null and start <= end")
    first = F.col("before").isNull()
    reason = F.when(F.col("kind") == 2, F.when(first, "before_first_heading")).otherwise(F.when(first, F.when(F.col("more"), "before_first_heading").otherwise("no_verified_nodes")).when(~F.col("more"), "after_last_heading"))
    return rows.select("document_id", F.col("start").cast(page).alias("start_page"), F.col("end").cast(page).alias("end_page"), F.coalesce(reason, F.lit("between_verified_nodes")).alias("reason"))


def chunks(page_counts: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    """Overlapping runs of pages, up to the first that reaches the last page."""
    step = max(1, size - overlap)
    rows = page_counts.where("page_count > 0").select("document_id", "page_count", F.posexplode(F.sequence(F.lit(0), F.col("page_count") - 1, F.lit(step))).alias("chunk", "start_page"))
    last = F.col("page_count") - 1
    return rows.where((F.col("start_page") == 0) | (F.col("start_page") - step + size - 1 < last)).select("document_id", "chunk", "start_page", F.least(F.col("start_page") + size - 1, last).alias("end_page"))


def closure(nodes: DataFrame) -> DataFrame:
    """ancestor_id, node_id of every node with itself and with the nodes whose path its own strictly extends.

    The paths' prefixes are joined, no recursion needed. Two sections of one path are no ancestors of each other.
    """
    up = nodes.select("document_id", F.col("node_id").alias("ancestor_id"), F.col("path").alias("p"))
    own = nodes.where(F.size("path") > 1).select("document_id", "node_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.slice("path", F.lit(1), k))).alias("p"))
    return nodes.select("document_id", F.col("node_id").alias("ancestor_id"), "node_id").unionByName(own.join(up, ["document_id", "p"]).select("document_id", "ancestor_id", "node_id"))


def closure_by_parent(nodes: DataFrame) -> DataFrame:
    """As closure, along parent links, for trees without unique paths: one join for each step up, until no node has one."""
    links = nodes.where("parent_id is not null").select("document_id", F.col("node_id").alias("ancestor_id"), "parent_id")
    at = checkpointed(nodes.select("document_id", F.col("node_id").alias("ancestor_id"), "node_id"))
    rows = [at]
    while not at.isEmpty():
        at = checkpointed(at.join(links, ["document_id", "ancestor_id"]).select("document_id", F.col("parent_id").alias("ancestor_id"), "node_id"))
        rows.append(at)
    return reduce(DataFrame.union, rows)


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes with their place in a pre-order walk: an ancestor's order keys come before its descendants'."""
    keyed = closure_by_parent(nodes).join(nodes.select("document_id", F.col("node_id").alias("ancestor_id"), F.struct("start_page", "end_page", F.col("path")[F.size("path") - 1].alias("t"), F.col("node_id").alias("i")).alias("k"), F.col("level").alias("depth")), ["document_id", "ancestor_id"])
    walks = keyed.groupBy("document_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("depth", "k"))).alias("walk"))
    order = W.partitionBy("document_id").orderBy(F.transform("walk", lambda x: x["k"]))
    return nodes.join(walks, ["document_id", "node_id"]).withColumn("preorder", F.row_number().over(order) - 1).drop("walk")


def needs_decomposition(nodes: DataFrame, max_pages: int = 10) -> DataFrame:
    return leaves(nodes).where(F.col("end_page") - F.col("start_page") + 1 > max_pages)


def boundary_children(parents: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Children of large leaves from boundaries (document_id, node_id, page, title): each up to the next one's page, the last up to the parent's end."""
    rows = boundaries.join(parents.select("document_id", "node_id", "start_page", "end_page", "path", "level"), ["document_id", "node_id"]).where("page between start_page and end_page")
    order = W.partitionBy("document_id", "node_id").orderBy("page", "title")
    end = F.greatest(F.col("page"), F.coalesce(F.lead("page").over(order), F.col("end_page")))
    path = F.concat("path", F.array("title"))
    return rows.select("document_id", F.col("node_id").alias("parent_id"), "title", F.col("page").alias("start_page"), end.alias("end_page"), path.alias("path"), (F.col("level") + 1).alias("level"))


def span_text(spans: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Text of page spans: pages of a span one after another. Spans become page rows, so the join is an equi-join."""
    rows = spans.select(*key, "document_id", F.explode(F.sequence("start_page", "end_page")).alias("page_index"))
    joined = rows.join(pages.select("document_id", "page_index", "text"), ["document_id", "page_index"])
    out = joined.groupBy("document_id", *key).agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    return out.select("document_id", *key, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def content_text(spans: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Text of content spans (page and character offsets; offsets hold on the first and last page)."""
    rows = spans.withColumn("page_index", F.explode(F.sequence("start_page", "end_page"))).join(pages.select("document_id", "page_index", "text"), ["document_id", "page_index"])
    first = F.when(F.col("page_index") == F.col("start_page"), F.least(F.col("start_offset"), F.length("text"))).otherwise(F.lit(0))
    last = F.when(F.col("page_index") == F.col("end_page"), F.least(F.col("end_offset"), F.length("text"))).otherwise(F.length("text"))
    rows = rows.withColumn("part", F.substring("text", first + 1, F.greatest(F.lit(0), last - first)))
    out = rows.groupBy("document_id", *key).agg(F.array_sort(F.collect_list(F.struct("page_index", "part"))).alias("p"))
    return out.select("document_id", *key, F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("text"))


def bounded_fragments(fragments: DataFrame, key: list[str], max_chars: int) -> DataFrame:
    """Fragments (ord, text) up to a total of characters; the one that crosses it is cut, the rest go."""
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy(*key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = fragments.where(F.trim("text") != "").withColumn("before", before).where(F.col("before") < max_chars)
    return rows.withColumn("text", F.trim(F.substring("text", F.lit(1), (max_chars - F.col("before")).cast("int")))).drop("before").where("text <> ''")


def attach_owned_spans(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """The default owned span: from the start page's first to the end page's last character."""
    ends = pages.select("document_id", F.col("page_index").alias("end_page"), F.length("text").alias("end_offset"))
    return nodes.join(ends, ["document_id", "end_page"], "left").withColumn("start_offset", F.lit(0)).withColumn("end_offset", F.coalesce("end_offset", F.lit(0)))


def trim_parent_spans(nodes: DataFrame) -> DataFrame:
    """A parent's own pages end before its first child starts (own_end; below start_page: none left)."""
    first = nodes.where("parent_id is not null").groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.min("start_page").alias("first_child"))
    return nodes.join(first, ["document_id", "node_id"], "left").withColumn("own_end", F.coalesce(F.col("first_child") - 1, F.col("end_page"))).drop("first_child")


def match_anchors(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors (page_index, title, offset) of each node: same folded title, on a page of its span."""
    own = nodes.select("document_id", "node_id", "start_page", "end_page", T.key_of(F.col("title")).alias("k"))
    at = anchors.select("document_id", "page_index", "offset", "title", T.key_of(F.col("title")).alias("k"))
    return own.join(at, ["document_id", "k"]).where("page_index between start_page and end_page").select("document_id", "node_id", "page_index", "offset", "title")


def summarize(nodes: DataFrame, texts: DataFrame, summarizer, min_words: int = 150) -> DataFrame:
    """Bottom-up summaries, one round for each level, deepest first.

    A leaf below min_words words is its own summary; other leaves and all parents (own text and children's summaries)
    go through summarizer(DataFrame of document_id, node_id, text) -> same with summary. Each round is cut before the
    next reads it, so a node is asked for once, and what its parent sees is what is returned.
    """
    levels = sorted((r[0] for r in nodes.select("level").distinct().collect()), reverse=True)
    done: list[DataFrame] = []
    inner = nodes.select("document_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct().withColumn("inner", F.lit(True))
    rows = nodes.join(texts.select("document_id", "node_id", "text"), ["document_id", "node_id"], "left").join(inner, ["document_id", "node_id"], "left")
    for level in levels:
        now = rows.where(F.col("level") == level)
        if done:
            kids = reduce(DataFrame.unionByName, done).join(nodes.select("document_id", "node_id", "parent_id", "start_page"), ["document_id", "node_id"]).groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("start_page", "node_id", "summary"))).alias("k"))
            now = now.join(kids, ["document_id", "node_id"], "left").withColumn("text", F.concat_ws("\n", "text", F.array_join(F.transform("k", lambda x: x["summary"]), "\n"))).drop("k")
        short = F.col("inner").isNull() & (T.word_count(F.coalesce("text", F.lit(""))) < min_words)
        raw = now.where(short).select("document_id", "node_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "title").alias("summary"), F.lit("passthrough").alias("summary_method"))
        asked = summarizer(now.where(~short).select("document_id", "node_id", "text")).select("document_id", "node_id", "summary", F.lit("model").alias("summary_method"))
        done.append(checkpointed(raw.unionByName(asked)))
    return reduce(DataFrame.unionByName, done)


def prefix_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Text of each parent's pages from its start to its first child's start, both included."""
    first = nodes.where("parent_id is not null").groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.min("start_page").alias("first"))
    spans = nodes.join(first, ["document_id", "node_id"]).select("document_id", "node_id", "start_page", F.greatest("start_page", "first").alias("end_page"))
    return span_text(spans, pages, ["node_id"])


def _as_nodes(rows: DataFrame, origin: str, confidence: float) -> DataFrame:
    """Nodes of ordered entries (ord, level, title, start_page, end_page) with path, id and parent."""
    ident = T.node_id(F.col("document_id"), F.col("path"), F.col("level"), F.col("start_page"), F.lit(0), F.lit(1), F.col("start_page"))
    out = parents_by_path(with_paths(rows).withColumn("node_id", ident))
    return out.select("document_id", "node_id", "parent_id", "ord", "path", "level", "title", T.key_of(F.col("title")).alias("normalized_title"), "start_page", "end_page", F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence"))


def from_outline(entries: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Trees from outlines (document_id, ord, level, title, page_index); a document without entries is one `Document Root`."""
    order = W.partitionBy("document_id").orderBy("page_index", "level", "title", "ord")
    spans = lead_spans(entries, page_counts).withColumn("ord", F.row_number().over(order)).select("document_id", "ord", "level", "title", "start_page", "end_page")
    bare = page_counts.join(entries.where("page_index is not null").select("document_id").distinct(), "document_id", "left_anti")
    lone = bare.select("document_id", F.lit(1).alias("ord"), F.lit(1).alias("level"), F.lit("Document Root").alias("title"), F.lit(0).alias("start_page"), F.greatest(F.lit(0), F.col("page_count") - 1).alias("end_page"))
    return _as_nodes(spans, "outline", 0.7).unionByName(_as_nodes(lone, "inferred", 0.5))


def from_responses(responses: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Trees from a model's answers (document_id, ord, level, title, start_page, end_page); pages are clamped to the document."""
    last = F.col("page_count") - 1
    rows = responses.join(page_counts, "document_id").select("document_id", "ord", "level", "title", F.least("start_page", last).alias("start_page"), F.least("end_page", last).alias("end_page"))
    return _as_nodes(rows, "llm_synthesized", 0.8)


def synthesize_chunked(pages: DataFrame, page_counts: DataFrame, ask_chunk, ask_merge, size: int = 10, overlap: int = 2) -> DataFrame:
    """Trees of long documents: every chunk of pages is asked about, then once a document what the chunks said is merged.

    ask_chunk(document_id, chunk, start_page, end_page, text) and ask_merge(document_id, total_pages, chunks) map
    DataFrames; both add an array `nodes` of (level, title, start_page, end_page). Chunks know nothing of each other.
    """
    spans = chunks(page_counts, size, overlap)
    texts = span_text(spans.select("document_id", "chunk", "start_page", "end_page"), pages, ["chunk"])
    said = checkpointed(ask_chunk(spans.select("document_id", "chunk", "start_page", "end_page").join(texts, ["document_id", "chunk"])).select("document_id", "chunk", "start_page", "end_page", "nodes"))
    asked = said.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "start_page", "end_page", "nodes"))).alias("chunks")).join(page_counts.select("document_id", F.col("page_count").alias("total_pages")), "document_id")
    merged = ask_merge(asked).select("document_id", F.posexplode("nodes").alias("ord", "n")).select("document_id", "ord", "n.*")
    return from_responses(merged, page_counts)


def build(entries: DataFrame, page_counts: DataFrame, pages: DataFrame | None = None, ask=None, ask_chunk=None, ask_merge=None, chunk_pages: int = 15) -> DataFrame:
    """Trees of all documents: without a model from outlines; else short documents in one call, those of chunk_pages or more by chunks."""
    if ask is None:
        return from_outline(entries, page_counts)
    short, long = page_counts.where(F.col("page_count") < chunk_pages), page_counts.where(F.col("page_count") >= chunk_pages)
    whole = span_text(short.select("document_id", F.lit(0).alias("start_page"), (F.col("page_count") - 1).alias("end_page")), pages, [])
    answers = ask(whole).select("document_id", F.posexplode("nodes").alias("ord", "n")).select("document_id", "ord", "n.*")
    return from_responses(answers, short).unionByName(synthesize_chunked(pages, long, ask_chunk or ask, ask_merge))


def flatten_outline(outlines: DataFrame) -> DataFrame:
    """Entries of nested outlines. outlines: document_id, ord, depth of nesting (0 at the top), title, page (0-based or null)."""
    return outlines.select("document_id", "ord", (F.col("depth") + 1).alias("level"), F.trim("title").alias("title"), F.when(F.col("page") >= 0, F.col("page")).alias("page_index"))


def node_cards(nodes: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Cards of nodes: what search and selection read. Summaries are joined where there are any."""
    cards = nodes.select("document_id", "node_id", "parent_id", "title", "path", "level", "start_page", "end_page", F.array_distinct("path").alias("keywords"))
    if summaries is None:
        return cards.withColumn("summary", F.lit(None).cast("string"))
    return cards.join(summaries.select("document_id", "node_id", "summary"), ["document_id", "node_id"], "left")


def stable_order() -> list[Column]:
    return [F.col("start_page"), F.col("level"), F.col("node_id")]
