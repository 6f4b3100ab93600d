"""From texts to pages and lines with stable offsets. document_id is the key everywhere, so all documents are one job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.functions import text as T

#: Lines on a logical page; geometry of synthetic lines.
LINES_PER_PAGE, LINE_HEIGHT, CHAR_WIDTH, BODY_FONT = 40, 14.0, 7.0, 12.0


def fingerprints(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """document_id (SHA-256 of the bytes), source_path, sha256, file_size_bytes."""
    digest = F.sha2(F.col(content), 256)
    return files.select(digest.alias("document_id"), F.col(path).alias("source_path"), digest.alias("sha256"), F.length(content).cast("long").alias("file_size_bytes"))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def markdown_lines(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE, split_on_breaks: bool = True) -> DataFrame:
    """Logical pages of Markdown texts (document_id, text): page_index, reading_index, content, heading_level (0: none).

    Blank lines go, a heading is its title, a thematic break starts a page, a fenced block stays on one page if it fits.
    One pass over each text, so no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, *line) for doc, text in zip(batch.document_id, batch.text, strict=True) for line in paginate(blocks(text or "", split_on_breaks), lines_per_page)]
            yield pd.DataFrame(rows, columns=["document_id", "page_index", "reading_index", "content", "heading_level"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInPandas(run, f"document_id {kind}, page_index int, reading_index int, content string, heading_level int")


_HEADING, _BREAK = re.compile(T.HEADING), re.compile(T.BREAK)
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")


def blocks(text: str, split_on_breaks: bool = True) -> list[tuple[list[tuple[str, int]], bool]]:
    """(lines with heading levels, whether a page starts before) of each block: a line, or a fenced block."""
    out, page, fence, inside = [], False, "", []
    for line in map(str.rstrip, text.split("\n")):
        if fence:
            mark = line.strip()
            if len(mark) >= len(fence) and set(mark) == {fence[0]}:
                out.append((inside, page))
                fence, inside, page = "", [], False
            elif line:
                inside.append((line, 0))
        elif opened := _FENCE.match(line):
            fence, inside = opened[1], [(line, 0)]
        elif not line.strip():
            continue
        elif split_on_breaks and _BREAK.match(line):
            page = True
        else:
            title = _HEADING.match(line.strip())
            out.append(([(title[2].strip(), len(title[1])) if title else (line, 0)], page))
            page = False
    return [*out, (inside, page)] if inside else out


def paginate(parts: list[tuple[list[tuple[str, int]], bool]], lines_per_page: int) -> list[tuple[int, int, str, int]]:
    """(page, place on the page, content, heading level) of each line."""
    out, page, used = [], 0, 0
    for lines, fresh in parts:
        if used and (fresh or 1 < len(lines) <= lines_per_page < used + len(lines) or (len(lines) > lines_per_page and used)):
            page, used = page + 1, 0
        for content, level in lines:
            if used == lines_per_page:
                page, used = page + 1, 0
            out.append((page, used, content, level))
            used += 1
    return out


def logical_pages(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """As markdown_lines for texts without fences, in DataFrame functions: page_index, reading_index, content, heading_level."""
    lines = docs.select("document_id", F.posexplode(F.split(unix_lines("text"), "\n")).alias("at", "raw"))
    lines = lines.withColumn("content", F.rtrim(F.regexp_replace("raw", "(?U)\\s+$", ""))).where(F.trim("content") != "")
    order = W.partitionBy("document_id").orderBy("at")
    lines = lines.withColumn("is_break", T.thematic_break(F.col("content"))).withColumn("segment", F.sum(F.col("is_break").cast("int")).over(order))
    lines = lines.where(~F.col("is_break"))
    level, title = T.heading(F.col("content"))
    k = (F.row_number().over(W.partitionBy("document_id", "segment").orderBy("at")) - 1).cast("int")
    lines = lines.withColumn("k", k).withColumn("part", F.floor(F.col("k") / lines_per_page))
    page = (F.dense_rank().over(W.partitionBy("document_id").orderBy("segment", "part")) - 1).cast("int")
    return lines.select("document_id", page.alias("page_index"), (F.col("k") % lines_per_page).cast("int").alias("reading_index"), F.when(level > 0, title).otherwise(F.col("content")).alias("content"), level.alias("heading_level"))


def text_lines(lines: DataFrame) -> DataFrame:
    """Lines with start and end offsets on their page (lines joined by a newline), occurrence index and keys."""
    by_page = W.partitionBy("document_id", "page_index").orderBy("reading_index")
    start = F.coalesce(F.sum(F.length("content") + 1).over(by_page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    out = lines.withColumn("content", F.trim("content")).withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("content"))
    out = out.withColumn("normalized_text", T.key_of(F.col("content"))).withColumn("casefold_punct_text", T.punct_key(F.col("content")))
    same = W.partitionBy("document_id", "page_index", "normalized_text").orderBy("reading_index")
    return out.withColumn("occurrence_index", (F.row_number().over(same) - 1).cast("int"))


def text_pages(lines: DataFrame) -> DataFrame:
    """Pages with their text, its SHA-256 and length."""
    pages = lines.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("reading_index", F.trim("content").alias("content")))).alias("l"))
    pages = pages.select("document_id", "page_index", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("text"))
    return pages.withColumn("text_sha256", F.sha2("text", 256)).withColumn("text_length", F.length("text"))


def geometry(lines: DataFrame) -> DataFrame:
    """Synthetic places of lines: top, width and font size, and the page's height."""
    size = F.when(F.col("heading_level") > 0, F.greatest(F.lit(13.0), 24.0 - 2.0 * (F.col("heading_level") - 1))).otherwise(F.lit(BODY_FONT))
    height = F.greatest(F.lit(792.0), LINE_HEIGHT * F.count("*").over(W.partitionBy("document_id", "page_index")) + 36.0)
    return lines.withColumns({"top_y": F.col("reading_index") * LINE_HEIGHT, "width": F.length("content") * CHAR_WIDTH, "font_size": size, "page_height": height})


def pages_text(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    return text_pages(logical_pages(docs, lines_per_page))


def page_trust(blocks: DataFrame) -> DataFrame:
    """Counts of trust tiers on each page as a map, and the dominant one (by count, then name)."""
    tier = T.trust_tier(F.col("source_track"), F.col("authoritativeness"), F.col("confidence"))
    counts = blocks.groupBy("document_id", "page_index", tier.alias("tier")).agg(F.count("*").alias("n"))
    return counts.groupBy("document_id", "page_index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", "n")))).alias("tiers"), F.max_by("tier", F.struct("n", "tier")).alias("dominant_tier"))
