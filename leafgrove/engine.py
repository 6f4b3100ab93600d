"""One object for the whole way from texts to answers: ingest, build, search, ask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.operators import ingest, qa, search, tree
from leafgrove.sources import store


@dataclass(frozen=True)
class Preset:
    """Named settings of a kind of document."""

    name: str = "general_document"
    lines_per_page: int = 40
    chunk_pages: int = 10
    chunk_overlap: int = 2
    max_children: int = 12
    answer_hits: int = 3


PRESETS = {p.name: p for p in (Preset(),)}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


class Engine:
    """Pages and units of a collection as tables in a folder; every query runs over all of it."""

    def __init__(self, spark: SparkSession, root: str, settings: str = "general_document"):
        self.spark, self.root, self.preset = spark, root.rstrip("/"), preset(settings)
        self.runs = store.RunRegistry(spark, f"{self.root}/runs")

    def ingest(self, docs: DataFrame, run_id: str) -> DataFrame:
        """Pages of docs (document_id, text), written once for a run id and these settings."""
        path = f"{self.root}/pages/{run_id}"
        new, run = self.runs.reserve("ingest", run_id, "*", {"digest": store.settings_digest(vars(self.preset))})
        if new or run["status"] != "completed":
            ingest.text_pages(ingest.markdown_lines(docs, self.preset.lines_per_page)).write.mode("overwrite").parquet(path)
            self.runs.complete("ingest", run_id, path)
        return self.spark.read.parquet(path)

    def units(self, pages: DataFrame, nodes: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
        """All unit families of a collection."""
        families = [search.page_units(pages)]
        if nodes is not None:
            counts = pages.groupBy("document_id").agg((F.max("page_index") + 1).alias("page_count"))
            texts = tree.span_text(nodes.select("document_id", "node_id", "start_page", "end_page"), pages, ["node_id"])
            families.append(search.node_units(nodes, texts))
            if summaries is not None:
                families.append(search.summary_units(nodes, summaries))
            gaps = tree.gaps(nodes, counts)
            families.append(search.gap_units(gaps, tree.span_text(gaps, pages, ["start_page"]).select("document_id", "start_page", "text")))
        return search.union_units(*families)

    def search(self, units: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        ordered = units.withColumn("cand_ord", F.struct("document_id", "start_page", "end_page", F.lower(F.coalesce("title", F.lit(""))).alias("t"), "unit_id"))
        return search.rank(ordered, queries, k)

    def ask(self, units: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, document_id, answer, citations."""
        hits = self.search(units, queries, k).join(units.drop("cand_ord"), ["document_id", "unit_id"]).join(F.broadcast(queries), "query_id")
        grounded = qa.grounding(search.excerpts(hits), limit=self.preset.answer_hits)
        cited = qa.citations(grounded).groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("place", "citation"))).alias("citations"))
        return qa.compose(grounded).join(cited, ["query_id", "document_id"])


def main(argv: list[str] | None = None) -> None:
    """python -m leafgrove.engine ingest|search ROOT RUN [PATH or QUERY]"""
    import sys

    command, root, run_id, argument = (argv or sys.argv[1:])[:4]
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(spark, root)
    if command == "ingest":
        good, bad = store.read_markdown(spark, argument)
        print(f"{engine.ingest(good, run_id).count()} pages, {bad.count()} files rejected")
    else:
        pages = spark.read.parquet(f"{engine.root}/pages/{run_id}")
        engine.ask(engine.units(pages), spark.createDataFrame([(1, argument)], "query_id int, query string")).show(truncate=False)


if __name__ == "__main__":
    main()
