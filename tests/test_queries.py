"""Each query of the library against its SQL, at the smallest scale."""

import itertools
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from leafgrove.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    value = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x
    names = sorted(frame)
    return sorted((tuple(value(x) for x in r) for r in zip(*(frame[n] for n in names), strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toArrow().to_pydict()
    want = con.execute(catalog.ORACLE_SQL[name]).to_arrow_table().to_pydict()
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    """Their content is checked by tests of their own."""
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_compact_mild_keeps_wide_parents(spark, tmp_path):
    """Parents of 30, 60 and 130 children: as they are, runs between high-signal ones, and the cheapest neighbours merged to 40."""
    sizes = {"A": 30, "B": 60, "C": 130}
    owners = [name for name, n in sizes.items() for _ in range(n)]
    pq.write_table(pa.table({"r_regionkey": [0], "r_name": ["R"]}), tmp_path / "region.parquet")
    pq.write_table(pa.table({"n_nationkey": [0, 1, 2], "n_name": ["A", "B", "C"], "n_regionkey": [0, 0, 0]}), tmp_path / "nation.parquet")
    pq.write_table(pa.table({"c_custkey": range(len(owners)), "c_name": [f"c{k:03d}" for k in range(len(owners))], "c_nationkey": ["ABC".index(n) for n in owners]}), tmp_path / "customer.parquet")
    got = {r.node_id: r.segment for r in catalog.QUERIES["compact_mild"](spark, str(tmp_path)).collect()}
    spans = {n: (min(k % 60 for k, o in enumerate(owners) if o == n), max(k % 60 + k % 3 for k, o in enumerate(owners) if o == n)) for n in sizes}
    want = {f"R/{n}": place for place, n in enumerate(sorted(sizes, key=lambda n: (spans[n], n)))}
    for name, n in sizes.items():
        own = sorted((k % 60, k % 60 + k % 3, f"c{k:03d}") for k, o in enumerate(owners) if o == name)
        high = [a % 4 == 0 or b > a for a, b, _ in own]
        parts = [[k] for k in range(n)]
        if 40 < n <= 80:
            parts = [[0]]
            for k in range(1, n):
                parts[-1].append(k) if not high[k] and not high[k - 1] else parts.append([k])
        elif n > 80:
            score = [[b - a + 1 + 4.0 * (a % 4 == 0) + 1.0 / 3] for a, b, _ in own]
            total = [s[0] for s in score]
            while len(parts) > 40:
                k = min(range(len(parts) - 1), key=lambda k: ((total[k] + total[k + 1]) / (len(parts[k]) + len(parts[k + 1])), k))
                parts[k : k + 2], total[k : k + 2] = [parts[k] + parts[k + 1]], [total[k] + total[k + 1]]
        want |= {f"R/{name}/{own[k][2]}": s for s, part in enumerate(parts) for k in part}
    assert got == want


def whole_sql(name, cut, every):
    """A query's SQL without its choice of ids."""
    return catalog.ORACLE_SQL[name].replace(cut, every)


def test_token_overlap_of_all_pairs(spark, con):
    got = catalog.QUERIES["token_overlap"](spark, SF).toArrow().to_pydict()
    assert len(got["doc_id"]) == con.execute("SELECT (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark)").fetchone()[0]
    assert rows(got) == rows(con.execute(whole_sql("token_overlap", "ON d.doc_id % 40 = b.item_id % 40", "ON true")).to_arrow_table().to_pydict())


def test_excerpts_of_search_hits(spark, con):
    top = whole_sql("rank_topk_batch", "rank <= 3", "rank <= 10")
    con.execute(f"CREATE OR REPLACE TEMP VIEW top AS {top}")
    want = con.execute(whole_sql("qa_excerpt", "ON doc_id % 40 = query_id % 40", "ON (query_id, doc_id) IN (SELECT (query_id, document_id) FROM top)")).to_arrow_table().to_pydict()
    assert len(want["query_id"]) == 10 * con.execute("SELECT count(*) FROM benchmark").fetchone()[0]
    assert rows(catalog.QUERIES["qa_excerpt"](spark, SF).toArrow().to_pydict()) == rows(want)


def test_rank_keyword_of_all_queries(spark, con):
    want = con.execute(whole_sql("rank_keyword", " WHERE query_id % 8 = 0", "")).to_arrow_table().to_pydict()
    assert len(set(want["query_id"])) == con.execute("SELECT count(*) FROM benchmark").fetchone()[0]
    assert rows(catalog.QUERIES["rank_keyword"](spark, SF).toArrow().to_pydict()) == rows(want)


def test_prefilter_of_all_types_and_brands(spark, con):
    every = "WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_type, p_brand)"
    want = con.execute(whole_sql("prefilter_lexical", "WHERE p_partkey % 97 = 0", every)).to_arrow_table().to_pydict()
    got = catalog.QUERIES["prefilter_lexical"](spark, SF).toArrow().to_pydict()
    assert len({q for q in got["query_id"] if q >= 0}) == con.execute("SELECT count(DISTINCT (p_type, p_brand)) FROM part").fetchone()[0]
    assert any(q < 0 for q in got["query_id"])  # queries inside of words
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """One nation of 25 customers, one of 4."""
    path = tmp_path_factory.mktemp("wide")
    pq.write_table(pa.table({"r_regionkey": [0], "r_name": ["R"]}), path / "region.parquet")
    pq.write_table(pa.table({"n_nationkey": [0, 1], "n_name": ["A", "B"], "n_regionkey": [0, 0]}), path / "nation.parquet")
    pq.write_table(pa.table({"c_custkey": range(29), "c_name": [f"c{k:03d}" for k in range(29)], "c_nationkey": [0] * 25 + [1] * 4}), path / "customer.parquet")
    return str(path)


def test_compacted_nodes_stand_for_their_segments(spark, wide):
    """25 children are merged to 10; ids, titles and spans follow the segments, and expansion gives every child once, in order."""
    from leafgrove.operators import compaction
    from leafgrove.plans import table_plans
    from leafgrove.plans.inputs import nodes

    own = nodes(spark, wide)
    cut = compaction.segments(compaction.importance(own, table_plans._summaries(own)), 10).collect()
    at = {r.node_id: r for r in own.collect()}
    want = {}
    for r in cut:
        want.setdefault((r.parent_id, r.segment, r.merged), []).append(at[r.node_id])
    rows = set()
    for (parent, segment, merged), kids in want.items():
        kids.sort(key=lambda n: (n.start_page, n.end_page, n.level, n.path, n.node_id))
        title = kids[0].title + (f" (+{len(kids) - 1})" if len(kids) > 1 else "")
        rows.add((f"{parent}::compact::{segment:02d}" if merged else kids[0].node_id, title, min(n.start_page for n in kids), max(n.end_page for n in kids), ",".join(n.node_id for n in kids)))
    got = catalog.QUERIES["compact_tree"](spark, wide).collect()
    assert {(r.serving_node_id, r.title, r.start_page, r.end_page, r.canonical_node_ids) for r in got} == rows
    assert sum(r.serving_node_id.startswith(("R/A/", "R/A:")) for r in got) == 10
    mapped = catalog.QUERIES["serving_map"](spark, wide).collect()
    assert sorted(r.node_id for r in mapped) == sorted(n for n in at if n != "R")
    assert all(r.node_id == (",".join(ids).split(","))[r.place] for r in mapped for ids in [[x.canonical_node_ids for x in got if r.node_id in x.canonical_node_ids.split(",")]])


def test_summaries_ask_once_for_each_node(spark):
    from pyspark.sql import functions as F

    from leafgrove.operators import tree

    rows = [("d", "r", None, "R", 1, 0), ("d", "a", "r", "A", 2, 0), ("d", "b", "r", "B", 2, 1), ("d", "c", "a", "C", 3, 0)]
    own = spark.createDataFrame(rows, "document_id string, node_id string, parent_id string, title string, level int, start_page int")
    texts = own.select("document_id", "node_id", F.lit("some words").alias("text"))
    asked = spark.sparkContext.accumulator(0)

    def model(df):
        def run(batches):
            for batch in batches:
                asked.add(len(batch))
                yield batch.assign(summary="s:" + batch.node_id)

        return df.mapInPandas(run, "document_id string, node_id string, text string, summary string")

    got = {r.node_id: r.summary for r in tree.summarize(own, texts, model, 1).collect()}
    assert got == {n: f"s:{n}" for n in "rabc"} and asked.value == 4


def test_trees_of_short_and_long_documents(spark):
    """Without a model outlines; with one, short documents are one call, long ones chunks and a merge."""
    from pyspark.sql import functions as F

    from leafgrove.operators import tree

    counts = spark.createDataFrame([("short", 3), ("long", 18), ("bare", 2)], "document_id string, page_count int")
    pages = counts.select("document_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_index")).withColumn("text", F.lit("x"))
    entries = spark.createDataFrame([("short", 1, 1, "A", 0), ("short", 2, 2, "B", 1), ("long", 1, 1, "Z", None)], "document_id string, ord int, level int, title string, page_index int")
    built = {(r.document_id, r.title): (r.start_page, r.end_page, r.origin) for r in tree.build(entries, counts).collect()}
    assert built == {("short", "A"): (0, 1, "outline"), ("short", "B"): (1, 2, "outline"), ("long", "Document Root"): (0, 17, "inferred"), ("bare", "Document Root"): (0, 1, "inferred")}
    node = F.struct(F.lit(1).alias("level"), F.lit("whole").alias("title"), F.lit(0).alias("start_page"), F.lit(99).alias("end_page"))
    part = F.struct(F.lit(1).alias("level"), F.concat(F.lit("chunk "), F.col("chunk").cast("string")).alias("title"), "start_page", "end_page")
    merge = lambda df: df.withColumn("nodes", F.flatten(F.transform("chunks", lambda c: c["nodes"])))
    made = tree.build(entries, counts, pages, lambda df: df.withColumn("nodes", F.array(node)), lambda df: df.withColumn("nodes", F.array(part)), merge).collect()
    assert {(r.document_id, r.title): (r.start_page, r.end_page) for r in made} == {("short", "whole"): (0, 2), ("bare", "whole"): (0, 1), ("long", "chunk 0"): (0, 9), ("long", "chunk 1"): (8, 17)}


def broadcast(df):
    """What the plan has below its broadcasts. Lines of the tree only: constants may hold line breaks."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if x.lstrip(" :").startswith(("+-", ":-"))]
    out, at = [], lambda x: len(x) - len(x.lstrip(" :"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            out += itertools.takewhile(lambda x, k=at(line): at(x) > k, lines[k + 1 :])
    return "\n".join(out)


def test_prefilter_broadcasts_no_documents(spark):
    got = catalog.QUERIES["prefilter_lexical"](spark, SF)
    assert "p_type" in broadcast(got) and "p_name" not in broadcast(got)


def test_description_sources_choose_from_few_rows(spark):
    """Two documents, with and without a root: the same as by looking at all nodes; of the many told ones of a span few are looked at."""
    import random

    from leafgrove.operators import compaction

    dice, rows = random.Random(5), []
    for d, tops in (("one", 1), ("two", 3)):
        rows += [(d, f"t{k}", [f"t{k}"], 1, 2 * k, 2 * k + 1) for k in range(tops)] + [(d, f"t0/{k}", ["t0", f"{k}"], 2, k, k) for k in range(3)]
        rows += [(d, f"t0/0/{k:03d}", ["t0", "0", f"{k:03d}"], 3, a := dice.randrange(6), a + dice.randrange(9)) for k in range(600)]
    nodes = spark.createDataFrame(rows, "document_id string, node_id string, path array<string>, level int, start_page int, end_page int")
    told = nodes.where("level = 3")
    want = set()
    for d, tops in (("one", 1), ("two", 3)):
        own = sorted((r for r in rows if r[0] == d), key=lambda r: (r[4], r[5], r[3], r[2], r[1]))
        chosen = [r for r in own if r[3] == 1] + [r for r in own if r[3] == 2 and tops == 1]
        while len(chosen) < 8:
            pages = {p for r in chosen for p in range(r[4], r[5] + 1)}
            chosen.append(min((r for r in own if r[3] == 3 and r not in chosen), key=lambda r: (-len(set(range(r[4], r[5] + 1)) - pages), r[4] - r[5])))
        want |= {(d, k, r[1]) for k, r in enumerate(chosen)}
    assert {tuple(r) for r in compaction.description_sources(nodes, told).collect()} == want
    spans = len({(r[0], r[4], r[5]) for r in rows if r[3] == 3})
    assert compaction.source_candidates(nodes, told).count() <= 8 * spans + 7 < len(rows)


def test_paths_and_parents_of_long_outlines(spark):
    """As by hand, levels below 1, null and skipped among them; no entry is joined with the others of its document."""
    import random

    from leafgrove.operators import tree

    dice = random.Random(3)
    rows = [(d, k, dice.choice([None, -1, 0, 1, 2, 2, 3, 3, 4, 7]), f"T{dice.randrange(3)}") for d in "ab" for k in range(1500)]
    want, stack, seen = {}, {"a": [], "b": []}, {}
    for d, k, level, title in rows:
        stack[d] = [*(stack[d] if level is None else stack[d][: max(0, level - 1)]), title]
        want[d, k] = (stack[d], seen.get((d, *stack[d][:-1])) if len(stack[d]) > 1 else None)
        seen[(d, *stack[d])] = f"{d}{k}"
    own = spark.createDataFrame(rows, "document_id string, ord int, level int, title string").orderBy("title")
    from pyspark.sql import functions as F

    found = tree.parents_by_path(tree.with_paths(own).withColumn("node_id", F.concat("document_id", F.col("ord").cast("string"))))
    assert {(r.document_id, r.ord): (r.path, r.parent_id) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "aggregate(" not in plan


def test_gaps_are_found_without_pages(spark):
    """As page by page: spans beyond the document, turned round and missing ones; the plan has no row for each page."""
    import random

    from leafgrove.operators import tree

    dice = random.Random(4)
    counts = [(f"d{k}", k % 12) for k in range(60)]
    spans = [(f"d{dice.randrange(70)}", a := dice.randrange(-3, 16), a + dice.randrange(-1, 3)) for _ in range(110)] + [("d5", None, 3), ("d6", 2, None)]
    want = set()
    for d, n in counts:
        covered = {p for x, a, b in spans if x == d and a is not None and b is not None for p in range(min(a, b), max(a, b) + 1)}
        free = [p for p in range(n) if p not in covered]
        for _, run in itertools.groupby(enumerate(free), lambda x: x[1] - x[0]):
            own = [p for _, p in run]
            reason = "no_verified_nodes" if not covered else "before_first_heading" if own[-1] < min(covered) else "after_last_heading" if own[0] > max(covered) else "between_verified_nodes"
            want.add((d, own[0], own[-1], reason))
    found = tree.gaps(spark.createDataFrame(spans, "document_id string, start_page int, end_page int"), spark.createDataFrame(counts, "document_id string, page_count int"))
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Join" not in plan


def test_rank_adds_up_few_units_in_a_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from leafgrove.operators import search
    from leafgrove.plans import inputs, search_plans

    monkeypatch.setattr(search, "DEALT", 10)
    hits = search.rank(search_plans._ranked(spark, SF), inputs.queries(spark, SF))
    shares = hits.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("document_id").alias("n")).collect()
    assert len(shares) > 10 and max(r.n for r in shares) < 30


def test_answers_search_once(spark):
    """Counts, answers and citations come from one search, whose plan ranks the units once."""
    from leafgrove.operators import qa

    texts = ["the river is wide\nthe stone", "a stone in the river", "The river is WIDE", "of nothing else", "| river | 7 |"]
    units = spark.createDataFrame([(1, f"u{k}", "table" if k == 4 else "page_text", "table" if k == 4 else "text", k, k, None, t, k) for k, t in enumerate(texts)], "document_id int, unit_id string, unit_type string, modality string, start_page int, end_page int, title string, text string, ord int")
    requests = spark.createDataFrame([(1, 1, "the wide river"), (2, 1, "tabular river"), (3, 1, "an overview"), (4, 1, "zebra")], "query_id int, document_id int, query string")
    found = qa.answers(units, requests)
    assert found._jdf.queryExecution().optimizedPlan().toString().count(" AS rank#") == 1
    got = {r.query_id: (r.answer_mode, r.answer, r.citations and [c.citation.unit_id for c in r.citations]) for r in found.collect()}
    assert got[1] == ("grounded_multi_excerpt", "the river is wide. a stone in the river. of nothing else.", ["u0", "u1", "u3"])
    assert got[2] == ("authoritative_text", "| river | 7 |.", ["u4"])
    assert got[3] == ("document_summary_fallback", "the river is wide\nthe stone. a stone in the river.", None)
    assert got[4] == ("low_evidence", None, None)


def test_excerpts_cut_a_query_once(spark):
    """An excerpt is computed once, not again by a filter, and its query is cut into tokens outside the walk over lines."""
    import re

    plan = catalog.QUERIES["qa_excerpt"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1
    inside = plan[plan.index("array_max(") :].split("Join Inner")[0]
    assert re.search(r"array_intersect\(.*?, lambda x_\d+#\d+\)", inside, re.S)
    hits = spark.createDataFrame([(1, 1, "wide river", " \n the river\nA wide, wide river \nriver wide"), (1, 2, "wide river", " \n "), (1, 3, "wide river", None), (2, 1, "", "a\nb")], "query_id int, document_id int, query string, text string")
    from leafgrove.operators import search

    got = {(r.query_id, r.document_id): r.excerpt for r in search.excerpts(hits, 12).collect()}
    assert got == {(1, 1): "A wide, wide", (1, 2): None, (1, 3): None, (2, 1): "a"}
