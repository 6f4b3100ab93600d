"""Hand-checked rules of the single operators."""

import json

import pytest
from pyspark.sql import functions as F

from leafgrove.functions import text as T
from leafgrove.operators import compaction, gateway, ingest, qa, search, selection, tree, treesearch
from leafgrove.sources import store
from leafgrove.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["  What Is  This About  ", "Straße ﬁne", "ΑΣ ς", "İstanbul", "a_b-c'd", "", "ǅ x"])
def test_normalize_is_casefold(spark, raw):
    want = " ".join("".join(" " if c in T.PUNCT else c for c in raw.casefold()).split())
    assert one(spark, T.normalize(F.lit(raw))) == want


def test_headings_and_breaks(spark):
    assert one(spark, F.struct(*T.heading(F.lit("## A title ##"))))[:] == (2, "A title")
    assert one(spark, T.thematic_break(F.lit("* * *"))) and not one(spark, T.thematic_break(F.lit("*-*")))


def test_section_anchors(spark):
    text = "x <!-- SECTION_ANCHOR: level=1, title='A' --> y <!-- SECTION_ANCHOR: level=1, title='A' --><!-- SECTION_ANCHOR: level=0, title='B' -->"
    found = one(spark, T.section_anchors(F.lit(text)))
    mark = "<!-- SECTION_ANCHOR: level=1, title='A' -->"
    assert [(a["level"], a["title"], a["offset"]) for a in found] == [(1, "A", 2), (1, "A", text.index(mark, 5))]


def test_fences_stay_together():
    parts = ingest.blocks("# T\n\n```py\na\n\nb\n```\nx\n---\ny")
    assert [[c for c, _ in lines] for lines, _ in parts] == [["T"], ["```py", "a", "b"], ["x"], ["y"]]
    assert [p[0] for p in ingest.paginate(parts, 3)] == [0, 1, 1, 1, 2, 3]


@pytest.mark.parametrize(("n", "want"), [(15, [(0, 9), (8, 14)]), (25, [(0, 9), (8, 17), (16, 24)]), (0, [])])
def test_chunks(spark, n, want):
    got = tree.chunks(spark.createDataFrame([("d", n)], "document_id string, page_count int")).collect()
    assert sorted((r.start_page, r.end_page) for r in got) == want


def test_gaps(spark):
    nodes = spark.createDataFrame([("d", 1, 1), ("d", 3, 3)], "document_id string, start_page int, end_page int")
    got = tree.gaps(nodes, spark.createDataFrame([("d", 5)], "document_id string, page_count int")).orderBy("start_page").collect()
    assert [(r.start_page, r.reason) for r in got] == [(0, "before_first_heading"), (2, "between_verified_nodes"), (4, "after_last_heading")]


def test_outline_score(spark):
    rows = [("d", "pypdf", k, 1, f"t{k}", k) for k in range(3)]
    got = tree.outline_quality(spark.createDataFrame(rows, "document_id string, source string, ord int, level int, title string, page_index int")).first()
    assert got.score == 300


NODES = "document_id string, node_id string, parent_id string, title string, level int, path array<string>, start_page int, end_page int, summary string, keywords array<string>"


def _chain(spark):
    rows = [("d", "r", None, "Root", 1, ["Root"], 0, 3, "", []), ("d", "a", "r", "Part", 2, ["Root", "Part"], 0, 2, "", []), ("d", "b", "a", "Appendix", 3, ["Root", "Part", "Appendix"], 1, 1, "", [])]
    return spark.createDataFrame(rows, NODES)


def test_tree_search_passes_through_single_nodes(spark):
    found = treesearch.search(_chain(spark), spark.createDataFrame([(1, "appendix")], "query_id int, query string"))
    assert [(r.node_id, r.score, r.signal) for r in found.candidates.collect()] == [("b", 2.0, "leaf")]
    assert [(r.step, r.node_id, r.score) for r in found.trace.orderBy("step").collect()] == [(0, "r", 0.0), (1, "a", 0.0), (2, "b", 2.0)]


def test_tree_search_falls_back(spark):
    rows = _chain(spark).union(spark.createDataFrame([("d", "r2", None, "Other", 1, ["Other"], 4, 5, "", [])], NODES))
    found = treesearch.search(rows, spark.createDataFrame([(1, "zzz")], "query_id int, query string"))
    assert found.candidates.count() == 0 and found.final.first().signal == "fallback_to_flat"


def test_sufficient_evidence_stops(spark):
    evidence = spark.createDataFrame([("d", "a", "u", "Part", "the appendix")], "document_id string, node_id string, unit_id string, title string, text string")
    found = treesearch.search(_chain(spark), spark.createDataFrame([(1, "appendix")], "query_id int, query string"), evidence)
    assert [(r.node_id, r.signal) for r in found.candidates.collect()] == [("a", "evidence_sufficient")]


def test_closures_agree(spark):
    nodes = _chain(spark)
    assert set(map(tuple, tree.closure(nodes).collect())) == set(map(tuple, tree.closure_by_parent(nodes).collect()))


def _parents(built):
    """The start page of each section's parent, by place."""
    rows = built.orderBy("ord").collect()
    starts = {r.node_id: r.start_page for r in rows if r.level == 1}
    assert len({r.node_id for r in rows if r.level == 2}) == 1
    return [starts[r.parent_id] for r in rows if r.level == 2]


def test_outline_entries_of_one_id_have_parents_of_their_own(spark):
    """Pages beyond the last are clamped to it, after the order was made: both sections lie on page 5."""
    entries = spark.createDataFrame([("d", 1, 1, "A", 3), ("d", 2, 2, "B", 7), ("d", 3, 1, "A", 8), ("d", 4, 2, "B", 9)], "document_id string, ord int, level int, title string, page_index int")
    assert _parents(tree.from_outline(entries, spark.createDataFrame([("d", 6)], "document_id string, page_count int"))) == [3, 5]


def test_response_entries_of_one_id_have_parents_of_their_own(spark):
    entries = spark.createDataFrame([("d", 1, 1, "A", 0, 5), ("d", 2, 2, "B", 4, 4), ("d", 3, 1, "A", 2, 5), ("d", 4, 2, "B", 4, 5)], "document_id string, ord int, level int, title string, start_page int, end_page int")
    assert _parents(tree.from_responses(entries, spark.createDataFrame([("d", 6)], "document_id string, page_count int"))) == [0, 2]


def test_summaries_bottom_up(spark):
    texts = spark.createDataFrame([("d", "b", "leaf text"), ("d", "a", "own")], "document_id string, node_id string, text string")
    got = {r.node_id: (r.summary, r.summary_method) for r in tree.summarize(_chain(spark), texts, lambda df: df.withColumn("summary", F.concat(F.lit("S:"), "text"))).collect()}
    assert got == {"b": ("leaf text", "passthrough"), "a": ("S:own\nleaf text", "model"), "r": ("S:S:own\nleaf text", "model")}


def test_compaction_rules():
    assert compaction.cut_runs([False, False, True, False]) == [[0, 1], [2], [3]]
    assert compaction.cut_runs([False, False]) == [[0], [1]]
    assert compaction.merge_cheapest([5.0, 1.0, 1.0, 5.0, 1.0], 3) == [[0, 1, 2], [3], [4]]
    assert compaction.merge_cheapest([1.0, 1.0, 1.0, 1.0], 1) == [[0, 1, 2, 3]]


def test_clauses_are_checked(spark):
    for bad in (("a", "in", []), ("a", "gte", True), ("a", "contains", " "), ("a", "like", "x")):
        with pytest.raises(ValueError):
            selection.Clause(*bad)
    with pytest.raises(ValueError, match="a, z"):
        selection.check_fields([selection.Clause("z", "eq", 1), selection.Clause("a", "eq", 1)], ["b"])
    df = spark.createDataFrame([("1", True, 1.0), (None, None, None)], "s string, b boolean, n double")
    count = lambda *c: selection.filter_metadata(df, [selection.Clause(*c)]).count()
    assert [count("s", "eq", 1), count("b", "eq", 1), count("n", "eq", 1), count("n", "eq", None), count("s", "contains", "1")] == [0, 0, 1, 1, 1]


def test_prefilter_golden(spark):
    """A query of two words, one in the description and one in the summary: 0.5 x 2 + 0.5 x 1.5."""
    proxies = spark.createDataFrame([("d", "Name", "an appendix", "some details", ["k"])], "document_id string, display_name string, description string, summary string, keywords array<string>")
    hit = selection.lexical_prefilter(proxies, spark.createDataFrame([(1, "appendix details")], "query_id int, query string")).first()
    assert hit.score == 1.75 and hit.matched_fields == ["description", "summary"]


def test_fillers_follow(spark):
    docs = spark.createDataFrame([("a", "B"), ("b", "a"), ("c", "C")], "document_id string, display_name string")
    hits = spark.createDataFrame([("c", "C", 1.0)], "document_id string, display_name string, score double")
    assert [r.document_id for r in selection.with_fillers(hits, docs, 3).collect()] == ["c", "b", "a"]


def test_preferences_in_order(spark):
    rows = [("p1", "global", "tax law", 1), ("p2", "user", "tax law", 1), ("p3", "user", "tax law", 5), ("p4", "user", "other", 9)]
    got = selection.select_preferences(spark.createDataFrame(rows, "preference_id string, scope string, text string, priority int"), "tax law", 3).collect()
    assert [r.preference_id for r in got] == ["p3", "p2", "p1"]
    assert one(spark, selection.preference_bonus(F.lit("Tax law"), F.lit("tax law"))) == 0.75


def test_rank_fills_up_with_candidates_without_score(spark):
    units = spark.createDataFrame([("d", f"u{k}", k, None, t) for k, t in enumerate(["x", "apple pie", "pie", "z"])], "document_id string, unit_id string, cand_ord int, title string, text string")
    got = search.rank(units, spark.createDataFrame([(1, "Apple pie!")], "query_id int, query string"), 3).orderBy("rank").collect()
    assert [(r.unit_id, r.score) for r in got] == [("u1", 4.0), ("u2", 2.0), ("u0", 0.0)]


def test_answer_modes(spark):
    cols = "intent string, n_hits int, any_lexical boolean, n_authoritative int, n_grounded int, has_visual boolean, cached_visual boolean, has_description boolean, has_summary boolean"
    rows = [("document_summary", 0, False, 0, 0, False, False, False, True), ("topic", 0, False, 0, 0, False, False, False, False), ("topic", 2, False, 1, 1, False, False, False, False), ("topic", 2, True, 1, 1, False, False, False, False), ("table", 2, True, 2, 2, False, False, False, False), ("visual", 1, True, 0, 0, True, True, False, False)]
    got = [r.answer_mode for r in qa.answer_mode(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["document_summary_fallback", "no_hits", "low_evidence", "authoritative_text", "grounded_multi_excerpt", "cached_visual_attachment"]


def test_gateway_retries_and_reports(spark):
    df = spark.createDataFrame([("1", "summarization", "p"), ("2", "tree_search", "p"), ("3", "none", "p")], "request_id string, operation string, payload string").coalesce(1)
    answers = {"summarization": ["!timeout", json.dumps({"summary": "s"})], "tree_search": ["!auth"]}
    got = {r.request_id: (r.failure, r.attempts, r.payload) for r in gateway.invoke(df, lambda: gateway.ScriptedClient(answers), ["summary"], redact=lambda x: "-").collect()}
    assert got == {"1": (None, 2, "-"), "2": ("auth", 1, "-"), "3": ("configuration", 1, "-")}


def test_breaker_opens_and_recovers():
    now = [0.0]
    breaker = gateway.Breaker(lambda: now[0])
    for _ in range(5):
        breaker.note(False)
    assert not breaker.allows()
    now[0] = 31.0
    assert breaker.allows()
    breaker.note(True)
    assert breaker.failures == 0 and breaker.opened is None


def test_runs_are_reserved_once(spark, tmp_path):
    registry = store.RunRegistry(spark, f"file://{tmp_path}/runs")
    assert registry.reserve("tree", "r1", "d", {"digest": store.settings_digest({"b": 1, "a": 2})})[0]
    assert not registry.reserve("tree", "r1", "d", {"digest": store.settings_digest({"a": 2, "b": 1})})[0]
    with pytest.raises(ValueError):
        registry.reserve("tree", "r1", "d", {"digest": "other"})
    assert registry.complete("tree", "r1", "m.json")["status"] == "completed" and registry.read("tree", "r1")["manifest_ref"] == "m.json"


def test_markdown_source_rejects_bad_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A\r\nx\ry")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"x")
    good, bad = store.read_markdown(spark, f"file://{tmp_path}")
    assert [r.text for r in good.collect()] == ["# A\nx\ny"]
    assert sorted(r.reason for r in bad.collect()) == ["not UTF-8", "unsupported source kind"]


def test_event_stream_is_idempotent(spark, tmp_path):
    rows = [("d", f"e{k % 3}", "NodeCommitted", f"2024-01-01 00:0{k}:00") for k in range(6)]
    schema = "document_id string, event_id string, name string, occurred_at timestamp"
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows, "document_id string, event_id string, name string, occurred_at string").coalesce(1).write.json(source)
    log = events.dedupe(events.read_log(spark, source, schema))
    events.append_log(log, out, f"{tmp_path}/check").awaitTermination()
    assert spark.read.schema(schema).json(out).count() == 3
    seen = []
    events.upsert_log(events.read_log(spark, source, schema), lambda batch, epoch: seen.append(batch.count()), f"{tmp_path}/check2").awaitTermination()
    assert seen == [3]


def test_keyed_tables_in_a_folder(spark, tmp_path):
    """Upserts are generations: repeating one changes nothing, one that broke off is not seen."""
    from leafgrove.sources import store

    rows = lambda *x: spark.createDataFrame(list(x), "id int, v int, text string")
    folder = str(tmp_path / "keyed")
    store.write_keyed(rows((1, 1, "a"), (2, 1, "b")), folder, ["id"], "v")
    for _ in range(2):
        got = store.write_keyed(rows((2, 2, "c"), (3, 1, "d"), (1, 0, "old")), folder, ["id"], "v")
        assert sorted(map(tuple, got.collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    (tmp_path / "keyed" / "000009").mkdir()
    assert store.read_keyed(spark, folder).count() == 3
    made = store.artifacts(spark.createDataFrame([("d", "p.txt", "x"), ("d", "q.txt", "y")], "document_id string, path string, content string"), "tree", "r1")
    assert [(r.kind, r.content) for r in store.artifact(made, "tree", "r1", "d", "q.txt").collect()] == [("text", "y")]
    assert store.artifact(made, "tree", "r2", "d", "q.txt").count() == 0


def test_errors_are_translated():
    import pytest

    from leafgrove import errors

    for raised, kind in ((FileNotFoundError("x"), errors.NotFoundError), (OSError("x"), errors.SourceError), (ValueError("run a/b exists with another identity"), errors.ConflictError), (ValueError("x"), errors.RequestError)):
        with pytest.raises(kind) as found, errors.translated("reading"):
            raise raised
        assert found.value.__cause__ is raised


def test_metadata_clauses_of_a_model(spark):
    """Unknown fields and operators are left out; a failed call gives no clauses."""
    import json

    from leafgrove.operators import planning

    def client():
        said = {"clauses": [{"field": "lang", "operator": "eq", "value": "de"}, {"field": "zz", "operator": "eq", "value": "1"}, {"field": "lang", "operator": "like", "value": "1"}]}
        return lambda operation, payload: json.dumps(said) if json.loads(payload)["query"] == "good" else "[]"

    asked = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id int, query string")
    assert [tuple(r) for r in planning.metadata_clauses(asked, ["lang", "source"], client).collect()] == [(1, "lang", "eq", "de")]


def test_words_without_stop_words(spark):
    from pyspark.sql import functions as F

    from leafgrove.functions import text as T

    row = spark.range(1).select(T.tokens(F.lit("The river, AND the stone"), ["the", "and"]).alias("a"), T.tokens(F.lit("ﬁne Straße ς\x1cİ")).alias("b"), T.collapse(F.lit(" a \t b ")).alias("c")).first()
    assert row.a == ["river", "stone"] and row.b == "ﬁne Straße ς İ".casefold().split() and row.c == "a b"


def test_evidence_and_preferences(spark):
    """Page filters, phrases and overlap make evidence; preferences lift a node, and pairs without one are walked without them."""
    from leafgrove.operators import treesearch

    evidence = spark.createDataFrame([("d", "a", "u1", "Title", "green river stones"), ("d", "b", "u2", None, "nothing here"), ("d", "c", "u3", "Old bridge", "x")], "document_id string, node_id string, unit_id string, title string, text string")
    queries = spark.createDataFrame([(1, "river stones"), (2, "the quick brown fox")], "query_id int, query string")
    found = lambda **k: {tuple(r) for r in treesearch.sufficient(evidence, queries, **k).select("query_id", "node_id").collect()}
    assert found() == {(1, "a")}
    assert found(phrases=["OLD bridge"]) == {(1, "a"), (1, "c"), (2, "c")}
    assert found(page=(0, 1)) == {(q, n) for q in (1, 2) for n in "abc"}
    rows = [("d", "r", None, "Root", 1, ["Root"], 0, 9), ("d", "x", "r", "Rivers", 2, ["Root", "Rivers"], 0, 4), ("d", "y", "r", "Stones", 2, ["Root", "Stones"], 5, 9)]
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame(rows, "document_id string, node_id string, parent_id string, title string, level int, path array<string>, start_page int, end_page int").withColumns({"summary": F.lit(""), "keywords": F.col("path")})
    asked = spark.createDataFrame([(1, "rivers stones")], "query_id int, query string")
    snippets = spark.createDataFrame([(7, "stones", "user", 1), (8, "unrelated", "user", 9)], "preference_id int, text string, scope string, priority int")
    bonus = {r.node_id: r.bonus for r in treesearch.preference_bonuses(nodes, asked, snippets).collect()}
    assert bonus == {"y": 0.75}
    best = treesearch.search_preferred(nodes, asked, snippets).candidates.orderBy(F.desc("score")).collect()
    assert [(r.node_id, r.score) for r in best] == [("y", 2.25), ("x", 1.5)]
    assert treesearch.search_preferred(nodes, asked, snippets.limit(0)).candidates.count() == 2
