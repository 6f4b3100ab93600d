"""From files to answers through the facade."""

from leafgrove.engine import Engine
from leafgrove.sources import pdf, store


def test_ingest_search_ask(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Apples\n\nApples grow on trees.\n\n# Pears\n\nPears are green.\n")
    (tmp_path / "b.md").write_text("Ships sail the sea.\n")
    good, bad = store.read_markdown(spark, f"file://{tmp_path}/*.md")
    engine = Engine(spark, f"file://{tmp_path}/root")
    pages = engine.ingest(good, "r1")
    assert pages.count() == 2 and bad.count() == 0
    assert engine.ingest(good.limit(0), "r1").count() == 2  # the run is reused
    answers = engine.ask(engine.units(pages), spark.createDataFrame([(1, "green pears")], "query_id int, query string"), 1).collect()
    assert [a.answer for a in answers] == ["Pears are green."]
    assert answers[0].citations[0].citation.page_label == "1"


def test_pdf_files_fail_apart(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-broken")
    rows = pdf.read_pdf_pages(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 1 and rows[0].error and rows[0].text is None
