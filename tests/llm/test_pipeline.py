"""The pipeline's stages on one small scale, each against a brute-force version of what it decides."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from leafgrove.llm import toxicity  # noqa: E402
from tests.llm.test_operators import brute_groups, brute_lines  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "line_dedup", "ngram_join", "packing"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        assert kept[-1].columns == docs.columns
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert texts[1] == {k: t for k, t in texts[0].items() if model.score(model.features(*model.found(t))) < 0.5}
    assert all(len([w for w in re.split("[\x20\x09-\x0d]+", t) if w]) >= 20 for t in texts[2].values())
    assert texts[3] == brute_lines(texts[2])
    groups = brute_groups(texts[3], 5, 80)
    assert texts[4] == {k: t for k, t in texts[3].items() if groups[k][1] == k}
    corpus_pipeline.STAGES[4][1](spark, kept[4], SF).write.parquet(f"{tmp_path}/packing")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = spark.read.parquet(f"{tmp_path}/packing")
    total = {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts[4].items()}
    got = {r.doc_id: (r.n, r.t) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert got == {k: (n, n) for k, n in total.items()}
    sequences = {}
    for r in pieces.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0


def test_stages_on_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 0


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, _: d.limit(3)), ("b", lambda s, d, _: d)])
    assert corpus_pipeline.run(spark, SF).count() == 3
    assert [p.name for p in tmp_path.glob("leafgrove/*/*")] == ["1-b"]


@pytest.mark.parametrize("name", ["op3_url_reputation", "op8_host_quality", "op9_ngram_join", "op10_embedding_dedup"])
def test_queries_against_sql(spark, name):
    import os

    import duckdb

    from leafgrove.llm import registry
    from tests.test_queries import rows

    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got, want = registry.QUERIES[name](spark, SF).toArrow().to_pydict(), con.sql(registry.ORACLE_SQL[name]).to_arrow_table().to_pydict()
    assert sorted(got) == sorted(want) and rows(got) == rows(want)


def test_stages_send_small_batches_to_workers(spark, monkeypatch):
    """Each stage runs with them; the setting is as before at the end."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key, None)
    stage = lambda spark, docs, sf_dir: seen.append(int(spark.conf.get(key, "10000"))) or docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(seen) == 2 and max(seen) <= 2000 and spark.conf.get(key, None) == before
