import json
import os

import pytest

from rankloom import cli
from rankloom.operators.bm25 import BM25Retriever
from rankloom.operators.chunking import FixedSizeChunker
from rankloom.plans import harness, service
from rankloom.plans.engine import Engine
from rankloom.plans.setups import (
    AblationCell,
    RetrievalSetup,
    SharedIndexes,
    ablation_grid,
    default_setups,
    make_setup,
)
from rankloom.runtime import materialize, new_table_path, scratch_dir, scratch_scope, write_alone, write_bucketed


def left_behind(spark):
    """What lies in the application's scratch folder, and the tables of its catalog."""
    folder = scratch_dir(spark).removeprefix("file:")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else [], sorted(t.name for t in spark.catalog.listTables())


def test_scope_drops_its_tables(spark):
    before = left_behind(spark)
    with scratch_scope(spark) as outer:
        rows = materialize(spark.range(9).selectExpr("id", "id % 3 AS k"), "rows")
        table = write_bucketed(rows, new_table_path(spark, "table"), "k", 2, ["id"])
        with scratch_scope(spark) as inner:
            assert inner.folder.startswith(outer.folder) and materialize(rows, "more").count() == 9
            assert len(os.listdir(inner.folder.removeprefix("file:"))) == 1
        assert not os.path.exists(inner.folder.removeprefix("file:"))
        assert table.count() == 9 and left_behind(spark) != before
    assert left_behind(spark) == before
    with pytest.raises(ValueError), scratch_scope(spark):
        materialize(rows.sparkSession.range(2), "rows")
        raise ValueError
    assert left_behind(spark) == before


def test_write_alone_keeps_only_the_result(spark):
    with scratch_scope(spark) as scope:
        path, rows = write_alone(spark, "result", lambda: materialize(materialize(spark.range(5), "a"), "b").selectExpr("id * 2 AS x"))
        assert sorted(r["x"] for r in rows.collect()) == [0, 2, 4, 6, 8]
        assert [f"{scope.folder}/{name}" for name in os.listdir(scope.folder.removeprefix("file:"))] == [path]


def test_registered_setups():
    assert [s.name for s in default_setups()] == [
        "bm25_fixed", "dense_fixed", "hybrid_rrf_fixed", "hybrid_rrf_fixed_rerank", "hybrid_rrf_sentwin", "bm25_rm3_fixed"]
    labels = [c.label for c in ablation_grid()]
    assert len(labels) == len(set(labels)) == 12 and "dense_sentwin+rerank" in labels
    with pytest.raises(ValueError, match="nope"):
        harness.select_setups(["nope"])


def test_setups_share_indexes(documents):
    shared = SharedIndexes(documents)
    a = make_setup("a", "fixed", "bm25").build(documents, shared)
    b = make_setup("b", "fixed", "hybrid_rrf").build(documents, shared)
    assert a.retriever.tables is b.retriever.retrievers[0].tables and a.chunks is b.chunks


def test_rerank_keeps_five_of_thirty(spark, documents, questions):
    built = RetrievalSetup("r", FixedSizeChunker(6, 3), BM25Retriever, use_rerank=True).build(documents)
    run = built.search(questions, k=10, rerank_top_k=5)
    assert run.groupBy("qid").count().agg({"count": "max"}).first()[0] <= 5
    assert {r["retriever"] for r in run.collect()} == {"rerank(bm25)"}


def test_harness_skips_failing_setups_and_writes_reports(spark, documents, questions, tmp_path, capsys):
    class Broken(BM25Retriever):
        def _build(self, chunks):
            raise OSError("disk on fire")

    setups = [RetrievalSetup("broken", FixedSizeChunker(), Broken), make_setup("bm25_fixed", "fixed", "bm25"),
              make_setup("dense_fixed", "fixed", "dense")]
    before = left_behind(spark)
    out = harness.run_harness(documents, questions, str(tmp_path), setups=setups)
    assert left_behind(spark) == before
    report = json.loads((tmp_path / "results.json").read_text())
    assert report["metadata"]["pipelines_completed"] == ["bm25_fixed", "dense_fixed"]
    assert report["pipelines"]["bm25_fixed"]["n_queries"] == 6
    assert set(out["comparisons"]) == {"dense_fixed"} and out["comparisons"]["dense_fixed"]["n"] == 6
    assert "`dense_fixed`" in (tmp_path / "RESULTS.md").read_text()
    assert "bm25_fixed" in capsys.readouterr().out
    with pytest.raises(RuntimeError):
        harness.run_harness(documents, questions, str(tmp_path), setups=setups[:1])


def test_ablation(spark, documents, questions, tmp_path):
    grid = [AblationCell("bm25_fixed", "fixed", "bm25", False), AblationCell("bm25_sentwin+rerank", "sentwin", "bm25", True)]
    before = left_behind(spark)
    ranked = harness.run_ablation(spark, documents, questions, str(tmp_path), grid).collect()
    assert left_behind(spark) == before
    assert len(ranked) == 2 and ranked[0]["ndcg5_mean"] >= ranked[1]["ndcg5_mean"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/ablation.csv").count() == 2
    assert "bm25_sentwin+rerank" in (tmp_path / "ABLATION.md").read_text()


@pytest.fixture(scope="module")
def engine(spark, documents):
    return Engine(spark, corpus=documents)


def test_engine(spark, questions, engine):
    hits = engine.search("Where do salmon swim?", 2).orderBy("rank").collect()
    assert hits[0]["doc_id"] == "river" and hits[0]["retriever"] == "rerank(hybrid_rrf)"
    chunks = engine.chunks
    assert engine.load(use_rerank=False).chunks is chunks
    assert engine.search("salmon", 1).first()["retriever"] == "hybrid_rrf"
    answers = engine.load().ask(questions, 2, score_faithfulness=True)
    assert answers.count() == 6
    assert all(0.0 <= r["faithfulness"] <= 1.0 and r["latency_ms"] > 0 for r in answers.collect())


def test_service(spark, engine):
    def source():
        return engine

    def missing():
        raise FileNotFoundError

    engine.load()
    before = left_behind(spark)
    assert service.root()[0] == 200
    assert service.health(source)[1] == {"status": "ok", "corpus_loaded": True}
    assert service.health(missing)[1]["corpus_loaded"] is False
    status, body = service.search({"query": "red stars", "k": 2}, source)
    assert status == 200 and len(body["results"]) == 2 and body["results"][0]["doc_id"] == "stars"
    status, body = service.ask({"query": "What makes dough rise?", "faithfulness": True}, source)
    assert status == 200 and "dough" in body["text"] and body["faithfulness"] is not None
    assert left_behind(spark) == before
    for bad in ({}, {"query": ""}, {"query": "x", "k": 101}, {"query": "x", "k": True}):
        assert service.search(bad, source)[0] == 422
    assert service.ask({"query": "x", "k": 51}, source)[0] == 422
    assert service.search({"query": "x"}, missing)[0] == 503


def test_cli(spark, tmp_path, monkeypatch, capsys):
    from rankloom.config import get_config

    monkeypatch.setenv("RANKLOOM_DATA_DIR", str(tmp_path))
    get_config.cache_clear()
    try:
        assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
        assert cli.main(["version"]) == 0
        assert cli.main(["search", "tides"]) == 1
        assert cli.main(["build-dataset"]) == 0
        capsys.readouterr()
        assert cli.main(["info"]) == 0 and "7 rows" in capsys.readouterr().out
        assert cli.main(["search", "spring tides", "-k", "2", "--no-rerank"]) == 0
        assert len(capsys.readouterr().out.strip().splitlines()) == 2
        assert cli.main(["ask", "What makes dough rise?", "--faithfulness"]) == 0
        out = capsys.readouterr().out
        assert "dough" in out and "faithfulness" in out
        assert cli.main(["evaluate", "--setups", "bm25_fixed", "--max-questions", "3", "--out", str(tmp_path / "r")]) == 0
    finally:
        get_config.cache_clear()
