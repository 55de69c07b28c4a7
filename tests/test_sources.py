import json

import pytest
from pyspark.sql import functions as F

from rankloom.config import EngineConfig, config_from_env
from rankloom.runtime import scratch_dir
from rankloom.sources import dataset, jsonl, reports


def write(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return path


def test_corpus(spark, tmp_path):
    path = write(tmp_path / "corpus.jsonl",
                 json.dumps({"doc_id": "a", "title": "T", "text": "é", "source": "s", "metadata": {"k": "v"}}), "", "   ",
                 json.dumps({"doc_id": "b", "text": "x"}))
    rows = {r["doc_id"]: r for r in jsonl.load_corpus(spark, tmp_path).collect()}
    assert rows["a"]["metadata"] == {"k": "v"} and rows["a"]["text"] == "é"
    assert (rows["b"]["title"], rows["b"]["source"], rows["b"]["metadata"]) == ("", "", {})
    assert jsonl.count_records(spark, path) == 2


@pytest.mark.parametrize("line", ['{"doc_id": "a"', '{"doc_id": "a"}', '{"text": "t"}'])
def test_broken_or_incomplete_lines_raise(spark, tmp_path, line):
    write(tmp_path / "corpus.jsonl", line)
    with pytest.raises(Exception, match="(?i)malformed|missing"):
        jsonl.load_corpus(spark, tmp_path).collect()


def test_broken_line_is_named_and_places_count_blank_lines(spark, tmp_path, monkeypatch):
    path = tmp_path / "corpus.jsonl"
    good = [json.dumps({"doc_id": f"d{i:03d}", "text": "x" * 300}) for i in range(200)]
    write(path, "", *good[:100], " ", *good[100:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = jsonl.load_corpus(spark, tmp_path).orderBy("src_pos").collect()
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 4  # the file was split
        write(path, *good[:150], "{broken", *good[150:])
        with pytest.raises(Exception, match=r"corpus\.jsonl:151: malformed"):
            jsonl.load_corpus(spark, tmp_path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["doc_id"] for r in rows] == [f"d{i:03d}" for i in range(200)]
    assert [int(r["src_pos"].rsplit(":", 1)[1]) for r in rows] == [i + 2 + (i >= 100) for i in range(200)]


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="build"):
        jsonl.load_corpus(spark, tmp_path / "no" / "corpus.jsonl")


def test_questions_and_prefix(spark, tmp_path):
    write(tmp_path / "qa.jsonl", *[json.dumps(
        {"qid": f"q{9 - i}", "question": "?", "answer": "!", "relevant_doc_ids": ["x", "y", "x"][:i]}) for i in range(4)])
    questions = jsonl.load_questions(spark, tmp_path)
    assert [r["qid"] for r in jsonl.first_questions(questions, 2).collect()] == ["q9", "q8"]
    assert jsonl.first_questions(questions, None).count() == 4
    qrels = sorted(tuple(r) for r in jsonl.qrels_of(questions).collect())
    assert qrels == [("q6", "x"), ("q6", "y"), ("q7", "x"), ("q7", "y"), ("q8", "x")]


def test_resolve_path():
    assert jsonl.resolve_path("d", "f.jsonl") == "d/f.jsonl"
    assert jsonl.resolve_path("d/x.jsonl", "f.jsonl") == "d/x.jsonl"
    assert jsonl.resolve_path(None, "f.jsonl") == f"{EngineConfig().data_dir}/f.jsonl"


def test_the_file_system_decides(spark, tmp_path):
    (tmp_path / "plain").write_text("{}")
    (tmp_path / "folder.json").mkdir()
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "part-0").write_text("{}")
    for name, want in (("plain", "plain"), ("folder.json", "folder.json/f.jsonl"), ("parts", "parts"), ("none", "none/f.jsonl")):
        assert jsonl.resolve_path(tmp_path / name, "f.jsonl", spark) == f"{tmp_path}/{want}"


@pytest.fixture(scope="module")
def rows(spark):
    contexts = ["c0", "c1", "c0", "c2", "c1", "c0", "c3"]
    data = [(i, f"id{i}", f"t{c}", c, f"q{i}?", [f"a{i}"] if i else []) for i, c in enumerate(contexts)]
    return spark.createDataFrame(data, "src_pos int, id string, title string, context string, question string, answers array<string>")


def test_build_keeps_first_documents_and_their_questions(spark, rows, tmp_path):
    documents, questions = dataset.build_from_rows(rows, n_docs=2, n_questions=4)
    assert [r["text"] for r in documents.orderBy("src_pos").collect()] == ["c0", "c1"]
    asked = questions.orderBy("src_pos").collect()
    assert [r["qid"] for r in asked] == ["id0", "id1", "id2", "id4"] and asked[0]["answer"] == ""
    summary = dataset.build_dataset(spark, tmp_path, rows, n_docs=3)
    assert summary == {"n_docs": 3, "n_questions": 6, "mean_chars": 2.0}
    assert dataset.build_dataset(spark, tmp_path, rows) is None  # already there
    assert jsonl.load_corpus(spark, tmp_path).count() == 3
    assert jsonl.load_questions(spark, tmp_path).filter(F.size("relevant_doc_ids") == 1).count() == 6


def test_build_falls_back_to_the_sample(spark, tmp_path):
    summary = dataset.build_dataset(spark, tmp_path, None)
    assert summary["n_docs"] == len(dataset.SAMPLE_DOCUMENTS)
    stray = spark.createDataFrame([("q", "?", "", "No such title")], "qid string, question string, answer string, title string")
    docs = spark.createDataFrame([("d1", "T", 0), ("d2", "T", 1)], "doc_id string, title string, src_pos int")
    assert dataset.link_by_title(stray, docs).first()["relevant_doc_ids"] == []
    assert dataset.link_by_title(stray.withColumn("title", F.lit("T")), docs).first()["relevant_doc_ids"] == ["d2"]


def test_formats():
    assert reports.format_ci(0.8124, 0.79, 0.83) == "0.812 [0.790, 0.830]"
    assert reports.format_latency(1.26) == "1.3 ms"
    assert [reports.significance(p) for p in (0.001, 0.03, 0.2)] == ["**", "*", ""]


def test_results_round_trip(spark, tmp_path):
    results = {"s": {"summary": {"mrr": {"mean": 0.5, "ci_lo": 0.4, "ci_hi": 0.6}}, "latency": {}, "n_queries": 3, "per_query": 1}}
    path = reports.write_results_json(tmp_path / "r" / "results.json", results, {}, {"k": 10})
    assert "per_query" not in path.read_text()
    assert [tuple(r) for r in reports.read_results(spark, path).collect()] == [("s", "mrr", 0.5, 0.4, 0.6)]
    assert reports.read_results(spark, write(tmp_path / "bad.json", "{")).count() == 0


def test_charts(spark):
    table = spark.createDataFrame([("a", 0.5, 0.6, 0.7, 3.0), ("b", 0.9, 0.8, 1.0, 4.0)],
                                  "label string, ndcg5_mean double, ndcg5_lo double, ndcg5_hi double, p50_ms double")
    bars = reports.ndcg_chart(table).collect()
    assert [b["label"] for b in bars] == ["b", "a"] and bars[1]["err_lo"] == 0.0
    assert reports.latency_quality_chart(table).columns == ["label", "p50_ms", "ndcg5_mean"]


def test_config(tmp_path):
    env = write(tmp_path / ".env", "# comment", "RANKLOOM_TOP_K=7", "OTHER=1", "RANKLOOM_GENERATION_ENABLED=true")
    config = config_from_env({"RANKLOOM_RRF_K": "30", "RANKLOOM_GENERATION_API_KEY": "abcdefghij"}, str(env))
    assert (config.top_k, config.rrf_k, config.generation_enabled) == (7, 30, True)
    assert config.masked_key() == "abcdef****" and EngineConfig().masked_key() == "(not set)"
    for bad in ({"top_k": 0}, {"hybrid_alpha": 1.5}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_scratch_folder_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or scratch_dir(spark).startswith(configured)
