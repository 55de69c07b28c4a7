import pytest
from pyspark.sql import functions as F

from rankloom.config import EngineConfig
from rankloom.operators import answers as an
from rankloom.operators import faithfulness as fa
from rankloom.operators.alignment import aligned_weight, alignment_nli

EVIDENCE = ("qid string, rank int, chunk_id string, doc_id string, score double, retriever string, text string")


def evidence_of(spark, *texts, qid="q"):
    return spark.createDataFrame([(qid, i, f"c{i}", "d", 1.0, "stub", t) for i, t in enumerate(texts, 1)], EVIDENCE)


@pytest.fixture()
def query(spark):
    return spark.createDataFrame([("q", "red fox jumps"), ("none", "lost")], "qid string, question string")


def test_extractive_picks_overlap_then_order(spark, query):
    evidence = evidence_of(spark, "Nothing here. A red fox sleeps.", "Red fox jumps. Nothing there.")
    answers = {r["qid"]: r for r in an.ExtractiveAnswerer(2).answer(query, evidence).collect()}
    assert answers["q"]["text"] == "Red fox jumps. A red fox sleeps."
    assert [c["chunk_id"] for c in answers["q"]["supporting_chunks"]] == ["c1", "c2"]
    assert answers["none"]["text"] == "" and answers["none"]["supporting_chunks"] == []
    assert answers["q"]["generator"] == "extractive" and answers["q"]["faithfulness"] is None


def test_sentences_without_overlap_are_still_returned(spark, query):
    evidence = evidence_of(spark, "One two. Three four. Five six.")
    assert an.ExtractiveAnswerer(1).answer(query, evidence).filter("qid = 'q'").first()["text"] == "One two."
    with pytest.raises(ValueError):
        an.ExtractiveAnswerer(0)


@pytest.mark.parametrize(("texts", "premise"), [
    (["a" * 2000, "b"], "a" * 2000),  # the first passage is never cut
    (["a" * 700, " ", "b" * 700, "c" * 300], "a" * 700 + " " + "b" * 700 + " " + "c" * 98),
    (["a" * 1490, "b" * 50], "a" * 1490),  # the room left is too little to use
    (["x", "y"], "x y"), ([" ", "\n"], "")])
def test_premise(spark, texts, premise):
    assert fa.premises(evidence_of(spark, *texts)).first()["premise"] == premise


def test_context_block(spark):
    texts = ["a" * 3000, " ", "b" * 990, "c" * 5000, "d"]
    got = an.context_blocks(evidence_of(spark, *texts)).first()["context"]
    assert got == "\n".join(["[1] " + "a" * 3000, "[2] ", ] + ([] if 3005 + 5 + 994 > 4000 else ["[3] " + "b" * 990]))
    assert an.context_blocks(evidence_of(spark, "z" * 9000, "y")).first()["context"] == "[1] " + "z" * 9000


def answers_of(spark, text, qid="q"):
    return spark.createDataFrame([(qid, text)], "qid string, text string")


def test_faithfulness_means_over_sentences(spark):
    def load():
        return lambda pairs: [[0.0, 50.0, 0.0] if "yes" in s else [50.0, 0.0, 0.0] for _, s in pairs]

    scorer = fa.FaithfulnessScorer(fa.model_nli(load))
    evidence = evidence_of(spark, "Some premise.")
    assert scorer.score(answers_of(spark, "It is yes. It is nope."), evidence).first()["faithfulness"] == pytest.approx(0.5)
    assert scorer.score(answers_of(spark, ""), evidence).first()["faithfulness"] == 0.0
    assert scorer.score(answers_of(spark, "Yes.", "other"), evidence).first()["faithfulness"] == 0.0


def test_failing_model_leaves_no_score(spark):
    def load():
        def model(pairs):
            raise OSError("no weights")
        return model

    scorer = fa.FaithfulnessScorer(fa.model_nli(load))
    got = scorer.score(answers_of(spark, "A b."), evidence_of(spark, "c"))
    assert got.first()["faithfulness"] is None
    assert tuple(scorer.failures(got).first()) == (1, 1)
    assert scorer.score(answers_of(spark, ""), evidence_of(spark, "c")).first()["faithfulness"] == 0.0


def test_model_loads_once_a_task_and_one_failure_stays_alone(spark, tmp_path):
    def load():
        with (tmp_path / "loads").open("a") as f:
            f.write("x")

        def model(pairs):
            if any("bad" in s for _, s in pairs):
                raise OSError("cannot score")
            return [[0.0, 0.0, 9.0] for _ in pairs]
        return model

    rows = spark.createDataFrame([("p", ["bad one."]), ("p", ["fine.", "good."]), ("p", [])] * 3, "p string, s array<string>").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [r[0] for r in rows.select(fa.model_nli(load)("p", "s")).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [None, [[0.0, 0.0, 9.0]] * 2, []] * 3
    assert (tmp_path / "loads").read_text() == "x"


def test_overlap_entailment(spark):
    scorer = fa.FaithfulnessScorer()
    evidence = evidence_of(spark, "Red fox jumps over.")
    full = scorer.score(answers_of(spark, "Fox jumps."), evidence).first()["faithfulness"]
    none = scorer.score(answers_of(spark, "Blue whale."), evidence).first()["faithfulness"]
    equal = scorer.score(answers_of(spark, "?!."), evidence).first()["faithfulness"]
    assert full > 0.99 and none < 0.01 and equal == pytest.approx(1 / 3)


LABELS = ("contradiction", "entailment", "neutral")


@pytest.mark.parametrize(("premise", "sentence", "label"), [
    ("The old bridge was built in 1890. It spans the river.", "The bridge was built in 1890.", "entailment"),
    ("The old bridge was built in 1890. It spans the river.", "The bridge was built in 1790.", "contradiction"),
    ("The old bridge was built in 1890. It spans the river.", "The bridge was not built in 1890.", "contradiction"),
    ("The old bridge wasn't built in 1890.", "The bridge was built in 1890.", "contradiction"),
    ("It isn't true that nobody came.", "It is true that people came.", "entailment"),
    ("The old bridge spans the river.", "Copper prices fell sharply yesterday.", "neutral"),
    ("The dog chased the small cat away.", "Away cat small the dog.", "neutral"),
    ("No ship came. The harbour stayed open.", "The harbour stayed open.", "entailment"),
])
def test_alignment_labels(spark, premise, sentence, label):
    rows = spark.createDataFrame([(premise, [sentence])], "p string, s array<string>")
    logits = rows.select(alignment_nli(F.col("p"), F.col("s"))).first()[0][0]
    assert LABELS[logits.index(max(logits))] == label


def test_alignment_is_the_heaviest_common_subsequence(spark):
    import random
    draw = random.Random(3)
    rows = [([(draw.choice("abcd"), draw.choice([0.5, 1.0, 2.5])) for _ in range(draw.randrange(7))],
             [draw.choice("abcde") for _ in range(draw.randrange(9))]) for _ in range(120)]

    def heaviest(items, words):
        if not items or not words:
            return 0.0
        skip = max(heaviest(items[1:], words), heaviest(items, words[1:]))
        return max(skip, items[0][1] + heaviest(items[1:], words[1:])) if items[0][0] == words[0] else skip

    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h array<struct<word: string, weight: double>>, p array<string>")
    got = frame.select("i", aligned_weight(F.col("h"), F.col("p")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: heaviest(*r) for i, r in enumerate(rows)}


def test_alignment_edges(spark):
    rows = spark.createDataFrame([("", ["a b."]), ("?!", ["a b."]), ("a b.", []), ("a b.", ["...", "a b."]), (None, ["a"]), ("a", None)],
                                 "p string, s array<string>")
    got = [r[0] for r in rows.select(alignment_nli(F.col("p"), F.col("s"))).collect()]
    assert [g and len(g) for g in got] == [1, 1, [], 2, got[4] and 1, None]
    assert got[0][0][1] < -10 and got[1][0][1] < -10 and got[3][0] == [0.0, 0.0, 0.0] and got[3][1][1] > 10


def test_generation_switches(spark, query):
    evidence = evidence_of(spark, "Fact.")
    off = EngineConfig()
    on = EngineConfig(generation_enabled=True, generation_api_key="k" * 8, generation_model="m")
    assert isinstance(an.get_answerer(off), an.ExtractiveAnswerer)
    assert isinstance(an.get_answerer(EngineConfig(generation_enabled=True)), an.ExtractiveAnswerer)

    def load():
        return lambda system, prompt, limit, model: f" {model}/{limit}: {prompt.splitlines()[0]} "

    answers = an.get_answerer(on, load).answer(query, evidence).filter("qid = 'q'").first()
    assert answers["text"] == "m/300: [1] Fact." and answers["generator"] == "generated"
    for config in (off, EngineConfig(generation_enabled=True), on):
        with pytest.raises(RuntimeError):
            an.GeneratedAnswerer(None, config).answer(query, evidence)
