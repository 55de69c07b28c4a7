from hashlib import md5
import hashlib
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import metrics as mt
from rankloom.operators import resampling as rs
from rankloom.plans.evaluation import compare_runs, evaluate_run

RUN = "qid string, rank int, chunk_id string, doc_id string, score double"


def run_of(spark, **lists):
    rows = [(q, i, f"{d}_{i}", d, 1.0 - i / 10) for q, docs in lists.items() for i, d in enumerate(docs, 1)]
    return spark.createDataFrame(rows, RUN)


def qrels_of(spark, **sets):
    return spark.createDataFrame([(q, d) for q, docs in sets.items() for d in docs], "qid string, doc_id string")


def ids(spark, *qids):
    return spark.createDataFrame([(q,) for q in qids], "qid string")


@pytest.fixture(scope="module")
def golden(spark):
    run = run_of(spark, q="ABACD", miss="XY", unjudged="A")
    per_query = mt.per_query_metrics(run, ids(spark, "q", "miss", "unjudged", "empty"),
                                     qrels_of(spark, q="ACC", miss="A", empty="A"), (1, 2, 3, 4, 5, 0))
    return {r["qid"]: r.asDict() for r in per_query.collect()}


def test_hand_values(golden):
    q = golden["q"]
    assert [q[f"recall@{k}"] for k in (1, 2, 3)] == [0.5, 0.5, 1.0]
    assert [q[f"precision@{k}"] for k in (1, 2, 3, 4, 5)] == pytest.approx([1, 0.5, 2 / 3, 0.5, 0.4])
    assert q["mrr"] == 1.0 and q["hit_rate@1"] == 1.0
    assert q["ndcg@3"] == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert q["map"] == pytest.approx((1 + 2 / 3) / 2)


def test_every_question_has_a_row_of_zeros_when_nothing_counts(golden):
    for qid in ("miss", "unjudged", "empty"):
        assert all(v == 0.0 for k, v in golden[qid].items() if k != "qid")
    assert golden["q"]["recall@0"] == 0.0


def test_summarize(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    row = mt.summarize(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert tuple(row) == pytest.approx((np.mean(values), np.std(values), np.percentile(values, 50), np.percentile(values, 95)))
    assert tuple(mt.summarize(spark.createDataFrame([], "v double"), "v").first()) == (0.0, 0.0, 0.0, 0.0)


def test_percentiles_without_a_group_buffer(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501), "b": np.round(rng.random(40), 1), "c": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in mt.summarize(df, "v", ["g"]).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx((vs.mean(), vs.std(), np.percentile(vs, 50), np.percentile(vs, 95)))
    whole = np.concatenate(list(groups.values()))
    assert mt.summarize(df, "v").first()["p95"] == pytest.approx(np.percentile(whole, 95))


def values_of(spark, values):
    return spark.createDataFrame([(f"q{i:05d}", float(v)) for i, v in enumerate(values)], "qid string, value double")


def words_of(label, block, key):
    digest = hashlib.md5(f"42|{label}|{block}|{key}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def poisson_of(word):
    """The Poisson(1) number at a uniform word, by summing probabilities."""
    k, cumulative = 0, math.exp(-1)
    while word >= math.floor(2 ** 32 * cumulative):
        k += 1
        cumulative += math.exp(-1) / math.factorial(k)
    return k


def expected_interval(keyed, n=2000):
    values = np.array([v for _, v in keyed])
    weights = np.array([[poisson_of(w) for block in range(n // 4) for w in words_of("bootstrap", block, key)] for key, _ in keyed])
    means = np.array([np.average(values, weights=w) if w.any() else values.mean() for w in weights.T])
    return values.mean(), np.percentile(means, 2.5), np.percentile(means, 97.5)


def test_bootstrap_equals_hash_draws(spark):
    values = np.random.default_rng(3).random(37)
    expected = expected_interval([(f"q{i:05d}", v) for i, v in enumerate(values)])
    assert tuple(rs.bootstrap_ci(values_of(spark, values)).first()) == pytest.approx(expected, abs=1e-12)
    # close to what resampling with replacement gives
    draws = values[np.random.default_rng(42).integers(0, 37, size=(2000, 37))].mean(axis=1)
    assert expected[1:] == pytest.approx((np.percentile(draws, 2.5), np.percentile(draws, 97.5)), abs=0.02)


def test_bootstrap_edges(spark):
    assert tuple(rs.bootstrap_ci(values_of(spark, [0.5] * 5)).first()) == pytest.approx((0.5, 0.5, 0.5))
    assert tuple(rs.bootstrap_ci(values_of(spark, [])).first()) == (0.0, 0.0, 0.0)


def test_draws_do_not_depend_on_size_or_partitioning(spark):
    """One rule at every size: a value that is already there keeps its draws when others come or tasks change."""
    frame = values_of(spark, np.random.default_rng(5).random(600))
    whole = rs.bootstrap_ci(frame).first()
    assert tuple(rs.bootstrap_ci(frame.repartition(7)).first()) == pytest.approx(tuple(whole), abs=1e-12)
    # A key's draws are its own: the same first draws however many are asked, each a Poisson weight or a sign from its word.
    words = [int(md5(f"42|bootstrap|{b}|q00003".encode()).hexdigest()[8 * k:8 * k + 8], 16) for b in range(2) for k in range(4)]
    assert rs.poisson_weights("q00003", 8, 42).tolist() == [sum(w >= step for step in rs.POISSON_STEPS) for w in words]
    assert (rs.poisson_weights("q00003", 2000, 42)[:6] == rs.poisson_weights("q00003", 6, 42)).all()
    word = int(md5(b"42|permutation|0|q00003").hexdigest()[8:16], 16)
    assert rs.sign_bits("q00003", 70, 42)[32:64].tolist() == [2 * (word >> bit & 1) - 1 for bit in range(32)]


def test_many_groups_are_handed_on(spark, monkeypatch):
    rows = [(f"g{i % 300}", f"q{i}", float(i % 7)) for i in range(900)] + [(None, "q1", 3.0), (None, "q2", None)]
    frame = spark.createDataFrame(rows, "g string, qid string, value double").repartition(2)
    got = {r["g"]: r["mean"] for r in rs.bootstrap_ci(frame, ["g"], n_resamples=20).collect()}
    assert len(got) == 301 and got[None] == 3.0 and got["g5"] == pytest.approx(np.mean([v for g, _, v in rows if g == "g5"]))


def test_null_groups_and_missing_values(spark):
    rows = [(None, "a", 1.0), (None, "b", 3.0), ("g", "a", 2.0), ("g", "b", None)]
    got = {r["g"]: tuple(r)[1:] for r in rs.bootstrap_ci(
        spark.createDataFrame(rows, "g string, qid string, value double"), ["g"]).collect()}
    assert got["g"] == (2.0, 2.0, 2.0) and got[None] == pytest.approx(expected_interval([("a", 1.0), ("b", 3.0)]))


def test_permutation_equals_hash_signs(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random(25), rng.random(25) * 0.9
    bits = np.array([[w >> bit & 1 for block in range(79) for w in words_of("permutation", block, f"q{i:05d}") for bit in range(32)]
                     for i in range(25)])[:, :10_000]
    flipped = ((2 * bits - 1) * (a - b)[:, None]).mean(axis=0)
    expected = max(np.mean(np.abs(flipped) >= abs((a - b).mean()) - 1e-12), 1e-4)
    pairs = values_of(spark, a).withColumnRenamed("value", "a").join(values_of(spark, b).withColumnRenamed("value", "b"), "qid")
    row = rs.paired_permutation(pairs).first()
    assert row["p_value"] == pytest.approx(expected, abs=1e-12) and row["n"] == 25
    signs = 2 * np.random.default_rng(42).integers(0, 2, size=(10_000, 25), dtype=np.int8) - 1
    assert row["p_value"] == pytest.approx(np.mean(np.abs((signs * (a - b)).mean(axis=1)) >= abs((a - b).mean())), abs=0.03)


def test_permutation_floor_and_identity(spark):
    pairs = spark.createDataFrame([(f"q{i}", 1.0, 0.0, 0.5) for i in range(30)], "qid string, a double, b double, c double")
    assert rs.paired_permutation(pairs).first()["p_value"] == 1e-4
    assert rs.paired_permutation(pairs, b="a").first()["p_value"] == 1.0
    for other in (pairs.limit(3), pairs.limit(0)):
        with pytest.raises(ValueError):
            rs.require_pairs(pairs, other)


def test_evaluate_and_compare(spark):
    questions = ids(spark, "q1", "q2", "q3")
    qrels = qrels_of(spark, q1="A", q2="B", q3="C")
    submitted = spark.createDataFrame([("q1", 20.0), ("q2", 40.0), ("ghost", 999.0)], "qid string, latency_ms double")
    with pytest.warns(UserWarning, match="ghost"):
        good = evaluate_run(run_of(spark, q1="A", q2="B", ghost="A"), questions, qrels, submitted=submitted)
    assert good.n_queries == 2 and good.latency["mean_ms"] == 30.0
    assert good.summary_dict()["ndcg@5"] == {"mean": 1.0, "ci_lo": 1.0, "ci_hi": 1.0}
    assert len(good.summary_dict()) == 18
    bad = evaluate_run(run_of(spark, q1="X", q2="X"), questions, qrels)
    assert bad.n_queries == 3
    result = compare_runs(good.per_query, bad.per_query, "ndcg@5")
    assert result["delta"] == 1.0 and result["n"] == 2
    assert compare_runs(good.per_query, bad.per_query, "unknown")["delta"] == 0.0
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        lone = compare_runs(good.per_query.filter(F.col("qid") == "q1"), bad.per_query, "mrr")
    assert lone == {"delta": 1.0, "p_value": 1.0, "n": 1} and caught


def test_bootstrap_draws_by_file_position(spark):
    found = [1, 0, 1, 1, 0, 0, 1]
    rows = [(f"q{9 - i}", i) for i in range(len(found))]  # ids sort against the file order
    questions = spark.createDataFrame(rows, "qid string, src_pos int")
    run = run_of(spark, **{qid: "A" if found[i] else "X" for qid, i in rows})
    ev = evaluate_run(run, questions, qrels_of(spark, **{qid: "A" for qid, _ in rows}), ks=(1,))
    got = ev.summary_dict()["mrr"]
    assert (got["mean"], got["ci_lo"], got["ci_hi"]) == pytest.approx(expected_interval([(i, float(v)) for i, v in enumerate(found)]))


def test_summary_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 7.0), ("a", 1.0), ("b", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in mt.summarize(df, "v", ["g"]).collect()}
    assert got[None] == (6.0, 1.0, 6.0, pytest.approx(6.9)) and got["b"] == (0.0, 0.0, 0.0, 0.0)
    assert mt.summarize(df.limit(0), "v").first()["p50"] == 0.0
