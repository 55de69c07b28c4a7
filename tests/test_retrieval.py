import math
import re
from collections import Counter
from dataclasses import replace
from hashlib import md5
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import STOPWORDS
from rankloom.operators.bm25 import (
    BM25Retriever, block_bounds, bm25_hits, bm25_scores, build_bm25_tables, load_bm25_tables, pruned_scores, weighted_terms, whole_chunks)
from rankloom.operators.dense import DenseRetriever
from rankloom.operators import bm25_scan, latent
from rankloom.operators.encoders import fit_pair_weights, hash_counts, model_encoder, model_scorer
from rankloom.operators.expansion import ExpandingRetriever, Rm3QueryExpander
from rankloom.operators.fusion import HybridRetriever, fuse_rrf, fuse_weighted
from rankloom.operators.rerank import PairReranker
from rankloom.operators.retriever import DeepRun, attach_text, fetch, top_k, write_chunks
from rankloom.plans.setups import SharedIndexes, ablation_grid, default_retriever, make_setup
from rankloom.runtime import bucketed_scans, buckets_of, materialize, new_table_path, rows_with, scratch_scope, table_exists, write_bucketed

RUN = "qid string, rank int, chunk_id string, doc_id string, score double, retriever string"
CHUNK = "chunk_id string, doc_id string, text string, index int"


def tokens(text):
    return [t for t in re.findall(r"\w+", text.lower()) if t not in STOPWORDS]


def brute_bm25(chunk_rows, question, k, k1=1.5, b=0.75):
    counts = {c["chunk_id"]: Counter(tokens(c["text"])) for c in chunk_rows}
    n, avgdl = len(counts), sum(sum(c.values()) for c in counts.values()) / len(counts)
    df = Counter(t for c in counts.values() for t in c)
    scores = {}
    for chunk_id, tf in counts.items():
        dl = sum(tf.values())
        parts = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * dl / avgdl))
                 for t in tokens(question) if t in tf]
        if parts:
            scores[chunk_id] = round(sum(parts), 9)
    return sorted(scores.items(), key=lambda item: (-item[1], item[0]))[:k]


def ranked(run):
    out = {}
    for r in run.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["chunk_id"], r["score"]))
    return out


def ask(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "qid string, question string")


@pytest.fixture(scope="module")
def bm25(chunks):
    return BM25Retriever().index(chunks)


@pytest.fixture(scope="module")
def dense(chunks):
    return DenseRetriever().index(chunks)


def test_bm25_equals_brute_force(chunks, questions, bm25):
    rows = chunks.collect()
    got = ranked(bm25.search(questions, 4))
    expected = {q["qid"]: brute_bm25(rows, q["question"], 4) for q in questions.collect()}
    for qid, hits in expected.items():
        assert [h[0] for h in got.get(qid, [])] == [h[0] for h in hits]
        assert [h[1] for h in got.get(qid, [])] == pytest.approx([h[1] for h in hits], abs=2e-9)
    assert "q5" not in got and "q6" not in got  # unknown words, and stopwords only


def test_bm25_repeated_query_words_count_again(spark, chunks, bm25):
    got = ranked(bm25.search(ask(spark, "river", "river river"), 1))
    assert got["q1"][0][1] == pytest.approx(2 * got["q0"][0][1], abs=1e-8)


def test_bm25_shuffled_terms_split_hot_terms(spark):
    # "common" is in every chunk: far beyond the hot share, so it is split
    rows = [(f"c{i:03d}", f"d{i}", f"common word{i % 7} " + "pad " * (i % 3), 0) for i in range(300)]
    tables = build_bm25_tables(spark.createDataFrame(rows, CHUNK))
    queries = ask(spark, "common word3", "word5 common common", "pad")
    wide = BM25Retriever.over(tables, broadcast_rows=0).search(queries, 20)
    small = BM25Retriever.over(tables).search(queries, 20)
    assert ranked(wide) == ranked(small)
    assert wide.count() == 60


def test_bm25_ties_by_chunk_id(spark):
    chunks = spark.createDataFrame(
        [("z_second", "d", "apple pie", 0), ("a_first", "d", "apple pie", 0), ("b_other", "d", "", 0)], CHUNK)
    retriever = BM25Retriever().index(chunks)
    assert retriever.tables.n_chunks == 3  # the empty chunk counts
    assert [h[0] for h in ranked(retriever.search(ask(spark, "apple"), 100))["q0"]] == ["a_first", "z_second"]


def test_bm25_saved_index(spark, chunks, questions, bm25):
    path = new_table_path(spark, "saved")
    build_bm25_tables(chunks, path)
    assert ranked(BM25Retriever.over(load_bm25_tables(spark, path)).search(questions)) == ranked(bm25.search(questions))


def test_bm25_scores_without_shuffling_postings(spark, questions, bm25):
    run = bm25.search(questions, 3)
    run.collect()
    plan = run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(") == 1  # the best k per bucket, by qid
    assert "WindowGroupLimit" in plan


def test_bm25_reads_only_its_terms(spark, questions):
    """One file a bucket; the question's terms reach the scan, and row groups without them are not read."""
    words = [f"t{i:05d}" for i in range(20_000)]
    rows = [(f"c{i:04d}", "d", " ".join(words[i * 20:i * 20 + 40]), 0) for i in range(999)]
    tables = build_bm25_tables(spark.createDataFrame(rows, CHUNK).repartition(3), chunk_buckets=2)
    small_groups = write_bucketed(tables.postings, new_table_path(spark, "small"), "chunk_id", 2, ["term"], 16_384)
    assert len(tables.postings.inputFiles()) == len(small_groups.inputFiles()) == 2
    asked = spark.createDataFrame([(words[0],), (words[9_999],)], "term string")
    found = rows_with(small_groups, "term", asked)
    assert {r["term"] for r in found.collect()} == {words[0], words[9_999]}
    plan = found._jdf.queryExecution().executedPlan()
    assert "In(term, [" in plan.toString()
    scan = plan.collectLeaves().head()
    assert int(scan.metrics().get("numOutputRows").get().value()) < tables.n_postings / 4
    assert rows_with(small_groups, "term", tables.vocab.select("term"), 100) is None
    assert rows_with(small_groups, "term", asked.limit(0)).count() == 0
    quoted = spark.createDataFrame([("it's \\ odd",)], "term string")
    assert rows_with(quoted, "term", quoted).count() == 1


def test_bm25_pruned_search_equals_exhaustive(spark):
    """Few blocks are scored where some chunks stand out; ties at the bound stay, as do questions with few matches."""
    draw = np.random.default_rng(8)
    rows = [(f"c{i:04d}", f"d{i}", " ".join(f"w{x}" for x in draw.zipf(1.6, 30) if x < 3_000), 0) for i in range(1_500)]
    rows += [(f"x{i:03d}", "e", "w7 w9 rare " + "w1 " * (i % 2), 0) for i in range(60)]  # ties in many blocks
    tables = build_bm25_tables(spark.createDataFrame(rows, CHUNK), chunks_per_block=8)
    queries = ask(spark, "w7 w9 rare", "w1 w2", "w2999", "w1", "nothing", "w11 w12 w13 w14")
    whole = BM25Retriever.over(tables, prune=False)
    for k in (1, 10, 70):
        assert ranked(BM25Retriever.over(tables, prune=True).search(queries, k)) == ranked(whole.search(queries, k))
    for params in ({"k1": 0.4, "b": 1.0}, {"k1": 3.0, "b": 0.0}):
        assert ranked(BM25Retriever.over(tables, prune=True, **params).search(queries, 5)) == ranked(
            BM25Retriever.over(tables, prune=False, **params).search(queries, 5))
    terms = weighted_terms(tables, queries, 1_000)
    found = pruned_scores(tables, terms, 3, 1.5, 0.75)
    assert 0.3 < found.share_skipped() < 1
    bounds = {(r["qid"], r["block"]): r["bound"] for r in found.bounds.collect()}
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(tables.n_blocks)).cast("int")
    for r in bm25_scores(tables, terms, 1.5, 0.75).withColumn("block", block).collect():
        assert r["score"] <= bounds[r["qid"], r["block"]] + 1e-9


def jobs_of(spark, name, work):
    """What *work* returns, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


@pytest.mark.parametrize("tiles", [1, 3])
def test_bm25_search_makes_no_row_per_question_and_chunk(spark, tiles, monkeypatch):
    """Tasks hand back their best k; repeated chunk ids, repeated and null question ids add up as in the plain sums."""
    draw = np.random.default_rng(5)
    rows = [(f"c{i:04d}", f"d{i}", " ".join(f"w{x}" for x in draw.integers(0, 40, 12)), 0) for i in range(600)]
    rows += rows[:50] + [("c0007", "d7", "w1 w2", 1)] + [(f"e{i}", "e", "w1 w2 w3", 0) for i in range(30)]
    tables = build_bm25_tables(spark.createDataFrame(rows, CHUNK), chunks_per_block=16)
    asked = [(f"q{i}", " ".join(f"w{x}" for x in draw.integers(0, 40, 6))) for i in range(20)] + [(None, "w1 w2"), ("q3", "w5 w5 w6")]
    terms = weighted_terms(tables, spark.createDataFrame(asked, "qid string, question string"), 1_000)
    hits = bm25_hits(tables, replace(terms, tiles=tiles), 4, 1.5, 0.75)
    plain = ranked(top_k(bm25_scores(tables, terms, 1.5, 0.75), 4, "bm25"))
    assert ranked(top_k(hits, 4, "bm25")) == plain
    assert hits.count() <= 4 * 21 * 16 and bm25_scores(tables, terms, 1.5, 0.75).count() > 4 * 21 * 16
    monkeypatch.setattr(bm25_scan, "CELLS", 50)  # small blocks, ranked often
    monkeypatch.setattr(bm25_scan, "HELD", 10)
    assert ranked(top_k(bm25_hits(tables, terms, 4, 1.5, 0.75), 4, "bm25")) == plain


def test_bm25_many_terms_are_counted_in_the_token_arrays(spark):
    """No postings are written for a batch that would read them all; few terms write and read them, and find the same."""
    draw = np.random.default_rng(3)
    rows = [(f"c{i:04d}", f"d{i % 90}", " ".join(f"w{x}" for x in draw.integers(0, 900, 40)), 0) for i in range(300)]
    rows += rows[:20] + [("c0007", "d7", "w1 w2 w2", 1), ("c0007", "e", "w1", 0), (None, "d", "w3 w4", 0), ("none", "d", None, 0)]
    tables = build_bm25_tables(spark.createDataFrame(rows, CHUNK), chunks_per_block=16)
    asked = [(f"q{i}", " ".join(f"w{x}" for x in range(60 * i, 60 * i + 60))) for i in range(15)]
    many = spark.createDataFrame(asked, "qid string, question string")
    found = BM25Retriever.over(tables).search(many, 7)
    pruned = ranked(BM25Retriever.over(tables, prune=True).search(many, 7))
    assert weighted_terms(tables, many, 10_000).rows.select("term").distinct().count() > 500
    found, written = ranked(found), [table_exists(spark, f"{tables.path}/{name}") for name in ("postings", "bounds")]
    assert written == [False, True] and found == pruned
    few = ranked(BM25Retriever.over(tables).search(spark.createDataFrame(asked[:3], "qid string, question string"), 7))
    assert few == {f"q{i}": found[f"q{i}"] for i in range(3)} and table_exists(spark, f"{tables.path}/postings")
    assert ranked(top_k(bm25_scores(tables, weighted_terms(tables, many, 10_000), 1.5, 0.75), 7, "")) == found
    assert {(r["term"], r["df"]) for r in tables.vocab.collect()} == {
        (r["term"], r["count"]) for r in tables.postings.groupBy("term").count().collect()}


def test_index_buckets_follow_the_chunks(spark):
    """A bucket's postings are sorted by one task, so buckets must not grow with the corpus."""
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("doc_id"),
                                       F.lit("river bank").alias("text"), F.lit(0).alias("index"))
    tables = build_bm25_tables(rows)
    assert spark.read.parquet(f"{tables.path}/stats").first()["chunk_buckets"] == 5


def test_power_step_runs_its_tasks_together(spark):
    rows = [(f"c{i}", [f"t{i % 7}", "all"]) for i in range(160)]
    tokens = materialize(spark.createDataFrame(rows, "chunk_id string, tokens array<string>").repartition(16), "tokens")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        model = latent.LatentModel({f"t{i}": i for i in range(7)}, np.ones(7), np.eye(7))
        found, jobs = jobs_of(spark, "power-step", lambda: latent.power_step(tokens, model, 16))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert np.allclose(np.diag(found), [23] * 6 + [22]) and jobs < 8


def test_small_question_tiles_share_a_pass(spark):
    rows = [(f"v{i}", "d", np.eye(8)[i % 8].tolist()) for i in range(60)]
    vectors = materialize(spark.createDataFrame(rows, "chunk_id string, doc_id string, vec array<double>"), "vectors")
    asked = vectors.select(F.col("chunk_id").alias("qid"), "vec")
    found, jobs = jobs_of(spark, "tiles", lambda: ranked(DenseRetriever.over(vectors, question_tile=4).search_vectors(asked, 3)))
    assert jobs < 8 and found == ranked(DenseRetriever.over(vectors).search_vectors(asked, 3))


def test_empty_index_and_missing_index(spark, questions):
    nothing = spark.createDataFrame([], CHUNK)
    for retriever in (BM25Retriever(), DenseRetriever()):
        with pytest.raises(ValueError):
            retriever.index(nothing)
        with pytest.raises(RuntimeError):
            type(retriever)().search(questions)
    with pytest.raises(ValueError):
        default_retriever(nothing)


def test_hash_counts(spark):
    rows = spark.createDataFrame([("A b a ab",), ("",)], "t string").select(hash_counts(F.col("t"), 16)).collect()
    buckets = Counter(int(md5(w.encode()).hexdigest()[:2], 16) % 16 for w in ("a", "b", "a", "ab"))
    assert rows[0][0] == [float(buckets[i]) for i in range(16)] and rows[1][0] == [0.0] * 16


def test_latent_basis_equals_dense_algebra(spark):
    """The fitted basis by plain matrices, for any partitioning; it spans the leading singular vectors."""
    draw = np.random.default_rng(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(4)]
    texts = [[str(draw.choice(topics[i % 4])) for _ in range(15)] + [f"own{i}"] for i in range(120)] + [[], ["unseen"] * 3]
    tokens = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, tokens array<string>")
    models = [latent.fit_latent(tokens.repartition(n), 4, 60, 6) for n in (1, 5)]
    assert np.allclose(models[0].basis, models[1].basis, atol=1e-9)
    df = Counter(t for text in texts for t in set(text))
    terms = sorted(df, key=lambda t: (-df[t], t))[:60]
    assert list(models[0].index) == terms
    idf = [math.log((len(texts) - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in terms]
    matrix = np.array([[(1 + math.log(text.count(t))) * w if t in text else 0 for t, w in zip(terms, idf)] for text in texts])
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    block = np.array([[int(md5(f"42|latent|{0}|{t}".encode()).hexdigest()[8 * j:8 * j + 8], 16) / 2 ** 32 - 0.5 for j in range(4)] for t in terms])
    for step in range(7):
        q, r = np.linalg.qr(block if step == 0 else matrix.T @ (matrix @ q))
        q = q * np.sign(np.diag(r))
    assert np.allclose(models[0].basis, q, atol=1e-8)
    leading = np.linalg.svd(matrix)[2][:4]
    assert np.linalg.norm(leading @ models[0].basis, 2) > 0.99 and abs(np.linalg.det(leading @ models[0].basis)) > 0.9
    assert not models[0].encode([["unseen"], []])[0].any()
    tiny = latent.fit_latent(tokens.limit(0), 4)
    assert tiny.basis.shape == (0, 0)


@pytest.mark.parametrize("share", [0.0, 1 / 128, 2.0])
def test_scorer_equals_sums_by_cell(monkeypatch, share):
    """Common terms as matrices or all terms by cell: the same scores; rows and questions that come twice add up."""
    monkeypatch.setattr(bm25_scan, "COMMON_SHARE", share)
    draw = np.random.default_rng(5)
    term = np.sort(draw.integers(0, 40, 300))
    starts, questions, weights = np.searchsorted(term, np.arange(41)), draw.integers(0, 25, 300), draw.random(300)
    row, number, part = np.sort(draw.integers(0, 60, 900)), draw.integers(0, 40, 900) ** 2 // 40, draw.random(900)
    scorer = bm25_scan._Scorer(bm25_scan._Group(0, 25, starts, questions, weights), 60, number)
    assert len(scorer.common) == (40 if share == 0 else 0) or share == 1 / 128 and 0 < len(scorer.common) < 40
    expected = np.zeros((60, 25))
    for r, t, x in zip(row, number, part):
        for e in range(starts[t], starts[t + 1]):
            expected[r, questions[e]] += x * weights[e]
    assert np.allclose(scorer.scores(60, row, number, part), expected, atol=1e-12)


def test_setups_share_a_search(spark, documents, questions):
    """Rows are those of searches of their own; the texts are tokenised and an index is searched once, for all that ask the same of it."""
    cells = [make_setup(c.label, c.chunker, c.retriever, c.rerank) for c in ablation_grid(("fixed",))]
    cells.append(make_setup("rm3", "fixed", "bm25", use_rm3=True))
    asked = questions.select("qid", "question")
    with scratch_scope(spark) as scope:
        plain = SharedIndexes(documents)
        shared = plain.for_setups(cells, asked)
        for cell in cells:
            own, found = (cell.build(documents, x).search(asked).collect() for x in (plain, shared))
            assert sorted(own) == sorted(found), cell.name
        made = Counter(f.name.split("-")[0] for f in Path(scope.folder).iterdir())
    assert made["deep"] == 2 and made["latent"] == 0 and made["bm25"] == 1


def test_deep_run_serves_its_own_questions_only(spark, chunks, questions):
    retriever = BM25Retriever().index(chunks)
    asked = materialize(questions.select("qid", "question"), "questions")
    own = ranked(retriever.search(asked, 3))
    other = ask(spark, "river", "acorns")
    expected, deeper = ranked(retriever.search(other, 2)), ranked(retriever.search(asked, 9))
    retriever.deep = DeepRun(asked, 4)
    assert ranked(retriever.search(asked, 3)) == own and ranked(retriever.search(other, 2)) == expected
    assert ranked(retriever.search(asked, 9)) == deeper and retriever.search(asked, 0).count() == 0


def test_short_chunks_are_indexed_where_they_lie(spark):
    """Buckets count by bytes as well: many short chunks are not shuffled again."""
    rows = spark.range(70_000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("doc_id"),
                                      F.lit("river bank").alias("text"), F.lit(0).alias("index"))
    assert build_bm25_tables(write_chunks(rows, 1)).chunk_buckets == 1


def test_latent_basis_counts_every_chunk(spark):
    """Beyond two million chunks too: chunks of one term make A'A the diagonal of the terms' counts."""
    n, cuts = 2_000_400, [0, 3, 5, 6]  # of every seven chunks three have t0, two t1, one t2 and one t3
    place = F.pmod(F.col("id"), F.lit(7))
    term = F.concat(F.lit("t"), sum((F.when(place >= cut, 1).otherwise(0) for cut in cuts[1:]), F.lit(0)).cast("string"))
    tokens = materialize(spark.range(n).select(F.col("id").cast("string").alias("chunk_id"), F.array(term).alias("tokens")), "tokens")
    model = latent.fit_latent(tokens, 2, 4, 2)
    places = np.bincount(np.arange(n) % 7, minlength=7)
    counts = dict(zip(("t0", "t1", "t2", "t3"), np.add.reduceat(places, cuts).tolist()))
    assert list(model.index) == sorted(counts, key=lambda t: (-counts[t], t))
    expected = latent.orthonormal(np.array([latent.drawn_row(t, 2, latent.SEED) for t in model.index]))
    for _ in range(2):
        expected = latent.orthonormal(np.array([counts[t] for t in model.index])[:, None] * expected)
    assert np.allclose(model.basis, expected, atol=1e-9)


def test_dense_vectors_from_written_tokens(spark, chunks):
    """Tokens of a word index give the vectors that texts give, and what the fit wrote goes."""
    forward, plain = build_bm25_tables(chunks).forward, DenseRetriever().index(chunks)
    with scratch_scope(spark) as scope:
        shared = DenseRetriever()
        shared.tokens = forward
        found = {r["chunk_id"]: r["vec"] for r in shared.index(chunks).vectors.collect()}
        assert [f.name.split("-")[0] for f in Path(scope.folder).iterdir()] == ["vectors"]
    assert found == {r["chunk_id"]: pytest.approx(r["vec"], abs=1e-6) for r in plain.vectors.collect()}
    by_text = chunks.select("chunk_id", plain.fitted(F.col("text")).alias("vec")).collect()
    norms = {r["chunk_id"]: np.linalg.norm(r["vec"]) for r in by_text}
    assert all(np.allclose(np.array(r["vec"]) / (norms[r["chunk_id"]] or 1.0), found[r["chunk_id"]], atol=1e-6) for r in by_text)


def test_latent_vectors_find_topics(spark):
    """Chunks of a question's topic come first though they share no word with the question."""
    near = [("sea", "wave"), ("wave", "tide"), ("tide", "sea"), ("oven", "bread"), ("bread", "dough"), ("dough", "oven")]
    rows = [(f"{a}{i}", a, f"{a} {b}", 0) for i in range(4) for a, b in near]
    retriever = DenseRetriever(latent.LatentEncoder(dims=2)).index(spark.createDataFrame(rows, CHUNK))
    found = retriever.search(ask(spark, "sea", "oven"), 12).collect()
    of = {q: {r["doc_id"] for r in found if r["qid"] == q} for q in ("q0", "q1")}
    assert of == {"q0": {"sea", "wave", "tide"}, "q1": {"oven", "bread", "dough"}}
    assert retriever.vectors.schema["vec"].dataType.simpleString() == "array<float>"


def test_dense_moves_no_vectors(spark, questions, dense):
    run = dense.search(questions, 3)
    run.collect()
    plan = run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(") == 1 and "Coalesce" in plan  # the merged best, by qid
    for line in plan.split("Exchange hashpartitioning(")[0].splitlines():
        assert "vec#" not in line


@pytest.mark.parametrize("params", [{}, {"question_tile": 5}])
def test_dense_equals_brute_force_with_many_ties(spark, params):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    # a third of all vectors are copies of one vector
    matrix = np.concatenate([base, np.repeat(base[:1], 60, axis=0), rng.normal(size=(90, 8))])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    ids = [f"v{i}" for i in range(len(matrix))]
    vectors = spark.createDataFrame([(i, "d", v.tolist()) for i, v in zip(ids, matrix)],
                                    "chunk_id string, doc_id string, vec array<double>")
    asked = vectors.limit(20).select(F.col("chunk_id").alias("qid"), "vec")
    got = ranked(DenseRetriever.over(vectors, **params).search_vectors(asked, 7))
    for row in asked.collect():
        scores = np.round(matrix @ np.array(row["vec"]), 9)
        best = sorted(zip(-scores, ids))[:7]
        assert [h[0] for h in got[row["qid"]]] == [b[1] for b in best]


def test_dense_search_and_model_encoder(spark, chunks, questions, dense):
    assert set(ranked(dense.search(questions, 3))) == {f"q{i}" for i in range(1, 7)}

    def load():
        return lambda texts: np.array([[float("river" in t.lower()), 1.0] for t in texts])

    retriever = DenseRetriever(model_encoder(load)).index(chunks)
    top = attach_text(retriever.search(ask(spark, "River?"), 1), chunks).first()
    assert "river" in top["text"].lower() and top["retriever"] == "dense"
    assert retriever.search_one("river", 2, spark).count() == 2


def run_of(spark, rows):
    return spark.createDataFrame([("q", rank, c, "d", score, "x") for rank, (c, score) in enumerate(rows, 1)], RUN)


def test_rrf_value_and_tie(spark):
    fused = fuse_rrf([run_of(spark, [("Z", 9.0), ("X", 8.0)]), run_of(spark, [("Z", 1.0), ("Y", 0.5)])], 10)
    assert ranked(fused)["q"] == [("Z", round(2 / 61, 9)), ("X", round(1 / 62, 9)), ("Y", round(1 / 62, 9))]
    assert fused.first()["retriever"] == "hybrid_rrf"


def test_weighted_fusion(spark):
    runs = [run_of(spark, [("ca", 10.0), ("cb", 0.0)]), run_of(spark, [("cb", 10.0), ("ca", 0.0)])]
    assert dict(ranked(fuse_weighted(runs, 10, [0.8, 0.2]))["q"]) == pytest.approx({"ca": 0.8, "cb": 0.2}, abs=1e-8)
    constant = fuse_weighted([run_of(spark, [("a", 3.0)])], 10)
    assert ranked(constant)["q"] == [("a", 0.0)]


def test_hybrid(chunks, questions, bm25, dense):
    hybrid = HybridRetriever([bm25, dense], "rrf", 60)
    run = hybrid.search(questions, 2)
    expected = fuse_rrf([bm25.search(questions, 6), dense.search(questions, 6)], 2)
    assert ranked(run) == ranked(expected)
    for bad in (lambda: HybridRetriever([], "rrf"), lambda: HybridRetriever([bm25], "sum")):
        with pytest.raises(ValueError):
            bad()


def test_expansion(spark):
    texts = ["apple pear pear", "apple pear fig the the the", "apple fig fig kiwi"]
    chunks = spark.createDataFrame([(f"c{i}", "d", t, i) for i, t in enumerate(texts)], CHUNK)
    retriever = BM25Retriever().index(chunks)
    expanded = Rm3QueryExpander(retriever, fb_docs=3, fb_terms=2).expand(ask(spark, "Apple!", "unknown"))
    got = {r["qid"]: r["question"] for r in expanded.collect()}
    assert got["q1"] == "unknown"
    assert got["q0"].startswith("Apple! ") and set(got["q0"].split()[1:]) == {"pear", "fig"}
    search = ExpandingRetriever(retriever, Rm3QueryExpander(retriever)).search(ask(spark, "kiwi"), 5)
    assert {r["retriever"] for r in search.collect()} == {"rm3+bm25"}
    assert search.count() == 3  # kiwi alone finds one chunk


def test_expansion_failures(spark):
    """Without an index questions stay as they are; an error inside Spark is raised."""
    never_indexed = Rm3QueryExpander(BM25Retriever())
    assert never_indexed.expand(ask(spark, "apple")).first()["question"] == "apple"

    class Failing(BM25Retriever):
        def _search(self, queries, k):
            return queries.select("qid", F.raise_error(F.lit("lost")).alias("rank"))

    failing = Failing()
    failing._ready = True
    with pytest.raises(Exception, match="lost"):
        Rm3QueryExpander(failing, tokens=spark.createDataFrame([], "chunk_id string, tokens array<string>")).expand(ask(spark, "a")).collect()


def test_chunk_tables_of_rows_without_a_size(spark):
    """Rows from Python have no size in the plan; the table still has a few buckets only."""
    table = write_chunks(spark.createDataFrame([("c1", "d", "text", 0)], CHUNK).repartition(2))
    assert len(table.inputFiles()) <= spark.sparkContext.defaultParallelism and table.count() == 1


def test_fetch_opens_only_the_wanted_buckets(spark):
    rows = [(f"c{i:05d}", "d", f"text {i}", i) for i in range(5_000)]
    table = write_chunks(spark.createDataFrame(rows, CHUNK), 16)
    run = materialize(spark.createDataFrame([("q0", 1, "c00017"), ("q1", 1, "c04000"), ("q0", 2, "c04000"), ("q2", 1, "none")],
                                            "qid string, rank int, chunk_id string"), "run")
    found = fetch(table, run, ["text"])
    assert sorted(map(tuple, found.collect())) == [("q0", 1, "c00017", "text 17"), ("q0", 2, "c04000", "text 4000"), ("q1", 1, "c04000", "text 4000")]
    listed = rows_with(table, "chunk_id", run.select("chunk_id"))
    plan = listed._jdf.queryExecution().executedPlan()
    assert "In(chunk_id, [" in plan.toString() and "In(chunk_id, [" in found._jdf.queryExecution().executedPlan().toString()
    buckets = plan.collectLeaves().head().optionalBucketSet()
    assert buckets.isDefined() and 1 <= buckets.get().cardinality() <= 3
    assert fetch(table, materialize(table.select("chunk_id", "index"), "run"), ["text"]).count() == 5_000


def test_rerank(spark):
    rows = [("q0", i + 1, f"c{'ABCDE'[i]}", "d", 1.0, "" if i == 4 else "bm25", f"text {i}") for i in range(5)]
    candidates = spark.createDataFrame(rows, RUN + ", text string")
    queries = ask(spark, "anything")

    def load():
        return lambda pairs: [float(p[1].split()[1]) for p in pairs]

    out = PairReranker(model_scorer(load)).rerank(queries, candidates, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["cE", "cD", "cC"]
    assert out[0]["score"] == pytest.approx(1 / (1 + math.exp(-4)), abs=1e-9)
    assert [r["retriever"] for r in out] == ["rerank(unknown)", "rerank(bm25)", "rerank(bm25)"]
    assert PairReranker().rerank(queries, candidates.limit(0)).count() == 0


def test_coverage_score(spark):
    """Words 2 of 2, pairs 1 of 1; words 2 of 3, pairs 1 of 2; nothing asked."""
    candidates = spark.createDataFrame([(f"q{i}", 1, "c", "d", 1.0, "bm25", "red fox jumps") for i in range(3)], RUN + ", text string")
    found = {r["qid"]: r["score"] for r in PairReranker().rerank(ask(spark, "Red fox", "red fox sleeps", ""), candidates).collect()}
    odds = {"q0": 4.0, "q1": -3 + 4 * 2 / 3 + 3 / 2, "q2": -3.0}
    assert found == pytest.approx({q: 1 / (1 + math.exp(-x)) for q, x in odds.items()}, abs=1e-9)


def test_fitted_weights(spark):
    """Gradient ascent by plain numpy; where word pairs alone tell, their weight grows and orders the pairs."""
    rows = [(f"w{i} v{i} u{i}", f"w{i} v{i} x u{i}" if i % 3 == 0 else f"v{i} w{i} x u{i}", i % 3 == 0) for i in range(60)]
    pairs = spark.createDataFrame(rows, "question string, text string, relevant boolean").repartition(4)
    weights = fit_pair_weights(pairs)
    x = np.array([[1, 1, 0.5 if hit else 0, 3 / 7] for _, _, hit in rows])
    y = np.array([hit for *_, hit in rows], dtype=float)
    mass, w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), np.array([-3.0, 4.0, 3.0, 0.0])
    for _ in range(25):
        w = w + 4.0 * (x.T @ (mass * (y - 1 / (1 + np.exp(-x @ w)))) - 0.001 * w)
    assert weights == pytest.approx(w.tolist(), abs=1e-9) and weights[2] > 3
    assert fit_pair_weights(pairs.where("relevant")) == fit_pair_weights(pairs.limit(0)) == [-3.0, 4.0, 3.0, 0.0]
    x, w = x[y == 0], np.array([-3.0, 4.0, 3.0, 0.0])  # one kind alone, on request
    for _ in range(25):
        w = w + 4.0 * (-(x.T @ (0.5 / len(x) / (1 + np.exp(-x @ w)))) - 0.001 * w)
    assert fit_pair_weights(pairs.where("not relevant"), both_kinds=False) == pytest.approx(w.tolist(), abs=1e-9)


def test_written_chunks_are_indexed_where_they_lie(spark):
    """One shuffle of the texts, for the chunk table: the index reads its buckets and writes one file for each."""
    rows = [(f"c{i:04d}", f"d{i % 9}", f"common word{i % 50} é{i}", 0) for i in range(2_000)]
    table = write_chunks(spark.createDataFrame(rows, CHUNK), 7)
    with bucketed_scans(spark):
        texts = table.select("chunk_id", "text").repartition(buckets_of(table, "chunk_id"), "chunk_id")
        assert "Exchange" not in texts._jdf.queryExecution().executedPlan().toString()
    tables, plain = build_bm25_tables(table), build_bm25_tables(materialize(table, "plain"))
    assert tables.chunk_buckets == len(tables.forward.inputFiles()) == 7
    assert plain.chunk_buckets == spark.sparkContext.defaultParallelism
    for name in ("forward", "vocab"):
        one, other = (getattr(t, name) for t in (tables, plain))
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0, name
    queries = ask(spark, "word3 é17", "common", "é1999 word49")
    assert ranked(BM25Retriever.over(tables).search(queries, 5)) == ranked(BM25Retriever.over(plain).search(queries, 5))


def test_block_bounds_shuffle_chunks(spark):
    """A block's chunks meet in one task; no row per term and block is shuffled, and repeated ids count together."""
    rows = [(f"c{i:04d}", "d", f"w{i % 7} w{i % 7} w{i % 11} common", 0) for i in range(400)] + [("c0003", "d", "common w3", 1)]
    for repeated, some in ((False, rows[:400]), (True, rows)):
        tables = build_bm25_tables(spark.createDataFrame(some, CHUNK), chunks_per_block=16)
        assert tables.repeated == repeated
        bounds = block_bounds(tables.forward, tables.n_blocks, 3, tables.repeated)
        assert bounds._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(block") == 1
        expected = tables.postings.groupBy("term", "block").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, expected.collect()))


def test_chunks_of_single_rows_are_not_grouped(spark):
    rows = [(f"c{i}", "d", f"river w{i}", 0) for i in range(50)]
    one, twice = (build_bm25_tables(spark.createDataFrame(r, CHUNK)) for r in (rows, rows + rows[:1]))
    plans = [whole_chunks(t.forward, 1, t.repeated)._jdf.queryExecution().executedPlan().toString() for t in (one, twice)]
    assert ["Aggregate" in plan for plan in plans] == [False, True]
