"""One registered query per operator: (spark, folder) -> DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.fixtures import FIXED, SENTENCES, Fixtures, fixtures
from rankloom.functions import scores as sc
from rankloom.functions import text as tx
from rankloom.operators import answers as an
from rankloom.operators import bm25
from rankloom.operators import faithfulness as fa
from rankloom.operators import fusion
from rankloom.operators import metrics as mt
from rankloom.operators import resampling as rs
from rankloom.operators.chunking import FixedSizeChunker, FunctionChunker
from rankloom.operators.dense import DenseRetriever
from rankloom.operators.encoders import coverage_scorer, fit_pair_weights, hash_counts, weighted_scorer
from rankloom.operators.expansion import ExpandingRetriever, Rm3QueryExpander
from rankloom.operators.rerank import PairReranker, score_pairs
from rankloom.operators.retriever import attach_text
from rankloom.plans.engine import Engine
from rankloom.plans.evaluation import compare_all, evaluate_run, orphan_qids
from rankloom.plans.setups import ablation_grid, default_setups, make_setup
from rankloom.runtime import materialize, new_table_path
from rankloom.sources import dataset, jsonl
from rankloom.sources.reports import search_view

Query = Callable[[SparkSession, str], DataFrame]

_registry: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Integers as 64 bit and doubles at six digits, so results compare across engines."""
    def column(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            value = value.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.round(value.cast("double"), 6)
        return value.alias(field.name)

    return df.select(*[column(field) for field in df.schema])


def registered(make: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    _registry[make.__name__] = lambda spark, folder: _plain(make(fixtures(spark, folder)))
    return make


def queries() -> dict[str, Query]:
    return dict(_registry)


# --- text functions -------------------------------------------------------

def _joined(tokens: Column) -> list[Column]:
    return [F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")]


@registered
def normalized_text(fx: Fixtures) -> DataFrame:
    return fx.documents.select("doc_id", tx.normalize(F.col("text")).alias("normalized"))


@registered
def word_tokens(fx: Fixtures) -> DataFrame:
    tokens = tx.tokenize(F.col("text"), remove_stops=False)
    return fx.documents.select("doc_id", tokens.alias("tokens")).select("doc_id", *_joined(tokens))


@registered
def index_tokens(fx: Fixtures) -> DataFrame:
    tokens = tx.tokenize(F.col("text"))
    return fx.documents.select("doc_id", tokens.alias("tokens")).select("doc_id", *_joined(tokens))


@registered
def stemmed_tokens(fx: Fixtures) -> DataFrame:
    tokens = tx.tokenize(F.col("text"), stemmed=True)
    return fx.documents.select("doc_id", tokens.alias("tokens")).select("doc_id", *_joined(tokens))


@registered
def sentences_for_chunking(fx: Fixtures) -> DataFrame:
    return fx.documents.select("doc_id", F.posexplode(tx.chunk_sentences(F.col("text"))).alias("pos", "sentence"))


@registered
def sentences_for_answers(fx: Fixtures) -> DataFrame:
    return fx.documents.select("doc_id", F.posexplode(tx.answer_sentences(F.col("text"))).alias("pos", "sentence"))


@registered
def content_ids(fx: Fixtures) -> DataFrame:
    return fx.documents.select("doc_id", tx.content_id(F.col("text")).alias("content_id"))


@registered
def snippets(fx: Fixtures) -> DataFrame:
    return fx.documents.select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


# --- chunking -------------------------------------------------------------

@registered
def fixed_chunks(fx: Fixtures) -> DataFrame:
    return FIXED.chunk(fx.documents)


@registered
def small_fixed_chunks(fx: Fixtures) -> DataFrame:
    return FixedSizeChunker(20, 4).chunk(fx.documents).drop("text")


@registered
def sentence_window_chunks(fx: Fixtures) -> DataFrame:
    return SENTENCES.chunk(fx.documents)


# --- index tables ---------------------------------------------------------

@registered
def chunk_lengths(fx: Fixtures) -> DataFrame:
    return fx.bm25().tables.forward.select("chunk_id", "dl")


@registered
def corpus_statistics(fx: Fixtures) -> DataFrame:
    return bm25.corpus_stats(fx.bm25().tables.forward)


@registered
def postings(fx: Fixtures) -> DataFrame:
    return fx.bm25().tables.postings.select("term", "chunk_id", "tf", "dl")


@registered
def vocabulary(fx: Fixtures) -> DataFrame:
    return fx.bm25().tables.vocab.select("term", "df", "idf")


@registered
def question_terms(fx: Fixtures) -> DataFrame:
    return bm25.query_terms(fx.queries).select("qid", "term", "qtf")


# --- retrieval ------------------------------------------------------------

@registered
def bm25_search(fx: Fixtures) -> DataFrame:
    return fx.search(fx.bm25())


@registered
def bm25_other_parameters(fx: Fixtures) -> DataFrame:
    return fx.search(fx.bm25(k1=1.2, b=0.5))


@registered
def bm25_sentence_windows(fx: Fixtures) -> DataFrame:
    return fx.search(fx.bm25(SENTENCES))


@registered
def bm25_shuffled_terms(fx: Fixtures) -> DataFrame:
    """The plan for question sets beyond the broadcast bound: their terms are dealt to tiles that take turns."""
    return fx.search(bm25.BM25Retriever.over(fx.bm25().tables, broadcast_rows=0))


@registered
def bm25_pruned_search(fx: Fixtures) -> DataFrame:
    """Two steps: blocks whose bound cannot reach the best ten are never scored."""
    return fx.search(bm25.BM25Retriever.over(fx.bm25().tables, prune=True))


@registered
def bm25_conversations(fx: Fixtures) -> DataFrame:
    turns = fx.table("conversations").filter(F.col("role") == "user").select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("question"))
    return fx.bm25().search(turns, 5)


@registered
def l2_normalized(fx: Fixtures) -> DataFrame:
    """Each embedding times its id plus one, brought back to unit length."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    unit = sc.l2_normalize(scaled)
    return fx.table("embeddings").select("vec_id", F.posexplode(unit).alias("pos", "value"))


def _embedding_retriever(fx: Fixtures, **params) -> tuple[DenseRetriever, DataFrame]:
    rows = fx.table("embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"),
        sc.l2_normalize(F.col("embedding")).alias("vec"))
    vectors = materialize(rows, "embeddings")
    return DenseRetriever.over(vectors, **params), vectors.select(F.col("chunk_id").alias("qid"), "vec")


@registered
def dense_embeddings(fx: Fixtures) -> DataFrame:
    """Every vector searched among all vectors."""
    retriever, asked = _embedding_retriever(fx)
    return retriever.search_vectors(asked, 10)


@registered
def dense_embeddings_grid(fx: Fixtures) -> DataFrame:
    """Question tiles one after another, for sets beyond one tile."""
    retriever, asked = _embedding_retriever(fx, question_tile=128)
    return retriever.search_vectors(asked, 10)


@registered
def hashed_counts(fx: Fixtures) -> DataFrame:
    return fx.chunks().select("chunk_id", F.posexplode(hash_counts(F.col("text"))).alias("bucket", "n"))


@registered
def latent_vectors(fx: Fixtures) -> DataFrame:
    """Every chunk's vector under the encoder fitted on all chunks."""
    return fx.dense().vectors.select("chunk_id", F.posexplode("vec").alias("pos", "value"))


@registered
def dense_search(fx: Fixtures) -> DataFrame:
    return fx.search(fx.dense())


def _hybrid(fx: Fixtures, strategy: str = "rrf", weights=None, chunker=FIXED) -> fusion.HybridRetriever:
    return fusion.HybridRetriever([fx.bm25(chunker), fx.dense(chunker)], strategy, 60, weights)


@registered
def hybrid_rrf(fx: Fixtures) -> DataFrame:
    return fx.search(_hybrid(fx))


@registered
def hybrid_weighted(fx: Fixtures) -> DataFrame:
    return fx.search(_hybrid(fx, "weighted", [0.8, 0.2]))


def _expander(fx: Fixtures) -> Rm3QueryExpander:
    return Rm3QueryExpander(fx.bm25(), fb_docs=5, fb_terms=8)


@registered
def rm3_terms(fx: Fixtures) -> DataFrame:
    return _expander(fx).terms(fx.queries)


@registered
def rm3_questions(fx: Fixtures) -> DataFrame:
    return _expander(fx).expand(fx.queries)


@registered
def bm25_rm3_search(fx: Fixtures) -> DataFrame:
    return fx.search(ExpandingRetriever(fx.bm25(), _expander(fx)))


def _candidates(fx: Fixtures, k: int = 10) -> DataFrame:
    run = materialize(fx.search(_hybrid(fx), k), "candidates")
    return attach_text(run, fx.chunks())


@registered
def pair_scores(fx: Fixtures) -> DataFrame:
    return score_pairs(_candidates(fx), fx.queries, coverage_scorer).select("qid", "chunk_id", "logit")


@registered
def rerank_hybrid(fx: Fixtures) -> DataFrame:
    return PairReranker().rerank(fx.queries, _candidates(fx, 30), 5).drop("text")


def _judged_pairs(fx: Fixtures) -> DataFrame:
    """Hybrid candidates of the training questions, relevant when their document holds the passage."""
    training = F.left(F.md5(F.col("qid").cast("binary")), F.lit(1)) > "2"  # about four fifths
    relevant = fx.qrels.select("qid", "doc_id", F.lit(True).alias("relevant"))
    return (_candidates(fx).where(training).join(fx.queries, "qid").join(relevant, ["qid", "doc_id"], "left")
            .select("question", "text", F.coalesce("relevant", F.lit(False)).alias("relevant")))


@registered
def fitted_pair_weights(fx: Fixtures) -> DataFrame:
    """Weights of the pair features by logistic regression on judged pairs."""
    weights = fit_pair_weights(_judged_pairs(fx), both_kinds=False)
    return fx.spark.createDataFrame(list(enumerate(weights)), "feature int, weight double")


@registered
def rerank_fitted(fx: Fixtures) -> DataFrame:
    scorer = weighted_scorer(fit_pair_weights(_judged_pairs(fx), both_kinds=False))
    return PairReranker(scorer).rerank(fx.queries, _candidates(fx, 30), 5).drop("text")


# --- answers --------------------------------------------------------------

def _evidence(fx: Fixtures) -> DataFrame:
    run = materialize(fx.search(fx.bm25(), 5), "run")
    return materialize(attach_text(run, fx.chunks()), "evidence")


@registered
def sentence_overlap(fx: Fixtures) -> DataFrame:
    return an.sentence_scores(fx.queries, _evidence(fx)).select("qid", "rank", "pos", "overlap")


@registered
def extractive_answers(fx: Fixtures) -> DataFrame:
    answers = an.ExtractiveAnswerer(2).answer(fx.queries, _evidence(fx))
    return answers.select("qid", "text", F.size("supporting_chunks").alias("n_supporting"), "generator")


@registered
def context_blocks(fx: Fixtures) -> DataFrame:
    return an.context_blocks(_evidence(fx))


@registered
def premises(fx: Fixtures) -> DataFrame:
    return fa.premises(_evidence(fx))


@registered
def faithfulness(fx: Fixtures) -> DataFrame:
    evidence = _evidence(fx)
    texts = an.ExtractiveAnswerer(2).texts(fx.queries, evidence)
    return fa.FaithfulnessScorer().score(texts, evidence)


@registered
def search_display(fx: Fixtures) -> DataFrame:
    return search_view(_evidence(fx))


# --- evaluation -----------------------------------------------------------

@registered
def relevant_documents(fx: Fixtures) -> DataFrame:
    return fx.qrels


@registered
def relevant_counts(fx: Fixtures) -> DataFrame:
    return mt.relevant_counts(fx.qrels)


@registered
def unjudged_questions(fx: Fixtures) -> DataFrame:
    return orphan_qids(fx.questions, fx.qrels)


@registered
def document_ranking(fx: Fixtures) -> DataFrame:
    return mt.doc_ranking(materialize(fx.search(fx.bm25()), "run"))


def _per_query(fx: Fixtures, retriever=None) -> DataFrame:
    run = materialize(fx.search(retriever or fx.bm25()), "run")
    return mt.per_query_metrics(run, fx.queries, fx.qrels)


def _metric_query(name: str, columns: list[str]) -> None:
    def make(fx: Fixtures) -> DataFrame:
        return _per_query(fx).select("qid", *[F.col(f"`{c}`").alias(c.replace("@", "_at_")) for c in columns])

    make.__name__ = name
    registered(make)


for _metric in mt.CUT_METRICS:
    _metric_query(f"metric_{_metric}", [f"{_metric}@{k}" for k in mt.DEFAULT_KS])
_metric_query("metric_reciprocal_rank", ["mrr"])
_metric_query("metric_average_precision", ["map"])


@registered
def metrics_per_question(fx: Fixtures) -> DataFrame:
    return mt.long_metrics(_per_query(fx))


@registered
def label_relevance_metrics(fx: Fixtures) -> DataFrame:
    """Vector search judged by equal labels: several relevant vectors per question."""
    retriever, asked = _embedding_retriever(fx)
    run = materialize(retriever.search_vectors(asked, 10), "run").withColumn("doc_id", F.col("chunk_id"))
    labels = fx.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), "label")
    counts = labels.groupBy("label").count()
    relevant = (
        run.join(labels.select(F.col("id").alias("qid"), F.col("label").alias("asked")), "qid")
        .join(labels.select(F.col("id").alias("doc_id"), F.col("label").alias("found")), "doc_id")
        .withColumn("rel", F.col("asked") == F.col("found"))
        .join(counts.withColumnRenamed("label", "asked"), "asked")
    )
    return relevant.groupBy("qid").agg(
        (F.sum(F.col("rel").cast("int")) / F.lit(10.0)).alias("precision_at_10"),
        (F.sum(F.col("rel").cast("int")) / F.max("count")).alias("recall_at_10"))


@registered
def run_summary(fx: Fixtures) -> DataFrame:
    return mt.summarize(mt.long_metrics(materialize(_per_query(fx), "per-query")), "value", ["metric"])


@registered
def latency_summary(fx: Fixtures) -> DataFrame:
    return mt.summarize(fx.table("events"), "value", ["event_type"])


@registered
def value_percentiles(fx: Fixtures) -> DataFrame:
    """The plan for groups too large for one percentile buffer."""
    return mt.exact_percentiles(fx.table("events"), "value", (0.5, 0.95), ["event_type"])


@registered
def compared_runs(fx: Fixtures) -> DataFrame:
    """Mean difference per metric, BM25 minus hybrid, over shared questions."""
    a = mt.long_metrics(_per_query(fx)).withColumnRenamed("value", "a")
    b = mt.long_metrics(_per_query(fx, _hybrid(fx))).withColumnRenamed("value", "b")
    return a.join(b, ["qid", "metric"]).groupBy("metric").agg(
        F.avg(F.col("a") - F.col("b")).alias("delta"), F.count("*").alias("n"))


@registered
def bootstrap_intervals(fx: Fixtures) -> DataFrame:
    return rs.bootstrap_ci(mt.long_metrics(_per_query(fx)), ["metric"]).select(
        "metric", *(F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi")))


@registered
def permutation_test(fx: Fixtures) -> DataFrame:
    a = mt.long_metrics(_per_query(fx)).withColumnRenamed("value", "a")
    b = mt.long_metrics(_per_query(fx, fx.dense())).withColumnRenamed("value", "b")
    return rs.paired_permutation(a.join(b, ["qid", "metric"]), ["metric"]).select(
        "metric", "n", *(F.round(c, 6).alias(c) for c in ("delta", "p_value")))


@registered
def evaluated_run(fx: Fixtures) -> DataFrame:
    """The whole evaluation of a run: means and intervals of every metric."""
    run = materialize(fx.search(fx.bm25()), "run")
    return evaluate_run(run, fx.questions, fx.qrels).summary.select("metric", "mean", "ci_lo", "ci_hi")


@registered
def run_comparison(fx: Fixtures) -> DataFrame:
    """Two evaluated runs compared on every metric, with p-values."""
    runs = [materialize(fx.search(r), "run") for r in (fx.bm25(), _hybrid(fx))]
    a, b = (evaluate_run(run, fx.questions, fx.qrels).per_query for run in runs)
    return compare_all(a, b).select("metric", "n", "delta", "p_value")


@registered
def ablation_table(fx: Fixtures) -> DataFrame:
    """Every cell of the grid with intervals of three metrics."""
    cells = [make_setup(c.label, c.chunker, c.retriever, c.rerank) for c in ablation_grid()]
    per_query = _setup_metrics(fx, cells)
    values = mt.long_metrics(per_query.drop("qid").withColumnRenamed("asked", "qid"), keep=["setup"]).where(
        F.col("metric").isin("ndcg@5", "recall@5", "mrr"))
    return rs.bootstrap_ci(values, ["setup", "metric"]).select(
        F.col("setup").alias("label"), "metric", "mean", "ci_lo", "ci_hi")


@registered
def engine_answers(fx: Fixtures) -> DataFrame:
    """Search and answer in one call: three times k fused candidates, reranked to k, answered, scored for faithfulness."""
    engine = Engine(fx.spark)
    engine.chunks, engine.retriever, engine.loaded = fx.chunks(), fusion.HybridRetriever([fx.bm25(), fx.dense()], "rrf", 60), True
    engine.load()
    found = engine.ask(fx.queries, 5, score_faithfulness=True)
    return found.select("qid", "text", F.size("supporting_chunks").alias("n_supporting"), "faithfulness")


@registered
def function_chunks(fx: Fixtures) -> DataFrame:
    """Chunks cut by a Python function: the lines of a text that are not blank."""
    return FunctionChunker("lines", lambda text: [x for x in text.split("\n") if x.strip()]).chunk(fx.documents)


@registered
def jsonl_round_trip(fx: Fixtures) -> DataFrame:
    """Documents written as JSON lines and scanned again with their places; within a file they keep their order."""
    path = new_table_path(fx.spark, "round-trip")
    ordered = fx.documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    jsonl.write_jsonl(ordered, path)
    rows = jsonl.load_corpus(fx.spark, path)
    before = F.lag("doc_id").over(Window.partitionBy(F.regexp_replace("src_pos", ":[0-9]+$", "")).orderBy("src_pos"))
    return rows.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                       F.coalesce(before < F.col("doc_id"), F.lit(True)).alias("in_order"))


def _setup_metrics(fx: Fixtures, setups) -> DataFrame:
    """Metrics per setup and question (asked), one metrics job over the union of the setups' runs.

    Question ids are prefixed by the setup while the runs are stacked.  What setups ask of the same index is searched once.
    """
    shared = fx.shared.for_setups(setups, fx.queries)
    key = F.concat_ws("|", "setup", "qid").alias("qid")
    runs, asked = None, None
    for setup in setups:
        name = F.lit(setup.name).alias("setup")
        run = materialize(setup.build(fx.documents, shared).search(fx.queries), "run").withColumn("setup", name)
        mine = fx.queries.select("qid", name)
        runs = run if runs is None else runs.unionByName(run)
        asked = mine if asked is None else asked.unionByName(mine)
    qrels = asked.join(fx.qrels, "qid").select(key, "doc_id")
    runs = runs.withColumn("qid", key)
    per_query = mt.per_query_metrics(runs, asked.select(key), qrels)
    return per_query.withColumn("setup", F.split_part("qid", F.lit("|"), F.lit(1))).withColumn(
        "asked", F.split_part("qid", F.lit("|"), F.lit(2)))


def _setup_means(fx: Fixtures, setups) -> DataFrame:
    return _setup_metrics(fx, setups).groupBy("setup").agg(
        F.avg("`ndcg@5`").alias("ndcg5_mean"), F.avg("`recall@5`").alias("recall5_mean"),
        F.avg("mrr").alias("mrr_mean"), F.avg("`recall@10`").alias("recall10_mean"))


@registered
def default_setup_means(fx: Fixtures) -> DataFrame:
    return _setup_means(fx, default_setups())


@registered
def ablation_means(fx: Fixtures) -> DataFrame:
    cells = [make_setup(c.label, c.chunker, c.retriever, c.rerank) for c in ablation_grid()]
    return _setup_means(fx, cells)


# --- dataset building -----------------------------------------------------

def _reading_rows(fx: Fixtures) -> DataFrame:
    """Documents as reading-comprehension rows, in document order."""
    words = F.split("text", " ")
    return fx.table("documents").select(
        F.col("doc_id").alias("src_pos"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("title"), F.col("text").alias("context"),
        F.array_join(F.slice(words, 1, 6), " ").alias("question"), F.slice(words, 1, 1).alias("answers"))


@registered
def first_documents(fx: Fixtures) -> DataFrame:
    """Distinct texts, each at its first position."""
    rows = _reading_rows(fx).withColumn("content_id", tx.content_id(F.col("context")))
    return dataset.first_occurrences(rows, "content_id", "src_pos").select("content_id", "src_pos", "title")


@registered
def dataset_documents(fx: Fixtures) -> DataFrame:
    documents, _ = dataset.build_from_rows(_reading_rows(fx))
    return documents.select("doc_id", "title", "source", F.length("text").alias("n_chars"))


@registered
def dataset_questions(fx: Fixtures) -> DataFrame:
    _, questions = dataset.build_from_rows(_reading_rows(fx))
    return questions.select("qid", "question", "answer", F.get("relevant_doc_ids", F.lit(0)).alias("doc_id"))


@registered
def dataset_size(fx: Fixtures) -> DataFrame:
    return fx.documents.agg(F.count("*").alias("n_docs"), F.avg(F.length("text")).alias("mean_chars"))


@registered
def questions_linked_by_title(fx: Fixtures) -> DataFrame:
    """Documents carry their source as title; question n asks for source n."""
    documents = fx.table("documents").select(
        tx.content_id(F.col("text")).alias("doc_id"), F.col("source").alias("title"),
        F.col("doc_id").alias("src_pos"))
    item = F.col("item_id").cast("string")
    asked = fx.table("benchmark").select(
        item.alias("qid"), F.col("text").alias("question"), F.lit("").alias("answer"),
        F.concat(F.lit("src"), item).alias("title"))
    linked = dataset.link_by_title(asked, documents)
    return linked.select("qid", F.get("relevant_doc_ids", F.lit(0)).alias("doc_id"))
