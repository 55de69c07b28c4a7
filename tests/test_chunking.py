import pytest

from rankloom.operators.chunking import (
    FixedSizeChunker,
    FunctionChunker,
    SentenceWindowChunker,
    chunk_corpus,
)


def one(spark, chunker, text):
    return chunker.chunk(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("index").collect()


@pytest.mark.parametrize(("n", "size", "overlap"), [(1, 5, 2), (5, 5, 2), (200, 200, 40), (201, 200, 40), (47, 10, 3)])
def test_fixed_windows(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    step = size - overlap
    rows = one(spark, FixedSizeChunker(size, overlap), "  ".join(words))
    assert [r["text"] for r in rows] == [" ".join(words[s:s + size]) for s in range(0, n, step)]
    assert [r["word_start"] for r in rows] == list(range(0, n, step))
    assert [r["word_end"] for r in rows] == [min(s + size, n) - 1 for s in range(0, n, step)]
    assert [r["chunk_id"] for r in rows] == [f"d::fixed::{i}" for i in range(len(rows))]


def test_sentence_windows(spark):
    text = "One is. Two is. Three is. Four is. Five is. Six is."
    rows = one(spark, SentenceWindowChunker(3, 2), text)
    assert [(r["sent_start"], r["sent_end"], r["num_sentences"]) for r in rows] == [(0, 2, 3), (2, 4, 3), (4, 5, 2)]
    assert rows[2]["text"] == "Five is. Six is."
    assert rows[1]["chunk_id"] == "d::sentence_window::1"


def test_abbreviation_is_no_boundary(spark):
    assert len(one(spark, SentenceWindowChunker(1, 1), "Dr. Smith came. He left.")) == 2


@pytest.mark.parametrize("chunker", [FixedSizeChunker(), SentenceWindowChunker()])
def test_blank_text_has_no_chunks(spark, chunker):
    assert one(spark, chunker, " \n ") == []


@pytest.mark.parametrize("make", [
    lambda: FixedSizeChunker(10, 10), lambda: FixedSizeChunker(0, 0), lambda: SentenceWindowChunker(2, 0),
    lambda: SentenceWindowChunker(2, 3)])
def test_bad_sizes(make):
    with pytest.raises(ValueError):
        make()


def test_function_chunker(spark):
    rows = one(spark, FunctionChunker("halves", lambda t: [t[:2], t[2:]]), "abcd")
    assert [(r["chunk_id"], r["text"]) for r in rows] == [("d::halves::0", "ab"), ("d::halves::1", "cd")]


def test_empty_corpus(spark):
    with pytest.raises(ValueError):
        chunk_corpus(spark.createDataFrame([], "doc_id string, text string"), FixedSizeChunker())


def test_chunking_is_one_stage_without_shuffle(spark, documents):
    plan = FixedSizeChunker().chunk(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
