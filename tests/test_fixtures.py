"""The judgements: documents that contain a whole passage, found by the keys of their windows."""

from pyspark.sql import functions as F

from catalog.fixtures import KEY_WORDS, Fixtures, window_keys


def test_window_keys(spark):
    """One key a window, equal for equal words wherever they stand, none for texts that are too short."""
    words = [f"w{i % 11}" for i in range(30)]
    rows = spark.createDataFrame([(words,), (words[3:3 + KEY_WORDS],), (words[:KEY_WORDS - 1],), ([],), (None,)], "words array<string>")
    whole, part, short, none, null = (r[0] for r in rows.select(window_keys(F.col("words"))).collect())
    assert len(whole) == 30 - KEY_WORDS + 1 and len(set(whole)) == 11
    assert part == whole[3:4] and short == none == [] and null is None


def test_qrels_are_the_documents_with_the_passage(spark, tmp_path):
    words = [f"word{i}" for i in range(40)]
    texts = {1: " ".join(words), 2: "x" + " ".join(words[5:20]) + "y", 3: " ".join(words[5:14]), 4: "", 5: None, 6: "word5\nword6", 7: " ".join(words[::-1])}
    passages = {1: " ".join(words[5:20]), 2: " ".join(words[5:16]), 3: "ord5 word6 wor", 4: "word5", 5: "word39 word38 word37", 6: "absent " * 12}
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r["qid"], r["doc_id"]) for r in Fixtures(spark, str(tmp_path)).qrels.collect()}
    assert found == {(str(q), str(d)) for q, p in passages.items() for d, t in texts.items() if t is not None and p in t}
