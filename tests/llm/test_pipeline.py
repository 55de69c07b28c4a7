"""The stages one after another over the smallest tables, each held against what its input asks for."""

import os

import pytest
from test_operators import check_shards, plain_hits

import corpus_pipeline
from pyspark.sql import functions as F
from rankloom.runtime import materialize, scratch_dir

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def shingle_set(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    docs = materialize(stages["language_id"](spark, docs, FOLDER), "t")
    after = {r["doc_id"] for r in docs.collect()}
    assert docs.columns == columns and all(any(c.isalpha() for c in before[i]) for i in after)
    assert len(after) >= 0.98 * len(before)

    docs = materialize(stages["simhash_near_dedup"](spark, docs, FOLDER), "t")
    kept = {r["doc_id"] for r in docs.collect()}
    sets = {i: shingle_set(before[i]) for i in after}
    near = {i: [j for j in after if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in after}
    assert docs.columns == columns and kept == {i for i in after if not near[i]}

    docs = materialize(stages["benchmark_decontamination"](spark, docs, FOLDER), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in docs.collect()}
    assert docs.columns == columns and clean == {i for i in kept if not plain_hits(before[i], items)[1]}

    docs = materialize(stages["poisson_mixing"](spark, docs, FOLDER), "t")
    mixed = docs.collect()
    assert docs.columns == columns and {r["doc_id"] for r in mixed} <= clean and all(before[r["doc_id"]] == r["text"] for r in mixed)

    docs = stages["hilbert_sharding"](spark, docs, FOLDER)
    check_shards(docs.collect(), 24, len(mixed))


def test_odd_tables_end_to_end(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names through all stages; only the result is left behind."""
    plain = " ".join(f"the quick brown fox number {i} jumps over the lazy dog and runs" for i in range(12))
    other = " ".join(f"many people in the old town say that week {i} was warm and calm" for i in range(12))
    long = " ".join(f"line {i} of a very long report about the harbour and its ships" for i in range(6_000))
    item = " ".join(f"benchmark passage word{i}" for i in range(12))
    texts = [plain, plain, other, long, None, "", "12 34 !?", f"{other} {item} {other}", plain]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 1]
    rows = spark.createDataFrame([(i, t, "en" if t else None, "web" if n % 2 else None) for n, (i, t) in enumerate(zip(ids, texts, strict=True))],
                                 "doc_id long, text string, lang string, source string")
    clashing = ("shard", "slot", "size", "curve", "key", "digest", "node", "root", "copies")
    rows = rows.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in clashing))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("hilbert_sharding-")
    assert {r["doc_id"] for r in found} <= {1, 3, 4} and all(r[c] == f"{c}-{r['doc_id']}" for r in found for c in clashing)
    assert all(r["text"] == texts[ids.index(r["doc_id"])] for r in found)


def test_empty_table_end_to_end(spark, tmp_path):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and found.columns[:len(rows.columns)] == rows.columns
