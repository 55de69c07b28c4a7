import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import scores as sc
from rankloom.functions import text as tx


def column(spark, values, make, schema="v string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


TEXTS = [
    "The quick brown foxes are running", "Über Straße", "Ａ ﬁne ½ №", "한국어 텍스트", "Éléphant_7 naïve",
    "", "  \t  ", "a b　c\x1cd", "İstanbul", "x²y",
]


def test_normalize_is_nfkd_then_lower(spark):
    expected = [unicodedata.normalize("NFKD", t).lower() for t in TEXTS]
    assert column(spark, TEXTS, tx.normalize) == expected


def test_word_tokens_match_python_word_runs(spark):
    expected = [re.findall(r"\w+", unicodedata.normalize("NFKD", t).lower()) for t in TEXTS]
    assert column(spark, TEXTS, lambda c: tx.tokenize(c, remove_stops=False)) == expected


def test_accents_split_words(spark):
    assert column(spark, ["Über"], tx.tokenize) == [["u", "ber"]]


def test_stopwords(spark):
    assert len(tx.STOPWORDS) == 96
    assert column(spark, ["the and or is are", "The quick brown foxes are running"], tx.tokenize) == [
        [], ["quick", "brown", "foxes", "running"]]


@pytest.mark.parametrize(("token", "root"), [
    ("foxes", "fox"), ("action", "action"), ("traction", "trac"), ("countries", "country"), ("items", "item"),
    ("cats", "cats"), ("run", "run"), ("running", "run"), ("making", "make"), ("jumping", "jump"),
    ("kindness", "kind"), ("tension", "ten"), ("stopped", "stop"), ("hoped", "hope"), ("walker", "walk"),
    ("slowly", "slow"), ("boxes", "box"), ("dishes", "dish"), ("glass", "glass"), ("houses", "hous"), ("caches", "cach"),
])
def test_stem(spark, token, root):
    assert column(spark, [token], tx.stem) == [root]


def test_whitespace_split_equals_python(spark):
    assert column(spark, TEXTS, tx.split_whitespace) == [t.split() for t in TEXTS]


def test_strip_and_blank(spark):
    assert column(spark, TEXTS, tx.strip) == [t.strip() for t in TEXTS]
    assert column(spark, TEXTS, tx.is_blank) == [not t.strip() for t in TEXTS]


@pytest.mark.parametrize(("text", "sentences"), [
    ("Dr. Mill bakes. Bread rises! Is it done? Yes.", ["Dr. Mill bakes.", "Bread rises!", "Is it done?", "Yes."]),
    ("Here is no capital. it goes on. Now.", ["Here is no capital. it goes on.", "Now."]),
    ("We met Mr. and Mrs. Smith. They left.", ["We met Mr. and Mrs. Smith.", "They left."]),
    ("Wait... What? 3.5 is a number. end", ["Wait...", "What? 3.5 is a number. end"]),
    ("", []),
])
def test_chunk_sentences(spark, text, sentences):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.chunk_sentences(F.col("t"))).first()[0] == sentences


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(
    ["Dr.", "Mr.", "no.", "Cat", "dog.", "x!", "A.", "b?\"", "U.S.", "e.g.", "(Fig.)", "\n", "9.", "St.", "Ünd."]),
    max_size=12).map(" ".join), min_size=30, max_size=60))
def test_sentences_keep_words_and_respect_abbreviations(spark, texts):
    def bare(text):
        return [w.strip("\"')]") for w in text.split()]

    for text, sentences in zip(texts, column(spark, texts, tx.chunk_sentences), strict=True):
        assert bare(" ".join(sentences)) == bare(text)
        assert all("A" <= s[0] <= "Z" for s in sentences[1:])
        assert not any(s.split()[-1].strip("().").lower() in ("dr", "mr", "st") for s in sentences[:-1])
    for text, sentences in zip(texts, column(spark, texts, tx.answer_sentences), strict=True):
        assert " ".join(sentences).split() == text.split()
        assert all(s[-1] in ".?!" for s in sentences[:-1])


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a", "a"], ["a"])],
                               "l array<string>, r array<string>")
    assert [r[0] for r in df.select(tx.jaccard(F.col("l"), F.col("r"))).collect()] == [1 / 3, 0.0, 1.0]


def test_snippet_and_content_id(spark):
    import hashlib

    long = "ab\n" * 60
    assert column(spark, [long, "x\ny"], tx.snippet) == [long[:120].replace("\n", " ") + "…", "x y"]
    assert column(spark, ["é"], tx.content_id) == [hashlib.sha1("é".encode()).hexdigest()[:12]]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(sc.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(sc.dot(F.col("v"), F.col("v"))).first()[0] == 25.0
    got = df.select(sc.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))).first()[0]
    assert got == pytest.approx([1 / 3] * 3)
    short = df.select(sc.entailment_probability(F.array(F.lit(1.0)))).first()[0]
    assert short == 0.0


def test_sigmoid_is_clipped(spark):
    low, mid, high = column(spark, [-1e6, 0.0, 1e6], sc.sigmoid, "v double")
    assert 0.0 < low < 1e-30 and mid == 0.5 and high == 1.0


def test_weights():
    assert sc.normalized_weights(None, 4) == [0.25] * 4
    assert sc.normalized_weights([8, 2], 2) == [0.8, 0.2]
    with pytest.raises(ValueError):
        sc.normalized_weights([0, 0], 2)
