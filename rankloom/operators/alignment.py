"""Entailment by alignment: which sentence of the evidence says what a sentence of the answer says, word after word.

The words of an answer sentence are aligned in order with those of every sentence of the
premise; the heaviest alignment's share of all its words' weight is the support.  A word
weighs more the fewer sentences of the premise have it, and words no sentence has weigh most,
so what the evidence lacks costs more than what it repeats.  The best supporting sentence (the
first of equal ones) contradicts where one of the two is negated and the other is not, or
where each gives a number that the other lacks.

The dynamic programme runs inside the row: one array as long as the premise sentence, updated
once per answer word, so memory is bounded by the premise's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import scores as sc
from rankloom.functions import text as tx
from rankloom.operators.encoders import OVERLAP_CLAMP, clamped_share

NEGATIONS = ("no", "not", "never", "none", "nobody", "nothing", "neither", "nor", "cannot", "without")
SHORT_NEGATION = "n['’]t"
NUMBER = "^[0-9]+$"


def _described(sentence: Column) -> Column:
    """words, numbers, and whether the sentence holds an odd number of negations."""
    def described(words: Column) -> Column:
        n_negations = F.size(F.filter(words, lambda w: w.isin(*NEGATIONS))) + F.regexp_count(
            F.lower(sentence), F.lit(SHORT_NEGATION))
        return F.struct(words.alias("words"), F.filter(words, lambda w: w.rlike(NUMBER)).alias("numbers"),
                        (n_negations % 2 == 1).alias("negated"))

    return tx.bind(tx.overlap_tokens(sentence), described)


def word_weights(words: Column, held: Column) -> Column:
    """word, weight of every word: ln(1 + (sentences + 1) / (sentences that have it + 1))."""
    def weight(word: Column) -> Column:
        having = F.size(F.filter(held, lambda s: F.array_contains(s["words"], word)))
        return F.log1p((F.size(held) + 1) / (having + 1))

    return F.transform(words, lambda w: F.struct(w.alias("word"), weight(w).alias("weight")))


def aligned_weight(weighted: Column, words: Column) -> Column:
    """Weight of the heaviest alignment of *weighted* (word, weight) with *words* that keeps both orders; 0 without any."""
    def update(best: Column, item: Column) -> Column:
        def ending_at(word: Column, place: Column) -> Column:
            before = F.coalesce(F.array_max(F.slice(best, F.lit(1), place)), F.lit(0.0))
            return F.when(word == item["word"], F.greatest(F.get(best, place), before + item["weight"])).otherwise(F.get(best, place))

        return F.transform(words, ending_at)

    best = F.aggregate(weighted, F.transform(words, lambda _: F.lit(0.0)), update)
    return F.coalesce(F.array_max(best), F.lit(0.0))


def _clash(asked: Column, held: Column) -> Column:
    numbers = (F.size(F.array_except(asked["numbers"], held["numbers"])) > 0) & (
        F.size(F.array_except(held["numbers"], asked["numbers"])) > 0)
    return (asked["negated"] != held["negated"]) | numbers


def _logits(share: Column, clash: Column) -> Column:
    """[contradiction, entailment, neutral]: the softmax gives the share to one of the first two and the rest to neutral."""
    impossible = F.lit(1.0) * sc.logit(F.lit(OVERLAP_CLAMP))
    return tx.bind(sc.logit(clamped_share(share)), lambda odds: F.array(
        F.when(clash, odds).otherwise(impossible), F.when(clash, impossible).otherwise(odds), F.lit(0.0)))


def alignment_nli(premise: Column, sentences: Column) -> Column:
    """Logits of every sentence; all equal for a sentence without words.  An empty premise supports nothing."""
    def against(held: Column) -> Column:
        def best(asked: Column) -> Column:
            def weighed(weighted: Column) -> Column:
                total = F.aggregate(weighted["weight"], F.lit(0.0), lambda acc, w: acc + w)
                found = F.array_max(F.transform(held, lambda s, place: F.struct(
                    F.try_divide(aligned_weight(weighted, s["words"]), total).alias("share"), (-place).alias("place"),
                    _clash(asked, s).alias("clash"))))
                return tx.bind(found, lambda f: _logits(F.coalesce(f["share"], F.lit(0.0)), F.coalesce(f["clash"], F.lit(False))))

            return F.when(F.size(asked["words"]) == 0, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).otherwise(
                tx.bind(word_weights(asked["words"], held), weighed))

        return F.transform(F.transform(sentences, _described), best)

    return tx.bind(F.transform(tx.answer_sentences(premise), _described), against)
