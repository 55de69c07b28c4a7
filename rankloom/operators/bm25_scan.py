"""Scoring inside tasks: a tile of questions against chunks with their matching postings.

A row is a chunk with the postings that any question of the tile shares, or with its tokens.  Rows are taken in blocks of a bounded number
of cells (chunk times question) and contributions.  Terms that most cells of a batch have are multiplied as matrices, the contributions
of others are added up by cell; a block's scores are one array, of which only what reaches a question's
k-th best score so far is kept.  Ties are settled by chunk id, as in the final ranking, so copies never pile up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from rankloom.functions.scores import SCORE_DIGITS

CELLS = 250_000  # cells or contributions of a block: its arrays stay in a core's cache
GROUP = 2_048  # questions scored together
MOST_COMMON = 256  # terms multiplied as matrices, and share of the cells from which a term is
COMMON_SHARE = 1 / 128
MANY = 16  # floors are raised before candidates are held that are more than this part of the best k
HELD = 200_000  # candidates held, beside twice the best k, before they are ranked
SLACK = 1e-8  # scores are rounded at nine digits, so what ranks equal differs by less

HITS = "qid string, chunk_id string, doc_id string, score double"
_HITS_ARROW = pa.schema([("qid", pa.string()), ("chunk_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])
_HELD_ARROW = pa.schema([("q", pa.int64()), ("rounded", pa.float64()), ("chunk_id", pa.string()), ("doc_id", pa.string()),
                         ("score", pa.float64())])


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values (null is one) and the place of each row's value among them."""
    encoded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)


@dataclass(frozen=True)
class QuestionTile:
    """Weighted terms of some questions: the questions of term t are at ``starts[t]`` to ``starts[t + 1]``."""

    qids: pa.Array
    terms: pa.Array
    starts: np.ndarray
    questions: np.ndarray
    weights: np.ndarray
    blocks: np.ndarray | None  # blocks by questions, true where the block is to be scored; None for all

    @classmethod
    def of(cls, rows: pa.Table, bits: pa.Table | None = None, n_blocks: int = 0) -> "QuestionTile":
        """From (qid, term, weight) rows and (qid, bits) rows of :func:`block_bits`."""
        qids, q = _numbered(rows["qid"])
        terms, t = _numbered(rows["term"])
        order = np.argsort(t, kind="stable")
        blocks = None
        if bits is not None:
            place = {qid: i for i, qid in enumerate(qids.to_pylist())}
            blocks = np.zeros((n_blocks, len(qids)), dtype=bool)
            for qid, held in zip(bits["qid"].to_pylist(), bits["bits"].to_pylist()):
                if qid in place:
                    blocks[:, place[qid]] = np.unpackbits(np.frombuffer(held, dtype=np.uint8), count=n_blocks)
        return cls(qids, terms, np.searchsorted(t[order], np.arange(len(terms) + 1)), q[order],
                   rows["weight"].to_numpy()[order], blocks)

    def numbered(self) -> pa.Table:
        """term, number: what a posting needs to find its questions."""
        return pa.table({"term": self.terms.cast(pa.string()), "number": pa.array(np.arange(len(self.terms)), pa.int32())})


def block_bits(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """qid, bits: the blocks of each question in a (qid, block) table as one string of bits."""
    def packed(table: pa.Table) -> pa.Table:
        held = np.zeros(n_blocks, dtype=bool)
        held[table["block"].to_numpy()] = True
        return pa.table({"qid": table["qid"].slice(0, 1), "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})

    return blocks.select("qid", "block").groupBy("qid").applyInArrow(packed, "qid string, bits binary")


def count_terms(held: pa.ListArray, value_set: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct terms of every row of *held*, lists of (dl, tokens): row, dl, place among the terms and count of each, by row,
    and the terms: those met, or *value_set*, beside which others do not count.  Token arrays of one row and length count together."""
    parts = held.flatten()
    row = np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    dl, tokens = parts.field(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), parts.field(1)
    order = np.lexsort((dl, row))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(row[order]) != 0) | (np.diff(dl[order]) != 0)
    whole = np.empty(len(order), dtype=np.int64)  # the parts that count together
    whole[order] = np.cumsum(first) - 1
    words = tokens.flatten().dictionary_encode()
    terms, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
    place = np.repeat(whole, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    if value_set is not None:
        code = pc.index_in(terms, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False)[code]
        terms, place, code = value_set, place[code >= 0], code[code >= 0]
    width = max(1, len(terms))
    key, tf = np.unique(place * width + code, return_counts=True)
    at = order[first][key // width]
    return row[at], dl[at], key % width, tf.astype(np.int64), terms


def _matches(batch: pa.RecordBatch, value_set: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number, tf and dl of each posting, in the order of the rows."""
    held = batch.column(3)
    if value_set is None:
        flat = held.flatten()
        row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy(zero_copy_only=False))
        return row, *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    row, dl, number, tf, _ = count_terms(held, value_set)
    return row, number, tf.astype(np.float64), dl.astype(np.float64)


class _Best:
    """Running best k per question by (rounded score desc, chunk id asc)."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.floor = np.zeros(questions)  # scores are positive
        self.top = np.zeros((questions, max(0, k)))  # the best scores met while they were many
        self.held: list[pa.Table] = []
        self.n = 0

    def add(self, at: np.ndarray, q: np.ndarray, found: np.ndarray, chunk_ids: pa.Array, doc_ids: pa.Array, asked: slice) -> None:
        """Scores of chunks (rows *at*) for questions, which are among *asked*; a chunk comes once."""
        if self.k < 1:
            return
        wanted = found > self.floor[q]
        at, q, found = at[wanted], q[wanted], found[wanted]
        if len(at) * MANY > self.top[asked].size:
            self._raise_floors(q, found, asked)
            wanted = found > self.floor[q]  # what ties with the k-th stays and is settled by chunk id
            at, q, found = at[wanted], q[wanted], found[wanted]
        if not len(at):
            return
        self.held.append(pa.Table.from_arrays([pa.array(q), pa.array(np.round(found, SCORE_DIGITS)), chunk_ids.take(pa.array(at)),
                                               doc_ids.take(pa.array(at)), pa.array(found)], schema=_HELD_ARROW))
        self.n += len(at)
        if self.n > HELD + 2 * self.k * len(self.floor):
            self.rank()

    def _raise_floors(self, q: np.ndarray, found: np.ndarray, asked: slice) -> None:
        top = self.top[asked]
        who = np.concatenate([np.repeat(np.arange(len(top)), self.k), q - asked.start])
        score = np.concatenate([top.ravel(), found])
        order = np.lexsort((-score, who))
        begin = np.searchsorted(who[order], np.arange(len(top)))
        self.top[asked] = score[order[begin[:, None] + np.arange(self.k)]]
        self.floor[asked] = np.maximum(self.floor[asked], self.top[asked, -1] - SLACK)

    def rank(self) -> pa.Table:
        table = pa.concat_tables(self.held) if self.held else _HELD_ARROW.empty_table()
        table = table.take(pc.sort_indices(table, [("q", "ascending"), ("rounded", "descending"), ("chunk_id", "ascending")],
                                           null_placement="at_start"))
        q = table["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        table = table.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(table["rounded"].to_numpy()[place[place < self.k] == self.k - 1] - SLACK, 0.0)
        self.held, self.n = [table], len(table)
        return table


def _block_ends(cost: np.ndarray) -> list[int]:
    """Ends of runs of rows that cost about ``CELLS`` each."""
    run = np.cumsum(cost) // CELLS
    return [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(cost)]


@dataclass(frozen=True)
class _Group:
    """The weighted terms of the questions from *first* on."""

    first: int
    n_questions: int
    starts: np.ndarray
    questions: np.ndarray
    weights: np.ndarray


def _groups(starts: np.ndarray, questions: np.ndarray, weights: np.ndarray, n_questions: int) -> list[_Group]:
    term, found = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), []
    for first in range(0, n_questions, GROUP):
        n = min(GROUP, n_questions - first)
        own = np.flatnonzero((questions >= first) & (questions < first + n))
        found.append(_Group(first, n, np.searchsorted(term[own], np.arange(len(starts))), questions[own] - first, weights[own]))
    return found


def _cell_sums(cell: np.ndarray, value: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Sums of *value* by cell, rows by columns."""
    return np.bincount(cell, value, rows * columns).astype(np.float64, copy=False).reshape(rows, columns)  # of nothing it counts integers


class _Scorer:
    """Scores of the rows of a batch, whose postings have the terms *number*, for a group of questions."""

    def __init__(self, group: _Group, n_rows: int, number: np.ndarray) -> None:
        starts, questions, weights, n_questions = group.starts, group.questions, group.weights, group.n_questions
        self.starts, self.questions, self.weights, self.n_questions = starts, questions, weights, n_questions
        asked = np.diff(starts)
        share = np.bincount(number, minlength=len(asked)) / n_rows * (asked / n_questions)  # of the cells
        common = np.flatnonzero(share >= COMMON_SHARE)
        common = common[np.argsort(-share[common], kind="stable")[:min(MOST_COMMON, CELLS // n_questions)]]
        self.column = np.full(len(asked), -1)
        self.column[common] = np.arange(len(common))
        entry = np.repeat(self.column, asked)  # of each weight
        at = entry >= 0
        self.common = _cell_sums(entry[at] * n_questions + questions[at], weights[at], len(common), n_questions)
        self.others = np.where(self.column < 0, asked, 0)  # contributions of a posting of the term

    def scores(self, n: int, row: np.ndarray, number: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Rows by questions, from the postings of *n* rows; 0 where they share nothing."""
        per = self.others[number]
        step = np.arange(per.sum()) + np.repeat(self.starts[number] - (np.cumsum(per) - per), per)
        cell = np.repeat(row * self.n_questions, per) + self.questions[step]
        scores = _cell_sums(cell, np.repeat(part, per) * self.weights[step], n, self.n_questions)
        if len(self.common):
            column = self.column[number]
            at, width = column >= 0, len(self.common)
            scores += _cell_sums(row[at] * width + column[at], part[at], n, width) @ self.common
        return scores


def scan(shared: Broadcast, k: int, k1: float, b: float, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over (chunk_id, doc_id, block, list of (number, tf, dl), or of (dl, tokens)) rows, returning its best *k* per question."""
    def best_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, qids, starts, questions, weights, blocks = shared.value
        best, groups = _Best(len(qids), k), _groups(starts, questions, weights, len(qids))
        for batch in batches:
            if not batch.num_rows:
                continue
            row, number, tf, dl = _matches(batch, value_set)
            part = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for group in groups:
                scorer = _Scorer(group, batch.num_rows, number)
                cost = np.diff(np.concatenate([[0], np.cumsum(scorer.others[number])])[ends])
                asked, begin = slice(group.first, group.first + group.n_questions), 0
                for end in _block_ends(np.maximum(group.n_questions, cost)):
                    here = slice(ends[begin], ends[end])
                    scores = scorer.scores(end - begin, row[here] - begin, number[here], part[here])
                    if blocks is not None:
                        scores[~blocks[batch.column(2).slice(begin, end - begin).to_numpy(), asked]] = 0.0
                    at, q = np.divmod(np.flatnonzero(scores > best.floor[asked]), group.n_questions)
                    best.add(at + begin, q + group.first, scores[at, q], batch.column(0), batch.column(1), asked)
                    begin = end
        kept = best.rank().combine_chunks()
        for held in kept.to_batches():
            yield pa.RecordBatch.from_arrays([qids.take(held["q"]).cast(pa.string()), held["chunk_id"], held["doc_id"], held["score"]],
                                             schema=_HITS_ARROW)

    return best_hits
