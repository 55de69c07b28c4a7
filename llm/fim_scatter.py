"""Fill-in-the-middle transformation by displacement scatter.

A text is cut at two line ends into prefix, middle and suffix, which move to other places
behind sentinels (``<P>``, ``<S>``, ``<M>``).  A batch of texts is one run of bytes and every byte
moves by the displacement of its piece:

1. one scan over the bytes finds line ends, and sentinels that a text already holds;
2. a difference array holds, at the first byte of each piece, by how much the displacement
   changes there; its cumulative sum is the displacement of every byte;
3. a scatter writes the bytes to their places between the sentinels;
4. the inverse is a gather: the sentinels found in the output alone give its pieces,
   their displacements and so the place that every byte came from.

Where the cuts lie and which form a text takes depends on its id and the seed only, never
on the partitioning, so a lost task repeats itself.  Batches are worked on in runs of about
``RUN_BYTES`` and displaced in blocks of ``BLOCK`` bytes; a longer text is a run of its own.
Nothing is shuffled.

A null or empty text is plain and has no lines; a null id is drawn as the empty string.
Repeated rows give equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches

SEED = 7
RATE = 100
SPM_SHARE = 50
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK = 3
#: Order of the pieces in the output; "P" is the prefix, "M" the middle, "S" the suffix.
ORDERS = {"psm": "PSM", "spm": "SPM"}
RUN_BYTES = 4 << 20
BLOCK = 1 << 20


def marks_in(data: np.ndarray) -> np.ndarray:
    """Where sentinels start in *data* (bytes)."""
    if len(data) < MARK:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(data[:-2] == ord("<"))
    letter = data[at + 1]
    return at[(data[at + 2] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M")))]


def displaced(places: np.ndarray, moves: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, displacement of each byte) block by block; from *places* (ascending) on bytes move by *moves*."""
    steps = np.diff(moves, prepend=0)
    carry = 0
    for start in range(0, size, BLOCK):
        end = min(start + BLOCK, size)
        change = np.zeros(end - start, dtype=np.int64)
        low, high = np.searchsorted(places, [start, end])
        np.add.at(change, places[low:high] - start, steps[low:high])
        shift = np.cumsum(change)
        shift += carry
        carry = int(shift[-1])
        yield start, end, shift


def scatter(data: np.ndarray, places: np.ndarray, moves: np.ndarray, out: np.ndarray) -> None:
    for start, end, shift in displaced(places, moves, len(data)):
        shift += np.arange(start, end)
        out[shift] = data[start:end]


def gather(data: np.ndarray, places: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """The *size* bytes that lie by *moves* away from their own places."""
    out = np.empty(size, dtype=np.uint8)
    for start, end, shift in displaced(places, moves, size):
        shift += np.arange(start, end)
        out[start:end] = data[shift]
    return out


def line_cuts(data: np.ndarray, starts: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines per text, and where its two cuts fall; text i is data[starts[i]:starts[i + 1]]."""
    ends = np.flatnonzero(data == 10)
    low, high = np.searchsorted(ends, starts[:-1]), np.searchsorted(ends, starts[1:])
    sizes = np.diff(starts)
    open_end = (sizes > 0) & (data[np.maximum(starts[1:] - 1, 0)] != 10) if len(data) else sizes > 0
    lines = high - low + open_end
    units = np.sort(draws[:, :2] % (lines + 1)[:, None], axis=1)
    cuts = np.repeat(starts[:-1, None], 2, axis=1)
    inside, whole = (units > 0) & (units <= (high - low)[:, None]), units > (high - low)[:, None]
    rows = np.broadcast_to(low[:, None], units.shape)
    cuts[inside] = ends[rows[inside] + units[inside] - 1] + 1
    cuts[whole] = np.broadcast_to(starts[1:, None], units.shape)[whole]
    return lines, cuts


def transform(data: np.ndarray, starts: np.ndarray, draws: np.ndarray,
              rate: int = RATE, spm: int = SPM_SHARE) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Output bytes, their starts, form, lines and cuts of every text; *draws* are four numbers a text."""
    lines, cuts = line_cuts(data, starts, draws)
    sizes = np.diff(starts)
    plain = (sizes == 0) | (draws[:, 2] % 100 >= rate)
    found = marks_in(data)
    owner = np.searchsorted(starts, found, side="right") - 1
    plain[owner[found + MARK <= starts[owner + 1]]] = True  # a sentinel across two texts is none
    forms = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm, "spm", "psm"))
    out_starts = np.concatenate([[0], np.cumsum(sizes + np.where(plain, 0, 3 * MARK))])
    bounds = np.column_stack([starts[:-1], cuts, starts[1:]])
    piece_sizes = dict(zip("PMS", np.diff(bounds, axis=1).T, strict=True))
    out = np.empty(out_starts[-1], dtype=np.uint8)
    moves = np.repeat((out_starts[:-1] - starts[:-1])[:, None], 3, axis=1)  # of prefix, middle, suffix
    for form, order in ORDERS.items():
        chosen = np.flatnonzero(forms == form)
        at = out_starts[:-1][chosen]
        for piece in order:
            for k, byte in enumerate(MARKS[piece]):
                out[at + k] = byte
            at = at + MARK
            moves[chosen, "PMS".index(piece)] = at - bounds[chosen, "PMS".index(piece)]
            at = at + piece_sizes[piece][chosen]
    scatter(data, bounds[:, :3].ravel(), moves.ravel(), out)
    return out, out_starts, forms.tolist(), lines, cuts


def restore(out: np.ndarray, out_starts: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts again and their starts, from outputs and forms alone."""
    form = np.array(forms)
    sizes = np.diff(out_starts) - np.where(form == "plain", 0, 3 * MARK)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # Of a formed text the first three sentinels are its own: its pieces hold none.
    found = marks_in(out)
    owner = np.searchsorted(out_starts, found, side="right") - 1
    found = found[(form[owner] != "plain") & (found + MARK <= out_starts[owner + 1])]
    formed = np.flatnonzero(form != "plain")
    marks = found.reshape(len(formed), 3)
    places = np.repeat(starts[:-1, None], 3, axis=1)
    moves = np.repeat((out_starts[:-1] - starts[:-1])[:, None], 3, axis=1)
    ends = np.column_stack([marks[:, 1:], out_starts[1:][formed]])
    lengths = ends - marks - MARK
    for name, order in ORDERS.items():
        chosen = form[formed] == name
        rows, at = formed[chosen], starts[:-1][formed[chosen]]
        for column, piece in enumerate("PMS"):
            place = order.index(piece)
            places[rows, column] = at
            moves[rows, column] = marks[chosen, place] + MARK - at
            at = at + lengths[chosen, place]
    return gather(out, places.ravel(), moves.ravel(), int(starts[-1])), starts


def code_points(data: np.ndarray) -> int:
    """UTF-8 characters in *data*."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring texts of about RUN_BYTES together, at least one."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > RUN_BYTES:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes)


def drawn(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, text and four draws h1 to h4 from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return docs.select("doc_id", "text", *(
        F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM_SHARE) -> DataFrame:
    """Per row of *docs* (doc_id, text): doc_id, n (lines), form, prefix_chars, middle_chars, output, restored.

    *rate* and *spm* are percentages: of the texts that are formed, and of those with the suffix in front.
    """
    small_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def form(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            draws = np.column_stack([batch.column(k).to_numpy() for k in range(2, 6)])
            for first, end in runs(np.array([len(x) for x in texts], dtype=np.int64)):
                data = np.frombuffer(b"".join(texts[first:end]), dtype=np.uint8)
                starts = np.concatenate([[0], np.cumsum([len(x) for x in texts[first:end]])]).astype(np.int64)
                out, out_starts, forms, lines, cuts = transform(data, starts, draws[first:end], rate, spm)
                back, back_starts = restore(out, out_starts, forms)
                formed = [f != "plain" for f in forms]
                prefix = [code_points(data[a:b]) if f else None for f, a, b in zip(formed, starts, cuts[:, 0], strict=False)]
                middle = [code_points(data[a:b]) if f else None for f, (a, b) in zip(formed, cuts, strict=True)]
                texts_of = lambda raw, at: pa.array(
                    [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(lines, pa.int64()), pa.array(forms, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), texts_of(out, out_starts),
                     texts_of(back, back_starts)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return drawn(docs, seed).mapInArrow(
        form, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def fim_digest(docs: DataFrame, **options) -> DataFrame:
    """The rows of :func:`fill_in_middle` with SHA-256 digests in place of the texts."""
    def digest(name: str):
        return F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")

    return fill_in_middle(docs, **options).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
