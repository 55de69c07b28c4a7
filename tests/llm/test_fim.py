"""Fill-in-the-middle against plain string slicing, over odd rows and with bytes displaced in small blocks."""

import hashlib
import re

import numpy as np
import pytest
from test_operators import docs_of, words

from llm import fim_scatter


def plain_form(doc_id, text, rate=100, spm=50):
    """The contract in plain slices: n, form, prefix and middle length, output."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb\nc"), (7, "é\n日本\n🙂\n"), (8, "x<P>y\nz"),
    (9, "<\nM>\n<S"), (10, ">tail\n<P"), (11, "> S>\nM>"), (None, "a\nb"), (6, "a\nb\nc"), (12, "a\r\nb\x0bc\n"), (13, "<P" * 5)]


def test_rows(spark):
    rows = [*ROWS, (20, "\n".join(words(40_000, 3))), *((i, "l\n" * (i % 7)) for i in range(21, 300))]
    docs = docs_of(spark, [(i, t, None, None) for i, t in rows]).repartition(2)
    found = fim_scatter.fill_in_middle(docs).collect()
    assert sorted((tuple(r)[:-1] for r in found), key=repr) == sorted(((i, *plain_form(i, t)) for i, t in rows), key=repr)
    texts = sorted(((r["doc_id"], r["restored"]) for r in found), key=repr)
    assert texts == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r["form"] for r in found} == {"plain", "spm", "psm"}
    few = fim_scatter.fill_in_middle(docs, rate=40, spm=0).collect()
    assert sorted((tuple(r)[:-1] for r in few), key=repr) == sorted(((i, *plain_form(i, t, 40, 0)) for i, t in rows), key=repr)
    digests = fim_scatter.fim_digest(docs.where("doc_id = 6")).collect()
    output = plain_form(6, "a\nb\nc")[-1]
    assert len(digests) == 2 and digests[0]["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
    assert digests[0]["restored_sha256"] == hashlib.sha256(b"a\nb\nc").hexdigest()
    assert fim_scatter.fim_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64])
def test_blocks_and_neighbours(monkeypatch, block):
    """Sentinels cut in two by a text's end or a block's end, texts of every length side by side."""
    monkeypatch.setattr(fim_scatter, "BLOCK", block)
    draw = np.random.default_rng(block)
    for _ in range(60):
        texts = ["".join(draw.choice(list("aé\n<>PSM"), draw.integers(0, 30))) for _ in range(draw.integers(1, 12))]
        ids = draw.integers(0, 10 ** 6, len(texts)).tolist()
        hashes = [hashlib.sha256(f"7:{i}".encode()).hexdigest() for i in ids]
        draws = np.array([[int(h[8 * k:8 * k + 8], 16) for k in range(4)] for h in hashes])
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        out, out_starts, forms, lines, _ = fim_scatter.transform(data, starts, draws)
        back, back_starts = fim_scatter.restore(out, out_starts, forms)
        for j, (i, t) in enumerate(zip(ids, texts, strict=True)):
            n, form, _, _, output = plain_form(i, t)
            assert (lines[j], forms[j]) == (n, form)
            assert out[out_starts[j]:out_starts[j + 1]].tobytes().decode() == output
            assert back[back_starts[j]:back_starts[j + 1]].tobytes().decode() == t


def test_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(fim_scatter, "RUN_BYTES", 10)
    assert list(fim_scatter.runs(np.array([4, 4, 4, 30, 0, 0, 9, 2]))) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]
    assert list(fim_scatter.runs(np.array([], dtype=int))) == []
