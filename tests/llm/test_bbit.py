"""b-bit MinHash against exact Jaccard over all pairs, with open buckets, hot groups and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs_of, words

from llm import bbit_minhash as bb
from llm.cells import open_cells


def plain_set(text):
    found = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))} if found else set()


def expected(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing everything with everything."""
    sets = [plain_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(s), least.get(find(i)), r[0] == least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def varied(base, seed, changes):
    draw = random.Random(seed)
    out = list(base)
    for at in draw.sample(range(len(out)), changes):
        out[at] = f"z{draw.randrange(10 ** 6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    base, other = words(400, 1, 5_000), words(120, 2, 5_000)
    # Around the bound: a changed word changes three shingles, so 400 words with 10 changes lie near 0.86, with 12 near 0.84.
    near = [(100 + i, varied(base, i, 4 + i % 10)) for i in range(60)]
    far = [(300 + i, varied(other, i, 2 + i % 3)) for i in range(40)]
    copies = [(500 + i % 9, "The same words again and again, of one hot group.") for i in range(60)]
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "One\x0btwo\rthree"),
           (9, "ÀÉ x"), (10, "àé x"), (None, "one two three"), (None, "alone without an id here"), (4, "one"), (11, " ".join(words(30_000, 9)))]
    return near + far + copies + odd


def result(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_components(spark, rows):
    docs = docs_of(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    want = expected(rows)
    assert result(bb.minhash_components(docs)) == want
    assert result(bb.minhash_components(docs, cell_rows=4)) == want
    assert len({r[2] for r in want}) > 15 and bb.minhash_components(docs.limit(0)).count() == 0


def test_other_bounds(spark, rows):
    docs = docs_of(spark, [(i, t, None, None) for i, t in rows[:100]])
    assert result(bb.minhash_components(docs, percent=92)) == expected(rows[:100], 92)


def test_open_buckets_alone(spark, rows):
    """Cells find what stars would: all sets in one bucket and no link given."""
    some = [(i, t) for i, t in rows[:80]]
    docs = docs_of(spark, [(i, t, None, None) for i, t in some])
    nodes = bb.signatures(docs, 3).where("node IS NOT NULL").dropDuplicates(["node"])
    shared = nodes.select(F.lit(1).cast("long").alias("bucket"), "node", F.lit(9).alias("n"), F.lit(0).alias("mixed"),
                          F.lit(b"a").alias("first"), F.lit(b"b").alias("last"))
    none = spark.createDataFrame([], "node binary, root binary")
    for cell_rows in (2_048, 7):
        links = bb.crowd_links(shared, none, nodes, docs, 85, 3, cell_rows).collect()
        of = {bytes(r["node"]): r["doc_id"] for r in nodes.collect()}
        root = {i: i for i, _ in some}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[find(of[bytes(a)])] = find(of[bytes(b)])
        want = {i: c for i, _, c, _ in expected(some)}
        assert {(find(i) == find(j)) == (want[i] == want[j]) for i in root for j in root} == {True}


def test_cells_hold_all_pairs_of_groups(spark):
    members = [(1, bytes([i]), bytes([i // 30]), 1) for i in range(60)] + [(1, bytes([i]), bytes([i]), 1) for i in range(60, 75)] + [
        (2, b"x", b"x", 1), (2, b"y", b"x", 1), (3, b"x", b"x", 50), (3, b"y", b"y", 1)]
    frame = spark.createDataFrame(members, "bucket int, node binary, group binary, weight int")
    cells = {}
    for r in open_cells(frame, 8).collect():
        cells.setdefault((r["bucket"], r["i"], r["j"]), []).append((bytes(r["node"]), bytes(r["group"])))
    met = {(k[0], a, b) for k, rows in cells.items() for a, _ in rows for b, _ in rows}
    assert all((x[0], x[1], y[1]) in met for x in members for y in members if x[0] == y[0] and x[2] != y[2])
    assert not any(k[0] == 2 for k in cells) and max(map(len, cells.values())) < 40
    assert open_cells(frame.limit(0)).count() == 0


def test_signature_estimates(spark):
    """Packed bits agree in numpy and in columns, and the corrected estimate is right on the mean."""
    # Each pair has a text of its own: pairs of one text would share its minima and err together.
    bases = [words(600, 100 + i, 10 ** 6) for i in range(40)]
    pairs = [(base, varied(base, i, changes).split()) for changes in (0, 20, 60) for i, base in enumerate(bases)]
    rows, true = [], []
    for a, b in pairs:
        x, y = (" ".join(t).encode() for t in (a, b))
        bits = [bb.signature(t, 3)[3] for t in (x, y)]
        rows.append((len(true), *bits))
        sa, sb = set(bb.shingle_set(x, 3).tolist()), set(bb.shingle_set(y, 3).tolist())
        true.append(len(sa & sb) / len(sa | sb))
        least = [bb.minima(bb.shingle_set(t, 3)) & np.uint64(15) for t in (x, y)]
        rows[-1] += (int((least[0] == least[1]).sum()),)
    frame = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, m int")
    found = frame.select("i", "m", bb.equal_places(F.col("a"), F.col("b")).alias("n")).select(
        "i", "m", "n", bb.estimate(F.col("n")).alias("e")).collect()
    assert all(r["m"] == r["n"] for r in found)
    errors = np.array([r["e"] - true[r["i"]] for r in found])
    assert abs(errors.mean()) < 0.012 and errors[:40].max() == 0 and abs(errors).max() < 0.2


def test_intersections():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 40))) for _ in range(30)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    for columns in (4_096, 7):
        found = bb.intersections(sets, columns)
        assert all(found[i, j] == want[i][j] for i in range(30) for j in range(30) if i != j)
