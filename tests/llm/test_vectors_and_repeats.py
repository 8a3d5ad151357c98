"""Hard negatives, repeated passages and whitening against brute force, on odd rows and on the smallest test tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfidelity.llm import hard_negatives, substring_dedup, whitening

from ..conftest import SMALL

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed=0, groups=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    return [(int(i), [float(v) for v in np.float32(centres[i % groups] + 0.4 * r.normal(size=d))], int(r.integers(0, 10))) for i in range(n)]


def usable(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]


# Hard negatives


def brute_negatives(rows, every=100, k=5):
    rows = [r for r in usable(rows) if r[0] is not None and r[2] is not None]
    d = max((len(r[1]) for r in rows), default=0)
    x = [[int(np.floor(256 * v)) for v in r[1]] + [0] * (d - len(r[1])) for r in rows]
    label = [(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows]
    out = []
    for i, anchor in enumerate(rows):
        if anchor[0] % every:
            continue
        score = [sum(a * b for a, b in zip(x[i], y, strict=True)) for y in x]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], rows[j][0]))
        for j in [j for j in order if label[j] == label[i]][:k]:
            fits = [m for m in order if label[m] != label[i] and 80 * score[j] <= 100 * score[m] <= 100 * score[j]]
            out += [(anchor[0], rows[j][0], rank, rows[m][0], score[j], score[m]) for rank, m in enumerate(fits[:k], 1)]
    return sorted(out)


def mined(spark, rows, p):
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("row", "x", "a", "b", "part", "parts", "group", "score", "key")})
    return sorted(map(tuple, hard_negatives.mine(df, p=p).collect()))


def test_hard_negatives_are_those_of_brute_force(spark):
    rows = vectors(400, 6)
    odd = [(500, None, 1), (600, [0.5] * 6, None), (700, [float("nan")] * 6, 2), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0], 2), (None, [0.5] * 6, 3), (900, [], 3), (1000, [0.1, 0.2], 4)]
    ties = [(2000 + i, rows[100][1], i % 3) for i in range(30)] + [(100, rows[100][1], rows[100][2])] * 3
    for p in (hard_negatives.Mining(), hard_negatives.Mining(sample=50, cell_rows=4, part_rows=40, group_codes=2, block_anchors=3)):
        got = mined(spark, rows + odd + ties, p)
        assert got == brute_negatives(rows + odd + ties) and len(got) > 20


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    rows = [(i, [float(np.float32((1 << 19) * (1 + i / 1000))), float(i)], i % 2) for i in range(0, 300, 20)]
    assert mined(spark, rows, hard_negatives.Mining(sample=4)) == brute_negatives(rows)
    assert mined(spark, [], hard_negatives.Mining()) == mined(spark, [(100, [1.0], 1)], hard_negatives.Mining()) == []
    with pytest.raises(ValueError):
        mined(spark, [(i, [1e9] * 8, 0) for i in range(3)], hard_negatives.Mining())


def test_cells_are_visited_by_falling_bounds_and_skipped_when_certified():
    r = np.random.default_rng(1)
    u, v = r.normal(size=7), r.normal(size=5)
    seen = list(hard_negatives.visit(u, v))
    assert [s[0] for s in seen] == sorted((float(a + b) for a in u for b in v), reverse=True)
    assert len({s[1:] for s in seen}) == 35


# Repeated passages


def brute_repeats(rows, size):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out.append((doc, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeats(spark, rows, p=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "name", "start", "spans", "starts", "sha", "kind", "hot")})
    return sorted(map(tuple, substring_dedup.deduplicated(df, p or substring_dedup.Repeats()).collect()), key=repr)


def passages(seed, texts=60):
    """Texts of few words, runs, periods, copies and shared passages."""
    r = random.Random(seed)
    few, many = [f"w{i}" for i in range(3)], [f"v{i}" for i in range(300)]
    shared = [[r.choice(many) for _ in range(r.choice((19, 20, 21, 35, 90)))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, " ".join(shared[0])), (4, "a " * 70), (5, "b a " * 50 + "a " * 33), (6, "x " + "a " * 41 + "y"), (7, "a b c d e f g " * 30)]
    for i in range(texts):
        words = []
        while len(words) < r.choice((5, 40, 200)):
            kind = r.random()
            words += r.choice(shared) if kind < 0.3 else [r.choice(few)] * r.randrange(1, 30) if kind < 0.4 else [r.choice(few) for _ in range(12)] if kind < 0.6 else [r.choice(many) for _ in range(15)]
        rows.append((100 + i, r.choice((" ", "\n", "\t ")).join(words)))
    long = " ".join(r.choice(many) for _ in range(30_000))
    return rows + [(300, long), (301, long), (302, "new " + long[: len(long) // 2] + " end"), (303, long[5000:60_000])]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_brute_force(spark, seed):
    rows = passages(seed)
    for p in (substring_dedup.Repeats(), substring_dedup.Repeats(window=7, key_rounds=4, span_round=5, span_every=1, often=1, chunk_bytes=50, slice_chars=400)):
        assert repeats(spark, rows, p) == brute_repeats(rows, p.window)


def test_repeated_rows_and_tables_without_words(spark):
    text = " ".join(f"u{i}" for i in range(40))
    got = repeats(spark, [(5, text), (5, text), (5, text + " more"), (9, text)])
    one = {r[2] for r in got if r[0] == 9}
    assert one == {40} and [r[1] for r in got if r[0] == 5].count(40) == 2
    # Equal rows are one document; of the two texts with one doc_id exactly one keeps its words.
    assert sorted(r[2] for r in got if r[0] == 5) in ([0, 0, 40], [0, 40, 40])
    assert repeats(spark, []) == [] and repeats(spark, [(1, None)]) == [(1, 0, 0, hashlib.sha256(b"").hexdigest())]


# Whitening


def whitened(spark, rows, **k):
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("x", "white", "n", "deviation", "component")})
    return whitening.whiten(df, p=whitening.Whitening(**k)).toPandas()


def test_whitening_is_that_of_the_covariance(spark):
    rows = vectors(300, 10, seed=3)
    odd = [(900, None, 1), (901, [float("inf")] * 10, 1), (902, [None] + [0.0] * 9, 1), (903, [0.5, 0.25], 1), (1, rows[1][1], 1)]
    got = whitened(spark, rows + odd)
    kept = usable(rows + odd)
    x = np.array([[int(np.floor(1024 * v)) + 100_000 for v in r[1]] + [0] * (10 - len(r[1])) for r in kept])
    n, s = len(x), x.sum(axis=0)
    assert set(got["n"]) == {n} and len(got) == 8 * n
    values, vectors_ = np.linalg.eigh((x - s / n).T @ (x - s / n) / n)
    for i in range(8):
        own = got[got["component"] == i + 1].sort_values(["vec_id", "whitened"])
        want = (x - s / n) @ vectors_[:, -1 - i] / np.sqrt(values[-1 - i])
        want = np.array([w for _, w in sorted(zip([r[0] for r in kept], want * np.sign(want @ np.array([dict(zip(own["vec_id"], own["whitened"], strict=True))[r[0]] for r in kept])), strict=True))])
        assert np.abs(own["whitened"].to_numpy() - want).max() < 1e-9
        assert np.allclose(own["explained"], values[-1 - i] / values.sum(), rtol=1e-9)
    gaps = dict(zip([r[0] for r in kept], [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x], strict=True))
    assert all(gaps[v] == d for v, d in zip(got["vec_id"], got["deviation"], strict=True)) and got["identity_error"].iloc[0] < 1e-10


def test_whitening_of_dependent_dimensions_and_of_nothing(spark):
    rows = [(i, [i / 7, 2 * (i // 7), 0.25], 0) for i in range(0, 70, 7)]
    got = whitened(spark, [(i, [v[0], v[0], 0.25], c) for i, v, c in rows])
    assert set(got["component"]) == {1} and abs(got["explained"].iloc[0] - 1) < 1e-12 and got["identity_error"].iloc[0] < 1e-12
    for none in ([], [(1, None, 0)], [(1, [0.5, 1.0], 0)], [(i, [0.5, 1.0], 0) for i in range(5)], [(1, [], 0)]):
        assert whitened(spark, none).empty


def test_jacobi_keeps_small_eigenvalues():
    factor = whitening.pivoted_cholesky(np.diag([1e8, 1.0, 1e-3]) + 1e-4 * np.ones((3, 3)), 1e-15)
    rotated = whitening.jacobi(factor)
    assert np.allclose((rotated**2).sum(axis=0), np.linalg.eigvalsh(factor @ factor.T)[::-1], rtol=1e-6)
    assert abs(rotated[:, 0] @ rotated[:, 2]) < 1e-9 * np.linalg.norm(rotated[:, 0]) * np.linalg.norm(rotated[:, 2]) + 1e-12


@pytest.mark.parametrize("query", [hard_negatives.op11_hard_negatives, substring_dedup.op12_substring_dedup, whitening.op13_embedding_whitening])
def test_queries_run_over_the_smallest_tables(spark, query):
    got = query(spark, SMALL)
    name = query.__name__
    if name.startswith("op11"):
        rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    elif name.startswith("op12"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, 20)
    else:
        assert got.count() == 8 * spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
