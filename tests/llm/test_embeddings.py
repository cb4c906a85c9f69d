from __future__ import annotations

import math

import numpy as np

from hemiciclo.llm.embedding_dedup import Quantised, code_pairs, linked_pairs, near_vectors
from llm_helpers import components


def brute(vectors: list[tuple]) -> dict:
    x = {i: np.array(v, np.float64) for i, v in vectors}
    ids = sorted(x)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(x[a]) == len(x[b]) and x[a] @ x[b] / math.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.95:
                links.append((a, b))
    c = components(ids, links)
    return {i: (sum(i in p for p in links), c[i], c[i] == i) for i in ids}


def made(seed: int, n: int, dims: int = 16) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.0, 0.1, 0.25, 0.3])).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force_over_blocks(spark):
    vectors = made(1, 400)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    for block in (50, 1000):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block).collect()} == brute(vectors)


def test_pairs_near_the_threshold_are_recomputed():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    y = x * 0.95 + np.sqrt(1 - 0.95**2) * rng.normal(size=(300, 64))
    i, j = linked_pairs(Quantised(x), Quantised(y), 0.95, 0, 300)
    cosine = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(cosine >= 0.95)), strict=True))


def test_codes_bound_cosines_at_any_length():
    """What the codes call sure is linked, what they leave out is not, at 1,000 dimensions as at 3."""
    rng = np.random.default_rng(9)
    for dims in (3, 64, 1000, 1100):
        x = rng.normal(size=(120, dims))
        y = x * 0.95 + np.sqrt(1 - 0.95**2) * rng.normal(size=(120, dims))
        y[:20] = 2 * x[:20]
        i, j, sure = code_pairs(Quantised(x), Quantised(y), 0.95, 0, 120)
        linked = (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= 0.95
        assert linked[i[sure], j[sure]].all() and sure.any() and not sure.all()
        may = np.zeros((120, 120), bool)
        may[i, j] = True
        assert not linked[~may].any()


def test_open_pairs_over_blocks_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    vectors = [(i, (base + rng.normal(size=24) * 0.32).tolist()) for i in range(150)]  # cosines around the threshold
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for block in (20, 64, 1000):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block).collect()} == brute(vectors)
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 3.0])]
    out = {(r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert (6, 1, 5) in out and (7, 1, 5) in out


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "2 as print")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    assert out[1] == (3, 1, True) and out[2] == (3, 1, False) == out[11] and out[10] == (3, 1, False)
    assert all(out[i] == (0, i, True) for i in range(3, 10)) and out[None] == (0, None, True)
    assert near_vectors(df.where("false")).count() == 0
