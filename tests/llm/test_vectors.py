"""op4 against all pairs, and on hard rows."""

import numpy as np

from claimspark.llm import embeddings, queries
from tests.llm.test_ids import find


def brute(rows, threshold):
    ids = [i for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    good = set(ids)
    x = np.array([np.pad(np.array(v, float), (0, 64 - len(v))) for i, v in rows if i in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    return {(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b}


def test_recall_and_counts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_BLOCK", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 64))
    near = base[rng.integers(0, 600, 500)] + rng.normal(size=(500, 64)) * 0.2
    tight = base[0] + rng.normal(size=(200, 64)) * 0.12
    vectors = [*base, *near, *tight, *base[:50], *(base[50:60] * 3)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want = brute(rows, 0.95)
    assert len(want) > 5_000
    assert sum(r.n_links for r in got.values()) / 2 >= 0.97 * len(want)
    degree = np.bincount(np.array(sorted(want)).ravel(), minlength=len(rows))
    assert all(got[i].n_links <= degree[i] for i in range(len(rows)))
    top = find(want, range(len(rows)))
    assert np.mean([got[i].component_id == top[i] for i in got]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [-1.0, 2.0]), (None, [1.0, 2.0]), (11, [1e-200, 2e-200]), (12, [1.0, 2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as n", "'y' as rep")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(frame).collect()), key=str)
    alone = [(i, 0, i) for i in (4, 5, 6, 7, 8, 9, 10)]
    want = [*alone, *[(i, 4, 1) for i in (1, 2, 3, 11, 12)], (None, 0, None)]
    assert got == sorted(want, key=str)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    """Two pivots only, one of them everywhere: lists of one, two and three pivots give the same links, each counted once."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + rng.normal(size=8) * 0.1).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = []
    for block in (4_096, 50, 10):
        monkeypatch.setattr(embeddings, "LIST_BLOCK", block)
        found.append(sorted(tuple(r) for r in embeddings.near_vectors(frame).collect()))
    assert found[0] == found[1] == found[2]
    want = brute(rows, 0.95)
    assert len(want) > 1_000 and sum(r[1] for r in found[0]) / 2 >= 0.95 * len(want)


def test_recall_at_a_larger_size(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2_500, 64))
    near = base[rng.integers(0, 2_500, 3_000)] + rng.normal(size=(3_000, 64)) * rng.uniform(0.1, 0.33, (3_000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, near)))]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(8)).collect()
    want = brute(rows, 0.95)
    assert len(want) > 2_000 and 0.95 * len(want) <= sum(r.n_links for r in got) / 2 <= len(want)


def test_op4_on_the_table(spark, sf_dir, tmp_path):
    """The table's own vectors are far from each other, so near and equal ones of them are planted: from just below the threshold to equal."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rng, first = np.random.default_rng(3), 1 + max(i for i, _ in rows)
    planted = []
    for k in range(1_500):
        v = np.array(rows[int(rng.integers(0, len(rows)))][1])
        planted.append((first + k, (v + rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5 * (0.0 if k % 10 == 0 else rng.uniform(0.05, 0.36))).tolist()))
    spark.createDataFrame([*rows, *planted], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = queries.op4_pivot_permutations(spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == sorted(i for i, _ in rows)
    want = brute(rows, 0.95)
    degree = np.bincount(np.array(sorted(want)).ravel(), minlength=first + 1_500)
    assert len(want) > 2_000 and 0.9 * len(want) <= sum(r.n_links for r in got) / 2 <= len(want)
    assert all(r.n_links <= degree[r.vec_id] for r in got)
    assert queries.op4_pivot_permutations(spark, sf_dir).where("n_links > 0").count() == 2 * len(brute(rows[:0] or [r for r in rows if r[0] < first], 0.95))


def test_ids_with_several_vectors(spark):
    """Classes with the same smallest id are told apart, and the vectors of one id count each other."""
    x, y, z = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.1]
    rows = [(1, x), (1, y), (2, x), (3, [0.01, 1.0, 0.0, 0.0]), (4, z), (4, [0.0, 0.0, 1.0, 0.11]), (5, y), (5, y)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 2, 1, False)]
