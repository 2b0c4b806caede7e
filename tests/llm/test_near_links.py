"""Near copies whose groups' closest pair isn't verified, though another pair of theirs is."""

import numpy as np

from claimspark.llm import similar


def test_pairs_of_different_groups_are_all_reached():
    rng = np.random.default_rng(2)
    who = rng.integers(0, 30, 300)
    bits = rng.integers(0, 2, (30, 256), dtype=np.uint8)[who] ^ (rng.random((300, 256)) < 0.08)
    lanes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    n = np.maximum(1, np.exp(rng.normal(4, 1, 30))[who] * rng.uniform(0.7, 1.3, 300)).astype(np.int64)
    far = np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(axis=2, dtype=np.int64)
    for comp in (np.arange(300), np.where(rng.random(300) < 0.5, 7, rng.integers(0, 9, 300))):
        for part in (None, rng.integers(0, 2, 300).astype(np.int32)):
            want = (far <= similar.RADIUS) & (np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n) - 1e-6) & (comp[:, None] != comp)
            want &= True if part is None else part[:, None] != part
            got = [tuple(sorted(p)) for a, b in similar.reached(lanes, n, part, comp, 0.8) for p in zip(a.tolist(), b.tolist(), strict=True)]
            assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in np.argwhere(want).tolist() if i < j}


def test_no_link_hangs_on_the_closest_pairs(spark, monkeypatch):
    """Where the closest pairs of a shard verify nothing, its other pairs still do."""
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(similar, "closest", lambda *a: (none, none))
    texts = [(3 * k + j, " ".join([f"p{k}w{i}" for i in range(84)] + [f"p{k}x{j}y{i}" for i in range(4 * j)])) for k in range(40) for j in range(3)]
    kept = similar.without_similar(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r.doc_id for r in kept.collect()} == {3 * k for k in range(40)}
