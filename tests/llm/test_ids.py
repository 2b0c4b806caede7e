"""op2, op3 and op6 against brute force, and on hard rows."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from claimspark.llm import mixing, queries, sharding, similar, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"
HARD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "b", 0, None),
    (2, "", "en", "b", 0, None),
    (3, "one", "en", "a", 3, "x"),
    (4, "A b c d e f g h é z " * 40, "en", "a", 3, "x"),
    (5, "a b c d e f g h é z " * 40, "en", None, 3, "x"),
    (6, "w " * 50_000, "en", "a", 3, "x"),
]


def hard(spark):
    return spark.createDataFrame(HARD, SCHEMA)


def documents(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def find(links, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_op2_targets_and_words(spark, sf_dir):
    rows = queries.op2_weighted_fair_mix(spark, sf_dir).collect()
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents(spark, sf_dir)}
    source = {d["doc_id"]: d["source"] for d in documents(spark, sf_dir)}
    total = defaultdict(int)
    for i, n in size.items():
        total[source[i]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, goal, open_ = 1.5 * sum(total.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        for s in over or set(open_):
            goal[s] = 2.0 * total[s] if over else weight[s] * level
            left -= goal[s]
            open_.discard(s)
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert (r["size"], r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.PACKET for s in names)
    assert sum(taken.values()) == round(sum(goal.values()))
    assert sorted(rows) == sorted(queries.op2_weighted_fair_mix(spark, sf_dir).collect())


def brute_mix(docs, targets, packet):
    """All packets in the order of their finish times, until the budget is reached; documents are dicts in queue order of their sources."""
    queue, at = [], defaultdict(int)
    total = defaultdict(int)
    for d in docs:
        total[d["source"]] += d["size"]
    for d in docs:
        start, at[d["source"]] = at[d["source"]], at[d["source"]] + d["size"]
        for turn in (0, 1):
            for lo in range(0, d["size"], packet or max(1, d["size"])):
                hi = min(d["size"], lo + packet) if packet else d["size"]
                queue.append(((start + turn * total[d["source"]] + hi) / targets[d["source"]], d["order"], turn, hi - lo, d["id"]))
    left, taken = round(sum(targets.values())), defaultdict(int)
    for _, _, _, n, i in sorted(queue):
        taken[i] += min(n, left) if packet or n <= left else 0
        left -= min(n, left)
    return taken


@pytest.mark.parametrize("packet", [7, None])
def test_the_cut_against_brute_force(spark, packet):
    import random

    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.choice((0, 1, 5, 30, 200))), rng.choice(("a", "b", None, "c"))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mixing.fair_queue(frame, packet=packet).select("row.doc_id", "row.source", "size", "target", "taken").collect()}
    order = {r.doc_id: r.order for r in frame.select("doc_id", mixing._order(0).alias("order")).collect()}
    docs = sorted(({"id": i, "source": r.source, "size": r["size"], "order": order[i]} for i, r in got.items() if r["size"]), key=lambda d: (d["order"], d["id"]))
    want = brute_mix(docs, {r.source: r.target for r in got.values()}, packet)
    assert {i: r.taken for i, r in got.items()} == {i: want[i] for i in got}


def test_mix_of_hard_rows(spark):
    frame = hard(spark).selectExpr("*", "'t' as target", "'c' as copies", "1 as row", "2 as turn", "3 as `a.b`", "4 as finish", "5 as name")
    rows = mixing.fair_queue(frame).collect()
    assert len(rows) == len(HARD)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.fair_queue(hard(spark).limit(0)).count() == 0
    mix = mixing.mixed_documents(frame)
    assert mix.columns == frame.columns and mix.count() > 0
    assert all((r.target, r.copies, r.row, r.turn, r["a.b"], r.finish, r.name) == ("t", "c", 1, 2, 3, 4, 5) for r in mix.collect())
    assert {r["size"] for r in mix.collect()} <= {"x", None}
    order = [r.place for r in mixing.in_mix_order(mixing.fair_queue(frame, packet=None), 3).collect()]
    assert order == sorted(order) and order
    alike = spark.createDataFrame([(1, "w " * 10, "a")] * 30 + [(2, "w " * 100, "b")], "doc_id bigint, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.fair_queue(alike).select("row.doc_id", "taken").collect()}[1] <= 20


def test_op3_against_all_pairs(spark, sf_dir):
    want = {}
    for d in documents(spark, sf_dir):
        tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (d["text"] or "").encode()))
        runs = [tokens[i : i + 3] for i in range(len(tokens) - 2)] or [tokens] * bool(tokens)
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs]
        want[d["doc_id"]] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    ids = sorted(want)
    links = [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 3]
    top = find(links, ids)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_vp_forest(spark, sf_dir).collect()}
    assert got == {i: (f"{want[i]:016x}", top[i]) for i in ids}
    assert any(top[i] != i for i in ids)


def test_forest_finds_every_pair(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.int64)
    near = base[rng.integers(0, 400, 900)] ^ (np.int64(1) << rng.integers(0, 63, 900)) ^ (np.int64(1) << rng.integers(0, 63, 900))
    tight = np.int64(12345) ^ (np.int64(1) << rng.integers(0, 63, 500)) ^ (np.int64(1) << rng.integers(0, 63, 500)) ^ (np.int64(1) << rng.integers(0, 63, 500))
    all_ = np.unique(np.concatenate((base, near, tight)))
    monkeypatch.setattr(simhash, "SHARD_ROWS", 100)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    frame = spark.createDataFrame([(i, [int(x)]) for i, x in enumerate(all_)], "rep bigint, lanes array<bigint>")
    edges = [(r.a, r.b) for r in simhash.near_links(frame, 1, 3, 1).collect()]
    monkeypatch.setattr(simhash, "SHARD_MOST", 40)  # shards in blocks
    cut = [(r.a, r.b) for r in simhash.near_links(frame, 1, 3, 1).collect()]
    assert find(cut, range(len(all_))) == find(edges, range(len(all_)))
    want = [(i, j) for i in range(len(all_)) for j in range(i + 1, len(all_)) if (int(all_[i]) ^ int(all_[j])).bit_count() <= 3]
    assert find(edges, range(len(all_))) == find(want, range(len(all_)))


def test_near_copies_of_hard_rows(spark):
    rows = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(hard(spark)).collect())
    assert rows == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]
    assert simhash.near_copies(hard(spark).limit(0)).count() == 0


def test_op6_shards(spark, sf_dir):
    rows = sorted(queries.op6_byte_prefix_shards(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    docs = {d["doc_id"]: (d["text"] or "").encode() for d in documents(spark, sf_dir)}
    assert [r.doc_id for r in rows] == sorted(docs)
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]))
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(sums) == list(range(16))
    share, most = sum(sums.values()) / 16, max(r["size"] for r in rows)
    assert all(abs(x - share) <= most for x in sums.values())
    assert all(x == list(range(len(x))) for x in slots.values())
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)


def test_shards_of_hard_rows(spark):
    rows = sharding.byte_shards(hard(spark)).collect()
    assert len(rows) == len(HARD)
    assert sharding.byte_shards(hard(spark).limit(0)).count() == 0


def test_pipeline_links_every_similar_pair_and_no_other(spark):
    """Pairs of texts at a known similarity of their runs of five words, whose fingerprints differ in every block."""
    import corpus_pipeline

    rows, want = [], set()
    for k in range(400):
        shared = [f"p{k}w{i}" for i in range(84)]
        more = 18 if k % 2 else 28  # 80 common runs and 18 or 28 others: 0.816 or 0.741
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join([*shared, *(f"p{k}x{i}" for i in range(more))]))]
        want |= {2 * k} if k % 2 else {2 * k, 2 * k + 1}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies_out(spark, frame, "").collect()} == want


def jaccard_links(texts, similarity=0.8, n=5):
    """All pairs of texts that share enough of their runs."""
    sets = {}
    for i, text in texts.items():
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s or {()}:
            where[x].append(i)
    common = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    share = lambda a, b, c: 1.0 if not sets[a] and not sets[b] else c / (len(sets[a]) + len(sets[b]) - c)
    return [(a, b) for (a, b), c in common.items() if share(a, b, c) >= similarity - 1e-9]


def test_similar_documents_against_all_pairs(spark, monkeypatch):
    """Random edits of a few texts; shards are cut small, so that large ones are dealt out and emptied by their first members."""
    import random

    rng = random.Random(3)
    monkeypatch.setattr(similar, "CHUNK", 40)
    monkeypatch.setattr(similar, "VERIFIED_RUNS", 3_000)
    texts = {}
    for k in range(12):
        base = [f"t{k}w{rng.randrange(400)}" for _ in range(rng.choice((9, 60, 150)))]
        for _ in range(rng.choice((2, 5, 70))):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(w).title() if rng.random() < 0.3 else " ".join(w)
    for text in ("", None, "one two", "one two", "  "):
        texts[len(texts)] = text
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    top = find(jaccard_links(texts), texts)
    got = {r.doc_id for r in similar.without_similar(frame).collect()}
    want = {i for i in texts if top[i] == i}
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


def test_similar_on_the_table(spark):
    """Recall of direct links at 0.8 and more; nothing below is dropped."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    top = find(jaccard_links(texts), texts)
    got = {r.doc_id for r in similar.without_similar(docs).collect()}
    want = {i for i in texts if top[i] == i}
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


def test_similar_on_hard_rows(spark):
    rows = [*HARD, (None, "w w", None, None, None, None), (None, "w w", None, None, None, None), (9, "é " * 10, None, None, None, None), (9, "é " * 11, None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'i' as _id", "1 as component", "2 as node", "3 as rep", "4 as `a.b`")
    kept = similar.without_similar(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 6, 9]
    assert all((r._id, r.component, r.node, r.rep, r["a.b"]) == ("i", 1, 2, 3, 4) for r in kept.collect())
    assert similar.without_similar(frame.limit(0)).count() == 0


def test_similar_forest_leaves_one_pair_in_a_thousand_unmet():
    """Fingerprints that differ in as many bits as texts at 0.8, in forests for tables of several sizes; each row is in one shard of each tree."""
    import numpy as np

    rng = np.random.default_rng(5)
    one = rng.integers(0, 2, (8_000, 256), dtype=np.uint8)
    two = [np.packbits(x, axis=1, bitorder="little").view(np.int64) for x in (one, one ^ (rng.random(one.shape) < 0.1514))]
    for rows in (1_000, 40_000, 300_000, 3_000_000):
        levels, trees = similar.forest_of(rows)
        met = np.zeros(len(one), bool)
        for (a, x), (b, y) in zip(*(simhash.shard_codes(similar.blocks_of(p, trees), levels, 0) for p in two), strict=True):
            assert sorted(a) == sorted(b) == list(range(len(one))) and len(np.unique(x)) <= 2**levels
            met |= x[np.argsort(a)] == y[np.argsort(b)]
        assert (~met).mean() < 0.003


def test_similar_pairs_meet_in_shards_of_the_forest(spark, monkeypatch):
    """Many shards on a small table: candidates come through them, and each pair of similar texts is one."""
    monkeypatch.setattr(similar, "CHUNK", 64)
    texts = [(2 * k + j, " ".join([f"p{k}w{i}" for i in range(84)] + [f"p{k}x{i}" for i in range(18 * j)])) for k in range(300) for j in (0, 1)]
    classes = similar.described(spark.createDataFrame(texts, "doc_id bigint, text string"), 5).withColumnRenamed("doc_id", "rep").checkpoint()
    members = similar.placed(classes, *similar.forest_of(600)).checkpoint()
    assert members.count() == 600 * similar.forest_of(600)[1] and members.select("key").distinct().count() > 300
    found = {tuple(r) for r in similar.candidate_pairs(members, 0.8).collect()}
    assert len({(2 * k, 2 * k + 1) for k in range(300)} - found) <= 2


def test_similar_forest_grows_slowly_and_evenly():
    """Five times the rows take less than twice the copies of each, and no shard of even fingerprints needs blocks."""
    import numpy as np

    assert similar.forest_of(203_000)[1] < 2 * similar.forest_of(42_000)[1] and similar.forest_of(12_000_000)[1] < 89
    rng = np.random.default_rng(7)
    levels, trees = similar.forest_of(203_000)
    for at, code in simhash.shard_codes(similar.blocks_of(rng.integers(-(2**63), 2**63, (203_000, 4)), trees), levels, 0):
        assert len(at) == 203_000 and np.bincount(code).max() <= similar.CHUNK


def test_similar_shuffles_only_texts_in_pairs(spark):
    """Of 2,000 texts of 4 kB two are alike but for a word: what is shuffled is far less than all texts."""
    import random

    rng = random.Random(11)
    texts = [(k, " ".join(f"{rng.randrange(10**7)}" for _ in range(500))) for k in range(2_000)]
    texts.append((2_000, f"{texts[7][1]} more"))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").checkpoint()
    classes = similar.described(frame, 5).selectExpr("doc_id as rep", "n").checkpoint()
    found = similar.verified(spark.createDataFrame([(7, 2_000), (3, 4)], "a bigint, b bigint"), frame, classes, 0.8, 5)
    assert [tuple(r) for r in found.collect()] == [(7, 2_000)]
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert re.search("BroadcastHashJoin .*LeftSemi", plan(found))
    kept = similar.without_similar(frame)
    assert re.search("BroadcastHashJoin .*LeftAnti", plan(kept)) and kept.count() == 2_000


def test_closest_pairs_of_mixed_sizes():
    """Groups by all pairs in reach whose sizes allow the similarity, also between two parts, one of them with fingerprints turned over."""
    import numpy as np

    rng = np.random.default_rng(1)
    who = rng.integers(0, 80, 600)
    bits = rng.integers(0, 2, (80, 256), dtype=np.uint8)[who] ^ (rng.random((600, 256)) < 0.08)
    bits[599] = 1 - bits[0]
    lanes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    n = np.maximum(1, np.exp(rng.normal(5, 1, 80))[who] * rng.uniform(0.8, 1.2, 600)).astype(np.int64)
    n[599] = n[0]
    for part in (None, rng.integers(0, 2, 600).astype(np.int32)):
        want, got = (simhash.Forest(600) for _ in range(2))
        far = np.bitwise_count(lanes[:, None] ^ lanes[None]).sum(axis=2, dtype=np.int64)
        near = (far <= similar.RADIUS) & (np.minimum(n[:, None], n) >= 0.8 * np.maximum(n[:, None], n) - 1e-6)
        near &= True if part is None else part[:, None] != part
        want.join(*np.nonzero(near))
        a, b = similar.closest(lanes, n, part, 0.8)
        assert near[a, b].all() and len(a) < 600
        got.join(a, b)
        assert (want.roots(np.arange(600)) == got.roots(np.arange(600))).all()
