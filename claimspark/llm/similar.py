"""Near copies by the similarity of word runs: a vantage-point forest over SimHash fingerprints finds pairs, and the runs themselves decide.

At a similarity of 0.8 fingerprints differ in about 15 of 100 bits. To follow every such pair through a tree, nearly all of it must be searched; a tree that sends
each row to one side only keeps four of five such pairs together on a level. So no border is searched twice, and there are as many trees as leave one pair in
MISSED unmet: 5 for the first level, 11 for three, 21 for five. Inside a shard all is done by Hamming distance of the whole fingerprints.
A second pass verifies all pairs in reach of groups that the first left apart. Texts are dealt out only where they are in a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fresh_names, gram_hashes, mixed, parts_for, prepare, sent, slices, span_hashes, words
from .components import components
from .simhash import BLOCK, Forest, fingerprint, shard_codes

#: Of pairs at 0.8, the share that a level keeps together (simulated: 0.804; less is reckoned with, as trees share bits), and one in how many may meet in no tree.
TOGETHER, MISSED = 0.78, 1_000
#: Levels that the trees go on below a shard, to tell its dense places.
DEEPER = 7
#: Fingerprint lanes of 64 bits, and bits in which a pair may differ to be looked at: 0.8 gives 39 of 256, give or take 6.
LANES, RADIUS = 4, 72
#: Members of a shard that one task compares with as many others; shards of the forest hold half as many at most, about.
CHUNK = 32_768
#: Runs of words that one task verifies at a time, about.
VERIFIED_RUNS = 250_000
#: Pairs in reach that a task holds, about, before it keeps only the closest ones.
HELD_PAIRS = 2_000_000
#: Cells of a band of distances; they stay in a core's cache.
BAND = 250_000


def run_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words, A-Z lower-cased: of all its words if they are fewer, of nothing if there are none."""
    for _, _, data, at in slices(texts):
        low = LOWER[data]
        starts, ends, offsets = words(low, at)
        h = span_hashes(low, starts, ends)
        grams = gram_hashes(h, n)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield gram_hashes(h[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64)


def blocks_of(lanes: np.ndarray, trees: int) -> np.ndarray:
    """rows x lanes of 64 bits to rows x trees of BLOCK bits: each tree sees bits of its own choice."""
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little")
    width = bits.shape[1]
    picks = np.argsort(mixed(np.arange(1, trees * width + 1, dtype=np.uint64)).reshape(trees, width), axis=1)[:, :BLOCK]
    seen = np.packbits(bits[:, picks.ravel()], axis=1, bitorder="little")
    return np.ascontiguousarray(seen).view(np.uint32).reshape(len(lanes), trees)


def forest_of(rows: int) -> tuple[int, int]:
    """Levels and trees for so many rows: shards hold CHUNK // 2 rows at most, about, and of pairs at 0.8 one in MISSED meets in none."""
    levels = (parts_for(rows, CHUNK // 2) - 1).bit_length()
    return levels, math.ceil(math.log(MISSED) / -math.log1p(-(TOGETHER**levels))) if levels else 1


def placed(classes: DataFrame, levels: int, trees: int) -> DataFrame:
    """(key, leaf, rep, n, lanes, and comp if it is there): the shard that holds each class in each tree, and the place DEEPER levels below."""
    columns = ["rep", "n", "lanes", *(["comp"] if "comp" in classes.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = blocks_of(np.array(batch.column(2).flatten(), np.int64).reshape(-1, LANES), trees)
            for tree, (at, code) in enumerate(shard_codes(blocks, levels + DEEPER, 0)):
                yield pa.RecordBatch.from_arrays([pa.array((code >> DEEPER) * trees + tree), pa.array(code & ((1 << DEEPER) - 1)), *batch.take(pa.array(at)).columns], ["key", "leaf", *columns])

    return classes.select(*columns).mapInArrow(run, "key bigint, leaf bigint, rep bigint, n bigint, lanes array<bigint>" + (", comp bigint" if "comp" in columns else ""))


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, name, n, lanes): name, size and fingerprint of the set of runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(xxhash.xxh3_128_digest(h.tobytes()), len(h), fingerprint(h, LANES)) for h in run_sets(batch.column(1), shingle)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 3
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(cols, kinds, strict=True)]], ["doc_id", "name", "n", "lanes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, name binary, n bigint, lanes array<bigint>")


def differing(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, LANES)), F.bit_count(a[0].bitwiseXOR(b[0])))


def sizes_allow(m: Column, n: Column, similarity: float) -> Column:
    return F.least(m, n) >= F.greatest(m, n) * F.lit(similarity) - F.lit(1e-6)


def spanning(n: int, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of a minimum spanning forest of n members, of these edges and their lengths."""
    sets, kept = Forest(n), [(x[:0], y[:0], far[:0])]
    order = np.argsort(far, kind="stable")
    x, y, far = x[order], y[order], far[order]
    for own in np.split(np.arange(len(far)), np.flatnonzero(np.diff(far)) + 1):
        u, v, d = x[own], y[own], far[own]
        while len(u):  # of the pairs at one distance, as many as join different groups, one for each lower root at a time
            p, q = sets.roots(u), sets.roots(v)
            apart = p != q
            u, v, d, p, q = u[apart], v[apart], d[apart], p[apart], q[apart]
            first = np.unique(np.maximum(p, q), return_index=True)[1]
            kept.append((u[first], v[first], d[first]))
            sets.join(u[first], v[first])
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


def closest(lanes: np.ndarray, n: np.ndarray, part: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a minimum spanning forest of the members, over pairs within RADIUS bits whose sizes allow the similarity.

    If no edge of it that joins two groups is verified, then all other pairs between them differ in more bits still. With `part`, pairs inside part 1 are left out
    (another task has them), as are those inside part 0. Members are sorted by size and compared as far as sizes allow, a band of them at a time; whenever HELD_PAIRS
    pairs are held, only the forest of those so far is kept.
    """
    order = np.argsort(n, kind="stable")
    lanes, n, part = lanes[order], n[order], None if part is None else part[order]
    none = np.zeros(0, np.int64)
    found, held = [(none, none, none.astype(np.uint8))], 0
    columns = np.ascontiguousarray(lanes.T)
    ends = np.searchsorted(n, (n + 1e-3) / similarity, "right")
    lo = 0
    while lo < len(n):
        hi = min(len(n), lo + max(1, BAND // int(ends[lo] - lo)))
        hi = min(hi, lo + max(1, BAND // int(ends[hi - 1] - lo)))
        end = int(ends[hi - 1])
        bits = np.zeros((hi - lo, end - lo), np.uint8)
        for k in range(LANES):
            bits += np.bitwise_count(lanes[lo:hi, None, k] ^ columns[None, k, lo:end])
        i, j = np.divmod(np.flatnonzero(bits <= RADIUS), end - lo)
        later = j > i
        i, j = i[later], j[later]
        x, y = i + lo, j + lo
        ok = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6
        ok &= lanes[x, 0] != ~lanes[y, 0]  # a byte holds all numbers of bits but 256, which looks like none
        if part is not None:
            ok &= part[x] != part[y]
        found.append((x[ok], y[ok], bits[i[ok], j[ok]]))
        held += int(ok.sum())
        if held > HELD_PAIRS:
            found = [spanning(len(n), *(np.concatenate(c) for c in zip(*found, strict=True)))]
            held = len(found[0][0])
        lo = hi
    x, y, _ = spanning(len(n), *(np.concatenate(c) for c in zip(*found, strict=True)))
    return order[x], order[y]


def reached(lanes: np.ndarray, n: np.ndarray, part: np.ndarray | None, comp: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs, as closest has them, of members of different groups (comp). Those of the largest group are compared with the others only, whose number decides the time."""
    order = np.argsort(n, kind="stable")
    lanes, n, comp, part = lanes[order], n[order], comp[order], None if part is None else part[order]
    names, at, size = np.unique(comp, return_inverse=True, return_counts=True)
    large = at == np.argmax(size)
    rows, columns = np.flatnonzero(~large), np.ascontiguousarray(lanes.T)
    starts, ends = np.searchsorted(n, n[rows] * similarity - 1e-3, "left"), np.searchsorted(n, (n[rows] + 1e-3) / similarity, "right")
    lo = 0
    while lo < len(rows):
        first = int(starts[lo])
        hi = min(len(rows), lo + max(1, BAND // int(ends[lo] - first)))
        hi = min(hi, lo + max(1, BAND // int(ends[hi - 1] - first)))
        end, own = int(ends[hi - 1]), rows[lo:hi]
        bits = np.zeros((hi - lo, end - first), np.uint8)
        for k in range(LANES):
            bits += np.bitwise_count(lanes[own, None, k] ^ columns[None, k, first:end])
        i, j = np.divmod(np.flatnonzero(bits <= RADIUS), end - first)
        x, y = own[i], j + first
        ok = (at[x] != at[y]) & (large[y] | (x < y)) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
        ok &= lanes[x, 0] != ~lanes[y, 0]
        if part is not None:
            ok &= part[x] != part[y]
        yield order[x[ok]], order[y[ok]]
        lo = hi


def candidate_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of the members (key, rep, n, lanes) of shards: each shard's closest pairs, at most one less than it has members; with comp, all pairs of different groups.

    A shard of more than CHUNK members is cut into chunks, and each two of them meet in a task of their own: a minimum spanning forest of the
    whole lies within those of its parts.
    """
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CHUNK).select("key", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_k"))
    rows = members.join(sent(large.checkpoint()), "key", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    grouped = "comp" in members.columns
    rows = rows.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).cast("int").alias("part"), "rep", "n", "lanes", *(["comp"] if grouped else []))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, i, j); a shard may go on in the next batch, and holds no more than 2 * CHUNK rows."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key, i, j = (table[c].to_numpy() for c in ("key", "i", "j"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                yield from found(table.slice(0, last), np.concatenate(([0], cuts)))
            held = table.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from found(held, np.array([0, held.num_rows]))

    def found(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        rep, n, part = (table[c].to_numpy() for c in ("rep", "n", "part"))
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        lanes = table["lanes"].combine_chunks().flatten().to_numpy().reshape(-1, LANES).view(np.uint64)
        size = np.diff(cuts)
        if grouped:
            comp, heads, tails, held = table["comp"].to_numpy(), [], [], 0
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (comp[lo:hi] == comp[lo]).all():
                    continue
                for a, b in reached(lanes[lo:hi], n[lo:hi], None if i[lo] == j[lo] else part[lo:hi], comp[lo:hi], similarity):
                    heads.append(rep[a + lo])
                    tails.append(rep[b + lo])
                    held += len(a)
                    if held > BAND:
                        yield batch_of(heads, tails)
                        heads, tails, held = [], [], 0
            if held:
                yield batch_of(heads, tails)
            return
        two = cuts[:-1][size == 2]
        near = np.bitwise_count(lanes[two] ^ lanes[two + 1]).sum(axis=1, dtype=np.uint16) <= RADIUS
        near &= (np.minimum(n[two], n[two + 1]) >= similarity * np.maximum(n[two], n[two + 1]) - 1e-6) & ((i[two] == j[two]) | (part[two] != part[two + 1]))
        heads, tails = [two[near]], [two[near] + 1]
        for lo, hi in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
            a, b = closest(lanes[lo:hi], n[lo:hi], None if i[lo] == j[lo] else part[lo:hi], similarity)
            heads.append(a + lo)
            tails.append(b + lo)
        yield batch_of([rep[x] for x in heads], [rep[x] for x in tails])

    def batch_of(heads: list[np.ndarray], tails: list[np.ndarray]) -> pa.RecordBatch:
        x, y = np.concatenate(heads), np.concatenate(tails)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(pairs, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts share at least `similarity` of their runs.

    The partners b of an a are dealt out by their runs (sizes: rep, n), so that a text with very many partners is looked at in many tasks, each with its own copy
    of that one text. Texts that are in no pair are never shuffled while the ids of those in pairs are few enough to be sent to all tasks; with more, all are shuffled once.
    """
    pairs = pairs.checkpoint()
    paired = sent(pairs.select(F.explode(F.array("a", "b")).alias("_paired")).distinct().checkpoint())
    weighed = pairs.join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("_n")), "b")
    salts = weighed.groupBy("a").agg(F.ceil(F.sum("_n") / VERIFIED_RUNS).cast("int").alias("_k"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(paired, F.col("_id") == F.col("_paired"), "left_semi")
    left = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_k")).cast("int").alias("salt"), "b").join(texts, F.col("b") == F.col("_id")).select("a", "salt", "b", "text")
    right = salts.join(texts, F.col("a") == F.col("_id")).select("a", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (a, salt), the text of a (whose b is null) before its partners'."""
        own = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            heads, tails = [], []
            for x, y, runs in zip(a, b, run_sets(batch.column(3), shingle), strict=True):
                if y is None:
                    own = runs
                    continue
                if not len(own) or not len(runs):
                    continue
                both = int((own[np.minimum(np.searchsorted(own, runs), len(own) - 1)] == runs).sum())
                if both >= similarity * (len(own) + len(runs) - both) - 1e-6:
                    heads.append(x)
                    tails.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(tails, pa.int64())], ["a", "b"])

    rows = left.unionByName(right)
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(check, "a bigint, b bigint")


def later_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id) of all documents but the one with the smallest doc_id of each group. doc_ids must be unique and not null.

    Documents link if their sets of runs of `shingle` words share at least `similarity` of their union; texts without words link with each other only.
    Equal sets become one class with its smallest doc_id, so that copies, however many, are not looked at again. Classes are dealt to the shards of a vantage-point
    forest over their fingerprints. At a place of a shard where more than CHUNK // 32 members crowd, those that are verified against its first member leave the
    shard, so that a large group of near copies costs a row each; of the others the closest pairs are verified. Then all members are placed once more with the groups
    that are known by then, and every pair in reach of two different groups is verified that wasn't before. No row is left out; what may be missed are
    links of sets that meet in no tree (1 in 1,000 at 0.8, fewer above) or differ in more than RADIUS bits.
    """
    prints = described(docs, shingle).checkpoint()
    classes = prints.groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("lanes").alias("lanes")).checkpoint()
    sizes, filled = classes.select("rep", "n"), classes.where("n > 0")
    forest = forest_of(filled.count())
    members = placed(filled, *forest)
    firsts = members.groupBy("key", "leaf").agg(F.count(F.lit(1)).alias("_c"), F.min("rep").alias("_first")).where(F.col("_c") > CHUNK // 32).select("key", "leaf", "_first").checkpoint()
    links = None
    if not firsts.isEmpty():
        heads = firsts.join(filled.select(F.col("rep").alias("_first"), F.struct("n", "lanes").alias("_h")), "_first").checkpoint()
        of_first = members.join(sent(heads), ["key", "leaf"]).where(F.col("rep") > F.col("_first")).where((differing(F.col("lanes"), F.col("_h.lanes")) <= RADIUS) & sizes_allow(F.col("n"), F.col("_h.n"), similarity))
        links = verified(of_first.select(F.col("_first").alias("a"), F.col("rep").alias("b")).distinct(), docs, sizes, similarity, shingle).checkpoint()
        gone = firsts.select("key", "leaf", F.col("_first").alias("a")).join(links, "a").select("key", "leaf", F.col("b").alias("rep")).distinct().checkpoint()
        members = members.join(sent(gone), ["key", "leaf", "rep"], "left_anti")
    tried = candidate_pairs(members, similarity).checkpoint()
    found = verified(tried, docs, sizes, similarity, shingle)
    links = (found if links is None else links.unionByName(found)).checkpoint()
    groups = components(links).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    grouped = filled.join(groups, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).checkpoint()
    others = candidate_pairs(placed(grouped, *forest), similarity).join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(verified(others, docs, sizes, similarity, shingle)).checkpoint()
    later = components(links).where("node <> component").select(F.col("node").alias("doc_id"))
    return later.unionByName(prints.select("doc_id").join(classes, F.col("doc_id") == F.col("rep"), "left_anti"))


def without_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The document with the smallest doc_id of each group, all its columns. Of rows that repeat a doc_id, the one with the least hash of its text stays.

    Null texts count as empty, and of texts without words one stays; rows without a doc_id stay and group with nothing; no rows give no rows; columns of any name are kept.
    """
    prepare(docs.sparkSession)
    known, columns = docs.where("doc_id is not null"), docs.columns
    id_, hash_ = fresh_names(docs, "id", "hash")
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        least = known.groupBy(F.col("doc_id").alias(id_)).agg(F.min(F.xxhash64("text")).alias(hash_))
        known = known.join(least, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_semi").dropDuplicates(["doc_id"])
    later = later_documents(known.select("doc_id", "text"), similarity, shingle).select(F.col("doc_id").alias(id_))
    kept = known.join(sent(later.checkpoint()), F.col("doc_id") == F.col(id_), "left_anti")
    return kept.unionByName(docs.where("doc_id is null")).select(*[f"`{c}`" for c in columns])
