"""SimHash fingerprints, and near copies by a distributed vantage-point forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import written

from .common import LOWER, mixed, parts_for, prepare, slices
from .components import components

SEED = 42
#: Fingerprints that a shard of the forest holds about, before its task goes on splitting; and those that a leaf compares outright.
SHARD_ROWS, LEAF_ROWS = 8_192, 512
#: Rows of a shard beyond which it is cut into blocks of about so many, and two blocks are searched at a time.
SHARD_MOST = 4 * SHARD_ROWS
#: Bits that a tree of the forest sees, and those of them that a level looks at where no border is searched: the fewer, the less often a cut parts near rows.
BLOCK, CUT_BITS = 32, 3


def shingle_hashes(tokens: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of n words joined by a space, repeats included; of all words if they are fewer, of nothing if there are none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), SEED)], np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens])
    cuts = zip([0, *ends[: len(tokens) - n].tolist()], (ends[n - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in cuts], np.uint64)


def fingerprint(h: np.ndarray, lanes: int = 1) -> list[int]:
    """`lanes` 64-bit numbers, a bit being 1 if it is set in over half the hashes; lane k > 0 uses the hashes mixed k times. No hash: 0."""
    out = []
    for _ in range(lanes):
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(h), 16_384):
            part = np.ascontiguousarray(h[lo : lo + 16_384]).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        bits = np.packbits(ones * 2 > len(h), bitorder="little")
        out.append(int(bits.view(np.int64)[0]))
        h = mixed(h + np.uint64(1)) if lanes > 1 else h
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, lanes array<long>) of each whole text, A-Z lower-cased, in words [^\\x20\\x09-\\x0D]+. Null and empty texts have zeros."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, at in slices(batch.column(1)):
                low = LOWER[data].tobytes()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    found.append(fingerprint(shingle_hashes(low[a:b].split(), shingle), lanes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "lanes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lanes array<bigint>")


def _blocks(lanes: np.ndarray) -> np.ndarray:
    """rows x lanes of int64 to rows x blocks of 32 bits."""
    return np.ascontiguousarray(lanes).view(np.uint32)


def _vantage(block: int, level: int) -> np.uint32:
    return np.uint32(int(mixed(np.array([(block + 1) * 1_000_003 + level], np.uint64))[0]) & 0xFFFFFFFF)


def _split_at(block: int, level: int) -> int:
    """Distances to a level's vantage point are cut at the middle of what random bits have."""
    return BLOCK // 2 - (level + block) % 2


def _seen(block: int, level: int) -> np.uint32:
    """CUT_BITS bits for a level of a tree; all bits of the block are used before any comes again."""
    turn, at = divmod(level, BLOCK // CUT_BITS)
    order = np.argsort(mixed(np.arange(1, BLOCK + 1, dtype=np.uint64) + np.uint64(((block + 1) * 1_009 + turn) * BLOCK)))
    return np.uint32(sum(1 << int(k) for k in order[at * CUT_BITS : (at + 1) * CUT_BITS]))


def shard_codes(blocks: np.ndarray, levels: int, block_radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block, the rows and the shards that hold them.

    Level by level, a row goes to the near side (0) if its distance d to the level's vantage point is at most m + r, and to the far
    side (1) if it is over m: by the triangle inequality, two rows within r of each other meet on the near side if either has d <= m,
    else on the far side. Other branches are pruned.

    With r = 0 a row goes to one side only, and each level takes distances over CUT_BITS bits of its own. Two rows that differ in 15 of 100 bits stay together on
    0.80 of such levels, against 0.75 over the whole block, and the sides are even.
    """
    out, whole = [], np.uint32(0xFFFFFFFF)
    for b in range(blocks.shape[1]):
        at, code = np.arange(len(blocks)), np.zeros(len(blocks), np.int64)
        for level in range(levels):
            seen, m = (whole, _split_at(b, level)) if block_radius else (_seen(b, level), CUT_BITS // 2)
            d = np.bitwise_count((blocks[at, b] ^ _vantage(b, level)) & seen)
            near, far = d <= m + block_radius, d > m
            at, code = np.concatenate((at[near], at[far])), np.concatenate((code[near] * 2, code[far] * 2 + 1))
        out.append((at, code))
    return out


class Forest:
    """Sets of positions that grow together; a set is named by its smallest position."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.up[x]
        while (more := self.up[at]).size and (more != at).any():
            at = more
        self.up[x] = at
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins each a with its b: roots hang themselves below smaller ones until all pairs agree."""
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _compare(at: np.ndarray, seen: np.ndarray, full: np.ndarray, block_radius: int, radius: int, sets: Forest) -> None:
    """Joins the pairs of these rows that differ in block_radius bits of the tree's block and in `radius` of all, a band of rows at a time."""
    own, block = full[at], seen[at]
    band = max(16, 1_000_000 // max(1, len(at)))
    for lo in range(0, len(at), band):
        i, j = np.nonzero(np.bitwise_count(block[lo : lo + band, None] ^ block[None, lo:]) <= block_radius)
        apart = j > i
        i, j = i[apart] + lo, j[apart] + lo
        for start in range(0, len(i), 1_000_000):
            x, y = i[start : start + 1_000_000], j[start : start + 1_000_000]
            near = np.bitwise_count(own[x] ^ own[y]).sum(axis=1, dtype=np.uint16) <= radius
            sets.join(at[x[near]], at[y[near]])


def search_shard(full: np.ndarray, block: int, radius: int, block_radius: int) -> np.ndarray:
    """The smallest position each row is linked with inside a shard, over steps of links.

    The tree goes on inside the shard with vantage points taken from its rows, each node cut where fewest rows lie on the border; nodes
    that no cut makes much smaller are compared outright, in bands.
    """
    seen, sets = _blocks(full)[:, block], Forest(len(full))
    words64 = np.ascontiguousarray(full).view(np.uint64)
    todo = [(np.arange(len(full)), 0)]
    while todo:
        at, depth = todo.pop()
        if len(at) <= LEAF_ROWS:
            _compare(at, seen, words64, block_radius, radius, sets)
            continue
        pick = int(mixed(np.array([len(at) * 31 + depth], np.uint64))[0] % np.uint64(len(at)))
        d = np.bitwise_count(seen[at] ^ seen[at[pick]])
        total = np.cumsum(np.bincount(d, minlength=BLOCK + block_radius + 2))
        cuts = np.arange(BLOCK)
        near, far = total[cuts + block_radius], len(at) - total[cuts]
        cost = near.astype(float) ** 2 + far.astype(float) ** 2
        m = int(cost.argmin())
        if cost[m] > 0.8 * len(at) ** 2 or depth > 64:
            _compare(at, seen, words64, block_radius, radius, sets)
            continue
        todo += [(at[d <= m + block_radius], depth + 1), (at[d > m], depth + 1)]
    return sets.roots(np.arange(len(full)))


def near_links(classes: DataFrame, lanes: int, radius: int, block_radius: int) -> DataFrame:
    """Links (a, b) that connect the fingerprints (rep long, lanes) within `radius` bits, as stars inside each shard of the forest.

    64 x lanes bits make 2 x lanes blocks of 32, each with a tree of its own. Two fingerprints within r bits agree in some block to
    r // blocks bits, so that searching each tree with a block_radius of that finds every pair; a smaller one trades recall for time.
    A shard's stars have one row per member that has a link at most, never all pairs. A shard of more than SHARD_MOST rows, as of fingerprints that are alike in a whole block,
    is cut by a hash into blocks, and each two of them are searched by a task of their own, so that no task holds more than two blocks.
    """
    spark = classes.sparkSession
    levels = max(0, (parts_for(classes.count(), SHARD_ROWS) - 1).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            full = np.array(batch.column(1).flatten(), np.int64).reshape(-1, lanes)
            for b, (at, code) in enumerate(shard_codes(_blocks(full), levels, block_radius)):
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(code * 2 * lanes + b), *taken.columns], ["shard", "rep", "lanes"])

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep = table["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        full = np.array(table["lanes"].combine_chunks().flatten(), np.int64).reshape(-1, lanes)[order]
        low = search_shard(full, int(table["shard"][0].as_py() % (2 * lanes)), radius, block_radius)
        linked = np.flatnonzero(low != np.arange(len(low)))
        return pa.table({"a": rep[low[linked]], "b": rep[linked]})

    shards = written(classes.select("rep", "lanes").mapInArrow(place, "shard bigint, rep bigint, lanes array<bigint>"))
    large = shards.groupBy(F.col("shard").alias("_shard")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SHARD_MOST).select("_shard", F.ceil(F.col("_n") / SHARD_MOST).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    dealt = shards.join(large, F.col("shard") == F.col("_shard"), "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "lanes")
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, 2 * lanes << levels), "shard", "i", "j")
    return dealt.groupBy("shard", "i", "j").applyInArrow(search, "a bigint, b bigint")


def near_copies(docs: DataFrame, shingle: int = 3, lanes: int = 1, radius: int = 3, block_radius: int = 1) -> DataFrame:
    """(doc_id, lanes, component_id) of each document: component_id is the smallest doc_id reachable by links, itself included.

    Documents link if their fingerprints differ in `radius` bits at most. Equal fingerprints become one class with their smallest doc_id
    before anything is compared, so that copies cost a row each. Texts without words have zero fingerprints and link like any other; rows
    with a null doc_id come out as their own component (null), and repeated rows come out as often as they came; no rows give no rows.
    With a block_radius of radius // (2 * lanes), as here, the search is exact.
    """
    prints = fingerprints(docs, shingle, lanes).checkpoint()
    classes = prints.where("doc_id is not null").groupBy("lanes").agg(F.min("doc_id").alias("rep")).checkpoint()
    found = components(near_links(classes.select(F.col("rep").cast("long"), "lanes"), lanes, radius, block_radius))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("lanes").alias("_lanes"), F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, F.col("lanes") == F.col("_lanes"), "left").drop("_lanes")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
