"""Near copies among embeddings by an index of pivot permutations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .components import components
from .simhash import Forest

#: Nearest pivots that describe a vector, and how many two vectors must share to be compared.
PREFIX, SHARED = 8, 3
#: Pivots: this many times the square root of the vectors, between the bounds. They are a bounded sample of the vectors; all vectors are indexed.
PIVOT_FACTOR, PIVOTS_LEAST, PIVOTS_MOST = 2.0, 32, 8_192
#: Vectors of one inverted list that are compared in one task with as many others.
LIST_BLOCK = 4_096


def _unit(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, filled up with zeros to `width`; and which are usable: no null, non-finite or only zero components."""
    out, good = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
    for i, v in enumerate(lists.to_pylist()):
        if v and None not in v:
            x = np.array(v, float)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top
                out[i, : len(x)], good[i] = x / math.sqrt(x @ x), True
    return out, good


def described(classes: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """(rep, n, vector, near) of each vector: near are its `prefix` nearest pivots, the nearest first."""
    held = classes.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS_MOST vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _ = _unit(batch.column(2), pivots.shape[1])
            close = x @ held.value.T
            m = min(prefix, close.shape[1])
            near = np.argpartition(-close, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(close, near, 1), axis=1, kind="stable"), 1)
            lists = pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * m, m, dtype=np.int32), pa.array(near.ravel().astype(np.int32)))
            flat = pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * x.shape[1], x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, lists], ["rep", "n", "vector", "near"])

    return classes.select("rep", "n", "embedding").mapInArrow(run, "rep bigint, n bigint, vector array<double>, near array<int>")


def inverted_lists(rows: DataFrame, shared: int) -> DataFrame:
    """(pivots, i, j, side, rep, n, vector, near): each vector in the lists in which it may meet another.

    A pair is compared in the list of the lowest pivot that both have; of a vector's sorted pivots, only those with shared - 1 others above can be that. A list
    of more than LIST_BLOCK vectors is replaced by lists of two pivots, and these by lists of three, up to `shared`: as a pair shares that
    many, no pair is lost. What is still longer is compared block by block.
    """
    low = F.array_sort("near")
    todo = rows.withColumn("low", low).select("rep", "low", F.explode(F.transform(F.slice(low, F.lit(1), F.size(low) - (shared - 1)), lambda p: F.array(p))).alias("pivots"))
    done = None
    for depth in range(1, shared + 1):
        sizes = todo.groupBy("pivots").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        sized = todo.join(sizes, "pivots")
        fits = sized if depth == shared else sized.where(F.col("_c") <= LIST_BLOCK)
        fits = fits.select("rep", "pivots", F.ceil(F.col("_c") / LIST_BLOCK).cast("int").alias("k"))
        done = fits if done is None else done.unionByName(fits)
        if depth < shared:
            above = F.filter("low", lambda p: p > F.element_at("pivots", -1))
            more = F.slice(above, F.lit(1), F.greatest(F.size(above) - (shared - depth - 1), F.lit(0)))
            todo = sized.where(F.col("_c") > LIST_BLOCK).select("rep", "low", "pivots", F.explode(more).alias("p")).select("rep", "low", F.concat("pivots", F.array("p")).alias("pivots"))
    placed = done.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    placed = placed.select("pivots", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), F.col("rep").alias("_rep"))
    return placed.join(rows, F.col("_rep") == F.col("rep")).drop("_rep")


def _compare(table: pa.Table, threshold: float, shared: int) -> pa.Table:
    """Links in one block pair of one list: rows (rep, low, links), low being the smallest class that it is linked with in this block, over steps.

    Shared pivots are counted first; cosines are worked out only for pairs that have enough of them and whose lowest shared pivots are the list's.
    """
    table = table.combine_chunks()
    rep, n, side = table["rep"].to_numpy(), table["n"].to_numpy(), table["side"].to_numpy()
    order = np.lexsort((side, rep))
    rep, n, side = rep[order], n[order], side[order]
    own, same = np.array(table["pivots"][0].as_py()), table["i"][0].as_py() == table["j"][0].as_py()
    x = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)[order]
    near = np.sort(table["near"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)[order], axis=1)
    names, code = np.unique(near, return_inverse=True)
    code = code.reshape(near.shape)
    has = np.zeros((len(rep), len(names)), np.float32)
    has[np.arange(len(rep))[:, None], code] = 1
    # pivots below the list's last that aren't the list's own: a pair that shares one of them belongs to another list
    other = has[:, (names < own[-1]) & ~np.isin(names, own)]
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links, sets = np.zeros(len(rep), np.int64), Forest(len(rep))
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        meet = has[rows] @ has[right].T >= shared
        if other.shape[1]:
            meet &= other[rows] @ other[right].T == 0
        a, b = np.nonzero(meet)
        p, q = rows[a], right[b]
        ok = q > p if same else p != q
        p, q = p[ok], q[ok]
        for start in range(0, len(p), 65_536):
            u, v = p[start : start + 65_536], q[start : start + 65_536]
            ok = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
            u, v = u[ok], v[ok]
            np.add.at(links, u, n[v])
            np.add.at(links, v, n[u])
            sets.join(u, v)
    at = np.flatnonzero(links)
    return pa.table({"rep": rep[at], "low": rep[sets.roots(at)], "links": links[at]})


def near_vectors(vectors: DataFrame, threshold: float = 0.95, prefix: int = PREFIX, shared: int = SHARED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector.

    Vectors link if their cosine, in double precision, is at least the threshold and they share `shared` of their `prefix` nearest pivots; no pair
    below the threshold links. Equal vectors become one class first, in which all link with each other. Each class enters inverted
    lists of its nearest pivots; in a list shared pivots are counted, and pairs with enough of them are verified, each pair in one list, so that nothing is
    counted twice. A block of a list gives a row per member: its links and the smallest member that they lead to. Long lists are split by further
    shared pivots and then into blocks, never capped. n_links counts other vectors.

    Vectors that are null, empty, zero or have null or non-finite components link with nothing; shorter vectors
    are taken with zeros behind; rows with a null id link with nothing and stay as they are; rows that repeat an id and its vector are one vector and come out once, while an
    id with several vectors comes out for each, and they may link with each other. Other columns are ignored; no rows give no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("embedding", lambda v: v != 0)
    whole = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    once = whole.where("_ok").groupBy("vec_id", "embedding").agg(F.lit(1).alias("_one"))
    # classes are numbered, as two of them may have the same smallest id
    classes = once.groupBy("embedding").agg(F.min("vec_id").cast("bigint").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()).checkpoint()
    total, width = classes.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    none = spark.createDataFrame([], "rep bigint, low bigint, links bigint")
    found = none
    if total:
        count = min(PIVOTS_MOST, max(PIVOTS_LEAST, int(PIVOT_FACTOR * math.sqrt(total))))
        sample = classes.select("embedding", F.xxhash64("embedding", F.lit(7)).alias("h")).orderBy("h").limit(count).collect()  # PIVOTS_MOST at most
        pivots, _ = _unit(pa.array([r["embedding"] for r in sample], pa.list_(pa.float64())), width)
        need = min(shared, len(pivots))
        placed = inverted_lists(described(classes, pivots, prefix).checkpoint(), need)
        found = placed.groupBy("pivots", "i", "j").applyInArrow(lambda t: _compare(t, threshold, need), none.schema).checkpoint()
    links = found.groupBy("rep").agg(F.sum("links").alias("_links"))
    joined = components(found.select(F.col("low").alias("a"), F.col("rep").alias("b")))
    linked = joined.join(classes.select("rep", "first"), F.col("node") == F.col("rep")).select("node", "component", "first")
    least = linked.groupBy(F.col("component").alias("_part")).agg(F.min("first").alias("_least"))
    named = classes.join(links, "rep", "left").join(linked.drop("first").join(least, F.col("component") == F.col("_part")), F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("embedding").alias("_e"), (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_n"), F.coalesce("_least", "first").alias("_c"))
    known = once.join(named, F.col("embedding") == F.col("_e")).select("vec_id", F.col("_n").cast("long").alias("n_links"), F.col("_c").cast("long").alias("component_id"))
    apart = whole.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return known.unionByName(apart).withColumn("kept", F.col("vec_id") == F.col("component_id"))
