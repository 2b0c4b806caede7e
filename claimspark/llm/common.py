"""What the operators share: the shared folder, Arrow text buffers, word boundaries and hashes on whole buffers."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import shared_folder, workers_find

#: Rows and bytes that Spark hands to Python at a time; long texts make large rows.
ARROW_ROWS, ARROW_BYTES = 2048, 8 << 20
#: Bytes of text that numpy works on at a time.
SLICE_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and the checkpoint folder that the cluster names."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    shared_folder(spark)
    return workers_find(spark)


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh_names(frame: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in frame.columns}
    return [next(x for k in range(len(taken) + 1) if (x := f"_{name}{k or ''}") not in taken) for name in names]


#: Rows of a small table that are sent to all tasks; with more it is joined like any other.
MOST_SENT = 100_000


def sent(small: DataFrame) -> DataFrame:
    """A table that is written down already, marked to be sent to all tasks if it has MOST_SENT rows at most."""
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions so that one holds about per_part rows, however many rows there are."""
    return max(least, -(-rows // per_part))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and their n+1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about `most` bytes; a longer text is a run of its own."""
    data, at = buffers(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: The bytes of [^\x20\x09-\x0D]: all but ASCII white space.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of `inside` bytes, never across texts, and the n+1 offsets of each text's runs."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(mask & (edge[:-1] | ~np.concatenate(([False], mask[:-1]))))
    ends = np.flatnonzero(mask & (edge[1:] | ~np.concatenate((mask[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, at)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 5
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running sum over the buffer."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i], ..., h[i + n - 1] for each i; fewer than n: none. Runs across texts too; the caller leaves those out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[n - 1 :].copy()
    for k in range(n - 2, -1, -1):
        out *= np.uint64(BASE)
        out += h[k : len(h) - n + 1 + k]
    return mixed(out)


def poly_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of h[first], ..., h[end - 1] for each pair of places, from one running sum."""
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(20, int(len(h)).bit_length()))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
