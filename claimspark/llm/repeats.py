"""Repeated passages across documents, by windows of fixed depth that are split into groups by hashed prefixes. No suffix tree is grown: README says why."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, mixed, parts_for, prepare, slices, span_hashes, words

#: Words of a passage that counts as repeated, and of the prefix by which suffixes are split first.
WINDOW, PREFIX = 13, 5
#: Bytes of text in a bucket of documents, and bytes of text for each group of windows, at least. Both grow with the root of the text, so that a bucket has CELL_KEYS keys or more
#: for each group and the rows between them stay few: at 100 TB a bucket and a group are 245 MB of text each.
BUCKET_BYTES, GROUP_BYTES, CELL_KEYS = 4 << 20, 16 << 20, 100
#: What is added to words' hashes before the second hash of a window is made.
CHECKED = np.uint64(0x5851F42D4C957F2D)
#: Stands for a null doc_id: larger than any.
NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy())


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    out, span = values, 1
    while span * 2 <= n:
        out, span = np.minimum(out[:-span], out[span:]), span * 2
    return np.minimum(out[: len(values) - n + 1], out[n - span :][: len(values) - n + 1]) if n > span else out


def _windows(text: pa.ChunkedArray, window: int, prefix: int | None, with_check: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of the texts: its rows, the words' offsets, and place, row and hash of each window; the least hash of its prefixes, and a second hash, where asked for."""
    for lo, hi, data, at in slices(text):
        starts, ends, offsets = words(data, at)
        h = span_hashes(data, starts, ends)
        grams = gram_hashes(h, window)
        row = np.repeat(np.arange(hi - lo), np.diff(offsets))[: len(grams)]
        place = np.flatnonzero(np.arange(len(grams)) + window <= offsets[1:][row]) if len(grams) else np.zeros(0, np.int64)
        none = np.zeros(0, np.uint64)
        # least hashes lie low; mixed once more they are spread evenly over all groups
        anchor = mixed(_least(gram_hashes(h, prefix), window - prefix + 1)[place]) if prefix and len(grams) else none
        check = (gram_hashes(mixed(h + CHECKED), window)[place] >> np.uint64(32)).astype(np.uint32) if with_check and len(grams) else none.astype(np.uint32)
        yield lo, hi, offsets, place, row[place], grams[place] if len(grams) else none, anchor, check


def _summed(keys: np.ndarray, check: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts by key and check; and each of these once: where its run begins, its size, its least document, and whether it has several."""
    order = np.lexsort((check, keys)) if check.any() else np.argsort(keys, kind="stable")
    keys, check, low, high = keys[order], check[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1]))))
    least = np.minimum.reduceat(low, first)
    return order, first, np.diff(np.append(first, len(keys))), least, least != np.maximum.reduceat(high, first)


SENT = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("least", pa.binary()), ("several", pa.binary())])
TOLD = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("least", pa.binary())])


def _small(x: np.ndarray) -> bytes:
    """Numbers by bytes: all first bytes, then all second ones; the high bytes of sorted numbers repeat and shrink to little."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _large(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _send(bucket: int, keys: np.ndarray, check: np.ndarray, docs: np.ndarray, bits: int) -> pa.Table:
    """One row for each group that the bucket's keys fall into; a group is the keys with the same first bits."""
    if not len(keys):
        return SENT.empty_table()
    order, first, _, low, several = _summed(keys, check, docs, docs)
    keys, check = keys[order][first], check[order][first]
    group = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(cuts[1:], len(keys))
    return _rows(SENT, [(int(group[a]), bucket, _small(keys[a:b]), _small(check[a:b]), _small(low[a:b]), _small(several[a:b].astype(np.uint8))) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)])


def _shared(table: pa.Table) -> pa.Table:
    """A group's keys that stand in several documents. Each bucket that has some is told which, and their least document."""
    rows = table.to_pylist()
    parts = [_large(r["keys"], "u8") for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(k) for k in parts])
    keys, check, low = np.concatenate(parts), np.concatenate([_large(r["checks"], "u4") for r in rows]), np.concatenate([_large(r["least"], "i8") for r in rows])
    several = np.concatenate([_large(r["several"], "u1") for r in rows]).astype(bool)
    order, first, size, least, apart = _summed(keys, check, low, low)
    keep = np.repeat(apart | np.logical_or.reduceat(several[order], first), size)
    keys, check, least, owner = keys[order][keep], check[order][keep], np.repeat(least, size)[keep], owner[order][keep]
    back = np.argsort(owner, kind="stable")
    keys, check, least, owner = keys[back], check[back], least[back], owner[back]
    cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
    return _rows(TOLD, [(rows[k]["bucket"], _small(keys[a:b]), _small(check[a:b]), _small(least[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a])


class Told:
    """All that a bucket was told, by key."""

    def __init__(self, table: pa.Table) -> None:
        rows = table.to_pylist()
        both = [np.concatenate([np.zeros(0, kind), *[_large(r[c], kind) for r in rows]]) for c, kind in (("keys", "u8"), ("checks", "u4"), ("least", "i8"))]
        order = np.argsort(both[0], kind="stable")
        self.keys, self.checks, self.least = (x[order] for x in both)
        run = np.flatnonzero(np.concatenate(([True], self.keys[1:] != self.keys[:-1]))) if len(self.keys) else np.zeros(0, np.int64)
        self.alike = int(np.diff(np.append(run, len(self.keys))).max()) if len(run) else 0

    def find(self, keys: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key (with its check) among those told, and whether it is there."""
        found, hit = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        start = np.searchsorted(self.keys, keys)
        for step in range(self.alike):  # keys that are alike though their checks aren't stand side by side
            at = np.minimum(start + step, len(self.keys) - 1)
            here = (self.keys[at] == keys) & ~hit
            if check is not None:
                here &= self.checks[at] == check
            found[here], hit = at[here], hit | here
        return found, hit


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of each document, and with texts its kept words as kept_text.

    A window is `window` consecutive words [^\\x20\\x09-\\x0D]+ of a document; a window that also starts in a document with a smaller doc_id
    is repeated, and the words that repeated windows cover are removed. spans are the runs of removed words, start:end, comma-joined: the
    maximal repeats' places.

    Documents lie in buckets of about BUCKET_BYTES, and hashes of prefixes and windows in groups of bounded size. First come prefixes of `prefix` words, of each window only the one
    with the least hash, which equal windows share: below a prefix that stands in one document nothing repeats. Windows with the
    other prefixes are looked at whole, and those in several documents are the repeats. A bucket sends each hash once, with its
    least document, so that a passage in very many documents costs a row per bucket, and is told the least document of all. A window is
    known by 96 bits of two hashes: that any of n windows is judged wrongly has odds of n * n / 2**97, 0.0006 for 10**13 windows.

    A null text has no words; a null doc_id counts as larger than any; rows that repeat a doc_id are judged one by one and never against
    each other; documents under `window` words lose nothing; a bucket holds a very long text whole; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    grown, cores = math.isqrt(6 * CELL_KEYS * size), docs.sparkSession.sparkContext.defaultParallelism
    buckets = parts_for(size, max(BUCKET_BYTES, grown), 2 * cores)
    bits = (parts_for(size, max(GROUP_BYTES, grown), cores) - 1).bit_length()
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", F.lit(3)))
    placed = docs.select(F.pmod(place, F.lit(buckets)).cast("bigint").alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(buckets, "bucket")

    def prefixes(table: pa.Table) -> pa.Table:
        docs_of, keys, owners = _ids(table["doc_id"]), [], []
        for lo, _, _, _, row, _, anchor, _ in _windows(table["text"], window, prefix):
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))[: len(anchor)]
            keys.append(anchor[new])
            owners.append(docs_of[row[new] + lo])
        keys = np.concatenate(keys)
        return _send(table["bucket"][0].as_py(), keys, np.zeros(len(keys), np.uint32), np.concatenate(owners), bits)

    def suffixes(table: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not table.num_rows:
            return SENT.empty_table()
        docs_of, known = _ids(table["doc_id"]), Told(told)
        keys, checks, owners = [], [], []
        for lo, _, _, _, row, gram, anchor, check in _windows(table["text"], window, prefix, with_check=True):
            hit = known.find(anchor)[1]
            keys.append(gram[hit])
            checks.append(check[hit])
            owners.append(docs_of[row[hit] + lo])
        return _send(table["bucket"][0].as_py(), np.concatenate(keys), np.concatenate(checks), np.concatenate(owners), bits)

    def removed(table: pa.Table, told: pa.Table) -> pa.Table:
        docs_of, known = _ids(table["doc_id"]), Told(told)
        out: list[list] = [[], [], [], [], []]
        for lo, _, offsets, place, row, gram, _, check in _windows(table["text"], window, None, with_check=bool(known.alike)):
            at, hit = known.find(gram, check)
            if hit.any():
                hit &= known.least[at] < docs_of[row + lo]
            edge = np.zeros(int(offsets[-1]) + 1, np.int64)
            edge[place[hit]] += 1
            edge[place[hit] + window] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            lost = np.concatenate(([0], np.cumsum(gone)))[offsets]
            for k in range(len(offsets) - 1):
                tokens = table["text"][lo + k].as_py().encode().split()
                mine = gone[offsets[k] : offsets[k + 1]]
                n = int(lost[k + 1] - lost[k])
                spans = ""
                if n:
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0]))))
                    spans = ",".join(f"{a}:{b}" for a, b in turn.reshape(-1, 2).tolist())
                    tokens = [w for w, g in zip(tokens, mine.tolist(), strict=True) if not g]
                text = b" ".join(tokens)
                for column, value in zip(out, (len(mine), n, hashlib.sha256(text).hexdigest(), spans, text.decode() if texts else None), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.table([table["doc_id"], *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    sent = "grp bigint, bucket bigint, keys binary, checks binary, least binary, several binary"
    told = "bucket bigint, keys binary, checks binary, least binary"
    by_bucket = placed.groupBy("bucket")

    def shared(rows: DataFrame) -> DataFrame:
        """As many tasks as there are groups, and then as there are buckets: both grow with the text."""
        return rows.repartition(1 << bits, "grp").groupBy("grp").applyInArrow(_shared, told).repartition(buckets, "bucket")

    upper = shared(by_bucket.applyInArrow(prefixes, sent))
    lower = shared(by_bucket.cogroup(upper.groupBy("bucket")).applyInArrow(suffixes, sent))
    out = by_bucket.cogroup(lower.groupBy("bucket")).applyInArrow(removed, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, spans string, kept_text string")
    return out if texts else out.drop("kept_text")
