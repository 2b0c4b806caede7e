"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_set, new_table, parts_for, prepare, slices

END_ID = 2
#: Bytes of text that a task encodes, about.
PART_BYTES = 8 << 20
#: Parts of the files at most.
MOST_PARTS = 20_000
#: Ids of a segment, about; a document is never cut, so that a longer one makes a longer segment.
SEGMENT_IDS = 250_000
MAGIC, LEVEL_BITS, BLOCK_BITS = b"DAC1", 8, 512
#: Pieces of text after which a worker puts away those it remembers; it forgets those put away before.
CACHE_PIECES = 500_000


class Encoder:
    """A tokenizers file, with the ids of blank-separated pieces remembered.

    The byte-level pre-tokenizer starts a new token at a blank between two characters that are no white space, so that pieces cut there have the ids
    that they have in the whole text. Texts with other white space beside a blank are encoded whole.
    """

    def __init__(self, path: str) -> None:
        # a task has one core, and each thread of the library would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # pieces come once; they are remembered here
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of pieces with a blank before them: those met of late, and those before.
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.stops = {s: self.plain(s) for s in (b",", b".")}

    def plain(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes runs of pieces at once and cuts their ids where the pieces' bytes end."""
        together = b" ".join(pieces)
        odd = {p for p in pieces for s in self.special if s in p} if any(s in together for s in self.special) else set()
        for p in odd:
            self.ids[p] = self.plain(b" " + p)
        easy = [p for p in pieces if p not in odd] if odd else pieces
        runs = [easy[i : i + 48] for i in range(0, len(easy), 48)]
        codes = self.tokenizer.encode_batch_fast([(b" " + b" ".join(r)).decode() for r in runs], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(code.ids for code in codes), "<u4")
        ends = np.cumsum(np.fromiter(map(len, easy), np.int64, len(easy)) + 1)
        cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        raw, lo = ids.tobytes(), 0
        for p, hi in zip(easy, (cuts * 4).tolist(), strict=True):
            self.ids[p] = raw[lo:hi]
            lo = hi

    def openings(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that open a text, with no blank before them."""
        each = list(pieces)
        codes = self.tokenizer.encode_batch_fast([p.decode() for p in each], add_special_tokens=False)
        return {p: np.array(code.ids, "<u4").tobytes() for p, code in zip(each, codes, strict=True)}

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each text of a buffer."""
        raw, bounds = data.tobytes(), at.tolist()
        whole = _odd_blanks(data, at)
        parts = [None if odd else raw[a:b].split(b" ") for a, b, odd in zip(bounds[:-1], bounds[1:], whole.tolist(), strict=True)]
        if len(self.ids) > CACHE_PIECES:
            self.older, self.ids = self.ids, {}
        known, older, new, stopped = self.ids, self.older, [], []
        for p in set(chain.from_iterable(x[1:] for x in parts if x)).difference(known):
            if (ids := older.get(p)) is not None:
                known[p] = ids
            elif p[-1:] in self.stops and p[-2:-1].isalnum():  # a stop behind a letter or digit is a token of its own
                stopped.append(p)
            else:
                new.append(p)
        # not difference() of all three, which would go through all that is remembered
        new += {q for p in stopped if (q := p[:-1]) not in known and q not in older}.difference(new)
        self.learn(new)
        for p in stopped:
            known[p] = (known.get(p[:-1]) or older[p[:-1]]) + self.stops[p[-1:]]
        first, out = self.openings({x[0] for x in parts if x}), []
        for k, x in enumerate(parts):
            if x is None:
                out.append(self.plain(raw[bounds[k] : bounds[k + 1]]))
            else:
                out.append(first[x[0]] + b"".join(map(known.__getitem__, x[1:])))
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder, with what it remembers, serves all tasks that the worker runs."""
    return Encoder(path)


BLANK_LIKE = byte_set((0x09, 0x0D), (0x1C, 0x20))
#: First bytes of all white space beyond ASCII, and of much else.
WIDE_BLANK = byte_set((0xC2, 0xC2), (0xE1, 0xE3))


def _odd_blanks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts may have a blank beside other white space or at their end, or characters that may be white space beyond ASCII."""
    if not len(data):
        return np.zeros(len(at) - 1, bool)
    white, blank = BLANK_LIKE[data], data == 0x20
    odd = WIDE_BLANK[data]
    odd[:-1] |= (blank[:-1] & white[1:]) | (white[:-1] & blank[1:])
    ends = at[1:][at[1:] > at[:-1]] - 1
    odd[ends] |= blank[ends]
    odd[at[:-1][at[1:] > at[:-1]]] |= blank[at[:-1][at[1:] > at[:-1]]]
    sums = np.concatenate(([0], np.cumsum(odd)))
    return sums[at[1:]] > sums[at[:-1]]


def pack(ids: np.ndarray, starts: np.ndarray, names: list[int | None], before: int) -> bytes:
    """A segment: header, document names and starts, then for each level its chunks, continuation bits and rank directory.

    Each id is cut into 8-bit chunks, lowest first. Level k holds the chunks of the ids that are that long, and a bit for each that says
    whether it goes on. The directory counts the bits before each block of 512, so that a chunk's place on the next level takes one look and
    a count inside a block.
    """
    has = np.array([n is not None for n in names], np.uint8)
    out = [np.array([n or 0 for n in names], "<i8").tobytes(), has.tobytes(), starts.astype("<u8").tobytes()]
    levels, rest = 0, ids.astype(np.uint64)
    while levels == 0 or len(rest):
        low = (rest & np.uint64(255)).astype(np.uint8)
        high = rest >> np.uint64(LEVEL_BITS)
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK_BITS // 8)))
        per_block = np.bitwise_count(bits).reshape(-1, BLOCK_BITS // 8).sum(axis=1, dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u4")
        out += [struct.pack("<III", len(low), len(bits), len(ranks)), low.tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, levels = high[more], levels + 1
    return MAGIC + struct.pack("<IIQQ", len(names), levels, len(ids), before) + b"".join(out)


class Segment:
    """Reads a packed segment in place."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.docs, levels, self.n, self.before = struct.unpack_from("<IIQQ", raw, 4)
        at = 28
        names = np.frombuffer(raw, "<i8", self.docs, at)
        has = np.frombuffer(raw, np.uint8, self.docs, at + 8 * self.docs)
        self.names = [n if h else None for n, h in zip(names.tolist(), has.tolist(), strict=True)]
        at += 9 * self.docs
        self.starts = np.frombuffer(raw, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        self.levels = []
        for _ in range(levels):
            n, b, r = struct.unpack_from("<III", raw, at)
            at += 12
            self.levels.append((np.frombuffer(raw, np.uint8, n, at), np.frombuffer(raw, np.uint8, b, at + n), np.frombuffer(raw, "<u4", r, at + n + b)))
            at += n + b + 4 * r

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits before place i."""
        _, bits, ranks = self.levels[level]
        block, byte = i // BLOCK_BITS, i // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK_BITS // 8) : byte]).sum())
        return n + (int(bits[byte]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else n

    def token(self, i: int) -> int:
        """The i-th id of the segment, without decoding any other."""
        out = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            out |= int(chunks[i]) << LEVEL_BITS * level
            if not int(bits[i // 8]) >> i % 8 & 1:
                return out
            i = self._rank(level, i)
        return out

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, reading only their own chunks."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        out, places = np.zeros(hi - lo, "<u4"), np.arange(hi - lo)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks[lo:hi].astype("<u4") << np.uint32(LEVEL_BITS * level)
            on = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 :][: hi - lo].astype(bool)
            if not on.any():
                break
            lo = self._rank(level, lo)
            hi, places = lo + int(on.sum()), places[on]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def write_segments(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the documents' ids, each with end_id behind it, as segments in ascending order of doc_id.

    The rows of the files are (part, seq, docs, ids, segment): part and seq give the order, and the columns beside the segment are its index. Segments are
    neither compressed nor put into dictionaries, so that a segment's bytes can be used as they lie in the file. Documents are range-partitioned by
    doc_id into parts of about PART_BYTES of text. doc_ids are integers of at most 64 bits.

    Rows that repeat a doc_id are ordered by their texts' hashes, and rows alike in both are interchangeable; null ids come first; null and empty texts
    have the end id only; a very long text is never cut and makes a longer segment; other columns, whatever their names, are left out; no rows give files
    without segments.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        held: list[bytes] = []
        sizes = [0]
        seq = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before
            ids = np.frombuffer(b"".join(held), "<u4")
            raw = pack(ids, np.array(sizes), names, before)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "docs": [len(names)], "ids": [len(ids)], "segment": [raw]}, schema=SCHEMA)
            seq, before = seq + 1, before + len(ids)
            names.clear()
            held.clear()
            sizes[:] = [0]
            return row

        for batch in batches:
            for lo, hi, data, at in slices(batch.column(1)):
                for name, ids in zip(batch.column(0)[lo:hi].to_pylist(), encoder.encode(data, at), strict=True):
                    names.append(name)
                    held.append(ids + end)
                    sizes.append(sizes[-1] + len(ids) // 4 + 1)
                    if sizes[-1] >= SEGMENT_IDS:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a task writes many segments one after the other, so that parts may be large; their bounds are held by the driver and so are few
    parts = min(parts_for(size, PART_BYTES, docs.sparkSession.sparkContext.defaultParallelism), MOST_PARTS)
    rows = rows.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    rows.select("doc_id", "text").mapInArrow(run, "part int, seq int, docs bigint, ids bigint, segment binary").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("segment", pa.binary())])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files; start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Segment(raw)
                sums = [zlib.crc32(s.document(k).tobytes()) for k in range(s.docs)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays([pa.array(s.names, pa.int64()), pa.array(s.starts[:-1] + s.before), pa.array(np.diff(s.starts)), pa.array(sums, pa.int64()), pa.array([part] * n, pa.int32())], ["doc_id", "at", "n_tokens", "ids_crc32", "part"])

    segments = spark.read.parquet(path)
    found = segments.select("part", "segment").mapInArrow(run, "doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, part int")
    parts = segments.groupBy("part").agg(F.sum("ids").alias("_ids"))  # a row per partition
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return found.join(parts, "part").select("doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, place: int) -> int:
    """The id at one place of all files: the index says which segment has it, and only that segment's cell is read."""
    index = spark.read.parquet(path).select("part", "seq", "ids")
    parts = index.groupBy("part").agg(F.sum("ids").alias("n"))
    ends = parts.withColumn("end", F.sum("n").over(Window.orderBy("part"))).where(F.col("end") > place)  # a row per part
    part = ends.orderBy("part").select("part", (F.col("end") - F.col("n")).alias("before")).first()
    if part is None or place < 0:
        raise IndexError(place)
    rows = index.where(F.col("part") == part["part"]).withColumn("end", F.sum("ids").over(Window.orderBy("seq")) + part["before"])  # a row per segment of the part
    row = rows.where(F.col("end") > place).orderBy("seq").first()
    raw = spark.read.parquet(path).where((F.col("part") == part["part"]) & (F.col("seq") == row["seq"])).select("segment").first()["segment"]
    return Segment(bytes(raw)).token(place - (row["end"] - row["ids"]))


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files to a new table in the shared folder and reads them back; no rows give no rows."""
    path = new_table(docs.sparkSession, "token-ids")
    write_segments(docs, tokenizer, path, end_id)
    return read_documents(docs.sparkSession, path)
