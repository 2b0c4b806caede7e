"""Benchmark decontamination by templates: numbers, names and units become slots, whose values must then agree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_set, fresh_names, mixed, poly_hashes, prepare, slices, span_hashes, words

#: Words of a window at least, and how many of them must be no slots; a window goes on until it has them.
WINDOW, LITERALS = 10, 6
#: An item without such a window is one window as a whole. If it has so many words and literals it is looked for anywhere; of fewer, it must be whole sentences or lines of a
#: document, as its template says little. Word for word it is looked for anywhere down to RUN words.
WHOLE, WHOLE_LITERALS, RUN = 6, 2, 3
#: How words are read: as typed, with capitals inside sentences as names; in lower case with numbers and units as slots; in lower case without slots; and as typed, with all
#: capitals as names, those that open a sentence too.
TYPED, FOLDED, EXACT, OPENED = range(4)
#: Bits of the filter that says which windows of documents are worth a look; its size is all that is sent to the tasks, in CHUNK_BITS at a time.
FILTER_BITS, CHUNK_BITS = 1 << 22, 1 << 15
# fixed values: units of measurement that follow a number
UNITS = """kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yard yards l ml litre litres liter liters gallon gallons
second seconds sec minute minutes min hour hours hr hrs day days week weeks month months year years dollar dollars cent cents euro euros
pound pounds percent degree degrees mph kmh watt watts volt volts""".split()

WORD_BYTES = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
DIGIT, UPPER = byte_set((0x30, 0x39)), byte_set((0x41, 0x5A))
STOP = byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x0A, 0x0A), (0x0D, 0x0D))
LITERAL, NUMBER, NAME, UNIT, OPENER = range(5)
SLOT_HASHES = mixed(np.arange(1, 5, dtype=np.uint64) << np.uint64(50))
_unit_text = " ".join(UNITS).encode()
_unit_bytes = np.frombuffer(_unit_text, np.uint8)
UNIT_HASHES = np.sort(span_hashes(_unit_bytes, *words(_unit_bytes, np.array([0, len(_unit_bytes)]), WORD_BYTES)[:2]))


@dataclass
class Template:
    """The words of a buffer of texts: byte places, hashes (those of a slot being its kind's), kinds, the offsets of each text's words, and which words open a sentence or line."""

    starts: np.ndarray
    ends: np.ndarray
    h: np.ndarray
    kind: np.ndarray
    offsets: np.ndarray
    opens: np.ndarray

    def as_form(self, slots: tuple[int, ...]) -> Template:
        """With these kinds as slots, an opener being a name; h must still be the words' own."""
        kind = np.where(np.isin(self.kind, slots), np.where(self.kind == OPENER, NAME, self.kind), LITERAL).astype(np.uint8)
        return Template(self.starts, self.ends, np.where(kind > 0, SLOT_HASHES[kind], self.h), kind, self.offsets, self.opens)


def read_words(data: np.ndarray, at: np.ndarray) -> Template:
    """All words with the kinds that they may have.

    Words are runs of letters, digits and bytes beyond ASCII; a point or comma between digits belongs to the number. A word with a digit is a
    number; a known unit after a number is a unit; a capitalised word is a name, or an opener if it opens a sentence; all else counts in lower case.
    """
    inside = WORD_BYTES[data]
    digit = DIGIT[data]
    if len(data) > 2:
        mark = (data[1:-1] == 0x2E) | (data[1:-1] == 0x2C)
        inside[1:-1] |= mark & digit[:-2] & digit[2:]
    starts, ends, offsets = words(inside.astype(np.uint8), at, np.arange(256) == 1)
    if not len(starts):
        return Template(starts, ends, np.zeros(0, np.uint64), np.zeros(0, np.uint8), offsets, np.zeros(0, bool))
    h = span_hashes(LOWER[data], starts, ends)
    digits = np.concatenate(([0], np.cumsum(digit)))
    number = digits[ends] > digits[starts]
    first = np.zeros(len(starts), bool)
    first[offsets[:-1][offsets[:-1] < len(starts)]] = True
    stops = np.concatenate(([0], np.cumsum(STOP[data])))
    opens = first | np.concatenate(([True], stops[starts[1:]] > stops[ends[:-1]]))
    after = np.minimum(starts + 1, len(data) - 1)
    capital = UPPER[data[starts]] | ((data[starts] == 0xC3) & (data[after] >= 0x80) & (data[after] <= 0x9E))
    unit = np.isin(h, UNIT_HASHES) & np.concatenate(([False], number[:-1])) & ~first
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(capital, np.where(opens, OPENER, NAME), LITERAL))).astype(np.uint8)
    return Template(starts, ends, h, kind, offsets, opens)


def forms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Template]]:
    """(form, first row, bytes, template) of each slice of the texts in each form."""
    for lo, _, data, at in slices(texts):
        typed = read_words(data, at)
        yield TYPED, lo, data, typed.as_form((NUMBER, NAME, UNIT))
        yield OPENED, lo, data, typed.as_form((NUMBER, NAME, UNIT, OPENER))
    for lo, _, data, at in slices(pc.utf8_lower(texts)):
        plain = read_words(data, at)
        yield FOLDED, lo, data, plain.as_form((NUMBER, UNIT))
        yield EXACT, lo, data, plain.as_form(())


def growing(t: Template) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the window that opens at each word: WINDOW words and more, until LITERALS of them are no slots; none that leaves its text."""
    literals = np.concatenate(([0], np.cumsum(t.kind == LITERAL)))
    first = np.arange(len(t.h))
    end = np.maximum(first + WINDOW, np.searchsorted(literals, literals[:-1] + LITERALS))
    last = np.repeat(t.offsets[1:], np.diff(t.offsets))
    ok = end <= last
    return first[ok], end[ok]


def of_size(t: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of so many words; of fewer than RUN only those that are a whole text. A size below zero stands for runs that are whole sentences or lines."""
    n = np.diff(t.offsets)
    if size < 0:
        opens = np.append(t.opens, True)
        first = np.flatnonzero(t.opens)
        first = first[first - size <= t.offsets[1:][np.searchsorted(t.offsets, first, "right") - 1]]
        first = first[opens[first - size]]
        return first, first - size
    if size < RUN:
        first = t.offsets[:-1][n == size]
    else:
        first = np.arange(len(t.h))
        first = first[first + size <= np.repeat(t.offsets[1:], n)]
    return first, first + size


def whole_items(t: Template, form: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first, end) of the items that have no window of their own in this form."""
    literals = np.concatenate(([0], np.cumsum(t.kind == LITERAL)))
    n, own = np.diff(t.offsets), literals[t.offsets[1:]] - literals[t.offsets[:-1]]
    if form == EXACT:
        short = (n > 0) & (n < WINDOW)
    else:
        bare = ((n < WINDOW) | (own < LITERALS)) & (own > 0)
        short = bare & (n >= WHOLE) & (own >= WHOLE_LITERALS)
        # without a slot an item is looked for word for word
        for size in np.unique(n[bare & ~short & (own < n)]).tolist():
            first = t.offsets[:-1][bare & ~short & (own < n) & (n == size)]
            yield -size, first, first + size
    for size in np.unique(n[short]).tolist():
        first = t.offsets[:-1][short & (n == size)]
        yield size, first, first + size


ROWS = "id {kind}, form int, size int, place bigint, template string, slots array<string>, gram bigint"


def _rows(ids: pa.Array, form: int, size: int, lo: int, data: np.ndarray, t: Template, first: np.ndarray, end: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
    """Windows with their literals and typed slots written out. size 0 stands for windows that grow."""
    low, found, values = LOWER[data].tobytes(), [], []
    row = np.searchsorted(t.offsets, first, "right") - 1
    kinds = t.kind.tolist()
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        parts = [low[t.starts[k] : t.ends[k]].decode("utf-8", "replace") for k in range(a, b)]
        values.append([p for p, k in zip(parts, kinds[a:b], strict=True) if k])
        found.append(" ".join(f"\0{k}" if k else p for p, k in zip(parts, kinds[a:b], strict=True)))
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row + lo)), pa.array([form] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array((first - t.offsets[row]).astype(np.int64)), pa.array(found, pa.string()), pa.array(values, pa.list_(pa.string())), pa.array(grams.view(np.int64))],
        ["id", "form", "size", "place", "template", "slots", "gram"],
    )


def _grams(t: Template, form: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return poly_hashes(t.h, first, end) + SLOT_HASHES[form]


def item_windows(items: DataFrame) -> DataFrame:
    """All windows of the benchmark's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for form, lo, data, t in forms(batch.column(1)):
                if not len(t.h):
                    continue
                shapes = [(WINDOW, *of_size(t, WINDOW)) if form == EXACT else (0, *growing(t)), *whole_items(t, form)]
                for size, first, end in shapes:
                    yield _rows(batch.column(0), form, size, lo, data, t, first, end, _grams(t, form, first, end))

    return items.select("item_id", "text").mapInArrow(run, ROWS.format(kind=items.schema["item_id"].dataType.simpleString()))


def document_windows(docs: DataFrame, shapes: list[tuple[int, int]], wanted: object) -> DataFrame:
    """The documents' windows of these (form, size) that the filter lets through, all in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for form, lo, data, t in forms(batch.column(1)):
                for size in (s for f, s in shapes if f == form and len(t.h)):
                    first, end = of_size(t, size) if size else growing(t)
                    grams = _grams(t, form, first, end)
                    bit = grams % np.uint64(FILTER_BITS)
                    hit = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    if hit.any():
                        yield _rows(batch.column(0), form, size, lo, data, t, first[hit], end[hit], grams[hit])

    return docs.select("doc_id", "text").mapInArrow(run, ROWS.format(kind=docs.schema["doc_id"].dataType.simpleString()))


def _filter(own: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, put together by executors in pieces of CHUNK_BITS, of which the driver gets as many as there are."""

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK_BITS, bool)
        bits[table["bit"].to_numpy() % CHUNK_BITS] = True
        return pa.table({"chunk": table["chunk"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    # FILTER_BITS is a power of two, so that the remainder of a signed number's bits is that of the unsigned one
    bits = own.select(F.pmod("gram", F.lit(FILTER_BITS)).alias("bit")).distinct().withColumn("chunk", F.expr(f"bit div {CHUNK_BITS}"))
    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.groupBy("chunk").applyInArrow(pack, "chunk bigint, bits binary").collect():  # FILTER_BITS // CHUNK_BITS rows at most
        wanted[r["chunk"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return wanted


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, n_changed, exact) for each document that holds a benchmark item's window.

    A window opens at each word and has WINDOW words, or as many more as it takes until LITERALS of them are no slots; windows are joined on their
    template, in which each slot shows whether it is a number, a name or a unit. An item without such a window is one window as a whole: anywhere, if it has WHOLE words
    and WHOLE_LITERALS literals, and else, if it has a literal at all, where whole sentences or lines of a document are its template. All this is done with and without openers of
    sentences as names; in lower case (of all alphabets) with numbers and units as the only slots; and word for word in lower case
    with WINDOW words, so that capitals and full stops hide nothing; items down to RUN words are looked for word for word as a whole, and those
    of one or two words without a slot only as whole documents. Windows of a document and an item with the same distance between their places belong to one
    alignment, in which each value of the item's slots must stand for one value of the document's; other alignments are dropped. The largest alignment
    counts, of equals the one with fewer changes, then one that takes no opener for a name; exact: none of its values differs. What one item gives doesn't depend on the others: a filter of FILTER_BITS bits made from the
    benchmark's windows goes before the join, and only lets more through when the benchmark is large.

    Null and empty texts match nothing, null ids are ids; repeated rows count once, their windows together; other columns are ignored; a very long text is read whole, in memory in
    proportion to it.
    """
    spark = prepare(docs.sparkSession)
    own = item_windows(benchmark.select("item_id", "text").dropDuplicates()).checkpoint()
    shapes = sorted((r["form"], r["size"]) for r in own.select("form", "size").distinct().collect())  # some eight for each number of words of an item at most
    theirs = document_windows(docs, shapes, spark.sparkContext.broadcast(_filter(own)))
    own = own.select(F.col("id").alias("item_id"), F.col("form").alias("_form"), F.col("size").alias("_size"), F.col("place").alias("_place"), F.col("template").alias("_template"), F.col("slots").alias("_slots"))
    both = theirs.join(own, (F.col("template") == F.col("_template")) & (F.col("form") == F.col("_form")) & (F.col("size") == F.col("_size")))
    rows = both.select(F.col("id").alias("doc_id"), "item_id", "form", (F.col("place") - F.col("_place")).alias("shift"), "place", F.arrays_zip(F.col("_slots").alias("item"), F.col("slots").alias("doc")).alias("pairs"))
    # the pairs of an alignment are no more than the item's slots times the rows that repeat its document's id
    lined = rows.groupBy("doc_id", "item_id", "form", "shift").agg(F.count_distinct("place").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    lined = lined.withColumn("n_slots", F.size(F.array_distinct(F.col("pairs.item")))).where(F.size("pairs") == F.col("n_slots"))
    lined = lined.withColumn("n_changed", F.size(F.filter("pairs", lambda p: ~p["item"].eqNullSafe(p["doc"]))))
    best = lined.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", (-F.col("n_changed")).alias("c"), (F.col("form") != OPENED).alias("plain"), "n_slots")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_windows"), F.col("m.n_slots"), (-F.col("m.c")).alias("n_changed"), (F.col("m.c") == 0).alias("exact"))


def without_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item, as often as they came, with columns of any name; a null doc_id stays."""
    (hit,) = fresh_names(docs, "hit")
    found = matches(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(hit), "left_anti")
