"""Spelling variants: words one edit apart, found by a frontier of states that is joined with the edges of tries, level by level."""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.session import written

from .common import LOWER, byte_set, prepare, slices, words

#: Code points and occurrences that make a word; how many times as frequent as a word its form must be.
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
#: One in so many (document, run) pairs loses a code point.
DAMAGE = 31
#: Words that a task counts before it passes the counts on.
HELD_WORDS = 200_000
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A))
TRUE = byte_set((1, 1))
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
EDGES = pa.schema([("node", pa.int64()), ("label", pa.string()), ("child", pa.int64()), ("leaf", pa.string()), ("leaf_n", pa.int64())])


def _words_of(doc_id: str | None, runs: list[bytes], total: Counter) -> None:
    """Adds a document's words: its runs, one in DAMAGE of them without one code point."""
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in Counter(runs).items():
        h = zlib.crc32(run, start)
        if h % DAMAGE == 0:
            text = run.decode()
            k = h % len(text)
            run = (text[:k] + text[k + 1 :]).encode() if len(text) > LEAST_LENGTH else b""
        if run:
            total[run] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points that occur LEAST_COUNT times and more in all texts together.

    Runs are maximal [A-Za-z\\u00C0-\\u00FF]+, of which A-Z are lower-cased. Where DAMAGE divides the crc32 of <doc_id>:<run>, the run loses its code point crc32 modulo
    its length; a null doc_id is written as nothing. A task passes its counts on whenever it holds HELD_WORDS words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], schema=COUNTS)
            total.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, data, at in slices(batch.column(1)):
                lead = data == 0xC3  # and the byte behind it: U+00C0 to U+00FF
                inside = LETTERS[data] | lead
                inside[1:] |= lead[:-1]
                starts, ends, offsets = words(inside.view(np.uint8), at, TRUE)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                long = points[ends] - points[starts] >= LEAST_LENGTH
                bounds = np.concatenate(([0], np.cumsum(long)))[offsets].tolist()
                raw = LOWER[data].tobytes()
                runs = [raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
                for k in range(len(bounds) - 1):
                    if bounds[k + 1] > bounds[k]:
                        _words_of(ids[lo + k], runs[bounds[k] : bounds[k + 1]], total)
                if len(total) > HELD_WORDS:
                    yield passed_on()
        if total:
            yield passed_on()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def node_name(backward: int, length: int, prefix: str) -> int:
    """The name of a node: 64 bits of its trie (direction, length of words) and prefix. What equal names mix up, the last check of pairs sorts out."""
    h = xxhash.xxh64_intdigest(f"{backward}:{length}:{prefix}".encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _node(backward: Column, length: Column, prefix: Column) -> Column:
    return F.xxhash64(F.concat_ws(":", backward.cast("string"), length.cast("string"), prefix))


def _shared(a: str, b: str) -> int:
    """Code points at the start of both."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _edges(rows: Iterator[tuple[int, int, str, str, int]]) -> Iterator[tuple[int, str, int, str | None, int | None]]:
    """Edges of the tries of words that come sorted: a trie for each direction and length of words, its paths compressed.

    Nodes are where words part, the two depths in the middle where a search may begin, and the ends of words. What lies above the middle is left out. Only the path of the
    last word is held.
    """
    trie, text, own, depths = (-1, -1), "", ("", 0), []

    def close(to: int) -> Iterator[tuple[int, str, int, str | None, int | None]]:
        """Ends the nodes of the last word that lie deeper than `to`, where the next word parts."""
        while depths and depths[-1] > to:
            end = depths.pop()
            if not depths:
                return
            if depths[-1] < to:
                depths.append(to)
            leaf = own if end == len(text) else (None, None)
            yield node_name(*trie, text[: depths[-1]]), text[depths[-1] : end], node_name(*trie, text[:end]), *leaf

    for backward, length, new, word, n in rows:
        part = _shared(text, new) if trie == (backward, length) else -1
        yield from close(part)
        trie, text, own = (backward, length), new, (word, n)
        depths.extend(d for d in sorted({length // 2, (length + 1) // 2, length}) if d > part)
    yield from close(-1)


def edge_table(vocabulary: DataFrame) -> DataFrame:
    """(node, label, child, leaf, leaf_n): the edges of all tries of the words and, for tries of the words read backwards, of those; leaf is the word that ends at the child.

    Words are range-sorted and tasks build the tries of their ranges, one word at a time. Where a range ends within a trie both sides give the edges that they
    share, or longer ones that begin alike; the search takes either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        held = []
        for edge in _edges(rows()):
            held.append(edge)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), EDGES, strict=True)], schema=EDGES)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), EDGES, strict=True)], schema=EDGES)

    both = vocabulary.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("backward"), F.char_length("word").alias("length"), "word", "n")
    both = both.select("backward", "length", F.when(F.col("backward") == 1, F.reverse("word")).otherwise(F.col("word")).alias("text"), "word", "n")
    ranged = both.repartitionByRange("backward", "length", "text").sortWithinPartitions("backward", "length", "text")
    return ranged.mapInArrow(run, "node bigint, label string, child bigint, leaf string, leaf_n bigint")


def first_states(vocabulary: DataFrame) -> DataFrame:
    """(word, n, node, rest, edits, shorter): where each word's searches begin, rest being what is still to be read.

    Of two words one edit apart, the code points before or behind the edit are at least half of the longer one. So a word searches forward and backward, and both begin
    in the middle, behind a half that must be the same: among words of its own length, and, without one code point (shorter), among words one shorter.
    """
    length = F.char_length("word")
    way = F.explode(F.array(*[F.struct(F.lit(b).alias("backward"), F.lit(s).alias("shorter")) for b in (0, 1) for s in (False, True)])).alias("way")
    rows = vocabulary.select("word", "n", length.alias("length"), way).select("word", "n", "length", "way.*").where(~F.col("shorter") | (F.col("length") > LEAST_LENGTH))
    rows = rows.withColumn("text", F.when(F.col("backward") == 1, F.reverse("word")).otherwise(F.col("word"))).withColumn("half", F.expr("length div 2").cast("int"))
    node = _node(F.col("backward"), F.col("length") - F.col("shorter").cast("int"), F.substring("text", F.lit(1), F.col("half")))
    return rows.select("word", "n", node.alias("node"), F.substring("text", F.col("half") + 1, F.col("length")).alias("rest"), F.lit(0).alias("edits"), "shorter")


def next_states(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level on, with the leaf that each has come to, if any.

    A state goes along an edge whose label it reads, or, if it has no edit yet, along one whose label it reads with one. Of two words of one length only the one that is first in order
    makes the edit. A code point is left out as late as may be, so that no edge is taken both ways.
    """
    size = F.char_length("label")
    same = F.startswith("rest", F.col("label"))
    read = F.when(F.col("shorter"), F.substring("rest", F.lit(1), size + 1)).otherwise(F.substring("rest", F.lit(1), size))
    edited = (F.col("edits") == 0) & (F.col("shorter") | (F.col("label") > read)) & (F.levenshtein("label", read, 1) == 1)
    rows = frontier.join(edges.withColumnRenamed("node", "_node"), (F.col("node") == F.col("_node")) & (same | edited))
    gone = size + F.when(~same & F.col("shorter"), 1).otherwise(0)
    return rows.select("word", "n", F.col("child").alias("node"), F.substring("rest", gone + 1, F.char_length("rest")).alias("rest"), F.when(same, F.col("edits")).otherwise(1).alias("edits"), "shorter", "leaf", "leaf_n")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words, both ways round, that differ by exactly one inserted, deleted or replaced code point.

    The frontier is joined with the edges until no state is left: as many rounds as words part from others behind their middles. A word has at most as many edges to look at
    as there are letters, so that a prefix which very many words share gives no pairs among these.
    """
    edges, frontier, found = written(edge_table(vocabulary)), first_states(vocabulary), []
    while True:
        level = written(next_states(frontier, edges))
        found.append(level.where(F.col("leaf").isNotNull() & (F.col("shorter") | (F.col("edits") == 1))).select("word", "n", F.col("leaf").alias("near"), F.col("leaf_n").alias("near_n")))
        frontier = level.where("leaf is null").drop("leaf", "leaf_n")
        if frontier.isEmpty():
            break
    pairs = functools.reduce(DataFrame.unionByName, found).where(F.levenshtein("word", "near", 1) == 1)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both.repartition("word").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. A form is FORM_FACTOR times as frequent as its word, so that chains are short and never come back."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("_w"), F.col("root").alias("_far"))
        after = written(now.join(far, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near words' number, the most frequent of them (of equals the first in code-point order) if that is
    FORM_FACTOR times as frequent, and the last form that forms lead to, or the word itself.

    Null and empty texts have no words; rows that repeat a doc_id count each; other columns are ignored; words and texts may be of any length; no rows give no rows.
    """
    prepare(docs.sparkSession)
    vocabulary = written(word_counts(docs))
    best = near_pairs(vocabulary).groupBy("word").agg(F.first("n").alias("_n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    taken = -F.col("b.m") >= FORM_FACTOR * F.col("_n")
    known = written(best.select("word", "n_near", F.when(taken, F.col("b.near")).alias("form"), F.when(taken, -F.col("b.m")).alias("form_n")))
    roots = followed(known.where("form is not null")).withColumnRenamed("word", "_w")
    rows = vocabulary.join(known.withColumnRenamed("word", "_k"), F.col("word") == F.col("_k"), "left").join(roots, F.col("word") == F.col("_w"), "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
