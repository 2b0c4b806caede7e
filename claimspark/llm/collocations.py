"""Collocations: phrases whose words stand together far more often than their parts would, from counts kept in suffix and in prefix order."""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import written

from .common import LOWER, byte_set, gram_hashes, mixed, parts_for, prepare, sent, slices, span_hashes, words
from .repeats import _large, _rows, _small

#: Words of a phrase, occurrences of a candidate, phrases for each language, and the share of its occurrences, in hundredths, with which a longer one takes a candidate's place.
LONGEST, LEAST, FIRST, SHARE = 3, 10, 2_000, 50
SCALE = 1_000_000
#: Bytes of text in a bucket and for each group of keys, at least. Both grow with the root of the text, so that a bucket has CELL_KEYS keys or more for each group.
BUCKET_BYTES, GROUP_BYTES, CELL_KEYS = 16 << 20, 8 << 20, 100
#: Counts that a task scans in their order, about, and how many sampled keys stand for a task when the orders are cut.
TASK_COUNTS, SAMPLED = 400_000, 64
# fixed values: what ends a piece of text, and what else parts words
BREAKS = byte_set(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
IN_WORD = ~(BREAKS | byte_set((0x20, 0x20), (0x09, 0x09)))
NO_LANGUAGE = "und"

SENT = pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TOLD = pa.schema([("bucket", pa.int64()), ("keys", pa.binary())])
SPELLED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


class Slice:
    """Words of a run of texts, and the keys of their n-grams: hashes that tell languages and lengths apart."""

    def __init__(self, langs: list[str], data: np.ndarray, at: np.ndarray) -> None:
        self.langs = langs
        low = LOWER[data]
        self.raw = low.tobytes()
        self.starts, self.ends, offsets = words(low, at, IN_WORD)
        self.row = np.repeat(np.arange(len(langs)), np.diff(offsets))
        self.hashes = span_hashes(low, self.starts, self.ends)
        self.piece = np.concatenate(([0], np.cumsum(BREAKS[data])))[self.starts]
        known = {lang: xxhash.xxh64_intdigest(lang.encode(), 7) for lang in set(langs)}
        self.seed = np.array([known[x] for x in langs], np.uint64)[self.row]

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of the n words from each place on, and whether they are n words of one piece of one text."""
        g = gram_hashes(self.hashes, n) if n > 1 else self.hashes
        last = len(self.hashes) - len(g)
        whole = (self.row[: len(g)] == self.row[last:]) & (self.piece[: len(g)] == self.piece[last:])
        return mixed(g + self.seed[: len(g)] + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))), whole

    def phrase(self, place: int, n: int) -> bytes:
        return b" ".join(self.raw[self.starts[place] : self.ends[place + n - 1]].split())


def _slices(table: pa.Table) -> Iterator[Slice]:
    langs = [x if x is not None else NO_LANGUAGE for x in table["lang"].to_pylist()]
    for lo, hi, data, at in slices(table["text"]):
        yield Slice(langs[lo:hi], data, at)


def _sums(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts (of 1s, where there are none)."""
    flat = np.concatenate([np.zeros(0, np.uint64), *keys])
    if counts is None:
        return np.unique(flat, return_counts=True)
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.add.reduceat(n, first) if len(first) else n


def _cells(bucket: int, found: Iterator[np.ndarray], bits: int) -> pa.Table:
    """One row for each group that the bucket's keys fall into: the keys with the same first bits, and their counts. Keys are summed up whenever a few million are held."""
    keys, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for new in found:
        once, n = _sums([new])
        keys.append(once)
        counts.append(n)
        held += len(once)
        if held > 4_000_000:
            once, n = _sums(keys, counts)
            keys, counts, held = [once], [n], 0
    once, n = _sums(keys, counts)
    if not len(once):
        return SENT.empty_table()
    group = (once >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(once), np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(cuts[1:], len(once))
    return _rows(SENT, [(int(group[a]), bucket, _small(once[a:b]), _small(n[a:b])) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)])


def _frequent(table: pa.Table, least: int) -> pa.Table:
    """A group's keys that come `least` times, told to each bucket that has some of them."""
    rows = table.to_pylist()
    parts = [_large(r["keys"], "u8") for r in rows]
    once, total = _sums(parts, [_large(r["counts"], "i8") for r in rows])
    once = once[total >= least]
    out = []
    for r, keys in zip(rows, parts, strict=True):
        own = keys[np.isin(keys, once, assume_unique=True)]
        if len(own):
            out.append((r["bucket"], _small(own)))
    return _rows(TOLD, out)


def _told(table: pa.Table) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[_large(x, "u8") for x in table["keys"].to_pylist()]]))


def _among(keys: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among those told, and whether it is there."""
    if not len(told):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(told, keys), len(told) - 1)
    return at, told[at] == keys


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f): all phrases of up to `longest` words that occur `least` times in a language, and for the phrase '' the words of the language.

    Texts lie in buckets. A bucket sends its words' and pairs' keys with their counts to groups of keys, each key to one group, and is told which of them come often
    enough in all; a longer phrase is counted only where both phrases that it is made of, one word shorter, are among those. In the end each bucket spells
    what it was told of, with its own counts, and these are summed up by the words themselves: keys that are alike by chance cost a row, and change no count.
    """
    spark = prepare(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    grown, cores = math.isqrt(6 * CELL_KEYS * size), spark.sparkContext.defaultParallelism
    buckets, bits = parts_for(size, max(BUCKET_BYTES, grown), 2 * cores), (parts_for(size, max(GROUP_BYTES, grown), cores) - 1).bit_length()
    text = F.coalesce("text", F.lit(""))
    placed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("bigint").alias("bucket"), "lang", text.alias("text")).repartition(buckets, "bucket")
    by_bucket = placed.groupBy("bucket")

    def short(table: pa.Table) -> pa.Table:
        return _cells(table["bucket"][0].as_py(), (k[whole] for s in _slices(table) for n in (1, 2) for k, whole in [s.keys(n)]), bits)

    def longer(n: int, table: pa.Table, told: pa.Table) -> pa.Table:
        known = _told(told)

        def found() -> Iterator[np.ndarray]:
            for s in _slices(table):
                part, whole = s.keys(n - 1)
                good = _among(part, known)[1] & whole
                key, inside = s.keys(n)
                yield key[inside & good[: len(key)] & good[len(good) - len(key) :]]

        return _cells(table["bucket"][0].as_py(), found(), bits) if len(known) and table.num_rows else SENT.empty_table()

    def spell(table: pa.Table, told: pa.Table) -> pa.Table:
        known, names, total = _told(told), {}, []  # languages by number, and their words
        count, spoken, said = np.zeros(len(known), np.int64), np.zeros(len(known), np.int32), [None] * len(known)
        seen = np.zeros(len(known), bool)
        for s in _slices(table):
            code = np.array([names.setdefault(x, len(names)) for x in s.langs], np.int32)[s.row]
            total.extend([0] * (len(names) - len(total)))
            for k, n in enumerate(np.bincount(code, minlength=len(names)).tolist()):
                total[k] += n
            for n in range(1, longest + 1):
                key, whole = s.keys(n)
                at, hit = _among(key, known)
                place = np.flatnonzero(hit & whole)
                once, first, times = np.unique(at[place], return_index=True, return_counts=True)
                count[once] += times
                new, place = once[~seen[once]], place[first[~seen[once]]]
                spoken[new] = code[place]
                for k, p in zip(new.tolist(), place.tolist(), strict=True):
                    said[k] = s.phrase(p, n)
                seen[new] = True
        langs = pa.array([*names], pa.string()).take(pa.array(np.concatenate((spoken[seen], np.arange(len(names), dtype=np.int32)))))
        phrases = pa.array([x for x in said if x is not None] + [b""] * len(names), pa.binary()).cast(pa.string())
        return pa.table([langs, phrases, pa.array(np.concatenate((count[seen], np.array(total, np.int64))))], schema=SPELLED)

    def told(rows: DataFrame) -> DataFrame:
        return written(rows.repartition(1 << bits, "grp").groupBy("grp").applyInArrow(lambda t: _frequent(t, least), "bucket bigint, keys binary"))

    cells = "grp bigint, bucket bigint, keys binary, counts binary"
    known = [told(by_bucket.applyInArrow(short, cells))]
    for n in range(3, longest + 1):
        known.append(told(by_bucket.cogroup(_dealt(known[-1], buckets)).applyInArrow(functools.partial(longer, n), cells)))
    every = functools.reduce(DataFrame.unionByName, known)
    rows = by_bucket.cogroup(_dealt(every, buckets)).applyInArrow(spell, "lang string, phrase string, f bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))


def _dealt(told: DataFrame, buckets: int):  # noqa: ANN202
    return told.repartition(buckets, "bucket").groupBy("bucket")


Key = tuple[str, ...]


def in_order(counts: DataFrame, longest: int, backward: bool) -> tuple[DataFrame, int]:
    """The rows (lang, phrase, f, ...) dealt to tasks in prefix order, or backward in suffix order, each with its key's words, and the number of tasks.

    Keys are the language and the words, sorted as they are and not by any hash. Bounds are taken from a sample of keys, some SAMPLED for each task. A phrase stands where it sorts
    (`own`), and a copy goes to each further task into which the phrases that begin with it reach, at most `longest` copies to a task: so a task finds the beginnings of
    all its phrases with it, and a word with which a third of them begin is spread over tasks.
    """
    # TASK_COUNTS, SAMPLED: some 64 keys for each 400,000 counts reach the driver
    split = F.split("phrase", " ")
    key = F.concat(F.array("lang"), F.reverse(split) if backward else split)
    rows = written(counts.withColumn("key", key))
    total = rows.count()
    parts = parts_for(total, TASK_COUNTS, min(counts.sparkSession.sparkContext.defaultParallelism, max(1, total // 1_000)))
    every = max(1, total // (SAMPLED * parts))
    sampled = sorted(tuple(r["key"]) for r in rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect()) if parts > 1 else []
    bounds = [sampled[len(sampled) * k // parts] for k in range(1, parts)] if sampled else []
    held = counts.sparkSession.sparkContext.broadcast(bounds)
    after = ("\U0010ffff",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part, own = [], [], []
            for k, key in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                key = tuple(key)
                first = bisect.bisect_right(held.value, key)
                last = bisect.bisect_right(held.value, key + after) if len(key) <= longest else first
                for p in range(first, last + 1):
                    at.append(k)
                    part.append(p)
                    own.append(p == first)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int64()), pa.array(own, pa.bool_())], [*batch.schema.names, "part", "own"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.mapInArrow(run, f"{fields}, part bigint, own boolean").repartitionByRange(max(1, parts), "part")
    return dealt, parts


def merged(rows: Iterator[tuple], close: Callable[[list, list], tuple | None]) -> Iterator[tuple]:
    """One pass over rows (part, key, own, f, covered, carried) in order. The beginnings of the last phrase are held, so that each phrase meets the counts of its beginnings, and each
    beginning the counts of the phrases that it begins, as sorted streams meet in a merge. close(phrase, beginnings) makes a row of a phrase once all its longer ones are past.
    """
    open_: list[list] = []  # [part, key, own, f, covered, carried, largest count of a phrase one word longer]
    for row in rows:
        if open_ and open_[-1][0] == row[0] and open_[-1][1] == row[1]:  # what another task has found of the same phrase
            open_[-1][4] |= row[4]
            continue
        while open_ and not (open_[-1][0] == row[0] and row[1][: len(open_[-1][1])] == open_[-1][1]):
            done = open_.pop()
            if (out := close(done, open_)) is not None:
                yield out
        if open_ and len(row[1]) > 2:
            open_[-1][6] = max(open_[-1][6], row[3])
        open_.append([*row, 0])
    while open_:
        done = open_.pop()
        if (out := close(done, open_)) is not None:
            yield out


def _scan(dealt: DataFrame, close: Callable, names: list[str], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        held = []
        for out in merged(rows(), close):
            held.append(out)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    # a phrase's own row comes before those that others have found of it
    ordered = dealt.sortWithinPartitions("part", "key", F.desc("own"), F.desc("mine")).select("part", "key", "own", "f", "covered", "carried")
    return ordered.mapInArrow(run, schema)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int | None = FIRST, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` phrases of 2 to `longest` words by score, then a, descending, then by the phrase. With first None all.

    Texts are lower-cased (A-Z) and cut into pieces at [.,;:!?\\x0A-\\x0D], and these into words [^\\x20\\x09]+. a is a phrase's count, `least` at the least; of its cuts into a
    left and a right part with counts l and r the one counts whose score floor(SCALE * a * a / (l * r)) is the lowest, of equals the earliest; n is the number of
    the language's words. A phrase is left out if one that is longer by words before or behind it has `share` hundredths of its count or more.

    Counts are kept in suffix order and scanned once: each phrase meets the counts of its endings, its right parts, and of the phrases that end with it. Then they are kept in
    prefix order and scanned again for left parts and for phrases that begin with it. No table of counts is built or looked up. Numbers are exact at any size.

    A null language is 'und'; null and empty texts have no words; rows that repeat a doc_id count each; other columns are ignored; a bucket holds a very long text whole;
    no rows give no rows.
    """
    counts = written(phrase_counts(docs, longest, least))
    words_of = counts.where("phrase = ''").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    start = counts.where("phrase <> ''").select("lang", "phrase", "f", F.lit(False).alias("covered"), F.lit(True).alias("mine"), F.array().cast("array<bigint>").alias("carried"))

    def is_covered(row: list) -> bool:
        return row[4] or (len(row[1]) > 2 and 100 * row[6] >= share * row[3])

    def endings(row: list, shorter: list) -> tuple | None:
        """With the counts of the phrase's own endings, from one word on; of a copy only that it is covered."""
        covered = is_covered(row)
        if not row[2] and not covered:
            return None
        return row[1][0], " ".join(row[1][:0:-1]), row[3], covered, row[2], [x[3] for x in shorter]

    def scored(row: list, shorter: list) -> tuple | None:
        covered, size = is_covered(row), len(row[1]) - 1
        if size < 2 or not row[2] and not covered:
            return None
        a, lefts, rights = row[3], [x[3] for x in shorter], row[5]
        score, k = min((SCALE * a * a // (lefts[k - 1] * rights[size - k - 1]), k) for k in range(1, size)) if row[2] else (0, 1)
        l, r = (lefts[k - 1], rights[size - k - 1]) if row[2] else (0, 0)
        return row[1][0], " ".join(row[1][1:]), a, covered, row[2], l, r, score

    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
    dealt, _ = in_order(start, longest, backward=True)
    ended = _scan(dealt, endings, ["lang", "phrase", "f", "covered", "mine", "carried"], "lang string, phrase string, f bigint, covered boolean, mine boolean, carried array<bigint>", kinds)
    dealt, _ = in_order(ended, longest, backward=False)
    kinds = [*kinds[:5], pa.int64(), pa.int64(), pa.int64()]
    found = written(_scan(dealt, scored, ["lang", "phrase", "a", "covered", "mine", "l", "r", "score"], "lang string, phrase string, a bigint, covered boolean, mine boolean, l bigint, r bigint, score bigint", kinds))
    gone = sent(written(found.where("not mine").select(F.col("lang").alias("_l"), F.col("phrase").alias("_p")).distinct()))  # a few for each task
    kept = found.where("mine and not covered").join(gone, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left_anti")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    ranked = ranked.where(F.col("rank") <= first) if first is not None else ranked
    return ranked.join(words_of, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
