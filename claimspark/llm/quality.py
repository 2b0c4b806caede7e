"""Quality rules of whole documents, and a log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.session import written

from .common import byte_set, gram_hashes, mixed, prepare, sent, slices, span_hashes, words

#: Buckets of the two multinomials: what is counted, summed up and sent to all tasks has so many entries, however large the corpus.
BUCKETS = 1 << 16
#: Words of the n-grams, and what is added to each bucket's count.
GRAMS, SMOOTH = (1, 2), 0.5
#: One in so many trusted documents sets the threshold and isn't counted into the target, so that its score is that of a document the model hasn't seen.
HELD = 5
#: The threshold lies under this quantile of those documents' scores, by this share of the quantile's distance from their median.
BELOW, SLACK = 0.01, 1.0
# fixed values: the rules' symbols, least words, words of a repeated window, and the largest share of words in such windows, in hundredths
SYMBOLS, LEAST_WORDS, WINDOW, MOST_REPEATED = b"#*$%&|<>", 10, 5, 20
SYMBOL_BYTES = byte_set(*[(b, b) for b in SYMBOLS])


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many places of each row are flagged; `at` are the n+1 offsets of the rows."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])


def _repeated(keys: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Which (key, row) pairs come at least `least` times; with 0, which of them come again, all but the first in their order."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((keys, row))
    first = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (row[order][1:] != row[order][:-1])))
    out = np.zeros(len(keys), bool)
    if least:
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(keys)))
        out[order] = np.repeat(size >= least, size)
    else:
        out[order] = ~first
    return out


def _lines_again(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each row, how many lines with a word equal an earlier line of the row. Lines end at a line feed or with the text."""
    feeds = np.flatnonzero(data == 0x0A)
    begins = np.unique(np.concatenate((at[:-1][np.diff(at) > 0], feeds + 1)))
    begins = begins[begins < len(data)]
    ends = np.minimum(np.append(begins[1:], len(data)), len(data))
    ends = ends - (data[np.maximum(ends - 1, 0)] == 0x0A) if len(ends) else ends
    filled = np.searchsorted(starts, ends) > np.searchsorted(starts, begins) if len(begins) else np.zeros(0, bool)
    begins, ends = begins[filled], ends[filled]
    row = np.searchsorted(at, begins, "right") - 1
    again = _repeated(span_hashes(data, begins, ends), row, 0)
    return np.bincount(row[again], minlength=len(at) - 1)


def _grams(h: np.ndarray, offsets: np.ndarray, buckets: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of words within a row, and the rows' n+1 offsets among them."""
    g = gram_hashes(h, n) if n > 1 else mixed(h)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(g)]
    inside = np.arange(len(g)) + n <= offsets[1:][row] if len(g) else np.zeros(0, bool)
    return ((g[inside] ^ np.uint64(n)) % np.uint64(buckets)).astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(row[inside], minlength=len(offsets) - 1))))


@dataclass
class Model:
    """The log ratio of each bucket, target against raw, by the words of the n-gram; and the score below which a document is not kept."""

    ratio: dict[int, np.ndarray]
    threshold: float = float("-inf")


def counted(docs: DataFrame, buckets: int) -> np.ndarray:
    """The n-grams of each length (rows) in each bucket, over all documents. A task gives a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(GRAMS), buckets), np.int64)
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                starts, ends, offsets = words(data, at)
                h = span_hashes(data, starts, ends)
                for k, n in enumerate(GRAMS):
                    total[k] += np.bincount(_grams(h, offsets, buckets, n)[0], minlength=buckets)
        k, used = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(used), pa.array(total[k, used])], ["k", "bucket", "found"])

    out = np.zeros((len(GRAMS), buckets))
    for r in docs.select("text").mapInArrow(run, "k bigint, bucket bigint, found bigint").groupBy("k", "bucket").agg(F.sum("found").alias("found")).collect():  # a row for each bucket at most
        out[r["k"], r["bucket"]] = r["found"]
    return out


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with `trusted` and `held`, one of them for each that is labelled quality 1, never 0: one in HELD, by a hash of their ids, is held."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_good")).agg(F.min("quality").alias("_q")).where("_q = 1")
    chosen = sent(written(good.select("_good", (F.pmod(F.xxhash64("_good", F.lit(1)), F.lit(HELD)) == 0).alias("_held"))))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_good"), "left")
    return rows.select("doc_id", "text", F.coalesce(~F.col("_held"), F.lit(False)).alias("trusted"), F.coalesce("_held", F.lit(False)).alias("held"))


def quantiles(rows: DataFrame, shares: list[float]) -> list[float]:
    """For each share the least `score` that so many of the rows don't exceed; exact, by range-sorted partitions and their totals. No rows give none."""
    ranges = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("score").withColumn("part", F.spark_partition_id()).checkpoint()
    totals = sorted(tuple(r) for r in ranges.groupBy("part").agg(F.sum("n")).collect())  # a row for each partition
    upto, out = np.cumsum([n for _, n in totals]), []
    for share in shares if totals else []:
        rank = max(1, int(np.ceil(share * upto[-1])))
        k = int(np.searchsorted(upto, rank))
        running = ranges.where(F.col("part") == totals[k][0]).select("score", F.sum("n").over(Window.partitionBy("part").orderBy("score")).alias("upto"))
        out.append(running.where(F.col("upto") >= rank - int(upto[k] - totals[k][1])).agg(F.min("score")).first()[0])
    return out


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, below: float = BELOW, slack: float = SLACK) -> Model:
    """The two multinomials and the threshold, from all documents and all labels.

    Raw counts cover every document, those of the target every trusted one. The threshold lies `slack` times the distance between all held documents' median
    score and their `below` quantile under that quantile. Without trusted documents all ratios are 0 and all is kept; with none held, too.
    """
    prepare(docs.sparkSession)
    known = written(with_trust(docs, labels).where("trusted or held"))
    target, raw = counted(known.where("trusted"), buckets), counted(docs, buckets)
    if not target.any():
        return Model({n: np.zeros(buckets) for n in GRAMS})
    model = Model({n: np.log((t + SMOOTH) / (t.sum() + SMOOTH * buckets)) - np.log((r + SMOOTH) / (r.sum() + SMOOTH * buckets)) for n, t, r in zip(GRAMS, target, raw, strict=True)})
    low, middle = quantiles(assess(known.where("held"), model).where(~F.col("base_failed")), [below, 0.5]) or (float("-inf"), 0.0)
    model.threshold = low - slack * (middle - low)
    return model


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of each document.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. score is the mean log ratio of the document's word n-grams, the mean of the means for each n; without
    n-grams of a length that length counts 0. kept is false if the rules failed, else whether the score reaches the model's threshold. Equal lines and windows
    are known by 64-bit hashes within their document.

    Null and empty texts have no words and fail; rows that repeat an id are assessed one by one; null ids stay; other columns are ignored; a very long text is
    worked on alone, in memory in proportion to it; no rows give no rows.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of as many numbers as there are buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, threshold = held.value.ratio, held.value.threshold
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(1)):
                starts, ends, offsets = words(data, at)
                h = span_hashes(data, starts, ends)
                n_words = np.diff(offsets)
                heads = (data & 0xC0) != 0x80
                space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
                grams = gram_hashes(h, WINDOW)
                row = np.repeat(np.arange(hi - lo), n_words)[: len(grams)]
                place = np.flatnonzero(np.arange(len(grams)) + WINDOW <= offsets[1:][row]) if len(grams) else np.zeros(0, np.int64)
                place = place[_repeated(grams[place], row[place], 2)]
                edge = np.zeros(len(h) + 1, np.int64)
                edge[place] += 1
                np.add.at(edge, place + WINDOW, -1)
                repeated = _per_row(np.cumsum(edge)[:-1] > 0, offsets)
                score = np.zeros(hi - lo)
                for n, weight in ratio.items():
                    b, of = _grams(h, offsets, len(weight), n)
                    total = np.concatenate(([0.0], np.cumsum(weight[b])))[of]
                    score += np.diff(total) / np.maximum(np.diff(of), 1) / len(ratio)
                failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
                columns = [n_words, _per_row(heads & ~space, at), _per_row(SYMBOL_BYTES[data], at), _lines_again(data, at, starts), repeated, failed, ~failed & (score >= threshold), score]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *[pa.array(c) for c in columns]], names=NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
