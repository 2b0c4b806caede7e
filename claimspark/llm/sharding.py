"""Contiguous shards of near equal bytes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, prepare

ROWS_PER_PART = 200_000
#: Rows of totals that are sent to all tasks; more are joined.
MOST_BROADCAST = 100_000


def with_offsets(rows: DataFrame, order: list[str], sums: dict[str, str], rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds, for each name in sums, the total of its column over all rows before (in `order`), and its grand total as all_<name>.

    Rows are range-partitioned once and written down; each partition's totals, a row per partition, are summed up and joined back, and a
    window inside each partition gives the rest. No task holds more than a partition: a repeated key is dealt out by the later columns
    of `order`.
    """
    n = parts_for(rows.count(), rows_per_part, rows.sparkSession.sparkContext.defaultParallelism)
    placed = rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums], *[F.sum(f"_{k}").over(whole).alias(f"all_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{k}") for k, c in sums.items()])
    # totals has a row for each of the n partitions that were asked for above
    out = out.join(F.broadcast(totals) if n <= MOST_BROADCAST else totals, "_part")
    return out.withColumns({k: F.col(f"_in_{k}") + F.col(f"_{k}") for k in sums}).drop("_part", *[f"_in_{k}" for k in sums], *[f"_{k}" for k in sums])


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents, in the order of their ids, into contiguous shards of near equal bytes.

    A document's size is the UTF-8 bytes of its text (null: none) plus 1. Prefix sums come from per-partition totals; a document goes
    to the shard in which the middle of its bytes lies, so that shards differ from an equal share by less than the largest document.
    Slots count a shard's documents from 0 in the same order. Null ids come first; equal ids are ordered by text checksum and size, and rows that
    agree in all three are interchangeable. A document larger than a share can leave a neighbouring shard empty. No rows give no rows;
    other columns are left out.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_offsets(rows.withColumn("_one", F.lit(1).cast("long")), ["doc_id", "text_crc32", "size"], {"bytes_before": "size", "rows_before": "_one"})
    shard = F.expr(f"(bytes_before * 2 + size) * {int(shards)} div (all_bytes_before * 2)")
    rows = rows.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
    first = rows.groupBy("shard").agg(F.min("rows_before").alias("_first"))  # a row for each shard
    rows = rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("rows_before") - F.col("_first"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bytes_before")
