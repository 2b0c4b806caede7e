"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, sent
from .sharding import with_offsets

#: Words that are served at a time; a document queues up in packets of so many, which is also how near a source's taken words come to its target.
PACKET = 128
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) to these and target: `share` times all sizes dealt by weight, none above `most` times its source.

    Sources in the order of their code points, null last, take the weights in turn. The excess of capped sources is dealt again by
    weight: with sources ordered by capacity over weight, the capped ones are a prefix, which running sums find without iterating. The
    table has one row per source, so that one window task holds them.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("source").isNull(), "source")
    full = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("budget", F.least(F.sum("source_size").over(full) * F.lit(share), F.sum("cap").over(full)))
    rows = rows.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weights_from", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("caps_before")) / F.col("weights_from"))
    rows = rows.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    rows = rows.withColumn("water", F.coalesce(F.max(F.when(~F.col("capped"), F.col("level"))).over(full), F.lit(0.0)))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def _name(source: Column) -> list[Column]:
    """A source as two columns that are never null and sort with null last."""
    return [source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")]


def queue(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int, size: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(none, name, order, id, size, start) of each document that isn't empty, start being its source's words before it; and (none, name, source_size, target, budget) of each source.

    Each source's documents are shuffled by a seeded hash. All documents are range-sorted by source and hash, so that a source which holds most of
    them spans many tasks, and prefix sums come from per-partition totals.
    """
    slim = docs.select(*_name(F.col("source")), _order(seed).alias("order"), F.col("doc_id").alias("id"), size(F.col("text")).alias("size")).checkpoint()
    sizes = slim.groupBy("none", "name").agg(F.sum("size").alias("source_size")).select(F.when(~F.col("none"), F.col("name")).alias("source"), "source_size")
    goals = targets(sizes, weights, share, most).select(*_name(F.col("source")), "source_size", "target")  # a row per source
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("none", "name").rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.withColumns({"budget": F.round(F.sum("target").over(whole)).cast("long"), "words_before": F.coalesce(F.sum("source_size").over(before), F.lit(0))}).checkpoint()
    line = with_offsets(slim.where("size > 0"), ["none", "name", "order", "id"], {"place": "size"})
    line = line.join(sent(goals).select("none", "name", "words_before"), ["none", "name"]).select("none", "name", "order", "id", "size", (F.col("place") - F.col("words_before")).alias("start"))
    return line, goals


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "source", "doc_id", "text")


def cut_of(line: DataFrame, goals: DataFrame, most: int, packet: int | None) -> DataFrame:
    """(none, name, turn, full, part, words): of each source and turn the last key that is taken as a whole, and the key that is taken in part with its words.

    A packet's virtual finish time is its source's words so far, itself included, over the source's target. The packets of all sources and turns are
    range-sorted by it and cut where their words reach the budget. In its source's queue, what lies before the cut is a beginning: two keys tell it.
    """
    number = F.ceil(F.col("size") / packet).cast("long") if packet else F.lit(1).cast("long")
    rows = line.join(sent(goals), ["none", "name"]).withColumn("turn", F.explode(F.array(*[F.lit(k) for k in range(most)]))).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), number)))
    done = F.least(F.col("number") * packet, F.col("size")) if packet else F.col("size")
    finish = (F.col("start") + F.col("source_size") * F.col("turn") + done) / F.col("target")
    words = done - (F.col("number") - 1) * packet if packet else F.col("size")
    rows = rows.select("none", "name", "order", "id", "size", "turn", finish.alias("finish"), words.cast("long").alias("words"), "budget")
    rows = with_offsets(rows, ["finish", "order", "turn"], {"served": "words"}).where("served < budget")
    given = F.when(F.col("served") + F.col("words") <= F.col("budget"), F.col("words")).otherwise(F.col("budget") - F.col("served") if packet else F.lit(0))
    taken = rows.groupBy("none", "name", "turn", "order", "id", "size").agg(F.sum(given).alias("taken"), F.count(F.lit(1)).alias("packets"))
    # rows that are alike in source, doc_id and text are one key here: as many as there are share what falls to them
    per_row = F.floor(F.col("taken") / F.greatest(F.ceil(F.col("packets") / number), F.lit(1))).cast("long")
    key = F.struct("order", "id")
    return taken.where("taken > 0").groupBy("none", "name", "turn").agg(
        F.max(F.when(per_row >= F.col("size"), key)).alias("full"), F.max(F.when(per_row < F.col("size"), F.struct("order", "id", per_row.alias("words")))).alias("part")
    )


def fair_queue(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 0,
    packet: int | None = PACKET,
    size: Callable[[Column], Column] = word_count,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, size, source_size, target, taken, copies, place) of each document; row is a struct of all its columns, or of those in `keep`.

    Each source's documents queue up in a shuffled order, `most` turns of them. In packets of so many words they are served by their virtual finish
    times, over all sources, until the total budget is reached; the packet at the cut gives the words that fit. packet=None makes each document one
    packet, which is taken as a whole or not at all; copies counts the turns in which anything is taken. place is the finish time of the first
    turn to be expected from the document's hash. What is taken is told by two keys of each source and turn, so that texts stay where they are.

    Null or empty texts have size 0 and are taken 0 times; a null source is a source; rows alike in source, doc_id and text are each taken as often,
    to a word; no rows give no rows; columns of any name are kept. A very long document is many packets, of which each is a short row.
    """
    prepare(docs.sparkSession)
    line, goals = queue(docs, weights, share, most, seed, size)
    cut = cut_of(line, goals, most, packet)
    by_turn = cut.groupBy("none", "name").pivot("turn", list(range(most))).agg(F.first("full").alias("full"), F.first("part").alias("part"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), *_name(F.col("source")), _order(seed).alias("order"), F.col("doc_id").alias("id"), size(F.col("text")).alias("size"))
    cuts = goals.drop("words_before").join(by_turn, ["none", "name"], "left").checkpoint()
    rows = rows.join(sent(cuts), ["none", "name"])
    key = F.struct("order", "id")

    def taken_in(turn: int) -> Column:
        full, part = F.col(f"`{turn}_full`"), F.col(f"`{turn}_part`")
        in_part = part.isNotNull() & key.eqNullSafe(F.struct(part["order"].alias("order"), part["id"].alias("id")))
        return F.when(full.isNotNull() & (key <= full), F.col("size")).when(in_part, part["words"]).otherwise(F.lit(0)).cast("long")

    turns = [taken_in(k) for k in range(most)]
    fraction = F.col("order") / F.lit(2.0**64) + 0.5
    return rows.select("row", "size", "source_size", "target", sum(turns[1:], turns[0]).alias("taken"), sum(((t > 0).cast("int") for t in turns[1:]), (turns[0] > 0).cast("int")).alias("copies"), F.try_divide(fraction * F.col("source_size"), F.col("target")).alias("place"))


def mixed_documents(docs: DataFrame, **how: object) -> DataFrame:
    """The mix as documents: whole ones, as often as they are taken, with all their columns."""
    rows = fair_queue(docs, packet=None, **how)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def in_mix_order(queued: DataFrame, parts: int) -> DataFrame:
    """What fair_queue takes, a row per copy with its turn, range-sorted over all partitions by the finish time to be expected."""
    rows = queued.where("copies > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("place", F.col("place") + F.try_divide(F.col("turn") * F.col("source_size"), F.col("target")))
    return rows.repartitionByRange(parts, "place", "row.doc_id").sortWithinPartitions("place", "row.doc_id")
