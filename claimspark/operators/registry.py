"""Consolidation of the metric registry: proposed merges are held against units and against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a registry row shows.
SAMPLE_LABELS = 3


def unit_class(unit: Column) -> Column:
    return F.when(unit.isNull(), None).when(unit == "pct", "rate").when(unit == "count", "count").when(unit == "x", "ratio").otherwise("amount")


def dominant_units(canon: DataFrame) -> DataFrame:
    """(metric_key, unit) by number of claims, the first in order of equals."""
    counts = canon.where("unit_canon is not null").groupBy("metric_key", "unit_canon").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("metric_key").agg(F.min_by("unit_canon", F.struct((-F.col("n")).alias("n"), "unit_canon")).alias("unit"))


def registry_rows(canon: DataFrame, metrics: DataFrame) -> DataFrame:
    """(key, claims, unit, labels): the first three different labels in the order of claims."""
    seen = canon.where("label is not null").groupBy("metric_key", "label").agg(F.min("claim_id").alias("at"))
    turn = F.row_number().over(Window.partitionBy("metric_key").orderBy("at", "label"))
    labels = seen.withColumn("rn", turn).where(F.col("rn") <= SAMPLE_LABELS).groupBy("metric_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]).alias("labels"))
    rows = metrics.select("key", F.col("claim_count").alias("claims")).join(dominant_units(canon).withColumnRenamed("metric_key", "key"), "key", "left").join(labels.withColumnRenamed("metric_key", "key"), "key", "left")
    return rows.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def parse_merge_proposals(lines: DataFrame) -> DataFrame:
    """(line_no, text) to (group_no, item_no, keep, alias, why): JSON objects with a keep and a list of keys to merge; other lines and items are dropped."""
    text = F.trim(F.col("text"))
    whole = F.from_json(text, "keep string, merge array<string>, why string")
    strings = F.from_json(text, "keep variant, merge array<variant>")
    rows = lines.where(~text.startswith("```") & text.startswith("{")).select("line_no", whole.alias("o"), strings.alias("v"))
    rows = rows.where(F.expr("v.keep is not null and schema_of_variant(v.keep) = 'STRING'"))
    rows = rows.select(F.col("line_no").alias("group_no"), "o.keep", F.coalesce("o.why", F.lit("")).alias("why"), F.posexplode(F.arrays_zip(F.col("o.merge").alias("a"), F.col("v.merge").alias("t"))).alias("item_no", "m"))
    return rows.where(F.expr("m.t is not null and schema_of_variant(m.t) = 'STRING'")).select("group_no", "item_no", "keep", F.col("m.a").alias("alias"), "why")


def validate_merges(proposals: DataFrame, metrics: DataFrame, aliases: DataFrame, units: DataFrame) -> DataFrame:
    """(group_no, alias, keep, outcome): 'applied' or the reason against it. A group with a bad keep has one row, with the keep as alias."""
    known = metrics.select(F.col("key").alias("_key")).withColumn("_known", F.lit(True))
    taken = aliases.select(F.col("alias").alias("_alias")).distinct().withColumn("_taken", F.lit(True))
    merged = proposals.select(F.col("alias").alias("_m")).distinct().withColumn("_merged", F.lit(True))
    unit = units.select(F.col("metric_key").alias("_metric"), F.col("unit").alias("_unit"))
    groups = proposals.select("group_no", "keep").distinct()
    groups = groups.join(known, F.col("keep") == F.col("_key"), "left").join(taken, F.col("keep") == F.col("_alias"), "left").join(merged, F.col("keep") == F.col("_m"), "left")
    groups = groups.select("group_no", "keep", F.when(F.col("_known").isNull() | F.col("_taken").isNotNull(), "keep is not a live key").when(F.col("_merged"), "keep is merged away in another group").alias("bad"))
    good = proposals.join(groups.where("bad is null").select("group_no"), "group_no")
    good = good.join(known, F.col("alias") == F.col("_key"), "left").join(taken, F.col("alias") == F.col("_alias"), "left")
    good = good.join(unit.withColumnsRenamed({"_metric": "_ma", "_unit": "_ua"}), F.col("alias") == F.col("_ma"), "left").join(unit.withColumnsRenamed({"_metric": "_mk", "_unit": "_uk"}), F.col("keep") == F.col("_mk"), "left")
    differs = F.coalesce(unit_class(F.col("_ua")) != unit_class(F.col("_uk")), F.lit(False))
    first = F.when((F.col("alias") == F.col("keep")) | F.col("_known").isNull(), "unknown key").when(F.col("_taken"), "already used").when(differs, F.concat(F.lit("unit differs ("), "_ua", F.lit(" vs "), "_uk", F.lit(")")))
    good = good.withColumn("_why", first)
    turn = F.row_number().over(Window.partitionBy("alias", F.col("_why").isNull()).orderBy("group_no", "item_no"))
    used_at = F.min(F.when(F.col("_why").isNull(), F.struct("group_no", "item_no"))).over(Window.partitionBy("alias"))
    good = good.withColumn("_turn", turn).withColumn("_used", used_at)
    late = F.col("_why").startswith("unit differs") & (F.struct("group_no", "item_no") > F.col("_used"))
    outcome = F.when(F.coalesce(late, F.lit(False)), "already used").when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_turn") > 1, "already used").otherwise("applied")
    bad = groups.where("bad is not null").select("group_no", F.col("keep").alias("alias"), F.lit(None).cast("string").alias("keep"), F.col("bad").alias("outcome"))
    return good.select("group_no", "alias", "keep", outcome.alias("outcome")).unionByName(bad)


def applied_aliases(validated: DataFrame, aliases: DataFrame) -> DataFrame:
    """The alias table with the applied merges; canonicalising with it re-keys all claims and merges their blocks."""
    return aliases.select("alias", "key").unionByName(validated.where("outcome = 'applied'").select("alias", F.col("keep").alias("key"))).distinct()
