"""Canonical coordinates of claims: entity, metric, period, unit, value, basis, scope, and the block in which claims are comparable.

The rules are batch rules, so that results don't depend on the order in which claims come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.periods import with_period
from claimspark.functions.words import bare_scale, basis_canon, entity_key, measure_family, money_like, page_currency, parse_unit, parse_value, precision_of, squash, stated, subject_name
from claimspark.session import written

#: Rounds in which chains of aliases are followed; n rounds follow 2 ** n aliases.
ALIAS_DOUBLINGS = 3


def first_owners(ids: DataFrame, owners: DataFrame) -> DataFrame:
    """(claim_id, owner): of a claim's identifiers (claim_id, pos, k, v), the first whose owner is an earlier claim."""
    return ids.join(owners, ["k", "v"]).where("owner < claim_id").groupBy("claim_id").agg(F.min_by("owner", "pos").alias("owner"))


def identifiers(claims: DataFrame) -> DataFrame:
    """(claim_id, pos, k, v) of each identifier that says something; values count whatever their case."""
    ids = claims.select("claim_id", F.posexplode(F.map_entries("keys")).alias("pos", "e"))
    return ids.select("claim_id", "pos", F.col("e.key").alias("k"), F.lower("e.value").alias("v")).where("coalesce(v, '') <> ''")


def follow_owners(pointers: DataFrame) -> DataFrame:
    """(claim_id, owner) with each owner replaced by the last of its chain. Owners are earlier claims, so that chains end; each round doubles the steps."""
    rows = pointers.select("claim_id", "owner").transform(written)
    while True:
        further = rows.select(F.col("claim_id").alias("_c"), F.col("owner").alias("_next"))
        rows = rows.select("claim_id", "owner").join(further, F.col("owner") == F.col("_c"), "left").select("claim_id", F.coalesce("_next", "owner").alias("owner"), F.col("_next").isNotNull().alias("_moved")).transform(written)
        if rows.where("_moved").isEmpty():
            return rows.select("claim_id", "owner")


def own_name() -> Column:
    return entity_key(subject_name(F.col("subject"), F.col("publisher")))


def resolve_entities(claims: DataFrame) -> DataFrame:
    """(claim_id, entity, root, own) of claims (claim_id, subject, publisher, keys map).

    The owner of an identifier is the lowest claim_id that carries it. A claim takes the entity of the owner of the first of its
    identifiers whose owner is an earlier claim, and so does that owner: the root is the claim at the end of this chain, whose own name's key is
    the entity. A claim without such an identifier is its own root.
    """
    named = claims.select("claim_id", own_name().alias("own"), "keys")
    ids = identifiers(named)
    owners = ids.groupBy("k", "v").agg(F.min("claim_id").alias("owner"))
    roots = follow_owners(first_owners(ids, owners)).withColumnRenamed("owner", "_root")
    names = named.select(F.col("claim_id").alias("_n"), F.col("own").alias("_theirs"))
    rows = named.drop("keys").join(roots, "claim_id", "left").join(names, F.col("_root") == F.col("_n"), "left")
    return rows.select("claim_id", F.coalesce("_theirs", "own").alias("entity"), F.coalesce("_root", "claim_id").alias("root"), "own")


def entities(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity, kind, keys): the first value seen of each identifier, and 'person' for those with a personal one."""
    ids = claims.join(resolved, "claim_id").select("claim_id", "entity", F.explode_outer(F.map_entries("keys")).alias("e"))
    one = ids.groupBy("entity", F.col("e.key").alias("k")).agg(F.min_by(F.nullif(F.col("e.value"), F.lit("")), "claim_id").alias("v"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull() & F.col("v").isNotNull(), F.struct("k", "v"))))  # an entity's kinds of identifiers
    return one.groupBy("entity").agg(pairs.alias("p")).select("entity", F.when(F.exists("p", lambda x: x["k"].isin("din", "pan")), "person").alias("kind"), F.map_from_entries("p").alias("keys"))


def metric_keys(counts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(metric_raw, metric_key) of counts (metric_raw, n): a stored alias first, then the most claimed key of the plural family, the smallest of equals.

    An alias that is stored under several keys counts for the smallest, and an alias of an alias is followed; aliases that lead in a circle stay where they are after as
    many steps as there are doublings.
    """
    stored = aliases.where("alias <> key").groupBy("alias").agg(F.min("key").alias("key"))
    for _ in range(ALIAS_DOUBLINGS):
        further = stored.select(F.col("alias").alias("_a"), F.col("key").alias("_k"))
        stored = stored.join(further, F.col("key") == F.col("_a"), "left").select("alias", F.coalesce("_k", "key").alias("key"))
    stored = stored.select(F.col("alias").alias("_a"), F.col("key").alias("_k"))
    live = counts.join(stored, F.col("metric_raw") == F.col("_a"), "left").select("metric_raw", "n", F.coalesce("_k", "metric_raw").alias("_key")).withColumn("_family", measure_family(F.col("_key"))).transform(written)
    total = live.groupBy("_family", "_key").agg(F.sum("n").alias("n"))
    best = total.groupBy("_family").agg(F.min_by("_key", F.struct((-F.col("n")).alias("n"), "_key")).alias("metric_key"))
    return live.join(best, "_family").select("metric_raw", "metric_key")


def resolve_metrics(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    return metric_keys(claims.groupBy("metric_raw").agg(F.count(F.lit(1)).alias("n")), aliases)


def metrics(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """(key, label, first_seen_doc, aliases, claim_count) of the keys that are left."""
    rows = claims.join(resolved, "metric_raw")
    return rows.groupBy("metric_key").agg(
        F.min("label").alias("label"), F.min("doc_id").alias("first_seen_doc"), F.array_sort(F.collect_set(F.when(F.col("metric_raw") != F.col("metric_key"), F.col("metric_raw")))).alias("aliases"), F.count(F.lit(1)).alias("claim_count")
    ).withColumnRenamed("metric_key", "key")


def rescue_currency(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Bare scales of money take the currency of the claim's page if it names just one: unit_canon 'count' becomes it.

    Only flagged claims meet their pages.
    """
    flag = (F.col("unit_canon") == "count") & bare_scale(F.col("unit_raw")) & money_like(F.col("label"), F.col("metric_raw"), F.col("metric_key"))
    marked = claims.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    need = marked.where("_flag").select(F.col("claim_id").alias("_id"), "doc_id", "page_no")
    found = need.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"]).select("_id", page_currency(F.col("text")).alias("_c"))
    return marked.join(found, F.col("claim_id") == F.col("_id"), "left").withColumn("unit_canon", F.coalesce("_c", "unit_canon")).drop("_flag", "_id", "_c")


def canonicalise_claims(claims: DataFrame, documents: DataFrame, aliases: DataFrame, pages: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """Verified claims with their canonical coordinates and block_key; those already in `done` are left out.

    A claim with a number needs a unit and a period for a block 'entity|metric|start|end'; one with text is in 'entity|metric' whatever its period; all
    others are in none. The claims are written down first: entities, metrics, periods and the rows themselves are each read from there.
    """
    claims = claims.transform(written)
    rows = with_publishers(claims.where("status = 'verified'"), documents)
    entity, metric = resolve_entities(rows), resolve_metrics(claims, aliases)
    if done is not None:
        rows = rows.join(done.select("claim_id"), "claim_id", "left_anti")
    return coordinates(rows.join(entity.select("claim_id", "entity"), "claim_id").join(metric, "metric_raw"), pages)


def with_publishers(claims: DataFrame, documents: DataFrame) -> DataFrame:
    published = documents.select(F.col("doc_id").alias("_d"), "publisher", "published_at")
    return claims.join(published, F.col("doc_id") == F.col("_d"), "left").drop("_d")


def coordinates(rows: DataFrame, pages: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """Claims whose entity and metric_key are known, with all other coordinates and the block; periods is a vocabulary of their periods, if there is one."""
    rows = with_period(rows, known=periods)
    rows = rows.withColumn("_u", parse_unit(F.col("unit_raw"))).withColumns({"unit_canon": F.col("_u.unit"), "_scale": F.col("_u.scale"), "_number": parse_value(F.col("value_raw"))}).drop("_u")
    if pages is not None:
        rows = rescue_currency(rows, pages)
    has_unit, number = F.col("unit_canon").isNotNull(), F.col("_number").isNotNull()
    words = squash(F.col("value_raw"))
    rows = rows.withColumns({
        "value_canon": F.when(number & has_unit, F.col("_number") * F.col("_scale")),
        "precision": F.when(number & has_unit, precision_of(F.col("value_raw")) * F.col("_scale")),
        "value_text": F.when(~number & (words != ""), words),
        "basis_canon": basis_canon(F.col("basis_raw"), F.col("period_raw"), F.col("quote"), F.col("label")),
        "scope_canon": stated(F.col("scope_raw")),
    })
    block = F.when(number & has_unit & F.col("period_start").isNotNull(), F.concat_ws("|", "entity", "metric_key", F.col("period_start").cast("string"), F.col("period_end").cast("string"))).when(F.col("value_text").isNotNull(), F.concat_ws("|", "entity", "metric_key"))
    return rows.withColumn("block_key", block).drop("_scale", "_number")


def canon_stats(canon: DataFrame) -> DataFrame:
    return canon.groupBy("doc_id").agg(
        F.count_if(F.col("block_key").isNotNull() & F.col("value_text").isNull()).alias("numeric"), F.count_if(F.col("value_text").isNotNull()).alias("text"), F.count_if(F.col("block_key").isNull()).alias("non_comparable")
    )
