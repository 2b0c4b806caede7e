"""Replies of an extraction model, as JSON lines, to typed claims; the requests that lead to them; and the metric registry."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.words import BASES, metric_slug
from claimspark.session import written

#: Pages of a request, keys of the registry that it lists, and requests that may follow a reply that was cut off.
PAGES_PER_REQUEST, REGISTRY_KEYS, MOST_RESUMES = 50, 200, 4
PENDING, IN_FLIGHT, STALE_SECONDS = ["queued", "ingested", "partial", "quota_exhausted", "failed"], ["extracting", "verifying", "reconciling"], 900
CLAIM_TEXTS = ("subject", "metric", "label", "unit", "period", "scope", "basis", "quote")


def slices(documents: DataFrame, size: int = PAGES_PER_REQUEST) -> DataFrame:
    """(doc_id, first, last): runs of `size` pages, from 1, both ends inside; a document without pages has none."""
    first = F.explode(F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count").cast("int"), F.lit(size))))
    rows = documents.select("doc_id", F.col("page_count").cast("int").alias("_n"), first.alias("first"))
    return rows.select("doc_id", "first", F.least(F.col("first") + size - 1, "_n").alias("last"))


def build_requests(documents: DataFrame, featured: DataFrame, registry: DataFrame, size: int = PAGES_PER_REQUEST) -> DataFrame:
    """A row for each slice: the hints of its pages, a line each in page order, its thin pages, and the most claimed registry keys.

    Pages meet their slice by the slice's number. The lists of a slice hold `size` entries at most.
    """
    bits = F.concat_ws("; ", *[F.when(F.size(f"hints.{c}") > 0, F.concat(F.lit(f"{name} "), F.array_join(f"hints.{c}", " | "))) for c, name in (("units", "units"), ("scopes", "scope"), ("periods", "period"))])
    lines = featured.select("doc_id", F.floor((F.col("page_no") - 1) / size).alias("_s"), "page_no", F.when(bits != "", F.concat(F.lit("p"), "page_no", F.lit(": "), bits)).alias("line"), "skipped")
    of = lines.groupBy("doc_id", "_s").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("page_no", "line")))).alias("l"), F.array_sort(F.collect_list(F.when(F.col("skipped"), F.col("page_no")))).alias("p"))
    keys = registry.orderBy(F.desc("claim_count"), "metric_raw").limit(REGISTRY_KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("claim_count")).alias("n"), "metric_raw"))), lambda x: x["metric_raw"]).alias("registry_keys"))
    rows = slices(documents, size).withColumn("_s", F.floor((F.col("first") - 1) / size)).join(of, ["doc_id", "_s"], "left")
    rows = rows.select("doc_id", "first", "last", F.coalesce(F.array_join(F.col("l.line"), "\n"), F.lit("")).alias("hint_lines"), F.coalesce(F.array_join(F.col("p").cast("array<string>"), ","), F.lit("")).alias("thin_pages"))
    return rows.crossJoin(F.broadcast(keys))  # one row of REGISTRY_KEYS keys at most


#: White space at the ends of lines, and what ends one: as Unicode has them.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DOCUMENT = ("title", "publisher", "published_at")
_RECORD = ", ".join(f"`{c}` string" for c in ("type", "page", "value", *CLAIM_TEXTS, *_DOCUMENT)) + ", `keys` map<string, string>"
_CLAIM = "struct<page_no: bigint, " + ", ".join(f"{k}_in: string" for k in CLAIM_TEXTS) + ", value_in: string, keys: map<string, string>>"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def record_lines(text: Column) -> Column:
    """The records of a reply, as JSON texts: its lines, or the items of the one array that it is. Blank lines and fences are none."""
    whole = _stripped(F.coalesce(text, F.lit("")))
    array = whole.startswith("[") & whole.endswith("]") & F.try_parse_json(whole).isNotNull()
    items = F.transform(F.from_json(whole, "array<string>"), lambda x: F.coalesce(x, F.lit("null")))
    lines = F.transform(F.when(array, items).otherwise(F.split(whole, _LINES)), _stripped)
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("```"))


def _shortest(number: Column) -> Column:
    """A number as JSON readers print it: digits in full between 1e-4 and 1e16, and beyond that an exponent of two digits at the least."""
    mantissa, power = F.regexp_replace(F.substring_index(number, "E", 1), r"\.0$", ""), F.substring_index(number, "E", -1).try_cast("int")
    full = F.regexp_replace(number.try_cast("decimal(38,20)").cast("string"), r"(?<=\.\d)(\d*?)0+$", "$1")
    short = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(~F.contains(number, F.lit("E")), number).when((power >= -4) & (power < 16), full).otherwise(short)


def _kind(whole: Column, name: str) -> Column:
    """The JSON type of a field, of a record that was parsed in brackets; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(whole, f"$[0].{name}", "variant"))


def _read(line: Column) -> Column:
    """What a record says: kind 'document', 'claim' or 'malformed', with its document or claim.

    A claim needs a page that is a whole number, in quotes or not, a metric and a quote. Fields that aren't text are kept as JSON; an empty, zero or false one counts as none.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    one = line.startswith("{") & whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()
    o = F.from_json(line, _RECORD)

    def said(name: str) -> Column:
        return F.coalesce(o[name], F.lit("")) != "" if name == "type" else F.coalesce(F.when(_kind(whole, name) == "STRING", o[name] != "").otherwise(~o[name].isin("0", "0.0", "-0.0", "false", "[]", "{}")), F.lit(False))

    page = F.when(_kind(whole, "page").isin("BIGINT", "STRING"), _stripped(o["page"]))
    claim = (o["type"] == "claim") & page.rlike(r"(?U)^\d+$") & said("quote") & said("metric")
    minus = (o["type"] == "claim") & (_kind(whole, "page") == "BIGINT") & said("quote") & said("metric")
    value = F.when(_kind(whole, "value") == "STRING", o["value"]).otherwise(F.when(o["value"].rlike(r"^-?[0-9.]+(E-?[0-9]+)?$"), _shortest(o["value"])).otherwise(o["value"]))
    keys = F.coalesce(o["keys"], F.create_map().cast("map<string,string>"))
    found = F.struct(page.try_cast("bigint").alias("page_no"), *[o[k].alias(f"{k}_in") for k in CLAIM_TEXTS], value.alias("value_in"), keys.alias("keys"))
    document = F.struct(*[F.when(_kind(whole, c) == "STRING", o[c]).alias(c) for c in _DOCUMENT])
    kind = F.when(~F.coalesce(one, F.lit(False)), "malformed").when(o["type"] == "document", "document").when(F.coalesce(claim | minus, F.lit(False)), "claim").otherwise("malformed")
    return F.struct(kind.alias("kind"), document.alias("document"), found.alias("claim"))


def parse_claim_lines(replies: DataFrame) -> DataFrame:
    """Replies (doc_id, response_id, text, ...) with document, claims (array) and malformed. A reply is parsed where it is; nothing is shuffled, and no Python runs.

    The last document record holds. A record with a key twice is malformed.
    """
    rows = replies.withColumn("_r", F.transform(record_lines(F.col("text")), _read))
    of = lambda kind: F.filter("_r", lambda r: r["kind"] == kind)
    documents = F.transform(of("document"), lambda r: r["document"])
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in _DOCUMENT])
    return rows.withColumns({"document": F.coalesce(F.try_element_at(documents, F.lit(-1)), none), "claims": F.transform(of("claim"), lambda r: r["claim"]), "malformed": F.size(of("malformed")).cast("bigint")}).drop("_r")


def resume_rounds(sliced: DataFrame, parsed: DataFrame, resumes: int = MOST_RESUMES) -> tuple[DataFrame, DataFrame]:
    """Rounds of request and reply for slices (doc_id, first, last) of pages, each from the page where the last reply broke off.

    parsed has replies (doc_id, start, document, claims, malformed, finish_reason) to requests for the pages from start on. A reply that was cut off loses the claims of its
    highest page, and the next request starts there. A slice ends with a reply that was not cut off; it is partial if a reply that was has no claims, which is
    then not counted at all, if a request would start no later than the one before, or after so many resumes. Slices behind a document's first partial one are not asked for.

    Gives the replies that count (doc_id, first, round, start, next_start, document, claims, malformed, finish_reason), and how slices (doc_id, first, last, rounds, ended) end:
    'complete', 'partial', or 'pending' with the page from which a reply is still wanted (start). All slices take a round together, as many as resumes allow.
    Replies are written down first, so that they are read once and not in each round.
    """
    replies = trim_truncated(parsed).select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), "document", "claims", "malformed", "finish_reason", "next_start", F.col("partial").alias("_bare")).transform(written)
    asked = sliced.select("doc_id", "first", "last", F.col("first").cast("bigint").alias("start"))
    taken, ended = [], []
    for turn in range(resumes + 1):
        got = asked.join(replies, (F.col("doc_id") == F.col("_doc")) & (F.col("start") == F.col("_start")), "left").withColumn("round", F.lit(turn)).drop("_start")
        stuck = F.col("next_start").isNotNull() & (F.col("next_start") <= F.col("last")) & ((F.col("next_start") <= F.col("start")) | F.lit(turn == resumes))
        goes_on = F.col("next_start").isNotNull() & (F.col("next_start") <= F.col("last")) & ~stuck
        end = F.when(F.col("_doc").isNull(), "pending").when(F.col("_bare") | stuck, "partial").when(goes_on, None).otherwise("complete")
        got = got.withColumn("ended", end).transform(written)
        taken.append(got.where("_doc is not null and not _bare").select("doc_id", "first", "round", "start", "next_start", "document", "claims", "malformed", "finish_reason"))
        ended.append(got.where("ended is not null").select("doc_id", "first", "last", F.when(F.col("ended") == "pending", F.col("start")).alias("start"), (F.col("round") + F.col("_doc").isNotNull().cast("int")).alias("rounds"), "ended"))
        asked = got.where("ended is null").select("doc_id", "first", "last", F.col("next_start").alias("start"))
        if asked.isEmpty():
            break
    ends = functools.reduce(DataFrame.unionByName, ended).transform(written)
    broken = ends.where("ended = 'partial'").groupBy(F.col("doc_id").alias("_d")).agg(F.min("first").alias("_broken"))
    kept = lambda rows: rows.join(broken, F.col("doc_id") == F.col("_d"), "left").where("_broken is null or first <= _broken").drop("_d", "_broken")
    return kept(functools.reduce(DataFrame.unionByName, taken)), kept(ends)


def trim_truncated(parsed: DataFrame) -> DataFrame:
    """Cut-off replies lose the claims of their highest page, where a resumed request starts (next_start); without claims they are partial."""
    cut = F.array_max(F.transform("claims", lambda c: c["page_no"]))
    broken = F.col("finish_reason") == "MAX_TOKENS"
    rows = parsed.withColumn("next_start", F.when(broken, cut)).withColumn("partial", F.coalesce(broken & (F.size("claims") == 0), F.lit(False)))
    return rows.withColumn("claims", F.when(F.col("next_start").isNotNull(), F.filter("claims", lambda c: c["page_no"] < F.col("next_start"))).otherwise(F.col("claims")))


def type_claims(trimmed: DataFrame) -> DataFrame:
    """One row per claim: slug of the metric, known basis or 'actual', status unverified. claim_id orders a document's claims by reply and place."""
    rows = trimmed.select("doc_id", "response_id", F.posexplode("claims").alias("pos", "c"))
    basis = F.lower(F.trim(F.col("c.basis_in")))
    return rows.select(
        F.xxhash64("doc_id", "response_id", "pos").alias("claim_id"), "doc_id", "response_id", "pos", "c.page_no", F.col("c.subject_in").alias("subject"), metric_slug(F.col("c.metric_in")).alias("metric_raw"), F.col("c.label_in").alias("label"),
        F.col("c.value_in").alias("value_raw"), F.col("c.unit_in").alias("unit_raw"), F.col("c.period_in").alias("period_raw"), F.col("c.scope_in").alias("scope_raw"), F.when(basis.isin(*BASES), basis).otherwise("actual").alias("basis_raw"),
        F.col("c.quote_in").alias("quote"), F.col("c.keys").alias("keys"), F.lit("unverified").alias("status"),
    )


def apply_document_lines(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """Title, publisher and date from the first reply of each document, where it states them."""
    first = parsed.groupBy("doc_id").agg(F.min_by("document", "response_id").alias("_d"))
    return documents.join(first, "doc_id", "left").withColumns({c: F.coalesce(F.col(f"_d.{c}"), F.col(c)) for c in ("title", "publisher", "published_at")}).drop("_d")


def registry_counts(claims: DataFrame) -> DataFrame:
    """Claims, first label and first document of each metric, over all claims whatever their status."""
    return claims.groupBy("metric_raw").agg(F.count(F.lit(1)).alias("claim_count"), F.min("label").alias("label"), F.min("doc_id").alias("first_seen_doc"))


def replace_document(table: DataFrame, doc_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table without the rows of documents that are extracted again; counts are made anew from what is left."""
    return table.join(doc_ids.select(F.col("doc_id").alias("_again")).distinct(), F.col(key) == F.col("_again"), "left_anti")


def without_relations_of(relations: DataFrame, claims_gone: DataFrame) -> DataFrame:
    gone = claims_gone.select(F.col("claim_id").alias("_gone")).distinct()
    return relations.join(gone, F.col("a_id") == F.col("_gone"), "left_anti").join(gone, F.col("b_id") == F.col("_gone"), "left_anti")


def document_outcome(trimmed: DataFrame) -> DataFrame:
    """Status and reason of each document: quota before partial before extracted; without claims, the reasons for which its replies ended."""
    rows = trimmed.groupBy("doc_id").agg(
        F.sum(F.size("claims")).alias("claims"), F.sum("malformed").alias("malformed"), F.max("partial").alias("_partial"), F.max(F.coalesce(F.col("finish_reason") == "QUOTA", F.lit(False))).alias("_quota"),
        F.array_join(F.array_sort(F.collect_set("finish_reason")), ", ").alias("_why"),
    )
    status = F.when(F.col("_quota"), "quota_exhausted").when(F.col("_partial"), "partial").otherwise("extracted")
    why = F.when(F.col("_quota"), "quota exhausted").when(F.col("_partial"), "output cut off").when(F.col("claims") == 0, F.concat(F.lit("no claims: "), F.when(F.col("_why") == "", "no response").otherwise(F.col("_why"))))
    return rows.select("doc_id", "claims", "malformed", status.alias("status"), why.alias("reason"))


def pending_documents(documents: DataFrame, now: str) -> DataFrame:
    """Documents that are due: pending, or in flight but untouched for STALE_SECONDS; a stamp that can't be read is no sign of life."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("updated_at"))
    busy = F.col("status").isin(*IN_FLIGHT) & F.coalesce(age < STALE_SECONDS, F.lit(False))
    return documents.where(F.col("status").isin(*PENDING, *IN_FLIGHT) & ~busy)


