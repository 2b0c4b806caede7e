"""Relations, answers, merges and the incremental path on small tables; every query against its SQL."""

import pytest

import __spark_entry__
from claimspark.operators import canon, gate, records, registry, relate, serve
from claimspark.sources import tables
from claimspark.streaming.incremental import FactState

CANON = (
    "claim_id bigint, doc_id bigint, block_key string, value_canon double, value_text string, unit_canon string, precision double, scope_canon string, basis_canon string, "
    "publisher string, published_at string, period_end date, label string, entity string, metric_key string, period_start date"
)


def claim(i, value=None, *, doc=None, block="b", text=None, unit="INR", precision=0.0, scope=None, basis="actual", publisher="Acme", published="2024-05", label="Revenue"):
    return (i, doc or i, block, value, text, unit, precision, scope, basis, publisher, published, None, label, "e", "m", None)


PAIRS = [
    (claim(1, 31.2e9, scope="standalone"), claim(2, 47.9e9, scope="consolidated"), ("reconciled", 1, 2, "scope", "high", "standalone vs consolidated")),
    (claim(1, 3.1, precision=0.05, basis="advance_estimate"), claim(2, 3.4, precision=0.05), ("supersedes", 2, 1, "basis", "high", "basis matured: advance_estimate → actual")),
    (claim(1, 7.7, publisher="North"), claim(2, 6.2, publisher="South"), ("contradicts", 1, 2, None, "review", "every coordinate matches and the values differ")),
    (claim(1, 52310.44e6, precision=5e3), claim(2, 5231e7, precision=5e6), ("corroborates", 1, 2, None, "high", None)),
    (claim(1, 1.0, scope="standalone"), claim(2, 1.0), ("corroborates", 1, 2, None, "high", "scope unstated on one side")),
    (claim(1, 1.0, label="Rental income"), claim(2, 2.0, publisher="Acme Ltd."), ("reconciled", 1, 2, "label", "low", "same publisher, two line items; labels differ: Rental income vs Revenue")),
    (claim(1, 1.0, published="2023"), claim(2, 2.0), ("supersedes", 2, 1, "vintage", "high", "restated by Acme on 2024-05-01")),
    (claim(1, 1.0, published=None), claim(2, 2.0), ("contradicts", 1, 2, None, "review", "publication date unknown, so supersession cannot be decided")),
    (claim(1, 1.0), claim(2, 2.0), ("contradicts", 1, 2, None, "review", "same publisher, same label, same date, different values")),
    (claim(1, 1.0, basis="projection"), claim(2, 2.0, publisher="Other"), ("reconciled", 1, 2, "basis", "high", "projection vs actual")),
    (claim(1, 1.0, unit="USD"), claim(2, 1.0), None),
    (claim(1, text="open"), claim(2, text="closed", published="2025"), ("supersedes", 2, 1, "time", "high", "state changed: open (2024-05-01) → closed (2025-01-01)")),
    (claim(1, text="open"), claim(2, 1.0), None),
]


def test_decisions(spark):
    rows = [(*c[:2], f"b{k}", *c[3:]) for k, (a, b, _) in enumerate(PAIRS) for c in ((a[0] + 10 * k, *a[1:]), (b[0] + 10 * k, *b[1:]))]
    found = {r.block_key: (r.kind, r.a_id % 10, r.b_id % 10, r.dimension, r.confidence, r.explanation) for r in relate.relations(spark.createDataFrame(rows, CANON)).collect()}
    assert found == {f"b{k}": want for k, (_, _, want) in enumerate(PAIRS) if want}


def test_large_blocks_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(relate, "BLOCK_SHARE", 7)
    rows = [claim(i, float(i)) for i in range(60)]
    assert relate.candidate_pairs(relate.comparable(spark.createDataFrame(rows, CANON))).count() == 60 * 59 // 2


def test_current_value_and_history(spark):
    rows = [claim(1, 2.1, basis="advance_estimate", publisher="one"), claim(2, 2.3, publisher="two"), claim(3, 2.3, publisher="three", published="2023"), claim(4, 9.9, block="other")]
    canon = spark.createDataFrame(rows, CANON)
    found = relate.relations(canon)
    now = serve.current_values(canon, found)
    assert {(r.block_key, r.claim_id, r.members) for r in now.collect()} == {("b", 2, 3), ("other", 4, 1)}
    assert [(r.claim_id, r.superseded_by) for r in serve.value_history(found, now).collect()] == [(1, 2)]
    assert [(r.current_id, r.other_id, r.kind) for r in serve.related_to_current(found, now).collect()] == [(2, 3, "corroborates")]


def test_merges(spark):
    proposals = [("1", 0, "a", "b", ""), ("1", 1, "a", "c", ""), ("2", 0, "d", "b", ""), ("3", 0, "x", "e", ""), ("4", 0, "e", "a2", ""), ("5", 0, "f", "e", "")]
    metrics = spark.createDataFrame([(k,) for k in "abcdef"], "key string")
    units = spark.createDataFrame([("a", "INR"), ("c", "pct"), ("b", "USD")], "metric_key string, unit string")
    got = registry.validate_merges(spark.createDataFrame(proposals, "group_no string, item_no int, keep string, alias string, why string"), metrics, spark.createDataFrame([], "alias string, key string"), units)
    assert {(r.group_no, r.alias, r.keep, r.outcome) for r in got.collect()} == {
        ("1", "b", "a", "applied"), ("1", "c", "a", "unit differs (pct vs INR)"), ("2", "b", "d", "already used"), ("3", "x", None, "keep is not a live key"), ("4", "e", None, "keep is merged away in another group"), ("5", "e", "f", "applied"),
    }


def test_quotes(spark):
    pages = spark.createDataFrame([(1, 1, "Total revenue 815 crore"), (1, 2, "The net profit was 42 crore"), (1, 3, "")], "doc_id bigint, page_no int, text string")
    docs = spark.createDataFrame([(1, 3)], "doc_id bigint, page_count int")
    quotes = [(1, 1, 1, "revenue 815"), (2, 1, 2, "Total revenue"), (3, 1, 2, "profit 42 crore"), (4, 1, 3, "profit of 43 crore"), (5, 1, 9, "x 1"), (6, 1, 1, "profit 99"), (7, 1, None, "x"), (8, 1, 1, None)]
    rows = {r.claim_id: r for r in gate.verify_claims(spark.createDataFrame([(*q, "unverified") for q in quotes], "claim_id bigint, doc_id bigint, page_no int, quote string, status string"), pages, docs).collect()}
    assert [(rows[i].grade, rows[i].located_page, rows[i].reason) for i in range(1, 9)] == [
        ("exact", 1, None), ("nearby", 1, None), ("tokens", 2, None), (None, None, "no_text_layer"), (None, None, "page_out_of_range"), (None, None, "quote_not_found"), (None, None, "page_out_of_range"), (None, None, "quote_not_found"),
    ]
    assert tuple(rows[1].span) == (6, 17) and rows[5].detail == "page 9 of 3"


def test_moved_claims_take_the_currency_of_their_own_page(spark):
    """The quote stands on page 1, in rupees; page 2, in dollars, was cited."""
    pages = spark.createDataFrame([(1, 1, "All figures in rupees. Revenue was 815 crore"), (1, 2, "US$ 5")], "doc_id bigint, page_no int, text string")
    docs = spark.createDataFrame([(1, 2, "Acme", None)], "doc_id bigint, page_count int, publisher string, published_at string")
    kinds = "claim_id bigint, doc_id bigint, page_no int, subject string, metric_raw string, label string, value_raw string, unit_raw string, period_raw string, scope_raw string, basis_raw string, quote string, keys map<string,string>, status string"
    claims = spark.createDataFrame([(7, 1, 2, "Acme", "revenue", "Revenue", "815", "crore", "FY24", None, None, "Revenue was 815", {}, "unverified")], kinds)
    checked = gate.verify_claims(claims, pages, docs).checkpoint()
    assert [(r.page_no, r.grade, tuple(r.span)) for r in checked.collect()] == [(1, "nearby", (23, 38))]
    row = canon.canonicalise_claims(checked, docs, spark.createDataFrame([], "alias string, key string"), pages).collect()[0]
    assert (row.unit_canon, row.value_canon, row.block_key) == ("INR", 815e7, "acme|revenue|2023-04-01|2024-03-31")


CLAIM = "claim_id bigint, doc_id bigint, page_no int, subject string, metric_raw string, label string, value_raw string, unit_raw string, period_raw string, scope_raw string, basis_raw string, quote string, keys map<string,string>, status string"


def stated(i, subject, keys, value="1", metric="revenue", status="verified"):
    return (i, i % 3, 1, subject, metric, "Revenue", value, "INR", "FY24", None, "actual", "q", keys, status)


def test_owners_are_followed_to_the_root(spark):
    """Claims that share an identifier have one entity, however long the chain."""
    chain = [stated(k, f"name {k}", {f"k{k - 1}": "v", f"k{k}": "V"}) for k in range(1, 12)]
    rows = spark.createDataFrame([*chain, stated(20, "alone", {"k0": "", "x": None}), stated(21, "none", {})], CLAIM).selectExpr("*", "'P' as publisher")
    assert {r.claim_id: r.entity for r in canon.resolve_entities(rows).collect()} == {**{k: "name 1" for k in range(1, 12)}, 20: "alone", 21: "none"}


def test_aliases_are_followed_and_counted_once(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 5), ("d", 1)], "metric_raw string, n bigint")
    aliases = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("d", "d")], "alias string, key string")
    assert sorted(tuple(r) for r in canon.metric_keys(counts, aliases).collect()) == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "d")]


def test_published_tables_that_differ(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a/t"))
    assert [tuple(r) for r in tables.publish_and_verify(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["t"]).collect()] == [("t", 3, 3, "ok")]
    compared = tables.publish_and_verify(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["t"])
    spark.range(2).write.mode("overwrite").parquet(str(tmp_path / "b/t"))
    spark.catalog.clearCache()
    assert [r.outcome for r in tables.compare_counts(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["t"]).collect()] == ["MISMATCH"] and compared.columns[-1] == "outcome"


def test_the_state_equals_a_rebuild(spark, tmp_path):
    """Claims in any order over batches: older ids and more frequent spellings come late and move what is there; the first batch has no relation, one is sent twice."""
    import random

    rng = random.Random(1)
    claims = [stated(k, f"name {rng.randrange(6)}", {x: str(rng.randrange(4)) for x in rng.sample(["din", "pan", "cin"], rng.randrange(3))}, str(rng.randrange(3)), rng.choice(["revenue", "revenues", "cost", "costs"]), rng.choice(["verified", "verified", "quarantined"])) for k in range(36)]
    rng.shuffle(claims)
    docs = spark.createDataFrame([(k, f"P{k}", "2024") for k in range(3)], "doc_id bigint, publisher string, published_at string")
    aliases = spark.createDataFrame([], "alias string, key string")
    state = FactState(spark, str(tmp_path / "state"), docs, aliases)
    cuts = [0, 1, 12, 12, 25, 36]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rows = spark.createDataFrame(claims[a:b] + claims[: a // 2], CLAIM)
        state.take(rows, batch)
        if batch == 2:
            state = FactState(spark, str(tmp_path / "state"), docs, aliases)
            state.take(rows, batch)
    whole = canon.canonicalise_claims(spark.createDataFrame(claims, CLAIM), docs, aliases).checkpoint()
    shown = lambda frame, names: sorted(map(str, (tuple(r) for r in frame.select(*names).collect())))
    names = ["claim_id", "entity", "metric_key", "value_canon", "unit_canon", "block_key", "period_start"]
    assert shown(state.canon(), names) == shown(whole, names)
    names = ["block_key", "a_id", "b_id", "kind", "explanation"]
    assert shown(state.relations(), names) == shown(relate.relations(whole), names)
    touched = {r.batch: r.n for r in spark.read.parquet(str(tmp_path / "state/touched")).groupBy("batch").count().withColumnRenamed("count", "n").collect()}
    assert 2 not in touched  # nothing new arrived


def test_truncated_replies(spark):
    line = '{"type":"claim","page":%d,"metric":"m","quote":"q"}'
    replies = [(1, 1, "\n".join(line % p for p in (1, 2, 2, 3)), "MAX_TOKENS"), (2, 1, "junk", "MAX_TOKENS"), (3, 1, "", "STOP")]
    rows = records.trim_truncated(records.parse_claim_lines(spark.createDataFrame(replies, "doc_id bigint, response_id int, text string, finish_reason string")))
    assert [(len(r.claims), r.next_start, r.partial) for r in rows.orderBy("doc_id").collect()] == [(3, 3, False), (0, None, True), (0, None, False)]
    assert [(r.status, r.reason) for r in records.document_outcome(rows).orderBy("doc_id").collect()] == [("extracted", None), ("partial", "output cut off"), ("extracted", "no claims: STOP")]


def test_files_and_replies(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    assert [(r.filename, r.length) for r in tables.read_raw_documents(spark, str(tmp_path / "in")).collect()] == [("a.pdf", 10)]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "k1.json").write_text('{"text": "hello",\n "finish_reason": "STOP", "input_tokens": 3}')
    assert [(r.key, r.text, r.input_tokens) for r in tables.read_responses(spark, str(tmp_path / "out")).collect()] == [("k1", "hello", 3)]


QUICK = ["c3_parse_period", "c6_parse_unit", "c18_canonicalise_claims", "r5_relate_numeric", "q11_current_values", "h4_page_features", "v3_grade_quotes", "e5_type_claims", "g5_validate_merges", "s6_response_key", "i1_incremental_documents"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_agree_with_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    rows = __spark_entry__.queries()[name](spark, sf_dir)
    cursor = db.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(rows.columns)
    shown = lambda found: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in found)
    assert shown(rows.select(*names).collect()) == shown(cursor.fetchall())


def test_every_query_has_a_partner():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert {k for k in queries if k not in sql} - {k for k in queries if k.startswith("op") or k == "pipeline"} == set()
