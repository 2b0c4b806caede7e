"""The queries once more, as SQL for another engine."""

from __future__ import annotations

from claimspark.plans.fixtures import oracle_ctes

_CANON = """canon as (
select c.claim_id, c.doc_id, lower(replace(c.subject, ' Limited', '')) as entity,
(select metric_raw from fx_claims group by 1 order by count(*) desc, 1 limit 1) as metric_key, cast(make_date(c.fy - 1, 4, 1) as string) as period_start, cast(make_date(c.fy, 3, 31) as string) as period_end,
'INR' as unit_canon, cast(c.value_raw as double) * s.scale as value_canon, (case when c.k % 3 = 2 then cast(0.5 as double) else cast(0.5 as double) * pow(cast(10 as double), -2) end) * s.scale as precision,
cast(null as string) as value_text, c.basis_raw as basis_canon, c.scope_raw as scope_canon, c.label, d.publisher, d.filename, lower(replace(replace(d.publisher, ' Ltd.', ''), '#', ' ')) as publisher_key,
case when d.published_at = '2002-05' then '2002-05-01' when d.published_at is not null then '2003-03-12' end as vintage, c.k, c.v, c.fy, c.cin
from fx_claims c join fx_documents d on d.doc_id = c.doc_id
join (select 0 as m, cast(1e6 as double) as scale union all select 1, cast(1e5 as double) union all select 2, cast(1e3 as double)) s on s.m = c.k % 3),
blocked as (select *, entity || '|' || metric_key || '|' || period_start || '|' || period_end as block_key from canon)"""

_PAIRS = """pairs as (
select a.block_key, a.claim_id as a_claim, b.claim_id as b_claim, a.doc_id <> b.doc_id as cross_document, a.scope_canon as sa, b.scope_canon as sb, a.basis_canon as ba, b.basis_canon as bb, a.label as la, b.label as lb, a.publisher as pa, b.publisher as pb, a.vintage as va, b.vintage as vb,
abs(a.value_canon - b.value_canon) <= greatest(a.precision, b.precision) * 1.0000001 as is_close, a.publisher_key = b.publisher_key as same_publisher,
a.scope_canon is not null and b.scope_canon is not null and a.scope_canon <> b.scope_canon as scope_differs, (a.scope_canon is null) <> (b.scope_canon is null) as one_unstated, a.basis_canon <> b.basis_canon as basis_differs,
case a.basis_canon when 'advance_estimate' then 1 when 'provisional' then 2 when 'revised' then 3 when 'actual' then 4 end as ra, case b.basis_canon when 'advance_estimate' then 1 when 'provisional' then 2 when 'revised' then 3 when 'actual' then 4 end as rb
from {source} a join {source} b on a.block_key = b.block_key and a.claim_id < b.claim_id),
ruled as (select *, case when is_close then 1 when scope_differs then 2 when same_publisher and la <> lb then 3 when basis_differs and ra is not null and rb is not null then 4
when basis_differs and same_publisher and va <> vb then 5 when basis_differs then 6 when one_unstated then 7 when same_publisher and va <> vb then 8 when same_publisher and (va is null or vb is null) then 9 when same_publisher then 10 else 11 end as rule from pairs),
turned as (select *, case when rule = 4 then ra <= rb when rule in (5, 8) then va < vb else false end as swap from ruled),
relations as (select block_key, case when swap then b_claim else a_claim end as a_id, case when swap then a_claim else b_claim end as b_id,
case when rule = 1 then 'corroborates' when rule in (4, 5, 8) then 'supersedes' when rule in (2, 3, 6, 7) then 'reconciled' else 'contradicts' end as kind,
case rule when 2 then 'scope' when 3 then 'label' when 4 then 'basis' when 5 then 'vintage' when 6 then 'basis' when 7 then 'scope' when 8 then 'vintage' end as dimension,
case when rule in (1, 2, 4, 5, 6, 8) then 'high' when rule in (3, 7) then 'low' else 'review' end as confidence,
case rule when 1 then nullif(concat_ws('; ', case when scope_differs then 'scope differs (' || sa || ' vs ' || sb || ') yet values agree' when one_unstated then 'scope unstated on one side' end, case when basis_differs then 'basis differs (' || ba || ' vs ' || bb || ') yet values agree' end), '')
when 2 then sa || ' vs ' || sb when 3 then 'same publisher, two line items; labels differ: ' || la || ' vs ' || lb
when 4 then 'basis matured: ' || case when swap then ba || ' → ' || bb else bb || ' → ' || ba end
when 5 then 'restated by ' || case when swap then pb || ' on ' || vb || ': ' || ba || ' → ' || bb else pa || ' on ' || va || ': ' || bb || ' → ' || ba end
when 6 then ba || ' vs ' || bb when 7 then 'scope unstated on one side; values differ' when 8 then 'restated by ' || case when swap then pb || ' on ' || vb else pa || ' on ' || va end
when 9 then 'publication date unknown, so supersession cannot be decided' when 10 then 'same publisher, same label, same date, different values' else 'every coordinate matches and the values differ' end as explanation, cross_document from turned)"""

_CURRENT = """current_values as (
select * from (select c.*, count(*) over (partition by block_key) as members, count(*) filter (where superseded) over (partition by block_key) as n_superseded, row_number() over (partition by block_key order by superseded, basis_rank desc, corroborations desc, coalesce(vintage, '') desc, claim_id) as rn from (
select b.*, b.claim_id in (select b_id from relations where kind = 'supersedes') as superseded, coalesce(n.n, 0) as corroborations, coalesce(case b.basis_canon when 'advance_estimate' then 1 when 'provisional' then 2 when 'revised' then 3 when 'actual' then 4 end, 0) as basis_rank
from {source} b left join (select id, count(*) as n from (select a_id as id from relations where kind = 'corroborates' union all select b_id from relations where kind = 'corroborates') group by 1) n on n.id = b.claim_id) c) where rn = 1)"""

_STATES = """states as (
select s.claim_id, s.doc_id, lower(replace(s.c_name, '#', ' ')) as entity, 'order_status' as metric_key, lower(s.value_raw) as value_text, period_raw as period_start, period_raw as period_end, lower(replace(s.c_name, '#', ' ')) || '|order_status' as block_key, 'actual' as basis_canon,
case when d.published_at = '2002-05' then '2002-05-01' when d.published_at is not null then '2003-03-12' end as vintage
from fx_states s join fx_documents d on d.doc_id = s.doc_id)"""

_STATE_RELATIONS = """relations as (select a.block_key, case when a.value_text <> b.value_text and a.period_end < b.period_end then b.claim_id else a.claim_id end as a_id, case when a.value_text <> b.value_text and a.period_end < b.period_end then a.claim_id else b.claim_id end as b_id,
case when a.value_text = b.value_text then 'corroborates' when a.period_end <> b.period_end then 'supersedes' else 'contradicts' end as kind,
case when a.value_text <> b.value_text and a.period_end <> b.period_end then 'time' end as dimension, case when a.value_text = b.value_text or a.period_end <> b.period_end then 'high' else 'review' end as confidence,
case when a.value_text = b.value_text then null when a.period_end < b.period_end then 'state changed: ' || a.value_text || ' (' || a.period_end || ') → ' || b.value_text || ' (' || b.period_end || ')' when a.period_end > b.period_end then 'state changed: ' || b.value_text || ' (' || b.period_end || ') → ' || a.value_text || ' (' || a.period_end || ')'
else 'same entity, same as-of date, different states' end as explanation, a.doc_id <> b.doc_id as cross_document
from states a join states b on a.block_key = b.block_key and a.claim_id < b.claim_id)"""

_PAGES = """lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
numbered as (select doc_id, l, unnest(generate_series(1, cast(ceil(len(l) / 3.0) as bigint))) as page_no from lines),
fx_pages as (select doc_id, page_no, case when doc_id % 4 = 0 then '(All amounts in Indian Rupees in million)' || chr(10) else '' end || case when doc_id % 6 = 0 then 'Standalone Balance Sheet as at March 31, 2024' || chr(10) else '' end
|| array_to_string(l[(page_no - 1) * 3 + 1 : (page_no - 1) * 3 + 3], chr(10)) as text, l[(page_no - 1) * 3 + 1] as first_line from numbered),
counted as (select doc_id, max(page_no) as page_count from fx_pages group by 1),
featured as (select *, len(regexp_extract_all(text, '[^\\s]+')) as word_count, len(regexp_extract_all(text, '[0-9][0-9,.]*')) as numbers from fx_pages)"""

_GATE = r"""quotes as (select doc_id * 10000 + page_no as claim_id, doc_id, page_no + doc_id % 4 - 1 as page_no, array_to_string(w[1:6], ' ') || case when doc_id % 7 = 0 then ' 98765' else '' end as quote
from (select *, string_split(trim(regexp_replace(first_line, '\s+', ' ', 'g')), ' ') as w from fx_pages) where len(w) >= 3),
normal as (select doc_id, page_no, text, NORM(text) as norm from fx_pages),
asked as (select q.*, NORM(q.quote) as q, c.page_count, p.text, b.text as text_before, a.text as text_after, p.norm, b.norm as before, a.norm as after from quotes q join counted c on c.doc_id = q.doc_id left join normal p on p.doc_id = q.doc_id and p.page_no = q.page_no
left join normal b on b.doc_id = q.doc_id and b.page_no = q.page_no - 1 and p.page_no is not null left join normal a on a.doc_id = q.doc_id and a.page_no = q.page_no + 1 and p.page_no is not null),
tokens as (select *, regexp_extract_all(q, '[0-9][0-9,]*[.]?[0-9]*') as n, regexp_extract_all(q, '[a-z]{3,}') as w from asked),
graded as (select *, case when q = '' or norm is null then 9 when contains(norm, q) then 1 when contains(coalesce(before, ''), q) then 2 when contains(coalesce(after, ''), q) then 3
when HAS(norm) then 4 when HAS(coalesce(before, '')) then 5 when HAS(coalesce(after, '')) then 6 else 9 end as g from tokens),
gated as (select *, case when g in (1) then 'exact' when g in (2, 3) then 'nearby' when g in (4, 5, 6) then 'tokens' end as grade, page_no + case when g in (2, 5) then -1 when g in (3, 6) then 1 when g = 9 then null else 0 end as located_page,
case when g < 9 then null when page_no < 1 or page_no > page_count then 'page_out_of_range' when trim(regexp_replace(text, '\s', '', 'g')) = '' then 'no_text_layer' else 'quote_not_found' end as reason,
case when g < 9 then 'verified' else 'quarantined' end as status, lower(case when g in (2, 5) then text_before when g in (3, 6) then text_after when g in (1, 4) then text end) as place,
array_to_string(list_transform(list_filter(string_split_regex(lower(quote), '\s+'), lambda t: t <> ''), lambda t: regexp_escape(t)), '[\s\S]{0,4}?') as chain from graded),
spanned as (select *, case when place is not null then nullif(regexp_extract(place, chain), '') end as hit from gated)"""


def _spelled(sql: str) -> str:
    """The gate's normal form and token rule, written out."""
    import re

    norm = lambda m: f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({m[1]}, '\\([0-9]{{1,2}}(?:,\\s*[0-9]{{1,2}})*\\)', '', 'g'), '([a-z])[0-9]{{1,2}}([\\s,.;:)]|$)', '\\1\\2', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_%₹$.,-]+', ' ', 'g'), '\\s+', ' ', 'g')))"
    has = lambda m: f"(len(n) > 0 and len(list_filter(n, lambda t: not contains({m[1]}, t))) = 0 and len(list_filter(w, lambda t: contains({m[1]}, t))) >= 0.7 * len(w))"
    sql = re.sub(r"HAS\(((?:coalesce\(\w+, ''\))|\w+)\)", has, sql)
    return re.sub(r"NORM\(([\w.]+)\)", norm, sql)


_REPLY = "'{\"type\":\"claim\",\"page\":' || cast(cast(right(period_raw, 2) as int) as string) || ',\"subject\":\"' || subject || '\",\"metric\":\"' || metric_raw || '\",\"label\":\"' || label || '\",\"value\":\"' || value_raw || '\",\"unit\":\"' || unit_raw || '\",\"period\":\"' || period_raw || '\"' || coalesce(',\"scope\":\"' || scope_raw || '\"', '') || ',\"basis\":\"' || basis_raw || '\",\"quote\":\"' || quote || '\",\"keys\":{' || coalesce('\"cin\":\"' || cin || '\"', '') || '}}'"
_PRINTED = """printed as (select l_orderkey, l_linenumber, l_orderkey % 6 as s, cast(cast(round(l_extendedprice * 100) as bigint) // 100 as string) || '.' || lpad(cast(cast(round(l_extendedprice * 100) as bigint) % 100 as string), 2, '0') as p from lineitem)"""
_PARTS = """registered as (select p_partkey as claim_id, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') || '_' || cast(p_size % 5 as string) as metric_key, p_name as label, case when p_size % 7 <> 0 then ['pct', 'INR', 'count', 'x'][p_partkey % 10 * length(p_type) % 4 + 1] end as unit_canon, p_partkey as doc_id from part),
metrics as (select metric_key as key, count(*) as claim_count from registered group by 1),
units as (select metric_key, unit_canon as unit from (select metric_key, unit_canon, row_number() over (partition by metric_key order by count(*) desc, unit_canon) as rn from registered where unit_canon is not null group by 1, 2) where rn = 1),
proposals as (select key as group_no, g.i as item_no, key as keep, left(key, length(key) - 1) || g.x as alias, 'alike' as why from metrics cross join (select 0 as i, '0' as x union all select 1, '2' union all select 2, '9') g where right(key, 1) in ('1', '3'))"""

_RECORDS = """parsed as (select doc_id, claim_id, cast(right(period_raw, 2) as bigint) as page_no, doc_id % 9 = 0 as broken, c.* exclude (doc_id, claim_id, page_no) from fx_claims c),
cut as (select doc_id, max(page_no) as top, bool_or(broken) as broken from parsed group by 1),
trimmed as (select p.*, c.top from parsed p join cut c on c.doc_id = p.doc_id where not c.broken or p.page_no < c.top)"""


def _sql(select: str, *parts: str, source: str = "blocked") -> str:
    return ",\n".join([oracle_ctes(), *[p.replace("{source}", source) for p in parts]]) + "\n" + select


_RELATED = (_CANON, _PAIRS)
_REL = "select a_id, b_id, kind, dimension, explanation, confidence, cross_document from relations"
_HINTS = "case when doc_id % 4 = 0 and page_no is not null then 'INR million' else '' end"


def oracle_sql() -> dict[str, str]:
    number = "case s when 0 then cast(p as double) when 1 then -cast(p as double) when 2 then -cast(p as double) when 3 then cast(p as double) when 4 then cast(p as double) end"
    paged, gate = (_PAGES,), (_PAGES, _spelled(_GATE))
    found = {
        "c8_parse_value": _sql(f"select l_orderkey, l_linenumber, {number} as value from printed", _PRINTED),
        "c9_precision_of": _sql("select l_orderkey, l_linenumber, case when s = 5 then cast(0 as double) else cast(0.5 as double) * pow(cast(10 as double), -2) end as precision from printed", _PRINTED),
        "c6_parse_unit": "select o_orderkey, ['INR', 'pct', 'count', 'sq ft', 'USD', 'pct', 'EUR', 'count', 'x', null, 'INR', 'tonnes'][o_orderkey % 12 + 1] as unit, cast([1e7, 0.01, 1e12, 1e6, 1e9, 1, 1e6, 1, 1, null, 1e5, 1][o_orderkey % 12 + 1] as double) as scale from orders",
        "c10_entity_key": "select c_custkey, lower(replace(c_name, '#', ' ')) as entity from customer",
        "c11_subject_name": "select c_custkey, case when c_custkey % 4 = 2 then c_name when c_custkey % 8 < 6 then c_mktsegment else 'unknown' end as name from customer",
        "c13_measure_family": "select p_partkey, array_to_string(list_transform(string_split(regexp_replace(lower(p_name || case when p_partkey % 2 = 0 then 's' else '' end), '[^a-z0-9]+', '_', 'g'), '_'), lambda t: case when length(t) > 4 and ends_with(t, 'ies') then left(t, length(t) - 3) || 'y' when length(t) > 3 and ends_with(t, 's') then left(t, length(t) - 1) else t end), '_') as family from part",
        "c15_basis_canon": "select o_orderkey, case o_orderkey % 6 when 0 then 'provisional' when 1 then 'budget' when 2 then 'projection' when 3 then 'advance_estimate' when 4 then 'projection' else 'revised' end as basis, case o_orderkey % 6 when 0 then 'provisional' when 1 then 'budget' when 2 then 'projection' end as marker, case o_orderkey % 6 when 3 then 'advance_estimate' when 4 then 'projection' end as phrase from orders",
        "c3_parse_period": """select o_orderkey, cast(a as string) as period_start, cast(b as string) as period_end from (select o_orderkey,
case k when 0 then d when 1 then date_trunc('month', d)::date when 2 then make_date(y - 1, 4, 1) when 3 then date_trunc('quarter', d)::date when 4 then make_date(y - 1, 4, 1) when 5 then (date_trunc('month', d) - interval 2 month)::date when 6 then make_date(y - 1, 10, 1) when 7 then d end as a,
case k when 0 then d when 1 then last_day(d) when 2 then make_date(y, 3, 31) when 3 then last_day((date_trunc('quarter', d) + interval 2 month)::date) when 4 then make_date(y - 1, 9, 30) when 5 then d when 6 then make_date(y - 1, 12, 31) when 7 then d end as b
from (select o_orderkey, o_orderkey % 9 as k, cast(o_orderdate as date) as d, year(o_orderdate) as y from orders))""",
        "c12_published_key": _sql("select doc_id, published_at, case when published_at = '2002-05' then '2002-05-01' when published_at is not null then '2003-03-12' end as vintage from fx_documents"),
        "r3_label_tokens": "select p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') as tokens from part",
        "c18_canonicalise_claims": _sql("select claim_id, doc_id, entity, metric_key, unit_canon, value_canon, precision, value_text, basis_canon, scope_canon, block_key, period_start, period_end from blocked", _CANON),
        "c18_canonicalise_states": _sql("select claim_id, doc_id, entity, metric_key, value_text, block_key, period_start, period_end from states", _STATES),
        "c7_rescue_currency": _sql("select claim_id, case when doc_id % 2 = 1 then 'tonnes' when doc_id % 3 = 0 then 'USD' when doc_id % 3 = 1 then 'INR' else 'count' end as unit_canon, cast(value_raw as double) * 1e7 as value_canon from fx_claims"),
        "c16_resolve_entities": _sql("select claim_id, entity from blocked", _CANON),
        "c16_entities": _sql("select distinct entity, 'person' as kind, din from (select entity, s.din from states t join fx_states s on s.claim_id = t.claim_id)", _STATES),
        "c17_resolve_metrics": """with raw as (select regexp_replace(lower(p_name || case when p_partkey % 3 = 0 then 's' else '' end), '[^a-z0-9]+', '_', 'g') as metric_raw from part), counts as (select metric_raw, count(*) as n from raw group by 1),
family as (select *, array_to_string(list_transform(string_split(metric_raw, '_'), lambda t: case when length(t) > 4 and ends_with(t, 'ies') then left(t, length(t) - 3) || 'y' when length(t) > 3 and ends_with(t, 's') then left(t, length(t) - 1) else t end), '_') as f from counts)
select metric_raw, first_value(metric_raw) over (partition by f order by n desc, metric_raw) as metric_key from family""",
        "c19_canon_stats": _sql("select doc_id, count(*) as numeric, cast(0 as bigint) as text, cast(0 as bigint) as non_comparable from blocked group by 1", _CANON),
        "q9_metric_list": _sql("select metric_key as key, min(label) as label, count(*) as claim_count, (select filename from fx_documents where doc_id = (select min(doc_id) from fx_claims)) as filename, (select string_agg(distinct metric_raw, ',') from fx_claims where metric_raw <> (select min(metric_key) from blocked)) as aliases from blocked group by 1", _CANON),
        "r1_candidate_pairs": _sql("select block_key, count(*) * (count(*) - 1) // 2 as pairs from blocked group by 1 having count(*) > 1", _CANON),
        "r5_relate_numeric": _sql(_REL, *_RELATED),
        "r6_relate_text": _sql(_REL, _STATES, _STATE_RELATIONS),
        "r8_upsert_relations": _sql(_REL, *_RELATED),
        "r9_touched_blocks": _sql("select distinct block_key from blocked where doc_id % 10 = 3", _CANON),
        "r10_reconcile_stats": _sql("select (select count(*) from (select block_key from blocked group by 1 having count(*) > 1)) as blocks, count(*) as pairs, " + ", ".join(f"count(*) filter (where kind = '{k}') as {k}" for k in ("corroborates", "reconciled", "supersedes", "contradicts")) + " from relations", *_RELATED),
        "q11_current_values": _sql("select block_key, claim_id, value_canon, unit_canon, basis_canon, corroborations, members, n_superseded from current_values", *_RELATED, _CURRENT),
        "q11_current_states": _sql("select block_key, claim_id, value_text, corroborations, members, n_superseded from current_values", _STATES, _STATE_RELATIONS, _CURRENT, source="states"),
        "q12_value_history": _sql("select block_key, b_id as claim_id, a_id as superseded_by, explanation from (select r.*, row_number() over (partition by r.b_id order by (r.a_id <> c.claim_id), r.a_id) as n from relations r join current_values c on c.block_key = r.block_key where r.kind = 'supersedes') where n = 1", *_RELATED, _CURRENT),
        "q13_related_to_current": _sql("select r.block_key, c.claim_id as current_id, case when r.a_id = c.claim_id then r.b_id else r.a_id end as other_id, r.kind, r.explanation from relations r join current_values c on c.block_key = r.block_key and c.claim_id in (r.a_id, r.b_id) where r.kind <> 'supersedes'", *_RELATED, _CURRENT),
        "q7_relation_counts": _sql("select kind, cross_document, count(*) as n from relations group by 1, 2", *_RELATED),
        "q5_search_relations": _sql("select a_id, b_id, (select min(metric_key) from blocked) as metric_key, explanation from relations where kind = 'supersedes' and confidence = 'high' and cross_document", *_RELATED),
        "q1_claim_view": _sql("select claim_id, filename, publisher, case when claim_id % 5 = 2 then 'quarantined' else 'verified' end as status, case when claim_id % 5 = 2 then null when claim_id % 3 = 0 then 'tokens' else 'exact' end as grade, case when claim_id % 5 <> 2 then 1 end as located_page, case when claim_id % 5 <> 2 then entity end as entity, case when claim_id % 5 <> 2 then value_canon end as value_canon, case when claim_id % 5 <> 2 then block_key end as block_key, case when claim_id % 5 = 2 then 'quote_not_found' end as quarantine_reason from blocked", _CANON),
        "q3_search_claims_page": _sql("select claim_id, doc_id, case when claim_id % 3 = 0 then 'tokens' else 'exact' end as grade from blocked where claim_id % 5 <> 2 order by doc_id, claim_id limit 50 offset 50", _CANON),
        "q5_search_relations_page": _sql("select a_id, b_id, kind, cross_document from relations where a_id // 1000 = (select min(doc_id) from fx_claims) or b_id // 1000 = (select min(doc_id) from fx_claims) order by kind, a_id, b_id limit 100", *_RELATED),
        "q8_quarantine_page": _sql("select claim_id, doc_id, 'quote_not_found' as quarantine_reason from blocked where claim_id % 5 = 2 order by doc_id, claim_id limit 40 offset 3", _CANON),
        "q9_metric_page": _sql("""select key, claim_count, filename from (select k.metric_key as key, count(*) as claim_count, min(r.doc_id) as first from registered r join (select metric_key as raw, first_value(metric_key) over (partition by f order by n desc, metric_key) as metric_key from (select metric_key, count(*) as n, array_to_string(list_transform(string_split(metric_key, '_'), lambda t: case when length(t) > 4 and ends_with(t, 'ies') then left(t, length(t) - 3) || 'y' when length(t) > 3 and ends_with(t, 's') then left(t, length(t) - 1) else t end), '_') as f from registered group by 1)) k on k.raw = r.metric_key group by 1) m
join (select doc_id, label as filename from registered) d on d.doc_id = m.first order by claim_count desc, key limit 100""", _PARTS),
        "q10_entity_page": _sql("select entity, count(*) as claims from blocked group by 1 order by claims desc, entity limit 10 offset 2", _CANON),
        "q3_search_claims": _sql("select claim_id, entity, label from blocked where contains(entity, 'nation_1') and claim_id % 5 <> 2 and claim_id % 3 <> 0 and label = 'Truckload revenue'", _CANON),
        "q4_claims_by_ids": _sql("select claim_id, case when claim_id % 5 <> 2 then entity end as entity, case when claim_id % 5 <> 2 then value_canon end as value_canon from blocked where claim_id % 7 = 0", _CANON),
        "q6_relation_detail": _sql("select r.a_id, r.b_id, a.filename as a_filename, b.filename as b_filename, a.value_canon as a_value, b.value_canon as b_value from relations r join blocked a on a.claim_id = r.a_id join blocked b on b.claim_id = r.b_id where r.kind = 'contradicts' and r.cross_document and r.a_id % 5 <> 2 and r.b_id % 5 <> 2", *_RELATED),
        "q10_entity_list": _sql("select e.entity, count(b.claim_id) as claims from (select lower(n_name) as entity from nation union select entity from blocked) e left join blocked b on b.entity = e.entity group by 1", _CANON),
        "q16_answer_requests": _sql("""select request_id, entity_found, metric_found, c.claim_id, c.value_canon, case when c.claim_id is not null then null when entity_found is null then 'no entity matching ' || asked when r.fy = 2002 then 'could not read period some day' else 'no grounded claim for that entity, metric and period' end as reason from (
select n_nationkey * 10000 + fy as request_id, fy, case n_nationkey % 4 when 0 then n_name || ' Limited' when 1 then substr(n_name, 2) when 2 then n_name || ' isle' else n_name end as asked, (select min(metric_key) from blocked) as metric_found,
case n_nationkey % 4 when 2 then null when 1 then (select entity from (select distinct entity from blocked) where contains(entity, lower(substr(n_name, 2))) order by length(entity), entity limit 1) else (select min(entity) from blocked where contains(entity, lower(n_name)) and length(entity) = (select min(length(entity)) from blocked where contains(entity, lower(n_name)))) end as entity_found
from nation cross join (select unnest(generate_series(1995, 2002)) as fy)) r left join current_values c on r.fy <> 2002 and c.block_key = entity_found || '|' || metric_found || '|' || cast(r.fy - 1 as string) || '-04-01|' || cast(r.fy as string) || '-03-31'""", *_RELATED, _CURRENT),
        "q17_parse_question_coordinates": _sql("select n_nationkey as request_id, lower(n_name) as entity, 'revenue' as metric, 'FY1998' as period from nation where n_nationkey % 5 <> 0 and lower(n_name) in (select entity from blocked)", _CANON),
        "g2_dominant_units": _sql("select metric_key, unit, case unit when 'pct' then 'rate' when 'count' then 'count' when 'x' then 'ratio' else 'amount' end as unit_class from units", _PARTS),
        "g3_registry_rows": _sql("select m.key, m.claim_count as claims, u.unit, coalesce(l.labels, '') as labels from metrics m left join units u on u.metric_key = m.key left join (select metric_key, string_agg(label, '|' order by rn) as labels from (select metric_key, label, row_number() over (partition by metric_key order by min(claim_id), label) as rn from registered where label is not null group by 1, 2) where rn <= 3 group by 1) l on l.metric_key = m.key", _PARTS),
        "g4_parse_merge_proposals": _sql("select group_no, item_no, keep, alias, why from proposals", _PARTS),
        "g5_validate_merges": _sql("""select group_no, alias, keep, case when why is not null and not (why like 'unit%' and used is not null and group_no > used) then why when why is not null then 'already used' when turn > 1 then 'already used' else 'applied' end as outcome from (
select *, row_number() over (partition by alias, why is null order by group_no, item_no) as turn, min(case when why is null then group_no end) over (partition by alias) as used from (
select p.group_no, p.item_no, p.alias, p.keep, case when m.key is null or p.alias = p.keep then 'unknown key' when a.c <> k.c then 'unit differs (' || a.unit || ' vs ' || k.unit || ')' end as why from proposals p left join metrics m on m.key = p.alias
left join (select *, case unit when 'pct' then 1 when 'count' then 2 when 'x' then 3 else 4 end as c from units) a on a.metric_key = p.alias left join (select *, case unit when 'pct' then 1 when 'count' then 2 when 'x' then 3 else 4 end as c from units) k on k.metric_key = p.keep))""", _PARTS),
        "g6_apply_aliases_and_rebuild": _sql("select block_key, kind, count(*) as n from relations group by 1, 2", *_RELATED),
        "h4_page_features": _sql("select doc_id, page_no, case when doc_id % 4 = 0 then 'INR million' else '' end as units, case when doc_id % 6 = 0 then 'standalone' else '' end as scopes, case when doc_id % 6 = 0 then 'as at march 31, 2024' else '' end as periods, regexp_replace(text, '\\s', '', 'g') <> '' as text_layer from fx_pages", *paged),
        "h5_thin_pages": _sql("select doc_id, page_no, word_count, word_count < 40 and numbers < 3 as skipped from featured", *paged),
        "h6_ingest_summary": _sql("select doc_id, count(*) as pages, count(*) filter (where word_count < 40 and numbers < 3) as skipped, count(*) filter (where word_count = 0) as no_text_layer, count(*) filter (where doc_id % 4 = 0) as unit_pages, count(*) filter (where doc_id % 6 = 0) as scope_pages, count(*) filter (where doc_id % 6 = 0) as period_pages from featured group by 1", *paged),
        "e1_slices": _sql("select doc_id, first, least(first + 3, page_count) as last from (select doc_id, page_count, unnest(generate_series(1, page_count, 4)) as first from counted)", *paged),
        "e2_build_requests": _sql("""select s.doc_id, s.first, least(s.first + 3, s.page_count) as last, coalesce(string_agg(line, chr(10) order by f.page_no), '') as hint_lines, coalesce(string_agg(cast(case when f.word_count < 40 and f.numbers < 3 then f.page_no end as string), ',' order by f.page_no), '') as thin_pages,
(select string_agg(metric_raw, ',' order by n desc, metric_raw) from (select metric_raw, count(*) as n from fx_claims group by 1)) as registry_keys
from (select doc_id, page_count, unnest(generate_series(1, page_count, 4)) as first from counted) s join (select *, case when doc_id % 12 = 0 then 'p' || cast(page_no as string) || ': units INR million; scope standalone; period as at march 31, 2024' when doc_id % 4 = 0 then 'p' || cast(page_no as string) || ': units INR million' when doc_id % 6 = 0 then 'p' || cast(page_no as string) || ': scope standalone; period as at march 31, 2024' end as line from featured) f
on f.doc_id = s.doc_id and f.page_no between s.first and s.first + 3 group by s.doc_id, s.first, s.page_count""", *paged),
        "e3_parse_claim_lines": _sql("select doc_id, count(*) as claims, case when doc_id % 5 = 0 then 1 else 0 end as malformed from fx_claims group by 1"),
        "e4_trim_truncated": _sql("select c.doc_id, count(t.claim_id) as claims, case when c.broken then c.top end as next_start, false as partial from cut c left join trimmed t on t.doc_id = c.doc_id group by c.doc_id, c.broken, c.top", _RECORDS),
        "e4_resume_rounds": _sql("""select doc_id, cast(case when doc_id % 11 = 5 then 0 when w < 2 then 1 when w = 2 then 5 else least(5, 1 + cast(ceil((8 - w) / (w - 1.0)) as bigint)) end as bigint) as rounds, case when doc_id % 11 = 5 then 'pending' when w < 3 then 'partial' else 'complete' end as ended,
case when doc_id % 11 = 5 or w < 2 then 0 when w = 2 then 5 else 8 end as claims, case when doc_id % 11 = 5 or w < 2 then '' when w = 2 then '1,2,3,4,5' else '1,2,3,4,5,6,7,8' end as pages from (select doc_id, doc_id % 9 as w from fx_documents)"""),
        "e5_type_claims": _sql("select doc_id, page_no, subject, metric_raw, label, value_raw, unit_raw, period_raw, scope_raw, basis_raw, quote, cin from trimmed", _RECORDS),
        "e7_registry_counts": _sql("select metric_raw, count(*) as claim_count, min(label) as label, min(doc_id) as first_seen_doc from fx_claims group by 1"),
        "e8_replace_document": _sql("select metric_raw, count(*) as claim_count, min(label) as label, min(doc_id) as first_seen_doc from fx_claims where doc_id % 5 <> 0 group by 1"),
        "e9_document_outcome": _sql("select c.doc_id, count(t.claim_id) as claims, case when c.doc_id % 5 = 0 then 1 else 0 end as malformed, 'extracted' as status, case when count(t.claim_id) = 0 then 'no claims: ' || case when c.broken then 'MAX_TOKENS' else 'STOP' end end as reason from cut c left join trimmed t on t.doc_id = c.doc_id group by c.doc_id, c.broken", _RECORDS),
        "e10_pending_documents": _sql("select doc_id, ['queued', 'extracting', 'ready', 'failed', 'reconciling'][doc_id % 5 + 1] as status from fx_documents where doc_id % 5 in (0, 3) or (doc_id % 5 in (1, 4) and doc_id % 3 <> 0)"),
        "v1_normalize_text": _sql(_spelled("select doc_id, page_no, NORM(text) as norm from fx_pages"), *paged),
        "v4_with_neighbour_pages": _sql("select p.doc_id, p.page_no + (p.page_no - 1) // 2 as page_no, case when p.page_no % 2 = 0 then length(b.text) end as before, case when p.page_no % 2 = 1 then length(a.text) end as after from fx_pages p left join fx_pages b on b.doc_id = p.doc_id and b.page_no = p.page_no - 1 left join fx_pages a on a.doc_id = p.doc_id and a.page_no = p.page_no + 1", *paged),
        "e6_apply_document_lines": _sql("select doc_id, case when doc_id % 3 = 0 then 'Report ' || cast(doc_id as string) end as title, case when doc_id % 5 = 0 then 'Someone else' else publisher end as publisher, published_at from fx_documents"),
        "q14_match_entity": "with names as (select distinct lower(replace(c_name, '#', ' ')) as e from customer), asked as (select c_custkey, regexp_replace(c_name, 'Customer#0*([0-9])', '\\1') as a from customer) select c_custkey, (select e from names where contains(e, a) order by length(e), e limit 1) as entity_found from asked",
        "q15_match_metric": "select n_nationkey, case n_nationkey % 3 when 2 then 'profit' else 'revenue' end as metric_found from nation",
        "v6_verify_claims": _sql("select claim_id, status, grade, coalesce(located_page, page_no) as page_no, cast(strpos(place, hit) - 1 as int) as char_start, cast(strpos(place, hit) - 1 + length(hit) as int) as char_end, reason, case when reason = 'page_out_of_range' then 'page ' || cast(page_no as string) || ' of ' || cast(page_count as string) when reason is not null then left(quote, 200) end as detail from spanned", *gate),
        "v3_grade_quotes": _sql("select claim_id, status, grade, located_page, reason from gated", *gate),
        "v8_verify_stats": _sql("select doc_id, " + ", ".join(f"count(*) filter (where grade = '{g}') as {g}" for g in ("exact", "nearby", "tokens")) + ", count(*) filter (where status = 'quarantined') as quarantined, " + ", ".join(f"count(*) filter (where reason = '{r}') as {r}" for r in ("page_out_of_range", "no_text_layer", "quote_not_found")) + " from gated group by 1", *gate),
        "v9_reverify": _sql("select doc_id, " + ", ".join(f"count(*) filter (where grade = '{g}') as {g}" for g in ("exact", "nearby", "tokens")) + ", count(*) filter (where status = 'quarantined') as quarantined, " + ", ".join(f"count(*) filter (where reason = '{r}') as {r}" for r in ("page_out_of_range", "no_text_layer", "quote_not_found")) + " from gated group by 1", *gate),
        "q2_documents_summary": _sql("select c.doc_id, 'doc-' || cast(c.doc_id as string) as filename, coalesce(g.claims, 0) as claims, coalesce(g.verified, 0) as verified, coalesce(g.quarantined, 0) as quarantined, coalesce(g.exact, 0) as exact, coalesce(g.weak, 0) as weak, t.skipped_pages, coalesce(g.claims, 0) as new_metrics from counted c left join (select doc_id, count(*) as claims, count(*) filter (where status = 'verified') as verified, count(*) filter (where status = 'quarantined') as quarantined, count(*) filter (where grade = 'exact') as exact, count(*) filter (where grade = 'tokens') as weak from gated group by 1) g on g.doc_id = c.doc_id join (select doc_id, count(*) filter (where word_count < 40 and numbers < 3) as skipped_pages from featured group by 1) t on t.doc_id = c.doc_id", *gate),
        "q8_quarantine_list": _sql("select claim_id, reason, case when reason = 'page_out_of_range' then 'page ' || cast(page_no as string) || ' of ' || cast(page_count as string) else left(quote, 200) end as detail from gated where reason is not null", *gate),
        "s2_dedup_by_content": "with a as (select doc_id as arrival, sha256(coalesce(text, '')) as sha256 from documents) select arrival, sha256, arrival = min(arrival) over (partition by sha256) and sha256 not in (select sha256 from a where arrival % 10 = 0) as is_new from a where arrival % 10 <> 0",
        "s3_admit_documents": "select doc_id as arrival, case when octet_length(encode(coalesce(text, ''))) + case when doc_id % 3 = 0 then 0 else 9 end > 20000 then 'too large' when doc_id % 3 = 0 and not contains(left(coalesce(text, ''), 1024), '%PDF') then 'not a PDF' when doc_id % 5 = 0 then 'cannot be opened' when doc_id % 130 = 0 then 'no pages' when doc_id % 130 > 100 then 'too many pages' end as rejected from documents",
        "s3_admit_files": "select doc_id // 50 as part, sum(strlen(coalesce(text, '')) + 1 + case when doc_id // 50 % 3 = 0 then 9 else 0 end) <= 100000 as opened, case when sum(strlen(coalesce(text, '')) + 1 + case when doc_id // 50 % 3 = 0 then 9 else 0 end) > 100000 then 'too large' when doc_id // 50 % 3 <> 0 then 'not a PDF' end as rejected from documents group by 1, doc_id // 50 % 3",
        "s7_replace_documents": _sql("select claim_id, doc_id, metric_raw, case when doc_id % 7 = 3 then value_raw || '9' else value_raw end as value_raw from fx_claims where doc_id % 7 <> 3 or doc_id % 21 <> 3 and claim_id % 2 = 1"),
        "s6_response_key": """with keyed as (select doc_id, sha256(unhex(lpad(hex(cast(octet_length(encode(l)) as bigint)), 16, '0')) || encode(l) || unhex(lpad(hex(cast(octet_length(encode(t)) as bigint)), 16, '0')) || encode(t)) as key
from (select doc_id, coalesce(lang, '') as l, coalesce(text, '') as t from documents)) select doc_id, key from keyed where key not in (select key from keyed where doc_id % 4 = 1)""",
        "s6_replayed_requests": """with keyed as (select doc_id, coalesce(lang, '') as l, coalesce(text, '') as t from documents) select k.doc_id, s.reply_of from keyed k join (select l, t, min(doc_id) as reply_of from keyed where doc_id % 4 = 1 group by 1, 2) s on s.l = k.l and s.t = k.t""",
        "s1_read_raw_documents": "select doc_id // 1000 as part, cast(octet_length(encode(string_agg(coalesce(text, '') || chr(10), '' order by doc_id))) as bigint) as length, sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as sha256 from documents group by 1",
        "s4_read_pages": _sql("select doc_id, page_no, sha256(case when (doc_id + page_no) % 5 = 0 then '' else text end) as sha256 from fx_pages", *paged),
        "s5_read_responses": _sql("select doc_id, true as named, case when doc_id % 9 = 0 then 'MAX_TOKENS' else 'STOP' end as finish_reason, cast(null as bigint) as input_tokens, cast(sum(length(j) + 1) - 1 + 12 + max(case when doc_id % 5 = 0 then 9 else 0 end) as bigint) as output_tokens, true as whole from (select *, REPLY as j from fx_claims) group by 1").replace("REPLY", _REPLY),
        "s8_publish_and_verify": _sql("select t as table_name, n as source_rows, n as target_rows, 'ok' as outcome from (select 'documents' as t, count(*) as n from fx_documents union all select 'claims', count(*) from fx_claims union all select 'pages', count(*) from fx_pages)", *paged),
        "i1_incremental_documents": _sql(_REL, *_RELATED),
        "i2_stream_dedup": "select sha256(t) as sha256, octet_length(encode(t)) as n_bytes from (select distinct coalesce(text, '') as t from documents)",
    }
    return found | {"q16_answer_stored": found["q16_answer_requests"], "q3_search_stored": found["q3_search_claims"]}
