"""The contract queries, one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, embeddings, licenses, mixing, quality, repeats, secrets, sharding, simhash, tokens, toxicity, variants
from .common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_spans", "spans")


def op2_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.fair_queue(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", "taken", "copies", "place")


def op3_simhash_vp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_copies(read(spark, sf_dir, "documents"), shingle=3, lanes=1, radius=3, block_radius=1)
    return rows.select("doc_id", F.lower(F.lpad(F.hex(F.col("lanes")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op4_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(read(spark, sf_dir, "documents"))


def op7_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_read(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(read(spark, sf_dir, "documents"))


def op9_rare_word_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_trie_frontier_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents"))


def op12_ordered_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_target_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


#: Windows by their words; the runs of removed words are islands of places.
OP8_SQL = r"""with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
placed as (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as p from split where len(w) >= 13),
keyed as (select doc_id, p, array_to_string(w[p : p + 12], ' ') as k from placed),
least as (select k, min(doc_id) as d from keyed group by 1),
hit as (select a.doc_id, a.p from keyed a join least b on a.k = b.k where b.d < a.doc_id),
gone as (select distinct doc_id, p + o as i from hit cross join (select unnest(generate_series(0, 12)) as o)),
islands as (select doc_id, min(i) - 1 as a, max(i) as b from (select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from gone) group by doc_id, g),
spans as (select doc_id, string_agg(cast(a as varchar) || ':' || cast(b as varchar), ',' order by a) as s from islands group by 1),
words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from split where len(w) > 0),
kept as (select w.doc_id, string_agg(w.word, ' ' order by w.i) as t from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i where g.i is null group by 1)
select s.doc_id, len(s.w) as n_words, coalesce(n.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256, coalesce(p.s, '') as spans
from split s left join (select doc_id, count(*) as n from gone group by 1) n on n.doc_id = s.doc_id left join kept k on k.doc_id = s.doc_id left join spans p on p.doc_id = s.doc_id"""

#: Words by their places in pieces; pairs and triples by looking ahead; products in 128 bits.
OP12_SQL = r"""with words as (select doc_id, lang, p, generate_subscripts(w, 1) as i, unnest(w) as w from (
  select doc_id, lang, generate_subscripts(pieces, 1) as p, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') as w from (
  select row_number() over () as doc_id, coalesce(lang, 'und') as lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces from documents))),
total as (select lang, count(*) as n from words group by 1),
ahead as (select lang, w as w1, lead(w) over q as w2, lead(w, 2) over q as w3 from words window q as (partition by doc_id, p order by i)),
grams as (select lang, w1 as phrase, 1 as k, count(*) as f from ahead group by 1, 2 union all
  select lang, w1 || ' ' || w2, 2, count(*) from ahead where w2 is not null group by 1, 2 having count(*) >= 10 union all
  select lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) from ahead where w3 is not null group by 1, 2 having count(*) >= 10),
cand as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from grams where k > 1 and f >= 10),
cuts as (select c.lang, c.phrase, c.k as size, c.a, s.k, array_to_string(c.w[1 : s.k], ' ') as lp, array_to_string(c.w[s.k + 1 :], ' ') as rp, w from cand c join (select unnest([1, 2]) as k) s on s.k < c.k),
cut as (select c.lang, c.phrase, c.size, c.a, c.k, l.f as l, r.f as r, cast((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as bigint) as score from cuts c join grams l on l.lang = c.lang and l.phrase = c.lp join grams r on r.lang = c.lang and r.phrase = c.rp),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (select distinct p.lang, p.phrase from cand p join (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from cand where k = 3) x on x.lang = p.lang and x.part = p.phrase where p.k = 2 and 100 * x.a >= 50 * p.a),
ranked as (select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank, b.phrase, b.a, b.l, b.r, b.score from best b anti join covered v on v.lang = b.lang and v.phrase = b.phrase)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join total t using (lang) where r.rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express: the others hash, fit, encode or score."""
    return {"op8_suffix_tree_repeats": OP8_SQL, "op12_ordered_stream_collocations": OP12_SQL}
